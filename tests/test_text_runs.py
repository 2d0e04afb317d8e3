"""Scalar and run functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import runs as rn
from quire.functions import text as tx
from quire.operators import blocks as bl
from quire.sources.tables import BLOCKS


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


FLAGS = ("bold", "italic", "underline", "strike", "code", "fn_ref")


def run(text, href=None, **flags):
    return {"text": text, "href": href, **{f: flags.get(f, False) for f in FLAGS}}


def with_runs(spark, cases):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, runs array<{rn.RUN.simpleString()}>")


@pytest.mark.parametrize(
    "words,label",
    [(0, ""), (-3, ""), (1, "~5 min read"), (1000, "~5 min read"), (5000, "~25 min read"), (28903, "~2½ hr read"), (24200, "~2 hr read"), (12000, "~1 hr read")],
)
def test_reading_time(spark, words, label):
    assert one(spark, t=tx.reading_time(F.lit(words))).t == label


@pytest.mark.parametrize(
    "slug,lenient,strict", [("1953_title", 1953, 9999), ("1953-title", 1953, 1953), ("title", 9999, 9999), ("-1953", 9999, 9999), ("1953", 1953, 1953)]
)
def test_start_year(spark, slug, lenient, strict):
    got = one(spark, a=tx.start_year(F.lit(slug)), b=tx.start_year(F.lit(slug), True))
    assert (got.a, got.b) == (lenient, strict)


def test_text_helpers(spark):
    cases = [
        (tx.norm_key(F.lit("  Straße\xa0 A ")), "strasse a"),
        (tx.fix_smart_quotes(F.lit('„Hi” a"b"c won”t ‚x')), '“Hi” a’b’c won’t ‘x'),
        (tx.collapse_repeats(F.lit("Baby Junior Baby  Junior")), "Baby Junior"),
        (tx.collapse_repeats(F.lit("a  b")), "a b"),
        (tx.strip_emphasis(F.lit(r"**A \*b**")), "A *b"),
        (tx.strip_emphasis(F.lit("*x*")), "x"),
        (tx.strip_sup_sub(F.lit('1<SUP a="b">st</sup>')), "1st"),
        (tx.slugify(F.lit("Élan — the Größe!")), "elan-the-grosse"),
        (tx.html_fragment_to_md(F.lit('<em>a</em> <b>b</b> <a href="u">c</a> <span>d</span> &amp;')), "*a* **b** [c](u) d &"),
        (tx.bind_digit_refs(F.lit("Vietnam1 in 1966 x12 a1b2"), F.array(F.lit(1), F.lit(2))), "Vietnam[^1] in 1966 x12 a[^1]b2"),
        (tx.footer(F.lit("© A & B"), F.lit("CC"), F.lit("http://x?a=1&b")), '© A &amp; B · <a href="http://x?a=1&amp;b">CC</a>'),
        (tx.footer(F.lit(" "), F.lit(""), F.lit("u")), ""),
        (tx.year_display(F.lit(1934), F.lit(1945)), "1934–1945"),
        (F.array_join(tx.tokenize_words(F.lit("“Hi,” *there*… a—b -")), "|"), "Hi|there|a-b"),
    ]
    got = one(spark, **{f"c{i}": c for i, (c, _) in enumerate(cases)})
    assert list(got) == [w for _, w in cases]


def test_slugs_keep_other_scripts(spark):
    cases = [("Мир и 한국!", "мир-и-한국"), ("Élan vital", "elan-vital"), ("Straße Æ", "strasse-ae"), ("--", ""), ("日本 2", "日本-2")]
    got = one(spark, **{f"c{i}": tx.slugify(F.lit(t)) for i, (t, _) in enumerate(cases)})
    assert list(got) == [w for _, w in cases]


@pytest.mark.parametrize("text,caps,year", [("ARRINO", True, False), ("1945", False, True), ("1939–1945.", False, True), ("Arrino", False, False), ("1745", False, False)])
def test_headings(spark, text, caps, year):
    got = one(spark, a=tx.is_caps(F.lit(text)), b=tx.is_year_heading(F.lit(text)))
    assert (got.a, got.b) == (caps, year)


def test_rendering_order_of_styles(spark):
    cases = [
        [run("a<b", bold=True, italic=True)], [run("1", fn_ref=True, bold=True)], [run("t", href="u?a&b", italic=True)], [run("x\ny", code=True, bold=True)], [],
    ]
    df = with_runs(spark, cases).select("i", rn.inline_html(F.col("runs")).alias("h"), rn.inline_md(F.col("runs")).alias("m"), rn.polish_text(F.col("runs")).alias("p"))
    rows = df.orderBy("i").collect()
    assert [r.h for r in rows] == [
        "<em><strong>a&lt;b</strong></em>", '<sup class="fn-ref">1</sup>', '<a href="u?a&amp;b"><em>t</em></a>', "<strong><code>x<br>y</code></strong>", "",
    ]
    assert [r.m for r in rows] == ["***a<b***", "[1]", "[*t*](u?a&b)", "**`x  \ny`**", ""]
    assert [r.p for r in rows] == ["***a<b***", "[^1]", "[*t*](u?a&b)", "`x\ny`", ""]


@pytest.mark.parametrize(
    "text,want",
    [
        ("plain", [("plain", "", None)]), ("a **b** c", [("a ", "", None), ("b", "b", None), (" c", "", None)]), ("*i*", [("i", "i", None)]),
        ("***x***", [("x", "bi", None)]), ("w[^12].", [("w", "", None), ("12", "f", None), (".", "", None)]),
        ("[a *b*](u)", [("a ", "", "u"), ("b", "i", "u")]), ("", []),
    ],
)
def test_parse_marked_text(spark, text, want):
    runs = one(spark, r=rn.runs_of(F.lit(text))).r
    got = [(r["text"], "b" * r["bold"] + "i" * r["italic"] + "f" * r["fn_ref"], r["href"]) for r in runs]
    assert got == want


@pytest.mark.parametrize(
    "runs,want",
    [
        ([run("all", italic=True)], True), ([run("a", italic=True), run(" , "), run("b", italic=True)], True), ([run("a", italic=True), run("b")], False),
        ([run("a", italic=True), run("1", fn_ref=True)], True), ([run("1", fn_ref=True)], False), ([run("  ", italic=True)], False), ([], False),
        ([run("l", href="u", italic=True)], True), ([run("l", href="u"), run("x", italic=True)], False),
    ],
)
def test_fully_italic(spark, runs, want):
    assert with_runs(spark, [runs]).select(rn.fully_italic(F.col("runs")).alias("x")).first().x is want


def test_narrative_keeps_notes_and_ids(spark):
    runs = [run("A", italic=True, bold=True), run("1", fn_ref=True, italic=True)]
    df = spark.createDataFrame([(1, 0, "b", None, 0, "paragraph", None, "A1", runs, {"k": "v"}), (1, 1, "c", 0, 1, "paragraph", None, "A", runs[:1], {})], BLOCKS)
    once = bl.to_narrative(df)
    a, b = once.orderBy("pos").collect()
    assert (a.type, a.block_id, a.props) == ("narrative", "b", {})
    assert [(r.italic, r.bold, r.fn_ref) for r in a.runs] == [(False, True, False), (True, False, True)]
    assert b.type == "paragraph"
    assert sorted(bl.to_narrative(once).collect(), key=str) == sorted(once.collect(), key=str)


def test_word_count_and_hash(spark):
    def rows(ids):
        return spark.createDataFrame(
            [
                (1, 0, ids[0], None, 0, "paragraph", None, "", [run("one two"), run("1", fn_ref=True), run("three")], {}),
                (1, 1, ids[1], None, 0, "heading", 2, "", [run("a b")], {}),
                (1, 2, ids[2], None, 0, "image", None, "", [], {"caption": "not counted", "asset_id": "x"}),
                (1, 3, ids[3], None, 0, "narrative", None, "", [run("not counted")], {}),
            ],
            BLOCKS,
        )

    assert bl.word_counts(rows("abcd")).first().words == 6
    assert bl.content_hash(rows("abcd")).first() == bl.content_hash(rows("wxyz")).first()
    changed = rows("abcd").withColumn("level", F.when(F.col("pos") == 1, 3).otherwise(F.col("level")))
    assert bl.content_hash(changed).first() != bl.content_hash(rows("abcd")).first()
