"""Page reading and comparison on literal HTML."""

import pytest
from pyspark.sql import functions as F

from quire.operators import compare as cp
from quire.sources import pages as pg

CASES = {
    "<h1>No</h1><h2>Two</h2><p>x</p>bare<nav>n</nav><h3>T</h3>": [("heading", 2, "Two"), ("paragraph", None, "x"), ("heading", 3, "T")],
    "<p>a <em>b</em><br><strong>c</strong></p>": [("paragraph", None, "a b\nc")],
    "<p>one<p>two": [("paragraph", None, "one"), ("paragraph", None, "two")],
    "<blockquote><p>q1</p><p>q2</p></blockquote><blockquote>plain</blockquote>": [("quote", None, "q1"), ("quote", None, "q2"), ("quote", None, "plain")],
    "<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul>": [("bulletListItem", None, "a"), ("numberedListItem", None, "b"), ("bulletListItem", None, "c")],
    '<div class="narrative"><p class="narrative-label">L</p><p>n1</p><p>n2</p></div>': [("narrative", None, "n1"), ("narrative", None, "n2")],
    "<section><div><p>deep</p></div></section><hr>": [("paragraph", None, "deep"), ("divider", None, "")],
    "<p>x</p><script>var p = '<p>no</p>';</script><aside>no</aside>": [("paragraph", None, "x")],
}


@pytest.mark.parametrize("html", CASES)
def test_blocks(html):
    rows = pg.read_article(1, f"<html><body><p>outside</p><article>{html}</article><p>after</p></body></html>")
    assert [(r[4], r[5], "".join(x["text"] for x in r[6])) for r in rows] == CASES[html]


def test_nesting_figures_notes_and_tables():
    html = (
        '<article><ul><li>a<ul><li>b</li></ul></li></ul><figure class="x portrait"><img alt="A" src="s/figure-3-original.png"><figcaption><span class="fignum">Fig 3</span>'
        '<em>Cap</em> &amp; co</figcaption></figure><aside class="footnote"><span class="fn-num">7</span> Note <strong>b</strong></aside>'
        '<table><tr><td>1</td><th><b>2</b></th></tr><tr><td>3</td></tr></table><p>w<sup class="fn-ref">7</sup><a href="u">l <i>k</i></a></p></article>'
    )
    rows = pg.read_article(9, html)
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [
        (0, None, 0, "bulletListItem"), (1, 0, 1, "bulletListItem"), (2, None, 0, "image"), (3, None, 0, "footnote"), (4, None, 0, "table"), (5, None, 0, "paragraph"),
    ]
    assert rows[2][7] == {"display_width": "portrait", "approval": "approved", "src": "s/figure-3-original.png", "alt_text": "A", "caption": "<em>Cap</em> &amp; co"}
    assert rows[3][7] == {"marker": "7", "text": "Note <strong>b</strong>"}
    assert [[c[0]["text"] for c in row] for row in rows[4][8]] == [["1", "2"], ["3"]]
    runs = [(x["text"], x["fn_ref"], x["italic"], x["href"]) for x in rows[5][6]]
    assert runs == [("w", False, False, None), ("7", True, False, None), ("l ", False, False, "u"), ("k", False, True, "u")]


def test_meta(spark):
    html = (
        '<html><head><meta content="About &amp; more" name="description"><link rel="canonical" href="https://e/x.html"><meta property="og:image" content="i.png">'
        '<script type="application/ld+json">{"datePublished":"2020-01-02","author":{"name":"N"}}</script></head><body class="a has-toc">'
        '<p class="overline"><a class="overline-home" href="/h">Home</a></p><h1 class="title">The  <em>Title</em></h1>'
        '<p class="byline"><span class="author">Ann</span><span class="dot">·</span><span>1950–1960</span><span>Perth</span></p><p class="standfirst">Stand</p>'
        '<nav class="docnav"><a class="prev" href="p.html"><div class="nm">Prev</div></a><a class="next" href="n.html"><div class="nm">Next</div></a></nav>'
        "<footer><p>© <a href='c'>x</a></p></footer></body></html>"
    )
    row = pg.page_meta(spark.createDataFrame([(1, html)], "page_id long, html string")).first().asDict()
    assert row == {
        "page_id": 1, "title": "The Title", "overline": "Home", "author": "Ann", "year_display": "1950–1960", "place": "Perth", "standfirst": "Stand",
        "meta_description": "About & more", "canonical_url": "https://e/x.html", "og_image": "i.png", "homepage_url": "/h", "date_published": "2020-01-02",
        "show_toc": True, "footer_html": "© <a href='c'>x</a>", "prev_url": "p.html", "prev_title": "Prev", "next_url": "n.html", "next_title": "Next",
    }


def test_dom_tokens_ignore_noise(spark):
    a = '<div class="b open a" id="x"><!-- c --><p>t  t</p><script type="application/ld+json">{"b":1,"a":2}</script></div>'
    b = '<div id="x" class="b a"><p>t t</p><script type="application/ld+json">{"a":2, "b":1}</script></div>'
    pages = lambda html: spark.createDataFrame([(1, html)], "page_id long, html string")
    tokens = [r.token for r in pg.dom_tokens(pages(a)).orderBy("idx").collect()]
    assert tokens == ['<div class="b a" id="x">', "<p>", "t t", "</p>", '<script type="application/ld+json">{"a":2,"b":1}', "</div>"]
    same, other = (cp.dom_compare(pages(a), pages(x)).first() for x in (b, b.replace(">t t<", ">u<")))
    assert (same.similarity, same.same_order, same.diffs) == (1.0, True, [])
    assert other.similarity == 10 / 12 and not other.same_order
    (edit,) = other.diffs
    assert (edit.op, edit.expected, edit.actual, edit.before[-1], edit.after[0]) == ("replace", ["t t"], ["u"], "<p>", "</p>")
    turned = cp.dom_compare(pages("<p>a</p><p>b</p>"), pages("<p>b</p><p>a</p>")).first()
    assert (turned.similarity, turned.same_order) == (8 / 12, False)


FIDELITY = [
    ("same", "same", (0, 0, 0), True, "typography"),
    ("“Hi” there", '"Hi"  there', (0, 0, 0), True, "typography"),
    ("a b", "a b c", (1, 0, 0), False, "inserted 1"),
    ("a b c d", "a d", (0, 2, 0), False, "deleted 2"),
    ("a b c", "a x c", (0, 0, 1), False, "replaced 1"),
    ("well known", "well-known", (0, 0, 0), True, "typography"),
    ("*a* b", "a *b*", (0, 0, 0), True, "typography"),
    ("a[^1] b", "a b", (0, 0, 1), False, "replaced 1"),
    ("a [^1]", "a [^2]", (0, 0, 1), False, "replaced 1"),
    ("a b c", "c b a", (2, 2, 0), False, "inserted 2, deleted 2"),
]


def test_fidelity(spark):
    schema = "block_id long, text string"
    a = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FIDELITY)], schema)
    b = spark.createDataFrame([(i, f[1]) for i, f in enumerate(FIDELITY)], schema)
    got = cp.fidelity(a, b, ["block_id"]).orderBy("block_id").collect()
    assert [((r.word_inserts, r.word_deletes, r.word_replaces), r.typography_only, r.summary) for r in got] == [f[2:] for f in FIDELITY]


def test_word_segments_spell_both_sides(spark):
    pairs = [("a b  c", "a x c d"), ("", "n"), ("same one", "same one"), ("tail ", "tail")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", cp.word_diff_segments(F.col("a"), F.col("b")).alias("s")).collect():
        assert "".join(x.a for x in r.s) == r.a and "".join(x.b for x in r.s) == r.b
