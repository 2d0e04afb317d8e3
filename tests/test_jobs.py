"""Replies, prompts, CSV, layout, search, lifecycle and streams on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import apply as ap
from quire.operators import layout as ly
from quire.operators import library as lb
from quire.operators import linear as ln
from quire.operators import search as se
from quire.operators import tracks as tk
from quire.operators import versions as vs
from quire.sources import files as fl
from quire.sources import sinks as sk
from quire.sources.tables import BLOCKS, RUN
from quire.streaming import incremental as inc

# ---------------------------------------------------------------- replies

REPLIES = [
    ('{"digest_md":"d","people":[{"name":"Ann","role":null,"extra":1},"junk",null]}', True),
    ('```json\n{"digest_md":"d"}\n```', True), ('Sure! {"digest_md":"d"} bye', True), ("{bad", False), ('{"people":[]}', False), ('["digest_md"]', False), ('{"digest_md":" "}', False),
    ('{"digest_md":5}', False), ('{"digest_md":"d","people":"none"}', True),
]


def test_replies_to_tracks(spark):
    df = spark.createDataFrame([(1, "s", i, raw) for i, (raw, _) in enumerate(REPLIES)], "doc_id long, source_name string, chapter_idx int, raw string")
    out = tk.replies_to_tracks(df)
    assert sorted(r.chapter_idx for r in out["digests"].collect()) == [i for i, (_, ok) in enumerate(REPLIES) if ok]
    assert sorted(r.chapter_idx for r in out["failures"].collect()) == [i for i, (_, ok) in enumerate(REPLIES) if not ok]
    assert [(r.track_type, r.data) for r in out["tracks"].collect()] == [("people", {"section": "", "name": "Ann", "role": ""})]


def test_dedup_keeps_first_and_all_chronology(spark):
    rows = [
        (1, "s", "people", 0, 0, {"name": "Ann  B", "section": "1"}), (1, "s", "people", 1, 0, {"name": " ann b", "section": "2"}), (1, "s", "people", 1, 1, {"name": " "}),
        (1, "s", "chronology", 0, 0, {"marker": "1950"}), (1, "s", "chronology", 2, 5, {"marker": "1950"}), (2, "s", "people", 0, 0, {"name": "ANN B"}),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source_name string, track_type string, chapter_idx int, row_idx int, data map<string,string>")
    got = sorted((r.doc_id, r.track_type, r.seq, r.data.get("section")) for r in tk.dedup_tracks(df).collect())
    assert got == [(1, "chronology", 0, None), (1, "chronology", 1, None), (1, "people", 0, "1"), (2, "people", 0, None)]


IDS = ["x-1", "x-2"]


@pytest.mark.parametrize(
    "raw,ok,error",
    [
        ('[{"id":"b000","kind":"p","text":"A"},{"id":"b001","kind":"h2","text":"B"}]', True, ""),
        ('```json\n{"id":"b000","kind":"p","text":"A"}\n{"id":"x-2","kind":"p","text":"B"}\n```', True, ""),
        ('{"id":"ctx","kind":"p","text":"c"}{"id":"b000","kind":"p","text":"A"}{"id":"b001","kind":"p","text":"B"}', True, ""),
        ('{"id":"b000","kind":"p","text":"A"}', False, "missing: 1"),
        ('{"id":"b000","kind":"p","text":"A"}{"id":"b000","kind":"p","text":"A"}{"id":"b001","kind":"p","text":"B"}', False, "repeated_id: 1"),
        ('{"id":"b009","kind":"p","text":"A"}{"id":"b000","kind":"p","text":"A"}{"id":"b001","kind":"p","text":"B"}', False, "unknown_id: 1"),
        ('{"id":"b000","kind":"p","text":7}{"id":"b001","kind":"p","text":"B"}', False, "text_type: 1, missing: 1"),
        ('{"id":"b000","kind":"p","text":"a}{"}\n{"id":"b001","kind":"p","text":"{\\"id\\": 1}"}', True, ""),
        ('{"id":"b000","text":"A"}{"id":"b001","kind":"p","text":"B"}', False, "incomplete: 1, missing: 1"),
        ("no reply", False, "unreadable"),
    ],
)
def test_block_replies(spark, raw, ok, error):
    df = spark.createDataFrame([(raw, IDS)], "raw string, ids array<string>")
    got = df.select(ap.parse_block_replies("raw", "ids").alias("r")).first().r
    assert (got.ok, got.error) == (ok, error)
    if ok:
        assert [r.block_id for r in got.replies] == IDS
        assert [r.text for r in got.replies] in (["A", "B"], ["a}{", '{"id": 1}'])
    else:
        assert not got.replies


# ---------------------------------------------------------------- CSV

TRICKY = [("a,b", 'say "hi"', "line\nbreak"), ("plain", "", " spaced "), ('"', ",", '""')]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, "src", "people", i, {"section": a, "name": b, "role": c}) for i, (a, b, c) in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "doc_id long, source_name string, track_type string, seq int, data map<string,string>")
    sk.write_tracks_csv(df, str(tmp_path), single_file=True)
    back = sk.read_tracks_csv(spark, str(tmp_path), "people").na.fill("").collect()
    assert [(r.section, r.name, r.role_or_relationship) for r in back] == TRICKY
    assert sk.validate_widths(spark, str(tmp_path), "people") == 4
    assert sk.validate_widths(spark, str(tmp_path), "geo") == 0


def test_csv_wrong_width(spark, tmp_path):
    (tmp_path / "people").mkdir()
    (tmp_path / "people" / "a.csv").write_text("source,section,name,role_or_relationship\na,b,c,d\na,b\n")
    with pytest.raises(ValueError):
        sk.validate_widths(spark, str(tmp_path), "people")


# ---------------------------------------------------------------- layout

SPAN = "doc_id long, page int, block int, line int, span int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean, text string, page_width double, page_height double"


def line(block, n, text, y, size=10.0, bold=False, italic=False, x=50.0, page=0, width=None):
    width = len(text) * 5.0 if width is None else width
    y = float(y)
    return (1, page, block, n, 0, x, y, x + width, y + 10, size, bold, italic, text, 600.0, 800.0)


def test_page_pipeline(spark):
    spans = [
        line(0, 0, "ARRINO", 50, bold=True, x=260.0, width=80.0), line(0, 1, "The Farm", 62, bold=True), line(0, 2, "First line", 74), line(0, 3, "goes on.", 86),
        line(0, 4, " ", 98), line(0, 5, "New para ends here.1", 110),
        line(1, 0, "Body above note.2", 700), line(1, 1, "2 The second note text", 712, size=8.0), line(1, 2, "runs over", 724, size=8.0), line(1, 3, "3 Third one here", 736, size=8.0),
        line(1, 4, "9 not in sequence", 748, size=8.0), line(2, 0, "17", 760),
        line(0, 0, "Contents", 50, page=1), line(1, 0, "Chapter 1 ... 2", 70, page=1), line(0, 0, "Last page text.", 50, page=2, italic=True),
    ]
    lines = ly.line_style(spark.createDataFrame(spans, SPAN))
    modes = ly.font_mode(spark.createDataFrame(spans, SPAN))
    assert modes.first().body_size == 10.0
    kept = ly.drop_toc_pages(ly.split_bold_lines(ly.drop_page_numbers(lines)))
    body, notes = ly.split_footnote_zone(kept, modes)
    assert [(r.n, r.local_num, r.text) for r in notes.orderBy("n").collect()] == [
        (1, 2, "The second note text runs over"), (2, 3, "Third one here 9 not in sequence"),
    ]
    out = ly.paragraph_groups(body, ly.heading_thresholds(modes)).orderBy("pos").collect()
    assert [(r.kind, r.text) for r in out] == [
        ("h2", "ARRINO"), ("h3", "The Farm"), ("p", "First line goes on."), ("p", "New para ends here.1"), ("p", "Body above note.[^1][^2]"), ("p", "*Last page text.*"),
    ]


def test_md_line_keeps_blanks_outside(spark):
    s = [(1, 0, 0, 0, i, 0.0, 0.0, 1.0, 1.0, 10.0, b, it, t, 600.0, 800.0) for i, (t, b, it) in enumerate([("a ", False, True), (" b", False, True), (" c ", True, True), ("d", False, False), ("  ", True, False)])]
    row = ly.line_style(spark.createDataFrame(s, SPAN)).first()
    assert row.md == "*a  b* ***c*** d" and row.text == "a  b c d"


def test_captions_are_claimed_once(spark):
    blocks = spark.createDataFrame(
        [
            (1, 0, 0, 40.0, 205.0, 200.0, 215.0, "Under  both", 8.0), (1, 0, 1, 40.0, 220.0, 200.0, 230.0, "second line", 8.0), (1, 0, 2, 40.0, 260.0, 200.0, 270.0, "too far", 8.0),
            (1, 0, 3, 40.0, 206.0, 200.0, 216.0, "body size", 12.0),
        ],
        "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, text string, size double",
    )
    pics = spark.createDataFrame([(1, 0, 0, 40.0, 100.0, 200.0, 200.0), (1, 0, 1, 45.0, 110.0, 205.0, 202.0)], "doc_id long, page int, image int, x0 double, y0 double, x1 double, y1 double")
    modes = spark.createDataFrame([(1, 12.0)], "doc_id long, body_size double")
    caps, claimed = ly.caption_blocks(pics, blocks, modes)
    assert [(r.image, r.caption) for r in caps.collect()] == [(0, "Under both second line")]
    assert sorted(r.block for r in claimed.collect()) == [0, 1]
    lines = spark.createDataFrame(
        [(1, 0, 7, 0, 50.0, 210.0, 150.0, 220.0, "in column"), (1, 0, 7, 1, 50.0, 240.0, 500.0, 250.0, "wide")],
        "doc_id long, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, text string",
    )
    fallback, keys = ly.caption_lines(pics, lines, caps)
    assert [(r.image, r.caption) for r in fallback.collect()] == [(1, "in column")]
    assert [(r.block, r.line) for r in keys.collect()] == [(7, 0)]


def joined(a, b):
    def bands(lo, hi):
        shared = max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
        return shared / max(1e-6, a[hi] - a[lo], b[hi] - b[lo]) >= 0.7

    def gap(lo, hi):
        return abs(max(a[lo], b[lo]) - min(a[hi], b[hi])) <= 3.0

    return (bands(0, 2) and gap(1, 3)) or (bands(1, 3) and gap(0, 2))


def test_tiles_match_pairwise_union(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for page in range(40):
        boxes = []
        for _ in range(rng.randint(1, 9)):
            x, y = rng.choice([0, 0, 0, 100, 101]), rng.choice([0, 50, 52, 100, 103, 150])
            boxes.append((float(x), float(y), float(x + rng.choice([100, 100, 98, 40])), float(y + rng.choice([50, 48, 50, 2]))))
        label = list(range(len(boxes)))
        for i in range(len(boxes)):
            for j in range(i):
                if joined(boxes[i], boxes[j]) and label[i] != label[j]:
                    lo, hi = sorted((label[i], label[j]))
                    label = [lo if k == hi else k for k in label]
        rows += [(1, page, i, *b) for i, b in enumerate(boxes)]
        want[page] = sorted([i for i, k in enumerate(label) if k == g] for g in set(label))
    df = spark.createDataFrame(rows, "doc_id long, page int, tile int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in ly.tile_components(df).collect():
        got.setdefault(r.page, []).append(list(r.tiles))
    assert {p: sorted(g) for p, g in got.items()} == want


# ---------------------------------------------------------------- body HTML


def test_nested_lists_and_tables(spark):
    run = lambda t, **k: {"text": t, **{f: k.get(f, False) for f in ("bold", "italic", "underline", "strike", "code", "fn_ref")}, "href": None}
    kinds = [("p", 0, "paragraph"), ("a", 0, "bulletListItem"), ("b", 1, "numberedListItem"), ("c", 2, "bulletListItem"), ("d", 1, "numberedListItem"), ("e", 0, "bulletListItem"),
             ("f", 0, "numberedListItem"), ("q", 0, "quote"), ("g", 0, "bulletListItem"), ("", 0, "table"), ("x", 1, "paragraph")]
    rows = [(1, i, f"b{i}", None, depth, kind, None, t, [run(t)] if t else [], {}, [[[run("1", bold=True)], [run("2")]], [[], [run("<")]]] if kind == "table" else None) for i, (t, depth, kind) in enumerate(kinds)]
    schema = T.StructType(BLOCKS.fields + [T.StructField("cells", T.ArrayType(T.ArrayType(T.ArrayType(RUN))))])
    html = ln.body_html(spark.createDataFrame(rows, schema)).first().html
    assert html.split("\n") == [
        '<p class="lead">p</p>', "<ul><li>a<ol><li>b<ul><li>c</li></ul></li><li>d</li></ol></li><li>e</li></ul>", "<ol><li>f</li></ol>",
        "<blockquote><p>q</p></blockquote>", "<ul><li>g</li></ul>", "<table><tr><td><strong>1</strong></td><td>2</td></tr><tr><td></td><td>&lt;</td></tr></table>",
    ]


# ---------------------------------------------------------------- search


def test_phrases_and_snippet(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "a-1", "Été", "one two three " * 10 + "mother's well-known boat " + "four " * 20), (2, "b", "x", "known well boat mothers"), (3, "c", "y", "")],
        "doc_id long, slug string, title string, body string",
    )
    se.write_index(docs, f"{tmp_path}/index")
    postings, lengths = se.stored_index(spark, f"{tmp_path}/index")
    found = lambda q: [r.doc_id for r in se.search(postings, lengths, q).collect()]
    assert found("well-known") == [1] and found("mother's BOAT") == [1] and found("ete") == [1] and found("boat") in ([2, 1], [1, 2]) and found(" ") == [] and found("boat nowhere") == []
    snip = se.search_with_snippets(docs, postings, lengths, "well-known boat").first().snippet
    assert "<b>well-known</b> <b>boat</b>" in snip and snip.startswith("…") and snip.endswith("…")


def test_every_script_is_found_and_replaced(spark):
    schema = "doc_id long, slug string, title string, body string"
    docs = spark.createDataFrame([(1, "s", "Чайковский", "ёлка играет 한국어"), (2, "t", "", None)], schema)
    index = se.build_index(docs)
    assert sorted((r.doc_id, r.length) for r in index[1].collect()) == [(1, 5), (2, 1)]
    for word in ("Чайковский", "한국어", "ёлка", "играет"):
        assert [r.doc_id for r in se.search(*index, word).collect()] == [1]
    changed = se.replace_in_index(*index, spark.createDataFrame([(1, "s", "", "new words")], schema))
    assert se.search(*changed, "играет").count() == 0
    assert [r.doc_id for r in se.search(*changed, "new-words").collect()] == [1]


# ---------------------------------------------------------------- lifecycle


def test_version_cycle(spark):
    docs = spark.createDataFrame([(1, "memoir", "h1")], "doc_id long, kind string, content_hash string")
    targets = spark.createDataFrame([(1, "pages"), (2, "drive")], "target_id long, target_kind string")
    sync = spark.createDataFrame([], "doc_id long, target_id long, snapshot_id long, status string, published_at timestamp")
    history = spark.createDataFrame([], "snapshot_id long, doc_id long, content_hash string, note string, created_at timestamp")
    now = F.lit("2024-01-01").cast("timestamp")
    flags = lambda d, s, h: {r.target_id: (r.status, r.dirty) for r in lb.dirty_matrix(d, targets, s, h).collect()}
    assert flags(docs, sync, history) == {1: ("NEVER_PUBLISHED", True), 2: ("NEVER_PUBLISHED", True)}
    history = history.unionByName(vs.snapshot(docs, docs.drop("kind"), history, "n", now))
    event = spark.createDataFrame([(1, 1, 1)], "doc_id long, target_id long, snapshot_id long").withColumn("at", now)
    sync = vs.mark_published(sync, event)
    assert flags(docs, sync, history)[1] == ("PUBLISHED", False)
    edited = docs.withColumn("content_hash", F.lit("h2"))
    assert flags(edited, sync, history)[1] == ("PUBLISHED", True)
    good, bad = vs.rollback(spark.createDataFrame([(1, 1), (1, 9)], "doc_id long, snapshot_id long"), history)
    assert good.first().content_hash == "h1" and bad.first().snapshot_id == 9


def test_home_pages_have_no_drive_copy(spark):
    docs = spark.createDataFrame([(1, "homepage", "h")], "doc_id long, kind string, content_hash string")
    targets = spark.createDataFrame([(1, "pages"), (2, "drive")], "target_id long, target_kind string")
    assert [r.target_id for r in lb.target_pairs(docs, targets).collect()] == [1]


def test_replacing_twice_changes_nothing(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, v string")
    new, keys = spark.createDataFrame([(1, "z")], "doc_id long, v string"), spark.createDataFrame([(1,), (3,)], "doc_id long")
    once = vs.replace_by_key(table, new, keys)
    assert sorted(vs.replace_by_key(once, new, keys).collect()) == sorted(once.collect())
    emptied = vs.replace_by_key(table, new.limit(0), keys)
    assert [tuple(r) for r in emptied.collect()] == [(2, "c")]


def test_unknown_sort_is_an_error(spark):
    with pytest.raises(ValueError):
        lb.sort_key("size")


def test_home_page_warnings(spark):
    from quire.sources.tables import BLOCKS

    run = lambda t: [{"text": t, "bold": False, "italic": False, "underline": False, "strike": False, "code": False, "fn_ref": False, "href": None}]
    block = lambda pos, kind, text="", level=None, **props: (1, pos, str(pos), None, 0, kind, level, text, run(text) if text else [], props)
    rows = [
        block(0, "heading", "Home", 1), block(1, "paragraph", "Hi"), block(2, "paragraph", " "), block(3, "narrative", "n1"), block(4, "narrative", "n2"),
        block(5, "group_listing"), block(6, "group_listing", group_id="4"), block(7, "group_listing", group_id="2"), block(8, "group_listing", group_id="1"),
        block(9, "paragraph", "Later"), block(10, "quote", "odd"), block(11, "dedication", text="", **{}), block(12, "heading", "Section"),
    ]
    out = ln.homepage_body(
        spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([(1, "One"), (2, "Two")], "group_id long, name string"),
        spark.createDataFrame([(1, 1, "s", "T")], "group_id long, rank long, slug string, title string"),
    )
    assert [r.warning for r in out["warnings"].orderBy("pos").collect()] == [
        "group listing without a group", "group listing of unknown group 4", "group listing without members: Two", "block type not shown here: quote",
    ]
    assert [(r.pos, r.role, r.text, r.panel) for r in out["entries"].orderBy("pos", "slot").collect()] == [
        (1, "intro", "Hi", 1), (3, "narrative", "n1", 3), (4, "narrative", "n2", 3), (8, "group", "One", 8), (8, "member", "T", 8), (9, "intro", "Later", 9), (12, "seclabel", "Section", 12),
    ]
    assert tuple(out["derived"].first()) == (1, "Home", "Hi")


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"same")
    (tmp_path / "b.png").write_bytes(b"same")
    (tmp_path / "c.jpg").write_bytes(b"other")
    got = {r.size_bytes: (r.kind, r.ext, r.mime) for r in fl.read_binary_assets(spark, f"{tmp_path}/*", "originals").collect()}
    assert got == {4: ("originals", ".png", "image/png"), 5: ("originals", ".jpg", "image/jpeg")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.manifest.json").write_text('{"source_file":"f.pdf","figures":[{"source_sha256":"h","caption":"old"},{"source_sha256":""},{"source_sha256":"h","included":false}]}')
    row = fl.read_manifests(spark, f"{tmp_path}/m/*.json").collect()
    assert [(r.source_sha256, r.caption, r.included, r.use_original) for r in row] == [("h", "", False, False)]


# ---------------------------------------------------------------- streams


def test_reindex_over_several_batches(spark, tmp_path):
    schema = "doc_id long, slug string, title string, body string, version int"
    src = tmp_path / "in"
    batches = [
        [(1, "a", "t", "old words", 1), (2, "b", "t", "stay here", 1)], [(1, "a", "t", "middle", 2), (1, "a", "t", "new text", 3)], [(3, "c", "", "late", 1), (2, "", "", "", 2)],
    ]
    postings, lengths = inc.BatchTable(spark, f"{tmp_path}/p"), inc.BatchTable(spark, f"{tmp_path}/l")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        inc.stream_reindex(spark.readStream.schema(schema).parquet(str(src)), "version", postings, lengths, f"{tmp_path}/cp")
    got = sorted((r.term, r.doc_id) for r in inc.current(postings, lengths).where("field = 'body'").collect())
    assert got == [("late", 3), ("new", 1), ("text", 1)]
    inc.compact(postings, inc.BatchTable(spark, f"{tmp_path}/p2"), lengths)
    assert inc.BatchTable(spark, f"{tmp_path}/p2").read().count() == inc.current(postings, lengths).count()


def test_replayed_batch_changes_nothing(spark, tmp_path):
    table = inc.BatchTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "x")], "doc_id long, v string")
    for _ in range(2):
        table.write(0, rows)
    assert inc.current(table).count() == 1
