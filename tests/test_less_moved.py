"""Steps that move keys and digests instead of texts, and their rows once."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import drafts as dr
from quire.operators import library as lb
from quire.operators import tracks as tk
from quire.operators import versions as vs
from quire.operators.ordered import SEG, number_rows, number_rows_by_range
from quire.session import fresh_folder, scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sorted_joins(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def dirty_rows(spark):
    rows = [(1, 1, "memoir", "pages", "x"), (1, 2, "memoir", "drive", "x"), (1, 2, "memoir", "drive", "x"), (2, 1, "homepage", "pages", "y"), (2, 2, "homepage", "pages", "y"),
            (3, None, "homepage", "pages", "z"), (None, 1, "homepage", "pages", "n"), (4, 1, None, None, None), (5, 1, "homepage", "pages", "h")]
    return spark.createDataFrame(rows, "doc_id long, target_id long, kind string, target_kind string, content_hash string")


def test_a_hash_moves_once_for_all_targets_of_a_document(spark, sorted_joins):
    """the dirty rows of every target were moved with their hash, twice a run."""
    with scratch(spark):
        dirty = vs.by_document(dirty_rows(spark))
        assert dirty.count() == 6
        assert sorted(map(tuple, vs.asked_pages(dirty).collect()), key=repr) == sorted([(1, 1), (1, 2), (2, 1), (2, 2), (3, None), (None, 1), (4, 1), (5, 1)], key=repr)
        assert plan(vs.asked_pages(dirty)).count("Exchange") == 1
        found = spark.createDataFrame([(1, 1), (1, 2), (4, 1), (5, 1), (9, 1)], "doc_id long, target_id long")
        made = vs.publish_state(dirty, found, F.lit("2024-01-01").cast("timestamp"))
        marked, log = made["marked"].collect(), made["log"].collect()
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(marked) == key([(1, 1, "x"), (1, 2, "x"), (1, 2, "x"), (4, 1, None), (5, 1, "h"), (2, 1, "y"), (None, 1, "n")])
    assert key((r["doc_id"], r["target_id"], r["summary"]) for r in log) == key([
        *[(d, t, "published") for d, t in ((1, 1), (1, 2), (1, 2), (4, 1), (5, 1))], *[(d, 1, "refreshed with its target") for d in (2, None)]])


def test_the_dirty_matrix_moves_no_hash(spark, sorted_joins):
    """Hashes of documents and snapshots were moved whole to be compared."""
    docs = spark.createDataFrame([(1, "memoir", "a"), (2, "homepage", None), (3, "memoir", "c")], "doc_id long, kind string, content_hash string")
    targets = spark.createDataFrame([(1, "pages"), (2, "drive")], "target_id long, target_kind string")
    sync = spark.createDataFrame([(1, 1, 10, "PUBLISHED", "d"), (1, 2, 11, "PUBLISHED", "d"), (2, 1, 12, "PUBLISHED", "d"), (3, 1, None, "UNPUBLISHED", None), (3, 2, 99, "PUBLISHED", "d")],
                                 "doc_id long, target_id long, snapshot_id long, status string, published_at string")
    snaps = spark.createDataFrame([(10, "a"), (11, "b"), (12, "x"), (10, "a")], "snapshot_id long, content_hash string")
    out = lb.dirty_matrix(docs, targets, sync, snaps)
    ends = re.findall(r"Exchange[^\n]*\n[^\n]*", plan(out))
    assert len(ends) > 3 and not [e for e in ends if "hash#" in re.sub(r"CASE WHEN.*? END AS", "", e)]
    got = sorted(((r["doc_id"], r["target_id"], r["status"], r["dirty"], r["snapshot_id"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, 1, "PUBLISHED", False, 10)] * 2 + [(1, 2, "PUBLISHED", True, 11), (2, 1, "PUBLISHED", True, 12), (3, 1, "UNPUBLISHED", True, None), (3, 2, "PUBLISHED", True, 99)], key=repr)


def test_numbered_rows_move_once(spark, sorted_joins):
    """Rows were moved to be numbered, and again to have the rows before added."""
    rows = [(k, i, f"t{i}") for k in ("a", None, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i long, words string").withColumn("words", F.concat("words", F.lit("!")))
    out = number_rows(df, ["k"], [F.col("i")], [F.floor(F.col("i") / 6)], "n")
    assert sum("words#" in e for e in re.findall(r"\+- Exchange[^\n]*\n[^\n]*", plan(out))) == 1
    assert {(r["k"], r["i"]): r["n"] for r in out.collect()} == {(k, i): i + 1 for k, i, _ in rows}
    ranged = number_rows_by_range(df, ["k"], [F.col("i")], "n")
    assert {(r["k"], r["i"]): r["n"] for r in ranged.collect()} == {(k, i): i + 1 for k, i, _ in rows}
    assert sorted(r["n"] for r in number_rows_by_range(df, [], [F.col("k"), F.col("i")], "n").collect()) == list(range(1, 61))


def test_names_move_once_to_be_spelled(spark, sorted_joins):
    """every step of the numbering moved the whole names."""
    docs = [(0, "A b"), (1, "a b"), (2, None), (3, "a-b"), (3, "a-b"), (4, "c"), (5, "c 2"), (6, "c"), (7, "d"), (None, "d")]
    frame = spark.createDataFrame([(i, t, "") for i, t in docs], "doc_id long, title string, date_stem string")
    with scratch(spark):
        out = lb.unique_slugs(frame, spark.createDataFrame([("d",), ("a-b-3",), (None,)], "slug string"))
        moved = re.findall(r"\+- Exchange[^\n]*\n[^\n]*", plan(out))
        assert len(moved) > 3 and not [e for e in moved if re.search(r"root#|slug#", e)] and sum("base#" in e for e in moved) <= 2
        got = sorted(((r["doc_id"], r["slug"]) for r in out.collect()), key=repr)
    assert got == sorted([(0, "a-b"), (1, "a-b-2"), (2, None), (3, "a-b-4"), (3, "a-b-5"), (4, "c"), (5, "c-2"), (6, "c-3"), (7, "d-3")], key=repr), got


def test_a_reply_is_read_once_for_each_table(spark):
    """lines and anchors read a reply to see whether it has a digest, and again for their rows."""
    body = '{"digest_md": "%s", "interpersonal_stated": [" a ", 3, "b"], "inconsistencies": ["c"], "anchors": [{"section": "s", "quote": 2}, {}], "people": [{"name": "P"}]}'
    raws = [body % "d", f"Here: {body % 'e'} Done.", f"```json\n{body % 'f'}\n```", "```" + body % "g" + "```", body % " ", "[1]", "no", None, "```"]
    replies = spark.createDataFrame([(i, "s", 0, r) for i, r in enumerate(raws)], "doc_id long, source_name string, chapter_idx long, raw string")
    out = tk.replies_to_tracks(replies)
    for name in ("tracks", "lines", "anchors"):
        assert out[name]._jdf.queryExecution().optimizedPlan().toString().count("```(?:json)?") == 1, name
    assert sorted((r["doc_id"], r["row_idx"], r["kind"], r["text"]) for r in out["lines"].collect()) == [
        (d, i, k, t) for d in range(4) for i, k, t in ((0, "interpersonal_stated", " a "), (2, "interpersonal_stated", "b"), (3, "inconsistencies", "c"))]
    assert sorted((r["doc_id"], r["row_idx"], r["section"], r["quote"]) for r in out["anchors"].collect()) == [(d, i, *x) for d in range(4) for i, x in enumerate((("s", "2"), ("", "")))]
    assert sorted(r["doc_id"] for r in out["tracks"].collect()) == [0, 1, 2, 3]
    assert sorted(r["doc_id"] for r in out["digests"].collect()) == [0, 1, 2, 3] and sorted(r["doc_id"] for r in out["failures"].collect()) == [4, 5, 6, 7, 8]


def test_who_counts_tracks_moves_none(spark, sorted_joins):
    """rows moved with all they hold to be deduplicated, to be numbered and to be counted."""
    rows = [(1, "s", c, i, {"name": n, "section": f"{c}{i}{j}"}, "people") for c, i, j, n in ((0, 0, 0, "A"), (0, 0, 1, "A"), (0, 1, 0, " a"), (1, 0, 0, "b"), (1, 0, 1, "c"), (1, 1, 0, " "))]
    rows += [(1, "s", 0, i, {"event": "x"}, "chronology") for i in (0, 0, 1)] + [(2, None, 0, 0, {"name": "A"}, "people")]
    df = spark.createDataFrame(rows, "doc_id long, source_name string, chapter_idx long, row_idx int, data map<string,string>, track_type string")
    with scratch(spark):
        out = tk.dedup_tracks(df)
        counts = out.groupBy("doc_id", "track_type").count()
        assert out.columns == [*df.columns, "seq"] and "data#" not in plan(counts)
        assert sum("data#" in e for e in re.findall(r"\+- Exchange[^\n]*\n[^\n]*", plan(out))) == 1
        got = out.collect()
        assert {(r["doc_id"], r["track_type"]): r["count"] for r in counts.collect()} == {(1, "people"): 3, (1, "chronology"): 2, (2, "people"): 1}
    assert sorted((r["seq"], r["chapter_idx"], r["row_idx"]) for r in got if r["doc_id"] == 1 and r["track_type"] == "people") == [(0, 0, 0), (1, 1, 0), (2, 1, 0)]
    assert sorted(r["data"]["name"] for r in got if r["track_type"] == "people") == ["A", "A", "b", "c"]
    assert sorted((r["seq"], r["row_idx"]) for r in got if r["track_type"] == "chronology") == [(0, 0), (1, 1)]


def test_drafts_move_only_what_a_step_touches(spark, sorted_joins):
    """every step of the cleaning pass moved all texts, to edit a few rows."""
    rows = [(d, i, "p", f"Line {i}.", None) for d in (1, 2) for i in range(60)] + [(None, 0, "p", "Loose.", None)]
    for i, (kind, text, image) in {3: ("p", "An open sentence", None), 4: ("image", None, "x"), 5: ("p", "goes on.", None), 9: ("image", None, "y"), 10: ("p", " Cap ", None)}.items():
        rows[i] = (1, i, kind, text, image)
    df = spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, image string")
    caps = spark.createDataFrame([(1, "y", "Cap")], "doc_id long, image string, caption string")
    df.write.mode("overwrite").parquet(folder := f"{fresh_folder(spark, 'drafts')}")
    df = spark.read.parquet(folder)
    moved = dr.relocate_figures(df)
    got = {(r["doc_id"], r["pos"]): r["text"] for r in moved.collect()}
    assert len(got) == 120 and got[1, 3] == "An open sentence goes on." and (1, 5) not in got and got[2, 5] == "Line 5."
    left = dr.drop_caption_duplicates(df, caps)
    assert (1, 10) not in {(r["doc_id"], r["pos"]) for r in left.collect()} and left.count() == 120
    touched, rest = dr._at(df, spark.createDataFrame([(1, 3), (1, 5)], "doc_id long, pos int"))
    assert {(1, 3), (1, 5)} <= {(r["doc_id"], r["pos"]) for r in touched.collect()} and touched.count() < 30 and touched.count() + rest.count() == 121
    assert "Exchange hashpartitioning" not in plan(rest)  # what a filter rules out is not shuffled
    assert "Union" in plan(moved) and "Union" in plan(left)


def test_paragraphs_are_joined_over_the_end_of_a_segment(spark, sorted_joins):
    """only groups that go on into another segment move again."""
    n = 2 * SEG + 3
    open_at = {SEG - 2, SEG - 1, SEG, 2 * SEG - 1, 10}
    rows = [(1, i, "p", f"l{i}" if i in open_at else f"l{i}.") for i in range(n)] + [(2, i, "p", "x") for i in range(3)]
    out = dr.rejoin_paragraphs(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string"))
    got = {(r["doc_id"], r["pos"]): r["text"] for r in out.collect()}
    assert got[1, SEG - 2] == f"l{SEG - 2} l{SEG - 1} l{SEG} l{SEG + 1}." and got[1, 2 * SEG - 1] == f"l{2 * SEG - 1} l{2 * SEG}." and got[1, 10] == "l10 l11."
    assert len(got) == n - 5 + 1 and got[2, 0] == "x x x"
