"""Operators that read their input several times work it out once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import apply as ap
from quire.operators import library as lb
from quire.operators import live_index as li
from quire.operators import search as se
from quire.operators import tracks as tk
from quire.operators import versions as vs
from quire.session import fresh_folder, scratch
from quire.sources import page_sink as ps
from quire.sources import sinks as sk


@pytest.fixture
def counted(spark):
    """A function that lets a table's rows pass and counts them, and the count."""
    seen = spark.sparkContext.accumulator(0)

    def passing(df):
        def step(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(step, df.schema)

    return passing, lambda: seen.value


def _tracks(spark):
    rows = [(1, "s", c, i, {"section": "a", "name": f"n{(c + i) % 7}", "role": ""}, "people") for c in range(3) for i in range(5)]
    rows += [(1, "s", c, i, {"section": "a", "marker": "m", "event": f"e{c}{i}"}, "chronology") for c in range(3) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, source_name string, chapter_idx long, row_idx int, data map<string,string>, track_type string")


def test_replies_are_parsed_once_for_their_tracks(spark, counted):
    passing, seen = counted
    body = '{"digest_md": "d", "people": [{"name": "A"}, {"name": "b%d"}, {"name": " a "}], "chronology": [{"event": "x"}, {"event": "x"}]}'
    replies = spark.createDataFrame([(1, "s", c, body % (c % 2)) for c in range(4)], "doc_id long, source_name string, chapter_idx long, raw string")
    with scratch(spark):
        tracks = tk.dedup_tracks(tk.replies_to_tracks(passing(replies))["tracks"])
        out = tk.pool_tracks([tracks.where("source_name < 't'"), tracks.where("source_name >= 't'")]).collect()
    assert seen() == 4
    assert sorted((r["seq"], r["data"]["name"]) for r in out if r["track_type"] == "people") == [(0, "A"), (1, "b0"), (2, "b1")]
    assert sorted(r["seq"] for r in out if r["track_type"] == "chronology") == list(range(8))


def test_csv_of_four_tracks_works_its_rows_out_once(spark, counted):
    passing, seen = counted
    rows = _tracks(spark).withColumn("seq", F.col("row_idx").cast("long") + F.col("chapter_idx") * 5)
    folder = fresh_folder(spark, "csv")
    with scratch(spark):
        sk.write_tracks_csv(passing(rows), folder)
    assert seen() == rows.count()
    back = [r["name"] for r in sk.read_tracks_csv(spark, folder, "people").collect()]
    assert back == [f"n{(c + i) % 7}" for c in range(3) for i in range(5)]


def test_slugs_are_made_once(spark, counted):
    passing, seen = counted
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(["A", "a", "B 2", "b", "b", "C"])], "doc_id long, title string, date_stem string")
    with scratch(spark):
        out = lb.unique_slugs(passing(docs), spark.createDataFrame([("c",)], "slug string")).collect()
    assert seen() == 6
    assert {r["doc_id"]: r["slug"] for r in out} == {0: "a", 1: "a-2", 2: "b-2", 3: "b", 4: "b-3", 5: "c-2"}


@pytest.mark.parametrize("publish", [vs.publish_all, ps.publish_run])
def test_dirty_rows_of_a_run_are_worked_out_once(spark, counted, publish):
    passing, seen = counted
    rows = [(1, 1, "memoir", "pages", "x"), (2, 1, "homepage", "pages", "y"), (3, 2, "memoir", "drive", "z"), (4, 2, "homepage", "drive", "w")]
    dirty = spark.createDataFrame(rows, "doc_id long, target_id long, kind string, target_kind string, content_hash string")
    render = spark.createDataFrame([(1, "<p>"), (3, "<p>")], "doc_id long, html string")
    with scratch(spark):
        made = publish(passing(dirty), render, fresh_folder(spark, "site"), spark, F.lit("2024-01-01").cast("timestamp"), 1)
        marked, log = made["marked"].collect(), made["log"].collect()
    assert seen() == 4
    assert sorted(r["doc_id"] for r in marked) == [1, 2, 3]
    assert sorted((r["doc_id"], r["summary"]) for r in log) == [(1, "published"), (2, "refreshed with its target"), (3, "published")]


def test_postings_of_one_slice_move_once(spark):
    docs = spark.createDataFrame([(1, "s", "t", "a b")], "doc_id long, slug string, title string, body string")
    plan = li.blocks(se.index_rows(docs), 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_index_rows_are_made_in_bounded_slices(monkeypatch):
    words = [["w"] * n for n in (3, 0, 4, 9, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), *[pa.array([["x"]] * 6)] * 2, pa.array(words)], names=["doc_id", *se.FIELDS])
    whole = [r for b in se._entries(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(se, "SLICE_TOKENS", 6)
    sliced = [b for b in se._entries(iter([batch]))]
    assert max(len(set(b["doc_id"].to_pylist())) for b in sliced) < 4
    by = lambda r: (r["doc_id"], r["field"], r["term"])
    assert sorted((r for b in sliced for r in b.to_pylist()), key=by) == sorted(whole, key=by)


def test_a_block_reply_is_read_once(spark):
    """every use of an entry, a count or the reply itself worked it out again."""
    raws = ['{"id":"b000","kind":"p","text":"x"}', '[{"id":"A","kind":"p","text":"x"},{"id":"b000","kind":"p","text":"y"},{"id":"q","kind":"p","text":2},{"id":"r","kind":"p","text":"s"}]', "none", None]
    df = spark.createDataFrame([(i, ["A", "B"], r) for i, r in enumerate(raws)], "i int, ids array<string>, raw string")
    out = df.select("i", ap.parse_block_replies("raw", "ids").alias("r"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("b%03d") == 1 and plan.count("```[A-Za-z]") == 1
    got = {r["i"]: (r["r"]["ok"], r["r"]["error"]) for r in out.collect()}
    assert got == {0: (False, "missing: 1"), 1: (False, "text_type: 1, unknown_id: 1, repeated_id: 1, missing: 1"), 2: (False, "unreadable"), 3: (False, "missing: 2")}
