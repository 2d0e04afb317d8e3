"""An index kept up over batches against one built afresh, and how little of it a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import live_index as li
from quire.operators import search as se

DOCS = "doc_id long, slug string, title string, body string"
QUERIES = ("the", "rare w3 the", "the w1-w2 w4", "nowhere the", "é1")


def frame(spark, docs):
    return spark.createDataFrame([(d, f"slug-{d}", "A title" if d % 2 else None, b) for d, b in docs.items()], DOCS)


def text(rng, n):
    return " ".join(rng.choice(["the", "the", "w1", "w2", "w3", "w4", "É1"]) if rng.random() < 0.97 else "rare" for _ in range(n))


def agree(spark, index, docs):
    fresh = se.build_index(frame(spark, docs))
    for q in QUERIES:
        want = [(r.doc_id, round(r.score, 9)) for r in se.search(*fresh, q).collect()]
        assert [(r.doc_id, round(r.score, 9)) for r in index.search(q).collect()] == want, q


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 8)


def test_searches_follow_batches(spark, tmp_path):
    rng = random.Random(1)
    index = li.LiveIndex(spark, str(tmp_path / "live"))
    assert index.search("the").count() == 0
    docs = {d: text(rng, rng.randrange(1, 30)) for d in range(160)}
    index.apply(0, frame(spark, docs))
    changed = {d: text(rng, 12) for d in (3, 50, 51, 120)} | {500: "rare new words"}
    emptied = {7: "", 8: None}
    for batch, (rows, gone) in enumerate([(changed, []), (emptied, [9, 10, 9999]), ({9: "back again the rare"}, [3])], 1):
        docs.update(rows)
        for d in gone:
            docs.pop(d, None)
        removed = spark.createDataFrame([(d,) for d in gone], "doc_id long") if gone else None
        for _ in range(2):  # a replay changes nothing
            index.apply(batch, frame(spark, rows), removed)
    agree(spark, index, docs)
    assert index.segments() == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert index.search(" ").count() == 0
    assert index.fold(4) == [(0, 3)] and index.segments() == [(0, 3)]
    index.clean()
    assert [p.name for p in (tmp_path / "live").iterdir()] == ["seg-0-3"]
    index.apply(2, frame(spark, {1: "late replay"}))
    agree(spark, index, docs)


def test_folders_grow_with_the_logarithm_of_batches(spark, tmp_path):
    index, docs = li.LiveIndex(spark, str(tmp_path / "live")), {}
    for batch in range(5):
        rows = {batch % 4: f"the word{batch} rare", 100 + batch: "the w1 w2"}
        docs.update(rows)
        index.apply(batch, frame(spark, rows))
        index.fold(2)
    assert index.segments() == [(0, 3), (4, 4)]
    agree(spark, index, docs)


def test_a_folder_without_its_mark_does_not_count(spark, tmp_path):
    index = li.LiveIndex(spark, str(tmp_path / "live"))
    docs = {1: "the rare", 2: "the"}
    index.apply(0, frame(spark, docs))
    broken = li.LiveIndex(spark, str(tmp_path / "live"))
    broken._finish = lambda segment: None  # the job ends before the mark
    broken.apply(1, frame(spark, {1: "other"}))
    agree(spark, index, docs)
    index.apply(1, frame(spark, {1: "other rare"}))
    agree(spark, index, {1: "other rare", 2: "the"})


def test_a_common_word_is_read_around_the_rare_one_only(spark, tmp_path):
    docs = {d: "the " * (1 + d % 5) + ("rare" if d in (700, 701, 1500) else "") + " zed" * (30 if d in range(300, 330) else 1) for d in range(2000)}
    index, report = li.LiveIndex(spark, str(tmp_path / "live")), {}
    index.apply(0, frame(spark, docs))
    fresh = se.search(*se.build_index(frame(spark, docs)), "the rare").collect()
    assert [r.doc_id for r in index.search("the rare", report=report).collect()] == [r.doc_id for r in fresh]
    assert report["blocks"] > 200 and report["read"] <= 5, report
    report = {}
    top = index.search("zed", report=report).collect()
    assert [r.doc_id for r in top] == [r.doc_id for r in se.search(*se.build_index(frame(spark, docs)), "zed").collect()]
    assert report["read"] < 30 < report["blocks"], report


def test_many_ranges_are_joined_to_few(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.randrange(3)) for a in rng.sample(range(100_000), 500)]
    heads = spark.createDataFrame([(x, x) for x in range(0, 100_000, 7)], "first_doc long, last_doc long")
    view = li._View(heads.withColumn("term", F.lit("t")).withColumns({"n": F.lit(1), "max_tf": F.lit(1), "min_length": F.lit(1)}), None, [], {}, 1, 1.0, None)
    got = {r.first_doc for r in heads.where(view.near(spans)).collect()}
    assert {x for x in range(0, 100_000, 7) if any(a <= x <= b for a, b in spans)} <= got and len(got) < heads.count()


def test_a_stream_keeps_the_index(spark, tmp_path):
    from quire.streaming import incremental as inc

    schema, src = "doc_id long, slug string, title string, body string, version int", str(tmp_path / "in")
    index, docs = li.LiveIndex(spark, str(tmp_path / "live")), {}
    for version, rows in enumerate([{1: "the rare", 2: "the w1"}, {1: "w1 w2", 3: "rare é1"}, {2: None, 3: "the the w4"}], 1):
        spark.createDataFrame([(d, f"slug-{d}", "A title" if d % 2 else None, b, version) for d, b in rows.items()], schema).coalesce(1).write.mode("append").parquet(src)
        inc.stream_live_index(spark.readStream.schema(schema).parquet(src), "version", index, str(tmp_path / "cp"), fan=2)
        docs = {d: b for d, b in {**docs, **rows}.items() if b is not None}
    assert index.segments() == [(0, 1), (2, 2)]
    agree(spark, index, docs)
