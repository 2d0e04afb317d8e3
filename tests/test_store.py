"""Content snapshots: what is restored, what is compared, and how little a small edit writes."""

import random

from pyspark.sql import functions as F

from quire.operators import store as st

BLOCKS = "doc_id long, pos int, type string, text string"


def now():
    return F.lit("2024-01-01").cast("timestamp")


def made(spark, docs):
    rows = [(d, i, "p", t) for d, texts in docs.items() for i, t in enumerate(texts)]
    meta = [(d, {"n": str(len(t))}, f"h{d}-{len(t)}") for d, t in docs.items()]
    return spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(meta, "doc_id long, meta map<string,string>, content_hash string")


def read(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.doc_id, r.pos)):
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def test_versions_come_back_whole(spark, tmp_path):
    rng = random.Random(1)
    first = {1: [f"line {rng.random()}" for _ in range(3000)], 2: ["same"] * 700, 3: [], 4: ["a", "b"], 5: ["a", "b"], 6: [None, ""]}
    second = {d: list(t) for d, t in first.items()}
    second[1][1500] = "changed"
    second[2].insert(3, "new")
    second[4] = []
    store = st.ContentStore(spark, str(tmp_path / "store"), "type string, text string")
    a, b = made(spark, first), made(spark, second)
    old, new = store.save(*a, "first", now()), store.save(*b, "second", now())
    for rows, want in ((old, first), (new, second)):
        assert read(store.blocks_of(rows.select("doc_id", "root", "level"), "doc_id")) == {d: t for d, t in want.items() if t}
        got = {r.doc_id: r for r in rows.collect()}
        assert set(got) == set(want) and all(got[d].size == len(t) and got[d].meta == {"n": str(len(t))} for d, t in want.items())
    assert [r.snapshot_id for r in sorted(old.collect())] == [1, 2, 3, 4, 5, 6] and {r.snapshot_id for r in new.collect()} == set(range(7, 13))
    equal = {r.doc_id: r.root for r in old.collect()}
    assert equal[4] == equal[5], "equal content has one name"

    # One changed line of 3,000 and one inserted: only the runs around them are written.
    saves = {r.save: r for r in store.saves().collect()}
    assert saves[2].blocks <= 4 * st.MOST and saves[2].bytes < saves[1].bytes / 5

    changed = sorted((r.doc_id, r.text, r.n) for r in store.changes(old, new).collect())
    assert changed == sorted([(1, first[1][1500], -1), (1, "changed", 1), (2, "new", 1), (4, "a", -1), (4, "b", -1)])
    assert store.changes(new, new).count() == 0

    out = store.rollback(spark.createDataFrame([(1, 1), (4, 4), (2, 9), (3, 9), (6, 99)], "doc_id long, snapshot_id long"), b[0], b[1].drop("content_hash"), now())
    assert {(r.doc_id, r.snapshot_id) for r in out["rejected"].collect()} == {(2, 9), (6, 99)}
    back = read(out["blocks"])
    assert back == {1: first[1], 2: second[2], 4: ["a", "b"], 5: ["a", "b"], 6: [None, ""]}
    log = {r.doc_id: r for r in out["log"].collect()}
    assert set(log) == {1, 3, 4} and log[1].summary == "rolled back to snapshot 1" and log[1].content_hash == "h1-3000"
    assert {r.doc_id: r.meta["n"] for r in out["docs"].collect()}[4] == "2"
    assert {r.doc_id for r in out["reindex"].collect()} == {1, 3, 4}


def test_a_moved_line_changes_the_root_alone(spark, tmp_path):
    store = st.ContentStore(spark, str(tmp_path / "store"), "type string, text string")
    texts = [f"t{i}" for i in range(400)]
    moved = texts[200:210] + texts[:200] + texts[210:]
    a, b = store.save(*made(spark, {1: texts}), "a", now()), store.save(*made(spark, {1: moved}), "b", now())
    assert a.first().root != b.first().root and store.changes(a, b).count() == 0
    assert read(store.blocks_of(b.select("doc_id", "root", "level"), "doc_id"))[1] == moved


def test_a_failed_save_leaves_no_snapshot(spark, tmp_path):
    store = st.ContentStore(spark, str(tmp_path / "store"), "type string, text string")
    blocks, docs = made(spark, {1: ["a", "b"], 2: ["c"]})
    runs, nodes, _ = st.trees(blocks, ["type", "text"])
    runs.limit(1).write.parquet(f"{store.folder}/runs/save=1")  # what a save that broke off may leave
    saved = store.save(blocks, docs, "again", now())
    assert read(store.blocks_of(saved.select("doc_id", "root", "level"), "doc_id")) == {1: ["a", "b"], 2: ["c"]}
    assert store.runs().count() == runs.count() == store.runs().select("digest").distinct().count()


def test_empty_tables(spark, tmp_path):
    store = st.ContentStore(spark, str(tmp_path / "store"), "type string, text string")
    blocks, docs = made(spark, {1: ["a"]})
    assert store.save(blocks.limit(0), docs.limit(0), "none", now()).count() == 0
    assert store.save(blocks, docs, "one", now()).count() == 1
    assert store.changes(store.snapshots().limit(0), store.snapshots()).collect()[0].n == 1
