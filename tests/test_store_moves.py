"""How often a save, a comparison and a rollback move text, and that runs are whole wherever segments end."""

import hashlib
import os
import random
import string

from pyspark.sql import functions as F

from quire.operators import store as st
from quire.operators import versions as vs
from tests.test_store import made, now, read

LETTERS = string.ascii_letters + string.digits


def shuffled(spark, work):
    """(what ``work`` returns, bytes of the shuffle files that it wrote)."""
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {os.path.join(at, f) for d in dirs for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = files()
    out = work()
    size = 0
    for path in files() - before:
        try:
            size += os.path.getsize(path)
        except FileNotFoundError:  # cleaned meanwhile
            pass
    return out, size


def texts(rng, docs, lines, length=1500):
    return {d: ["".join(rng.choices(LETTERS, k=length)) for _ in range(lines)] for d in range(docs)}


def plain_broadcasts(spark, on):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760" if on else "-1")


def test_text_moves_once_at_most(spark, tmp_path):
    """a save moved all text five times, a comparison that of both versions twice, a rollback all three times."""
    rng = random.Random(7)
    first = texts(rng, 60, 12)
    second = {d: list(t) for d, t in first.items()}
    for d in second:
        if d % 10 == 0:
            second[d][3] = "".join(rng.choices(LETTERS, k=1500))
    text = sum(len(x) for t in first.values() for x in t)
    store = st.ContentStore(spark, str(tmp_path / "store"), "type string, text string")
    a, b = made(spark, first), made(spark, second)
    plain_broadcasts(spark, False)
    try:
        old, one = shuffled(spark, lambda: store.save(*a, "first", now()))
        new, two = shuffled(spark, lambda: store.save(*b, "second", now()))
        changed, three = shuffled(spark, lambda: store.changes(old, new).collect())
        choice = old.where("doc_id < 54").select("doc_id", "snapshot_id")
        out, four = shuffled(spark, lambda: store.rollback(choice, b[0], b[1].drop("content_hash"), now())["blocks"].collect())
    finally:
        plain_broadcasts(spark, True)
    assert 0 < one < 1.6 * text, "once, and narrow rows"
    assert two < 0.7 * text, "documents that did not change stay"
    assert three < 0.7 * text and len(changed) == 12 and sum(r.n for r in changed) == 0
    assert four < 1.7 * text, "what is restored, and what stays, once"
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {d: first[d] if d < 54 else second[d] for d in first}


def name(text):
    return hashlib.sha256(('{"type":"p","text":"%s"}' % text).encode()).hexdigest()


def runs_of(rows):
    """Digest to texts of each run of (pos, text) in order, by the rule as the module states it."""
    out, group, first = {}, [], None
    for pos, text in rows:
        if first is not None and (pos - first) // st.MOST != (group[-1][0] - first) // st.MOST:
            out[hashlib.sha256("".join(name(t) for _, t in group).encode()).hexdigest()] = [t for _, t in group]
            group = []
        first = pos if first is None else first
        group.append((pos, text))
        if int(name(text)[:4], 16) % st.USUAL == 0:
            out[hashlib.sha256("".join(name(t) for _, t in group).encode()).hexdigest()] = [t for _, t in group]
            group, first = [], None
    if group:
        out[hashlib.sha256("".join(name(t) for _, t in group).encode()).hexdigest()] = [t for _, t in group]
    return out


def test_runs_over_the_ends_of_segments(spark):
    """Runs that reach over a segment or a stretch are whole, and named as the blocks in them say."""
    rng = random.Random(8)
    plain = [t for t in (f"t{i}" for i in range(400)) if int(name(t)[:4], 16) % st.USUAL]
    docs = {
        1: [(i, rng.choice(plain)) for i in range(9000)],  # no boundary: cut by MOST alone
        2: [(i + 100, rng.choice(plain)) for i in range(5000)],  # parts lie across the ends
        3: [(i, f"t{rng.randrange(10**6)}") for i in range(5000)],
        4: [(3 * i + i // 7, rng.choice(plain)) for i in range(3000)],
        5: [(0, "a"), (1_000_000, "b")],
        6: [(-3000 + i, rng.choice(plain)) for i in range(5000)],
    }
    data = [(d, p, "p", t) for d, rows in docs.items() for p, t in rows]
    rng.shuffle(data)
    blocks = spark.createDataFrame(data, "doc_id long, pos int, type string, text string")
    runs, _, roots = st.trees(blocks, ["type", "text"])
    got = {r.digest: [b.text for b in r.blocks] for r in runs.collect()}
    want = {}
    for rows in docs.values():
        want |= runs_of(rows)
    assert got == want and runs.count() == len(want)
    assert {r.doc_id: r.size for r in roots.collect()} == {d: len(rows) for d, rows in docs.items()}
    one = next(iter(want))
    left, _, same = st.trees(blocks, ["type", "text"], spark.createDataFrame([(3,), (5,)], "doc_id long"), spark.createDataFrame([(one,)], "digest string"))
    assert {r.digest for r in left.collect()} == {*runs_of(docs[3]), *runs_of(docs[5])} - {one} and {r.doc_id for r in same.collect()} == {3, 5}


def test_rows_that_come_twice(spark, tmp_path):
    """Rows of one position count each against all of it, in a run, its size and what comes back, as they always did."""
    ends = next(t for t in (f"t{i}" for i in range(400)) if int(name(t)[:4], 16) % st.USUAL == 0)
    rows = [(1, p, "p", t) for p, t in enumerate(["a", ends, "b"])]
    blocks = spark.createDataFrame(rows * 2, "doc_id long, pos int, type string, text string")
    docs = spark.createDataFrame([(1, {"k": "v"}, "h")], "doc_id long, meta map<string,string>, content_hash string")
    store = st.ContentStore(spark, str(tmp_path / "store"), "type string, text string")
    saved = store.save(blocks, docs, "twice", now())
    assert saved.first()["size"] == 12
    assert read(store.blocks_of(saved.select("doc_id", "root", "level"), "doc_id")) == {1: ["a"] * 4 + [ends] * 4 + ["b"] * 4}


def test_replace_by_key_keeps_null_keys(spark):
    """only rows that stay are moved; a row without a key stays, as it did."""
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "doc_id long, v string")
    new = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "doc_id long, v string")
    keys = spark.createDataFrame([(1,), (3,), (None,)], "doc_id long")
    out = vs.replace_by_key(table, new, keys)
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(2, "b"), (2, "b"), (None, "c"), (1, "x"), (3, "y")], "doc_id long, v string").collect()))
    given = vs.replace_by_key(table, new.where("doc_id is not null"), keys, within=True)
    assert sorted(map(str, given.collect())) == sorted(map(str, out.collect()))
    assert out.where(F.col("doc_id") == 2).count() == 2
