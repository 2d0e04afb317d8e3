"""Block naming and source mixing."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from helpers import corpus, frame

from quire.llm import block_naming, source_mix
from quire.llm.common import prefix_sums
from pyspark.sql import functions as F


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("size", [7, 4096])
def test_duplicates(spark, size):
    rows = corpus(40)
    got = block_naming.duplicates(frame(spark, rows), size=size).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    assert len(got) == len(rows)
    want = sorted(
        (str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_unique_rows_keep_columns(spark):
    rows = corpus(40)
    docs = frame(spark, rows)
    kept = block_naming.unique_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(r[1]) for r in rows})


def test_weak_digest_is_salted_again(spark, monkeypatch):
    real = block_naming.digest
    monkeypatch.setattr(block_naming, "digest", lambda b, salt: F.substring(real(b, 0), 1, 1) if salt == 0 else real(b, salt))
    rows = [(i, f"text {i % 700} " * 3, None, None, None) for i in range(1400)]
    got = block_naming.duplicates(frame(spark, rows, extra=False), size=16).collect()
    assert all(r.group_size == 2 and r.keep_id == r.doc_id % 700 for r in got)


def test_empty_tables(spark):
    docs = frame(spark, corpus(5)).filter("false")
    assert block_naming.duplicates(docs).count() == 0
    assert block_naming.unique_rows(docs).count() == 0
    assert source_mix.mix(docs).count() == 0
    assert source_mix.mixed_rows(docs).count() == 0


def test_prefix_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("o"), "id", (F.col("id") % 5).alias("v"))
    got = prefix_sums(df, ["g"], ["o", "id"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    for g in range(3):
        s = n = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id)):
            assert (r.s, r.n) == (s, n)
            s, n = s + r.v, n + 1


def targets_by_rounds(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight; whoever is above its cap is set to it, and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed = {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    rows = corpus(60)
    got = source_mix.mix(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets_by_rounds(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] in (math.floor(want[s]), math.floor(want[s] + 1e-6)) for s in sizes)
    again = source_mix.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_source_holds_most_words_and_one_is_tiny(spark):
    rows = [(i, "a b c " * 50, None, "big", None) for i in range(30)] + [(100, "x y", None, "tiny", None), (101, None, None, "void", None)]
    got = {r.doc_id: r for r in source_mix.mix(frame(spark, rows, extra=False)).collect()}
    assert got[100].taken == 6 and got[101].taken == 0
    assert sum(r.taken for r in got.values()) == pytest.approx(4502, abs=2)


def test_mixed_rows(spark):
    rows = [r for r in corpus(60)[:-2]]
    docs = frame(spark, rows)
    plan = {r.doc_id: r.taken for r in source_mix.mix(docs).collect()}
    out = source_mix.mixed_rows(docs)
    assert out.columns == [c for c in docs.columns if c != "epoch"] + ["epoch", "taken_words"]
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += r.taken_words
    assert got == {d: t for d, t in plan.items() if t}


def test_rows_of_one_id_are_each_taken_as_planned(spark):
    schema = "doc_id long, text string, source string, row long, _row long"
    docs = spark.createDataFrame([(1, "a b c", "s", 5, 5), (1, "d e", "s", 5, 5), (2, "f g", "s", 6, 6), (None, "h", "s", 7, 7), (None, "h", "s", 7, 7)], schema)
    out = source_mix.mixed_rows(docs)
    assert out.columns == [*docs.columns, "epoch", "taken_words"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.epoch, r.taken_words) for r in out.collect())
    assert got == [(False, 1, "a b c", 0, 3), (False, 1, "d e", 0, 2), (False, 2, "f g", 0, 2), (True, 0, "h", 0, 1), (True, 0, "h", 0, 1)]
    assert sum(r.taken for r in source_mix.mix(docs).collect()) == sum(g[4] for g in got) == 9
    two = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(9, "x", "t", 0, 0)], schema))
    want = {r[0]: r[1] for r in source_mix.mix(two).filter("taken > 0").groupBy("source").agg({"taken": "sum"}).collect()}
    assert {r[0]: r[1] for r in source_mix.mixed_rows(two).groupBy("source").agg({"taken_words": "sum"}).collect()} == want
