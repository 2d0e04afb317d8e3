"""Work that no task may hold whole: packing over a tree of segments, pictures by a sweep, keys sifted before a join."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import assets as az
from quire.operators import layout as ly
from quire.operators import membership as mb
from quire.operators import structure as st


def folded(tokens, heading, target):
    """Chunk of each row by the plain fold."""
    out, held, body, chunk = [], target + 1, False, -1
    for t, h in zip(tokens, heading):
        if held + t > target or (h and body) or chunk < 0:
            chunk, held, body = chunk + 1, 0, False
        out.append(chunk)
        held, body = held + t, body or not h
    return out


def rows(rng, n, target):
    return [rng.choice([1, 2, 3, target // 3, target + 5]) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]


def test_steps_of_segments_are_the_fold():
    rng = random.Random(1)
    for _ in range(120):
        target = rng.randrange(4, 40)
        tokens, heading = (np.array(x) for x in rows(rng, rng.randrange(2, 60), target))
        cuts = sorted({0, len(tokens), *(rng.randrange(len(tokens) + 1) for _ in range(rng.randrange(5)))})
        parts = [st._segment_steps(tokens[a:b], heading[a:b], target) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)  # any order of folding gives the same
            parts[k : k + 2] = [st._after(parts[k], parts[k + 1], target + 1)]
        whole = st._segment_steps(tokens, heading, target)
        for body in (0, 1):
            for held in range(target + 2):
                assert st._apply(parts[0], held, body, target + 1) == st._apply(whole, held, body, target + 1)
        assert st._apply(whole, target + 1, 0, target + 1)[2] == folded(tokens, heading, target)[-1] + 1


def test_packing_over_a_tree(spark, monkeypatch):
    monkeypatch.setattr(st, "TREE", 3)
    rng = random.Random(2)
    docs = {d: rows(rng, n, 20) for d, n in ((1, 400), (2, 90), (3, 7))}
    data = [(d, i, "h2" if h else "p", "x" * (4 * t)) for d, (tokens, heading) in docs.items() for i, (t, h) in enumerate(zip(tokens, heading))]
    df = spark.createDataFrame(data, "doc_id long, pos int, kind string, text string")
    sizes = {(r.doc_id, r.pos): r.n for r in df.select("doc_id", "pos", st.tx.estimated_tokens(F.col("text")).alias("n")).collect()}
    got = {(r.doc_id, r.pos): r.chunk for r in st.pack_chunks(df, 20, seg=8).collect()}
    for d, (tokens, heading) in docs.items():
        assert [got[d, i] for i in range(len(tokens))] == folded([sizes[d, i] for i in range(len(tokens))], heading, 20)


def test_a_segment_is_a_few_steps():
    rng = random.Random(3)
    tokens, heading = np.array([rng.randrange(20, 200) for _ in range(4096)]), np.array([rng.random() < 0.05 for _ in range(4096)])
    steps = st._segment_steps(tokens, heading, 3500)
    assert sum(map(len, steps)) < 150  # 20 bytes each, where a table of all states took 84 KB


def test_a_page_of_many_tiles(spark):
    side = 220
    boxes = [(1, 1, r * side + c, c * 30.0, r * 30.0, c * 30.0 + 29.0, r * 30.0 + 29.0) for r in range(side) for c in range(side) if c % 11 != 10]
    df = spark.createDataFrame(boxes, "doc_id long, page int, tile int, x0 double, y0 double, x1 double, y1 double")
    start = time.time()
    got = ly.tile_components(df).collect()
    assert time.time() - start < 60
    assert len(got) == side // 11 and sorted(len(r.tiles) for r in got)[0] == 10 * side


@pytest.mark.parametrize("seed", range(6))
def test_sweep_is_pairwise(seed):
    rng = np.random.default_rng(seed)
    n = 120
    at = rng.integers(0, 40, (n, 2)) * rng.choice([1.0, 3.0, 7.0])
    box = np.hstack([at, at + rng.choice([0.0, 0.5, 2.0, 3.0, 10.0, 13.0, 30.0], (n, 2))])
    label = np.arange(n)
    meets = [[bool(ly._meet(box, i, np.array([j]), 0, 1)[0] or ly._meet(box, i, np.array([j]), 1, 0)[0]) for j in range(n)] for i in range(n)]
    for _ in range(n):
        for i in range(n):
            label[i] = min(label[j] for j in range(n) if meets[i][j] or i == j)
    assert ly._pictures(box).tolist() == ly._few_pictures(box).tolist() == label.tolist()


def test_no_key_of_the_table_is_sifted_out(spark):
    table = spark.range(0, 20_000, 2).select(F.concat(F.lit("k"), "id").alias("key"))
    rows_ = spark.range(0, 40_000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionByName(spark.createDataFrame([(None, -1)], "key string, id long"))
    may, new = mb.sifted(rows_, "key", table, "key")
    kept = {r.id for r in may.collect()}
    assert set(range(0, 20_000, 2)) <= kept and kept.isdisjoint({r.id for r in new.collect()}) and may.count() + new.count() == 40_001
    wrong = len(kept) - 10_000
    assert wrong / 30_000 < 0.08, wrong  # so of rows that miss, that share is shuffled


def test_filter_too_large_or_empty(spark, monkeypatch):
    rows_ = spark.createDataFrame([("a", 1), (None, 2)], "key string, id long")
    may, new = mb.sifted(rows_, "key", rows_.limit(0).select("key"), "key")
    assert may.count() == 0 and new.count() == 2
    monkeypatch.setattr(mb, "MOST", 0)
    may, new = mb.sifted(rows_, "key", rows_.select("key"), "key")
    assert new is None and may.count() == 2


def test_cache_lookup_keeps_all_rows(spark):
    figures = spark.createDataFrame([(i, f"c{i % 7}", "p", "m") for i in range(50)], "id int, content string, prompt string, model string")
    keys = figures.where("id in (1, 2)").select(az.cache_key(F.col("content"), F.col("prompt"), F.col("model")).alias("key"), F.lit("r").alias("result"))
    got = az.cache_lookup(figures, keys)
    assert got.count() == 50 and {r.id % 7 for r in got.where("state = 'hit'").collect()} == {1, 2}
    assert az.cache_lookup(figures, keys, force=True).where("state = 'hit'").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_slugs_one_by_one(spark, seed):
    from quire.operators.library import unique_slugs

    rng = random.Random(seed)
    titles = ["report", "report 2", "report 3", "report 2 2", "report 2 3", "report 3 2", "report 1", "report 02", "note", "note 2", "other 7", *(f"report {k}" for k in range(4, 30))]
    docs = [(i, rng.choice(titles[:11] if rng.random() < 0.6 else titles), "") for i in rng.sample(range(1000), 90)]
    old = rng.sample(["report", "report-2", "report-5", "report-2-2", "note-2", "other-7", "report-31", "x"], rng.randrange(8))
    used, want = set(old), {}
    for i, title, _ in sorted(docs):
        base, k = title.replace(" ", "-"), 1
        while (base if k == 1 else f"{base}-{k}") in used:
            k += 1
        want[i] = base if k == 1 else f"{base}-{k}"
        used.add(want[i])
    got = unique_slugs(spark.createDataFrame(docs, "doc_id long, title string, date_stem string"), spark.createDataFrame([(s,) for s in old], "slug string"))
    assert {r.doc_id: r.slug for r in got.collect()} == want
