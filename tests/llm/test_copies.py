"""Repeated windows, Jaccard join and decontamination."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, frame, near_classes, shingle_set, tokens

from quire.llm import decontaminate, jaccard_join, repeated_windows
from quire.llm.kernel import mix64


def cut_by_hand(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram", "width"), [(35, 8, 1 << 20), (35, 8, 1 << 3), (10, 3, 1 << 20)])
def test_repeated_windows(spark, window, gram, width):
    few = corpus(80, words=["a", "b"], seed=3)[:80]
    rows = corpus(90) + [(1000 + r[0], *r[1:]) for r in few]
    docs = frame(spark, rows)
    got = repeated_windows.remove_repeats(docs, window, gram, width).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == cut_by_hand([(r[0], r[1]) for r in rows], window)
    assert repeated_windows.remove_repeats(docs.filter("false"), window, gram, width).count() == 0


def near_group(n, seed=0, edits=9, words=150):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [48, 2])
def test_near_duplicates(spark, small):
    rows = corpus(80)
    rows += [(2000 + i, t, "en", "s", 1) for i, t in enumerate(near_group(120))]
    rows += [(3000 + i, t, "en", "s", 1) for i, t in enumerate(near_group(30, seed=1, edits=3, words=20))]
    docs = frame(spark, rows)
    got = jaccard_join.near_duplicates(docs, small=small).collect()
    flat = [(r[0], r[1]) for r in rows]
    want = Counter(zip((str(i) for i, _ in flat), map(str, near_classes(flat))))
    assert Counter((str(r.doc_id), str(r.class_id)) for r in got) == want
    if small == 48:
        sets = {i: shingle_set(t) for i, t in flat if i is not None and 3000 <= i}
        low = {i: t.lower() for i, t in flat if i in sets}
        for r in got:
            if r.doc_id in sets:
                s = sets[r.doc_id]
                far = {low[o] for o, x in sets.items() if low[o] != low[r.doc_id] and len(s & x) >= 0.8 * len(s | x)}
                assert r.n_links == len(far)


def test_near_duplicates_of_nothing(spark):
    docs = frame(spark, corpus(5))
    assert jaccard_join.near_duplicates(docs.filter("false")).count() == 0
    blank = jaccard_join.near_duplicates(frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, " . ", None, None, None)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in blank) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_one_of_each(spark):
    rows = [r for r in corpus(60) if r[0] is not None][:-1]
    docs = frame(spark, rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = near_classes([(r[0], r[1]) for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r, c in zip(rows, classes) if r[0] == c})


def test_pruning_keeps_pairs_at_the_threshold():
    need = jaccard_join.least_matches(0.8, jaccard_join.TOLERANCE)
    rng = np.random.default_rng(0)
    equal = rng.random((20_000, jaccard_join.HASHES)) < 0.8
    steps = np.cumsum(equal, axis=1)[:, jaccard_join.STEP - 1 :: jaccard_join.STEP]
    assert (steps >= need).all(axis=1).mean() > 0.9999
    far = np.cumsum(rng.random((20_000, jaccard_join.HASHES)) < 0.35, axis=1)[:, jaccard_join.STEP - 1 :: jaccard_join.STEP]
    assert (far >= need).all(axis=1).mean() < 0.01


ITEMS = [(i, " ".join(random.Random(i).choices([f"b{k}" for k in range(300)], k=n))) for i, n in enumerate([5, 6, 7, 9, 14, 20, 33, 59, 90, 200])]


def test_leaks(spark):
    rng = random.Random(4)
    rows = corpus(40)
    want = set()
    for i, (item, text) in enumerate(ITEMS):
        pad = lambda: " ".join(rng.choices([f"p{k}" for k in range(200)], k=40))
        rows.append((500 + i, f"{pad()} {text.upper().replace(' ', ', ')}!\n{pad()}", None, None, None))
        want.add((500 + i, item))
        rows.append((600 + i, text, None, None, None))
        want.add((600 + i, item))
        w = text.split()
        rows.append((700 + i, f"{pad()} {' '.join(w[: len(w) // 2])} {pad()}", None, None, None))
        if len(w) >= 59:
            w[len(w) // 2] = "other"
            rows.append((800 + i, f"{pad()} {' '.join(w)} {pad()}", None, None, None))
            want.add((800 + i, item))
    items = [*ITEMS, (97, None), (98, ""), (99, "too short item"), (100, ITEMS[5][1])]
    want |= {(d, 100) for d, i in want if i == 5}
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(*i, 3, ["x"]) for i in items], "item_id long, text string, item int, shingles array<string>")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    exact = [r for r in got if r.doc_id < 700]
    assert all(r.similarity == pytest.approx(1) for r in exact)
    assert {r.start_word for r in exact if r.doc_id < 600} == {40}
    for pass_bytes in (40, 1):  # some passes hold short items only
        in_parts = decontaminate.leaks(docs, bench, pass_bytes=pass_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in in_parts} == want
    clean = decontaminate.clean_rows(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.leaks(docs.filter("false"), bench).count() == 0
    assert decontaminate.leaks(docs, bench.filter("false")).count() == 0
    assert decontaminate.leaks(docs, bench.filter("item_id >= 97 and item_id < 100")).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "one two three four five six seven")], "item_id long, text string")
    text = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    assert [r.item_id for r in decontaminate.leaks(text, short, pass_bytes=1).collect()] == [2]


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.build_index(ITEMS, 0.8)
    for size, part in index.items():
        prints = mix64(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
        for k in range(0, 3000, 2):
            flips = rng.choice(64, rng.integers(0, 10), replace=False)
            prints[k] = part["prints"][k % len(part["prints"])] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else part["prints"][0]
        got = set(zip(*(x.tolist() for x in decontaminate.within_radius(prints, part))))
        want = np.bitwise_count(prints[:, None] ^ part["prints"][None, :]) <= decontaminate.RADIUS
        assert got == set(zip(*(x.tolist() for x in np.nonzero(want)))), size


def test_passages_on_the_driver_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    want = set()
    items = [(b.item_id, b" " + b" ".join(tokens(b.text)) + b" ") for b in bench.collect()]
    for d in docs.collect():
        text = b" " + b" ".join(tokens(d.text)) + b" "
        want |= {(d.doc_id, i) for i, t in items if t in text and len(t.split()) >= 5}
    assert want <= got
    assert all(d in {x for x, _ in want} for d, _ in got)
