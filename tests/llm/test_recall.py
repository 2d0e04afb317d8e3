"""Edited passages: every one at the threshold is found, wherever and however it was edited."""

import math
import random
from collections import Counter

import pytest
from helpers import tokens

from quire.llm import decontaminate


def shingles_of(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def best_by_hand(text, item, weight, one):
    """Largest weighted Jaccard similarity of the item and a window of its length, clipped to the text."""
    words, own = tokens(text), shingles_of(tokens(item))
    total, length, best = sum(weight[s] for s in own), len(tokens(item)), 0.0
    for b in range(-length + 1, len(words)):
        there = shingles_of(words[max(b, 0) : b + length])
        best = max(best, sum(weight[s] for s in own & there) / (total + one * len(there - own)))
    return best


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [f"e{rng.randrange(99)}"], [f"e{rng.randrange(99)}"]])
    return w


def edited_corpus(seed=11, lengths=(9, 16, 20, 28, 49, 52, 60, 100, 140), copies=24):
    rng = random.Random(seed)
    items, docs = [], []
    line = [f"c{k}" for k in range(12)]
    for i, n in enumerate(lengths):
        words = [f"b{rng.randrange(2000)}" for _ in range(n)]
        if n > 40:
            words[6:18] = line  # a passage that several items share weighs less
        items.append((i, " ".join(words)))
        for k in range(copies):
            pad = [[f"p{rng.randrange(300)}" for _ in range(rng.choice([0, 0, 3, 30]))] for _ in range(2)]
            changed = list(words)
            if k % 2:
                changed[k * n // copies] = "other"
            else:
                changed = edited(rng, words, 1 + k % 4)
            docs.append((len(docs), " ".join(pad[0] + changed + pad[1])))
    return items, docs


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_edited_passages_are_all_found(spark, similarity):
    items, docs = edited_corpus()
    df = Counter(s for _, t in items for s in shingles_of(tokens(t)))
    weight, one = {s: math.log1p(len(items) / n) for s, n in df.items()}, math.log1p(len(items))
    best = {(d, i): best_by_hand(text, item, weight, one) for d, text in docs for i, item in items if set(tokens(text)) & set(tokens(item))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, similarity).collect()}
    assert set(got) == {p for p, s in best.items() if s >= similarity - 1e-9}
    assert all(r.similarity == pytest.approx(best[p]) for p, r in got.items())
    if similarity == 0.8:
        assert sum(s < 0.9 for s in (best[p] for p in got)) > 40
    # The windows by themselves, without the anchors.
    alone = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, similarity, complete=False).collect()}
    assert alone == {p for p, r in got.items() if r.by_simhash}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)) if similarity == 0.8 else ((similarity, 1.01),):
        there = {p for p in got if low <= best[p] < high}
        print(low, len(there), len(there & alone))
        assert len(there & alone) >= 0.9 * len(there)


def test_a_short_window_lies_in_every_clean_run():
    for n in range(1, 400):
        for similarity in (0.8, 0.9):
            windows = decontaminate.item_windows(n, similarity)
            short = min(s for s, _ in windows)
            most = int(n * (1 - similarity) / (1 + similarity) + 1e-9)
            spoilt = most // decontaminate.SHINGLE
            run = -(-(n - most) // (spoilt + 1))
            starts = [at for s, at in windows if s == short]
            assert all(any(b <= at and at + short <= b + run for at in starts) for b in range(n - run + 1)), n
