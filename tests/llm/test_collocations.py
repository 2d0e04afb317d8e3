"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from helpers import corpus, frame
from quire.llm import collocations as col

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, most, least, cover):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        held = defaultdict(int)
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    held[q] = max(held[q], a)
        for p, a in counts.items():
            if len(p) == 1 or a < least or (len(p) == 2 and p in held and 100 * held[p] >= cover * a):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mixed(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "é", "É", "a b", "||"]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab[:12] if rng.random() < 0.6 else vocab) + rng.choice(["", "", "", ".", ",", "!", "\n"]) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            w += ["new", "york", "city", f"x{i % 5}"] * rng.randrange(0, 4)
        rows.append((rng.choice([" ", "\t", "  "]).join(w), ["en", "fr", None, "und", ""][i % 5]))
    return rows + [(None, "en"), ("", None), ("loop " * 90, "en"), ("loop " * 90, "de")]


@pytest.mark.parametrize("most, least, first, batch", [(5, 2, 3, 1 << 20), (40, 3, 1, 7), (10_000, 2, 20, 64), (3, 10, 1, 1)])
def test_equal_to_counting_everything(spark, most, least, first, batch):
    rows = mixed(most)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = col.collocations(docs, most, least, 50, first, batch if batch > 6 else 1 << 20, 64).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, most, least, 50)


def test_corpus_of_odd_rows(spark):
    rows = corpus(60, words=[f"w{i}" for i in range(40)])
    got = col.collocations(frame(spark, rows), 50, 3, 50, 30).collect()
    assert sorted(map(tuple, got)) == by_hand([(t, g) for _, t, g, *_ in rows], 50, 3, 50)
    assert col.collocations(frame(spark, rows).limit(0)).count() == 0


def test_nothing_frequent_enough(spark):
    docs = spark.createDataFrame([("a b c", "en"), ("b c d", "en")], "text string, lang string")
    assert col.collocations(docs).count() == 0


def test_long_text_in_parts_is_counted_as_a_whole():
    text = " ".join(random.Random(1).choice(["aa", "b.", "cc,", "dd", "\teé"]) for _ in range(3000)) + " end"
    batch = lambda t: [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([t])], names=["lang", "text"])]
    count = lambda limit: sum((Counter({(r["lang"], r["h1"], r["h2"]): r["n"]}) for b in col._count(iter(batch(text)), limit) for r in b.to_pylist()), Counter())
    whole = count(1 << 20)
    assert count(16) == whole == count(1000) and whole["en", None, None] == 3001


def test_equal_keys_of_different_phrases_stay_apart():
    import numpy as np

    key, h = np.zeros(4, dtype=np.uint64), np.array([1, 2, 1, 2], dtype=np.uint64)
    at, n = col._distinct(key, h)
    found = Counter()
    for i, k in zip(at, n):
        found[int(h[i])] += int(k)
    assert found == {1: 2, 2: 2}


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_100_000_000)], "a long, l long, r long")
    got = row.select(col._score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 3_100_000_000)
