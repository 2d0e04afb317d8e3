"""Links of near copies, counted in groups of any size."""

import numpy as np
import pytest
from helpers import corpus, frame, shingle_set
from test_copies import near_group

from quire.llm import jaccard_join


@pytest.mark.parametrize(("small", "block", "strip"), [(48, 1 << 23, 512), (48, 1 << 16, 7), (2, 1 << 23, 512)])
def test_every_link_of_a_large_group_is_counted(spark, monkeypatch, small, block, strip):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "STRIP", strip)
    texts = [r[1] for r in corpus(40)] + near_group(120, edits=4) + near_group(30, seed=1, edits=3, words=20)
    got = jaccard_join.near_duplicates(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), small=small).collect()
    sets = {(t or "").lower(): shingle_set((t or "").lower()) for t in texts}
    want = {t: sum(o != t and bool(s) and len(s & x) >= 0.8 * len(s | x) - 1e-9 for o, x in sets.items()) for t, s in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == {i: want[(t or "").lower()] for i, t in enumerate(texts)}
    assert sum(want.values()) > 3000


@pytest.mark.parametrize("columns", [3, 2048])
def test_link_counts_by_blocks(monkeypatch, columns):
    monkeypatch.setattr(jaccard_join, "COLUMNS", columns)
    monkeypatch.setattr(jaccard_join, "STRIP", 16)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 30, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(70)]
    near = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for a in sets] for b in sets])
    np.fill_diagonal(near, False)
    left, right = np.arange(40), np.arange(40, 70)
    assert (jaccard_join.link_counts(sets, left, left, 0.8)[:40] == near[:40, :40].sum(axis=1)).all()
    across = jaccard_join.link_counts(sets, left, right, 0.8)
    assert (across[:40] == near[:40, 40:].sum(axis=1)).all() and (across[40:] == near[:40, 40:].sum(axis=0)).all()
