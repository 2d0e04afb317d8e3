"""Postings that move packed: pieces of terms from tokens, put together to blocks without unpacking them."""

import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from quire.functions import text as tx
from quire.operators import live_index as li
from quire.operators import search as se

TOKENS = pa.schema([("doc_id", pa.int64()), *[(f, pa.list_(pa.string())) for f in se.FIELDS]])


def unpacked(blocks):
    """(term, doc_id, batch) to the length and the places by field."""
    out = {}
    for b in blocks:
        rows = b.select(["term", "first_doc", "ids", "batches", "infos", "places"])
        for r in (r for x in li._hits(iter([rows])) for r in x.to_pylist()):
            length, fields = out.setdefault((r["term"], r["doc_id"], r["batch"]), (r["length"], {}))
            assert length == r["length"] and r["tf"] == len(r["positions"])
            fields.setdefault(r["field"], []).append(r["positions"])
    return out


def wanted(docs, batch):
    out = {}
    for d, *texts in docs:
        length = sum(len(t or []) for t in texts)
        for field, t in zip(se.FIELDS, texts):
            for term in set(t or []):
                was, fields = out.setdefault((term, d, batch), (0, {}))
                fields.setdefault(field, []).append([i for i, x in enumerate(t) if x == term])
                out[term, d, batch] = (max(was, length), fields)
    return {k: (n, {f: sorted(p) for f, p in v.items()}) for k, (n, v) in out.items()}


def ordered(pieces, cuts):
    """Pieces as Spark hands them over: in the order of slice, term and id, a few to a batch."""
    rows = [r for b in pieces for r in b.to_pylist()]
    low = lambda x: (x is not None, x or 0)
    rows.sort(key=lambda r: (r["slice"], r["term"], low(r["first_doc"]), low(r["last_doc"])))
    names = ("bucket", "slice", "term", "first_doc", "ids", "batches", "infos", "places")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 4)
    for a in range(0, len(rows), 7):
        yield pa.RecordBatch.from_arrays([pa.array([{**r, "bucket": 1}[n] for r in rows[a : a + 7]], k) for n, k in zip(names, kinds)], names=list(names))


@pytest.mark.parametrize("cuts", [[], [10, 25]])
@pytest.mark.parametrize("in_order", [True, False])
def test_blocks_hold_every_hit_of_the_tokens(monkeypatch, cuts, in_order):
    rng = random.Random(7)
    monkeypatch.setattr(li, "PIECE_TOKENS", 40)
    monkeypatch.setattr(li, "OPEN_BYTES", 100)
    word = lambda: rng.choice(["a", "a", "b", "c", f"r{rng.randrange(30)}"])
    ids = [*range(-3, 40), 7, 7, None, None]
    docs = [(d, *[rng.choice([None, [word() for _ in range(rng.randrange(n))]]) for n in (2, 3, 12)]) for d in ids]
    if in_order:
        docs.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    else:
        rng.shuffle(docs)
    batch = pa.RecordBatch.from_pylist([dict(zip(TOKENS.names, d)) for d in docs], TOKENS)
    pieces = [*li._token_pieces(cuts)(iter([batch]))]
    made = [*li._blocked(4, 9, None)(ordered(pieces, cuts))]
    got = {k: (n, {f: sorted(p) for f, p in v.items()}) for k, (n, v) in unpacked(made).items()}
    assert got == wanted(docs, 9)
    by_term = {}
    for r in (r for b in made for r in b.to_pylist()):
        assert 1 <= r["n"] <= 4
        by_term.setdefault(r["term"], []).append(r)
    for term, rows in by_term.items():
        spans = [(r["first_doc"], r["last_doc"]) for r in rows if r["first_doc"] is not None]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])), (term, spans)
        assert sum(r["n"] for r in rows) == len({d for t, d, _ in got if t == term})
        if not cuts:
            assert all(r["n"] == 4 for r in rows[(rows[0]["first_doc"] is None) : -1])


def test_a_fold_leaves_out_what_was_replaced():
    docs = lambda ids, w: pa.RecordBatch.from_pylist([{"doc_id": d, "slug": None, "title": None, "body": [w, "x"]} for d in ids], TOKENS)
    blocks = []
    for batch, part in enumerate((docs([None, *range(12)], "a"), docs([3, 5, 20], "b"))):
        blocks += [*li._blocked(4, batch, None)(ordered([*li._token_pieces([])(iter([part]))], []))]
    rows = sorted((r for b in blocks for r in b.to_pylist()), key=lambda r: (r["first_doc"] is not None, r["term"], r["first_doc"] or 0))
    pieces = [pa.RecordBatch.from_pylist([{**r, "slice": -1 if r["first_doc"] is None else 0}]) for r in rows]
    made = [*li._blocked(4, None, (np.array([3, 5]), np.array([1, 1])))(ordered(pieces, []))]
    assert sorted(unpacked(made), key=repr) == sorted([
        *[(t, d, 0) for d in (None, *range(12)) if d not in (3, 5) for t in "ax"], *[(t, d, 1) for d in (3, 5, 20) for t in "bx"]], key=repr)


def test_postings_move_as_pieces_and_are_not_grouped_row_by_row(spark):
    """A row moved for each word of each document, and was aggregated twice and ranked."""
    docs = spark.createDataFrame([(i, "s", "t", "a b a") for i in range(300)], "doc_id long, slug string, title string, body string").coalesce(1)
    pieces = se.tokenised(docs).mapInArrow(li._token_pieces([]), li.PIECES)
    assert pieces.count() == 4
    made = li._packed(pieces, 1, 0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    assert sorted((r["term"], r["n"]) for r in made.collect()) == sorted((t, n) for t in "abst" for n in (128, 128, 44))
    flat = li.hits(li.blocks(se.index_rows(docs), 0, 1)).select("term", "doc_id", "field", "positions")
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, li.hits(made).select("term", "doc_id", "field", "positions").collect()))


def test_functions_travel_without_the_modules_around_them(spark, monkeypatch):
    """A text function that was used holds a lock, which does not travel."""
    monkeypatch.setattr(tx, "held", threading.RLock(), raising=False)
    for f in (li._token_pieces([]), li._row_pieces([]), li._blocked(4, 0, None), li._hits, se._entries):
        assert cloudpickle.dumps(f)
