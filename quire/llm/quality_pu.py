"""Quality scores by positive-unlabelled learning.

Only trusted positives and unlabelled web text are learned from: a linear model over features of the whole text minimises
the non-negative unbiased risk ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` with logistic loss. Where the last part
turns negative (the model has begun to fit the unlabelled texts one by one), its gradient is followed backwards.

The class prior is estimated from the same two samples: a first model tells positives from unlabelled texts; among texts
held back, the least ratio of the unlabelled to the positive share above any of its thresholds bounds the share of
positives among the unlabelled.

Fitting uses bounded samples (``POSITIVES``, ``UNLABELLED``), chosen by hash over all rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, text_or_empty
from quire.llm.kernel import NOT_SPACE, U64, mix64, slices, word_hashes, words

#: Most rows fitted on, of either kind.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Documents that score less are rejected; one fold of so many is held out.
LEAST, FOLDS = 0.3, 5
#: Hashed shares of byte trigrams, after the shape features.
TRIGRAMS = 256
#: What trigram features are scaled by beside the shape features, which short texts fix far better.
TRIGRAM_SCALE = 0.1
STEPS, RATE, DECAY = 400, 0.03, 3e-4

UPPER, LOWER, DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
MARKS = [np.arange(256) == ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\n "]
SHAPES = 12 + len(MARKS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x features: shares of byte classes and marks, word lengths and repetition, hashed trigram shares."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1).astype(np.float64)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, SHAPES + TRIGRAMS), dtype=np.float32)
    share = lambda mask: np.bincount(row[mask[data]], minlength=n) / per
    starts, ends, of = words(data, offsets, NOT_SPACE)
    count = np.bincount(of, minlength=n)
    many = np.maximum(count, 1)
    h = word_hashes(data, starts, ends)
    order = np.lexsort((h, of))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    twice = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    lens = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint8)
    word_end = ~(UPPER | LOWER | DIGIT)[last] & (last < 128)
    upper, lower = share(UPPER), share(LOWER)
    shape = [
        upper, lower, share(DIGIT), upper / np.maximum(upper + lower, 1e-9), share(np.arange(256) >= 128),
        np.log1p(size) / 12, np.bincount(of, weights=lens, minlength=n) / many / 12,
        np.bincount(of[order][new], minlength=n) / many, np.bincount(of[1:][twice], minlength=n) / many,
        np.bincount(of[word_end], minlength=n) / many, np.bincount(of[lens > 14], minlength=n) / many, count == 0,
    ]
    for k, column in enumerate([*shape, *(share(m) for m in MARKS)]):
        out[:, k] = column
    if len(data) > 2:
        h = mix64(data[:-2].astype(np.uint64) * U64(65536) + data[1:-1].astype(np.uint64) * U64(256) + data[2:])
        same = row[:-2] == row[2:]
        cell = row[:-2][same] * TRIGRAMS + (h[same] >> U64(56)).astype(np.int64) % TRIGRAMS
        out[:, SHAPES:] = np.sqrt(np.bincount(cell, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / per[:, None])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            packed = [r.tobytes() for r in features(data, offsets).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["positive", "x"])


def _scaled(x, mean, scale):
    x = np.clip((x - mean) / scale, -8, 8)
    x[:, SHAPES:] *= TRIGRAM_SCALE
    return x


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def _descend(gradient, width: int) -> np.ndarray:
    """Adam over all rows with a falling rate; the mean of the second half of the steps, since the risk switches sign."""
    w, m, v, mean = (np.zeros(width, dtype=np.float32) for _ in range(4))
    for t in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * min(1.0, 2 * (1 - t / STEPS) + 0.02)
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        if t > STEPS // 2:
            mean += w
    return (mean / (STEPS - STEPS // 2)).astype(np.float64)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from a model of one half that ranks the other half."""
    a, b = p[::2], u[::2]
    w = _descend(lambda w: -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b), p.shape[1])
    fp, fu = p[1::2] @ w, u[1::2] @ w
    cut = np.quantile(fp, np.linspace(0, 0.98, 99))
    above_p, above_u = ((x[None, :] >= cut[:, None]).mean(axis=1) for x in (fp, fu))
    slack = 1.0 / np.sqrt(len(fp)) + 1.0 / np.sqrt(len(fu))
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk."""

    def gradient(w):
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        if negative < 0:
            return -down
        return down - prior * (p.T @ (1 - _sigmoid(fp))) / len(p)

    return _descend(gradient, p.shape[1])


def _rank(salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def fit(docs: DataFrame, positive_ids: DataFrame, allowed: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """A model from ids of trusted positives (doc_id) and from ``docs`` as unlabelled text, both where ``allowed``.

    At most so many ids of least hash are fitted on. None if either sample has fewer than two texts.
    """
    ids = docs.filter(allowed & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    trusted = positive_ids.filter(allowed & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = ids.join(trusted, "doc_id", "left_semi").orderBy(_rank("p:"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    chosen = chosen.unionByName(ids.orderBy(_rank("u:"), "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive")))
    # At most positives + unlabelled ids of a few bytes each.
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("positive", "text")
    rows = sorted((r[0], bytes(r[1])) for r in texts.mapInArrow(_features, "positive boolean, x binary").collect())
    is_positive = np.array([r[0] for r in rows], dtype=bool)
    if min(is_positive.sum(), (~is_positive).sum()) < 2:
        return None
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = _scaled(x, mean, scale)
    rng = np.random.default_rng(0)
    x, is_positive = (lambda o: (x[o], is_positive[o]))(rng.permutation(len(x)))
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    p, u = x[is_positive], x[~is_positive]
    prior = estimate_prior(p, u)
    return {"mean": mean, "scale": scale, "weights": fit_nnpu(p, u, prior), "prior": prior}


def from_labels(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model whose trusted positives are the labels of quality 1; the held-out fifth of the ids is not learned from."""
    return fit(docs, labels.filter("quality = 1").select("doc_id"), fold(FOLDS) != 0)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            if model is None:
                score = np.full(hi - lo, 0.5)
            else:
                x = _scaled(features(data, offsets).astype(np.float16).astype(np.float32), model["mean"], model["scale"])
                # Rounded, since the order in which a product is summed depends on the batch.
                score = np.round(_sigmoid(x @ model["weights"][:-1] + model["weights"][-1]), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1, from the text alone): one row per row of ``docs``.

    Null texts score as empty ones; equal texts score alike; without a model every score is 0.5; an empty table gives an
    empty result. A text is worked on whole, in about 50 bytes for each of its own. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    return rows.mapInArrow(lambda b: _score(b, shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def good_rows(docs: DataFrame, model: dict | None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns kept.

    Null texts are judged as empty ones, repeated rows and rows without id by their texts; without a model all stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = F.pandas_udf(lambda text: _keep(text, shared, least), "boolean")
    return docs.filter(keep(text_or_empty("text")))


def _keep(text, shared, least):
    import pandas as pd

    batch = pa.RecordBatch.from_arrays([pa.nulls(len(text)), pa.array(text, pa.string())], names=["doc_id", "text"])
    return pd.concat([pd.Series(b.column(1).to_numpy() >= least) for b in _score(iter([batch]), shared)], ignore_index=True) if len(text) else pd.Series([], dtype=bool)
