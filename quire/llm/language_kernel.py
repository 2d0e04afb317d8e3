"""Language identification with a string kernel.

Two texts are compared by the blended spectrum they share: the n-grams of one to five bytes of the lower-cased text that
are present in both, normalised by the geometric mean of how many each has (n-grams are hashed into ``BUCKETS``). A bounded
sample of labelled texts fits a Nyström map on landmark texts, and kernel ridge regression one against the rest.

In a long text nearly every bucket is taken, whatever the language. So a text is cut into even pieces of at most ``PIECE``
bytes, which overlap by what an n-gram needs, and stands for the mean of their normalised presences, in fitting as in
scoring. A text of one piece is compared as above.

Scoring is a product of matrices per batch of whole texts: presence x landmarks' presence x regression weights. The last
two do not depend on the text and are multiplied once, so a batch costs one product of (pieces x buckets) by
(buckets x languages), the same values by associativity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty
from quire.llm.kernel import U64, mix64, slices, spread

#: Longest n-gram in bytes, and buckets of the presence vector.
LONGEST, BUCKETS = 5, 1 << 14
#: Most bytes of a piece of text: at most five n-grams a byte for the buckets.
PIECE = 1 << 12
#: About so many labelled texts of each language are fitted on, so many landmarks in all, and the ridge.
PER_LANG, LANDMARKS, RIDGE = 600, 240, 1e-2
#: Pieces scored at once, so that a presence matrix stays at 4 MB.
BATCH = 256


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x buckets: which n-grams a text holds."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, BUCKETS), dtype=bool)
    h = np.zeros(len(data), dtype=np.uint64)
    for k in range(LONGEST):
        if len(data) <= k:
            break
        h = h[: len(data) - k] * U64(0x100000001B3) + data[k:] + U64(1)
        same = row[: len(h)] == row[k:]
        out[row[: len(h)][same], (mix64(h[same] + U64(k)) >> U64(64 - 14)).astype(np.int64)] = True
    return out


def normalised(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.float32) / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def piece_bounds(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every piece: as many even ones as a text needs, one at least."""
    lens = np.diff(offsets)
    n = np.maximum(1, -(-lens // PIECE))
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start, end = (offsets[of] + lens[of] * x // n[of] for x in (k, k + 1))
    return start, np.minimum(end + LONGEST - 1, offsets[of + 1]), of


def mean_product(data: np.ndarray, offsets: np.ndarray, product) -> np.ndarray:
    """Per text the mean of ``product`` (rows to rows, linear) of the normalised presence of its pieces, ``BATCH`` at once."""
    start, end, of = piece_bounds(offsets)
    out = None
    for a in range(0, len(of), BATCH):
        lens = end[a : a + BATCH] - start[a : a + BATCH]
        first, _, where = spread(start[a : a + BATCH], lens)
        rows = product(normalised(presence(data[where], np.append(first, lens.sum()))))
        out = np.zeros((len(offsets) - 1, rows.shape[1]), dtype=np.float64) if out is None else out
        texts, heads = np.unique(of[a : a + BATCH], return_index=True)
        out[texts] += np.add.reduceat(rows, heads, axis=0)
    return out / np.bincount(of)[:, None]


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in slices(column):
        for a in range(0, hi - lo, BATCH):
            b = min(a + BATCH, hi - lo)
            yield lo + a, lo + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bits: the packed presence of a text of one piece, the mean (32-bit floats) of a longer one."""
    for batch in batches:
        for lo, hi, data, offsets in groups(batch.column(1)):
            packed = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                one, ends = data[a:b], np.array([0, b - a])
                packed.append(np.packbits(presence(one, ends)).tobytes() if b - a <= PIECE else mean_product(one, ends, lambda x: x).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["lang", "bits"])


def _row(packed: bytes) -> np.ndarray:
    if len(packed) == BUCKETS // 8:
        return normalised(np.unpackbits(np.frombuffer(packed, dtype=np.uint8))[None, :])[0]
    return np.frombuffer(packed, dtype=np.float32)


def sample(docs: DataFrame, allowed: Column, per_lang: int = PER_LANG) -> DataFrame:
    """lang, text of about ``per_lang`` labelled texts of each language, those of least hash; all rows are counted for it."""
    rank = F.conv(F.substring(F.md5(F.concat(F.lit("sample:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty("text")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = docs.filter(allowed & F.col("lang").isNotNull())
    # One weight column per language is kept in the model, so their counts are few.
    share = {r[0]: per_lang / r[1] for r in rows.groupBy("lang").count().collect()}
    least = F.lit(0.0)
    for lang, part in sorted(share.items()):
        least = F.when(F.col("lang") == lang, part).otherwise(least)
    return rows.filter(rank < least).select("lang", F.lower(text_or_empty("text")).alias("text"))


def fit(texts: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(languages, buckets x languages weights) from a bounded table of lang, text."""
    rows = sorted((r[0], bytes(r[1])) for r in texts.mapInArrow(_present, "lang string, bits binary").collect())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return ["und"], np.zeros((BUCKETS, 1), dtype=np.float32)
    y = np.array([langs.index(r[0]) for r in rows])
    x = np.stack([_row(r[1]) for r in rows])
    each = max(1, landmarks // len(langs))
    chosen = np.concatenate([np.flatnonzero(y == k)[:: max(1, int((y == k).sum()) // each)][:each] for k in range(len(langs))])
    z = x[chosen]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ z.T).astype(np.float64) @ root
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.where(y[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    # Each language has the same total weight, so a rare one is not outvoted.
    weight = 1.0 / np.bincount(y, minlength=len(langs))[y]
    weight /= weight.mean()
    gram = phi.T @ (phi * weight[:, None]) + ridge * len(phi) / 100 * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return langs, np.vstack([z.T @ (root @ solved[:-1]), solved[-1:]]).astype(np.float32)


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    langs, weights = shared.value
    for batch in batches:
        for lo, hi, data, offsets in groups(batch.column(2)):
            margin = mean_product(data, offsets, lambda x: x @ weights[:-1]) + weights[-1]
            best = margin.argmax(axis=1)
            part = batch.slice(lo, hi - lo)
            letters = part.column(1).to_numpy(zero_copy_only=False)
            # Rounded, since the order in which a product is summed depends on the batch.
            score = np.round(np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64), 4)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([langs[k] if ok else "und" for k, ok in zip(best, letters)], pa.string()), pa.array(np.where(letters, score, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: one row per row of ``docs``, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0; where nothing could be learned all are ``und``. Texts
    are scored whole, long ones by the mean over all their pieces; repeated rows score alike; an empty table gives an empty result. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1] if len(model[1]) == BUCKETS + 1 else np.vstack([model[1], np.zeros((1, model[1].shape[1]), dtype=np.float32)])))
    rows = docs.select("doc_id", F.rlike(text_or_empty("text"), F.lit(r"\p{L}")).alias("letters"), F.lower(text_or_empty("text")).alias("text"))
    return rows.mapInArrow(lambda b: _predict(b, shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
