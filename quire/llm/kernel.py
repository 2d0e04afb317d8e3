"""Vectorised text kernels: words, word hashes and rolling hashes straight from an Arrow string column.

Everything works on the bytes of a group of texts at once, in slices of a bounded size, so that a task holds one slice
of work beside its Arrow batch. A single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SLICE = 1 << 19

U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x5851F42D4C957F2D  # odd, so its powers stay invertible


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))

#: Byte classes: all but ASCII white space; ASCII letters and digits with every byte beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for groups of rows; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of ``kind`` within a row."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def spread(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges: where each begins in their concatenation, every element's place in its range, and its index."""
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    return first, place, place + np.repeat(starts, lens)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    first, place, index = spread(starts, lens)
    value = BYTES[data[index]] * powers(int(lens.max()))[place]
    return mix64(np.add.reduceat(value, first) + lens.astype(np.uint64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every ``k`` neighbours, by doubling; rows are not told apart here."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    done, width, cur, size = None, 0, h, 1
    while True:
        if k & size:
            if done is None:
                done, width = cur, size
            else:
                n = min(len(done), len(cur) - width)
                done = done[:n] * U64(pow(BASE, size, 1 << 64)) + cur[width : width + n]
                width += size
        if size * 2 > k:
            break
        cur = cur[:-size] * U64(pow(BASE, size, 1 << 64)) + cur[size:]
        size *= 2
    return mix64(done)


def extreme(x: np.ndarray, k: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``k`` neighbours, by doubling."""
    if len(x) < k:
        return x[:0]
    size = 1
    while size * 2 <= k:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = k - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles and their rows; a row of fewer words has one shingle, of all its words."""
    starts, ends, row = words(data, offsets, kind)
    h = word_hashes(data, starts, ends)
    n = np.bincount(row, minlength=len(offsets) - 1)
    at = np.cumsum(n) - n
    parts, rows = [], []
    full = rolling(h, k)
    if len(full):
        inside = row[: len(full)] == row[k - 1 :]
        parts.append(full[inside])
        rows.append(row[: len(full)][inside])
    for few in range(1, k):
        short = np.flatnonzero(n == few)
        if len(short):
            parts.append(rolling(h, few)[at[short]])
            rows.append(short)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    s, r = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return s[order], r[order]
