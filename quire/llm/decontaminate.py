"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

Words are runs of letters and digits of the lower-cased text; a shingle is five of them. An item is fingerprinted over
its first and its last window of an item-sized class of shingles (at least two thirds of the item each) and over short
windows that follow each other through the whole of it. A changed word spoils at most five shingles, so a passage at the
threshold leaves a run of shingles unchanged whose least length follows from the item's; the short windows are half of
that, so one of them lies whole in the run. Windows of these sizes are fingerprinted in every document at every word. A
64-bit fingerprint is cut into four blocks of 16 bits: if two differ in at most three bits, some block is equal, so
looking up the blocks finds every fingerprint within the radius.

Shingles that many items share weigh less, so a passage may be spoilt in more places than counted above. The few that
SimHash misses for this are completed by anchors: the heaviest shingles of an item, as many as weigh more than a passage
at the threshold may lack. ``by_simhash`` tells which leaks the windows found by themselves.

Around what is met by either way, all windows of the item's length are weighed by running sums; the words of the best
are then verified, by weighted shingles, in DataFrame operations. A task keeps the fingerprints, the shingles and their
weights of one pass, whose items have at most ``PASS_BYTES`` of text together (or are one item); a larger benchmark is
taken in passes. Only passages near an item are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prefix_sums, text_or_empty
from quire.llm.kernel import ALNUM, U64, mix64, rolling, slices, spread, word_hashes, words
from quire.session import cut_lineage

SHINGLE = 5
#: Least weighted Jaccard similarity of a passage and its item.
SIMILARITY = 0.8
#: Window classes, in shingles.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Bits in which fingerprints may differ: with four blocks one is equal then.
RADIUS = 3
#: Bytes of item text that one pass sends to the tasks, as fingerprints (about 60 bytes a window) and shingles (16 bytes each).
PASS_BYTES = 1 << 22
#: Bits of a shingle by which a task tells at once that it is no anchor.
SIEVE = 22


def fingerprints(shingle: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """SimHash of every window of each size: bit by bit the majority of the window's shingles."""
    if not sizes:
        return
    half, ones, size = None, np.unpackbits(shingle.view(np.uint8).reshape(-1, 8), axis=1), 1
    while size <= max(sizes) and len(ones):
        if size in sizes:
            yield size, _majority(ones, size)
        longer = size + size // 2
        if longer in sizes and half is not None and len(half) > size:
            n = len(half) - size
            yield longer, _majority(ones[:n] + half[size:], longer)
        half, ones = ones, ones[:-size] + ones[size:] if len(ones) > size else ones[:0]
        size *= 2


def _majority(ones: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel()


def clean_run(n: int, similarity: float) -> int:
    """The least longest run of unchanged shingles in a passage at ``similarity`` to an item of ``n`` equal shingles.

    ``n (1 - s) / (1 + s)`` shingles may be spoilt; a change inside spoils five of them, one at an end may spoil fewer.
    """
    spoilt = int(n * (1 - similarity) / (1 + similarity) + 1e-9)
    return -(-(n - spoilt) // (spoilt // SHINGLE + 1))


def item_windows(n: int, similarity: float) -> list[tuple[int, int]]:
    """(size, first shingle) of the windows of an item of ``n`` shingles."""
    whole = max(s for s in SIZES if s <= n)
    short = max(s for s in SIZES if s <= max(1, (clean_run(n, similarity) + 1) // 2))
    places = {(whole, 0), (whole, n - whole), (short, n - short)}
    return sorted(places | {(short, at) for at in range(0, n - short + 1, short)})


def build_index(items: list[tuple[int, str]], similarity: float) -> dict[int, dict]:
    """Per window size: fingerprints, item numbers and the block lists."""
    found: dict[int, list] = {}
    for number, text in items:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
        shingle = rolling(word_hashes(data, starts, ends), SHINGLE)
        if len(shingle):
            wanted = item_windows(len(shingle), similarity)
            prints = dict(fingerprints(shingle, {s for s, _ in wanted}))
            for size, at in wanted:
                found.setdefault(size, []).append((int(prints[size][at]), number))
    index = {}
    for size, rows in found.items():
        prints, owner = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64)
        lists = []
        for b in range(4):
            block = prints.view(np.uint16).reshape(-1, 4)[:, b]
            lists.append((np.concatenate([[0], np.cumsum(np.bincount(block, minlength=1 << 16))]), np.argsort(block, kind="stable")))
        index[size] = {"prints": prints, "items": owner, "lists": lists, "any": [np.diff(x[0]) > 0 for x in lists]}
    return index


def within_radius(prints: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(window, index row) of all fingerprints at most ``RADIUS`` bits apart."""
    blocks = prints.view(np.uint16).reshape(-1, 4)
    hit = reduce(np.logical_or, (index["any"][b][blocks[:, b]] for b in range(4)))
    at = np.flatnonzero(hit)
    pairs = []
    for b in range(4):
        ends, rows = index["lists"][b]
        value = blocks[at, b].astype(np.int64)
        lens = ends[value + 1] - ends[value]
        _, _, where = spread(ends[value], lens)
        window, row = np.repeat(at, lens), rows[where]
        close = np.bitwise_count(prints[window] ^ index["prints"][row]) <= RADIUS
        pairs.append(np.stack([window[close], row[close]], axis=1))
    both = np.unique(np.concatenate(pairs), axis=0)
    return both[:, 0], both[:, 1]


def build_anchors(items: list[tuple[int, str, list[float]]], similarity: float, one: float) -> dict:
    """Anchors of (number, text, weights of its distinct shingles in the order of the text), and what the items hold.

    ``one`` is the weight of a shingle of no item.
    """
    held, keys, owners = {}, [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for number, text, weights in items:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
        shingle = rolling(word_hashes(data, starts, ends), SHINGLE)
        if len(shingle):
            own, at = np.unique(shingle, return_index=True)
            weight = np.empty(len(own))
            weight[np.argsort(at)] = weights
            held[number] = (own, weight, float(weight.sum()), len(starts))
            heavy = np.lexsort((mix64(own), -weight))
            enough = np.searchsorted(np.cumsum(weight[heavy]), ((1 - similarity) + 1e-9) * weight.sum(), "right") + 1
            keys.append(own[heavy[:enough]])
            owners.append(np.full(len(keys[-1]), number))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    sieve = np.zeros(1 << SIEVE, dtype=bool)
    sieve[keys >> U64(64 - SIEVE)] = True
    return {"keys": keys[order], "owners": owners[order], "sieve": sieve, "held": held, "similarity": similarity, "one": one}


def _best_window(shingle: np.ndarray, low: int, high: int, first: int, last: int, item: tuple, anchors: dict) -> tuple[int, int] | None:
    """Begin and end word of the best window that starts at a word from ``low`` to ``high``, if it may pass.

    A shingle counts once in a window: in those that start after its last occurrence before, and reach it. Windows are
    clipped to the document, whose words are ``first`` to ``last``.
    """
    own, weight, total, length = item
    n = length - SHINGLE + 1
    at = np.arange(max(low, first), min(high + n, last - SHINGLE + 1))
    part = shingle[at]
    order = np.argsort(part, kind="stable")
    before = np.full(len(part), low - 1)
    again = part[order[1:]] == part[order[:-1]]
    before[order[1:][again]] = at[order[:-1][again]]
    enter, leave = np.maximum(np.maximum(before + 1, at - n + 1), low) - low, np.minimum(at, high) + 1 - low
    some = enter < leave
    place = np.minimum(np.searchsorted(own, part), len(own) - 1)
    known = own[place] == part
    running = lambda x: np.cumsum(np.bincount(enter[some], x[some], high - low + 2) - np.bincount(leave[some], x[some], high - low + 2))[:-1]
    value = running(np.where(known, weight[place], 0.0)) / (total + np.round(running(np.where(known, 0.0, 1.0))) * anchors["one"])
    if value.max() < anchors["similarity"] - 1e-9:
        return None
    begin = low + np.flatnonzero(value >= value.max() - 1e-9)
    begin, end = np.maximum(begin, first), np.minimum(begin + length, last)
    k = np.lexsort((-end, begin))[0]
    return int(begin[k]), int(end[k])


def anchors_met(shingle: np.ndarray, row: np.ndarray, anchors: dict) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, item) of all anchors met."""
    at = np.flatnonzero(anchors["sieve"][shingle >> U64(64 - SIEVE)])
    at = at[row[at] == row[at + SHINGLE - 1]]
    low, high = (np.searchsorted(anchors["keys"], shingle[at], side) for side in ("left", "right"))
    _, _, where = spread(low, high - low)
    return np.repeat(at, high - low), anchors["owners"][where]


def windows_met(shingle: np.ndarray, row: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, item) of all windows near a window of an item."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    for size, prints in fingerprints(shingle, set(index)):
        at, hit = within_radius(prints, index[size])
        inside = row[at] == row[at + size + SHINGLE - 2]
        found.append(np.stack([at[inside], index[size]["items"][hit[inside]]]))
    return tuple(np.concatenate(found, axis=1))


def best_windows(shingle: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, met: list, anchors: dict) -> np.ndarray:
    """(row, item, begin, end, ways) of the best window around each group of what is met; ``met`` holds a pair for each way."""
    at, item, way = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*((a, i, np.full(len(a), 1 << k)) for k, (a, i) in enumerate(met))))
    order = np.lexsort((at, item, row[at]))
    at, item, way = at[order], item[order], way[order]
    reach = np.array([anchors["held"][i][3] - SHINGLE for i in item.tolist()], dtype=np.int64)
    apart = np.ones(len(at), dtype=bool)
    apart[1:] = (row[at[1:]] != row[at[:-1]]) | (item[1:] != item[:-1]) | (np.diff(at) > reach[1:])
    heads = np.flatnonzero(apart)
    out = []
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(at)).tolist()):
        doc, i = row[at[a]], int(item[a])
        window = _best_window(shingle, int(at[a] - reach[a]), int(at[b - 1]), int(first[doc]), int(first[doc] + n[doc]), anchors["held"][i], anchors)
        if window:
            out.append((doc, i, *window, np.bitwise_or.reduce(way[a:b])))
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def _passages(shared, batches: Iterator[pa.RecordBatch], complete: bool) -> Iterator[pa.RecordBatch]:
    index, anchors = shared.value
    for batch in batches:
        for lo, _, data, offsets in slices(batch.column(1)):
            starts, ends, row = words(data, offsets, ALNUM)
            shingle = rolling(word_hashes(data, starts, ends), SHINGLE)
            if not len(shingle):
                continue
            n = np.bincount(row, minlength=len(offsets) - 1)
            first = np.cumsum(n) - n
            met = [windows_met(shingle, row, index)] + ([anchors_met(shingle, row, anchors)] if complete else [])
            found = best_windows(shingle, row, first, n, met, anchors)
            if len(found):
                doc, item, begin, end, ways = found.T
                text = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lo + doc)), pa.array(item, pa.int64()), pa.array(begin - first[doc], pa.int64()),
                        pa.array([text[starts[b] : ends[e - 1]].decode() for b, e in zip(begin, end)], pa.string()), pa.array((ways & 1).astype(bool)),
                    ],
                    names=["doc_id", "item", "start_word", "passage", "by_simhash"],
                )


def _shingles(text):
    token = F.regexp_extract_all(text, F.lit(r"[0-9a-zA-Z\x{80}-\x{10FFFF}]+"), F.lit(0))
    n = F.size(token) - (SHINGLE - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(token, i, SHINGLE), " ")))).otherwise(F.array().cast("array<string>"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, pass_bytes: int = PASS_BYTES, complete: bool = True) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, by_simhash: the best passage of each (document, benchmark item).

    Shingles weigh ``log(1 + items / items that hold it)``; a shingle of no item weighs as one of a single item. Items
    and texts of fewer than five words, null or empty have no shingle and never match, also where a whole benchmark or
    pass is such. Documents of one id are reported together; a null id is reported as null. Items with equal texts are
    each reported; empty tables give no rows. ``by_simhash`` is true where the fingerprints alone found the item in the
    document; ``complete=False`` leaves the anchors out. A text is worked on whole, in about 100 bytes for each of its own.
    Only doc_id, item_id and text are read.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.lower(text_or_empty("text")).alias("text"))
    size = F.octet_length("text").cast("long")
    items = prefix_sums(items, [], ["item_id", "text"], {"item": F.lit(1), "before": size})
    items = cut_lineage(items.withColumn("pass", F.expr(f"before div {pass_bytes}")).drop("before").withColumn("shingles", _shingles(F.col("text"))))
    count = items.count()
    weight = items.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    weight = weight.select("s", F.log1p(F.lit(float(count)) / F.col("df")).alias("w"))
    weighed = items.select("item", F.posexplode("shingles").alias("place", "s")).join(weight, "s").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("place", "s", "w"))).alias("own"), F.sum("w").alias("total")
    )
    weighed = cut_lineage(weighed.join(items.select("item", "item_id", "text", "pass"), "item"))
    lower = docs.select("doc_id", F.lower(text_or_empty("text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item long, start_word long, passage string, by_simhash boolean"
    found = spark.createDataFrame([], schema)
    for (number,) in sorted(weighed.select("pass").distinct().collect()):
        part = weighed.filter(F.col("pass") == number).select("item", "text", "own.w").collect()
        shared = spark.sparkContext.broadcast((build_index([(r[0], r[1]) for r in part], similarity), build_anchors(part, similarity, math.log1p(count))))
        found = found.unionByName(lower.mapInArrow(_bound(shared, complete), schema))
    judged = found.withColumn("there", _shingles(F.col("passage"))).join(weighed.drop("text", "pass"), "item")
    common = F.filter("own", lambda o: F.array_contains("there", o["s"]))
    judged = judged.withColumn("common", common).withColumn(
        "similarity",
        F.aggregate("common", F.lit(0.0), lambda a, o: a + o["w"])
        / (F.col("total") + (F.size("there") - F.size("common")) * F.log1p(F.lit(float(count)))),
    )
    n_words = F.size(F.regexp_extract_all("passage", F.lit(r"[0-9a-zA-Z\x{80}-\x{10FFFF}]+"), F.lit(0)))
    best = judged.filter(F.col("similarity") >= similarity - 1e-9).groupBy("doc_id", "item", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), n_words.alias("n_words"))).alias("best"), F.bool_or("by_simhash").alias("by_simhash")
    )
    return best.select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"), F.col("best.n_words").alias("n_words"), "by_simhash",
    )


def _bound(shared, complete):
    return lambda batches: _passages(shared, batches, complete)


def clean_rows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept; null and empty texts have none, rows without id or of a
    repeated one go if any row of that id has a leak."""
    caught = leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(caught, docs["doc_id"].eqNullSafe(caught["_id"]), "left_anti")
