"""Phrase collocation mining: each language's best phrases by best-first branch and bound over growing prefixes.

A phrase's score is its worst cut, so it never beats ``a / f(first word)``, and since a phrase occurs no more often than
its prefix, a two-word prefix p bounds everything that grows from it: ``score <= f(p) / f(first word of p)`` and
``a <= f(p)``. The frontier is the table of two-word prefixes with their bounds.

1. One pass over the corpus counts words and neighbouring pairs exactly.
2. The frontier is expanded best bound first, each language its own share: one pass over the corpus counts all three-word
   phrases that begin or end with a prefix of the batch. That gives the children of the batch, and what covers it.
3. The score of the last wanted survivor is a lower limit from then on: every prefix whose bound reaches it, ties
   included, is expanded next. Where a language has too few survivors yet, a larger batch of it follows. Once no prefix
   left can reach the limit, the list is settled.

A batch is sent to the tasks as a sorted array of at most ``BATCH`` keys; a larger one takes several passes. Words are
compared by 64-bit hashes and pairs by two of them, the phrases of a batch also by their strings; nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty
from quire.llm.kernel import BASE, U64, mix64, slices, word_hashes, words
from quire.session import written

#: Least occurrences of a phrase, the share (in percent) of them that a longer phrase must hold to replace it, and the
#: phrases wanted of each language.
LEAST, COVER, MOST = 10, 50, 2000
SCALE = 1_000_000
#: Prefixes of a language expanded first, how much larger the next batch is where that was too few, and keys in one pass.
FIRST, GROW, BATCH = 4 * MOST, 8, 1 << 20
#: Bytes of text worked on at once.
SLICE = 1 << 21
UNKNOWN = "und"

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[*b".,;:!?\n\x0b\x0c\r"]] = True
INSIDE = ~SEPARATOR
INSIDE[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _next(data: np.ndarray, at: int, inside: bool) -> int:
    """The first place from ``at`` on whose byte is inside a word, or outside one."""
    while at < len(data):
        hit = np.flatnonzero(INSIDE[data[at : at + 65536]] == inside)
        if len(hit):
            return at + int(hit[0])
        at += 65536
    return len(data)


def _parts(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Slices of texts in lower case with the number of leading bytes they own; a longer text comes in several.

    What begins in the own bytes is counted; behind them stand the two words that a phrase begun there may still take.
    """
    for lo, hi, data, offsets in slices(column, limit):
        if len(data) <= 2 * limit:
            yield lo, hi, LOWER[data], offsets, len(data)
            continue
        at = 0
        while at < len(data):
            own = end = _next(data, at + limit, False)
            for _ in range(2):
                end = _next(data, _next(data, end, True), False)
            yield lo, hi, LOWER[data[at:end]], np.array([0, end - at], dtype=np.int64), own - at
            at = own


def _grams(data: np.ndarray, offsets: np.ndarray, own: int):
    """Word starts, ends, rows and hashes; whether a word and its follower are one piece; and how many words are own."""
    starts, ends, row = words(data, offsets, INSIDE)
    piece = np.cumsum(SEPARATOR[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, dtype=np.int32)
    pair = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return starts, ends, row, word_hashes(data, starts, ends), pair, int(np.searchsorted(starts, own))


def _seeds(langs: list[str]) -> np.ndarray:
    """A hash for each language."""
    column = pa.array(langs, pa.large_string())
    out = np.zeros(len(langs), dtype=np.uint64)
    for lo, hi, data, offsets in slices(column):
        ends = offsets[1:]
        full = np.flatnonzero(ends > offsets[:-1])
        out[lo + full] = word_hashes(data, offsets[:-1][full], ends[full])
    return mix64(out + U64(1))


def pair_keys(seed: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix64((h1 * U64(BASE) + h2) ^ seed)


def _distinct(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each group of equal columns; equal keys of different columns stay apart."""
    if not len(key):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(key), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(key)))


def _languages(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, the code of each row and the seed of each code."""
    coded = column.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary
    return names, coded.indices.to_numpy(zero_copy_only=False), _seeds(names.to_pylist())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(lang, h1, h2, n): pairs; words, with no h2; and all words of a language, with neither."""
    for batch in batches:
        names, codes, seeds = _languages(batch.column(0))
        for lo, hi, data, offsets, own in _parts(batch.column(1), limit):
            _, _, row, h, pair, n = _grams(data, offsets, own)
            lang = codes[lo:hi][row]
            if not n:
                continue
            first = np.flatnonzero(pair[:n])
            one, times = _distinct(mix64(h[:n] ^ seeds[lang[:n]]), h[:n], lang[:n])
            two, both = _distinct(pair_keys(seeds[lang[first]], h[first], h[first + 1]), h[first], h[first + 1], lang[first])
            two = first[two]
            every = np.bincount(lang[:n], minlength=len(names))
            used = np.flatnonzero(every)
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(np.concatenate([lang[one], lang[two], used]))),
                    pa.concat_arrays([_signed(h[one]), _signed(h[two]), none(len(used))]),
                    pa.concat_arrays([none(len(one)), _signed(h[two + 1]), none(len(used))]),
                    pa.array(np.concatenate([times, both, every[used]])),
                ],
                names=["lang", "h1", "h2", "n"],
            )


def _grow(batches: Iterator[pa.RecordBatch], shared, limit: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, h1, h2, h3, n): the pairs of the batch, and the three-word phrases that begin or end with one."""
    keys = shared.value
    bits = np.zeros(1 << 24, dtype=bool)
    bits[(keys >> U64(40)).astype(np.int64)] = True
    for batch in batches:
        names, codes, seeds = _languages(batch.column(0))
        for lo, hi, data, offsets, own in _parts(batch.column(1), limit):
            starts, ends, row, h, pair, n = _grams(data, offsets, own)
            if not n or not len(pair):
                continue
            lang = codes[lo:hi][row]
            key = pair_keys(seeds[lang[:-1]], h[:-1], h[1:])
            chosen = pair & bits[(key >> U64(40)).astype(np.int64)]
            at = np.flatnonzero(chosen)
            chosen[at] = keys[np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)] == key[at]
            two = np.flatnonzero(chosen[:n])
            three = np.flatnonzero(((chosen[:-1] | chosen[1:]) & pair[:-1] & pair[1:])[:n])
            text = data.tobytes()
            for size, at in ((2, two), (3, three)):
                if not len(at):
                    continue
                hashes = [h[at + k] for k in range(size)]
                mixed = mix64(key[at] + hashes[-1])
                group, times = _distinct(mixed, *hashes, lang[at])
                phrases = [b" ".join(text[starts[i + k] : ends[i + k]] for k in range(size)) for i in at[group].tolist()]
                columns = [_signed(x[group]) for x in hashes] + [pa.nulls(len(group), pa.int64())] * (3 - size)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang[at][group])), pa.array(phrases, pa.binary()).cast(pa.string()), *columns, pa.array(times)],
                    names=["lang", "phrase", "h1", "h2", "h3", "n"],
                )


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (l * r)), in whole numbers of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(38,0))"
    return F.expr(f"cast(({wide(a)} * {wide(a)} * {SCALE}) div ({wide(left)} * {wide(right)}) as bigint)")


def _cut(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The level down to which each language of ``wanted`` (lang, size) is expanded: its first ``size`` prefixes, or all.

    Levels are thousands of the bound and powers of two of the count, so a language has at most 64,064 of them.
    """
    counted = pairs.groupBy("lang", "level").count().join(wanted, "lang")
    down = Window.partitionBy("lang").orderBy(F.desc("level"))
    reached = counted.withColumn("upto", F.sum("count").over(down))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("size"), F.col("level"))), F.min("level")).alias("cut"))


def _batch_keys(batch: DataFrame) -> np.ndarray:
    """Keys of a batch of bounded size."""
    rows = batch.select("lang", "h1", "h2").toArrow()
    names, codes, seeds = _languages(rows.column("lang"))
    h1, h2 = (rows.column(c).combine_chunks().to_numpy().view(np.uint64) for c in ("h1", "h2"))
    return np.unique(pair_keys(seeds[codes], h1, h2))


def collocations(
    docs: DataFrame, most: int = MOST, least: int = LEAST, cover: int = COVER, first: int = FIRST, batch_size: int = BATCH, limit: int = SLICE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of two or three words.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends and into words at spaces and tabs; a
    phrase lies in one piece. ``a`` counts its occurrences, overlapping ones too, and must reach ``least``; ``l`` and ``r`` are the counts
    of the two parts of its lowest-scoring cut (ties: the earliest) and ``n`` all words of the language. A phrase inside
    a longer one of at least ``least`` that has ``cover`` percent of its occurrences is left out. Order: score, a (both
    falling), phrase by bytes. Null texts are empty, a null language is ``und``, repeated rows count again, long texts
    are read in pieces, and an empty table gives an empty result. Only lang and text are read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), text_or_empty("text").alias("text"))
    grams = texts.mapInArrow(lambda b: _count(b, limit), "lang string, h1 long, h2 long, n long").groupBy("lang", "h1", "h2").agg(F.sum("n").alias("n"))
    grams = written(grams.filter((F.col("n") >= least) | F.col("h1").isNull()), "grams")
    totals = grams.filter("h1 is null").select("lang", "n")
    single = grams.filter("h1 is not null and h2 is null").select("lang", "h1", "n")
    left, right = single.withColumnRenamed("n", "l"), single.select("lang", F.col("h1").alias("h2"), F.col("n").alias("r"))
    pairs = grams.filter("h2 is not null").withColumnRenamed("n", "a").join(left, ["lang", "h1"]).join(right, ["lang", "h2"])
    pairs = pairs.select("lang", "h1", "h2", "a", "l", "r", _score("a", "l", "r").alias("score"), F.expr(f"cast((cast(a as decimal(38,0)) * {SCALE}) div l as bigint)").alias("bound"))
    pairs = written(pairs.withColumn("level", F.expr("cast(bound div 1000 as int) * 64") + F.floor(F.log2("a")).cast("int")), "pairs")

    size, known, settled = first, [], None
    # Per language: expanded are the prefixes from a level up, and those that reach a survivor's (score, a).
    limits = written(_cut(pairs, totals.select("lang", F.lit(size).alias("size"))).select("lang", "cut", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("sa")), "limits")
    done = limits.select("lang", *(F.lit(None).cast(t).alias(c) for c, t in (("done_cut", "int"), ("done_s", "long"), ("done_sa", "long"))))
    reaches = "coalesce(level >= {0}cut, false) or coalesce(bound > {0}s or (bound = {0}s and a >= {0}sa), false)"
    while True:
        wanted = pairs.join(limits, "lang").join(done, "lang").filter(f"({reaches.format('')}) and not ({reaches.format('done_')})")
        batch = written(wanted.select("lang", "h1", "h2", F.expr("pmod(xxhash64(h1, h2), 1000003)").alias("deal")), "batch")
        n = batch.count()
        if not n:
            return settled if settled is not None else _ranked(totals, pairs, None, most, cover)
        parts = -(-n // batch_size)
        for part in range(parts):
            keys = _batch_keys(batch.filter(F.col("deal") % parts == part))
            if not len(keys):
                continue
            shared = spark.sparkContext.broadcast(keys)
            grown = texts.mapInArrow(lambda b, shared=shared: _grow(b, shared, limit), "lang string, phrase string, h1 long, h2 long, h3 long, n long")
            grown = grown.groupBy("lang", "phrase", "h1", "h2", "h3").agg(F.sum("n").alias("a"))
            known.append(written(grown.filter(F.col("a") >= least), "grown"))
        found = known[0]
        for more in known[1:]:
            found = found.unionByName(more)
        settled = written(_ranked(totals, pairs, found.distinct(), most, cover), "settled")
        last = settled.filter(F.col("rank") == most).select("lang", F.col("score").alias("s"), F.col("a").alias("sa"))
        size *= GROW
        too_few = limits.select("lang").join(last, "lang", "left_anti").select("lang", F.lit(size).alias("size"))
        done = limits.select("lang", *(F.col(c).alias(f"done_{c}") for c in ("cut", "s", "sa")))
        cut = _cut(pairs, too_few).join(limits.select("lang", F.col("cut").alias("old")), "lang").select("lang", F.least("cut", "old").alias("cut"))
        limits = limits.select("lang", F.col("cut").alias("old")).join(last, "lang", "left").join(cut, "lang", "left")
        limits = written(limits.select("lang", F.coalesce("cut", "old").alias("cut"), "s", "sa"), "limits")


def _ranked(totals: DataFrame, pairs: DataFrame, found: DataFrame | None, most: int, cover: int) -> DataFrame:
    """The survivors among the phrases found, each language's first ``most``."""
    if found is None:
        found = pairs.limit(0).select("lang", F.lit("").alias("phrase"), "h1", "h2", F.lit(0).cast("long").alias("h3"), "a")
    three = found.filter("h3 is not null")
    head = pairs.select("lang", "h1", "h2", F.col("a").alias("a12"), F.col("l").alias("f1"))
    tail = pairs.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("a23"), F.col("r").alias("f3"))
    three = three.join(head, ["lang", "h1", "h2"]).join(tail, ["lang", "h2", "h3"])
    three = three.withColumn("s1", _score("a", "f1", "a23")).withColumn("s2", _score("a", "a12", "f3"))
    early = F.col("s1") <= F.col("s2")
    longer = three.select(
        "lang", "phrase", "a", F.when(early, F.col("f1")).otherwise(F.col("a12")).alias("l"), F.when(early, F.col("a23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    held = three.select("lang", "a", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"))
    held = held.groupBy("lang", "p.h1", "p.h2").agg(F.max("a").alias("most_held"))
    two = found.filter("h3 is null").select("lang", "phrase", "h1", "h2").join(pairs, ["lang", "h1", "h2"]).join(held, ["lang", "h1", "h2"], "left")
    two = two.filter(F.coalesce(F.col("most_held") * 100 < F.col("a") * cover, F.lit(True))).select("lang", "phrase", "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = longer.unionByName(two).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
