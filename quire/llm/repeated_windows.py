"""Substring de-duplication: every word covered by a 35-word window that also starts elsewhere goes.

A window is represented by the smallest hash among its 8-word grams (its anchor), which equal windows share. Two passes:

1. Count-min prefilter. Every partition counts, in a sketch of fixed width, the places of the grams that are some window's
   anchor; summing the cells merges the partitions' sketches. A cell never counts too little, so a window whose anchor
   falls in a cell of one is alone in the corpus and is set aside. Only the cells of two or more go on, as bitmaps of a
   fixed size.
2. Exact grouping of the windows estimated repeated. Neighbouring windows of one anchor are a run; equal runs (anchor and
   content) are repeated as a whole. Only where an anchor has runs of different content, or one that repeats itself, are
   the windows grouped one by one, each distinct run sending its windows once.

Windows, runs and anchors are compared by 64-bit hashes within groups that already agree on another 64-bit hash of
different content (the anchor). Hot passages cost no more than others: counts are combined before they are shuffled, and a
run's copies meet only as a count. A task holds a slice of text, the bitmaps and the covered places of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty
from quire.llm.kernel import NOT_SPACE, U64, extreme, mix64, powers, rolling, slices, spread, word_hashes, words
from quire.session import cut_lineage, written

#: Words in a window and in the grams that anchor it.
WINDOW, GRAM = 35, 8
#: Cells of a sketch row (a power of two) and rows. The bitmaps sent to the tasks take WIDTH * DEPTH / 8 bytes.
WIDTH, DEPTH = 1 << 27, 2
#: Bits of one bitmap that Spark's bitmap functions build.
PAGE = 32768

SALTS = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)


def cells(anchor: np.ndarray, width: int, depth: int) -> list[np.ndarray]:
    """The cell of each sketch row, rows one after another."""
    shift = U64(64 - (width.bit_length() - 1))
    return [(mix64(anchor ^ U64(SALTS[d])) >> shift).astype(np.int64) + d * width for d in range(depth)]


def _windows(data, offsets, window, gram):
    """Row of every word, and of each window that lies in one row: its first word, hash and anchor."""
    starts, ends, row = words(data, offsets, NOT_SPACE)
    h = word_hashes(data, starts, ends)
    grams = rolling(h, gram)
    anchor = extreme(grams, window - gram + 1)
    inside = row[: len(anchor)] == row[window - 1 : window - 1 + len(anchor)]
    return row, h, grams, anchor, inside


def _sketch(batches: Iterator[pa.RecordBatch], window: int, gram: int, width: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            _, _, grams, anchor, inside = _windows(data, offsets, window, gram)
            if not inside.any():
                continue
            span = window - gram
            edge = np.zeros(span, dtype=np.uint64)
            largest = extreme(np.concatenate([edge, np.where(inside, anchor, U64(0)), edge]), span + 1, np.maximum)
            chosen = grams[grams == largest[: len(grams)]]
            cell, n = np.unique(np.concatenate(cells(chosen, width, depth)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])


def repeated_cells(texts: DataFrame, window: int, gram: int, width: int, depth: int) -> bytes:
    """The merged sketch as one bitmap: a bit per cell counted twice or more (its size is fixed by width and depth)."""
    sketches = texts.mapInArrow(lambda b: _sketch(b, window, gram, width, depth), "cell long, n long")
    merged = sketches.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    pages = merged.groupBy(F.expr(f"cell div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("cell") % PAGE).alias("bits"))
    out = bytearray(max(1, -(-width * depth // PAGE)) * PAGE // 8)
    for page, bits in pages.toLocalIterator():
        out[page * PAGE // 8 : page * PAGE // 8 + len(bits)] = bits
    return bytes(out)


RUN = pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("again", pa.bool_()), ("hashes", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch], shared, window: int, gram: int, width: int, depth: int) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(shared.value, dtype=np.uint8)
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            row, h, _, anchor, inside = _windows(data, offsets, window, gram)
            n = np.bincount(row, minlength=hi - lo)
            at = np.flatnonzero(inside)
            for d in range(depth):
                cell = cells(anchor[at], width, depth)[d]
                at = at[(bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
            value = rolling(h, window)[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]) | (anchor[at[1:]] != anchor[at[:-1]])
            begin = np.flatnonzero(new)
            lens = np.diff(np.append(begin, len(at)))
            first = np.cumsum(n) - n
            docs, again, content = row[at[begin]], np.zeros(len(begin), dtype=bool), np.zeros(len(begin), dtype=np.uint64)
            if len(begin):
                _, place, _ = spread(begin, lens)
                content = mix64(np.add.reduceat(value * powers(int(lens.max()))[place], begin) + lens.astype(np.uint64))
                of = np.repeat(np.arange(len(begin)), lens)
                order = np.lexsort((value, of))
                twice = (of[order][1:] == of[order][:-1]) & (value[order][1:] == value[order][:-1])
                again[of[order][1:][twice]] = True
            hashes = pa.Array.from_buffers(
                pa.binary(), len(begin), [None, pa.py_buffer((8 * np.append(begin, len(at))).astype(np.int32).tobytes()), pa.py_buffer(value.astype(">u8").tobytes())]
            )
            runs = pa.StructArray.from_arrays(
                [
                    pa.array(anchor[at[begin]].view(np.int64)), pa.array(content.view(np.int64)), pa.array((at[begin] - first[docs]).astype(np.int32)),
                    pa.array(lens.astype(np.int32)), pa.array(again), hashes,
                ],
                fields=list(RUN),
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=hi - lo))]).astype(np.int32)
            text = data.tobytes()
            whole = [hashlib.sha256(b" ".join(text[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            part = batch.slice(lo, hi - lo)
            marked = pa.array(np.diff(ends) > 0)
            empty = pa.nulls(hi - lo, pa.string())
            kept = pa.compute.if_else(marked, part.column(2).cast(pa.string()), empty)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), kept, pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(ends), runs)],
                names=["rid", "doc_id", "text", "n_words", "sha", "runs"],
            )


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, n_words, sha, text, spans = (batch.column(i) for i in range(5))
        removed, digest, kept_text = [], [], []
        for i in range(batch.num_rows):
            if not spans[i].is_valid:
                removed.append(0)
                digest.append(sha[i].as_py())
                kept_text.append(None)
                continue
            gone = np.zeros(n_words[i].as_py() + 1, dtype=np.int64)
            pieces = spans[i].values
            starts, lens = (pieces.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + lens + window - 1, -1)
            keep = np.cumsum(gone)[:-1] == 0
            left = b" ".join(w for w, k in zip(text[i].as_buffer().to_pybytes().split(), keep.tolist()) if k)
            removed.append(int(len(keep) - keep.sum()))
            digest.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left.decode())
        yield pa.RecordBatch.from_arrays(
            [doc, n_words, pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row per row of ``docs``.

    Words are runs of anything but ASCII white space, taken unchanged; the kept words are joined by one space.
    ``kept_text`` is null where no window was estimated repeated, the words then all staying. Null and empty texts have
    no words, texts under a window lose none, repeated rows count as different places, ids may be null or repeat, and an
    empty table gives an empty result. A text is worked on whole, in about 34 bytes for each of its own. Only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    texts = docs.select(text_or_empty("text").alias("text"))
    shared = spark.sparkContext.broadcast(repeated_cells(texts, window, gram, width, depth))
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "array<struct<anchor:long,content:long,start:int,len:int,again:boolean,hashes:binary>>"
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_or_empty("text").alias("text"))
    rows = rows.mapInArrow(lambda b: _runs(b, shared, window, gram, width, depth), f"rid long, doc_id {kind}, text string, n_words long, sha string, runs {run}")
    rows = written(rows, "runs")
    runs = rows.select("rid", F.explode("runs").alias("run")).select("rid", "run.*")
    same = runs.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("at"), F.max("again").alias("again"), F.first("hashes").alias("hashes")
    )
    same = written(same, "same")
    mixed = same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("again").alias("again")).filter("kinds > 1 or again").select("anchor")
    mixed = cut_lineage(mixed)  # a table of its own, so that the join on a hot anchor can be split
    single = same.join(mixed, "anchor").select(
        "anchor", "n", "at", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("length(hashes) div 8 - 1")), lambda i: F.substring("hashes", i * 8 + 1, 8))).alias("place", "hash")
    )
    single = written(single, "single")  # else the grouping below would keep a hot anchor's join in one task
    again = single.groupBy("anchor", "hash").agg(F.sum(F.least("n", F.lit(2))).alias("times")).filter("times > 1").select("anchor", "hash")
    found = single.filter("n = 1").join(again, ["anchor", "hash"]).select("at.rid", (F.col("at.start") + F.col("place")).alias("start"), F.lit(1).alias("len"))
    many = same.filter("n > 1").select("anchor", "content")
    whole = runs.select("rid", "anchor", "content", "start", "len").join(many, ["anchor", "content"]).select("rid", "start", "len")
    spans = whole.unionByName(found).groupBy("rid").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    cut = rows.select("rid", "doc_id", "n_words", "sha", "text").join(spans, "rid", "left").select("doc_id", "n_words", "sha", "text", "spans")
    return cut.mapInArrow(lambda b: _cut(b, window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
