"""A search index that follows edits, and a search that reads only what can matter (I-01, I-02, R-02).

Every batch of changed documents becomes a folder of its own: postings in blocks, the documents with the terms they hold,
the documents that had an earlier version, and what the batch changed in the counts of documents, words and documents per
term. Counts add up over folders, so a search knows the corpus without reading it. Where several folders of one size have
gathered, they are folded into one, so their number grows with the logarithm of the batches. A folder counts once its
mark is written; of folders that overlap the widest counts.

A block holds up to ``BLOCK`` documents of one term in the order of their ids, with the first and last id, the highest
frequency and the shortest length in it, which bound the score of any of them. What it says of its documents is packed as
plain numbers, a hit for each field of a document, so that blocks are made and folded many at once and Spark moves them
whole; ``_hits`` unpacks them. A search of single words looks at these
bounds first, scores the most promising blocks of its rarest word, and then reads only blocks that can still reach the
twentieth score, and of the other words only blocks around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import search as se
from quire.operators.membership import sifted
from quire.session import cut_lineage, remove_folder, written

#: Documents in a block, folders of one size that are folded together, ranges of ids handed to a scan, and changed
#: documents up to which their ids are handed to it.
BLOCK, FAN, RANGES, IDS = 128, 4, 64, 1000
#: Ids or blocks whose places the driver looks at to choose the ranges, and replaced ids up to which they are handed to a fold.
HANDED, SENT = 10_000, 1 << 22
MARK = "_DONE"

#: Fields by the number a hit names them with, and how many tokens weigh as one row where ranges of ids are chosen.
NAMES, WEIGHT = sorted(se.FIELDS), 4096
#: Tokens whose pieces are made at once, unless one document holds more, and packed bytes that are unpacked at once.
PIECE_TOKENS, OPEN_BYTES = 1 << 20, 1 << 24
#: A hit for each field of a document: the step from the id before (the first one's is in ``first_doc``), its batch, the
#: length of the document, how often and in which field (``_coded``), and the places.
PACKED = "ids binary, batches binary, infos binary, places binary"
PIECES = f"slice int, term string, first_doc long, last_doc long, {PACKED}"
HITS = "term string, doc_id long, batch long, length long, field string, tf long, positions array<int>, head boolean"
SCHEMAS = {
    "postings": f"term string, first_doc long, last_doc long, n long, max_tf long, min_length long, {PACKED}, bucket int",
    "docs": "doc_id long, batch long, length long, terms array<string>",
    "replaced": "doc_id long, batch long",
    "terms": "term string, df long, bucket int",
    "totals": "docs long, words long",
}


class LiveIndex:
    """Folders ``seg-<first batch>-<last batch>`` of an index in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsparkSession.sparkContext().hadoopConfiguration())

    def segments(self, before: int | None = None) -> list[tuple[int, int]]:
        """(first, last) batch of the folders that count, in order; ``before`` leaves out later batches."""
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("seg-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARK)):
                lo, hi = map(int, name.split("-")[1:])
                if before is None or hi < before:
                    found.append((lo, hi))
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(found, key=lambda s: (s[0], -s[1])):
            if not out or lo > out[-1][1]:
                out.append((lo, hi))
        return out

    def _path(self, segment: tuple[int, int], name: str = "") -> str:
        return f"{self.folder}/seg-{segment[0]}-{segment[1]}/{name}".rstrip("/")

    def read(self, name: str, segments: list[tuple[int, int]] | None = None) -> DataFrame:
        """The rows of a table of all folders (or of ``segments``)."""
        segments = self.segments() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[name])
        parts = [self.spark.read.schema(SCHEMAS[name]).parquet(self._path(s, name)) for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def _finish(self, segment: tuple[int, int]) -> None:
        _, fs = self._fs()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(segment, MARK)), True).close()

    def apply(self, batch: int, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """A batch of new and changed documents (doc_id, slug, title, body) and of ids no longer there; replays change nothing."""
        segment = (batch, batch)
        if any(lo <= batch <= hi for lo, hi in self.segments()):
            return
        earlier = self.segments(before=batch)
        # Words are written once, in the order of ids: what a document holds is read off its row, and postings move packed.
        laid = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        read = written(se.tokenised(laid), "tokens")
        none = F.array().cast("array<string>")
        own = F.array_distinct(F.concat(*[F.coalesce(f, none) for f in se.FIELDS]))
        length = sum((F.coalesce(F.array_size(f), F.lit(0)) for f in se.FIELDS), F.lit(0)).cast("long")
        held = read.select("doc_id", F.lit(batch).cast("long").alias("batch"), length.alias("length"), F.when(F.col("doc_id").isNotNull(), own).otherwise(none).alias("terms"))
        if removed is not None:
            gone = removed.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")
            gone = gone.select("doc_id", F.lit(batch).cast("long").alias("batch"), F.lit(None).cast("long").alias("length"), F.array().cast("array<string>").alias("terms"))
            held = held.unionByName(gone.repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
        self._write(segment, "docs", held)
        held = self.read("docs", [segment])
        old = written(self._versions(held.select("doc_id"), earlier), "versions")
        slices = se.write_tasks(docs)
        cuts = _cuts(held.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / WEIGHT)))), "doc_id", slices)
        self._write(segment, "postings", _packed(read.mapInArrow(_token_pieces(cuts), PIECES), slices, batch), "bucket")
        self._write(segment, "replaced", old.select("doc_id", F.lit(batch).cast("long").alias("batch")).repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
        signed = lambda d, n: d.select(F.explode("terms").alias("term"), F.lit(n).alias("df"))
        counted = signed(held, 1).unionByName(signed(old, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
        self._write(segment, "terms", _by_term(counted), "bucket")
        live = lambda d, n: d.where("length is not null").select(F.lit(n).alias("docs"), (F.col("length") * n).alias("words"))
        total = live(held, 1).unionByName(live(old, -1)).agg(F.coalesce(F.sum("docs"), F.lit(0)).cast("long").alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"))
        self._write(segment, "totals", total)
        self._finish(segment)

    def _write(self, segment: tuple[int, int], name: str, rows: DataFrame, by: str | None = None) -> None:
        # Small row groups let a scan skip by term and by id.
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("parquet.block.size", 1 << 22).option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(self._path(segment, name))

    def _versions(self, ids: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
        """doc_id, length and terms of the newest version of each of ``ids``; few ids are handed to the scan."""
        if not segments:
            return self.spark.createDataFrame([], "doc_id long, length long, terms array<string>")
        docs = self.read("docs", segments)
        few = [r["doc_id"] for r in ids.limit(IDS + 1).collect()]
        docs = docs.where(F.col("doc_id").isin(few)) if len(few) <= IDS else sifted(docs, "doc_id", ids, "doc_id")[0].join(ids, "doc_id", "left_semi")
        return docs.groupBy("doc_id").agg(F.max_by(F.struct("length", "terms"), "batch").alias("v")).select("doc_id", "v.*")

    def fold(self, fan: int = FAN) -> list[tuple[int, int]]:
        """Folds neighbouring folders of one size, ``fan`` or more, into one until none is left to fold; what was folded.

        The size of a folder is the power of ``fan`` of its batches. The folders folded stay for searches under way;
        ``clean`` removes them.
        """
        done = []
        while True:
            segments = self.segments()
            tiers = [int(math.log(hi - lo + 1, fan) + 1e-9) for lo, hi in segments]
            runs = [i for i in range(len(segments) - fan + 1) if len(set(tiers[i : i + fan])) == 1]
            if not runs:
                return done
            group = segments[runs[0] : runs[0] + fan]
            done.append(self._merge(group))

    def _merge(self, group: list[tuple[int, int]]) -> tuple[int, int]:
        segment = (group[0][0], group[-1][1])
        replaced = self.read("replaced", group).groupBy("doc_id").agg(F.max("batch").alias("upto"))
        replaced = cut_lineage(replaced)
        postings = self.read("postings", group)
        size = postings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        slices = max(1, -(-size // (se.BUCKETS << 20)))
        cuts = _cuts(postings, "first_doc", slices)
        few = replaced.count() <= SENT
        if few:
            # Blocks move whole and lose what was replaced where they are put together.
            ids, upto = (np.asarray(c, dtype=np.int64) for c in replaced.where("doc_id is not null").orderBy("doc_id").toArrow().itercolumns())
            part = F.when(F.col("first_doc").isNull(), -1).otherwise(sum(((F.col("first_doc") > c).cast("int") for c in cuts), F.lit(0)))
            out = _packed(postings.withColumn("slice", part), slices, None, (ids, upto))
        else:
            flat = hits(postings).join(replaced.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").where("upto is null or batch >= upto")
            out = _packed(_pieces(flat, cuts), slices)
        self._write(segment, "postings", out, "bucket")
        newer = replaced.withColumnRenamed("doc_id", "__id")
        newest = self.read("docs", group).join(F.broadcast(newer) if few else newer, F.col("doc_id") == F.col("__id"), "left").where("upto is null or batch >= upto")
        self._write(segment, "docs", newest.select("doc_id", "batch", "length", "terms").sortWithinPartitions("doc_id"))
        self._write(segment, "replaced", replaced.select("doc_id", F.col("upto").alias("batch")).repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
        self._write(segment, "terms", _by_term(self.read("terms", group).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")), "bucket")
        self._write(segment, "totals", self.read("totals", group).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")))
        self._finish(segment)
        return segment

    def clean(self) -> None:
        """Removes folders that a wider one covers, and those without a mark that hold batches already covered."""
        keep = {self._path(s) for s in self.segments()}
        path, fs = self._fs()
        for status in fs.listStatus(path):
            if status.getPath().getName().startswith("seg-") and f"{self.folder}/{status.getPath().getName()}" not in keep:
                remove_folder(self.spark, status.getPath().toString())

    # ------------------------------------------------------------ search

    def search(self, query: str, limit: int = 20, report: dict | None = None) -> DataFrame:
        """doc_id, score: the best documents holding every phrase, by BM25 over all fields, as over a fresh index (I-02).

        ``report`` receives the blocks of the query's words and those read. A phrase of several words has to be counted
        in all documents for its weight, so the blocks of its words are read around those of its rarest one.
        """
        phrases = se.query_phrases(self.spark, query)
        segments = self.segments()
        none = self.spark.createDataFrame([], "doc_id long, score double")
        wanted = sorted({t for p in phrases for t in p})
        if not phrases or not segments:
            return none
        buckets = [r["b"] for r in self.spark.range(1).select(F.explode(F.transform(F.array(*map(F.lit, wanted)), se.bucket_of)).alias("b")).collect()]
        mine = lambda name: self.read(name, segments).where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
        n, words = self.read("totals", segments).agg(F.sum("docs"), F.sum("words")).first()
        df = {r["term"]: r["df"] for r in mine("terms").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        if not n or any(df.get(t, 0) <= 0 for t in wanted):
            return none
        postings = mine("postings")
        replaced = self.read("replaced", segments).groupBy("doc_id").agg(F.max("batch").alias("upto"))
        view = _View(postings, replaced, phrases, df, n, words / n, report)
        return (view.best if all(len(p) == 1 for p in phrases) else view.all)(limit)


class _View:
    """What one search knows: the blocks of its words, the counts of the corpus, and what it read."""

    def __init__(self, postings, replaced, phrases, df, n, average, report):
        self.postings, self.replaced, self.phrases, self.df, self.n, self.average = postings, replaced, phrases, df, n, average
        self.report = report
        self.heads = postings.select("term", "first_doc", "last_doc", "n", "max_tf", "min_length")

    def idf(self, found: int) -> float:
        return max(math.log((self.n - found + 0.5) / (found + 0.5)), 1e-6)

    def part(self, idf: float | Column, tf: Column, length: Column) -> Column:
        return idf * tf * (se.K1 + 1) / (tf + se.K1 * (1 - se.B + se.B * length / self.average))

    def entries(self, blocks: DataFrame) -> DataFrame:
        """Hits of blocks that no later version replaces."""
        return hits(blocks).drop("head").join(self.replaced, "doc_id", "left").where("upto is null or batch >= upto").drop("upto")

    def near(self, ranges: list[tuple[int, int]]) -> Column:
        """Blocks that meet one of at most ``RANGES`` ranges of ids; the closest of more are joined."""
        merged: list[list[int]] = []
        for lo, hi in sorted(ranges):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        if len(merged) > RANGES:
            gaps = sorted(range(1, len(merged)), key=lambda i: merged[i - 1][1] - merged[i][0])
            cuts = sorted(gaps[: RANGES - 1])
            merged = [[merged[a][0], merged[b - 1][1]] for a, b in zip([0, *cuts], [*cuts, len(merged)])]
        out = F.lit(False)
        for lo, hi in merged:
            out = out | ((F.col("first_doc") <= hi) & (F.col("last_doc") >= lo))
        return out

    def count(self, where: Column, what: str) -> None:
        if self.report is not None:
            self.report[what] = self.report.get(what, 0) + self.heads.where(where).count()

    def scored(self, rows: DataFrame, weights: dict[int, float]) -> DataFrame:
        """doc_id, score of documents that hold every phrase, from entries of the query's words."""
        counts = se.phrase_counts(rows.select("term", "doc_id", "field", "positions"), self.phrases)
        lengths = rows.select("doc_id", "length").distinct()
        both = counts.where(" AND ".join(f"f{i} > 0" for i in weights)).join(lengths, "doc_id")
        return both.select("doc_id", sum((self.part(w, F.col(f"f{i}"), F.col("length")) for i, w in weights.items()), F.lit(0.0)).alias("score"))

    def spans(self, where: Column) -> Column:
        """Blocks around the documents of those of ``where``, or around these blocks if that is too much to hand over."""
        ids = [r[0] for r in hits(self.postings.where(where)).where("head").select("doc_id").limit(HANDED + 1).collect()]
        if len(ids) <= HANDED:
            return self.near([(d, d) for d in ids])
        found = [tuple(r) for r in self.heads.where(where).select("first_doc", "last_doc").limit(HANDED + 1).collect()]
        return self.near(found) if len(found) <= HANDED else F.lit(True)

    def all(self, limit: int) -> DataFrame:
        """Phrases: all blocks of a phrase's rarest word, those of its other words around them, and of single words around both."""
        self.count(F.lit(True), "blocks")
        several = [p for p in self.phrases if len(p) > 1]
        drivers = {min(p, key=lambda t: (self.df[t], t)): p for p in several}
        where = F.lit(False)
        for driver, phrase in drivers.items():
            where = where | (F.col("term") == driver) | (F.col("term").isin(phrase) & self.spans(F.col("term") == driver))
        rarest = min(drivers, key=lambda t: (self.df[t], t))
        single = [p[0] for p in self.phrases if len(p) == 1]
        where = where | (F.col("term").isin(single) & self.spans(F.col("term") == rarest))
        self.count(where, "read")
        rows = cut_lineage(self.entries(self.postings.where(where)))
        counts = se.phrase_counts(rows.select("term", "doc_id", "field", "positions"), self.phrases)
        # Single words take their counts from the index, since only blocks around the phrases are read of them.
        found = counts.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"f{i}") for i in range(len(self.phrases))]).first()
        weights = {i: self.idf(self.df[p[0]] if len(p) == 1 else found[f"f{i}"]) for i, p in enumerate(self.phrases)}
        return self.scored(rows, weights).orderBy(F.desc("score"), "doc_id").limit(limit)

    def best(self, limit: int) -> DataFrame:
        """Single words: blocks of the rarest by their bound, the most promising first, then all that can still reach."""
        weights = {i: self.idf(self.df[p[0]]) for i, p in enumerate(self.phrases)}
        of_term = {t: sum(w for i, w in weights.items() if self.phrases[i][0] == t) for t in self.df}
        driver = min(of_term, key=lambda t: (self.df[t], t))
        most = self.heads.where(F.col("term") != driver).groupBy("term").agg(F.max(self.part(1.0, F.col("max_tf"), F.col("min_length"))).alias("m")).collect()
        others = sum(of_term[r["term"]] * r["m"] for r in most)
        # A little slack, since bounds and scores add their parts in different orders.
        bound = (self.part(of_term[driver], F.col("max_tf"), F.col("min_length")) + others) * (1 + 1e-9)
        mine = F.col("term") == driver
        ranked = self.heads.where(mine).select("first_doc", "last_doc", "n", bound.alias("bound")).orderBy(F.desc("bound"), "first_doc").limit(8 * limit).collect()
        first, seen = [], 0
        for r in ranked:
            first.append(r)
            seen += r["n"]
            if seen >= 8 * limit:
                break
        enough = first[-1]["bound"] if first else 0.0
        self.count(F.lit(True), "blocks")
        # Of blocks that tie with the last one only those chosen; the others are looked at again below.
        tied = [r["first_doc"] for r in first if r["bound"] == enough]
        at_first = mine & ((bound > enough) | ((bound == enough) & F.col("first_doc").isin(tied)))
        where = at_first | (~mine & self.spans(at_first))
        self.count(where, "read")
        top = cut_lineage(self.scored(self.entries(self.postings.where(where)), weights).orderBy(F.desc("score"), "doc_id").limit(limit))
        scores = [r["score"] for r in top.collect()]
        reach = min(scores) if len(scores) == limit else -1.0
        rest = mine & ~at_first & (bound >= reach)
        if self.heads.where(rest).isEmpty():
            return top.orderBy(F.desc("score"), "doc_id")
        where = rest | (~mine & self.spans(rest))
        self.count(where, "read")
        more = self.scored(self.entries(self.postings.where(where)), weights)
        return top.unionByName(more).orderBy(F.desc("score"), "doc_id").limit(limit)


def _by_term(rows: DataFrame) -> DataFrame:
    with_bucket = rows.withColumn("bucket", se.bucket_of(F.col("term")))
    return with_bucket.repartition(se.BUCKETS, "bucket").sortWithinPartitions("bucket", "term").select("term", "df", "bucket")


def blocks(rows: DataFrame, batch: int, slices: int, places: DataFrame | None = None) -> DataFrame:
    """Posting blocks of index rows (term, doc_id, field, tf, positions, length); ``places`` are their ids, if at hand."""
    rows = rows.where("term != ''").withColumn("batch", F.lit(batch).cast("long"))
    return _packed(_pieces(rows, _cuts(rows if places is None else places, "doc_id", slices)), slices)


def _cuts(rows: DataFrame, ids: str, slices: int) -> list[int]:
    """Ids that cut ``rows`` into ``slices`` ranges."""
    found = rows.agg(F.percentile_approx(ids, [k / slices for k in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    return sorted(set(found or []))


def _pieces(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Rows of hits as pieces: what an Arrow batch holds of a term."""
    return rows.select("term", "doc_id", "batch", "length", "field", "positions").mapInArrow(_row_pieces(cuts), PIECES)


def _packed(pieces: DataFrame, slices: int, batch: int | None = None, dead: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Blocks from pieces (or from blocks with their slice): each bucket is dealt to ``slices`` tasks, the one shuffle of postings.

    ``batch`` is that of pieces that do not name theirs; ``dead`` has ids that were replaced, in order, and since which batch.
    """
    rows = pieces.withColumn("bucket", se.bucket_of(F.col("term"))).repartition(se.BUCKETS * slices, "bucket", "slice")
    rows = rows.sortWithinPartitions("bucket", "slice", "term", "first_doc", "last_doc")
    columns = ("bucket", "slice", "term", "first_doc", "ids", "batches", "infos", "places")
    return rows.select(*columns).mapInArrow(_blocked(BLOCK, batch, dead), SCHEMAS["postings"]).sortWithinPartitions("bucket", "term", "first_doc")


def hits(blocks: DataFrame) -> DataFrame:
    """term, doc_id, batch, length, field, tf, positions of blocks; ``head`` marks the first hit of a document."""
    return blocks.select("term", "first_doc", "ids", "batches", "infos", "places").mapInArrow(_hits, HITS)


# ---------------------------------------------------------------- packed hits


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values, and how many each value holds."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return np.frombuffer(flat.tobytes(), dtype=kind), np.diff(ends) // np.dtype(kind).itemsize


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, cut where ``OPEN_BYTES`` are reached."""
    for batch in batches:
        sizes = sum(pc.binary_length(batch.column(batch.schema.get_field_index(c))).to_numpy().astype(np.int64) for c in ("ids", "places"))
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // OPEN_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers as binary values that end where ``bounds`` says."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _steps(doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.diff(doc, prepend=0)
    out[starts] = 0
    return out


def _summed(steps: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ids from their steps: ``n`` of them after each of ``first``."""
    total = np.cumsum(steps)
    starts = np.cumsum(n) - n
    return total + np.repeat(first - total[np.minimum(starts, max(len(total) - 1, 0))] if len(total) else first, n)


def _coded(infos: np.ndarray) -> np.ndarray:
    return np.column_stack([infos[:, 0], infos[:, 1] * 4 + infos[:, 2]]).astype("<i4")


def _infos(column: pa.Array) -> np.ndarray:
    """(length of the document, hits, field) of each hit."""
    coded = _numbers(column, "<i4")[0].reshape(-1, 2)
    return np.column_stack([coded[:, 0], coded[:, 1] // 4, coded[:, 1] % 4])


def _taken(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of these sizes) in another order."""
    starts, sized = np.cumsum(sizes) - sizes, sizes[order]
    return values[np.repeat(starts[order] - (np.cumsum(sized) - sized), sized) + np.arange(sized.sum())]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    turn = np.ones(len(keys[0]), dtype=bool)
    turn[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(turn)


def _piece(terms, code, part, nil, doc, batch, infos, places) -> pa.RecordBatch:
    """Pieces of hits in the order of term, slice and id."""
    starts = _heads(code, part) if len(code) else np.empty(0, dtype=np.int64)
    bounds = np.append(starts, len(code)).astype(np.int64)
    at = np.append(0, np.cumsum(infos[:, 1]))[bounds].astype(np.int64)
    none, last = nil[starts], bounds[1:] - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[starts].astype(np.int32)), terms.take(pa.array(code[starts])).cast(pa.string()), pa.array(doc[starts], mask=none), pa.array(doc[last], mask=none),
            _binary(_steps(doc, starts), bounds), pa.nulls(len(starts), pa.binary()) if batch is None else _binary(batch, bounds), _binary(_coded(infos), bounds), _binary(places, at),
        ],
        names=["slice", "term", "first_doc", "last_doc", "ids", "batches", "infos", "places"],
    )


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(column).to_numpy(zero_copy_only=False)


def _token_pieces(cuts: list[int]):
    """Pieces of rows (doc_id, an array of tokens for each field), by one sort of the tokens of a bounded slice."""
    slices, columns = se._slices, [1 + se.FIELDS.index(name) for name in NAMES]  # a function that names a module would take all of it along

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, PIECE_TOKENS)):
            doc, nil = _ids(batch.column(0))
            lists = [batch.column(c) for c in columns]
            sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in lists]
            total = sum(sizes)
            if not total.sum():
                continue
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            row = np.concatenate([np.repeat(np.arange(len(doc)), n) for n in sizes])
            at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
            rank = np.empty(len(doc), dtype=np.int64)
            rank[np.lexsort((doc, ~nil))] = np.arange(len(doc))
            key = (code * len(doc) + rank[row]) * len(NAMES) + np.repeat(np.arange(len(NAMES)), [n.sum() for n in sizes])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = _heads(key)
            mine = row[order][first]
            infos = np.column_stack([total[mine], np.diff(np.append(first, len(key))), key[first] % len(NAMES)]).astype("<i4")
            part = np.where(nil, -1, np.searchsorted(np.asarray(cuts, dtype=np.int64), doc))
            yield _piece(coded.dictionary, code[order][first], part[mine], nil[mine], doc[mine], None, infos, at[order].astype("<i4"))

    return run


def _row_pieces(cuts: list[int]):
    """Pieces of rows (term, doc_id, batch, length, field, positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded, (doc, nil) = batch.column(0).dictionary_encode(), _ids(batch.column(1))
            code, since = coded.indices.to_numpy().astype(np.int64), batch.column(2).to_numpy().astype("<i8")
            length, field = batch.column(3).to_numpy(), pc.index_in(batch.column(4), value_set=pa.array(NAMES)).to_numpy()
            tf = pc.list_value_length(batch.column(5)).to_numpy().astype(np.int64)
            order = np.lexsort((field, since, doc, ~nil, code))
            part = np.where(nil, -1, np.searchsorted(np.asarray(cuts, dtype=np.int64), doc))
            infos = np.column_stack([length, tf, field]).astype("<i4")[order]
            places = _taken(batch.column(5).flatten().to_numpy().astype("<i4"), tf, order)
            yield _piece(coded.dictionary, code[order], part[order], nil[order], doc[order], since[order], infos, places)

    return run


def _blocked(block: int, batch: int | None, dead: tuple[np.ndarray, np.ndarray] | None):
    """Blocks of pieces that come in the order of bucket, slice, term and first id.

    Pieces may overlap. What the pieces still to come cannot precede is settled: ids below the last piece's first one. Of
    the last term the rest, and settled documents that do not fill a block yet, wait for the next Arrow batch.
    """

    def alive(doc, since, nil):
        ids, upto = dead
        if not len(ids):
            return np.ones(len(doc), dtype=bool)
        at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
        return nil | (ids[at] != doc) | (since >= upto[at])

    def out(keys, g, nil, doc, since, infos, places, block_at, entry_at):
        """Blocks that begin at hits ``block_at``; ``entry_at`` are the hits at which a document begins."""
        entry_tf, entry_length = np.add.reduceat(infos[:, 1].astype(np.int64), entry_at), np.maximum.reduceat(infos[:, 0], entry_at)
        infos = infos.copy()
        infos[:, 0] = np.repeat(entry_length, np.diff(np.append(entry_at, len(doc))))
        bounds = np.append(block_at, len(doc)).astype(np.int64)
        at = np.append(0, np.cumsum(infos[:, 1].astype(np.int64)))[bounds]
        first = np.searchsorted(entry_at, block_at)
        n, none, mine = np.diff(np.append(first, len(entry_at))), nil[block_at], pa.array(g[block_at])
        return pa.RecordBatch.from_arrays(
            [
                keys[2].take(mine), pa.array(doc[block_at], mask=none), pa.array(doc[bounds[1:] - 1], mask=none), pa.array(n.astype(np.int64)),
                pa.array(np.maximum.reduceat(entry_tf, first)), pa.array(np.minimum.reduceat(entry_length, first).astype(np.int64)),
                _binary(_steps(doc, block_at), bounds), _binary(since, bounds), _binary(_coded(infos), bounds), _binary(places, at), pa.array(keys[0][g[block_at]]),
            ],
            names=["term", "first_doc", "last_doc", "n", "max_tf", "min_length", "ids", "batches", "infos", "places", "bucket"],
        )

    def settle(keys, g, nil, doc, since, infos, places, below):
        """(blocks, what waits): ``below`` is None at the end, else the id below which the last group is settled (None of a null id)."""
        order = np.lexsort((infos[:, 2], since, doc, g))
        if (np.diff(order) != 1).any():
            places = _taken(places, infos[:, 1].astype(np.int64), order)
            g, nil, doc, since, infos = g[order], nil[order], doc[order], since[order], infos[order]
        entry_at = _heads(g, doc, since) if len(g) else np.empty(0, dtype=np.int64)
        group_at = np.searchsorted(g[entry_at], np.arange(len(keys[0]) + 1))
        rank = np.arange(len(entry_at)) - group_at[g[entry_at]] if len(entry_at) else entry_at
        stop = len(entry_at)
        if below is not None:
            begin = group_at[-2]
            sure = np.searchsorted(doc[entry_at[begin:]], below) if not nil[entry_at[begin:]].any() else 0
            stop = begin + sure // block * block
        cut = entry_at[stop] if stop < len(entry_at) else len(g)
        at = int(infos[:cut, 1].sum())
        made = None
        if stop:
            made = out(keys, g[:cut], nil[:cut], doc[:cut], since[:cut], infos[:cut], places[:at], entry_at[:stop][rank[:stop] % block == 0], entry_at[:stop])
        return made, (nil[cut:], doc[cut:], since[cut:], infos[cut:], places[at:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for rows in _opened(batches):
            if not rows.num_rows:
                continue
            bucket, part, term = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).cast(pa.string())
            turn = np.ones(rows.num_rows, dtype=bool)
            turn[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            first, group = np.flatnonzero(turn), np.cumsum(turn) - 1
            keys = [bucket[first], part[first], term.take(pa.array(first))]
            steps, n = _numbers(rows.column(4), "<i8")
            doc = _summed(steps, _ids(rows.column(3))[0], n)
            since = np.full(len(doc), batch, dtype="<i8") if batch is not None else _numbers(rows.column(5), "<i8")[0]
            infos, places = _infos(rows.column(6)), _numbers(rows.column(7), "<i4")[0]
            g, nil = np.repeat(group, n), np.repeat(pc.is_null(rows.column(3)).to_numpy(zero_copy_only=False), n)
            if dead is not None:
                keep = np.flatnonzero(alive(doc, since, nil))
                if len(keep) < len(doc):
                    places = _taken(places, infos[:, 1].astype(np.int64), keep)
                    g, nil, doc, since, infos = g[keep], nil[keep], doc[keep], since[keep], infos[keep]
            if held is not None and len(held[0]):
                if key != (keys[0][0], keys[1][0], keys[2][0].as_py()):
                    g, keys = g + 1, [np.append(k, x).astype(x.dtype) for k, x in zip(key, keys[:2])] + [pa.concat_arrays([pa.array([key[2]], pa.string()), keys[2]])]
                g = np.append(np.zeros(len(held[0]), dtype=g.dtype), g)
                nil, doc, since, infos, places = (np.concatenate([a, b]) for a, b in zip(held, (nil, doc, since, infos, places)))
            last = rows.column(3)[rows.num_rows - 1].as_py()
            made, held = settle(keys, g, nil, doc, since, infos, places, -(1 << 63) if last is None else last)
            key = (keys[0][-1], keys[1][-1], keys[2][-1].as_py())
            if made is not None:
                yield made
        if held is not None and len(held[0]):
            keys = [np.array([key[0]], dtype=np.int32), np.array([key[1]]), pa.array([key[2]], pa.string())]
            made, _ = settle(keys, np.zeros(len(held[0]), dtype=np.int64), *held, None)
            yield made

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _opened(batches):
        steps, n = _numbers(rows.column(2), "<i8")
        doc = _summed(steps, _ids(rows.column(1))[0], n)
        since, infos, places = _numbers(rows.column(3), "<i8")[0], _infos(rows.column(4)), _numbers(rows.column(5), "<i4")[0]
        block = np.repeat(np.arange(rows.num_rows), n)
        nil = pc.is_null(rows.column(1)).to_numpy(zero_copy_only=False)[block]
        head = np.zeros(len(doc), dtype=bool)
        if len(doc):
            head[_heads(block, doc, since)] = True
        at = np.append(0, np.cumsum(infos[:, 1].astype(np.int64))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(pa.array(block)).cast(pa.string()), pa.array(doc, mask=nil), pa.array(since), pa.array(infos[:, 0].astype(np.int64)),
                pa.array(NAMES, pa.string()).take(pa.array(infos[:, 2])), pa.array(infos[:, 1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(places)), pa.array(head),
            ],
            names=["term", "doc_id", "batch", "length", "field", "tf", "positions", "head"],
        )
