"""Full-text index as postings, ranked search and snippets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.session import cut_lineage

FIELDS = ("slug", "title", "body")
TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Folders of a stored index, and bytes of text whose entries one task writes.
BUCKETS, TASK_BYTES = 64, 1 << 26
#: Tokens that are grouped at once, unless one document holds more.
SLICE_TOKENS = 1 << 19


def fold(c: Column) -> Column:
    """Lower-case with Latin diacritics removed."""
    return tx.fold_latin(F.lower(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(f"({TOKEN})"), 1)


def _slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where ``SLICE_TOKENS`` are reached, so that memory follows neither batch nor text."""
    most = most or SLICE_TOKENS
    sizes = sum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy().astype(np.int64) for k, _ in enumerate(FIELDS, 1))
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, field, tf, positions, length) of rows (doc_id, an array of tokens for each field).

    Tokens are grouped by one sort of their codes for a slice of a batch. A row of the empty term holds the document's length.
    """
    for batch in (part for whole in batches for part in _slices(whole)):
        total, parts = np.zeros(batch.num_rows, dtype=np.int64), []
        for k, _ in enumerate(FIELDS, 1):
            lists = batch.column(k)
            flat, lens = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            total += lens
            coded = flat.dictionary_encode()
            code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), lens)
            at = np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens)
            key = row * (len(coded.dictionary) + 1) + code
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            parts.append((FIELDS[k - 1], coded.dictionary, code[order][heads], row[order][heads], np.diff(np.append(heads, len(key))), at[order].astype(np.int32), heads))
        for name, terms, code, row, tf, at, heads in parts:
            ends = pa.array(np.append(heads, len(at)).astype(np.int32))
            yield _rows(batch, terms.take(pa.array(code)), row, name, tf, pa.ListArray.from_arrays(ends, pa.array(at)), total)
        none = pa.ListArray.from_arrays(pa.array(np.zeros(batch.num_rows + 1, dtype=np.int32)), pa.array([], pa.int32()))
        yield _rows(batch, pa.array([""] * batch.num_rows), np.arange(batch.num_rows), "", total, none, total)


def _rows(batch, terms, row, field, tf, positions, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            terms.cast(pa.string()), batch.column(0).take(pa.array(row)), pa.array([field] * len(row), pa.string()), pa.array(tf, pa.int64()), positions,
            pa.array(total[row], pa.int64()),
        ],
        names=["term", "doc_id", "field", "tf", "positions", "length"],
    )


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id and the tokens of each field: every text is tokenised once, inside its row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[tokens(F.col(f)).alias(f) for f in FIELDS])


def token_rows(rows: DataFrame) -> DataFrame:
    """Index rows of tokenised documents; nothing is shuffled."""
    return rows.mapInArrow(_entries, "term string, doc_id long, field string, tf long, positions array<int>, length long")


def index_rows(docs: DataFrame) -> DataFrame:
    """term, doc_id, field, tf, positions, length of the document: every text is tokenised once, and nothing is shuffled.

    A row of the empty term holds the document's length as its tf.
    """
    return token_rows(tokenised(docs))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("term") != "").drop("length"), rows.where(F.col("term") == "").select("doc_id", "length")


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) from doc_id, slug, title, body (I-01)."""
    return _split(index_rows(docs))


def bucket_of(term: Column) -> Column:
    return F.when(term == "", -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def write_tasks(docs: DataFrame) -> int:
    """Tasks for each bucket of an index of ``docs``."""
    size = docs.agg(sum((F.coalesce(F.sum(F.octet_length(f)), F.lit(0)) for f in FIELDS), F.lit(0))).first()[0]
    return max(1, -(-size // (BUCKETS * TASK_BYTES)))


def write_index(docs: DataFrame, folder: str) -> None:
    """The index as a table laid out by term: a search reads the folders of its own terms (I-01).

    A bucket is dealt by document to as many tasks as its share of the text needs, so that a term of every document makes
    no single task and a task writes about ``TASK_BYTES`` of text, whatever the corpus.
    """
    dealt_to = write_tasks(docs)
    rows = index_rows(docs).drop("length").withColumn("bucket", bucket_of(F.col("term")))
    dealt = rows.repartition(BUCKETS * dealt_to + 1, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(dealt_to))).sortWithinPartitions("bucket", "term", "doc_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def stored_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a written index."""
    rows = spark.read.schema("term string, doc_id long, field string, tf long, positions array<int>, bucket int").parquet(folder)
    return rows.where("bucket >= 0"), rows.where("bucket = -1").select("doc_id", F.col("tf").alias("length"))


def replace_in_index(postings: DataFrame, lengths: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete and re-insert the changed documents' entries."""
    ids = changed.select("doc_id").distinct()
    new_postings, new_lengths = build_index(changed)
    return postings.join(ids, "doc_id", "left_anti").unionByName(new_postings), lengths.join(ids, "doc_id", "left_anti").unionByName(new_lengths)


def query_phrases(spark: SparkSession, query: str) -> list[list[str]]:
    """Whitespace terms, each a phrase of index tokens: folded by the very expression the index is built with."""
    terms = spark.range(1).select(F.transform(tx.words(F.lit(query)), tokens).alias("t")).first()["t"]
    return [list(p) for p in terms if p]


def phrase_counts(postings: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """doc_id with f0…fk, the occurrences of each phrase over all fields."""
    wanted = sorted({t for p in phrases for t in p})
    mine = postings.where(F.col("term").isin(wanted))
    if "bucket" in postings.columns:
        found = postings.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, wanted)), bucket_of).alias("b")).first()["b"]
        mine = mine.where(F.col("bucket").isin(sorted(set(found))))
    per_field = mine.groupBy("doc_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    def shifted(places: Column, by: int) -> Column:
        return F.transform(places, lambda p: p + F.lit(by))

    def occurrences(phrase: list[str]) -> Column:
        first = F.coalesce(F.try_element_at("at", F.lit(phrase[0])), F.array().cast("array<int>"))
        for k, term in enumerate(phrase[1:], 1):
            places = F.coalesce(F.try_element_at("at", F.lit(term)), F.array().cast("array<int>"))
            first = shifted(F.array_intersect(shifted(first, k), places), -k)
        return F.size(first)

    counts = per_field.select("doc_id", *[occurrences(p).alias(f"f{i}") for i, p in enumerate(phrases)])
    return counts.groupBy("doc_id").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(phrases))])


def search(postings: DataFrame, lengths: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best documents holding every phrase, by BM25 over all fields (I-02, O-08)."""
    phrases = query_phrases(postings.sparkSession, query)
    if not phrases:
        return lengths.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = cut_lineage(phrase_counts(postings, phrases))  # counted and then ranked
    names = [f"f{i}" for i in range(len(phrases))]
    corpus = lengths.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("avg"))).scalar()
    found = hits.agg(F.struct(*[F.count_if(F.col(f) > 0).alias(f) for f in names])).scalar()
    both = hits.where(" AND ".join(f"{f} > 0" for f in names)).join(lengths, "doc_id").withColumns({"__c": corpus, "__d": found})

    def part(f: str) -> Column:
        n = F.col("__d")[f]
        idf = F.greatest(F.log((F.col("__c")["n"] - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        tf = F.col(f)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("__c")["avg"]))

    scored = both.select("doc_id", sum((part(f) for f in names), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def snippet(body: Column, phrases: list[list[str]], width: int = 12) -> Column:
    """The window with most distinct query tokens, earliest first, hits in <b>, … at cut edges (I-03)."""
    wanted = F.array(*[F.lit(t) for t in sorted({t for p in phrases for t in p})])

    def marked(word):
        return F.struct(word.alias("w"), F.array_intersect(tokens(word), wanted).alias("hits"))

    def choose(ws):
        starts = F.filter(F.transform(ws, lambda w, i: F.when(F.size(w["hits"]) > 0, i)), lambda i: i.isNotNull())
        scored = F.transform(
            starts, lambda i: F.struct(F.size(F.array_distinct(F.flatten(F.slice(ws, i + 1, width)["hits"]))).alias("n"), (-i).alias("neg"))
        )
        best = F.coalesce(-F.array_max(scored)["neg"], F.lit(0))
        start = F.greatest(F.lit(0), F.least(best, F.size(ws) - width))
        shown = F.transform(
            F.slice(ws, start + 1, width), lambda w: F.when(F.size(w["hits"]) > 0, F.concat(F.lit("<b>"), w["w"], F.lit("</b>"))).otherwise(w["w"])
        )
        left, right = F.when(start > 0, "…").otherwise(""), F.when(start + width < F.size(ws), "…").otherwise("")
        return F.concat(left, F.array_join(shown, " "), right)

    return F.get(F.transform(F.array(F.transform(tx.words(body), marked)), choose), F.lit(0))


def search_with_snippets(docs: DataFrame, postings: DataFrame, lengths: DataFrame, query: str, limit: int = 20) -> DataFrame:
    top = search(postings, lengths, query, limit)
    return top.join(docs, "doc_id").select("doc_id", "slug", "title", "score", snippet(F.col("body"), query_phrases(docs.sparkSession, query)).alias("snippet"))
