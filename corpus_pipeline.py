"""A corpus made ready for training: rejected texts, copies, near copies and benchmark leaks go, then sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns the mix, a row for each epoch
in which a document is read. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost
executor costs at most the stage it worked on; what a stage wrote for itself goes when its rows are written, and they go
when the next stage's are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import block_naming, decontaminate, jaccard_join, quality_pu, source_mix
from quire.llm.common import table
from quire.session import fresh_folder, remove_folder, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as good. Null and empty texts are scored as empty ones, equal texts alike; documents
    without a usable sample of labels all stay."""
    return quality_pu.good_rows(docs, quality_pu.from_labels(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the row of the smallest id; null counts as empty, of repeated rows one stays."""
    return block_naming.unique_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the smallest id; texts without words and rows without id stay."""
    return jaccard_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null, empty and very short texts hold none."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch that reads a document, with ``epoch`` and ``taken_words``; texts without words are in none,
    rows of one id are taken each by itself, a null source is a source."""
    return source_mix.mixed_rows(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mix),
]

#: SQL cannot fit the classifier or find fingerprints; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove_folder(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
