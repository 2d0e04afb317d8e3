"""Corpus scans: documents to ordered block rows, schema alignment, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx

RUN = T.StructType(
    [T.StructField("text", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("bold", "italic", "underline", "strike", "code", "fn_ref")]
    + [T.StructField("href", T.StringType())]
)

BLOCKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("parent_pos", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Corpus table, filtered by kind at the scan when asked (S-01)."""
    docs = spark.read.parquet(path)
    return docs.where(F.col("kind") == kind) if kind else docs


def paragraphs(docs: DataFrame, text_col: str = "text", sep: str = r"\n\s*\n", keep: tuple[str, ...] = ()) -> DataFrame:
    """Trimmed, non-empty paragraphs with dense positions; no shuffle (S-02)."""
    parts = F.filter(F.transform(F.split(F.col(text_col), sep), tx.strip), lambda p: p != "")
    return docs.select("doc_id", *keep, F.posexplode(parts).alias("pos", "text"))


def align_schema(df: DataFrame, target: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Add missing columns with their defaults, leave existing ones alone (S-04)."""
    defaults = defaults or {}
    missing = {
        f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType) for f in target.fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


CHANGE_LOG = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_change_log(spark: SparkSession, path: str, schema: str | None = None, stream: bool = False) -> DataFrame:
    """The append-only log as a table, or as a stream over its folder (S-07)."""
    if stream:
        return spark.readStream.schema(schema or CHANGE_LOG).parquet(path)
    return spark.read.parquet(path)


def as_runs(text: Column, **styles: Column) -> Column:
    """A one-run inline array for a plain text column."""
    flags = [styles.get(f.name, F.lit(False)).alias(f.name) for f in RUN.fields[1:7]]
    href = styles.get("href", F.lit(None).cast("string")).alias("href")
    return F.array(F.struct(text.alias("text"), *flags, href))
