"""Pieces shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

#: White space and words as every operator here reads them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(parts: int, doc_id: str = "doc_id") -> Column:
    """Fold of a document: crc32 of its id as text (null: empty), modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of ``keys`` in which null equals null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, *but: str) -> list[Column]:
    """All columns of ``df`` but some, bound to it, so that a joined table may have columns of the same names."""
    left_out = {c.lower() for c in but}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in left_out]


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds each named sum over the rows before this one, in ``order`` inside ``group`` (no nulls in ``group``).

    Rows are range-partitioned on group and order, so a group of any size spreads over many tasks; the layout is
    written once, since range bounds are sampled. A sum is the one inside the partition plus the totals of the
    group's earlier partitions: a small table of one row per (group, partition). Rows that tie in ``order`` are
    taken in any sequence, so ``order`` should hold all columns in which rows may differ.
    """
    rows = df.select("*", *(c.cast("long").alias(f"_v_{n}") for n, c in sums.items()))
    rows = written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "prefix")
    per_part = rows.groupBy("_part", *group).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", *group, *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums))
    before = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_l_{n}") for n in sums))
    return local.join(offsets, ["_part", *group]).select(*df.columns, *((F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))
