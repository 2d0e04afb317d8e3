"""A mergeable membership filter before a join: keys that a table cannot hold never move (J-14, K-04).

The filter is a blocked Bloom filter as a table: a key chooses one block of 64 bits and sets ``BITS`` of them. Each task
ORs the blocks of its own keys and the partial blocks are merged by one aggregate. The number of blocks follows from the
counted keys, so a block takes about ``LOAD`` of them whatever the table; a filter of at most ``MOST`` blocks (16 bytes
each) is sent to every task, and above that the plain join is used. A key of the table is never missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: Bits that a key sets, keys in a block of 64 bits, and blocks up to which a filter is sent to all tasks.
BITS, LOAD, MOST = 4, 5, 1 << 21


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and its bits in there."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(BITS)]
    return F.pmod(F.xxhash64(h), F.lit(blocks)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(filter rows (block, bits), number of blocks) of the non-null keys of a table, sized by a count of them."""
    n = keys.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    blocks = max(1, -(-n // LOAD))
    block, bits = _place(F.col(key), blocks)
    rows = keys.where(F.col(key).isNotNull()).select(block.alias("block"), bits.alias("bits"))
    return rows.groupBy("block").agg(F.bit_or("bits").alias("bits")), blocks


def sifted(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key the table may hold, rows whose key it surely does not); the second is None where no filter fits."""
    made, blocks = build(table, table_key)
    if blocks > MOST:
        return rows, None
    block, bits = _place(F.col(key), blocks)
    marked = rows.withColumns({"__block": block, "__bits": bits})
    found = cut_lineage(made.select(F.col("block").alias("__b"), F.col("bits").alias("__have")))
    met = marked.join(F.broadcast(found), F.col("__block") == F.col("__b"), "left")
    may = F.coalesce(F.col("__have").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False)) & F.col(key).isNotNull()
    return met.where(may).select(*rows.columns), met.where(~may).select(*rows.columns)
