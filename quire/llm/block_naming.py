"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed size. The distinct blocks of the corpus are sorted into integer names;
then adjacent pairs of names are named the same way, level by level, until one name is left per document. Two documents
carry the same (level, name) exactly when their texts are the same.

Block texts travel once, de-duplicated before they are shuffled. Occurrences follow their block by a 128-bit digest, and
the distinct blocks themselves prove that no digest stands for two contents; should one, the round is repeated with
another salt, so identities never rest on a hash. All later levels move integers only, half as many at each level.
"""

from __future__ import annotations

from functools import partial
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, fresh, prefix_sums, text_or_empty
from quire.session import cut_lineage

#: Code points in a block.
BLOCK = 4096


def normalised(text: str | Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digest(block: Column, salt: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{salt}:"), block)))


def _blocks(text: Column, size: int) -> Column:
    """Consecutive blocks; an empty text has one empty block."""
    return F.regexp_extract_all(text, F.lit(f"(?s)^$|.{{1,{size}}}"), F.lit(0))


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``rid`` (this run's row number), ``doc_id``, ``text_sha256``, ``level``, ``name``.

    Null and empty texts share one identity; very long texts only take more levels; repeated rows keep a row each; an
    empty table gives an empty result. Other columns are not read.
    """
    norm = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), _blocks(F.col("norm"), size).alias("blocks"))
    for salt in count():
        named_by = partial(digest, salt=salt)
        base = cut_lineage(
            cut.select(
                F.monotonically_increasing_id().alias("rid"), "doc_id", "text_sha256",
                F.transform("blocks", lambda b: named_by(b)).alias("digests"),  # noqa: B023
            )
        )
        distinct = norm.select(F.explode(_blocks(F.col("norm"), size)).alias("block")).select(named_by(F.col("block")).alias("digest"), "block").distinct()
        names = prefix_sums(distinct.groupBy("digest").agg(F.count("*").alias("contents")), [], ["digest"], {"name": F.lit(1)})
        if names.filter("contents > 1").isEmpty():
            break
    longest = base.agg(F.max(F.size("digests"))).first()[0] or 1
    seq = base.select("rid", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    seq = cut_lineage(seq.join(names, "digest").select("rid", "n", "pos", "name"))
    done = []
    for level in range(longest.bit_length() + 1):
        done.append(seq.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        longest = (longest + 1) // 2
        pairs = seq.filter("n > 1").groupBy("rid", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut_lineage(pairs)
        names = prefix_sums(pairs.select("a", "b").distinct(), [], ["a", "b"], {"name": F.lit(1)})
        seq = cut_lineage(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"))
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return base.select("rid", "doc_id", "text_sha256").join(named, "rid")


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of equal texts the row with the smallest id stays.

    Null ids come after all others. Rows that also share their id are told apart by their place in the input, so one
    row of a group always stays.
    """
    rows = cut_lineage(identities(docs, text, doc_id, size))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = rows.groupBy("level", "name").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))
    groups = cut_lineage(groups)  # a table of its own, so that the join on a hot identity can be split
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256",
    )


def unique_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows alike in id and text stay once."""
    kept = duplicates(docs, text, doc_id, size).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = fresh(docs, "_sha256")
    rows = docs.withColumn(sha, F.sha2(normalised(text), 256))
    found = rows.join(kept, rows[doc_id].eqNullSafe(kept["_id"]) & (rows[sha] == kept["_sha"]), "left_semi")
    return found.dropDuplicates([doc_id, sha]).drop(sha)
