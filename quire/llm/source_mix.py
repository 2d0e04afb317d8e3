"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key; each source is range-sorted on it, distributed prefix sums give the words before
each document, and the source is cut at its exact budget. Budgets above a source's size repeat whole epochs of it, the
last epoch being cut in the same order. Targets share the corpus by weight, no source above a multiple of its size, what
exceeds that being shared again by weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, columns, fresh, prefix_sums, text_or_empty
from quire.session import written

#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: Most epochs of one source.
EPOCHS = 3
SEED = "mix"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to a table of sources (``no_source``, ``src``, ``source_size``).

    With the sources in order of the share at which they reach their cap, capping the first k leaves the level
    ``(total - caps) / (weights left)``; that level rises while k is too small and falls after, so its maximum is the
    level at which no target is above its cap. Both orders are prefix sums, so the catalogue may be long too.
    """
    ranked = prefix_sums(sizes, [], ["no_source", "src"], {"rank": F.lit(1)})
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if whole[0] is None:
        return ranked.select("no_source", "src", "source_size", F.lit(0.0).alias("target"))
    # Weights enter the running sums in millionths, which whole-number sums keep exact.
    running = prefix_sums(ranked, [], ["ratio", "no_source", "src"], {"caps": F.col("cap"), "used": F.round(F.col("weight") * 1e6)})
    level = running.agg(F.max((F.lit(whole[0]) - F.col("caps")) / (F.lit(whole[1]) - F.col("used") / 1e6))).first()[0]
    return ranked.select("no_source", "src", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words the mix takes of each document, repeats counted.

    The taken words of a source add up to its target rounded down; the document at the cut gives the words that are
    left. Null texts have no words, a null source is one source of its own (the last), repeated rows count each by
    itself, a source without words takes nothing, and an empty table gives an empty result. Sizes are of whole texts;
    columns other than doc_id, source and text are not read.
    """
    return _mix(docs, weights, epochs, seed).drop("row")


def _mix(docs: DataFrame, weights: Sequence[float], epochs: int, seed: str, row: str | None = None) -> DataFrame:
    """The rows of ``mix`` with ``row``, the number of the input row where a column holds one."""
    sized = docs.select(
        "doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"),
        F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size"),
        F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).alias("key"),
        (F.col(row) if row else F.lit(0)).cast("long").alias("row"),
    )
    # Range bounds are sampled from the rows, which would read every text twice.
    rows = prefix_sums(written(sized, "sizes"), ["no_source", "src"], ["key", "doc_id", "size", "row"], {"before": F.col("size")})
    sizes = rows.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    budget = targets(sizes, weights, epochs).withColumn("budget", F.floor("target"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.expr("budget - (budget div greatest(source_size, 1)) * source_size - before")))
    return rows.join(budget, ["no_source", "src"]).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.expr("budget div greatest(source_size, 1)") * F.col("size") + cut).cast("long").alias("taken"), "row",
    )


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix written out: a row of ``docs`` for each epoch it is read in, with ``epoch`` and ``taken_words`` of it.

    Rows are numbered as they are written, and the plan goes by that number, so rows of one id are each taken as planned
    and the budget holds; rows alike in id and size are taken in the order of the input. Documents that the mix does not
    reach, null and empty texts among them, are left out; input columns of the two names are replaced.
    """
    number = fresh(docs, "row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "mixed")
    plan = _mix(rows, weights, epochs, seed, number).filter("taken > 0").select(F.col("row").alias("_row"), "size", "taken")
    parts = F.expr("transform(sequence(0L, (taken - 1) div size), e -> least(size, taken - e * size))")
    plan = plan.select("_row", F.posexplode(parts).alias("epoch", "taken_words"))
    mixed = rows.join(plan, rows[f"`{number}`"] == plan["_row"])
    return mixed.select(*columns(rows, "epoch", "taken_words", number), plan["epoch"], plan["taken_words"])
