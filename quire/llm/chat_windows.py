"""Chat formatting in budgeted windows, in DataFrame operations only.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans. A window is the system turn, a limited
history (the last turns before the span, within a token and a turn limit) and the span's own turns. Only the span's
assistant texts are under the loss mask: what is repeated is masked, so every assistant text is learned from once.

Spans are read off the prefix sums alone, with no fold over the conversation: a turn of more than half the span budget
stands by itself, and the others go by the half-budget cell in which they start; so a span never exceeds its budget
unless it is one turn. Every turn counts in full, system turns wherever they stand too, so a window has at most the
tokens of its leading system turn, the history budget, and the span budget or one longer turn. Conversations are laid out by range, so a very long one spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prefix_sums, text_or_empty

#: Tokens of new turns in a window, tokens and turns of repeated history.
SPAN, HISTORY, HISTORY_TURNS = 256, 96, 2
#: Tokens that a turn takes besides its text.
OVERHEAD = 4
OPEN, MID, CLOSE = "<|turn|>", "<|says|>", "<|done|>"


def escaped(text: Column) -> Column:
    """Text in which no control string of this or a common template can occur: a backslash follows each ``<``, ``[``, ``\\``."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def token_estimate(text: Column) -> Column:
    """A token per four characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def windows(
    turns: DataFrame, span: int = SPAN, history: int = HISTORY, history_turns: int = HISTORY_TURNS, tokens=token_estimate,
) -> DataFrame:
    """conv_id, window (number of its first new turn), formatted, loss (spans of ``formatted``), n_turns, n_repeated, n_tokens.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by turn (null first), role and text; null roles and texts
    are empty; rows without conv_id form one conversation. ``n_tokens`` counts all turns of the window: the leading
    system turn, at most ``history`` of history, and at most ``span`` of new turns unless these are a single one. A turn
    longer than the span stays whole in a window of its own. Repeated rows are turns of their own, an empty table gives
    an empty result, and columns but the four are not read. Loss spans are code points, end exclusive.
    """
    half = max(1, span // 2)
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = turns.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tok", F.lit(OVERHEAD) + tokens(F.col("text")))
    rows = rows.withColumn("alone", F.col("tok") > half)
    rows = prefix_sums(rows, ["no_conv", "conv"], ["turn", "role", "text"], {"pos": F.lit(1), "before": F.col("tok"), "big": F.col("alone").cast("int")})
    rows = rows.withColumn("cell", F.expr(f"before div {half}"))
    span_key = ["no_conv", "conv", "big", "cell", "alone"]
    starts = rows.groupBy(*span_key).agg(F.min("pos").alias("start"), F.min("before").alias("start_before")).filter("start > 0")
    turn = ["pos", "role", "text", "tok"]
    own = rows.select(*span_key, *turn, F.lit(True).alias("new"))
    first = rows.filter("pos = 0 and role = 'system'").select("no_conv", "conv", *turn)
    system = starts.join(first, ["no_conv", "conv"]).select(*span_key, *turn, F.lit(False).alias("new"))
    back = starts.select(*span_key, "start_before", F.explode(F.expr(f"sequence(start - 1, start - {history_turns}, -1)" if history_turns > 1 else "array(start - 1)")).alias("pos"))
    past = rows.filter("not (pos = 0 and role = 'system')").select("no_conv", "conv", "before", *turn)
    past = back.join(past, ["no_conv", "conv", "pos"]).filter(F.col("start_before") - F.col("before") <= history)
    parts = own.unionByName(system)
    if history_turns > 0:
        parts = parts.unionByName(past.select(*span_key, *turn, F.lit(False).alias("new")))
    built = parts.groupBy(*span_key).agg(F.sort_array(F.collect_list(F.struct("pos", "new", "role", "text"))).alias("t"), F.sum("tok").alias("n_tokens"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MID))
    pieces = F.transform("t", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["new"] & (t["role"] == "assistant")).alias("learn")))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(CLOSE))).alias("at"),
        F.when(p["learn"], F.array_append(acc["loss"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))).otherwise(acc["loss"]).alias("loss"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return built.withColumn("p", pieces).select(
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"),
        F.array_min(F.transform(F.filter("t", lambda t: t["new"]), lambda t: t["pos"])).alias("window"),
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("p", zero, step, lambda acc: acc["loss"]).alias("loss"),
        F.size("t").alias("n_turns"), F.size(F.filter("t", lambda t: ~t["new"])).alias("n_repeated"), "n_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text) and loss texts, parsed from the formatted strings alone; repeats are left out."""
    one = f"(?s){''.join(chr(92) + c if not c.isalnum() else c for c in OPEN)}(.*?){''.join(chr(92) + c if not c.isalnum() else c for c in MID)}(.*?){''.join(chr(92) + c if not c.isalnum() else c for c in CLOSE)}"
    part = lambda g: F.transform(F.regexp_extract_all("formatted", F.lit(one), F.lit(g)), unescaped)
    both = F.arrays_zip(part(1).alias("role"), part(2).alias("text"))
    own = F.slice(both, F.col("n_repeated") + 1, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", own.alias("turns"), loss.alias("loss_texts"), F.length("formatted").alias("chars"))
