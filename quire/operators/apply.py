"""User functions over chunks, prompt texts and parsing of block replies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx


def map_chunks(chunks: DataFrame, fn: Callable[[str, str], str], text: str = "text", attempts: int = 2) -> DataFrame:
    """Run ``fn(text, last_error)`` on every chunk (U-01).

    A failing call is tried again with the error it raised; a chunk that keeps
    failing becomes a row with ok = false and never fails the job. Parallelism
    is the number of partitions.
    """
    schema = T.StructType(chunks.schema.fields + T.StructType.fromDDL("ok boolean, payload string, error string, attempts int").fields)

    def run(value):
        error = ""
        for n in range(1, attempts + 1):
            try:
                return True, fn(value, error), "", n
            except Exception as e:  # the user function may raise anything
                error = f"{e}"
        return False, None, error, attempts

    def each(batches):
        for pdf in batches:
            done = pd.DataFrame([run(v) for v in pdf[text]], columns=["ok", "payload", "error", "attempts"], index=pdf.index)
            yield pd.concat([pdf, done.astype({"attempts": "int32"})], axis=1)

    return chunks.mapInPandas(each, schema)


def build_prompts(rows: DataFrame, rules: str, extra_rules: str = "") -> DataFrame:
    """One prompt per chunk of (doc_id, chunk, pos, block_id, kind, text, context_kind, context_text) rows (U-04).

    Blocks get short ids b000, b001 … in order; a chunk is bounded by its token
    budget. ``ids`` is the list of block ids behind the short ones.
    """
    flat = lambda c: F.translate(c, "\n\r", "  ")
    items = F.sort_array(F.collect_list(F.struct("pos", "block_id", "kind", "text")))
    grouped = rows.groupBy("doc_id", "chunk").agg(
        items.alias("items"), F.min_by(F.struct("context_kind", "context_text"), "pos").alias("ctx")
    )
    line = lambda tag, sid, kind, text: F.concat_ws(" ", F.lit(tag), sid, F.rpad(kind, 2, " "), F.lit("::"), flat(text))
    context = F.when(F.col("ctx.context_text").isNotNull(), F.array(line("CONTEXT", F.lit("ctx"), F.col("ctx.context_kind"), F.col("ctx.context_text"))))
    body = F.transform("items", lambda b, i: line("POLISH ", F.format_string("b%03d", i), b["kind"], b["text"]))
    head = rules + (f"\n\n{extra_rules.strip()}" if extra_rules.strip() else "")
    lines = F.concat(F.array(F.lit(head), F.lit("")), F.coalesce(context, F.array().cast("array<string>")), body)
    return grouped.select("doc_id", "chunk", F.col("items.block_id").alias("ids"), F.array_join(lines, "\n").alias("prompt"))


def parse_block_replies(raw: str, ids: str) -> Column:
    """Replies of one chunk as {ok, error, replies: [{block_id, text}]}; any structural fault fails the chunk (U-05).

    Column names of the raw reply and of the chunk's block ids. The reply is a JSON array of {id, kind, text}, or such
    objects one after another, fenced or not. Blocks are named by their own or their short id; ``ctx`` is left out.
    ``error`` lists fault codes with their counts: unreadable, incomplete, text_type, unknown_id, repeated_id, missing.
    """
    # Every step is bound: what is read off a reply is worked out once, however often the next step uses it.
    bare = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"(?s)\A\s*```[A-Za-z]*\n|\n?```\s*\z", "")
    # a quote cannot follow a brace inside a JSON string without ending it there, so this only meets between objects
    listed = lambda b: F.concat(F.lit("["), F.regexp_replace(b, r'\}\s*,?\s*(?=\{\s*"[A-Za-z_]+"\s*:)', "},"), F.lit("]"))
    value = tx.bound(bare, lambda b: F.try_parse_json(F.when(b.rlike(r"\A\s*\["), b).otherwise(listed(b))))
    short = F.transform(F.col(ids), lambda _, i: F.format_string("b%03d", i))
    field = lambda e, k: F.try_variant_get(e, f"$.{k}", "string")

    def parts(e):
        is_text = F.schema_of_variant(F.try_variant_get(e, "$.text", "variant")) == "STRING"
        return F.struct(field(e, "id").alias("name"), field(e, "kind").isNull().alias("bare"), field(e, "text").alias("text"), is_text.alias("is_text"))

    def judged(e, short):
        name = e["name"]
        known = F.when(F.array_contains(F.col(ids), name), name).otherwise(F.try_element_at(F.col(ids), F.nullif(F.array_position(short, name).cast("int"), F.lit(0))))

        def settle(known):
            fault = F.when(name.isNull() | e["bare"] | e["text"].isNull(), "incomplete").when(~e["is_text"], "text_type").when(known.isNull(), "unknown_id")
            return F.struct(known.alias("block_id"), e["text"].alias("text"), fault.alias("fault"))

        return tx.bound(known, settle)

    entries = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), parts), lambda e: ~e["name"].eqNullSafe(F.lit("ctx")))
    read_ = tx.bound(short, lambda s: F.transform(entries, lambda e: judged(e, s)))

    def told(read_, good):
        count = lambda code: F.size(F.filter(read_, lambda r: r["fault"] == code))
        names = good["block_id"]
        counts = [(code, count(code)) for code in ("incomplete", "text_type", "unknown_id")]
        counts += [("repeated_id", F.size(names) - F.size(F.array_distinct(names))), ("missing", F.size(F.array_except(F.col(ids), names)))]
        shown = lambda code, n: tx.bound(n, lambda k: F.when(k > 0, F.concat(F.lit(f"{code}: "), k.cast("string"))))
        faults = F.concat_ws(", ", *[shown(code, n) for code, n in counts])
        return F.when(read_.isNull(), "unreadable").otherwise(faults)

    def outcome(read_, good):
        replies = F.transform(good, lambda r: F.struct(r["block_id"].alias("block_id"), r["text"].alias("text")))
        return tx.bound(told(read_, good), lambda error: F.struct(
            (error == "").alias("ok"), error.alias("error"), F.when(error == "", replies).otherwise(F.slice(replies, 1, 0)).alias("replies")))

    return tx.bound(read_, lambda r: tx.bound(F.filter(r, lambda x: x["fault"].isNull()), lambda good: outcome(r, good)))


def reply_ids_check(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """missing, unexpected and duplicate block ids per chunk (X-05)."""
    have = got.groupBy(*keys, "block_id").agg(F.count("*").alias("__n"))
    want = expected.select(*keys, "block_id").distinct().withColumn("__w", F.lit(True))
    both = want.join(have, [*keys, "block_id"], "full")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__w").isNull(), "unexpected").when(F.col("__n") > 1, "duplicate")
    return both.select(*keys, "block_id", problem.alias("problem")).where(F.col("problem").isNotNull())
