"""Per-document results over block rows: word counts, plain text, hashes, polishable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import runs as rn
from quire.functions import text as tx
from quire.operators.ordered import assemble, segment

# Block types counted as prose, and those a polish pass may touch.
PROSE = ("paragraph", "heading", "quote", "bulletListItem", "numberedListItem")
POLISHABLE = (*PROSE, "narrative")


def prop(name: str) -> Column:
    return F.col("props")[name]


def heading_level(default: int = 2) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("level", F.lit(default))))


def word_counts(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of prose and headings per document; documents without any show 0 (A-01)."""
    counted = F.when(F.col("type").isin(*PROSE), tx.word_count(rn.spoken_text(F.col("runs")))).otherwise(0)
    return blocks.select(*keys, counted.alias("w")).groupBy(*keys).agg(F.sum("w").alias("words"))


def block_plain_text() -> Column:
    """Searchable text of one block: caption and alt, note text, or inline text; null when blank."""
    image = F.concat_ws("\n", F.nullif(prop("caption"), F.lit("")), F.nullif(prop("alt_text"), F.lit("")))
    text = F.when(F.col("type") == "image", image).when(F.col("type") == "footnote", prop("text"))
    return F.nullif(text.otherwise(rn.inline_text(F.col("runs"))), F.lit(""))


def plain_text(blocks: DataFrame) -> DataFrame:
    """Newline-joined searchable text per document (F-02)."""
    return assemble(blocks, ["doc_id"], block_plain_text(), "body")


def canonical_block() -> Column:
    """Content of one block as a string with sorted keys and no block id (F-11)."""
    props = F.array_join(
        F.transform(F.sort_array(F.map_entries(F.coalesce("props", F.create_map().cast("map<string,string>")))),
                    lambda e: F.concat(e["key"], F.lit("\x1e"), F.coalesce(e["value"], F.lit("\x1b")))), "\x1d")
    return F.concat_ws(
        "\x1f",
        F.col("type"),
        F.coalesce(F.col("level").cast("string"), F.lit("")),
        F.coalesce(F.col("depth").cast("string"), F.lit("0")),
        rn.inline_html(F.col("runs")),
        props,
    )


def content_hash(blocks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """sha256 per document over block content and (doc_id, meta) maps (F-11).

    Blocks are hashed one by one and only the digests are shuffled, first per
    segment and then per document.
    """
    digests = blocks.select("doc_id", "pos", F.sha2(canonical_block(), 256).alias("h"))
    parts = (
        digests.groupBy("doc_id", segment("pos").alias("seg"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("items"))
        .select("doc_id", "seg", F.sha2(F.array_join("items.h", ""), 256).alias("h"))
    )
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg", "h"))).alias("items"))
    body = F.array_join("items.h", "")
    if meta is None:
        return whole.select("doc_id", F.sha2(body, 256).alias("content_hash"))
    entries = F.transform(
        F.sort_array(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("\x1e"), F.coalesce(e["value"], F.lit("\x1b")))
    )
    return meta.join(whole, "doc_id", "left").select(
        "doc_id",
        F.sha2(F.concat(F.coalesce(body, F.lit("")), F.lit("\x1c"), F.coalesce(F.array_join(entries, "\x1d"), F.lit(""))), 256).alias("content_hash"),
    )


def polishable(blocks: DataFrame) -> DataFrame:
    """Rows a polish pass may touch: block id, kind h1–h3 or p, polish text (P-04)."""
    text = rn.polish_text(F.col("runs"))
    kind = F.when(F.col("type") == "heading", F.concat(F.lit("h"), heading_level().cast("string"))).otherwise("p")
    return (
        blocks.where(F.col("type").isin(*POLISHABLE))
        .select("doc_id", "pos", "block_id", kind.alias("kind"), text.alias("text"))
        .where(tx.strip(F.col("text")) != "")
    )


def to_narrative(blocks: DataFrame) -> DataFrame:
    """Wholly italic top-level paragraphs become narrative panels and lose the italics (F-19)."""
    turn = (F.col("type") == "paragraph") & (F.col("depth") == 0) & rn.fully_italic(F.col("runs"))
    return blocks.withColumn("__turn", turn).withColumns(
        {
            "runs": F.when(F.col("__turn"), rn.strip_italic(F.col("runs"))).otherwise(F.col("runs")),
            "type": F.when(F.col("__turn"), "narrative").otherwise(F.col("type")),
            "props": F.when(F.col("__turn"), F.create_map().cast("map<string,string>")).otherwise(F.col("props")),
        }
    ).drop("__turn")


def conversion_scan(blocks: DataFrame, docs: DataFrame, flag_words: int = 12) -> DataFrame:
    """Per document: paragraphs that would turn narrative and those short enough to flag (A-09)."""
    words = tx.word_count(rn.inline_text(F.col("runs")))
    hits = blocks.where((F.col("type") == "paragraph") & (F.col("depth") == 0) & rn.fully_italic(F.col("runs")))
    counts = hits.groupBy("doc_id").agg(
        F.count("*").alias("conversions"), F.count_if(words < flag_words).alias("flagged")
    )
    return docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["conversions", "flagged"])


def conversions(blocks: DataFrame, flag_words: int = 12) -> DataFrame:
    """One row per converting paragraph: words, 90-character preview, flagged (A-09)."""
    text = rn.inline_text(F.col("runs"))
    words = tx.word_count(text)
    preview = F.when(F.length(text) > 90, F.concat(F.substring(text, 1, 90), F.lit("…"))).otherwise(text)
    return blocks.where((F.col("type") == "paragraph") & (F.col("depth") == 0) & rn.fully_italic(F.col("runs"))).select(
        "doc_id", "pos", words.alias("words"), preview.alias("preview"), (words < flag_words).alias("flagged")
    )
