"""Figures, manifests and stored assets: carry-over, seeding, match rates, coverage, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import membership as mb
from quire.operators.blocks import prop


def _blank_to_null(c) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def carry_over(new_figs: DataFrame, old_figs: DataFrame) -> DataFrame:
    """New figures take the props of the first old figure with the same content (J-03)."""
    first = old_figs.groupBy("doc_id", "sha256").agg(F.min_by("props", "pos").alias("__old"))
    out = new_figs.join(first, ["doc_id", "sha256"], "left")
    return out.select(
        *[c for c in new_figs.columns if c != "props"], F.coalesce("__old", "props").alias("props"), F.col("__old").isNotNull().alias("matched")
    )


def carry_over_counts(carried: DataFrame) -> DataFrame:
    return carried.groupBy("doc_id").agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("new"))


def seed_from_manifest(figures: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sketches, captions and modes from a manifest, matched on content (J-04).

    ``figures``: doc_id, pos, asset_id, sketch_id, caption, alt_text, approval,
    safe_mode. ``manifest``: doc_id, source_sha256, caption, included,
    use_original, sketch_sha256 (null when the file is missing), approved.
    A figure that has a sketch keeps everything; ``reason`` says what happened.
    """
    m = manifest.select(
        "doc_id", F.col("source_sha256").alias("asset_id"), F.col("caption").alias("__cap"), F.col("included").alias("__in"),
        F.col("use_original").alias("__orig"), F.col("sketch_sha256").alias("__sketch"), F.col("approved").alias("__ok"), F.lit(True).alias("__hit"),
    )
    rows = figures.join(m, ["doc_id", "asset_id"], "left")
    reason = (
        F.when(F.coalesce("sketch_id", F.lit("")) != "", "kept").when(F.col("__hit").isNull(), "unmatched")
        .when(_blank_to_null("__sketch").isNull(), "file missing").otherwise("seeded")
    )
    seeded = F.col("reason") == "seeded"
    caption = F.when(seeded, F.coalesce(_blank_to_null("__cap"), "caption")).otherwise(F.col("caption"))
    alt = F.when(seeded, F.coalesce(_blank_to_null("__cap"), "alt_text")).otherwise(F.col("alt_text"))
    mode = F.when(seeded & ~F.col("__in"), "omit").when(seeded & F.col("__orig"), "original").otherwise(F.col("safe_mode"))
    return rows.withColumn("reason", reason).select(
        "doc_id", "pos", "asset_id", F.when(seeded, F.col("__sketch")).otherwise(F.col("sketch_id")).alias("sketch_id"), caption.alias("caption"),
        alt.alias("alt_text"), F.when(seeded, F.when(F.col("__ok"), "approved").otherwise("pending")).otherwise(F.col("approval")).alias("approval"),
        mode.alias("safe_mode"), "reason",
    )


def match_rate(extracted: DataFrame, manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """'matched/extracted' per document with the counts behind it; '0/0' when empty (J-05)."""
    known = manifest.select("doc_id", F.col("source_sha256").alias("sha256"), F.lit(True).alias("__hit")).distinct()
    counts = extracted.select("doc_id", "sha256").distinct().join(known, ["doc_id", "sha256"], "left").groupBy("doc_id").agg(
        F.count("*").alias("extracted"), F.count("__hit").alias("matched")
    )
    out = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    return out.withColumn("rate", F.concat_ws("/", F.col("matched").cast("string"), F.col("extracted").cast("string")))


def unmatched(extracted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Extracted images no manifest figure knows (J-05)."""
    known = manifest.select("doc_id", F.col("source_sha256").alias("sha256"))
    return extracted.select("doc_id", "sha256").distinct().join(known, ["doc_id", "sha256"], "left_anti")


def manifest_lookup(docs: DataFrame, manifests: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """Manifest per document: by slug, else the first path with the same source file (J-06)."""
    live = manifests if denied is None else manifests.join(denied.select("stem").distinct(), "stem", "left_anti")
    by_stem = live.groupBy(F.col("stem").alias("slug")).agg(F.min("path").alias("__stem_path"))
    by_file = live.where(F.col("source_file") != "").groupBy("source_file").agg(F.min("path").alias("__file_path"))
    out = docs.join(by_stem, "slug", "left").join(by_file, "source_file", "left")
    via = F.when(F.col("__stem_path").isNotNull(), "slug").when(F.col("__file_path").isNotNull(), "source_file").otherwise("none")
    return out.select("doc_id", F.coalesce("__stem_path", "__file_path").alias("path"), via.alias("via"))


def cache_key(content: Column, prompt: Column, model: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), prompt.cast("binary"), model.cast("binary")), 256)


def cache_lookup(figures: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Key per figure and whether its result is already stored (J-14).

    ``figures``: content, prompt, model; ``cache``: key, result. Figures that a filter of the cache's keys rules out are
    pending without being shuffled.
    """
    keyed = figures.withColumn("key", cache_key(F.col("content"), F.col("prompt"), F.col("model"))).drop("content")
    pending = lambda d: d.withColumn("result", F.lit(None).cast(cache.schema["result"].dataType))
    if force:
        return pending(keyed).withColumn("state", F.lit("pending"))
    may, new = mb.sifted(keyed, "key", cache, "key")
    out = may.join(cache.groupBy("key").agg(F.min("result").alias("result")), "key", "left").select(*keyed.columns, "result")
    if new is not None:
        out = out.unionByName(pending(new))
    return out.withColumn("state", F.when(F.col("result").isNull(), "pending").otherwise("hit"))


def apply_updates(blocks: DataFrame, updates: DataFrame) -> DataFrame:
    """Blocks changed by (block_id, props) updates, with only the listed props overwritten (J-11)."""
    new = updates.select("block_id", F.col("props").alias("__new"))
    rows = blocks.join(new, "block_id")
    kept = F.map_filter("props", lambda k, v: ~F.map_contains_key(F.col("__new"), k))
    differs = F.exists(F.map_entries("__new"), lambda e: ~F.try_element_at(F.col("props"), e["key"]).eqNullSafe(e["value"]))
    return rows.where(differs).withColumn("props", F.map_concat(kept, "__new")).select(*blocks.columns)


def figures_of(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("type") == "image").select("doc_id", "pos", prop("asset_id").alias("sha256"), "props")


def coverage(images: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """Expected against found per document (A-08).

    ``images``: doc_id, src per figure block; ``files``: doc_id, name of stored
    files; ``sources``: doc_id, expected_sha, found_sha (null when absent).
    """
    figures = images.groupBy("doc_id").agg(F.count("*").alias("figure_blocks"))
    per_src = images.groupBy("doc_id", "src").agg(F.lit(1).alias("one"))
    unique = per_src.groupBy("doc_id").agg(F.count("*").alias("unique_images"))
    # one count per published number, judged by its first source
    firsts = images.withColumn("n", tx.published_number(F.col("src"))).where(F.col("n").isNotNull()).groupBy("doc_id", "n").agg(
        F.min_by("src", "pos").alias("src")
    )
    name = F.regexp_extract("src", r"([^/]+)$", 1)
    stored = files.select("doc_id", "name").distinct()
    originals = firsts.select("doc_id", "n", name.alias("name")).join(stored.withColumn("__o", F.lit(1)), ["doc_id", "name"], "left")
    number = F.regexp_extract("name", r"^figure-(\d+)-silhouette\.(?:png|jpeg|jpg|webp)$", 1)
    sketches = stored.select("doc_id", F.nullif(number, F.lit("")).try_cast("int").alias("n")).where(F.col("n").isNotNull()).distinct().withColumn("__s", F.lit(1))
    found = originals.join(sketches, ["doc_id", "n"], "left").groupBy("doc_id").agg(
        F.count("__o").alias("originals_found"), F.count("__s").alias("sketches_found"),
        F.array_sort(F.collect_list(F.when(F.col("__s").isNull(), F.col("n")))).alias("sketch_gaps"),
    )
    out = sources.join(figures, "doc_id", "left").join(unique, "doc_id", "left").join(found, "doc_id", "left")
    out = out.na.fill(0, ["figure_blocks", "unique_images", "originals_found", "sketches_found"])
    return out.select(
        "doc_id", "figure_blocks", "unique_images", "originals_found", "sketches_found",
        F.coalesce("sketch_gaps", F.array().cast("array<int>")).alias("sketch_gaps"),
        F.when(F.col("found_sha").isNotNull(), F.coalesce(F.col("found_sha") == F.col("expected_sha"), F.lit(False))).alias("source_sha_ok"),
    )
