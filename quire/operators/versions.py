"""Snapshots, edits, publishing state, renames and deletes as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.membership import sifted
from quire.operators.ordered import number_rows, number_rows_by_range, segment
from quire.session import cut_lineage, written

FP = "\x1c"


def effective_hash(docs: DataFrame, hashes: DataFrame, blocks: DataFrame, labels: DataFrame, home_fingerprint: Column | None = None) -> DataFrame:
    """Content hash plus what else shows on the page (F-12).

    The narrative label counts only for documents that hold a panel, the group
    listing fingerprint only for home pages.
    """
    panels = blocks.where(F.col("type") == "narrative").select("doc_id").distinct().withColumn("__panel", F.lit(True))
    rows = docs.select("doc_id", "kind").join(hashes, "doc_id").join(labels, "doc_id", "left").join(panels, "doc_id", "left")
    label = F.when(F.col("__panel"), F.concat(F.lit("label" + FP), F.coalesce("label", F.lit(""))))
    home = F.when(F.col("kind") == "homepage", F.concat(F.lit("home" + FP), home_fingerprint)) if home_fingerprint is not None else F.lit(None).cast("string")
    extra = F.concat_ws(FP, label, home)
    full = F.when(extra == "", F.col("content_hash")).otherwise(F.sha2(F.concat_ws(FP, "content_hash", extra), 256))
    return rows.select("doc_id", full.alias("content_hash"))


def listing_fingerprint(timeline: DataFrame) -> DataFrame:
    """One hash over an ordered group listing: rows, then slices of a group, then slices of groups (F-12)."""
    rows = timeline.select(
        "sort_order", "rank", F.sha2(F.concat_ws(FP, "name", F.col("rank").cast("string"), "title", "reading_time"), 256).alias("h")
    )
    parts = rows.groupBy("sort_order", segment("rank").alias("seg")).agg(F.sort_array(F.collect_list(F.struct("rank", "h"))).alias("x"))
    parts = parts.select("sort_order", "seg", F.sha2(F.array_join("x.h", ""), 256).alias("h"))
    wide = parts.groupBy(segment("sort_order").alias("top")).agg(F.sort_array(F.collect_list(F.struct("sort_order", "seg", "h"))).alias("x"))
    tops = wide.select("top", F.sha2(F.array_join("x.h", ""), 256).alias("h"))
    return tops.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("top", "h")))["h"], ""), 256).alias("fingerprint"))


def snapshot(docs: DataFrame, hashes: DataFrame, history: DataFrame, note: str, now: Column) -> DataFrame:
    """New snapshot rows, numbered after the history, one per document (V-01)."""
    base = history.agg(F.coalesce(F.max("snapshot_id"), F.lit(0)).alias("top")).scalar()
    rows = docs.select("doc_id").join(hashes, "doc_id")
    numbered = number_rows_by_range(rows, [], [F.col("doc_id")], "n")
    return numbered.select((F.col("n") + base).alias("snapshot_id"), "doc_id", "content_hash", F.lit(note).alias("note"), now.alias("created_at"))


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """Snapshots per document, newest first as rank 1 (O-07)."""
    newest = -F.col("snapshot_id")
    return number_rows(snapshots, ["doc_id"], [newest], [segment(newest)], "rank")


def log_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """A change row where the content hash differs, with both hashes (V-02)."""
    old = before.select("doc_id", F.col("content_hash").alias("hash_before"))
    rows = after.select("doc_id", F.col("content_hash").alias("hash_after")).join(old, "doc_id", "left")
    return rows.where(~F.col("hash_before").eqNullSafe(F.col("hash_after"))).select(
        "doc_id", F.lit("edit").alias("kind"), "hash_before", "hash_after"
    )


def mark_published(sync: DataFrame, events: DataFrame) -> DataFrame:
    """Upsert state rows: a null snapshot unpublishes (V-03). ``events``: doc_id, target_id, snapshot_id, at."""
    on = events.select("doc_id", "target_id", F.col("snapshot_id").alias("__s"), F.col("at").alias("__at"), F.lit(True).alias("__new"))
    rows = sync.join(on, ["doc_id", "target_id"], "full")
    hit, live = F.coalesce("__new", F.lit(False)), F.col("__s").isNotNull()
    return rows.select(
        "doc_id", "target_id", F.when(hit, F.col("__s")).otherwise(F.col("snapshot_id")).alias("snapshot_id"),
        F.when(hit, F.when(live, "PUBLISHED").otherwise("UNPUBLISHED")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.when(live, F.col("__at"))).otherwise(F.col("published_at")).alias("published_at"),
    )


def rollback(choice: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to restore, rejected pairs): the snapshot must belong to the document (V-04)."""
    owned = snapshots.select("snapshot_id", F.col("doc_id").alias("__owner"), "content_hash")
    rows = choice.join(owned, "snapshot_id", "left")
    fits = F.col("__owner").eqNullSafe(F.col("doc_id"))
    return rows.where(fits).select("doc_id", "snapshot_id", "content_hash"), rows.where(~fits).select("doc_id", "snapshot_id")


def stale_reports(reports: DataFrame, hashes: DataFrame) -> DataFrame:
    """Reports whose document has changed since (V-05)."""
    now = hashes.select("doc_id", F.col("content_hash").alias("__now"))
    return reports.join(now, "doc_id").withColumn("stale", F.col("content_hash") != F.col("__now")).drop("__now")


def publish_all(dirty: DataFrame, render: DataFrame, folder: str, spark, now: Column, run: int) -> dict[str, DataFrame]:
    """Write rendered pages, then record state and log for the pages found written (V-07).

    ``dirty``: doc_id, target_id, kind, target_kind, content_hash; ``render``:
    doc_id, html. Every run has a folder of its own, so earlier pages stay, and
    only this run's folder is read back: a failed write leaves its document
    dirty whatever was published before. A dirty home page is refreshed, marked
    and logged once anything but a drive copy went out to its target.
    """
    dirty = by_document(dirty)
    own = f"{folder}/run={run}"
    pages = render.join(asked_pages(dirty), "doc_id")
    pages.write.mode("overwrite").partitionBy("target_id").parquet(own)
    schema = f"{pages.drop('target_id').schema.simpleString()[7:-1]}, target_id: bigint".replace(":", " ")
    return publish_state(dirty, spark.read.schema(schema).parquet(own).select("doc_id", "target_id").distinct(), now)


def by_document(dirty: DataFrame) -> DataFrame:
    """Dirty rows, written once: a row for each document, kind and hash with its targets, so that a hash moves once for all of them."""
    wanted = F.collect_list(F.struct("target_id", "target_kind"))
    return written(dirty.groupBy("doc_id", "kind", "content_hash").agg(wanted.alias("targets")), "dirty")


def asked_pages(dirty: DataFrame) -> DataFrame:
    """Each (doc_id, target_id) once; they lie by document."""
    each = dirty.select("doc_id", F.explode("targets.target_id").alias("target_id"))
    return each.repartition("doc_id").distinct()


def publish_state(dirty: DataFrame, found: DataFrame, now: Column) -> dict[str, DataFrame]:
    """State and log rows for the (doc_id, target_id) found written, and for the home pages refreshed with them (V-07).

    ``dirty`` as of ``by_document``: both are read off one join by document.
    """
    there = found.groupBy("doc_id").agg(F.collect_set("target_id").alias("found"))
    out = lambda t: F.coalesce(F.array_contains("found", t["target_id"]), F.lit(False))
    met = dirty.join(there, "doc_id", "left")
    rows = written(met.select("doc_id", "kind", "content_hash", F.explode(F.transform("targets", lambda t: F.struct(t["target_id"].alias("target_id"), t["target_kind"].alias("target_kind"), out(t).alias("done")))).alias("t")).select("doc_id", "kind", "content_hash", "t.*").where((F.col("kind") == "homepage") | F.col("done")), "done")
    done = rows.where("done")
    other = done.where((F.col("target_kind") != "drive") & (F.col("kind") != "homepage")).select("target_id").distinct()
    home = rows.where(~F.col("done")).join(other, "target_id", "left_semi")
    row = lambda d, what: d.select("doc_id", F.lit("publish").alias("kind"), "target_id", F.lit(what).alias("summary"), now.alias("created_at"))
    log = row(done, "published").unionByName(row(home, "refreshed with its target"))
    return {"marked": done.unionByName(home.select(*done.columns)).select("doc_id", "target_id", "content_hash"), "log": log}


def published_pages(spark, folder: str, schema: str = "doc_id long, html string") -> DataFrame:
    """The newest page per document and target over all runs: doc_id, target_id, run, html."""
    rows = spark.read.schema(f"{schema}, run long, target_id long").parquet(folder)
    newest = rows.groupBy("doc_id", "target_id").agg(F.max("run").alias("run"))
    return rows.join(newest, ["doc_id", "target_id", "run"]).select("doc_id", "target_id", "run", "html")


def once_only(job: str, rows: DataFrame, markers: DataFrame, force: bool = False) -> DataFrame:
    """Rows of keys that have no marker for this job yet; force takes all (V-08)."""
    if force:
        return rows
    return rows.join(markers.where(F.col("job") == job).select("doc_id").distinct(), "doc_id", "left_anti")


def rename_keys(docs: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Batch slug rename (J-12): docs, rejected collisions, change rows.

    ``mapping``: old_slug, new_slug. A new slug that exists, or that two
    renames ask for, is rejected.
    """
    wanted = mapping.select("old_slug", "new_slug").distinct()
    twice = wanted.groupBy("new_slug").agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select("new_slug")
    clash = docs.select(F.col("slug").alias("new_slug")).distinct().unionByName(twice).distinct()
    rejected = wanted.join(clash, "new_slug", "left_semi").select("old_slug", "new_slug")
    good = wanted.join(clash, "new_slug", "left_anti").select(F.col("old_slug").alias("slug"), "new_slug")
    rows = docs.join(good, "slug", "left")
    url = F.replace(F.col("canonical_url"), F.concat(F.lit("/"), F.col("slug"), F.lit(".")), F.concat(F.lit("/"), F.col("new_slug"), F.lit(".")))
    renamed = rows.withColumns(
        {"canonical_url": F.when(F.col("new_slug").isNotNull(), url).otherwise(F.col("canonical_url")), "slug": F.coalesce("new_slug", "slug")}
    ).select(*docs.columns)
    log = rows.where(F.col("new_slug").isNotNull()).select(
        "doc_id", F.lit("edit").alias("kind"), F.concat(F.lit("renamed '"), "slug", F.lit("' to '"), "new_slug", F.lit("'")).alias("summary")
    )
    return {"docs": renamed, "rejected": rejected, "log": log}


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Drop a set of documents from every table keyed by doc_id; asset tables have no such key and stay (J-13)."""
    ids = gone.select("doc_id").distinct()
    return {name: t.join(ids, "doc_id", "left_anti") if "doc_id" in t.columns else t for name, t in tables.items()}


def replace_by_key(table: DataFrame, new: DataFrame, keys: DataFrame, key: str = "doc_id", within: bool = False) -> DataFrame:
    """Delete the rows of ``keys`` and insert ``new``; a key without new rows ends up empty (K-03).

    ``within`` says that ``new`` was made for these keys only, so its rows need not be moved to be compared with them.
    Keys alone tell what stays, and rows that surely do not are not moved.
    """
    named = keys.select(key).distinct()
    stay = cut_lineage(table.select(key).distinct().join(named, key, "left_anti"))
    kept = sifted(table, key, stay, key)[0].join(stay, key, "left_semi").unionByName(table.where(F.col(key).isNull()))
    return kept.unionByName(new if within else new.join(named, key, "left_semi"))
