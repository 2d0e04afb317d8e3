"""Reference tracks: order-preserving dedupe, pooling, counts and reply parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.ordered import number_rows, segment
from quire.session import written


def keep_first(
    rows: DataFrame, group: list[str], key: Column, order: list[str], bucket: list[Column], exempt: Column | None = None
) -> DataFrame:
    """First row per (group, normalised key); blank keys go, exempt rows all stay (A-06).

    A grouped minimum of keys and places alone tells which rows stay and gives them their number; then the rows move
    once, to it. Keys travel as digests. ``seq`` is the kept order. The rows are written once, so that none of this works
    them out again, and who asks for the numbers only moves no row.
    """
    cols = rows.columns
    free = F.lit(False) if exempt is None else exempt
    # an exempt row is keyed by its own place, so it never meets another
    place = F.concat_ws("\x1f", F.lit(""), *[F.col(o).cast("string") for o in order])
    own = F.when(free, place).otherwise(F.nullif(tx.norm_key(key), F.lit("")))  # a key does not begin with a blank
    keyed = written(rows.withColumn("__k", F.unhex(F.md5(own))).where("__k is not null"), "keyed")
    at = F.struct(*[F.col(c) for c in [*group, "__k", *order]])
    first = keyed.groupBy(*group, "__k").agg(F.min(F.struct(*order)).alias("__o")).select(*group, "__k", "__o.*")
    numbered = number_rows(written(first, "first"), group, [F.col(o) for o in order], bucket, "seq")
    rest = [c for c in cols if c not in group and c not in order]
    whole = keyed.groupBy(at.alias("__at")).agg(*[F.any_value(c).alias(c) for c in rest])
    seq = numbered.select(at.alias("__of"), (F.col("seq") - 1).alias("seq"))
    return whole.join(seq, F.col("__at") == F.col("__of")).select("__at.*", *rest, "seq").select(*cols, "seq")


def keep_first_lines(rows: DataFrame) -> DataFrame:
    """Trimmed text lines per document, repeats dropped, first spelling kept (A-07)."""
    lines = rows.select("doc_id", "pos", tx.strip(F.col("text")).alias("text"))
    out = keep_first(lines, ["doc_id"], F.col("text"), ["pos"], [segment("pos")])
    return out.select("doc_id", "seq", "text")


# List fields of a chapter reply, and the field each track is deduplicated on.
TRACK_KEYS = {"people": "name", "geo": "place", "glossary": "term", "chronology": None}
TRACK_FIELDS = {
    "people": ("section", "name", "role"),
    "geo": ("section", "place", "what", "arrival"),
    "glossary": ("section", "term", "meaning"),
    "chronology": ("section", "marker", "event"),
}
LINE_KEYS = ("interpersonal_stated", "interpersonal_inference", "inconsistencies")
SLICE = 4096


def _reply(raw: Column, whole, inner) -> Column:
    """``whole`` of a reply that is an object, else ``inner`` of the object inside its prose; both take (text, variant)."""
    unopened = lambda t: F.when(t.startswith("```"), tx.strip(F.regexp_replace(t, r"\A```(?:json)?", ""))).otherwise(t)
    unclosed = lambda t: F.when(t.endswith("```"), tx.strip(F.left(t, F.length(t) - 3))).otherwise(t)

    def settle(text):
        # What parses and begins with a brace is an object, so no schema is derived.
        cut = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
        found = tx.bound(cut, lambda c: tx.bound(F.try_parse_json(c), lambda v: F.when(v.isNotNull(), inner(c, v))))
        return tx.bound(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), F.when(text.startswith("{"), whole(text, v))).otherwise(found))

    return tx.bound(tx.strip(raw), lambda t: tx.bound(unopened(t), lambda t: tx.bound(unclosed(t), settle)))


def reply_json(raw: Column) -> Column:
    """JSON object text of a reply, without fences or prose around it; null when there is none (F-24)."""
    return _reply(raw, lambda t, v: t, lambda t, v: t)


def reply_object(raw: Column) -> Column:
    """The object of a reply as a variant, parsed once."""
    return _reply(raw, lambda t, v: v, lambda t, v: v)


def _list(v: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def track_row(v: Column, track: str) -> Column:
    """A reply row cut to its track's fields, nulls as ''; null for anything but an object (P-08)."""
    pairs = [x for f in TRACK_FIELDS[track] for x in (F.lit(f), F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")))]
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.create_map(*pairs))


def track_rows(v: Column, track: str) -> Column:
    return F.transform(_list(v, track), lambda e: track_row(e, track))


def replies_to_tracks(replies: DataFrame) -> dict[str, DataFrame]:
    """Chapter replies (doc_id, source_name, chapter_idx, raw) to typed tables (U-02).

    A reply without an object or without a digest is a failure row and gives
    nothing else.
    """
    parsed = replies.withColumn("__v", reply_object(F.col("raw")))
    digest_of = lambda v: F.try_variant_get(v, "$.digest_md", "string")
    is_string = lambda v: F.coalesce(F.schema_of_variant(F.variant_get(v, "$.digest_md", "variant")) == "STRING", F.lit(False))
    has_digest = lambda v: is_string(v) & (tx.strip(digest_of(v)) != "")
    digest, has = digest_of(F.col("__v")), has_digest(F.col("__v"))
    ok = parsed.where(has)
    error = F.when(F.col("__v").isNull(), "no JSON object in the reply").otherwise("digest_md is missing")
    key = ["doc_id", "source_name", "chapter_idx"]

    def listed(v, track):
        return F.transform(track_rows(v, track), lambda d, i: F.struct(F.lit(track).alias("track_type"), i.alias("row_idx"), d.alias("data")))

    # Rows of a table come from one reading of the reply, which is also where a reply without a digest drops out.
    def read(made):
        return tx.bound(reply_object(F.col("raw")), lambda v: F.when(has_digest(v), made(v)))

    rows = replies.select(*key, F.inline(read(lambda v: F.concat(*[listed(v, t) for t in TRACK_KEYS])))).where(F.col("data").isNotNull()).select(*key, "row_idx", "data", "track_type")
    strings = lambda v, k: F.transform(
        _list(v, k), lambda e: F.struct(F.lit(k).alias("kind"), F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).alias("text"))
    )
    lines = replies.select(*key, F.posexplode(read(lambda v: F.concat(*[strings(v, k) for k in LINE_KEYS]))).alias("row_idx", "l")).select(*key, "row_idx", "l.kind", "l.text")
    anchor = lambda e: F.struct(*[F.coalesce(F.try_variant_get(e, f"$.{f}", "string"), F.lit("")).alias(f) for f in ("section", "attribution", "quote")])
    anchors = replies.select(*key, F.posexplode(read(lambda v: F.transform(_list(v, "anchors"), anchor))).alias("row_idx", "a")).select(*key, "row_idx", "a.*")
    return {
        "digests": ok.select(*key, digest.alias("digest_md")),
        "tracks": rows,
        "lines": lines.where(F.col("text").isNotNull()),
        "anchors": anchors,
        "failures": parsed.where(~has | F.col("__v").isNull()).select(*key, error.alias("error")),
    }


def dedup_tracks(rows: DataFrame) -> DataFrame:
    """Document tracks: first row per name, place or term; every chronology row; ``seq`` from 0 (A-06)."""
    key = F.coalesce(*[F.when(F.col("track_type") == t, F.col("data")[f]) for t, f in TRACK_KEYS.items() if f], F.lit(""))
    order = ["chapter_idx", "row_idx"]
    bucket = [F.col("chapter_idx"), F.floor(F.col("row_idx") / SLICE)]
    listed = rows.withColumn("__key", key).withColumn("data", F.map_entries("data"))
    chrono = F.col("track_type") == "chronology"
    kept = keep_first(listed, ["doc_id", "source_name", "track_type"], F.col("__key"), order, bucket, exempt=chrono)
    return kept.withColumn("data", F.map_from_entries("data")).drop("__key")


def dedup_reply_lines(lines: DataFrame) -> DataFrame:
    """Pooled text lines per document and kind, trimmed, first spelling kept (A-07)."""
    rows = lines.select("doc_id", "kind", "chapter_idx", "row_idx", tx.strip(F.col("text")).alias("text"))
    return keep_first(rows, ["doc_id", "kind"], F.col("text"), ["chapter_idx", "row_idx"], [F.col("chapter_idx"), F.floor(F.col("row_idx") / SLICE)])


def track_counts(tracks: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows per document and track, zeros included (A-03)."""
    counts = tracks.groupBy("doc_id").agg(*[F.count_if(F.col("track_type") == t).alias(t) for t in TRACK_KEYS])
    return docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)


def master_stats(tracks: DataFrame) -> DataFrame:
    """Distinct sources, rows, rows per track (A-04)."""
    return tracks.agg(
        F.count_distinct("source_name").alias("sources"), F.count("*").alias("rows"), *[F.count_if(F.col("track_type") == t).alias(t) for t in TRACK_KEYS]
    )


def pool_tracks(tables: list[DataFrame]) -> DataFrame:
    """Union of track rows of many documents; sources are never merged (A-05, X-01)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def anchor_topk(anchors: DataFrame, k: int = 8) -> DataFrame:
    """First k anchors per document; each task keeps only k per document before the shuffle (O-09)."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chapter_idx", "row_idx")
    return anchors.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def consolidate(docs: DataFrame, replies: DataFrame, lines: DataFrame, anchors: DataFrame, k: int = 8) -> DataFrame:
    """Curated fields of the closing reply, each falling back to the pooled material (U-03).

    ``replies``: doc_id, raw; ``lines``: deduplicated (doc_id, kind, seq, text).
    """
    v = reply_object(F.col("raw"))
    trimmed = lambda key: F.filter(
        F.transform(_list(F.col("__v"), key), lambda e: F.when(F.schema_of_variant(e) == "STRING", tx.strip(F.try_variant_get(e, "$", "string")))),
        lambda s: s.isNotNull() & (s != ""),
    )
    text = F.when(
        F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.executive_summary", "variant")) == "STRING", F.lit(False)),
        tx.strip(F.try_variant_get("__v", "$.executive_summary", "string")),
    )
    pooled = lines.groupBy("doc_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == key, F.struct("seq", "text"))))["text"].alias(f"__{key}") for key in LINE_KEYS
    ])
    first = anchor_topk(anchors, k).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "section", "attribution", "quote"))), lambda a: F.struct(a["section"].alias("section"), a["attribution"].alias("attribution"), a["quote"].alias("quote"))).alias("__anchors")
    )
    own = F.transform(_list(F.col("__v"), "anchors"), lambda e: F.struct(*[F.coalesce(F.try_variant_get(e, f"$.{f}", "string"), F.lit("")).alias(f) for f in ("section", "attribution", "quote")]))
    out = docs.select("doc_id").join(replies.select("doc_id", v.alias("__v")), "doc_id", "left").join(pooled, "doc_id", "left").join(first, "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", F.coalesce(text, F.lit("")).alias("exec_summary"),
        *[F.coalesce(F.when(F.size(trimmed(key)) > 0, trimmed(key)), f"__{key}", none).alias(key) for key in LINE_KEYS],
        F.coalesce(F.when(F.size(own) > 0, own), "__anchors", F.array().cast("array<struct<section:string,attribution:string,quote:string>>")).alias("anchors"),
    )
