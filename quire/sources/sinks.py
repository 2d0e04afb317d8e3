"""Outputs: track CSVs, asset plans, manifests, and ordered catalogue texts as line rows.

Corpus-wide texts (sitemap, catalogue, site index) are produced as ordered rows
or bounded parts, never as one value, so they grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.session import written

# CSV headers and the stored field behind each, after the source column.
TRACK_HEADERS = {
    "people": ["source", "section", "name", "role_or_relationship"],
    "geo": ["source", "section", "place", "what_occurred_there", "arrival_or_movement"],
    "glossary": ["source", "section", "term", "meaning"],
    "chronology": ["source", "section", "date_or_marker", "event"],
}
TRACK_FIELDS = {
    "people": ["section", "name", "role"],
    "geo": ["section", "place", "what", "arrival"],
    "glossary": ["section", "term", "meaning"],
    "chronology": ["section", "marker", "event"],
}
CSV = {"header": "true", "quote": '"', "escape": '"', "lineSep": "\n", "emptyValue": "", "nullValue": ""}


def track_table(tracks: DataFrame, track_type: str) -> DataFrame:
    """Rows of one track under its CSV header, in (source, document, seq) order columns."""
    header, fields = TRACK_HEADERS[track_type], TRACK_FIELDS[track_type]
    named = [F.coalesce(F.col("data")[f], F.lit("")).alias(h) for h, f in zip(header[1:], fields)]
    return tracks.where(F.col("track_type") == track_type).select(F.col("source_name").alias("source"), *named, "doc_id", "seq")


def write_tracks_csv(tracks: DataFrame, folder: str, single_file: bool = False) -> None:
    """One CSV folder per track type, globally sorted; one file only when asked (K-01).

    Each type is sampled for its sort and then sorted, so the rows are written once and read eight times.
    """
    tracks = written(tracks, "tracks")
    for kind in TRACK_HEADERS:
        rows = track_table(tracks, kind).orderBy("source", "doc_id", "seq").drop("doc_id", "seq")
        if single_file:
            rows = rows.coalesce(1)
        rows.write.mode("overwrite").options(**CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(f"{folder}/{kind}")


def read_tracks_csv(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = ", ".join(f"`{h}` string" for h in TRACK_HEADERS[kind]) + ", `_bad` string"
    return spark.read.schema(schema).options(
        **CSV, multiLine="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema="true",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(f"{folder}/{kind}")


def validate_widths(spark: SparkSession, folder: str, kind: str) -> int:
    """Column count of a written track; rows of another width are an error, an empty one is 0 (K-02)."""
    counts = read_tracks_csv(spark, folder, kind).agg(F.count("*").alias("n"), F.count("_bad").alias("bad"), F.count("source")).first()
    if counts["bad"]:
        raise ValueError(f"{kind}: {counts['bad']} rows of the wrong width")
    return len(TRACK_HEADERS[kind]) if counts["n"] else 0


def incremental_asset_plan(src: DataFrame, dst: DataFrame) -> DataFrame:
    """write when missing or different, skip when equal, keep what only the destination has (K-04)."""
    there = dst.select("path", F.col("sha256").alias("__have"))
    rows = src.select("path", "sha256").join(there, "path", "full")
    action = (
        F.when(F.col("sha256").isNull(), "keep").when(F.col("__have").isNull() | (F.col("__have") != F.col("sha256")), "write").otherwise("skip")
    )
    return rows.select("path", F.coalesce("sha256", "__have").alias("sha256"), action.alias("action"))


def upsert_manifest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Same name updates and keeps its id; other names are created (K-05). Ids of new rows come from ``new``."""
    known = existing.groupBy("name").agg(F.min("file_id").alias("__id"))
    rows = new.join(known, "name", "left")
    return rows.select(
        "name", F.coalesce("__id", "file_id").alias("file_id"), F.when(F.col("__id").isNull(), "created").otherwise("updated").alias("action")
    )


def catalogue_json(entries: DataFrame) -> DataFrame:
    """Ordered catalogue entries as JSON lines (K-06)."""
    fields = [c for c in entries.columns if c not in ("rank", "doc_id")]
    return entries.select("rank", F.to_json(F.struct(*fields)).alias("line"))


def xml_escape(c: Column) -> Column:
    return tx.html_escape(c)


def sitemap(entries: DataFrame, base_url: str, home_lastmod: str = "", per_file: int = 50_000) -> DataFrame:
    """Complete sitemap files of at most ``per_file`` addresses (the format's own limit): part, xml (K-07).

    The home page comes first in part 0; entries without an address are left out.
    """
    url, last = tx.strip(F.col("url")), tx.strip(F.coalesce("published", F.lit("")))
    stamp = F.when(last != "", F.concat(F.lit("    <lastmod>"), xml_escape(last), F.lit("</lastmod>\n"))).otherwise("")
    one = F.concat(
        F.lit("  <url>\n    <loc>"), xml_escape(url), F.lit("</loc>\n"), stamp, F.lit("    <changefreq>yearly</changefreq>\n  </url>\n")
    )
    rows = entries.where(url != "").select("rank", one.alias("xml"))
    home = f"  <url>\n    <loc>{base_url.rstrip('/')}/index.html</loc>\n"
    home += f"    <lastmod>{home_lastmod}</lastmod>\n" if home_lastmod else ""
    home += "    <changefreq>monthly</changefreq>\n    <priority>1.0</priority>\n  </url>\n"
    first = entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(home).alias("xml"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    parts = rows.unionByName(first).groupBy(F.floor(F.col("rank") / per_file).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "xml")))["xml"].alias("items")
    )
    return parts.select("part", F.concat(F.lit(head), F.array_join("items", ""), F.lit("</urlset>\n")).alias("xml"))


def llms_txt(entries: DataFrame, title: str, welcome: str = "") -> DataFrame:
    """Site index as ordered text rows, the heading as rank 0 (K-08)."""
    url, years, about = tx.strip(F.col("url")), tx.strip(F.col("years")), tx.strip(F.col("description"))
    name = F.coalesce(F.nullif(tx.strip(F.col("title")), F.lit("")), "stem")
    line = F.concat(
        F.lit("- ["), name, F.lit("]("), url, F.lit(")"), F.when(years != "", F.concat(F.lit(" — "), years)).otherwise(""),
        F.when(about != "", F.concat(F.lit("\n  "), about)).otherwise(""),
    )
    head = "\n".join([f"# {title}", "", *([welcome.strip(), ""] if welcome else []), "## Documents", ""])
    first = entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(head).alias("text"))
    return first.unionByName(entries.where(url != "").select("rank", line.alias("text")))


def series_parts(entries: DataFrame) -> DataFrame:
    """One hasPart object per entry, ordered, safe inside a script element (K-09)."""
    span = F.translate(F.coalesce("years", F.lit("")), "–—", "//")
    part = F.struct(
        F.lit("Article").alias("@type"), F.col("url").alias("@id"), F.col("title").alias("name"), F.col("url").alias("url"),
        F.col("published").alias("datePublished"), span.alias("temporalCoverage"),
    )
    return entries.select("rank", F.replace(F.to_json(part), F.lit("</"), F.lit("<\\/")).alias("part"))


def series_jsonld(entries: DataFrame, base_url: str, title: str, description: str, author: str) -> DataFrame:
    """The series object as ordered text rows: opening, one row per part, closing (K-09)."""
    import json

    home = f"{base_url.rstrip('/')}/index.html"
    head = {
        "@context": "https://schema.org", "@type": "CreativeWorkSeries", "@id": f"{home}#collection", "name": title, "url": home,
        "description": description.strip(), "creator": {"@type": "Person", "@id": f"{home}#author", "name": author or "Author"},
    }
    opening = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1].replace("</", "<\\/") + ',"hasPart":['
    top = entries.agg(F.max("rank").alias("top")).scalar()
    parts = series_parts(entries).select("rank", F.concat(F.when(F.col("rank") > 1, ",").otherwise(""), "part").alias("text"))
    one = entries.sparkSession.range(1)
    ends = one.select(F.lit(0).cast("long").alias("rank"), F.lit('<script type="application/ld+json">' + opening).alias("text")).unionByName(
        one.select((F.coalesce(top, F.lit(0)) + 1).alias("rank"), F.lit("]}</script>").alias("text"))
    )
    return parts.unionByName(ends)


def article_jsonld(docs: DataFrame) -> DataFrame:
    """Stored JSON-LD with headline, description and url refreshed where not blank (K-10).

    ``docs``: doc_id, jsonld (map of field to JSON text), title, meta_description, standfirst, canonical_url.
    """
    fresh = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    news = F.filter(
        F.array(
            F.struct(F.lit("headline").alias("key"), quoted(fresh("title")).alias("value")),
            F.struct(F.lit("description").alias("key"), quoted(F.coalesce(fresh("meta_description"), fresh("standfirst"))).alias("value")),
            F.struct(F.lit("url").alias("key"), quoted(fresh("canonical_url")).alias("value")),
        ),
        lambda e: e["value"].isNotNull() & (e["value"] != "null"),
    )
    default = F.create_map(
        F.lit("@context"), F.lit('"https://schema.org"'), F.lit("@type"), F.lit('"Article"'), F.lit("inLanguage"), F.lit('"en"')
    )
    stored = F.when(F.size(F.coalesce("jsonld", F.create_map().cast("map<string,string>"))) > 0, F.col("jsonld")).otherwise(default)
    fresh_map = F.map_from_entries(news)
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh_map, k)), fresh_map)
    body = F.array_join(F.transform(F.sort_array(F.map_entries(merged)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return docs.select("doc_id", F.concat(F.lit('<script type="application/ld+json">{'), body, F.lit("}</script>")).alias("script"))


def corpus_author(docs: DataFrame, default: str) -> DataFrame:
    """JSON-LD author name of the first document, else the default (F-31)."""
    name = F.get_json_object("jsonld", "$.author.name")
    first = docs.agg(F.min_by(F.struct(name.alias("n")), "doc_id").alias("a"))
    return first.select(F.coalesce(F.nullif(F.col("a.n"), F.lit("")), F.lit(default)).alias("author"))
