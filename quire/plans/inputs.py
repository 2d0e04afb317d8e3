"""Block, log and catalogue tables derived from the corpus tables, in Spark and in SQL.

The corpus documents carry plain lines only, so block kinds are assigned by a
fixed rule on the line length; the SQL text states the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.sources.tables import as_runs, paragraphs

# Upper length bound, block type, heading level.
KINDS = (
    (30, "heading", 2),
    (60, "heading", 3),
    (80, "image", None),
    (100, "quote", None),
    (120, "bulletListItem", None),
    (140, "numberedListItem", None),
    (155, "footnote", None),
    (170, "narrative", None),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return paragraphs(table(spark, sf, "documents"), sep="\n", keep=keep)


def _pick(index: int):
    col = None
    n = F.length("text")
    for bound, *values in KINDS:
        value = F.lit(values[index])
        col = F.when(n <= bound, value) if col is None else col.when(n <= bound, value)
    return col


def typed(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Block rows: doc_id, pos, block_id, type, level, text, runs, props."""
    rows = lines(spark, sf, *keep).withColumns(
        {"type": F.coalesce(_pick(0), F.lit("paragraph")), "level": _pick(1).cast("int")}
    )
    image, note = F.col("type") == "image", F.col("type") == "footnote"
    props = (
        F.when(image, F.create_map(F.lit("asset_id"), F.sha2("text", 256), F.lit("caption"), F.col("text")))
        .when(note, F.create_map(F.lit("marker"), F.length("text").cast("string"), F.lit("text"), F.col("text")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return rows.select(
        "doc_id",
        "pos",
        F.concat_ws("-", "doc_id", "pos").alias("block_id"),
        F.lit(None).cast("int").alias("parent_pos"),
        F.lit(0).alias("depth"),
        "type",
        "level",
        F.when(image | note, "").otherwise(F.col("text")).alias("text"),
        F.when(image | note, F.array().cast(as_runs_type())).otherwise(as_runs(F.col("text"))).alias("runs"),
        props.alias("props"),
        *keep,
    )


def as_runs_type():
    from pyspark.sql import types as T

    from quire.sources.tables import RUN

    return T.ArrayType(RUN)


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest-draft rows: doc_id, pos, kind (h1/h2/h3/p/image), text, image (content id)."""
    n = F.length("text")
    kind = (
        F.when(n <= 15, "h1").when(n <= 40, "h2").when(n <= 60, "h3").when(n <= 100, "image").otherwise("p")
    )
    rows = lines(spark, sf).withColumn("kind", kind)
    image = F.col("kind") == "image"
    return rows.select(
        "doc_id",
        "pos",
        "kind",
        F.when(~image, F.col("text")).alias("text"),
        F.when(image, F.sha2("text", 256)).alias("image"),
    )


_blank = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {_blank})"


SQL_WORDS = f"'{tx.WORD}'"
SQL_BLANK = f"'{tx.BLANK}+'"


def sql_count_words(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {SQL_WORDS})) AS BIGINT)"


def sql_norm_key(expr: str) -> str:
    folded = f"replace(replace(replace(lower({sql_strip(expr)}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"
    return f"regexp_replace({folded}, {SQL_BLANK}, ' ', 'g')"


SQL_LINES = f"""
split_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
lines AS (
  SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
         {sql_strip('t')} AS text
  FROM split_lines WHERE {sql_strip('t')} <> '')"""

_case = " ".join(f"WHEN length(text) <= {b} THEN '{t}'" for b, t, _ in KINDS)
_level = " ".join(f"WHEN length(text) <= {b} THEN {lv}" for b, _, lv in KINDS if lv)

SQL_TYPED = f"""{SQL_LINES},
kinds AS (
  SELECT *, CASE {_case} ELSE 'paragraph' END AS type, CASE {_level} END AS level, text AS line FROM lines),
typed AS (
  SELECT doc_id, lang, source, pos, doc_id || '-' || pos AS block_id, type, level, line,
         CASE WHEN type IN ('image', 'footnote') THEN '' ELSE line END AS text,
         CASE WHEN type = 'image' THEN sha256(line) END AS asset_id,
         CASE WHEN type = 'image' THEN line END AS caption,
         CASE WHEN type = 'footnote' THEN CAST(length(line) AS VARCHAR) END AS marker
  FROM kinds)"""

SQL_DRAFTS = f"""{SQL_LINES},
dk AS (
  SELECT doc_id, pos, text AS line, CASE WHEN length(text) <= 15 THEN 'h1' WHEN length(text) <= 40 THEN 'h2'
         WHEN length(text) <= 60 THEN 'h3' WHEN length(text) <= 100 THEN 'image' ELSE 'p' END AS kind FROM lines),
drafts AS (
  SELECT doc_id, pos, kind, CASE WHEN kind <> 'image' THEN line END AS text,
         CASE WHEN kind = 'image' THEN sha256(line) END AS image FROM dk)"""
