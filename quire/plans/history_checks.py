"""Three versions of every document in a content store: saving, comparing, rolling back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import store as st
from quire.plans.inputs import KINDS, SQL_LINES, _pick, lines, table
from quire.plans.registry import check
from quire.session import fresh_folder

_kind = " ".join(f"WHEN length(text) <= {b} THEN '{t}'" for b, t, _ in KINDS)


def versions(spark, sf):
    """Lines as they are; every third document with its second line revised; then even ones without their first line,
    and every fifth with a line more."""
    kind = F.coalesce(_pick(0), F.lit("paragraph"))
    first = lines(spark, sf).select("doc_id", "pos", kind.alias("type"), "text")
    edited = (F.col("doc_id") % 3 == 0) & (F.col("pos") == 1)
    second = first.withColumn("text", F.when(edited, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    more = table(spark, sf, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(1_000_000).alias("pos"), F.lit("paragraph").alias("type"), F.lit("closing words").alias("text"))
    third = second.where("not (doc_id % 2 = 0 and pos = 0)").unionByName(more)
    return first, second, third


SQL_VERSIONS = f"""{SQL_LINES},
v1 AS (SELECT doc_id, pos, CASE {_kind} ELSE 'paragraph' END AS type, text FROM lines),
v2 AS (SELECT doc_id, pos, type, text || CASE WHEN doc_id % 3 = 0 AND pos = 1 THEN ' revised' ELSE '' END AS text FROM v1),
v3 AS (SELECT * FROM v2 WHERE NOT (doc_id % 2 = 0 AND pos = 0) UNION ALL SELECT doc_id, 1000000, 'paragraph', 'closing words' FROM documents WHERE doc_id % 5 = 0),
d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rank, count(*) OVER () AS total FROM documents)"""


def stored(spark, sf):
    """(store, third version's blocks, documents): every version saved with a meta that names it."""
    store = st.ContentStore(spark, fresh_folder(spark, "store"), "type string, text string")
    docs = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang").alias("meta"))
    at = F.lit("2024-01-01").cast("timestamp")
    found = versions(spark, sf)
    for k, blocks in enumerate(found, 1):
        hashed = docs.select("doc_id", F.map_concat("meta", F.create_map(F.lit("version"), F.lit(str(k)))).alias("meta"), F.sha2(F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")), 256).alias("content_hash"))
        store.save(blocks, hashed, f"v{k}", at)
    return store, found[-1], docs


def rolled_back(spark, sf):
    """Every document back to one of the three versions; every seventh names the snapshot of another document."""
    store, blocks, docs = stored(spark, sf)
    note = F.concat(F.lit("v"), (F.col("doc_id") % 3 + 1).cast("string"))
    choice = store.snapshots().where(F.col("note") == note).select("doc_id", (F.col("snapshot_id") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("snapshot_id"))
    return store.rollback(choice, blocks, docs, F.lit("2024-02-01").cast("timestamp"))


_BACK = f"""{SQL_VERSIONS},
w AS (SELECT doc_id, rank, total, lang, doc_id % 3 + 1 AS version, doc_id % 7 = 0 AS other FROM d),
b AS (
  SELECT v.*, 1 AS version FROM v1 v UNION ALL SELECT v.*, 2 FROM v2 v UNION ALL SELECT v.*, 3 FROM v3 v),
kept AS (
  SELECT b.doc_id, CAST(CASE WHEN other THEN b.pos ELSE row_number() OVER (PARTITION BY b.doc_id ORDER BY b.pos) - 1 END AS INTEGER) AS pos, type, text
  FROM b JOIN w ON b.doc_id = w.doc_id AND b.version = CASE WHEN other THEN 3 ELSE w.version END)"""


@check("rollback_content", f"WITH {_BACK} SELECT doc_id, pos, type, md5(text) AS text_md5 FROM kept")
def rollback_content(spark, sf):
    return rolled_back(spark, sf)["blocks"].select("doc_id", "pos", "type", F.md5("text").alias("text_md5"))


@check(
    "rollback_meta",
    f"""WITH {_BACK} SELECT w.doc_id, CASE WHEN other THEN NULL ELSE CAST(version AS VARCHAR) END AS version, lang,
  CASE WHEN other THEN NULL ELSE 'rolled back to snapshot ' || ((version - 1) * total + rank) END AS summary,
  CASE WHEN other THEN NULL ELSE sha256(version || ':' || w.doc_id) END AS content_hash, other AS rejected FROM w""",
)
def rollback_meta(spark, sf):
    out = rolled_back(spark, sf)
    docs = out["docs"].select("doc_id", F.col("meta")["version"].alias("version"), F.col("meta")["lang"].alias("lang"))
    rejected = out["rejected"].select("doc_id", F.lit(True).alias("rejected"))
    return docs.join(out["log"].select("doc_id", "summary", "content_hash"), "doc_id", "left").join(rejected, "doc_id", "left").na.fill({"rejected": False})


@check(
    "snapshot_changes",
    f"""WITH {SQL_VERSIONS}, s AS (SELECT doc_id, type, text, -1 AS n FROM v1 UNION ALL SELECT doc_id, type, text, 1 FROM v3)
  SELECT doc_id, type, md5(text) AS text_md5, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY doc_id, type, text HAVING sum(n) <> 0""",
)
def snapshot_changes(spark, sf):
    store, _, _ = stored(spark, sf)
    snapshots = store.snapshots()
    out = store.changes(snapshots.where("note = 'v1'"), snapshots.where("note = 'v3'"))
    return out.select("doc_id", "type", F.md5("text").alias("text_md5"), "n")


@check(
    "snapshot_content",
    f"""WITH {SQL_VERSIONS}, v AS (SELECT doc_id, 1 AS version FROM v1 UNION ALL SELECT doc_id, 2 FROM v2 UNION ALL SELECT doc_id, 3 FROM v3),
  n AS (SELECT doc_id, version, count(*) AS size FROM v GROUP BY doc_id, version)
  SELECT (k - 1) * total + rank AS snapshot_id, d.doc_id, 'v' || k AS note, coalesce(size, 0) AS size, lang FROM d CROSS JOIN range(1, 4) AS r(k) LEFT JOIN n ON n.doc_id = d.doc_id AND version = k""",
)
def snapshot_content(spark, sf):
    store, _, _ = stored(spark, sf)
    return store.snapshots().select("snapshot_id", "doc_id", "note", "size", F.col("meta")["lang"].alias("lang"))
