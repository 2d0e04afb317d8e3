"""Groups, targets, catalogue, badges, versions and set checks over library rows derived from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import assets as az
from quire.operators import library as lb
from quire.operators import versions as vs
from quire.plans.inputs import SQL_LINES, SQL_TYPED, lines, sql_norm_key, table, typed
from quire.plans.registry import check
from quire.session import written
from quire.plans.text_checks import _time_sql
from quire.sources import sinks as sk


def library(spark, sf):
    """Orders as library documents; a third of them belong to no group."""
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate").cast("string")
    key = F.col("o_orderkey").cast("string")
    loose = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.when(F.col("o_orderstatus") == "O", year).otherwise("n"), F.lit("-"), key).alias("slug"),
        F.concat(F.col("o_orderpriority"), F.lit(" ß "), key).alias("title"),
        F.when(F.col("o_orderpriority") == "5-LOW", "homepage").otherwise("memoir").alias("kind"),
        F.when(~loose, F.col("o_custkey")).alias("group_id"),
        F.month("o_orderdate").cast("long").alias("group_position"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("updated_at"),
        F.date_add("o_orderdate", 30).cast("timestamp").alias("created_at"),
        F.col("o_totalprice").cast("long").alias("words"),
        F.sha2(key, 256).alias("content_hash"),
        "o_orderstatus", "o_orderpriority", "o_custkey",
    )


SQL_LIB = """lib AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'n' END || '-' || o_orderkey AS slug,
  o_orderpriority || ' ß ' || o_orderkey AS title, CASE WHEN o_orderpriority = '5-LOW' THEN 'homepage' ELSE 'memoir' END AS kind,
  CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS group_id, month(o_orderdate) AS group_position,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS updated_at, o_orderdate + INTERVAL 30 DAY AS created_at,
  CAST(trunc(o_totalprice) AS BIGINT) AS words, sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash, o_orderstatus, o_orderpriority, o_custkey,
  CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate) ELSE 9999 END AS start FROM orders)"""


def groups(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("group_id"), F.col("c_name").alias("name"), (F.lit(1_000_000) - F.col("c_custkey")).cast("long").alias("sort_order")
    )


SQL_GROUPS = "grp AS (SELECT c_custkey AS group_id, c_name AS name, 1000000 - c_custkey AS sort_order FROM customer)"


def targets(spark, sf):
    """Regions as targets: one drive, one local folder, the rest pages."""
    kind = F.when(F.col("r_regionkey") == 0, "drive").when(F.col("r_regionkey") == 1, "local").otherwise("pages")
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("target_id"), F.col("r_name").alias("target_name"), kind.alias("target_kind"),
        F.concat(F.lit("https://e.org/"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("base_url"),
    )


SQL_TARGETS = """tgt AS (SELECT CAST(r_regionkey AS BIGINT) AS target_id, r_name AS target_name, CASE r_regionkey WHEN 0 THEN 'drive' WHEN 1 THEN 'local' ELSE 'pages' END AS target_kind FROM region)"""


def states(spark, sf, once=False):
    """(sync, snapshots): every line item is a publish of its order to one of five targets; returned ones have an old hash.

    ``once`` writes the line items of a slot out, for jobs that read both tables several times.
    """
    slot = (F.col("l_linenumber") - 1) % 5
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", slot.alias("slot")).agg(
        *[F.max(c).alias(c) for c in ("l_linestatus", "l_returnflag", "l_shipdate")]
    )
    li = written(li, "states") if once else li
    ident = F.col("l_orderkey") * 10 + F.col("slot") + 1
    key = F.col("l_orderkey").cast("string")
    rows = li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("slot").cast("long").alias("target_id"),
        F.when(F.col("l_linestatus") == "O", ident).alias("snapshot_id"), ident.alias("any_id"),
        F.when(F.col("l_returnflag") == "N", "PUBLISHED").otherwise("UNPUBLISHED").alias("status"), F.col("l_shipdate").alias("published_at"),
        F.sha2(F.when(F.col("l_returnflag") == "R", F.concat(key, F.lit("x"))).otherwise(key), 256).alias("content_hash"),
    )
    snaps = rows.select(F.col("any_id").alias("snapshot_id"), "doc_id", "content_hash", F.col("published_at").alias("created_at"))
    return rows.select("doc_id", "target_id", "snapshot_id", "status", "published_at"), snaps


SQL_STATES = """st AS (SELECT l_orderkey AS doc_id, CAST(slot AS BIGINT) AS target_id, CASE WHEN l_linestatus = 'O' THEN l_orderkey * 10 + slot + 1 END AS snapshot_id,
  l_orderkey * 10 + slot + 1 AS any_id, CASE WHEN l_returnflag = 'N' THEN 'PUBLISHED' ELSE 'UNPUBLISHED' END AS status, l_shipdate AS published_at,
  sha256(CAST(l_orderkey AS VARCHAR) || CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '' END) AS content_hash FROM (SELECT l_orderkey, (l_linenumber - 1) % 5 AS slot, max(l_linestatus) AS l_linestatus, max(l_returnflag) AS l_returnflag, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL))"""

_MATRIX = f"""{SQL_LIB}, {SQL_TARGETS}, {SQL_STATES},
mx AS (SELECT l.doc_id, t.target_id, coalesce(s.status, 'NEVER_PUBLISHED') AS status,
  s.snapshot_id IS NULL OR s.content_hash <> l.content_hash AS dirty, s.published_at, s.snapshot_id
  FROM lib l CROSS JOIN tgt t LEFT JOIN st s ON s.doc_id = l.doc_id AND s.target_id = t.target_id WHERE NOT (l.kind = 'homepage' AND t.target_kind = 'drive'))"""


@check("dirty_matrix", f"WITH {_MATRIX} SELECT * FROM mx")
def dirty(spark, sf):
    sync, snaps = states(spark, sf)
    return lb.dirty_matrix(library(spark, sf), targets(spark, sf), sync, snaps)


@check(
    "target_pill",
    f"WITH {_MATRIX} SELECT doc_id, target_id, CASE WHEN status <> 'PUBLISHED' THEN 'unpublished' WHEN dirty THEN 'changes' ELSE 'live' END AS pill FROM mx",
)
def _(spark, sf):
    return dirty(spark, sf).select("doc_id", "target_id", lb.target_pill(F.col("status"), F.col("dirty")).alias("pill"))


@check(
    "target_url",
    f"""WITH {_MATRIX}, pub AS (SELECT l_orderkey AS doc_id, l_partkey * 10 + l_linenumber AS change_id, CASE WHEN l_suppkey > 50 THEN 'AFRICA' ELSE 'ASIA' END AS target_name,
      CASE WHEN l_returnflag = 'A' THEN '' ELSE 'f' || l_partkey END AS file_id FROM (SELECT l_orderkey, l_partkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)),
    newest AS (SELECT * FROM pub QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY change_id DESC) <= 3),
    f AS (SELECT doc_id, target_name, arg_max(file_id, change_id) AS file_id FROM newest WHERE file_id <> '' GROUP BY ALL)
    SELECT m.doc_id, m.target_id, CASE WHEN status <> 'PUBLISHED' THEN NULL WHEN target_kind = 'pages' AND kind = 'homepage' THEN 'https://e.org/' || m.target_id || '/index.html'
      WHEN target_kind = 'pages' THEN 'https://e.org/' || slug WHEN target_kind = 'local' THEN '/site/' || CASE WHEN kind = 'homepage' THEN 'index' ELSE slug END || '.html'
      ELSE 'https://docs.google.com/document/d/' || f.file_id || '/edit' END AS url
    FROM mx m JOIN lib l ON l.doc_id = m.doc_id JOIN tgt t ON t.target_id = m.target_id LEFT JOIN f ON f.doc_id = m.doc_id AND f.target_name = t.target_name""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(
        F.max("l_suppkey").alias("l_suppkey"), F.max("l_returnflag").alias("l_returnflag")
    )
    log = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("change_id"), F.lit("publish").alias("kind"),
        F.when(F.col("l_suppkey") > 50, "AFRICA").otherwise("ASIA").alias("target_name"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat(F.lit("f"), F.col("l_partkey").cast("string"))).alias("file_id"),
    )
    docs = library(spark, sf).withColumn("canonical_url", F.concat(F.lit("https://e.org/"), "slug"))
    return lb.target_url(dirty(spark, sf), docs, targets(spark, sf), log, recent=3)


def summary(spark, sf):
    """Library rows with the array of target states."""
    per = dirty(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("target_id", "status", "dirty")).alias("targets"))
    docs = library(spark, sf).withColumns(
        {"pending_review": F.when(F.col("o_orderpriority") == "3-MEDIUM", F.col("group_position")).otherwise(0), "date_confirmed": F.col("o_orderstatus") != "P"}
    )
    return docs.join(per, "doc_id")


_SUM = f"""{_MATRIX}, sm AS (SELECT l.*, CASE WHEN o_orderpriority = '3-MEDIUM' THEN group_position ELSE 0 END AS pending_review, o_orderstatus <> 'P' AS date_confirmed, a.any_dirty, a.any_pub
  FROM lib l JOIN (SELECT doc_id, bool_or(dirty) AS any_dirty, bool_or(status = 'PUBLISHED') AS any_pub FROM mx GROUP BY doc_id) a ON a.doc_id = l.doc_id),
nd AS (SELECT *, pending_review > 0 OR NOT date_confirmed OR any_dirty AS need FROM sm)"""


@check("needs_attention", f"WITH {_SUM} SELECT doc_id, need FROM nd")
def _(spark, sf):
    return summary(spark, sf).select("doc_id", lb.needs_attention().alias("need"))


for _f, _w in (("pending", "any_dirty"), ("unpublished", "NOT any_pub"), ("clean", "any_pub AND NOT any_dirty"), ("all", "true")):

    @check(f"status_filter_{_f}", f"WITH {_SUM} SELECT doc_id FROM sm WHERE {_w}")
    def _(spark, sf, _f=_f):
        return lb.status_filter(summary(spark, sf), _f).select("doc_id")


_FOLD = "replace(lower(title), 'ß', 'ss')"
for _mode, _order in (
    ("manual", "group_position, doc_id"), ("date_range", "start, slug"), ("title_az", f"{_FOLD}, doc_id"),
    ("last_updated", "coalesce(updated_at, created_at) DESC, doc_id"),
):

    @check(
        f"sort_members_{_mode}",
        f"WITH {SQL_LIB} SELECT group_id, doc_id, row_number() OVER (PARTITION BY group_id ORDER BY {_order}) AS rank FROM lib",
    )
    def _(spark, sf, _mode=_mode):
        return lb.ranked(library(spark, sf), _mode, ["group_id"], ["group_id", "doc_id"])


@check(
    "sort_library_attention",
    f"""WITH {_SUM} SELECT doc_id, row_number() OVER (ORDER BY need DESC, CASE WHEN need THEN pending_review END DESC NULLS LAST,
    CASE WHEN need THEN {_FOLD} END NULLS LAST, start, slug, doc_id) AS rank FROM nd""",
)
def _(spark, sf):
    return lb.ranked(summary(spark, sf), "attention", [], ["doc_id"])


@check("sort_library_date_range", f"WITH {SQL_LIB} SELECT doc_id, row_number() OVER (ORDER BY start, slug, doc_id) AS rank FROM lib")
def _(spark, sf):
    return lb.ranked(library(spark, sf), lb.effective_mode("manual", "status"), [], ["doc_id"])


@check(
    "bucket_group",
    f"""WITH {SQL_LIB}, {SQL_GROUPS} SELECT 'group-' || g.group_id AS bucket, count(l.doc_id) AS docs FROM grp g LEFT JOIN lib l ON l.group_id = g.group_id GROUP BY ALL
    UNION ALL SELECT 'ungrouped', count(*) FILTER (group_id IS NULL) FROM lib""",
)
def _(spark, sf):
    return lb.bucket_sizes(library(spark, sf), "group", groups(spark, sf))


@check(
    "bucket_status",
    f"WITH {_SUM} SELECT CASE WHEN any_dirty THEN 'dirty' WHEN any_pub THEN 'clean' ELSE 'never' END AS bucket, count(*) AS docs FROM sm GROUP BY ALL",
)
def _(spark, sf):
    return lb.bucket_sizes(summary(spark, sf), "status")


@check("bucket_format", "SELECT 'format-' || CASE p_brand WHEN 'Brand#11' THEN 'HTML' ELSE p_brand END AS bucket, count(*) AS docs FROM part GROUP BY ALL")
def _(spark, sf):
    kind = F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).otherwise("")
    return lb.bucket_sizes(table(spark, sf, "part").select(kind.alias("source_type")), "format")


@check(
    "library_summary",
    f"""WITH {SQL_TYPED} SELECT d.doc_id, count(t.pos) AS figures, count(t.pos) FILTER (asset_id < '8') AS sketched, count(t.pos) FILTER (asset_id >= '4') AS pending_review,
    CASE d.lang WHEN 'fr' THEN 'HTML' WHEN 'de' THEN 'PDF' ELSE 'DOCX' END AS source_type, d.lang <> 'es' AS date_confirmed
    FROM documents d LEFT JOIN (SELECT * FROM typed WHERE type = 'image') t ON t.doc_id = d.doc_id GROUP BY ALL""",
)
def _(spark, sf):
    a = F.col("props")["asset_id"]
    extra = F.create_map(F.lit("sketch_id"), F.when(a < "8", a).otherwise(""), F.lit("approval"), F.when(a >= "4", "pending").otherwise("approved"))
    rows = typed(spark, sf).withColumn("props", F.when(F.col("type") == "image", F.map_concat("props", extra)).otherwise(F.col("props")))
    file = F.when(F.col("lang") == "de", "a.b/x.pdf").when(F.col("lang") != "fr", "x.y.Docx")
    meta = F.create_map(F.lit("source_file"), file, F.lit("date_confirmed"), F.when(F.col("lang") == "es", "false"))
    return lb.library_summary(table(spark, sf, "documents").select("doc_id", meta.alias("meta")), rows).drop("meta")


@check(
    "group_members",
    f"""WITH {SQL_LIB}, {SQL_GROUPS} SELECT l.group_id, g.name, row_number() OVER (PARTITION BY l.group_id ORDER BY group_position, doc_id) AS rank, doc_id, slug, title,
    CASE WHEN o_orderstatus = 'O' THEN 'about ' || slug ELSE '' END AS description FROM lib l JOIN grp g ON g.group_id = l.group_id""",
)
def _(spark, sf):
    docs = library(spark, sf)
    catalogue = docs.where(F.col("o_orderstatus") == "O").select(F.col("slug").alias("stem"), F.concat(F.lit("about "), "slug").alias("description"))
    return lb.group_members(groups(spark, sf), docs, catalogue)


@check(
    "timeline",
    f"""WITH {SQL_LIB}, {SQL_GROUPS} SELECT g.sort_order, g.name, row_number() OVER (PARTITION BY l.group_id ORDER BY start, slug) AS rank, doc_id, title,
    replace({_time_sql('words')}, ' read', '') AS reading_time FROM lib l JOIN grp g ON g.group_id = l.group_id WHERE kind = 'memoir'""",
)
def timeline(spark, sf):
    docs = library(spark, sf)
    return lb.timeline(groups(spark, sf), docs.drop("words"), docs.select("doc_id", "words"))


@check(
    "normalise_positions",
    f"WITH {SQL_LIB} SELECT doc_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY group_position, doc_id) - 1 AS group_position FROM lib",
)
def _(spark, sf):
    return lb.normalise_positions(library(spark, sf))


@check(
    "append_to_bucket",
    f"""WITH {SQL_LIB}, mv AS (SELECT doc_id, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_custkey + 1 END AS to_group FROM lib WHERE o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED')),
    rm AS (SELECT m.* FROM mv m JOIN lib l ON l.doc_id = m.doc_id WHERE m.to_group IS DISTINCT FROM l.group_id),
    tp AS (SELECT group_id, max(group_position) AS top FROM lib GROUP BY group_id),
    pl AS (SELECT rm.doc_id, to_group, coalesce(top, -1) + row_number() OVER (PARTITION BY to_group ORDER BY rm.doc_id) AS p FROM rm LEFT JOIN tp ON tp.group_id IS NOT DISTINCT FROM to_group)
    SELECT l.doc_id, CASE WHEN pl.doc_id IS NULL THEN l.group_id ELSE to_group END AS group_id, CAST(CASE WHEN pl.doc_id IS NULL THEN group_position ELSE p END AS BIGINT) AS group_position
    FROM lib l LEFT JOIN pl ON pl.doc_id = l.doc_id""",
)
def _(spark, sf):
    docs = library(spark, sf)
    moves = docs.where(F.col("o_orderpriority").isin("2-HIGH", "4-NOT SPECIFIED")).select(
        "doc_id", F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_custkey") + 1).alias("to_group"), F.col("doc_id").alias("seq")
    )
    return lb.append_to_bucket(docs, moves)


@check(
    "dissolve_groups",
    f"""WITH {SQL_LIB}, {SQL_GROUPS}, gone AS (SELECT c_custkey AS group_id FROM customer WHERE c_mktsegment = 'BUILDING'),
    mv AS (SELECT l.doc_id, row_number() OVER (ORDER BY g.sort_order, g.group_id, group_position, doc_id) AS rn FROM lib l JOIN grp g ON g.group_id = l.group_id WHERE g.group_id IN (SELECT group_id FROM gone))
    SELECT l.doc_id, CASE WHEN rn IS NULL THEN group_id END AS group_id, CAST(CASE WHEN rn IS NULL THEN group_position ELSE (SELECT max(group_position) FROM lib WHERE group_id IS NULL) + rn END AS BIGINT) AS group_position
    FROM lib l LEFT JOIN mv ON mv.doc_id = l.doc_id""",
)
def _(spark, sf):
    gone = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("group_id"))
    return lb.dissolve_groups(library(spark, sf), groups(spark, sf), gone)


@check("reorder_groups", "SELECT c_custkey AS group_id, c_name AS name, c_custkey * 2 AS sort_order FROM customer")
def _(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), (F.col("c_custkey") * 2).alias("index"))
    return lb.reorder_groups(groups(spark, sf), wanted)[0]


@check(
    "exact_membership",
    """WITH a AS (SELECT c_custkey AS k, 1 AS n FROM customer), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'unexpected' WHEN b.k IS NULL THEN 'missing' ELSE 'repeated' END AS problem
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR b.n > 1""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return lb.exact_membership(a, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@check("bootstrap_group", f"""WITH {SQL_LIB} SELECT doc_id, CAST(1 AS BIGINT) AS group_id, row_number() OVER (ORDER BY start, slug) - 1 AS group_position FROM lib WHERE kind = 'memoir'
    UNION ALL SELECT doc_id, group_id, CAST(group_position AS BIGINT) FROM lib WHERE kind <> 'memoir'""")
def _(spark, sf):
    return lb.bootstrap_group(library(spark, sf), groups(spark, sf).where(F.col("group_id") < 0))


# ---------------------------------------------------------------- catalogue


def _entries(spark, sf):
    docs = library(spark, sf).withColumn(
        "meta",
        F.create_map(
            F.lit("title"), F.when(F.col("o_orderstatus") != "P", F.col("title")), F.lit("year_display"),
            F.when(F.col("o_orderstatus") == "O", F.substring("slug", 1, 4)).otherwise(""),
            F.lit("canonical_url"), F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("https://e.org/?a&b="), "slug")).otherwise(" "),
            F.lit("date_published"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        ),
    )
    imported = docs.where(F.col("o_orderpriority") == "2-HIGH").select(
        F.col("slug").alias("stem"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("on </"), "slug")).otherwise("").alias("description"),
        F.lit("human").alias("source"), F.lit(None).cast("boolean").alias("needs_description"), F.lit("2001").alias("published"),
    )
    sync, _ = states(spark, sf)
    return lb.build_entries(docs.drop("words"), docs.select("doc_id", "words"), imported, sync.where((F.col("target_id") == 2) & F.col("published_at").isNotNull()))


_ENT = f"""{SQL_LIB}, {SQL_STATES}, ent AS (SELECT l.doc_id, slug AS stem, CASE WHEN o_orderstatus <> 'P' THEN title ELSE title END AS title,
  CASE WHEN o_orderstatus = 'O' THEN substring(slug, 1, 4) ELSE '' END AS years,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'on </' || slug ELSE '' END AS description,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN 'https://e.org/?a&b=' || slug ELSE ' ' END AS url, '' AS subtitle,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'human' ELSE 'generated' END AS source,
  NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'O') AS needs_description, words AS word_count,
  CASE WHEN s.published_at IS NOT NULL AND s.published_at <> created_at THEN strftime(s.published_at, '%Y-%m-%dT%H:%M:%S+00:00') WHEN o_orderpriority = '2-HIGH' THEN '2001'
    ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') END AS published, row_number() OVER (ORDER BY start, slug) AS rank
  FROM lib l LEFT JOIN st s ON s.doc_id = l.doc_id AND s.target_id = 2 WHERE kind = 'memoir')"""


@check("build_entries", f"WITH {_ENT} SELECT * FROM ent")
def _(spark, sf):
    return _entries(spark, sf)


@check(
    "nav_prev_next",
    f"""WITH {_ENT} SELECT stem, lag(url) OVER w AS prev_url, lag(title) OVER w AS prev_title, lead(url) OVER w AS next_url, lead(title) OVER w AS next_title
    FROM ent WINDOW w AS (ORDER BY rank)""",
)
def _(spark, sf):
    return lb.nav_prev_next(_entries(spark, sf))


@check(
    "sitemap",
    f"""WITH {_ENT}, u AS (SELECT rank, '  <url>' || chr(10) || '    <loc>' || replace(url, '&', '&amp;') || '</loc>' || chr(10) || '    <lastmod>' || published || '</lastmod>' || chr(10)
      || '    <changefreq>yearly</changefreq>' || chr(10) || '  </url>' || chr(10) AS x FROM ent WHERE trim(url) <> ''
      UNION ALL SELECT 0, '  <url>' || chr(10) || '    <loc>https://e.org/index.html</loc>' || chr(10) || '    <changefreq>monthly</changefreq>' || chr(10) || '    <priority>1.0</priority>' || chr(10) || '  </url>' || chr(10))
    SELECT rank // 1000 AS part, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg(x, '' ORDER BY rank) || '</urlset>' || chr(10) AS xml FROM u GROUP BY ALL""",
)
def _(spark, sf):
    return sk.sitemap(_entries(spark, sf), "https://e.org/", per_file=1000)


@check(
    "llms_txt",
    f"""WITH {_ENT} SELECT rank, '- [' || trim(title) || '](' || url || ')' || CASE WHEN years <> '' THEN ' — ' || years ELSE '' END || CASE WHEN description <> '' THEN chr(10) || '  ' || description ELSE '' END AS text
    FROM ent WHERE trim(url) <> '' UNION ALL SELECT 0, '# The Archive' || chr(10) || chr(10) || 'Hello' || chr(10) || chr(10) || '## Documents' || chr(10)""",
)
def _(spark, sf):
    return sk.llms_txt(_entries(spark, sf), "The Archive", " Hello ")


@check(
    "catalogue_json",
    f"""WITH {_ENT} SELECT rank, CAST(json_object('stem', stem, 'title', title, 'years', years, 'description', description, 'url', url, 'subtitle', subtitle, 'source', source,
    'needs_description', needs_description, 'word_count', word_count, 'published', published) AS VARCHAR) AS line FROM ent""",
)
def _(spark, sf):
    return sk.catalogue_json(_entries(spark, sf))


@check(
    "series_jsonld",
    f"""WITH {_ENT} SELECT rank, CASE WHEN rank > 1 THEN ',' ELSE '' END || replace(CAST(json_object('@type', 'Article', '@id', url, 'name', title, 'url', url, 'datePublished', published, 'temporalCoverage', years) AS VARCHAR), '</', '<\\/') AS text FROM ent
    UNION ALL SELECT 0, '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"CreativeWorkSeries","@id":"https://e.org/index.html#collection","name":"A <\\/b>","url":"https://e.org/index.html","description":"d","creator":{{"@type":"Person","@id":"https://e.org/index.html#author","name":"Author"}},"hasPart":['
    UNION ALL SELECT (SELECT max(rank) FROM ent) + 1, ']}}</script>'""",
)
def _(spark, sf):
    return sk.series_jsonld(_entries(spark, sf), "https://e.org", "A </b>", " d ", "")


@check(
    "article_jsonld",
    """SELECT c_custkey AS doc_id, '<script type="application/ld+json">{' || CASE WHEN c_mktsegment = 'BUILDING' THEN '"@context":"https://schema.org","@type":"Article",' ELSE '"@type":"Book",' END
    || CASE WHEN c_acctbal > 0 THEN '"description":"say \\"' || c_mktsegment || '\\"",' ELSE '"description":"s' || c_custkey || '",' END || '"headline":"' || c_name || '"'
    || CASE WHEN c_mktsegment = 'BUILDING' THEN ',"inLanguage":"en"' ELSE ',"url":"old"' END || '}</script>' AS script FROM customer""",
)
def _(spark, sf):
    stored = F.when(F.col("c_mktsegment") != "BUILDING", F.create_map(F.lit("@type"), F.lit('"Book"'), F.lit("headline"), F.lit('"x"'), F.lit("url"), F.lit('"old"')))
    docs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc_id"), stored.alias("jsonld"), F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit('say "'), "c_mktsegment", F.lit('"'))).alias("meta_description"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("standfirst"), F.lit("").alias("canonical_url"),
    )
    return sk.article_jsonld(docs)


@check("corpus_author", "SELECT arg_min(CASE WHEN c_acctbal > 0 THEN c_name ELSE 'Nobody' END, c_custkey) AS author FROM customer")
def _(spark, sf):
    name = F.to_json(F.struct(F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name")).alias("author")))
    return sk.corpus_author(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), name.alias("jsonld")), "Nobody")


@check(
    "label_resolution",
    "SELECT doc_id, CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN source ELSE 'Notes' END AS label FROM documents",
)
def _(spark, sf):
    meta = F.when(F.col("lang") == "fr", F.create_map(F.lit("narrative_label"), F.lit(""))).when(
        F.col("lang") == "de", F.create_map(F.lit("narrative_label"), F.col("source"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return lb.label_resolution(table(spark, sf, "documents").select("doc_id", meta.alias("meta")), F.lit("Notes"))


for _name, _blank in (("or", True), ("get", False)):

    @check(
        f"settings_with_defaults_{_name}",
        f"""WITH d AS (SELECT c_name AS key, c_mktsegment AS value FROM customer), s AS (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key, s_name AS k2,
        CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END AS value FROM supplier)
        SELECT coalesce(d.key, s.key) AS key, coalesce({"nullif(s.value, '')" if _blank else "s.value"}, d.value) AS value FROM d FULL JOIN s ON d.key = s.key""",
    )
    def _(spark, sf, _blank=_blank):
        defaults = table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
        key = F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
        stored = table(spark, sf, "supplier").select(key.alias("key"), F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")).alias("value"))
        return lb.settings_with_defaults(stored, defaults, _blank)


# ---------------------------------------------------------------- badges and quality


@check(
    "polish_badge",
    """WITH r AS (SELECT user_id, max(ts) AS run_at FROM events WHERE event_type = 'signup' GROUP BY ALL)
    SELECT e.event_id, CASE WHEN r.run_at IS NULL THEN 'never-run' WHEN value < 20 THEN 'flagged' WHEN r.run_at <= e.ts THEN 'stale' ELSE 'polished' END AS badge,
    CASE WHEN e.event_type = 'view' THEN 'never-run' WHEN e.event_type = 'error' THEN 'flagged' WHEN value < 50 THEN 'stale' ELSE 'generated' END AS report,
    CASE WHEN r.run_at IS NULL THEN false WHEN e.event_type = 'view' THEN true ELSE r.run_at > e.ts END AS push
    FROM events e LEFT JOIN r ON r.user_id = e.user_id""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    runs = e.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.max("ts").alias("run_at"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "view", "done")
    return e.join(runs, "user_id", "left").select(
        "event_id", lb.polish_badge(F.col("run_at"), F.when(F.col("value") < 20, 1).otherwise(0), F.col("ts")).alias("badge"),
        lb.report_badge(status, F.col("value") < 50).alias("report"),
        lb.needs_push(F.col("run_at"), F.when(F.col("event_type") != "view", F.col("ts"))).alias("push"),
    )


_QUALITY = """q AS (SELECT p_partkey, lower(replace(p_name, ' ', '-')) || CASE WHEN p_size > 40 THEN '!' ELSE '' END AS slug, '#' || substring(md5(p_name), 1, CASE WHEN p_size < 5 THEN 5 ELSE 6 END) AS color,
  CASE WHEN p_brand LIKE 'Brand#1%' THEN '  ' ELSE p_type END AS name FROM part),
f AS (SELECT *, concat_ws(',', CASE WHEN p_slug_bad THEN 'slug' END, CASE WHEN p_color_bad THEN 'color' END, CASE WHEN name = '  ' THEN 'name' END) AS failed
  FROM (SELECT *, NOT regexp_matches(slug, '^[a-z0-9][a-z0-9_-]*$') AS p_slug_bad, NOT regexp_matches(color, '^#[0-9a-fA-F]{6}$') AS p_color_bad FROM q))"""


def _quality(spark, sf):
    p = table(spark, sf, "part")
    slug = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.when(F.col("p_size") > 40, "!").otherwise(""))
    color = F.concat(F.lit("#"), F.substring(F.md5("p_name"), F.lit(1), F.when(F.col("p_size") < 5, 5).otherwise(6)))
    name = F.when(F.col("p_brand").startswith("Brand#1"), "  ").otherwise(F.col("p_type"))
    return lb.quality_split(p.select("p_partkey", slug.alias("slug"), color.alias("color"), name.alias("name")), "slug", "color", "name")


@check("quality_good", f"WITH {_QUALITY} SELECT p_partkey, slug, color, name FROM f WHERE failed = ''")
def _(spark, sf):
    return _quality(spark, sf)[0]


@check("quality_rejected", f"WITH {_QUALITY} SELECT p_partkey, slug, color, name, failed FROM f WHERE failed <> ''")
def _(spark, sf):
    return _quality(spark, sf)[1].withColumn("failed", F.array_join("failed", ","))


@check("excluded_keys", "SELECT source AS stem, doc_id FROM documents WHERE source NOT IN ('src1', 'src3', 'src5')")
def _(spark, sf):
    denied = table(spark, sf, "documents").select(F.col("source").alias("stem")).where(F.col("source").isin("src1", "src3", "src5"))
    return lb.excluded_keys(table(spark, sf, "documents").select(F.col("source").alias("stem"), "doc_id"), denied)


# ---------------------------------------------------------------- change log


@check("recent_changes", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def _(spark, sf):
    return lb.recent_changes(table(spark, sf, "events").select("user_id", "event_id", "event_type"), 20, "user_id", "event_id")


def change_log(e):
    """Events (a table or a stream) as log rows: users are documents, signups and clicks are polish edits."""
    n = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("change_id"), F.when(F.col("event_type") == "view", "publish").otherwise("edit").alias("kind"),
        F.concat(F.when(F.col("event_type").isin("signup", "click"), "polish").otherwise("edit"), F.lit(" by "), "event_type").alias("summary"),
        (n + 20).alias("polishable"), n.alias("blocks_changed"), (n % 30).alias("flagged"), F.when(F.col("value") > 100, F.col("ts")).alias("resolved_at"), F.col("ts").alias("created_at"),
    )


SQL_LOG = """lg AS (SELECT user_id AS doc_id, event_id AS change_id, CASE event_type WHEN 'view' THEN 'publish' ELSE 'edit' END AS kind,
  CASE WHEN event_type IN ('signup', 'click') THEN 'polish' ELSE 'edit' END || ' by ' || event_type AS summary, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, ts FROM events),
lt AS (SELECT * FROM lg WHERE kind = 'edit' AND summary LIKE 'polish%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY change_id DESC) = 1)"""


@check(
    "latest_run",
    f"""WITH {SQL_LOG} SELECT doc_id, change_id, summary, k + 20 AS polishable, k AS blocks_changed, CAST(k % 30 AS INTEGER) AS flagged, greatest(0, 20 - k % 30) AS blocks_unchanged, ts AS ran_at FROM lt""",
)
def _(spark, sf):
    return lb.latest_run(change_log(table(spark, sf, "events")), "polish").drop("kind", "resolved_at", "created_at")


@check(
    "resolve_flags",
    f"""WITH {SQL_LOG} SELECT doc_id, change_id, CASE WHEN change_id IN (SELECT change_id FROM lt) THEN 0 ELSE CAST(k % 30 AS INTEGER) END AS flagged,
    CASE WHEN change_id IN (SELECT change_id FROM lt) THEN TIMESTAMP '2024-03-01' WHEN value > 100 THEN ts END AS resolved_at FROM lg""",
)
def _(spark, sf):
    out = lb.resolve_flags(change_log(table(spark, sf, "events")), "polish", F.lit("2024-03-01").cast("timestamp"))
    return out.select("doc_id", "change_id", "flagged", "resolved_at")


@check(
    "run_metrics",
    """WITH v AS (SELECT l_orderkey AS doc_id, count(*) AS polishable, count(*) FILTER (l_returnflag = 'A') AS cleaned, count(*) FILTER (l_returnflag = 'R') AS flagged FROM lineitem GROUP BY ALL)
    SELECT v.doc_id, polishable, cleaned, flagged, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS failed_chunks, greatest(0, polishable - cleaned - flagged) AS unchanged
    FROM v LEFT JOIN orders ON o_orderkey = v.doc_id""",
)
def _(spark, sf):
    action = F.when(F.col("l_returnflag") == "A", "apply").when(F.col("l_returnflag") == "R", "flag").otherwise("unchanged")
    verdicts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), action.alias("action"))
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") != "P").alias("ok"))
    out = lb.run_metrics(verdicts, chunks)
    return out.withColumn("failed_chunks", F.col("failed_chunks").cast("int"))


@check(
    "job_summary",
    "SELECT user_id AS job, count(*) AS total, count(*) FILTER (event_type <> 'view') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL",
)
def _(spark, sf):
    return lb.job_summary(job_results(table(spark, sf, "events")))


def job_results(events):
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").otherwise("ok")
    return events.select(F.col("user_id").alias("job"), state.alias("state"))


# ---------------------------------------------------------------- years, slugs


@check(
    "densest_year_window",
    """WITH c AS (SELECT o_custkey AS doc_id, year(o_orderdate) AS y, count(*) AS w FROM orders GROUP BY ALL),
    s AS (SELECT a.doc_id, a.y AS lo, max(b.y) AS hi, sum(b.w) AS t FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.y BETWEEN a.y AND a.y + 2 GROUP BY ALL)
    SELECT doc_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, lo) = 1""",
)
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("weight"))
    return lb.densest_year_window(counts, span=2)


@check(
    "year_counts",
    """WITH t AS (SELECT doc_id, 'x' || text || ' ' || (1840 + length(text) % 300) || 'a' || (1900 + doc_id % 90) || '1 ' || (2000 + n_chars % 50) AS text, '1953_' || (1950 + doc_id % 8) || '_1953.pdf' AS name FROM documents),
    y AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS y, 1 AS w FROM t UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(name, '[0-9]+'))), 5 FROM t)
    SELECT doc_id, CAST(y AS INTEGER) AS year, CAST(sum(w) AS BIGINT) AS weight FROM y WHERE regexp_matches(y, '^(1[89]|20|21)[0-9][0-9]$') AND CAST(y AS INTEGER) BETWEEN 1850 AND 2025 GROUP BY ALL""",
)
def _(spark, sf):
    n = F.length("text")
    text = F.concat(
        F.lit("x"), F.col("text"), F.lit(" "), (n % 300 + 1840).cast("string"), F.lit("a"), (F.col("doc_id") % 90 + 1900).cast("string"), F.lit("1 "),
        (F.col("n_chars") % 50 + 2000).cast("string"),
    )
    docs = table(spark, sf, "documents")
    files = docs.select("doc_id", F.concat(F.lit("1953_"), (F.col("doc_id") % 8 + 1950).cast("string"), F.lit("_1953.pdf")).alias("name"))
    return lb.year_counts(docs.select("doc_id", text.alias("text")), files, max_year=2025)


_SLUG = f"""trim(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace({sql_norm_key('text')}, 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'đ', 'd'), 'ł', 'l'), 'ð', 'd')), '[^a-z0-9]+', '-', 'g'), '-')"""


@check(
    "unique_slugs",
    f"""WITH RECURSIVE {SQL_LINES}, nm AS (SELECT doc_id * 100000 + pos AS doc_id, pos, length(text) < 30 AS short, {_SLUG} AS base FROM lines),
    q AS (SELECT *, regexp_replace(base, '(-[0-9]+)+$', '') AS root FROM nm),
    old AS (SELECT regexp_replace(slug, '(-[0-9]+)+$', '') AS root, list(DISTINCT slug) AS used FROM (SELECT base || '-' || (pos % 4 + 2) AS slug FROM nm WHERE short) GROUP BY ALL),
    o AS (SELECT doc_id, root, base, row_number() OVER (PARTITION BY root ORDER BY doc_id) AS k FROM q),
    pick AS (SELECT o.doc_id, o.root, o.k, coalesce(old.used, CAST([] AS VARCHAR[])) AS used, o.base,
        list_filter(range(1, len(coalesce(old.used, CAST([] AS VARCHAR[]))) + 2), lambda n: NOT list_contains(coalesce(old.used, CAST([] AS VARCHAR[])), CASE WHEN n = 1 THEN o.base ELSE o.base || '-' || n END))[1] AS n
      FROM o LEFT JOIN old ON old.root = o.root WHERE k = 1
      UNION ALL SELECT o.doc_id, o.root, o.k, list_append(p.used, CASE WHEN p.n = 1 THEN p.base ELSE p.base || '-' || p.n END), o.base,
        list_filter(range(1, len(p.used) + 3), lambda n: NOT list_contains(list_append(p.used, CASE WHEN p.n = 1 THEN p.base ELSE p.base || '-' || p.n END), CASE WHEN n = 1 THEN o.base ELSE o.base || '-' || n END))[1]
      FROM pick p JOIN o ON o.root = p.root AND o.k = p.k + 1)
    SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM pick""",
)
def _(spark, sf):
    rows = lines(spark, sf)
    docs = rows.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("doc_id"), F.col("text").alias("title"), F.lit("").alias("date_stem"))
    existing = rows.where(F.length("text") < 30).select(F.concat(tx.slugify(F.col("text")), F.lit("-"), (F.col("pos") % 4 + 2).cast("string")).alias("slug"))
    return lb.unique_slugs(docs, existing)


# ---------------------------------------------------------------- versions


def _hashes(spark, sf, changed: bool):
    text = F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(F.col("text")) if changed else F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("content_hash"))


@check(
    "log_edits",
    "SELECT doc_id, 'edit' AS kind, sha256(text) AS hash_before, sha256(text || '!') AS hash_after FROM documents WHERE lang = 'en'",
)
def _(spark, sf):
    return vs.log_edits(_hashes(spark, sf, False), _hashes(spark, sf, True))


@check(
    "stale_reports",
    "SELECT doc_id, sha256(text) AS content_hash, lang = 'en' AS stale FROM documents",
)
def _(spark, sf):
    return vs.stale_reports(_hashes(spark, sf, False), _hashes(spark, sf, True))


@check(
    "snapshot",
    """SELECT row_number() OVER (ORDER BY doc_id) + (SELECT max(event_id) FROM events) AS snapshot_id, doc_id, sha256(text) AS content_hash, 'first' AS note, TIMESTAMP '2024-01-01' AS created_at FROM documents""",
)
def _(spark, sf):
    history = table(spark, sf, "events").select(F.col("event_id").alias("snapshot_id"))
    docs = table(spark, sf, "documents")
    return vs.snapshot(docs, _hashes(spark, sf, False), history, "first", F.lit("2024-01-01").cast("timestamp"))


@check("snapshot_history", "SELECT user_id AS doc_id, event_id AS snapshot_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events")
def _(spark, sf):
    return vs.snapshot_history(table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("snapshot_id")))


@check(
    "mark_published",
    f"""WITH {SQL_STATES}, ev AS (SELECT o_orderkey AS doc_id, CAST(2 AS BIGINT) AS target_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey END AS s, o_orderdate AS t FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT coalesce(st.doc_id, ev.doc_id) AS doc_id, coalesce(st.target_id, ev.target_id) AS target_id, CASE WHEN ev.doc_id IS NULL THEN snapshot_id ELSE s END AS snapshot_id,
    CASE WHEN ev.doc_id IS NULL THEN status WHEN s IS NULL THEN 'UNPUBLISHED' ELSE 'PUBLISHED' END AS status, CASE WHEN ev.doc_id IS NULL THEN published_at WHEN s IS NOT NULL THEN t END AS published_at
    FROM st FULL JOIN ev ON st.doc_id = ev.doc_id AND st.target_id = ev.target_id""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") != "5-LOW")
    events = o.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(2).cast("long").alias("target_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("snapshot_id"), F.col("o_orderdate").alias("at"),
    )
    return vs.mark_published(states(spark, sf)[0], events)


_ROLL = f"{SQL_STATES}, ch AS (SELECT o_orderkey AS doc_id, (o_orderkey + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 10 + 1 AS snapshot_id FROM orders), j AS (SELECT ch.*, st.doc_id AS owner, content_hash FROM ch LEFT JOIN st ON st.any_id = ch.snapshot_id)"


def _rolled(spark, sf):
    o = table(spark, sf, "orders")
    choice = o.select(F.col("o_orderkey").alias("doc_id"), ((F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) * 10 + 1).alias("snapshot_id"))
    return vs.rollback(choice, states(spark, sf)[1])


@check("rollback", f"WITH {_ROLL} SELECT doc_id, snapshot_id, content_hash FROM j WHERE owner = doc_id")
def _(spark, sf):
    return _rolled(spark, sf)[0]


@check("rollback_rejected", f"WITH {_ROLL} SELECT doc_id, snapshot_id FROM j WHERE owner IS DISTINCT FROM doc_id")
def _(spark, sf):
    return _rolled(spark, sf)[1]


def _renamed(spark, sf):
    docs = library(spark, sf).select("doc_id", "slug", F.concat(F.lit("https://e.org/"), "slug", F.lit(".html")).alias("canonical_url"))
    o = library(spark, sf).where(F.col("o_orderstatus") != "P")
    new = F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("n-"), (F.col("doc_id") + 1).cast("string"))).otherwise(F.concat(F.lit("r-"), F.col("doc_id").cast("string")))
    return vs.rename_keys(docs, o.select(F.col("slug").alias("old_slug"), new.alias("new_slug")))


_REN = f"""{SQL_LIB}, mp AS (SELECT slug AS old_slug, CASE WHEN o_orderpriority = '2-HIGH' THEN 'n-' || (doc_id + 1) ELSE 'r-' || doc_id END AS new_slug FROM lib WHERE o_orderstatus <> 'P'),
rj AS (SELECT * FROM mp WHERE new_slug IN (SELECT slug FROM lib))"""


@check(
    "rename_keys",
    f"""WITH {_REN} SELECT doc_id, coalesce(new_slug, slug) AS slug, 'https://e.org/' || coalesce(new_slug, slug) || '.html' AS canonical_url FROM lib LEFT JOIN (SELECT * FROM mp WHERE old_slug NOT IN (SELECT old_slug FROM rj)) m ON m.old_slug = slug""",
)
def _(spark, sf):
    return _renamed(spark, sf)["docs"]


@check("rename_keys_rejected", f"WITH {_REN} SELECT * FROM rj")
def _(spark, sf):
    return _renamed(spark, sf)["rejected"]


@check("cascade_delete", "SELECT l_orderkey AS doc_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    gone = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return vs.cascade_delete({"rows": rows}, gone)["rows"]


@check(
    "replace_by_key",
    """SELECT l_orderkey AS doc_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_linenumber > 2""",
)
def _(spark, sf):
    keys = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_quantity")
    new = rows.where(F.col("l_linenumber") > 2).withColumn("l_quantity", -F.col("l_quantity"))
    return vs.replace_by_key(vs.replace_by_key(rows, new, keys), new, keys)


@check("once_only", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def _(spark, sf):
    markers = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, "convert").otherwise("other").alias("job"))
    return vs.once_only("convert", table(spark, sf, "documents").select("doc_id"), markers)


@check(
    "effective_hash",
    f"""WITH {SQL_TYPED}, p AS (SELECT DISTINCT doc_id FROM typed WHERE type = 'narrative')
    SELECT d.doc_id, CASE WHEN p.doc_id IS NULL AND lang <> 'fr' THEN sha256(text) ELSE sha256(concat_ws(chr(28), sha256(text), CASE WHEN p.doc_id IS NOT NULL THEN 'label' || chr(28) || source END,
      CASE WHEN lang = 'fr' THEN 'home' || chr(28) || 'fp' END)) END AS content_hash FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("kind", F.when(F.col("lang") == "fr", "homepage").otherwise("memoir"))
    labels = docs.select("doc_id", F.col("source").alias("label"))
    return vs.effective_hash(docs, _hashes(spark, sf, False), typed(spark, sf), labels, F.lit("fp"))


@check(
    "listing_fingerprint",
    f"""WITH {SQL_LIB}, {SQL_GROUPS}, t AS (SELECT g.sort_order, row_number() OVER (PARTITION BY l.group_id ORDER BY start, slug) AS rank, g.name, title, replace({_time_sql('words')}, ' read', '') AS rt
      FROM lib l JOIN grp g ON g.group_id = l.group_id WHERE kind = 'memoir'),
    h AS (SELECT sort_order, rank, sha256(concat_ws(chr(28), name, CAST(rank AS VARCHAR), title, rt)) AS h FROM t),
    s AS (SELECT sort_order, rank // 4096 AS seg, sha256(string_agg(h, '' ORDER BY rank)) AS h FROM h GROUP BY ALL),
    w AS (SELECT sort_order // 4096 AS top, sha256(string_agg(h, '' ORDER BY sort_order, seg)) AS h FROM s GROUP BY ALL)
    SELECT sha256(string_agg(h, '' ORDER BY top)) AS fingerprint FROM w""",
)
def _(spark, sf):
    return vs.listing_fingerprint(timeline(spark, sf))


# ---------------------------------------------------------------- assets


def _figs(spark, sf):
    """Figures: every line of a document, its content id and a small props map."""
    rows = lines(spark, sf, "lang")
    return rows.select("doc_id", "pos", F.sha2("text", 256).alias("sha256"), F.create_map(F.lit("at"), F.col("pos").cast("string")).alias("props"), "lang")


_FIG = f"{SQL_LINES}, fig AS (SELECT doc_id, lang, pos, sha256(text) AS sha256 FROM lines)"


@check(
    "carry_over",
    f"""WITH {_FIG}, old AS (SELECT doc_id, sha256, min(pos) AS p FROM fig WHERE sha256 < '8' GROUP BY ALL)
    SELECT f.doc_id, f.pos, f.sha256, old.p IS NOT NULL AS matched, CAST(coalesce(old.p, f.pos) AS VARCHAR) AS at FROM fig f LEFT JOIN old ON old.doc_id = f.doc_id AND old.sha256 = f.sha256""",
)
def _(spark, sf):
    figs = _figs(spark, sf).drop("lang")
    out = az.carry_over(figs, figs.where(F.col("sha256") < "8"))
    return out.select("doc_id", "pos", "sha256", "matched", F.col("props")["at"].alias("at"))


@check(
    "carry_over_counts",
    f"WITH {_FIG} SELECT doc_id, count(*) FILTER (sha256 < '8') AS matched, count(*) FILTER (sha256 >= '8') AS new FROM fig GROUP BY doc_id",
)
def _(spark, sf):
    figs = _figs(spark, sf).drop("lang")
    return az.carry_over_counts(az.carry_over(figs, figs.where(F.col("sha256") < "8")))


def _manifest(spark, sf):
    a = F.col("sha256")
    return _figs(spark, sf).where(a < "c").groupBy("doc_id", a.alias("source_sha256")).agg(F.min("pos").alias("p")).select(
        "doc_id", "source_sha256", F.when(F.col("source_sha256") < "6", "named").otherwise("").alias("caption"), (F.col("source_sha256") > "3").alias("included"),
        (F.col("source_sha256") > "a").alias("use_original"), F.when(F.col("p") > 2, F.reverse("source_sha256")).alias("sketch_sha256"), (F.col("p") > 5).alias("approved"),
    )


@check(
    "seed_from_manifest",
    f"""WITH {_FIG}, m AS (SELECT doc_id, sha256, min(pos) AS p FROM fig WHERE sha256 < 'c' GROUP BY ALL),
    j AS (SELECT f.doc_id, f.pos, f.sha256, m.p, CASE WHEN f.pos < 1 THEN 'kept' WHEN m.p IS NULL THEN 'unmatched' WHEN m.p <= 2 THEN 'file missing' ELSE 'seeded' END AS reason FROM fig f LEFT JOIN m ON m.doc_id = f.doc_id AND m.sha256 = f.sha256)
    SELECT doc_id, pos, sha256 AS asset_id, CASE WHEN reason = 'seeded' THEN reverse(sha256) WHEN pos < 1 THEN 's' ELSE '' END AS sketch_id,
      CASE WHEN reason = 'seeded' AND sha256 < '6' THEN 'named' ELSE 'c' END AS caption, CASE WHEN reason = 'seeded' AND sha256 < '6' THEN 'named' ELSE 'a' END AS alt_text,
      CASE WHEN reason <> 'seeded' THEN '' WHEN p > 5 THEN 'approved' ELSE 'pending' END AS approval,
      CASE WHEN reason <> 'seeded' THEN '' WHEN sha256 <= '3' THEN 'omit' WHEN sha256 > 'a' THEN 'original' ELSE '' END AS safe_mode, reason FROM j""",
)
def _(spark, sf):
    figs = _figs(spark, sf).select(
        "doc_id", "pos", F.col("sha256").alias("asset_id"), F.when(F.col("pos") < 1, "s").otherwise("").alias("sketch_id"), F.lit("c").alias("caption"),
        F.lit("a").alias("alt_text"), F.lit("").alias("approval"), F.lit("").alias("safe_mode"),
    )
    return az.seed_from_manifest(figs, _manifest(spark, sf))


@check(
    "match_rate",
    f"""WITH {_FIG}, u AS (SELECT DISTINCT doc_id, sha256 FROM fig), c AS (SELECT doc_id, count(*) AS e, count(*) FILTER (sha256 < 'c') AS m FROM u GROUP BY doc_id)
    SELECT d.doc_id, coalesce(e, 0) AS extracted, coalesce(m, 0) AS matched, coalesce(m, 0) || '/' || coalesce(e, 0) AS rate FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
)
def _(spark, sf):
    return az.match_rate(_figs(spark, sf), _manifest(spark, sf), table(spark, sf, "documents"))


@check("unmatched", f"WITH {_FIG} SELECT DISTINCT doc_id, sha256 FROM fig WHERE sha256 >= 'c'")
def _(spark, sf):
    return az.unmatched(_figs(spark, sf), _manifest(spark, sf))


@check(
    "manifest_lookup",
    f"""WITH {SQL_LIB}, m AS (SELECT CASE WHEN o_orderstatus = 'P' THEN slug ELSE 'other-' || doc_id END AS stem, 'file-' || o_custkey AS source_file, 'p/' || doc_id AS path FROM lib WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
    bs AS (SELECT stem, min(path) AS path FROM m GROUP BY stem), bf AS (SELECT source_file, min(path) AS path FROM m GROUP BY source_file)
    SELECT l.doc_id, coalesce(bs.path, bf.path) AS path, CASE WHEN bs.path IS NOT NULL THEN 'slug' WHEN bf.path IS NOT NULL THEN 'source_file' ELSE 'none' END AS via
    FROM lib l LEFT JOIN bs ON bs.stem = l.slug LEFT JOIN bf ON bf.source_file = 'file-' || l.o_custkey""",
)
def _(spark, sf):
    docs = library(spark, sf).withColumn("source_file", F.concat(F.lit("file-"), F.col("o_custkey").cast("string")))
    stem = F.when(F.col("o_orderstatus") == "P", F.col("slug")).otherwise(F.concat(F.lit("other-"), F.col("doc_id").cast("string")))
    manifests = docs.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        stem.alias("stem"), "source_file", F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path")
    )
    return az.manifest_lookup(docs, manifests)


@check(
    "cache_lookup",
    """SELECT doc_id, lang AS prompt, source AS model, sha256(text || lang || source) AS key, CASE WHEN lang = 'de' THEN min(doc_id) OVER (PARTITION BY text, lang, source) END AS result,
    CASE WHEN lang = 'de' THEN 'hit' ELSE 'pending' END AS state FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("prompt"), F.col("source").alias("model"))
    cache = docs.where(F.col("prompt") == "de").select(az.cache_key(F.col("content"), F.col("prompt"), F.col("model")).alias("key"), F.col("doc_id").alias("result"))
    return az.cache_lookup(docs, cache)


@check(
    "apply_updates",
    f"""WITH {SQL_TYPED} SELECT doc_id, pos, CASE WHEN asset_id < '8' THEN 'new' ELSE caption END AS caption, asset_id, 'x' AS extra FROM typed WHERE type = 'image'""",
)
def _(spark, sf):
    rows = typed(spark, sf)
    a = F.col("props")["asset_id"]
    same = F.create_map(F.lit("asset_id"), a, F.lit("extra"), F.lit("x"), F.lit("caption"), F.when(a < "8", "new").otherwise(F.col("props")["caption"]))
    updates = rows.where(F.col("type") == "image").select("block_id", same.alias("props"))
    unchanged = rows.where(F.col("type") == "footnote").select("block_id", F.map_filter("props", lambda k, v: k == "marker").alias("props"))
    out = az.apply_updates(rows, updates.unionByName(unchanged))
    return out.select("doc_id", "pos", *[F.col("props")[k].alias(k) for k in ("caption", "asset_id", "extra")])


@check(
    "coverage",
    """WITH i AS (SELECT l_orderkey AS doc_id, 'figure-' || (l_linenumber % 4) || '-original.png' AS src, l_linenumber % 4 AS n FROM lineitem),
    s AS (SELECT l_orderkey AS doc_id, max(CASE WHEN l_returnflag = 'A' AND l_linenumber % 4 = n.n THEN 1 ELSE 0 END) AS sk, max(CASE WHEN l_returnflag = 'N' AND l_linenumber % 4 = n.n THEN 1 ELSE 0 END) AS og, n.n FROM lineitem,
      (SELECT unnest([0, 1, 2, 3]) AS n) n GROUP BY ALL),
    u AS (SELECT DISTINCT doc_id, n FROM i), g AS (SELECT u.doc_id, count(*) AS unique_images, CAST(sum(og) AS BIGINT) AS originals_found, CAST(sum(sk) AS BIGINT) AS sketches_found, string_agg(CASE WHEN sk = 0 THEN CAST(u.n AS VARCHAR) END, ',' ORDER BY u.n) AS gaps FROM u JOIN s ON s.doc_id = u.doc_id AND s.n = u.n GROUP BY ALL)
    SELECT o_orderkey AS doc_id, (SELECT count(*) FROM i WHERE i.doc_id = o_orderkey) AS figure_blocks, coalesce(unique_images, 0) AS unique_images, coalesce(originals_found, 0) AS originals_found, coalesce(sketches_found, 0) AS sketches_found,
    coalesce(gaps, '') AS gaps, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS source_sha_ok FROM orders LEFT JOIN g ON g.doc_id = o_orderkey""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    n = (F.col("l_linenumber") % 4).cast("string")
    images = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("figure-"), n, F.lit("-original.png")).alias("src"))
    name = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("figure-"), n, F.lit("-silhouette.webp"))).when(
        F.col("l_returnflag") == "N", F.concat(F.lit("figure-"), n, F.lit("-original.png"))
    )
    files = li.select(F.col("l_orderkey").alias("doc_id"), name.alias("name")).where(F.col("name").isNotNull())
    status = F.col("o_orderstatus")
    sources = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("a").alias("expected_sha"), F.when(status == "F", "a").when(status == "O", "b").alias("found_sha"))
    out = az.coverage(images, files, sources)
    return out.withColumn("gaps", F.array_join("sketch_gaps", ",")).drop("sketch_gaps")


@check(
    "incremental_asset_plan",
    """WITH s AS (SELECT 'p' || l_partkey AS path, sha256(max(l_returnflag || l_linestatus)) AS h FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL), d AS (SELECT 'p' || l_partkey AS path, sha256(max(l_returnflag || l_linestatus)) AS h FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
    SELECT coalesce(s.path, d.path) AS path, coalesce(s.h, d.h) AS sha256, CASE WHEN s.path IS NULL THEN 'keep' WHEN d.path IS NULL OR d.h <> s.h THEN 'write' ELSE 'skip' END AS action FROM s FULL JOIN d ON s.path = d.path""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path")
    src = li.where(F.col("l_returnflag") != "A").groupBy(path).agg(F.sha2(F.max(F.concat("l_returnflag", "l_linestatus")), 256).alias("sha256"))
    dst = li.where(F.col("l_linestatus") == "O").groupBy(path).agg(F.sha2(F.max(F.concat("l_returnflag", "l_linestatus")), 256).alias("sha256"))
    return sk.incremental_asset_plan(src, dst)


@check(
    "upsert_manifest",
    """SELECT c_name AS name, CASE WHEN s_suppkey IS NULL THEN 'new-' || c_custkey ELSE 'old-' || s_suppkey END AS file_id, CASE WHEN s_suppkey IS NULL THEN 'created' ELSE 'updated' END AS action
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def _(spark, sf):
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    new = table(spark, sf, "customer").select("c_name", name("c_custkey").alias("name"), F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("file_id"))
    old = table(spark, sf, "supplier").select(name("s_suppkey").alias("name"), F.concat(F.lit("old-"), F.col("s_suppkey").cast("string")).alias("file_id"))
    out = sk.upsert_manifest(old, new)
    return out.join(new.select("name", "c_name"), "name").select(F.col("c_name").alias("name"), "file_id", "action")
