"""Chapters, chunks, numbering, headings, lists and linearised documents over derived block rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import linear as ln
from quire.operators import structure as st
from quire.operators.blocks import polishable
from quire.operators.ordered import prev, scan
from quire.plans.inputs import SQL_TYPED, sql_count_words, sql_norm_key, table, typed
from quire.plans.registry import check
from quire.sources.tables import as_runs

_SLUG = (
    "trim(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(" + sql_norm_key("line")
    + ", 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'đ', 'd'), 'ł', 'l'), 'ð', 'd')), '[^a-z0-9]+', '-', 'g'), '-')"
)

_LINE = """CASE type WHEN 'image' THEN '[Figure: ' || trim(caption) || ']' WHEN 'footnote' THEN '[' || marker || '] ' || line
  WHEN 'narrative' THEN '> ' || line WHEN 'quote' THEN '> ' || line WHEN 'paragraph' THEN line WHEN 'heading' THEN NULL ELSE '- ' || line END"""


@check("block_lines", f"WITH {SQL_TYPED} SELECT doc_id, pos, {_LINE} AS line FROM typed")
def _(spark, sf):
    lines = F.when(F.col("type") != "heading", st.block_lines())
    return typed(spark, sf).select("doc_id", "pos", lines.alias("line"))


@check(
    "chapters",
    f"""WITH {SQL_TYPED}, n AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ch,
      CASE WHEN level = 3 THEN '### ' || line ELSE {_LINE} END AS l FROM typed),
    g AS (SELECT doc_id, ch, max(CASE WHEN level = 2 THEN line END) AS t, string_agg(l, chr(10) ORDER BY pos) AS body,
      string_agg(CASE WHEN level = 3 THEN line END, '|' ORDER BY pos) AS sections FROM n GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ch) - 1 AS idx, coalesce(t, 'Opening') AS title, coalesce(sections, '') AS sections,
      '## ' || coalesce(t, 'Opening') || coalesce(chr(10) || body, '') AS text FROM g WHERE ch > 0 OR body IS NOT NULL""",
)
def _(spark, sf):
    return st.chapters(typed(spark, sf)).withColumn("sections", F.array_join("sections", "|"))


_PACK = f"""WITH RECURSIVE {SQL_TYPED},
pol AS (SELECT doc_id, pos, block_id, CASE WHEN type = 'heading' THEN true ELSE false END AS h, greatest(1, length(text) // 4) AS tok,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM typed WHERE type NOT IN ('image', 'footnote')),
fold AS (
  SELECT doc_id, pos, i, tok AS total, NOT h AS body, 0 AS chunk FROM pol WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.pos, p.i, CASE WHEN (p.h AND f.body) OR f.total + p.tok > 200 THEN p.tok ELSE f.total + p.tok END,
    CASE WHEN (p.h AND f.body) OR f.total + p.tok > 200 THEN NOT p.h ELSE f.body OR NOT p.h END,
    CASE WHEN (p.h AND f.body) OR f.total + p.tok > 200 THEN f.chunk + 1 ELSE f.chunk END
  FROM fold f JOIN pol p ON p.doc_id = f.doc_id AND p.i = f.i + 1)"""


@check("pack_chunks_long", f"{_PACK} SELECT doc_id, pos, chunk FROM fold")
def _(spark, sf):
    """Segments of eight rows, so that documents span many of them."""
    return st.pack_chunks(polishable(typed(spark, sf)), target=200, seg=8)


@check("pack_chunks", f"{_PACK} SELECT doc_id, pos, chunk FROM fold")
def _(spark, sf):
    return st.pack_chunks(polishable(typed(spark, sf)), target=200)


@check(
    "chunk_table",
    f"""{_PACK}, j AS (SELECT f.doc_id, f.chunk, f.pos, p.tok, lag(p.block_id) OVER (PARTITION BY f.doc_id ORDER BY f.pos) AS context FROM fold f JOIN pol p ON p.doc_id = f.doc_id AND p.i = f.i)
    SELECT doc_id, chunk, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_blocks, CAST(sum(tok) AS BIGINT) AS tokens, arg_min(coalesce(context, '-'), pos) AS context, max(tok > 400) AS oversize FROM j GROUP BY ALL""",
)
def _(spark, sf):
    return st.chunk_table(polishable(typed(spark, sf)), target=200).drop("contexts").na.fill("-", ["context"])


@check(
    "chunk_overlap",
    f"""{_PACK}, j AS (SELECT f.doc_id, f.chunk, f.pos, list(p.block_id) OVER (PARTITION BY f.doc_id ORDER BY f.pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM fold f JOIN pol p ON p.doc_id = f.doc_id AND p.i = f.i)
    SELECT doc_id, chunk, coalesce(array_to_string(arg_min(coalesce(before, []), pos), ' '), '') AS contexts FROM j GROUP BY ALL""",
)
def _(spark, sf):
    """Three blocks before each chunk as context."""
    out = st.chunk_table(polishable(typed(spark, sf)), target=200, overlap=3)
    return out.select("doc_id", "chunk", F.array_join("contexts", " ").alias("contexts"))


_FIRST = "firsts AS (SELECT doc_id, asset_id, min(pos) AS p FROM {src} GROUP BY ALL), nums AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INTEGER) AS n FROM firsts)"


@check(
    "figure_numbers",
    f"""WITH {SQL_TYPED}, img AS (SELECT doc_id, pos, CASE WHEN asset_id < '4' THEN '' ELSE asset_id END AS asset_id FROM typed WHERE type = 'image'),
    keyed AS (SELECT *, CASE WHEN asset_id = '' THEN 'row' || pos ELSE asset_id END AS k FROM img),
    firsts AS (SELECT doc_id, k, min(pos) AS p FROM keyed GROUP BY ALL), nums AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INTEGER) AS n FROM firsts)
    SELECT i.doc_id, i.pos, i.asset_id, n FROM keyed i JOIN nums m ON m.doc_id = i.doc_id AND m.k = i.k""",
)
def _(spark, sf):
    """Images whose content id starts low lose it."""
    blank = F.map_concat(F.map_filter("props", lambda k, v: k != "asset_id"), F.create_map(F.lit("asset_id"), F.lit("")))
    rows = typed(spark, sf).withColumn("props", F.when(F.col("props")["asset_id"] < "4", blank).otherwise(F.col("props")))
    return st.figure_numbers(rows)


@check(
    "bundle_numbers",
    f"""WITH {SQL_TYPED}, img AS (SELECT * FROM typed WHERE type = 'image'), {_FIRST.format(src='img')}
    SELECT doc_id, n, 'original' AS role, 'figure-' || n || '-original' || CASE WHEN asset_id < '8' THEN '.png' ELSE '.jpeg' END AS name, asset_id AS sha256 FROM nums""",
)
def _(spark, sf):
    rows = typed(spark, sf)
    ids = rows.where(F.col("type") == "image").select(F.col("props")["asset_id"].alias("sha256")).distinct()
    assets = ids.withColumn("ext", F.when(F.col("sha256") < "8", ".png").otherwise(".jpeg"))
    return st.bundle_numbers(rows, assets)


@check(
    "eligible_figures",
    f"WITH {SQL_TYPED} SELECT doc_id, pos FROM typed WHERE type = 'image' AND asset_id >= '4' AND NOT (asset_id >= '8' AND asset_id < 'c')",
)
def _(spark, sf):
    a = F.col("props")["asset_id"]
    extra = F.create_map(
        F.lit("safe_mode"), F.when(a < "2", "original").when(a < "4", "omit").otherwise(""), F.lit("sketch_id"), a,
        F.lit("approval"), F.when((a >= "8") & (a < "c"), "approved").otherwise("pending"),
    )
    rows = typed(spark, sf).withColumn("props", F.when(F.col("type") == "image", F.map_concat("props", extra)).otherwise(F.col("props")))
    return st.eligible_figures(rows).select("doc_id", "pos")


def _referring(spark, sf):
    """Paragraphs end in a note reference run numbered by their length."""
    rows = typed(spark, sf)
    ref = as_runs((F.length("text") % 30 + 130).cast("string"), fn_ref=F.lit(True))
    return rows.withColumn("runs", F.when(F.col("type") == "paragraph", F.concat("runs", ref)).otherwise(F.col("runs")))


_REF = f"""WITH {SQL_TYPED}, r AS (SELECT doc_id, pos, CAST(length(line) % 30 + 130 AS VARCHAR) AS m FROM typed WHERE type = 'paragraph'),
nt AS (SELECT DISTINCT doc_id, marker AS m FROM typed WHERE type = 'footnote'),"""


@check(
    "renumber_notes",
    f"""{_REF} f AS (SELECT r.doc_id, r.m, min(r.pos) AS p FROM r JOIN nt ON nt.doc_id = r.doc_id AND nt.m = r.m GROUP BY ALL),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS VARCHAR) AS n FROM f),
    b AS (SELECT doc_id, pos, type, CASE type WHEN 'paragraph' THEN CAST(length(line) % 30 + 130 AS VARCHAR) WHEN 'footnote' THEN marker END AS m FROM typed)
    SELECT b.doc_id, b.pos, b.type, coalesce(o.n, b.m) AS mark FROM b LEFT JOIN o ON o.doc_id = b.doc_id AND o.m = b.m""",
)
def _(spark, sf):
    out = st.renumber_notes(_referring(spark, sf))
    mark = F.when(F.col("type") == "paragraph", F.element_at("runs", -1)["text"]).when(F.col("type") == "footnote", F.col("props")["marker"])
    return out.select("doc_id", "pos", "type", mark.alias("mark"))


@check(
    "remove_footnotes",
    f"""{_REF} gone AS (SELECT doc_id, max(marker) AS m FROM typed WHERE type = 'footnote' GROUP BY doc_id),
    r2 AS (SELECT r.* FROM r ANTI JOIN gone g ON g.doc_id = r.doc_id AND g.m = r.m), n2 AS (SELECT nt.* FROM nt ANTI JOIN gone g ON g.doc_id = nt.doc_id AND g.m = nt.m),
    f AS (SELECT r2.doc_id, r2.m, min(r2.pos) AS p FROM r2 JOIN n2 ON n2.doc_id = r2.doc_id AND n2.m = r2.m GROUP BY ALL),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS VARCHAR) AS n FROM f),
    b AS (SELECT t.doc_id, pos, type, CASE WHEN type = 'paragraph' AND g.m = CAST(length(line) % 30 + 130 AS VARCHAR) THEN line
      WHEN type = 'paragraph' THEN CAST(length(line) % 30 + 130 AS VARCHAR) WHEN type = 'footnote' THEN marker END AS m FROM typed t
      LEFT JOIN gone g ON g.doc_id = t.doc_id WHERE type IN ('paragraph', 'footnote') AND (type <> 'footnote' OR marker <> g.m))
    SELECT b.doc_id, b.pos, b.type, coalesce(o.n, b.m) AS mark FROM b LEFT JOIN o ON o.doc_id = b.doc_id AND o.m = b.m""",
)
def _(spark, sf):
    rows = _referring(spark, sf)
    gone = rows.where(F.col("type") == "footnote").groupBy("doc_id").agg(F.max(F.col("props")["marker"]).alias("marker"))
    out = st.remove_footnotes(rows, gone).where(F.col("type").isin("paragraph", "footnote"))
    mark = F.when(F.col("type") == "paragraph", F.element_at("runs", -1)["text"]).otherwise(F.col("props")["marker"])
    return out.select("doc_id", "pos", "type", mark.alias("mark"))


@check(
    "next_marker",
    f"""{_REF} m AS (SELECT doc_id, CAST(m AS BIGINT) AS m FROM r UNION ALL SELECT doc_id, CAST(m AS BIGINT) FROM nt)
    SELECT d.doc_id, CAST(coalesce(max(m), 0) + 1 AS VARCHAR) AS marker FROM (SELECT DISTINCT doc_id FROM typed) d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, sf):
    return st.next_marker(_referring(spark, sf))


@check(
    "heading_anchors",
    f"""WITH {SQL_TYPED}, h AS (SELECT doc_id, pos, level, line AS text, {_SLUG} AS slug FROM typed WHERE type = 'heading'),
    n AS (SELECT *, CASE slug WHEN '' THEN 'section' ELSE slug END AS base FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS k FROM n)
    SELECT doc_id, pos, level, text, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS anchor FROM r""",
)
def _(spark, sf):
    return st.heading_anchors(st.toc_headings(typed(spark, sf)))


@check(
    "heading_tree",
    f"""WITH {SQL_TYPED} SELECT doc_id, pos, level, coalesce(max(CASE WHEN level = 2 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), pos) AS group_pos
    FROM typed WHERE type = 'heading'""",
)
def _(spark, sf):
    return st.heading_tree(st.toc_headings(typed(spark, sf))).drop("text")


def _deeper(spark, sf):
    """Heading rows whose level is 1 to 3 by the length of the line."""
    rows = typed(spark, sf)
    return rows.withColumn("level", F.when(F.col("type") == "heading", F.length("text") % 3 + 1))


_DEEP = f"""WITH {SQL_TYPED}, h AS (SELECT doc_id, pos, CAST(length(line) % 3 + 1 AS INTEGER) AS level, line AS text FROM typed WHERE type = 'heading'),
p AS (SELECT *, (SELECT max(x.pos) FROM h x WHERE x.doc_id = h.doc_id AND x.pos < h.pos AND x.level < h.level) AS parent_pos,
  lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS before, min(level) OVER (PARTITION BY doc_id) AS base FROM h)"""


@check(
    "outline",
    f"""{_DEEP} SELECT doc_id, pos, level, text, parent_pos, level > coalesce(before, base - 1) + 1 AS skips,
    pos IN (SELECT q.parent_pos FROM p q WHERE q.doc_id = p.doc_id AND q.parent_pos IS NOT NULL) AS has_children FROM p""",
)
def _(spark, sf):
    return st.outline(_deeper(spark, sf))


@check(
    "list_runs",
    f"""WITH {SQL_TYPED}, k AS (SELECT *, type LIKE '%ListItem' AND lag(type) OVER (PARTITION BY doc_id ORDER BY pos) = type AS joins FROM typed),
    l AS (SELECT *, max(CASE WHEN coalesce(joins, false) THEN NULL ELSE pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k)
    SELECT doc_id, pos, run FROM l WHERE type LIKE '%ListItem'""",
)
def _(spark, sf):
    return st.list_runs(typed(spark, sf)).select("doc_id", "pos", "run")


@check(
    "merge_narrative",
    f"""WITH {SQL_TYPED}, k AS (SELECT *, type = 'narrative' AND lag(type) OVER (PARTITION BY doc_id ORDER BY pos) = type AS joins FROM typed),
    l AS (SELECT *, max(CASE WHEN coalesce(joins, false) THEN NULL ELSE pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k)
    SELECT doc_id, run AS pos, string_agg(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|' ORDER BY pos) AS paragraphs FROM l WHERE type = 'narrative' GROUP BY doc_id, run""",
)
def _(spark, sf):
    return st.merge_narrative(typed(spark, sf)).withColumn("paragraphs", F.array_join("paragraphs", "|"))


@check("lead_flags", f"WITH {SQL_TYPED} SELECT doc_id, pos, pos = min(pos) OVER (PARTITION BY doc_id) AS lead FROM typed WHERE type = 'paragraph'")
def _(spark, sf):
    return st.lead_flags(typed(spark, sf)).select("doc_id", "pos", "lead")


@check(
    "show_toc",
    f"""WITH {SQL_TYPED} SELECT d.doc_id, CASE d.lang WHEN 'fr' THEN false WHEN 'de' THEN true ELSE count(t.doc_id) FILTER (t.type = 'heading') > 3 END AS show_toc
    FROM documents d LEFT JOIN typed t ON t.doc_id = d.doc_id GROUP BY d.doc_id, d.lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "fr", False).when(F.col("lang") == "de", True).alias("show_toc"))
    return st.show_toc(docs, typed(spark, sf), threshold=3)


def _doc_meta(spark, sf):
    docs = table(spark, sf, "documents")
    meta = F.create_map(
        F.lit("title"), F.concat(F.lit("Doc "), "doc_id"), F.lit("author"), F.when(F.col("lang") == "en", F.col("source")).otherwise(""),
        F.lit("slug"), F.concat_ws("-", "source", "doc_id"), F.lit("canonical_url"),
        F.when(F.col("lang") != "de", F.concat(F.lit("https://e.org/"), "doc_id")).otherwise(""), F.lit("footer_html"),
        F.when(F.col("lang") == "es", F.lit("<em>©</em> all")).otherwise(""),
    )
    return docs.select("doc_id", F.concat_ws("-", "source", "doc_id").alias("slug"), F.concat(F.lit("Doc "), "doc_id").alias("title"), meta.alias("meta"), "lang")


@check(
    "safe_markdown",
    f"""WITH {SQL_TYPED}, img AS (SELECT doc_id, pos, asset_id FROM typed WHERE type = 'image'), {_FIRST.format(src='img')},
    nx AS (SELECT t.*, lead(type) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS after, m.n FROM typed t LEFT JOIN nums m ON m.doc_id = t.doc_id AND m.asset_id = t.asset_id),
    part AS (SELECT x.doc_id, x.pos, CASE type
      WHEN 'narrative' THEN '> ' || line || CASE WHEN after = 'narrative' THEN chr(10) || '>' || chr(10) ELSE chr(10) || chr(10) END
      WHEN 'image' THEN '![Figure ' || n || '](' || CASE WHEN asset_id < '8' THEN asset_id ELSE '' END || ')' || chr(10) || chr(10) || '**Figure ' || n || '.** ' || trim(caption)
        || CASE WHEN d.lang <> 'de' THEN ' — [View original photo](https://e.org/' || x.doc_id || '#figure-' || n || ')' ELSE '' END || chr(10) || chr(10)
      WHEN 'footnote' THEN '> **[' || marker || ']** ' || line || chr(10) || chr(10)
      WHEN 'heading' THEN CASE level WHEN 3 THEN '### ' ELSE '## ' END || line || chr(10) || chr(10)
      WHEN 'paragraph' THEN line || chr(10) || chr(10) WHEN 'quote' THEN '> ' || line || chr(10) || chr(10)
      WHEN 'numberedListItem' THEN '1. ' || line || chr(10) ELSE '- ' || line || chr(10) END AS p FROM nx x JOIN documents d ON d.doc_id = x.doc_id),
    body AS (SELECT doc_id, string_agg(p, '' ORDER BY pos) AS b FROM part GROUP BY doc_id),
    w AS (SELECT doc_id, CAST(sum(CASE WHEN type IN ('paragraph', 'heading', 'quote', 'bulletListItem', 'numberedListItem') THEN {sql_count_words('text')} ELSE 0 END) AS BIGINT) AS w FROM typed GROUP BY doc_id)
    SELECT d.doc_id, rtrim('**Title:** Doc ' || d.doc_id || '  ' || chr(10) || CASE WHEN lang = 'en' THEN '**Author:** ' || source || '  ' || chr(10) ELSE '' END
      || '**Source name:** ' || source || '-' || d.doc_id || '  ' || chr(10) || '**Word count:** ' || format('{{:,}}', w) || '  ' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
      || b || CASE WHEN lang = 'es' THEN '---' || chr(10) || chr(10) || '**©* all*' ELSE '' END, ' ' || chr(10)) || chr(10) AS markdown
    FROM documents d JOIN body ON body.doc_id = d.doc_id JOIN w ON w.doc_id = d.doc_id""",
)
def _(spark, sf):
    rows = typed(spark, sf)
    assets = rows.where(F.col("type") == "image").select(F.col("props")["asset_id"].alias("sha256")).distinct().where(F.col("sha256") < "8")
    return ln.safe_markdown(_doc_meta(spark, sf), rows, assets)


_ESC = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@check(
    "body_html",
    f"""WITH {SQL_TYPED}, y AS (SELECT doc_id, pos, line, asset_id, level, CASE WHEN type = 'quote' AND length(line) % 2 = 0 THEN 'table' ELSE type END AS type, {_ESC} AS esc FROM typed),
    d AS (SELECT *, type = 'numberedListItem' AND coalesce(lag(type) OVER w = 'bulletListItem', false) AS nested, lead(type) OVER w AS next_type, lead(esc) OVER w AS next_esc FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    k AS (SELECT *, lag(type) OVER w AS up, lead(type) OVER w AS down FROM d WHERE NOT nested WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r AS (SELECT *, max(CASE WHEN type LIKE '%ListItem' AND up = type THEN NULL ELSE pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k),
    an AS (SELECT doc_id, pos, base || CASE WHEN j > 1 THEN '-' || j ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS j
      FROM (SELECT doc_id, pos, coalesce(nullif({_SLUG}, ''), 'section') AS base FROM (SELECT doc_id, pos, line FROM d WHERE type = 'heading')))),
    fg AS (SELECT doc_id, asset_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS n FROM d WHERE type = 'image' GROUP BY doc_id, asset_id),
    ld AS (SELECT doc_id, min(pos) AS lead FROM d WHERE type = 'paragraph' GROUP BY doc_id),
    ls AS (SELECT doc_id, run, string_agg('<li>' || esc || CASE WHEN type = 'bulletListItem' AND next_type = 'numberedListItem' THEN '<ol><li>' || next_esc || '</li></ol>' ELSE '' END || '</li>', '' ORDER BY pos) AS items
      FROM r WHERE type LIKE '%ListItem' GROUP BY ALL),
    h AS (SELECT r.doc_id, r.pos, CASE r.type WHEN 'heading' THEN '<h' || r.level || ' id="' || anchor || '">' || esc || '</h' || r.level || '>'
      WHEN 'paragraph' THEN CASE WHEN r.pos = lead THEN '<p class="lead">' ELSE '<p>' END || esc || '</p>' WHEN 'quote' THEN '<blockquote><p>' || esc || '</p></blockquote>'
      WHEN 'table' THEN '<table><tr><td>' || esc || '</td><td><strong>' || length(line) || '</strong></td></tr></table>'
      WHEN 'footnote' THEN '<aside class="footnote"><sup>' || length(line) || '</sup> ' || line || '</aside>'
      WHEN 'image' THEN '<figure id="figure-' || n || '"><img src="assets/figure-' || n || '-original.jpeg" alt=""><figcaption>' || line || '</figcaption></figure>'
      WHEN 'narrative' THEN CASE WHEN up IS DISTINCT FROM 'narrative' THEN '<div class="narrative">' ELSE '' END || '<p>' || esc || '</p>' || CASE WHEN down IS DISTINCT FROM 'narrative' THEN '</div>' ELSE '' END
      WHEN 'bulletListItem' THEN CASE WHEN r.pos = r.run THEN '<ul>' || items || '</ul>' END WHEN 'numberedListItem' THEN CASE WHEN r.pos = r.run THEN '<ol>' || items || '</ol>' END END AS html
      FROM r LEFT JOIN an ON an.doc_id = r.doc_id AND an.pos = r.pos LEFT JOIN fg ON fg.doc_id = r.doc_id AND fg.asset_id = r.asset_id LEFT JOIN ld ON ld.doc_id = r.doc_id LEFT JOIN ls ON ls.doc_id = r.doc_id AND ls.run = r.run)
    SELECT doc_id, string_agg(html, chr(10) ORDER BY pos) AS html FROM h WHERE html IS NOT NULL GROUP BY doc_id""",
)
def _(spark, sf):
    """Numbered items right after a bulleted one are nested in it; quotes of even length are tables of two cells."""
    rows = typed(spark, sf)
    near = scan(rows, __up=prev(F.col("type")))
    cell = lambda t, **styles: as_runs(t, **styles)
    line = F.get("runs", F.lit(0))["text"]
    table = (F.col("type") == "quote") & (F.length(line) % 2 == 0)
    rows = near.withColumns({
        "depth": F.when((F.col("type") == "numberedListItem") & (F.col("__up") == "bulletListItem"), 1).otherwise(0),
        "cells": F.when(table, F.array(F.array(cell(line), cell(F.length(line).cast("string"), bold=F.lit(True))))),
        "type": F.when(table, "table").otherwise(F.col("type")),
    })
    return ln.body_html(rows.drop("__up"))


@check(
    "homepage_body",
    f"""WITH {SQL_TYPED}, r AS (SELECT doc_id, pos, type, line AS text, length(line) % 3 = 0 AS grp,
      CASE WHEN type = 'heading' THEN CASE level WHEN 2 THEN 'h1' ELSE 'seclabel' END WHEN type = 'paragraph' THEN 'intro' WHEN type = 'narrative' THEN 'narrative' END AS k FROM typed),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) = 1 AND coalesce(k, '') = 'h1' AS is_title FROM r)
    SELECT doc_id, pos, CASE WHEN k = 'h1' THEN 'seclabel' WHEN type = 'quote' THEN 'group' ELSE k END AS role,
      CASE WHEN type = 'quote' THEN CASE length(text) % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END ELSE text END AS text, CAST(0 AS BIGINT) AS slot
    FROM t WHERE (k IS NOT NULL OR type = 'quote') AND NOT is_title
    UNION ALL SELECT doc_id, pos, 'member', n_name, row_number() OVER (PARTITION BY doc_id, pos ORDER BY n_name) FROM t JOIN nation ON n_regionkey = length(text) % 5 WHERE type = 'quote'""",
)
def _(spark, sf):
    """Quotes stand in for group listings of regions with their nations; level-2 headings for h1."""
    rows = typed(spark, sf)
    quote, head = F.col("type") == "quote", F.col("type") == "heading"
    rows = rows.withColumns(
        {
            "props": F.when(quote, F.create_map(F.lit("group_id"), (F.length("text") % 5 + 1).cast("string"))).otherwise(F.col("props")),
            "type": F.when(quote, "group_listing").otherwise(F.col("type")),
            "level": F.when(head & (F.col("level") == 2), 1).otherwise(F.col("level")),
        }
    )
    groups = table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("long").alias("group_id"), F.col("r_name").alias("name"))
    nations = table(spark, sf, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("group_id"), F.col("n_name").alias("title"))
    from quire.operators.ordered import number_rows

    members = number_rows(nations, ["group_id"], [F.col("title")], [F.substring("title", 1, 1)], "rank")
    return ln.homepage_body(rows, groups, members)["entries"].select("doc_id", "pos", "role", "text", "slot")
