"""Layout tables, file sources and streams, on rows derived from the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire.operators import layout as ly
from quire.operators import live_index as li
from quire.operators import versions as vs
from quire.plans.inputs import SQL_LINES, lines, table
from quire.plans.library_checks import SQL_LOG, _MATRIX, change_log, dirty, job_results, library, states, targets
from quire.plans.page_checks import _INDEX, _REPLY, _bm25, _one, doc_tracks
from quire.plans.registry import check
from quire.session import cut_lineage, written
from quire.session import fresh_folder as _fresh
from quire.sources import files as fl
from quire.sources import page_sink as ps
from quire.sources import sinks as sk
from quire.sources.tables import read_change_log
from quire.streaming import incremental as inc

# ---------------------------------------------------------------- layout


def spans(spark, sf):
    """Lines as blocks (six to a page), sentences as printed lines, comma pieces as styled spans."""
    t = F.col("text")
    text = (
        F.when(F.length(t) <= 15, F.length(t).cast("string"))
        .when((F.col("pos") % 6 == 0) & (F.length(t) % 10 == 0), F.concat(F.lit("Contents — "), t))
        .otherwise(t)
    )
    rows = lines(spark, sf).select("doc_id", F.floor(F.col("pos") / 6).cast("int").alias("page"), (F.col("pos") % 6).alias("block"), text.alias("t"))
    rows = rows.select("doc_id", "page", "block", F.posexplode(F.split("t", r"\. ")).alias("line", "t"))
    rows = rows.select("doc_id", "page", "block", "line", F.posexplode(F.split("t", ", ")).alias("span", "text"))
    n = F.length("text")
    x0 = (F.lit(50.0) + F.col("span") * 10 + F.when(n < 12, 200.0).otherwise(0.0))
    y0 = F.col("block") * 145.0 + F.col("line") * 14.0
    return rows.select(
        "doc_id", "page", "block", "line", "span", x0.alias("x0"), y0.alias("y0"), (x0 + n * 5.0).alias("x1"), (y0 + 12.0).alias("y1"),
        (F.lit(9.0) + (n % 5) * 0.5 + 0.1).alias("size"), (n % 2 == 0).alias("bold"), (n % 3 == 0).alias("italic"), F.concat("text", F.lit(" ")).alias("text"),
        F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )


_SPANS = f"""{SQL_LINES},
bt AS (SELECT doc_id, CAST(pos // 6 AS INTEGER) AS page, CAST(pos % 6 AS INTEGER) AS block, CASE WHEN length(text) <= 15 THEN CAST(length(text) AS VARCHAR) WHEN pos % 6 = 0 AND length(text) % 10 = 0 THEN 'Contents — ' || text ELSE text END AS t FROM lines),
bl AS (SELECT doc_id, page, block, unnest(string_split(t, '. ')) AS t, CAST(generate_subscripts(string_split(t, '. '), 1) - 1 AS INTEGER) AS line FROM bt),
sp AS (SELECT doc_id, page, block, line, unnest(string_split(t, ', ')) AS text, CAST(generate_subscripts(string_split(t, ', '), 1) - 1 AS INTEGER) AS span FROM bl),
sz AS (SELECT *, 9.0 + (length(text) % 5) * 0.5 AS size, length(text) % 2 = 0 AS bold, length(text) % 3 = 0 AS italic FROM sp)"""


@check(
    "font_mode",
    f"""WITH {_SPANS}, b AS (SELECT doc_id, size, count(*) AS n, min(page * 10000000 + block * 1000000 + line * 1000 + span) AS f FROM sz GROUP BY ALL)
    SELECT doc_id, CAST(size AS DOUBLE) AS body_size FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1""",
)
def modes(spark, sf):
    return ly.font_mode(spans(spark, sf))


@check(
    "heading_thresholds",
    f"""WITH {_SPANS}, b AS (SELECT doc_id, size, count(*) AS n, min(page * 10000000 + block * 1000000 + line * 1000 + span) AS f FROM sz GROUP BY ALL)
    SELECT doc_id, CAST(size AS DOUBLE) AS body_size, CAST(size AS DOUBLE) * 1.6 AS h1_size, CAST(size AS DOUBLE) * 1.2 AS h2_size FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1""",
)
def _(spark, sf):
    return ly.heading_thresholds(modes(spark, sf))


_MARK = "CASE WHEN bold AND italic THEN '***' WHEN bold THEN '**' WHEN italic THEN '*' ELSE '' END"


_PRINTED = f"""{_SPANS},
    k AS (SELECT *, CASE WHEN span > 0 AND bold = lag(bold) OVER w AND italic = lag(italic) OVER w THEN 0 ELSE 1 END AS opens FROM sz WINDOW w AS (PARTITION BY doc_id, page, block, line ORDER BY span)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page, block, line ORDER BY span) AS g FROM k),
    r AS (SELECT doc_id, page, block, line, g, bool_or(bold) AS bold, bool_or(italic) AS italic, string_agg(text || ' ', '' ORDER BY span) AS t, sum(CASE WHEN bold THEN length(replace(text, ' ', '')) ELSE 0 END) AS bn, sum(length(replace(text, ' ', ''))) AS n FROM g GROUP BY ALL),
    l AS (SELECT doc_id, page, block, line, trim(string_agg(t, '' ORDER BY g)) AS text,
      trim(string_agg(CASE WHEN trim(t) = '' THEN t ELSE regexp_extract(t, '^ *') || {_MARK} || trim(t) || {_MARK} || regexp_extract(t, ' *$') END, '' ORDER BY g)) AS md, sum(bn) AS bn, sum(n) AS n FROM r GROUP BY ALL),
    y AS (SELECT doc_id, page, block, line, size, count(*) AS c, min(span) AS f FROM sz GROUP BY ALL), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, page, block, line ORDER BY c DESC, f) = 1),
    box AS (SELECT doc_id, page, block, line, min(x0) AS x0, max(x1) AS x1, block * 145.0 + line * 14.0 AS y0 FROM (
      SELECT *, 50.0 + span * 10 + CASE WHEN length(text) < 12 THEN 200.0 ELSE 0.0 END AS x0, 50.0 + span * 10 + CASE WHEN length(text) < 12 THEN 200.0 ELSE 0.0 END + length(text) * 5.0 AS x1 FROM sz) GROUP BY ALL),
    pr AS (SELECT l.doc_id, l.page, l.block, l.line, l.text, l.md, CASE WHEN l.text = '' THEN 0.0 ELSE CAST(z.size AS DOUBLE) END AS size, l.n > 0 AND bn / l.n >= 0.8 AS bold, x0, x1, y0
      FROM l JOIN z ON z.doc_id = l.doc_id AND z.page = l.page AND z.block = l.block AND z.line = l.line
      JOIN box ON box.doc_id = l.doc_id AND box.page = l.page AND box.block = l.block AND box.line = l.line)"""


@check("line_style", f"WITH {_PRINTED} SELECT doc_id, page, block, line, text, md, size, bold FROM pr")
def _(spark, sf):
    return printed(spark, sf).select("doc_id", "page", "block", "line", "text", "md", "size", "bold")


def printed(spark, sf):
    """Printed lines, written out once because every layout step reads them several times."""
    return cut_lineage(ly.line_style(spans(spark, sf)))


@check(
    "drop_page_numbers",
    f"""WITH {_SPANS} SELECT DISTINCT doc_id, page, block, line FROM sz WHERE NOT (block = 5 AND regexp_matches(text, '^[0-9]{{1,4}}$') AND line = 0 AND span = 0
      AND (SELECT count(*) FROM sz x WHERE x.doc_id = sz.doc_id AND x.page = sz.page AND x.block = sz.block) = 1)""",
)
def _(spark, sf):
    return ly.drop_page_numbers(printed(spark, sf)).select("doc_id", "page", "block", "line")


@check(
    "drop_toc_pages",
    f"""WITH {_SPANS}, toc AS (SELECT doc_id, page FROM bt WHERE block = 0 AND t LIKE 'Contents — %') SELECT DISTINCT s.doc_id, s.page, s.block, s.line FROM sz s ANTI JOIN toc ON toc.doc_id = s.doc_id AND toc.page = s.page""",
)
def _(spark, sf):
    return ly.drop_toc_pages(printed(spark, sf)).select("doc_id", "page", "block", "line")


def bold_split(spark, sf):
    return ly.split_bold_lines(ly.line_style(spans(spark, sf)))


_BOLD = f"""{_PRINTED}, e AS (SELECT *, min(x0) FILTER (text <> '') OVER (PARTITION BY doc_id, page) AS edge FROM pr),
    h AS (SELECT *, CASE WHEN NOT (bold AND text <> '' AND length(text) <= 100) THEN 'p'
      WHEN x0 - edge >= 72 AND abs(x0 - (600 - x1)) <= 132 AND ((regexp_matches(text, '\\p{{L}}') AND upper(text) = text) OR regexp_full_match(trim(text, '.,;: '), '(1[89]|20)\\d{{2}}(\\s*[–—-]\\s*(1[89]|20)\\d{{2}})?')) THEN 'h2' ELSE 'h3' END AS kind FROM e),
    o AS (SELECT *, CASE WHEN kind = 'p' AND lag(kind) OVER w = 'p' THEN 0 ELSE 1 END AS opens FROM h WINDOW w AS (PARTITION BY doc_id, page, block ORDER BY line)),
    q AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page, block ORDER BY line) AS run FROM o),
    f AS (SELECT *, min(line) OVER w AS part, min(line) FILTER (text <> '') OVER w AS said FROM q WINDOW w AS (PARTITION BY doc_id, page, block, run))"""


@check("split_bold_lines", f"WITH {_BOLD} SELECT doc_id, page, block, line, text, part, kind FROM f WHERE line >= said")
def _(spark, sf):
    return bold_split(spark, sf).select("doc_id", "page", "block", "line", "text", "part", "kind")


def _small_print(spark, sf):
    """Blocks low on the page whose first line is kept large and whose later lines are numbered small print."""
    rows = printed(spark, sf).withColumns({"part": F.lit(0), "kind": F.lit("p")})
    note = (F.col("block") >= 4) & (F.col("line") > 0)
    numbered = F.when(F.col("line") % 2 == 1, F.concat(((F.col("line") + 1) / 2).cast("int").cast("string"), F.lit(" "), "text")).otherwise(F.col("text"))
    out = rows.withColumns(
        {
            "text": F.when(note, numbered).when((F.col("block") >= 4) & (F.col("line") == 0), F.concat("text", F.lit("1"))).otherwise(F.col("text")),
            "size": F.when(note, 6.0).otherwise(F.col("size")),
        }
    )
    out = out.withColumn("md", F.col("text"))
    return ly.split_footnote_zone(out, modes(spark, sf))


_LEAD = "'(?s)^\\s*(\\d{1,2})\\s+(.+)$'"
# In a block low on the page the numbered lines rise by one from the first on, until one is missing.
_NOTES = f"""{_PRINTED},
    sp2 AS (SELECT doc_id, page, block, line, CASE WHEN block >= 4 AND line > 0 AND line % 2 = 1 THEN ((line + 1) // 2) || ' ' || text WHEN block >= 4 AND line = 0 THEN text || '1' ELSE text END AS text FROM pr),
    zn AS (SELECT *, min(line) FILTER (block >= 4 AND line > 0 AND regexp_matches(text, {_LEAD})) OVER (PARTITION BY doc_id, page, block) AS zone FROM sp2),
    ld AS (SELECT *, CAST(regexp_extract(text, {_LEAD}, 1) AS INTEGER) AS num, row_number() OVER (PARTITION BY doc_id, page, block ORDER BY line) AS rn FROM zn WHERE line >= zone AND regexp_matches(text, {_LEAD})),
    op AS (SELECT * FROM (SELECT *, first(num) OVER (PARTITION BY doc_id, page, block ORDER BY line) AS num0 FROM ld) WHERE num = num0 + rn - 1),
    it AS (SELECT z.doc_id, z.page, z.block, z.line, z.text, (SELECT max(op.line) FROM op WHERE op.doc_id = z.doc_id AND op.page = z.page AND op.block = z.block AND op.line <= z.line) AS head FROM zn z WHERE z.line >= z.zone AND z.text <> ''),
    bd AS (SELECT doc_id, page, block, head, trim(string_agg(CASE WHEN line = head THEN trim(regexp_extract(text, {_LEAD}, 2)) ELSE trim(text) END, ' ' ORDER BY line)) AS text FROM it WHERE head IS NOT NULL GROUP BY ALL),
    nt AS (SELECT bd.doc_id, bd.page, bd.block, bd.head, op.num AS local_num, bd.text, CAST(row_number() OVER (PARTITION BY bd.doc_id ORDER BY bd.page, bd.block, bd.head) AS INTEGER) AS n
      FROM bd JOIN op ON op.doc_id = bd.doc_id AND op.page = bd.page AND op.block = bd.block AND op.line = bd.head WHERE length(bd.text) >= 6)"""


@check("split_footnote_zone", f"WITH {_NOTES} SELECT doc_id, page, block, n, local_num, text FROM nt")
def _(spark, sf):
    return _small_print(spark, sf)[1]


@check(
    "split_footnote_zone_body",
    f"""WITH {_NOTES}, kp AS (SELECT *, max(line) FILTER (text <> '') OVER (PARTITION BY doc_id, page, block) AS tail FROM zn WHERE zone IS NULL OR line < zone),
    mk AS (SELECT doc_id, page, block, string_agg('[^' || n || ']', '' ORDER BY head) AS marks, arg_min(local_num, head) AS num FROM nt GROUP BY ALL)
    SELECT kp.doc_id, kp.page, kp.block, kp.line, CASE WHEN kp.line = tail AND marks IS NOT NULL THEN rtrim(regexp_replace(kp.text, '(\\D)' || num || '\\s*$', '\\1')) || marks ELSE kp.text END AS text
    FROM kp LEFT JOIN mk ON mk.doc_id = kp.doc_id AND mk.page = kp.page AND mk.block = kp.block WHERE tail IS NOT NULL""",
)
def _(spark, sf):
    return _small_print(spark, sf)[0].select("doc_id", "page", "block", "line", "text")


def images(lines):
    """Every block of a short first line has a picture that ends five points above it."""
    rows = lines.where((F.col("line") == 0) & F.length("text").between(16, 60))
    top = F.col("y0")
    return rows.select(
        "doc_id", "page", F.col("block").alias("image"), F.lit(40.0).alias("x0"), (top - 60.0).alias("y0"), F.lit(300.0).alias("x1"), (top - 5.0).alias("y1")
    )


def _captions(spark, sf):
    rows = printed(spark, sf)
    return ly.caption_blocks(images(rows), ly.text_blocks(rows), modes(spark, sf).withColumn("body_size", F.lit(12.0))), rows


_CLIP = "CASE WHEN length(caption) > 240 THEN rtrim(caption[:240]) || '…' ELSE caption END"
_IMAGES = "im AS (SELECT doc_id, page, block AS image, y0 - 5.0 AS below FROM pr WHERE line = 0 AND length(text) BETWEEN 16 AND 60)"
# Blocks stand 145 points apart, so only an image's own block is near enough.
_CAPTIONED = f"""{_PRINTED}, {_IMAGES},
    tb AS (SELECT doc_id, page, block, string_agg(text, ' ' ORDER BY line) FILTER (text <> '') AS text, min(x0) AS x0, max(x1) AS x1 FROM pr GROUP BY ALL),
    cb AS (SELECT im.doc_id, im.page, im.image, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS caption FROM im JOIN tb ON tb.doc_id = im.doc_id AND tb.page = im.page AND tb.block = im.image
      WHERE greatest(0, least(x1, 300) - greatest(x0, 40)) / 260 >= 0.25 AND length(text) <= 240)"""


@check("caption_blocks", f"WITH {_CAPTIONED} SELECT doc_id, page, image, {_CLIP} AS caption FROM cb")
def _(spark, sf):
    return _captions(spark, sf)[0][0]


@check(
    "caption_lines",
    f"""WITH {_CAPTIONED}, lf AS (SELECT * FROM im ANTI JOIN (SELECT * FROM cb WHERE caption <> '') c ON c.doc_id = im.doc_id AND c.page = im.page AND c.image = im.image),
    cd AS (SELECT lf.doc_id, lf.page, lf.image, pr.text, pr.y0, row_number() OVER w AS nth, CASE WHEN pr.y0 - (lag(pr.y0) OVER w + 12) > 10 THEN 1 ELSE 0 END AS apart
      FROM lf JOIN pr ON pr.doc_id = lf.doc_id AND pr.page = lf.page
      WHERE pr.text <> '' AND pr.y0 BETWEEN below - 35 AND below + 40 AND greatest(0, least(x1, 300) - greatest(x0, 40)) / greatest(1e-6, x1 - x0) >= 0.7 AND length(pr.text) <= 180
      WINDOW w AS (PARTITION BY lf.doc_id, lf.page, lf.image ORDER BY pr.y0, pr.block, pr.line)),
    ch AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page, image ORDER BY nth) AS broken FROM cd)
    SELECT doc_id, page, image, {_CLIP} AS caption FROM (SELECT doc_id, page, image, trim(string_agg(text, ' ' ORDER BY nth)) AS caption FROM ch WHERE broken = 0 AND nth <= 3 GROUP BY ALL)""",
)
def _(spark, sf):
    (captions, _), rows = _captions(spark, sf)
    return ly.caption_lines(images(rows), rows, captions)[0]


@check(
    "tile_components",
    f"""WITH {SQL_LINES}, t AS (SELECT doc_id, CAST(pos // 20 AS INTEGER) AS page, pos % 20 AS slot, length(text) % 3 AS gap FROM lines),
    g AS (SELECT *, sum(CASE WHEN gap = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY slot) AS run FROM t)
    SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY run) - 1 AS INTEGER) AS image, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS tiles FROM g GROUP BY doc_id, page, run""",
)
def _(spark, sf):
    """Boxes of equal width stacked down a page; a line length divisible by three leaves a gap above its box."""
    rows = lines(spark, sf)
    slot = F.col("pos") % 20
    y0 = slot * 40.0 + F.when(F.length("text") % 3 == 0, 20.0).otherwise(0.0)
    boxes = rows.select(
        "doc_id", F.floor(F.col("pos") / 20).cast("int").alias("page"), slot.cast("int").alias("tile"), F.lit(10.0).alias("x0"), y0.alias("y0"),
        F.lit(200.0).alias("x1"), (slot * 40.0 + 39.0).alias("y1"),
    )
    out = ly.tile_components(boxes)
    return out.select("doc_id", "page", "image", F.array_join(F.col("tiles").cast("array<string>"), ",").alias("tiles"))


@check(
    "paragraph_groups",
    f"""WITH {_BOLD}, fm AS (SELECT doc_id, size, count(*) AS n, min(page * 10000000 + block * 1000000 + line * 1000 + span) AS f FROM sz GROUP BY ALL),
    bo AS (SELECT doc_id, CAST(size AS DOUBLE) AS body FROM fm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
    rw AS (SELECT * FROM f WHERE line >= said),
    bs AS (SELECT doc_id, page, block, size, count(*) AS c, min(line) AS first_line FROM rw WHERE text <> '' AND size > 0 GROUP BY ALL),
    bz AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY doc_id, page, block ORDER BY c DESC, first_line) = 1),
    kd AS (SELECT rw.*, CASE WHEN rw.kind <> 'p' THEN rw.kind WHEN bz.size >= body * 1.6 THEN 'h1' WHEN bz.size >= body * 1.2 THEN 'h2' ELSE 'p' END AS level
      FROM rw LEFT JOIN bz ON bz.doc_id = rw.doc_id AND bz.page = rw.page AND bz.block = rw.block LEFT JOIN bo ON bo.doc_id = rw.doc_id),
    br AS (SELECT *, text <> '' AND level = 'p' AS flows FROM kd),
    og AS (SELECT *, CASE WHEN flows AND lag(flows) OVER w THEN 0 ELSE 1 END AS starts FROM br WINDOW w AS (PARTITION BY doc_id, page, block, part ORDER BY line)),
    gp AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page, block, part ORDER BY line) AS stretch FROM og),
    gr AS (SELECT *, CASE WHEN level = 'p' THEN min(line) OVER (PARTITION BY doc_id, page, block, part, stretch) ELSE part END AS grp FROM gp),
    pa AS (SELECT doc_id, page, block, part, grp, level, trim(string_agg(CASE WHEN level = 'p' THEN md ELSE text END, ' ' ORDER BY line)) AS text,
      CASE WHEN level = 'p' THEN arg_min(y0, line) ELSE min(y0) END AS y, max(size) AS size FROM gr WHERE text <> '' GROUP BY doc_id, page, block, part, grp, level)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y, block, part, grp) - 1 AS INTEGER) AS pos, page, level AS kind, text, size FROM pa WHERE text <> ''""",
)
def _(spark, sf):
    return ly.paragraph_groups(bold_split(spark, sf), ly.heading_thresholds(modes(spark, sf)))


# ---------------------------------------------------------------- sinks that write


@check(
    "write_tracks_csv",
    f"""WITH {_REPLY} SELECT source_name AS source, section, k AS name, x AS role_or_relationship, CAST(4 AS INTEGER) AS width FROM dt WHERE track_type = 'people'""",
)
def _(spark, sf):
    """Tracks written as CSV, checked for their width and read back."""
    folder = _fresh(spark, "csv")
    sk.write_tracks_csv(doc_tracks(spark, sf), folder)
    width = sk.validate_widths(spark, folder, "people")
    return sk.read_tracks_csv(spark, folder, "people").drop("_bad").na.fill("").withColumn("width", F.lit(width))


@check(
    "publish_all",
    f"""WITH {_MATRIX}, d AS (SELECT m.doc_id, m.target_id, l.kind, t.target_kind, l.content_hash, l.o_orderstatus AS s, r.run FROM mx m JOIN lib l ON l.doc_id = m.doc_id JOIN tgt t ON t.target_id = m.target_id,
      (VALUES (1), (2)) r(run) WHERE m.dirty AND (r.run = 2 OR m.doc_id % 2 = 0)),
    w AS (SELECT * FROM d WHERE s <> 'P' AND doc_id % 2 = CASE run WHEN 1 THEN 0 ELSE 1 END),
    h AS (SELECT * FROM d WHERE kind = 'homepage' AND (run, target_id) IN (SELECT (run, target_id) FROM w WHERE kind <> 'homepage' AND target_kind <> 'drive')
      AND (run, doc_id, target_id) NOT IN (SELECT (run, doc_id, target_id) FROM w))
    SELECT 'marked' AS what, CAST(run AS BIGINT) AS run, doc_id, target_id, content_hash AS value FROM (SELECT * FROM w UNION ALL SELECT * FROM h)
    UNION ALL SELECT 'log', CAST(run AS BIGINT), doc_id, target_id, 'published' FROM w UNION ALL SELECT 'log', CAST(run AS BIGINT), doc_id, target_id, 'refreshed with its target' FROM h
    UNION ALL SELECT 'page', CAST(run AS BIGINT), doc_id, target_id, '<p>' || run || '</p>' FROM w""",
)
def _(spark, sf):
    """Two runs: even documents, then all of them, of which only the odd ones render; status P never renders."""
    docs, folder = library(spark, sf), _fresh(spark, "site")
    dirty_rows = dirty(spark, sf).where("dirty").select("doc_id", "target_id").join(docs.select("doc_id", "kind", "content_hash"), "doc_id")
    rows = written(dirty_rows.join(targets(spark, sf).select("target_id", "target_kind"), "target_id"), "asked")  # read by both runs
    even = F.col("doc_id") % 2 == 0
    out = []
    for run, asked, fine in ((1, even, even), (2, F.lit(True), ~even)):
        render = docs.where((F.col("o_orderstatus") != "P") & fine).select("doc_id", F.lit(f"<p>{run}</p>").alias("html"))
        made = vs.publish_all(rows.where(asked), render, folder, spark, F.lit("2024-01-01").cast("timestamp"), run)
        one = lambda what, df, value, run=run: df.select(F.lit(what).alias("what"), F.lit(run).cast("long").alias("run"), "doc_id", "target_id", F.col(value).alias("value"))
        out += [one("marked", made["marked"], "content_hash"), one("log", made["log"], "summary")]
    pages = vs.published_pages(spark, folder)
    out.append(pages.select(F.lit("page").alias("what"), "run", "doc_id", "target_id", F.col("html").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), out)


@check(
    "publish_committed",
    f"""WITH {_MATRIX}, d AS (SELECT m.doc_id, m.target_id, l.kind, t.target_kind, l.content_hash, l.o_orderstatus AS s, r.run FROM mx m JOIN lib l ON l.doc_id = m.doc_id JOIN tgt t ON t.target_id = m.target_id,
      (VALUES (1), (2)) r(run) WHERE m.dirty AND (r.run = 2 OR m.doc_id % 2 = 0)),
    w AS (SELECT * FROM d WHERE s <> 'P' AND doc_id % 2 = CASE run WHEN 1 THEN 0 ELSE 1 END),
    h AS (SELECT * FROM d WHERE kind = 'homepage' AND (run, target_id) IN (SELECT (run, target_id) FROM w WHERE kind <> 'homepage' AND target_kind <> 'drive')
      AND (run, doc_id, target_id) NOT IN (SELECT (run, doc_id, target_id) FROM w))
    SELECT 'marked' AS what, CAST(run AS BIGINT) AS run, doc_id, target_id, content_hash AS value FROM (SELECT * FROM w UNION ALL SELECT * FROM h)
    UNION ALL SELECT 'log', CAST(run AS BIGINT), doc_id, target_id, 'published' FROM w UNION ALL SELECT 'log', CAST(run AS BIGINT), doc_id, target_id, 'refreshed with its target' FROM h
    UNION ALL SELECT 'page', CAST(run AS BIGINT), doc_id, target_id, '<p>' || run || '</p>' FROM w""",
)
def _(spark, sf):
    """Two runs: even documents, then all of them, of which only the odd ones render; status P never renders; pages count once committed."""
    docs, folder = library(spark, sf), _fresh(spark, "site")
    dirty_rows = dirty(spark, sf).where("dirty").select("doc_id", "target_id").join(docs.select("doc_id", "kind", "content_hash"), "doc_id")
    rows = written(dirty_rows.join(targets(spark, sf).select("target_id", "target_kind"), "target_id"), "asked")  # read by both runs
    even = F.col("doc_id") % 2 == 0
    out = []
    for run, asked, fine in ((1, even, even), (2, F.lit(True), ~even)):
        render = docs.where((F.col("o_orderstatus") != "P") & fine).select("doc_id", F.lit(f"<p>{run}</p>").alias("html"))
        made = ps.publish_run(rows.where(asked), render, folder, spark, F.lit("2024-01-01").cast("timestamp"), run)
        one = lambda what, df, value, run=run: df.select(F.lit(what).alias("what"), F.lit(run).cast("long").alias("run"), "doc_id", "target_id", F.col(value).alias("value"))
        out += [one("marked", made["marked"], "content_hash"), one("log", made["log"], "summary")]
    pages = ps.committed_pages(spark, folder)
    out.append(pages.select(F.lit("page").alias("what"), "run", "doc_id", "target_id", F.col("html").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), out)


# ---------------------------------------------------------------- file sources


@check(
    "manifest_figures",
    f"""WITH {SQL_LINES}, f AS (SELECT doc_id, pos, text, sha256(text) AS h FROM lines WHERE length(text) % 4 <> 0),
    l AS (SELECT doc_id, h, max(pos) AS pos FROM f GROUP BY ALL)
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'stem-' || doc_id ELSE 'm' || doc_id END AS stem, h AS source_sha256, CAST(pos AS VARCHAR) AS n, CASE WHEN pos % 2 = 0 THEN 'cap' ELSE '' END AS caption, pos % 3 <> 0 AS included FROM l""",
)
def _(spark, sf):
    """A manifest file per document, written and read back; even documents name their stem inside."""
    rows = lines(spark, sf)
    fig = F.struct(
        F.col("pos").cast("string").alias("n"), F.when(F.length("text") % 4 != 0, F.sha2("text", 256)).otherwise("").alias("source_sha256"),
        F.when(F.col("pos") % 2 == 0, "cap").alias("caption"), F.when(F.col("pos") % 3 == 0, False).alias("included"),
    )
    one = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", fig.alias("f"))))["f"].alias("figures"))
    stem = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("stem-"), "doc_id"))
    folder = _fresh(spark, "manifests")
    files = one.select(F.concat(F.lit("m"), "doc_id", F.lit(".json")).alias("name"), F.to_json(F.struct(stem.alias("stem"), "figures")).alias("content"))
    fl.write_files(files, folder).write.format("noop").mode("overwrite").save()
    return fl.read_manifests(spark, folder).select("stem", "source_sha256", "n", "caption", "included")


@check("binary_assets", "SELECT sha256(html) AS sha256, 'text/html' AS mime, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM pages GROUP BY html")
def _(spark, sf):
    """Every page as a file, and a text file beside it that the name leaves unopened; files are told apart by their bytes."""
    pages, folder = table(spark, sf, "pages"), _fresh(spark, "assets")
    name = F.format_string("%d", "page_id")
    rows = pages.select(F.concat(name, F.lit(".html")).alias("name"), F.col("html").alias("content")).unionByName(pages.select(F.concat(name, F.lit(".txt")).alias("name"), F.lit("x").alias("content")))
    fl.write_files(rows, folder).write.format("noop").mode("overwrite").save()
    return fl.read_binary_assets(spark, folder, "originals", "*.html").select("sha256", "mime", "size_bytes")


@check(
    "asset_rows",
    """SELECT sha256(text) AS sha256, 'originals' AS kind, arg_min(doc_id || '.PNG', doc_id) AS filename, '.png' AS ext, 'image/png' AS mime, CAST(min(n_chars) AS BIGINT) AS size_bytes FROM documents GROUP BY sha256(text)""",
)
def _(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("text").cast("binary").alias("content"), F.format_string("/in/%012d/%d.PNG", "doc_id", "doc_id").alias("path"),
        F.col("n_chars").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
    )
    return fl.asset_rows(files, "originals").drop("created_at")


@check("discover", "SELECT source || '-' || doc_id AS stem FROM documents WHERE lang IN ('en', 'de')")
def _(spark, sf):
    name = F.concat_ws("-", "source", "doc_id")
    lang = F.col("lang")
    path = F.when(lang == "fr", F.concat(F.lit("/s/index"), name, F.lit(".html"))).when(lang == "es", F.concat(F.lit("/s/"), name, F.lit(".txt"))).otherwise(
        F.concat(F.lit("/s/"), name, F.lit(".html"))
    )
    return fl.discover(table(spark, sf, "documents").select(path.alias("path")))


# ---------------------------------------------------------------- streams


def _stream(spark, sf, name, batches=3):
    """A table as a stream of several files, each a micro-batch of its own."""
    folder = _fresh(spark, f"in-{name}")
    rows = table(spark, sf, name)
    rows.repartition(batches).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@check("read_change_log", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    return read_change_log(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type")


@check("stream_latest_run", f"WITH {SQL_LOG} SELECT doc_id, change_id, summary, k AS blocks_changed FROM lt")
def _(spark, sf):
    out = inc.BatchTable(spark, _fresh(spark, "runs"))
    inc.stream_latest_run(change_log(_stream(spark, sf, "events")), "polish", out, _fresh(spark, "cp"))
    return inc.latest_runs(out).select("doc_id", "change_id", "summary", "blocks_changed")


@check(
    "stream_progress",
    "SELECT user_id AS job, count(*) AS total, count(*) FILTER (event_type <> 'view') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL",
)
def _(spark, sf):
    out = inc.BatchTable(spark, _fresh(spark, "progress"))
    inc.stream_progress(job_results(_stream(spark, sf, "events")), out, _fresh(spark, "cp"))
    return inc.progress(out)


def _replayed(spark, sf, name):
    """A table as a stream in which every row comes twice, in no order."""
    folder = _fresh(spark, f"twice-{name}")
    rows = table(spark, sf, name)
    rows.unionByName(rows).repartition(3).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


#: Longer than the log, so that no row of the shuffled stream is too late.
AGES = 86_400 * 3650


@check("stream_latest_keyed", f"WITH {SQL_LOG} SELECT doc_id, change_id, summary, k AS blocks_changed FROM lt")
def _(spark, sf):
    out = inc.BatchTable(spark, _fresh(spark, "keyed"))
    log = change_log(_replayed(spark, sf, "events"))
    log = log.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "resolved_at")})
    inc.stream_latest_keyed(log, "polish", out, _fresh(spark, "cp"), AGES)
    return inc.current(out).select("doc_id", "change_id", "summary", "blocks_changed")


@check(
    "stream_progress_keyed",
    "SELECT user_id AS job, count(*) AS total, count(*) FILTER (event_type <> 'view') AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL",
)
def _(spark, sf):
    events = _replayed(spark, sf, "events")
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").otherwise("ok")
    results = events.select(F.col("user_id").alias("job"), F.col("event_id").alias("item"), state.alias("state"), F.col("ts").cast("timestamp").alias("at"))
    out = inc.BatchTable(spark, _fresh(spark, "keyed"))
    inc.stream_progress_keyed(results, out, _fresh(spark, "cp"), AGES)
    return inc.current(out, key="job")


@check("stream_reindex", f"WITH {_INDEX} SELECT term, doc_id, field, count(*) AS tf FROM tok GROUP BY ALL")
def _(spark, sf):
    docs = _stream(spark, sf, "documents").select(
        "doc_id", F.concat_ws("-", "source", "doc_id").alias("slug"), F.concat("lang", F.lit(" "), "source").alias("title"), F.col("text").alias("body"),
        F.lit(1).alias("version"),
    )
    postings, lengths = inc.BatchTable(spark, _fresh(spark, "post")), inc.BatchTable(spark, _fresh(spark, "len"))
    inc.stream_reindex(docs, "version", postings, lengths, _fresh(spark, "cp"))
    return inc.current(postings, owners=lengths).select("term", "doc_id", "field", "tf")


@check("stream_live_search", _bm25({"f0": _one("the"), "f1": _one("attion")}, 20))
def _(spark, sf):
    """Documents in three micro-batches into the index that is searched."""
    docs = _stream(spark, sf, "documents").select(
        "doc_id", F.concat_ws("-", "source", "doc_id").alias("slug"), F.concat("lang", F.lit(" "), "source").alias("title"), F.col("text").alias("body"),
        F.lit(1).alias("version"),
    )
    index = li.LiveIndex(spark, _fresh(spark, "live"))
    inc.stream_live_index(docs, "version", index, _fresh(spark, "cp"), fan=2)
    return index.search("the attion").withColumn("score", F.round("score", 6))


@check("stream_dirty", f"WITH {_MATRIX} SELECT doc_id, target_id, status, dirty FROM mx")
def _(spark, sf):
    o = _stream(spark, sf, "orders")
    changes = o.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") == "5-LOW", "homepage").otherwise("memoir").alias("kind"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"), F.lit(1).alias("version"),
    )
    sync, snaps = states(spark, sf, once=True)
    out = inc.BatchTable(spark, _fresh(spark, "dirty"))
    inc.stream_dirty(changes, "version", targets(spark, sf), sync, snaps, out, _fresh(spark, "cp"))
    return inc.current(out).select("doc_id", "target_id", "status", "dirty")
