"""Cleaning steps over ingest drafts derived from the corpus lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import drafts as dr
from quire.operators.ordered import following, prev, scan
from quire.plans.inputs import SQL_DRAFTS, SQL_LINES, drafts, lines, sql_strip, table
from quire.plans.registry import check
from quire.session import cut_lineage

# The Markdown twin of each line, by its length (Spark and SQL state the same rule).
SQL_MD = f"""{SQL_LINES},
md AS (SELECT doc_id, pos, text AS line, length(text) AS n, CASE WHEN length(text) <= 20 THEN 'head' WHEN length(text) <= 40 THEN 'img'
  WHEN length(text) <= 60 THEN 'cap' WHEN length(text) <= 80 THEN 'bold' WHEN length(text) <= 100 THEN 'def' ELSE 'p' END AS kind FROM lines)"""


def md_line(c, i):
    n = F.length(c)
    num = (n % 40).cast("string")
    return (
        F.when(n <= 20, F.concat(F.lit("## "), c, F.lit(" ##")))
        .when(n <= 40, F.concat(F.lit("![](m/"), n.cast("string"), F.lit(".png) "), c, F.lit(' <figure><img\n  alt="x" SRC="m/'), num, F.lit('.gif">\n</figure>')))
        .when(n <= 60, F.concat(F.lit("<figcaption><p>"), c, F.lit("</p></figcaption>")))
        .when(n <= 80, F.concat(F.lit("**"), F.translate(c, "*\\", ""), F.lit("**")))
        .when(n <= 100, F.concat(F.lit("[^"), num, F.lit("]: "), c))
        .otherwise(F.concat(c, F.lit("[^"), num, F.lit("]")))
    )


def md_once(spark, sf):
    """Markdown rows written out, for steps that read them several times."""
    return cut_lineage(dr.md_rows(markdown(spark, sf)))


def markdown(spark, sf):
    """One Markdown text per document, built from its lines."""
    strip = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda p: p != "")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(strip, md_line), "\n\n").alias("text"))


_SEGS = f"""WITH {SQL_MD},
seg AS (
  SELECT doc_id, pos, 0 AS s, 'h2' AS kind, line AS text, CAST(NULL AS VARCHAR) AS src FROM md WHERE kind = 'head'
  UNION ALL SELECT doc_id, pos, 0, 'image', NULL, 'm/' || n || '.png' FROM md WHERE kind = 'img'
  UNION ALL SELECT doc_id, pos, 1, 'p', line, NULL FROM md WHERE kind = 'img'
  UNION ALL SELECT doc_id, pos, 2, 'image', NULL, 'm/' || (n % 40) || '.gif' FROM md WHERE kind = 'img'
  UNION ALL SELECT doc_id, pos, 0, 'figcaption', line, NULL FROM md WHERE kind = 'cap'
  UNION ALL SELECT doc_id, pos, 0, 'p', '**' || translate(line, '*' || chr(92), '') || '**', NULL FROM md WHERE kind = 'bold'
  UNION ALL SELECT doc_id, pos, 0, 'p', '[^' || (n % 40) || ']: ' || line, NULL FROM md WHERE kind = 'def'
  UNION ALL SELECT doc_id, pos, 0, 'p', line || '[^' || (n % 40) || ']', NULL FROM md WHERE kind = 'p'),
rows AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, s) - 1 AS INTEGER) AS pos, kind, text, src FROM seg)"""


@check("md_rows", f"{_SEGS} SELECT doc_id, pos, kind, text, src FROM rows")
def _(spark, sf):
    return dr.md_rows(markdown(spark, sf)).select("doc_id", "pos", "kind", "text", "src")


@check(
    "figcaptions",
    f"""{_SEGS}, near AS (SELECT *, last_value(src IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM rows)
    SELECT doc_id, s AS src, arg_min(text, pos) AS caption FROM near WHERE kind = 'figcaption' AND s IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return dr.figcaptions(md_once(spark, sf))[0]


@check(
    "footnote_defs",
    f"""{_SEGS} SELECT doc_id, pos, CAST(regexp_extract(text, '^\\[\\^([0-9]+)\\]', 1) AS INTEGER) AS n, {sql_strip("regexp_replace(text, '^\\[\\^[0-9]+\\]:\\s*', '')")} AS text
    FROM rows WHERE kind = 'p' AND text LIKE '[^%]: %'""",
)
def _(spark, sf):
    return dr.footnote_defs(dr.md_rows(markdown(spark, sf)))[0]


@check(
    "gallery_captions",
    f"""{_SEGS}, f AS (SELECT doc_id, pos, kind = 'image' AS image, kind <> 'image' AND NOT text LIKE '**%**' AS prose FROM rows)
    SELECT doc_id, pos, (coalesce(lag(image) OVER w, false) OR coalesce(lead(image) OVER w, false))
      AND NOT (coalesce(lag(prose) OVER w, false) OR coalesce(lead(prose) OVER w, false)) AS gallery_caption
    FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def _(spark, sf):
    return dr.mark_gallery_captions(md_once(spark, sf)).select("doc_id", "pos", "gallery_caption")


@check(
    "promote_bold_headings",
    f"""{_SEGS}, k AS (SELECT *, coalesce(text, '') AS t, kind = 'image' AS im FROM rows),
    b AS (SELECT *, length(t) > 4 AND starts_with(t, '**') AND ends_with(t, '**') AS bold, length(t) > 2 AND starts_with(t, '*') AND NOT starts_with(t, '**') AND ends_with(t, '*') AS ital FROM k),
    n AS (SELECT *, NOT im AND t <> '' AND NOT bold AND NOT ital AS prose FROM b),
    g AS (SELECT *, (coalesce(lag(im) OVER w, false) OR coalesce(lead(im) OVER w, false)) AND NOT (coalesce(lag(prose) OVER w, false) OR coalesce(lead(prose) OVER w, false)) AS gallery,
      {sql_strip("substr(t, 3, length(t) - 4)")} AS inner_ FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT *, kind = 'p' AND bold AND inner_ <> '' AND NOT contains(inner_, '**') AND length(inner_) <= 100 AND NOT regexp_matches(inner_, '[.!?]$') AND NOT gallery AS up FROM g),
    h AS (SELECT doc_id, pos, src, CASE WHEN up THEN inner_ ELSE text END AS text,
      CASE WHEN up AND regexp_matches(inner_, '\\p{{L}}') AND NOT regexp_matches(inner_, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') THEN 'h2' WHEN up THEN 'h3' ELSE kind END AS kind FROM f),
    o AS (SELECT doc_id, min(pos) FILTER (kind = 'h1') AS h1, min(pos) FILTER (kind IN ('h2', 'h3')) AS head FROM h GROUP BY doc_id)
    SELECT h.doc_id, h.pos, CASE WHEN o.h1 IS NULL AND h.pos = o.head THEN 'h1' ELSE h.kind END AS kind, h.text, h.src FROM h JOIN o ON o.doc_id = h.doc_id""",
)
def _(spark, sf):
    return dr.promote_bold_headings(md_once(spark, sf))


def _captioned(spark, sf):
    """Draft rows whose lines of 41–60 characters are wholly bold."""
    rows = drafts(spark, sf)
    bold = F.col("kind") == "h3"
    return rows.withColumns(
        {
            "text": F.when(bold, F.concat(F.lit("**"), F.translate("text", "*\\", ""), F.lit("**"))).otherwise(F.col("text")),
            "kind": F.when(bold, "p").otherwise(F.col("kind")),
        }
    )


_BOLD = f"""WITH {SQL_DRAFTS},
bolded AS (SELECT doc_id, pos, CASE kind WHEN 'h3' THEN 'p' ELSE kind END AS kind, kind = 'h3' AS bold,
  CASE kind WHEN 'h3' THEN translate(text, '*' || chr(92), '') ELSE text END AS text, image FROM drafts),
up AS (SELECT *, CASE WHEN kind = 'image' THEN 0 ELSE 1 END AS brk, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS above FROM bolded),
run AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM up)"""


@check(
    "harvest_bold_captions",
    f"""{_BOLD}, caps AS (SELECT doc_id, g - 1 AS g, pos, text FROM run WHERE bold AND above = 'image')
    SELECT i.doc_id, i.image, arg_min(trim(c.text), c.pos) AS caption FROM run i JOIN caps c ON i.doc_id = c.doc_id AND i.g = c.g
    WHERE i.kind = 'image' GROUP BY ALL""",
)
def _(spark, sf):
    return dr.harvest_bold_captions(_captioned(spark, sf))[0]


@check("harvest_bold_captions_rows", f"{_BOLD} SELECT doc_id, pos, kind, image FROM run WHERE NOT (bold AND coalesce(above, '') = 'image')")
def _(spark, sf):
    return dr.harvest_bold_captions(_captioned(spark, sf))[1].select("doc_id", "pos", "kind", "image")


@check(
    "strip_front_matter",
    f"""WITH {SQL_DRAFTS}, c AS (SELECT doc_id, min(pos) FILTER (kind = 'h1') AS h1, min(pos) FILTER (kind IN ('h2', 'h3')) AS sub FROM drafts GROUP BY doc_id)
    SELECT d.doc_id, pos, kind, text, image FROM drafts d JOIN c ON c.doc_id = d.doc_id
    WHERE h1 IS NULL OR sub < h1 OR pos > h1 OR kind = 'image'""",
)
def _(spark, sf):
    return dr.strip_front_matter(drafts(spark, sf))


@check(
    "demote_extra_h1",
    f"""WITH {SQL_DRAFTS} SELECT doc_id, pos, CASE WHEN kind = 'h1' AND row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) > 1 THEN 'h2' ELSE kind END AS kind FROM drafts""",
)
def _(spark, sf):
    return dr.demote_extra_h1(drafts(spark, sf)).select("doc_id", "pos", "kind")


@check(
    "lift_h3_when_no_h2",
    f"""WITH {SQL_DRAFTS} SELECT doc_id, pos, CASE WHEN kind = 'h3' AND NOT bool_or(kind = 'h2') OVER (PARTITION BY doc_id) THEN 'h2' ELSE kind END AS kind FROM drafts""",
)
def _(spark, sf):
    return dr.lift_h3_when_no_h2(drafts(spark, sf)).select("doc_id", "pos", "kind")


def _broken(spark, sf):
    """Draft rows with the full stop taken off lines that hold a comma, and lower-case starts after images."""
    rows = drafts(spark, sf)
    cut = F.when(F.col("text").contains(","), F.rtrim(F.col("text"), F.lit("."))).otherwise(F.col("text"))
    low = F.when(F.length("text") % 2 == 0, F.lower(cut)).otherwise(cut)
    return rows.withColumn("text", F.when(F.col("kind") == "p", low).otherwise(F.col("text")))


_BROKEN = f"""{SQL_DRAFTS},
cut AS (SELECT doc_id, pos, kind, image, CASE WHEN contains(text, ',') THEN rtrim(text, '.') ELSE text END AS t, length(text) AS n, text FROM drafts),
broken AS (SELECT doc_id, pos, kind, image, CASE WHEN kind <> 'p' THEN text WHEN n % 2 = 0 THEN lower(t) ELSE t END AS text FROM cut)"""


@check(
    "relocate_figures",
    f"""WITH {_BROKEN},
    a AS (SELECT *, kind = 'image' OR kind IN ('h2', 'h3') AS filler FROM broken),
    b AS (SELECT *, sum(CASE WHEN filler AND coalesce(lag_f, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g
          FROM (SELECT *, lag(filler) OVER (PARTITION BY doc_id ORDER BY pos) AS lag_f FROM a)),
    c AS (SELECT doc_id, g, bool_or(filler) AS filler, arg_min(kind, pos) AS first_kind, min(pos) AS pos, arg_min(text, pos) AS text FROM b GROUP BY doc_id, g),
    d AS (SELECT *, lag(pos) OVER w AS into_pos, lag(first_kind) OVER w AS pk, lag(text) OVER w AS pt,
          lead(pos) OVER w AS moved, lead(first_kind) OVER w AS nk, lead(text) OVER w AS nt FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
    e AS (SELECT *, coalesce(filler AND first_kind = 'image' AND pk = 'p' AND nk = 'p' AND NOT regexp_matches(pt, '[.!?…]["”’'')\\]]*$')
          AND regexp_matches(nt, '^["“‘''(\\[]*\\p{{Ll}}'), false) AS fits FROM d),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k, g - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY g) AS chain FROM e WHERE fits),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY g) % 2 = 1 AS fires FROM f),
    fired AS (SELECT doc_id, into_pos, moved, nt FROM h WHERE fires)
    SELECT b.doc_id, b.pos, b.kind, b.image, CASE WHEN f.nt IS NULL THEN b.text ELSE trim(b.text || ' ' || f.nt) END AS text
    FROM broken b LEFT JOIN fired f ON f.doc_id = b.doc_id AND f.into_pos = b.pos
    WHERE NOT EXISTS (SELECT 1 FROM fired x WHERE x.doc_id = b.doc_id AND x.moved = b.pos)""",
)
def _(spark, sf):
    return dr.relocate_figures(_broken(spark, sf))


@check(
    "rejoin_paragraphs",
    f"""WITH {_BROKEN},
    f AS (SELECT *, rtrim(rtrim(text, '*')) AS fin, ltrim(ltrim(text, '*')) AS beg FROM broken),
    l AS (SELECT *, coalesce(kind = 'p' AND beg <> '' AND lag(kind) OVER w = 'p' AND lag(fin) OVER w <> ''
          AND NOT regexp_matches(lag(fin) OVER w, '[.?!…:"''’”)\\]}}]$'), false) AS joins FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l)
    SELECT doc_id, min(pos) AS pos, min(kind) AS kind, min(image) AS image, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, g""",
)
def _(spark, sf):
    return dr.rejoin_paragraphs(_broken(spark, sf))


def _neighbour_captions(spark, sf):
    """Captions by content id: the text after the image when its id starts low, else the text before."""
    rows = drafts(spark, sf)
    near = scan(rows, up=prev(F.col("text")), down=following(F.col("text"))).where(F.col("kind") == "image")
    caption = F.when(F.col("image") < "8", F.col("down")).otherwise(F.col("up"))
    return rows, cut_lineage(near.groupBy("doc_id", "image").agg(F.min(caption).alias("caption")))


@check(
    "drop_caption_duplicates",
    f"""WITH RECURSIVE {SQL_DRAFTS}, nb AS (SELECT *, lag(pos) OVER w AS up, lag(kind) OVER w AS up_kind, lag(text) OVER w AS up_text,
      lead(pos) OVER w AS down, lead(kind) OVER w AS down_kind, lead(text) OVER w AS down_text FROM drafts WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    cp AS (SELECT doc_id, image, min(CASE WHEN image < '8' THEN down_text ELSE up_text END) AS cap FROM nb WHERE kind = 'image' GROUP BY ALL),
    im AS (SELECT n.doc_id, up, down, row_number() OVER (PARTITION BY n.doc_id ORDER BY pos) AS k, coalesce(cap <> '' AND up_kind IN ('h2', 'h3', 'p') AND up_text = cap, false) AS l,
      coalesce(cap <> '' AND down_kind IN ('h2', 'h3', 'p') AND down_text = cap, false) AS r FROM nb n JOIN cp c ON c.doc_id = n.doc_id AND c.image = n.image WHERE n.kind = 'image'),
    go AS (SELECT doc_id, k, CASE WHEN l THEN up WHEN r THEN down END AS taken FROM im WHERE k = 1
      UNION ALL SELECT i.doc_id, i.k, CASE WHEN i.l AND i.up IS DISTINCT FROM g.taken THEN i.up WHEN i.r THEN i.down END FROM go g JOIN im i ON i.doc_id = g.doc_id AND i.k = g.k + 1)
    SELECT d.* FROM drafts d ANTI JOIN (SELECT DISTINCT doc_id, taken FROM go WHERE taken IS NOT NULL) x ON x.doc_id = d.doc_id AND x.taken = d.pos""",
)
def _(spark, sf):
    return dr.drop_caption_duplicates(*_neighbour_captions(spark, sf))


def _noted(spark, sf):
    """(rows, notes): p lines end in a marker and lines of 61–100 characters are the notes."""
    rows = drafts(spark, sf)
    num = (F.length("text") % 60).cast("string")
    p = F.col("kind") == "p"
    marked = F.concat(F.lit("["), F.col("text"), F.lit("[^"), num, F.lit("] and[^"), (F.length("text") % 7).cast("string"), F.lit("]"))
    notes = lines(spark, sf).where(F.length("text").between(61, 100)).groupBy("doc_id", (F.length("text") % 60).alias("n")).agg(
        F.min("text").alias("text")
    )
    return rows.where(F.col("kind") != "image").withColumn("text", F.when(p, marked).otherwise(F.col("text"))), notes


_NOTED = f"""{SQL_DRAFTS},
notes AS (SELECT doc_id, length(text) % 60 AS n, min(text) AS text FROM lines WHERE length(text) BETWEEN 61 AND 100 GROUP BY ALL),
body AS (SELECT doc_id, pos, kind, text, length(text) % 60 AS a, length(text) % 7 AS b FROM drafts WHERE kind <> 'image'),
refs AS (SELECT doc_id, pos, 0 AS idx, a AS n FROM body WHERE kind = 'p' UNION ALL SELECT doc_id, pos, 1, b FROM body WHERE kind = 'p'),
firsts AS (SELECT r.doc_id, r.n, min(pos * 2 + idx) AS spot FROM refs r SEMI JOIN notes s ON s.doc_id = r.doc_id AND s.n = r.n GROUP BY ALL),
numbered AS (SELECT doc_id, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS INTEGER) AS new_n FROM firsts)"""


@check(
    "renumber_footnotes",
    f"""WITH {_NOTED} SELECT body.doc_id, body.pos, body.kind, CASE WHEN kind = 'p' THEN '[' || text || '[^' || coalesce(x.new_n, a) || '] and[^' || coalesce(y.new_n, b) || ']' ELSE text END AS text
    FROM body LEFT JOIN numbered x ON x.doc_id = body.doc_id AND x.n = a LEFT JOIN numbered y ON y.doc_id = body.doc_id AND y.n = b""",
)
def _(spark, sf):
    return dr.renumber_footnotes(*_noted(spark, sf))["rows"].select("doc_id", "pos", "kind", "text")


@check("renumber_footnotes_notes", f"WITH {_NOTED} SELECT s.doc_id, new_n AS n, text FROM notes s JOIN numbered m ON m.doc_id = s.doc_id AND m.n = s.n")
def _(spark, sf):
    return dr.renumber_footnotes(*_noted(spark, sf))["notes"]


@check(
    "renumber_footnotes_orphans",
    f"""WITH {_NOTED}, o AS (SELECT r.doc_id, r.pos, r.idx, CAST(r.n AS INTEGER) AS n FROM refs r ANTI JOIN notes s ON s.doc_id = r.doc_id AND s.n = r.n),
    t AS (SELECT o.*, '[' || text || '[^' || a || '] and[^' || b || ']' AS full_text,
      length(text) + 1 + CASE WHEN idx = 1 THEN length('[^' || a || '] and') ELSE 0 END AS spot, length('[^' || o.n || ']') AS m FROM o JOIN body ON body.doc_id = o.doc_id AND body.pos = o.pos)
    SELECT doc_id, pos, idx, n, {sql_strip('substring(full_text, spot - 19, 40 + m)')} AS snippet FROM t""",
)
def _(spark, sf):
    return dr.orphan_refs(*_noted(spark, sf)).withColumn("idx", F.col("idx").cast("int"))


@check(
    "known_minus_seen",
    f"WITH {_NOTED} SELECT doc_id, CAST(n AS INTEGER) AS n FROM notes s ANTI JOIN numbered m ON m.doc_id = s.doc_id AND m.n = s.n",
)
def _(spark, sf):
    return dr.renumber_footnotes(*_noted(spark, sf))["dropped"]


@check(
    "colocate_footnotes",
    f"""WITH {_NOTED} SELECT doc_id, pos, 0 AS slot, kind, CASE WHEN kind = 'p' THEN '[' || text || '[^' || a || '] and[^' || b || ']' ELSE text END AS text, CAST(NULL AS INTEGER) AS n FROM body
    UNION ALL SELECT f.doc_id, CAST(spot // 2 AS INTEGER), CAST(spot % 2 + 1 AS INTEGER), 'footnote', s.text, CAST(f.n AS INTEGER) FROM firsts f JOIN notes s ON s.doc_id = f.doc_id AND s.n = f.n""",
)
def _(spark, sf):
    return dr.colocate_footnotes(*_noted(spark, sf))


def _tailed(spark, sf):
    """Draft rows where lines over 200 characters read 'line N Then the line again'."""
    rows, notes = _noted(spark, sf)
    rows = drafts(spark, sf)
    tail = F.concat("text", F.lit(" "), (F.length("text") % 60).cast("string"), F.lit(" Then "), "text")
    return rows.withColumn("text", F.when(F.length("text") > 200, tail).otherwise(F.col("text"))), notes


@check(
    "split_orphan_notes",
    f"""WITH {_NOTED}, long AS (SELECT doc_id, pos, text, CAST(length(text) % 60 AS INTEGER) AS n FROM drafts WHERE length(text) > 200 AND kind = 'p' AND regexp_matches(text, '[.!?]$')),
    free AS (SELECT l.* FROM long l ANTI JOIN notes s ON s.doc_id = l.doc_id AND s.n = l.n)
    SELECT doc_id, n, min(pos) AS pos, arg_min('Then ' || text, pos) AS text FROM free
    GROUP BY doc_id, n""",
)
def _(spark, sf):
    return dr.split_orphan_notes(*_tailed(spark, sf))[1]


@check(
    "nearby_caption",
    f"""WITH {SQL_DRAFTS}, n AS (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM drafts)
    SELECT doc_id, pos, image, substring(coalesce(t, ''), 1, 200) AS nearby_caption FROM n WHERE kind = 'image'""",
)
def _(spark, sf):
    return dr.nearby_captions(drafts(spark, sf))


@check(
    "dedup_images",
    f"""WITH {SQL_DRAFTS}, n AS (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM drafts),
    f AS (SELECT doc_id, image, min(pos) AS first_pos, arg_min(substring(t, 1, 200), pos) FILTER (t <> '') AS caption FROM n WHERE kind = 'image' GROUP BY ALL)
    SELECT d.doc_id, d.pos, d.image, o.ord AS "order", coalesce(caption, '') AS caption FROM drafts d
    JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS ord FROM f) o ON o.doc_id = d.doc_id AND o.image = d.image""",
)
def _(spark, sf):
    return dr.dedup_images(drafts(spark, sf))


@check(
    "caption_precedence",
    f"""{_SEGS}, near AS (SELECT *, last_value(src IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS s, last_value(CASE WHEN kind = 'p' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM rows),
    caps AS (SELECT doc_id, s AS src, arg_min(text, pos) AS caption FROM near WHERE kind = 'figcaption' AND s IS NOT NULL GROUP BY ALL)
    SELECT n.doc_id, n.pos, n.src AS image, substring(coalesce(t, ''), 1, 200) AS nearby_caption, coalesce(c.caption, nullif(substring(coalesce(t, ''), 1, 200), ''), '') AS caption
    FROM near n LEFT JOIN caps c ON c.doc_id = n.doc_id AND c.src = n.src WHERE n.kind = 'image'""",
)
def _(spark, sf):
    rows = md_once(spark, sf).withColumnRenamed("src", "image")
    caps, _ = dr.figcaptions(rows.withColumnRenamed("image", "src"))
    near = dr.nearby_captions(rows.withColumn("text", F.when(F.col("kind").isin("p", "image"), F.col("text"))))
    none = caps.select("doc_id", F.col("src").alias("image"), "caption")
    return dr.caption_precedence(near, none.where(F.length("caption") > 100), none, none.where(F.length("caption") > 100))


@check(
    "detect_title",
    f"""WITH {SQL_DRAFTS}, f AS (SELECT doc_id, arg_min(trim(replace(substring(text, 1, 200), chr(92), '')), pos) AS t FROM drafts WHERE kind IN ('h1', 'h2', 'p') GROUP BY doc_id)
    SELECT d.doc_id, coalesce(CASE WHEN lang = 'fr' THEN d.source END, f.t, 'doc' || d.doc_id) AS title FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", F.col("source")).otherwise(" ").alias("title"), F.concat(F.lit("doc"), "doc_id").alias("stem")
    )
    return dr.detect_title(drafts(spark, sf), docs)


@check("normalise_drafts")
def normalised(spark, sf):
    """Broken sentences, repeated captions and notes through the whole cleaning pass."""
    rows = _broken(spark, sf)
    _, notes = _noted(spark, sf)
    marked = F.when((F.col("kind") == "p") & (F.length("text") % 3 == 0), F.concat("text", F.lit("[^"), (F.length("text") % 60).cast("string"), F.lit("]"))).otherwise(F.col("text"))
    return dr.normalise(rows.withColumn("text", marked), _neighbour_captions(spark, sf)[1], notes)["rows"]


@check(
    "draft_to_blocks",
    f"""WITH {_NOTED}, w AS (SELECT doc_id, pos, 0 AS slot, CASE kind WHEN 'p' THEN 'paragraph' ELSE 'heading' END AS type, CASE kind WHEN 'h2' THEN 2 WHEN 'h3' THEN 3 END AS level,
      CASE WHEN kind = 'p' THEN '[' || text || '[^' || a || '] and[^' || b || ']' ELSE text END AS body FROM body WHERE kind <> 'h1'
      UNION ALL SELECT f.doc_id, CAST(spot // 2 AS INTEGER), CAST(spot % 2 + 1 AS INTEGER), 'footnote', NULL, s.text FROM firsts f JOIN notes s ON s.doc_id = f.doc_id AND s.n = f.n
      UNION ALL SELECT doc_id, pos, 0, 'image', NULL, substring(image, 1, 8) FROM drafts WHERE kind = 'image')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, slot) - 1 AS INTEGER) AS pos, type, level, body FROM w""",
)
def _(spark, sf):
    rows, notes = _noted(spark, sf)
    every = rows.unionByName(drafts(spark, sf).where(F.col("kind") == "image"))
    images = drafts(spark, sf).where(F.col("kind") == "image").select(
        "doc_id", "image", F.substring("image", 1, 8).alias("caption"), F.lit(3).alias("width"), F.lit(4).alias("height")
    ).distinct()
    out = dr.draft_to_blocks(every, notes, images)
    body = F.when(F.col("type") == "image", F.col("props")["caption"]).when(F.col("type") == "footnote", F.col("props")["text"]).otherwise(F.col("text"))
    return out.select("doc_id", "pos", "type", "level", body.alias("body"))
