"""One text per document: safe Markdown, body HTML, reports and the home page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import runs as rn
from quire.functions import text as tx
from quire.operators.blocks import prop, word_counts
from quire.operators.ordered import assemble, following, islands, latest, scan
from quire.operators.structure import LISTS, emitted, figure_numbers, heading_anchors, lead_flags, list_runs, toc_headings
from quire.session import cut_lineage, written


def _prop(name: str) -> Column:
    return F.coalesce(prop(name), F.lit(""))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _with_panels(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Mark the first and last row of each run of equal kind among ``kinds``."""
    kind = F.when(F.col("type").isin(*kinds), F.col("type"))
    grouped = cut_lineage(islands(rows.select("doc_id", "pos", "type"), kind, kind, "__run"))
    ends = scan(grouped, __after=following(F.col("__run")))
    ends = ends.select(
        "doc_id", "pos", (F.col("pos") == F.col("__run")).alias("opens"), (~F.col("__run").eqNullSafe(F.col("__after"))).alias("closes")
    )
    return rows.join(ends, ["doc_id", "pos"])


def safe_markdown(docs: DataFrame, blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Labelled header, rule, body and footer per document (L-01).

    ``docs`` needs doc_id and a ``meta`` map. Figures show the sketch unless the
    mode asks for the original or none is stored; sources stay asset ids.
    """
    blocks = written(blocks, "blocks")  # read several times below
    stored = assets.select(F.col("sha256").alias("__sha")).distinct()
    figures = figure_numbers(blocks).select("doc_id", "pos", "n")
    md = tx.strip(rn.inline_md(F.col("runs")))
    blank = F.col("type").isin("narrative", "heading", "paragraph", "quote") & (md == "")
    rows = blocks.where((F.col("depth") == 0) & ~(blank & (F.col("type") == "narrative")))
    rows = _with_panels(rows, ("narrative",)).join(figures, ["doc_id", "pos"], "left")
    rows = rows.join(docs.select("doc_id", F.coalesce(F.col("meta")["canonical_url"], F.lit("")).alias("__url")), "doc_id")
    mode, sketch, original = _prop("safe_mode"), _prop("sketch_id"), _prop("asset_id")
    # which of its assets a figure shows, worked out on narrow rows of figures alone; an asset that many show is split by AQE
    wanted = blocks.where(F.col("type") == "image").select(
        "doc_id", "pos", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.when(mode != "original", sketch).alias("sha")), F.struct(F.lit(1).alias("k"), original.alias("sha")))).alias("a")
    ).where("a.sha != ''")
    have = wanted.select("doc_id", "pos", F.col("a.k").alias("k"), F.col("a.sha").alias("__sha")).join(stored, "__sha", "left_semi")
    shown = have.groupBy("doc_id", "pos").agg(F.min_by("__sha", "k").alias("__src"))
    rows = rows.join(shown, ["doc_id", "pos"], "left")
    src = F.coalesce("__src", F.lit(""))
    n = F.col("n").cast("string")
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    alt = flat(F.coalesce(F.nullif(_prop("alt_text"), F.lit("")), _cat("Figure ", n)))
    caption = tx.strip(flat(tx.html_fragment_to_md(_prop("caption"))))
    link = F.when(F.col("__url") != "", _cat(" — [View original photo](", F.col("__url"), "#figure-", n, ")")).otherwise("")
    figure = _cat("![", alt, "](", src, ")\n\n**Figure ", n, ".** ", caption, link, "\n\n")
    note = _cat("> **[", _prop("marker"), "]** ", tx.strip(tx.html_fragment_to_md(_prop("text"))), "\n\n")
    hashes = F.when(F.coalesce(F.col("level"), F.lit(2)) >= 3, "### ").otherwise("## ")
    kind = F.col("type")
    part = (
        F.when(kind == "narrative", _cat("> ", md, F.when(F.col("closes"), "\n\n").otherwise("\n>\n")))
        .when((kind == "image") & (mode != "omit"), figure)
        .when(kind == "footnote", note)
        .when((kind == "heading") & ~blank, _cat(hashes, md, "\n\n"))
        .when((kind == "paragraph") & ~blank, _cat(md, "\n\n"))
        .when((kind == "quote") & ~blank, _cat("> ", md, "\n\n"))
        .when(kind == "numberedListItem", _cat("1. ", md, "\n"))
        .when(kind == "bulletListItem", _cat("- ", md, "\n"))
        .when(kind == "divider", F.lit("---\n\n"))
    )
    body = assemble(rows, ["doc_id"], part, "__body", sep="")
    meta = lambda k: F.nullif(F.coalesce(F.col("meta")[k], F.lit("")), F.lit(""))
    fields = (
        ("Title", meta("title")), ("Standfirst", meta("standfirst")), ("Author", meta("author")), ("Years covered", meta("year_display")),
        ("Source name", F.coalesce(meta("slug"), meta("source_file"))), ("Word count", F.format_number(F.coalesce("words", F.lit(0)), 0)),
    )
    header = F.concat(*[F.coalesce(_cat(f"**{label}:** ", value, "  \n"), F.lit("")) for label, value in fields], F.lit("\n---\n\n"))
    foot = F.coalesce(_cat("---\n\n*", tx.strip(tx.html_fragment_to_md(meta("footer_html"))), "*\n\n"), F.lit(""))
    out = docs.join(word_counts(blocks), "doc_id", "left").join(body, "doc_id", "left")
    return out.select("doc_id", _cat(tx.rstrip(F.concat(header, F.coalesce("__body", F.lit("")), foot)), "\n").alias("markdown"))


def table_html(cells: Column) -> Column:
    """Rows of run arrays to an HTML table."""
    row = lambda r: _cat("<tr>", F.array_join(F.transform(r, lambda c: _cat("<td>", rn.inline_html(c), "</td>")), ""), "</tr>")
    return _cat("<table>", F.array_join(F.transform(cells, row), ""), "</table>")


def list_html(blocks: DataFrame) -> DataFrame:
    """doc_id, pos of the first item, __list: consecutive items of one kind with what is nested in them.

    The items of one list are folded in order; the fold keeps the tags of the open lists, so closing needs no look back.
    """
    item = F.col("type").isin(*LISTS)
    top = scan(blocks.select("doc_id", "pos", "type", "depth", "runs"), __top=latest(F.when(F.col("depth") == 0, F.struct("pos", "type"))))
    inside = top.where(item & F.col("__top.type").isin(*LISTS)).select("doc_id", "pos", "type", "depth", "runs", F.col("__top.pos").alias("__at"))
    heads = list_runs(blocks).select("doc_id", F.col("pos").alias("__at"), F.col("run"))
    tag = F.when(F.col("type") == "numberedListItem", "ol").otherwise("ul")
    rows = inside.join(heads, ["doc_id", "__at"]).groupBy("doc_id", F.col("run").alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "depth", tag.alias("tag"), rn.inline_html(F.col("runs")).alias("html")))).alias("items")
    )
    closed = lambda tags: F.array_join(F.transform(F.reverse(tags), lambda t: F.concat(F.lit("</li></"), t, F.lit(">"))), "")

    def step(acc, x):
        level = F.least(x["depth"], F.size(acc["open"]))  # an item no list has yet been opened for goes one level down
        deeper = level == F.size(acc["open"])
        done = closed(F.slice(acc["open"], level + 2, F.size(acc["open"])))
        start = F.when(deeper, F.concat(F.lit("<"), x["tag"], F.lit(">"))).otherwise(F.concat(done, F.lit("</li>")))
        return F.struct(
            F.concat(acc["html"], start, F.lit("<li>"), x["html"]).alias("html"),
            F.when(deeper, F.concat(acc["open"], F.array(x["tag"]))).otherwise(F.slice(acc["open"], F.lit(1), level + 1)).alias("open"),
        )

    zero = F.struct(F.lit("").alias("html"), F.array().cast("array<string>").alias("open"))
    whole = F.aggregate("items", zero, step, lambda acc: F.concat(acc["html"], closed(acc["open"])))
    return rows.select("doc_id", "pos", whole.alias("__list"))


def body_fragments(blocks: DataFrame, image_base: Column) -> DataFrame:
    """One HTML fragment per rendered row; panels open and close in place, a list stands at its first item (L-02).

    Tables come from a ``cells`` column (rows of run arrays) where there is one.
    """
    blocks = written(blocks, "blocks")  # read several times below
    rows = emitted(blocks).select(*blocks.columns, image_base.alias("__base"))
    anchors = heading_anchors(toc_headings(rows)).select("doc_id", "pos", "anchor")
    leads = lead_flags(rows).where("lead").select("doc_id", "pos", "lead")
    figures = figure_numbers(rows).select("doc_id", "pos", "n")
    full = _with_panels(rows, (*LISTS, "narrative"))
    for side in (anchors, leads, figures, list_html(blocks)):
        full = full.join(side, ["doc_id", "pos"], "left")
    html, kind, n = rn.inline_html(F.col("runs")), F.col("type"), F.col("n").cast("string")
    level = F.when(F.coalesce(F.col("level"), F.lit(2)) >= 3, "3").otherwise("2")
    src = _cat(F.col("__base"), "/figure-", n, "-original", F.coalesce(F.nullif(_prop("ext"), F.lit("")), F.lit(".jpeg")))
    opens, closes = F.col("opens"), F.col("closes")
    part = (
        F.when(kind == "heading", _cat("<h", level, ' id="', F.col("anchor"), '">', html, "</h", level, ">"))
        .when((kind == "paragraph") & F.col("lead"), _cat('<p class="lead">', html, "</p>"))
        .when(kind == "paragraph", _cat("<p>", html, "</p>"))
        .when(kind == "quote", _cat("<blockquote><p>", html, "</p></blockquote>"))
        .when(kind == "divider", F.lit("<hr>"))
        .when(kind == "footnote", _cat('<aside class="footnote"><sup>', _prop("marker"), "</sup> ", _prop("text"), "</aside>"))
        .when(
            kind == "image",
            _cat('<figure id="figure-', n, '"', F.when(_prop("display_width") == "portrait", ' class="portrait"').otherwise(""), '><img src="', src,
                 '" alt="', tx.html_escape(_prop("alt_text"), True), '"><figcaption>', _prop("caption"), "</figcaption></figure>"),
        )
        .when(
            kind == "narrative",
            _cat(F.when(opens, '<div class="narrative">').otherwise(""), "<p>", html, "</p>", F.when(closes, "</div>").otherwise("")),
        )
        .when(kind.isin(*LISTS), F.col("__list"))
        .when(kind == "table", table_html(F.col("cells")) if "cells" in blocks.columns else _prop("html"))
    )
    return full.select("doc_id", "pos", part.alias("html"))


def body_html(blocks: DataFrame, image_base: Column | None = None) -> DataFrame:
    base = F.lit("assets") if image_base is None else image_base
    return assemble(body_fragments(blocks, base), ["doc_id"], F.col("html"), "html")


# Track kinds in report order and their labels.
TRACK_LABELS = (("people", "People"), ("geo", "Geography"), ("glossary", "Glossary"), ("chronology", "Chronology"))


def counts_section(tracks: DataFrame, docs: DataFrame) -> DataFrame:
    """'- Label: n' lines per document in fixed order (A-16)."""
    counts = [F.count_if(F.col("track_type") == key).alias(key) for key, _ in TRACK_LABELS]
    per_doc = docs.select("doc_id").join(tracks.groupBy("doc_id").agg(*counts), "doc_id", "left").na.fill(0)
    lines = [_cat(f"- {label}: ", F.col(key).cast("string")) for key, label in TRACK_LABELS]
    return per_doc.select("doc_id", F.concat_ws("\n", *lines).alias("section"))


def _bullets(items: Column, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda t: F.concat(F.lit("- "), t)), "\n")).otherwise(F.lit(empty))


def report_markdown(docs: DataFrame, reports: DataFrame, tracks: DataFrame) -> DataFrame:
    """Fixed sections 0–6 per document with '(none …)' fallbacks (L-03).

    ``docs``: doc_id, title, slug, meta, words. ``reports``: doc_id, exec_summary,
    digest_md, stated, inferences, inconsistencies, anchors(section, attribution, quote).
    """
    meta = lambda k: F.nullif(F.coalesce(F.col("meta")[k], F.lit("")), F.lit(""))
    blank = lambda c: F.nullif(tx.strip(F.col(c)), F.lit(""))
    anchors = F.transform("anchors", lambda a: F.concat(
        F.lit("- *"), F.coalesce(a["section"], F.lit("")), F.lit("* — "), F.coalesce(a["attribution"], F.lit("")), F.lit(': "'),
        F.coalesce(a["quote"], F.lit("")), F.lit('"')))
    title = F.coalesce(meta("title"), F.col("title"))
    parts = (
        _cat("# Analytical Report — *", title, "*\n"),
        F.lit("### 0. Provenance header\n"),
        _cat(
            "- **Document:** *", title, "* (", F.coalesce(meta("author"), F.lit("")), ")\n- **Period covered:** ",
            F.coalesce(meta("year_display"), F.lit("")), "\n- **Source word count:** ", F.format_number(F.coalesce("words", F.lit(0)), 0),
            "\n- **Source name:** ", F.coalesce(meta("slug"), F.col("slug")),
        ),
        F.lit("\n### 1. Executive summary\n"),
        F.coalesce(blank("exec_summary"), F.lit("- (none generated)")),
        F.lit("\n### 2. Section-by-section digest\n"),
        F.coalesce(blank("digest_md"), F.lit("- (none)")),
        F.lit("\n### 3. Interpersonal & familial dynamics\n"),
        _cat("**Stated:**\n", _bullets(F.col("stated"), "- (none recorded)")),
        _cat("\n**[INFERENCE]:**\n", _bullets(F.col("inferences"), "- (none)")),
        F.lit("\n### 4. Source inconsistencies & open questions\n"),
        _bullets(F.col("inconsistencies"), "- (none identified)"),
        F.lit("\n### 5. Notable verbatim anchors\n"),
        F.when(F.size("anchors") > 0, F.array_join(anchors, "\n")).otherwise(F.lit("- (none selected)")),
        F.lit("\n### 6. Reference tracks\n"),
        F.col("section"),
    )
    full = docs.join(reports, "doc_id").join(counts_section(tracks, docs), "doc_id")
    return full.select("doc_id", _cat(F.concat_ws("\n", *parts), "\n").alias("body_md"))


def homepage_body(blocks: DataFrame, groups: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Entries, warnings and derived title and welcome of home pages (L-04).

    The first h1 is the title and other headings are section labels; group
    listings expand in place to ``members`` (group_id, rank, slug, title);
    consecutive panels share ``panel``. A listing without a usable group, and
    any block kind the page cannot show, becomes a warning row.
    """
    text, kind = rn.inline_text(F.col("runs")), F.col("type")
    tops = blocks.groupBy("doc_id").agg(
        F.min(F.when((F.col("type") == "heading") & (F.coalesce("level", F.lit(1)) == 1), F.col("pos"))).alias("__h1"),
        F.min(F.when(F.col("type") == "group_listing", F.col("pos"))).alias("__group"),
    )
    role = (
        F.when(F.col("pos").eqNullSafe(F.col("__h1")), "title")
        .when(kind == "heading", "seclabel")
        .when((kind == "paragraph") & (tx.strip(text) != ""), "intro")
        .when((kind == "narrative") & (tx.strip(text) != ""), "narrative")
        .when((kind == "dedication") & (_prop("text") != ""), "dedication")
        .when(kind == "divider", "hr")
    )
    rows = blocks.join(tops, "doc_id").select(
        "doc_id", "pos", "type", role.alias("role"), F.when(kind == "dedication", _prop("text")).otherwise(text).alias("text"),
        F.coalesce(F.regexp_extract(_prop("group_id"), r"^\d+$", 0).try_cast("long"), F.lit(0)).alias("group_id"),
        F.coalesce(F.col("pos") < F.col("__group"), F.lit(True)).alias("early"),
    )
    rows = cut_lineage(rows)
    known = groups.select("group_id", F.col("name").alias("group_name"))
    filled = members.select("group_id").distinct().withColumn("__filled", F.lit(True))
    listings = rows.where(F.col("type") == "group_listing").select("doc_id", "pos", "group_id").join(known, "group_id", "left").join(filled, "group_id", "left")
    warning = (
        F.when(F.col("group_id") == 0, "group listing without a group")
        .when(F.col("group_name").isNull(), F.concat(F.lit("group listing of unknown group "), F.col("group_id").cast("string")))
        .when(F.col("__filled").isNull(), F.concat(F.lit("group listing without members: "), F.col("group_name")))
    )
    judged = listings.withColumn("warning", warning)
    handled = ("heading", "paragraph", "narrative", "dedication", "divider", "group_listing")
    odd = rows.where(~F.col("type").isin(*handled)).select(
        "doc_id", "pos", F.concat(F.lit("block type not shown here: "), "type").alias("warning")
    )
    warnings = judged.where(F.col("warning").isNotNull()).select("doc_id", "pos", "warning").unionByName(odd)
    good = judged.where(F.col("warning").isNull()).select("doc_id", "pos", F.lit("group").alias("role"), F.col("group_name").alias("text"), "group_id")
    own = rows.where(F.col("role").isNotNull() & (F.col("role") != "title")).select(
        "doc_id", "pos", "role", "text", F.lit(None).cast("long").alias("group_id")
    )
    panel = F.when(F.col("role") == "narrative", F.lit(1))
    shown = islands(own.unionByName(good), panel, panel, "panel")
    # a group listing, shown or skipped, ends the stretch in which an intro can lead
    seen = own.select("doc_id", "pos").unionByName(listings.select("doc_id", "pos"))
    first = seen.groupBy("doc_id").agg(F.min("pos").alias("__first"))
    shown = shown.join(first, "doc_id").withColumn("lead", (F.col("role") == "intro") & (F.col("pos") == F.col("__first"))).drop("__first")
    entries = shown.withColumn("slot", F.lit(0).cast("long"))
    listed = shown.where(F.col("role") == "group").drop("text", "lead", "role").join(
        members.select("group_id", F.col("rank").alias("slot"), F.col("title").alias("text")), "group_id"
    )
    entries = entries.unionByName(listed.withColumns({"role": F.lit("member"), "lead": F.lit(False)}))
    titles = rows.where(F.col("role") == "title").select("doc_id", F.col("text").alias("title"))
    welcome = assemble(rows.where((F.col("role") == "intro") & F.col("early")), ["doc_id"], F.col("text"), "welcome", sep="\n\n")
    derived = blocks.select("doc_id").distinct().join(titles, "doc_id", "left").join(welcome, "doc_id", "left").na.fill("", ["welcome"])
    return {"entries": entries, "warnings": warnings, "derived": derived}
