"""Page-layout tables: spans to lines, headings, note zones, captions, tiles, paragraphs.

Span rows: doc_id, page, block, line, span, x0, y0, x1, y1, size, bold, italic,
text, page_width, page_height. A printed page bounds every (doc_id, page) group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.ordered import grouped_map, number_rows
from quire.session import cut_lineage, written

PAGE = ["doc_id", "page"]
LINE = ["doc_id", "page", "block", "line"]
BLOCK = ["doc_id", "page", "block"]

# Layout thresholds.
PAGE_NUMBER_BAND, NOTE_BAND, NOTE_SIZE, CAPTION_SIZE = 0.88, 0.65, 0.92, 0.95
BOLD_SHARE, HEADING_CHARS, CENTRE_INDENT, CENTRE_DIFF = 0.8, 100, 0.12, 0.22
TOC_WORDS = ("contents", "table of contents", "index")
TILE_GAP, TILE_OVERLAP = 3.0, 0.7
NOTE_LEAD = r"(?s)\A\s*(\d{1,2})\s+(.+)\z"


def _placed(keys: list[str]) -> Column:
    """Every key is known, as where rows are joined by them."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _stretches(rows: DataFrame, flag: Column, out: str, keys: list[str]) -> DataFrame:
    """``out``: the line that opens the stretch of neighbours whose ``flag`` is equal and not null; a printed page bounds ``keys``."""
    up = Window.partitionBy(*keys).orderBy("line")
    rows = rows.withColumn("__flag", flag)
    rows = rows.withColumn("__new", F.when(~F.coalesce(F.lag("__flag").over(up) == F.col("__flag"), F.lit(False)), F.col("line")))
    return rows.withColumn(out, F.last("__new", True).over(up.rowsBetween(Window.unboundedPreceding, 0))).drop("__flag", "__new")


def half_point(size: Column) -> Column:
    return F.bround(size * 2, 0) / 2


def font_mode(spans: DataFrame) -> DataFrame:
    """Most frequent half-point size per document, first seen wins ties (A-11)."""
    first = F.min(F.struct("page", "block", "line", "span")).alias("first")
    bins = spans.where(F.col("size") > 0).groupBy("doc_id", half_point(F.col("size")).alias("size")).agg(F.count("*").alias("n"), first)
    return bins.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body_size"))


def heading_thresholds(modes: DataFrame) -> DataFrame:
    """h1 from 1.6 and h2 from 1.2 times the body size; -1 switches them off (A-12)."""
    on = F.col("body_size") > 0
    return modes.select(
        "doc_id", "body_size", F.when(on, F.col("body_size") * 1.6).otherwise(-1.0).alias("h1_size"), F.when(on, F.col("body_size") * 1.2).otherwise(-1.0).alias("h2_size")
    )


def size_kind(size: Column) -> Column:
    return F.when((F.col("h1_size") > 0) & (size >= F.col("h1_size")), "h1").when((F.col("h2_size") > 0) & (size >= F.col("h2_size")), "h2").otherwise("p")


def md_line(spans: Column) -> Column:
    """Styled spans as Markdown; adjacent equal styles merge, blanks stay outside the marks (F-22)."""
    said = lambda x: F.coalesce(x["text"], F.lit(""))
    styled = lambda x: _marked(x["text"], x["bold"], x["italic"])
    same = lambda x, y: F.coalesce(x, F.lit(False)) == F.coalesce(y, F.lit(False))

    # What is finished, and the spans of one style that are still open.
    def step(acc, r):
        goes_on = same(acc["bold"], r["bold"]) & same(acc["italic"], r["italic"])
        return F.when(
            acc["any"] & goes_on, F.struct(acc["done"].alias("done"), F.concat(acc["text"], said(r)).alias("text"), acc["bold"].alias("bold"), acc["italic"].alias("italic"), F.lit(True).alias("any"))
        ).otherwise(F.struct(F.concat(acc["done"], styled(acc)).alias("done"), said(r).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), F.lit(True).alias("any")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("any"))
    many = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], styled(acc)))
    # Most lines are one span, which has nothing to merge with.
    only = F.get(spans, F.lit(0))
    return tx.strip(F.when(F.size(spans) == 1, _marked(said(only), only["bold"], only["italic"])).otherwise(many))


def _marked(text: Column, bold: Column, italic: Column) -> Column:
    core = tx.strip(text)
    mark = F.when(bold & italic, "***").when(bold, "**").otherwise("*")
    lead = F.substring(text, F.lit(1), F.length(text) - F.length(tx.lstrip(text)))
    trail = F.substring(text, F.length(tx.rstrip(text)) + 1, F.length(text))
    return F.when((core == "") | ~(bold | italic), text).otherwise(F.concat(lead, mark, core, mark, trail))


def mode_of(values: Column) -> Column:
    """Most frequent value of a short array, first seen wins ties."""
    scored = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.coalesce(F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.array_max(scored)["v"]), F.lit(0.0))


def line_style(spans: DataFrame) -> DataFrame:
    """One row per line: text, Markdown, size mode, bold flag, box (A-13).

    Spans move to their page, so what follows by page, block or line needs no further shuffle.
    """
    parts = F.sort_array(F.collect_list(F.struct("span", "text", "bold", "italic", "size")))
    solid = F.length(F.translate("text", tx.BLANK_CHARS, ""))
    rows = spans.withColumn("__solid", solid).repartition(*PAGE).groupBy(*LINE).agg(
        parts.alias("s"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1", "page_width", "page_height")],
        F.sum("__solid").alias("__total"), F.sum(F.when(F.col("bold"), F.col("__solid")).otherwise(0)).alias("__bold"), (F.count("text") == F.count("*")).alias("__known"),
    )
    sizes = F.transform(F.filter("s", lambda s: s["size"] > 0), lambda s: half_point(s["size"]))
    text = tx.strip(F.array_join("s.text", ""))
    bold = F.col("__known") & (F.col("__total") > 0) & (F.col("__bold") / F.col("__total") >= BOLD_SHARE)
    return rows.select(
        *LINE, "x0", "y0", "x1", "y1", "page_width", "page_height", text.alias("text"), md_line(F.col("s")).alias("md"),
        F.when(text == "", 0.0).otherwise(mode_of(sizes)).alias("size"), F.coalesce(bold, F.lit(False)).alias("bold"),
    )


def text_blocks(lines: DataFrame) -> DataFrame:
    """Block rows: joined text, size mode, box."""
    kept = F.filter(F.sort_array(F.collect_list(F.struct("line", "text", "size"))), lambda r: r["text"] != "")
    rows = lines.groupBy(*BLOCK).agg(
        kept.alias("r"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1", "page_width", "page_height")]
    )
    size = mode_of(F.transform(F.filter("r", lambda r: r["size"] > 0), lambda r: r["size"]))
    return rows.where(F.size("r") > 0).select(
        *BLOCK, "x0", "y0", "x1", "y1", "page_width", "page_height", F.array_join("r.text", " ").alias("text"), size.alias("size")
    )


def is_page_number() -> Column:
    return (F.col("y0") > F.col("page_height") * PAGE_NUMBER_BAND) & F.col("text").rlike(r"\A\s*\d{1,4}\s*\z")


def drop_page_numbers(lines: DataFrame) -> DataFrame:
    """Lines without the blocks that only hold a page number at the foot (P-06)."""
    numbers = text_blocks(lines).where(is_page_number()).select(*BLOCK)
    return lines.join(numbers, BLOCK, "left_anti")


def drop_toc_pages(lines: DataFrame) -> DataFrame:
    """Pages that open with a contents or index heading lose all their text (P-07)."""
    first = text_blocks(lines).groupBy("doc_id", "page").agg(F.min_by("text", "block").alias("t"))
    low = F.lower(tx.strip(F.col("t")))
    word = F.get(F.split(low, rf"{tx.BLANK}|[—–-]", 2), F.lit(0))
    toc = first.where(low.isin(*TOC_WORDS) | word.isin(*TOC_WORDS)).select("doc_id", "page")
    return lines.join(toc, ["doc_id", "page"], "left_anti")


def split_bold_lines(lines: DataFrame) -> DataFrame:
    """Short bold lines become heading rows of their own, others stay grouped (W-33).

    Adds ``part`` (line number that opens the group) and ``kind`` h2/h3/p.
    Leading blank lines of a group are dropped, later ones kept as breaks. Lines
    move at most once, to their page.
    """
    said = F.col("text") != ""
    width = F.col("page_width")
    indent = F.col("x0") - F.col("__left")
    diff = F.abs(F.col("x0") - (width - F.col("x1")))
    centred = (indent >= width * CENTRE_INDENT) & (diff <= width * CENTRE_DIFF)
    level = F.when(F.coalesce(width, F.lit(0)) <= 0, "h2").when(
        centred & (tx.is_caps(F.col("text")) | tx.is_year_heading(F.col("text"))), "h2"
    ).otherwise("h3")
    heading = F.col("bold") & (F.col("text") != "") & (F.length("text") <= HEADING_CHARS)
    rows = lines.withColumn("__left", F.min(F.when(said, F.col("x0"))).over(Window.partitionBy(*PAGE)))
    rows = rows.withColumn("kind", F.when(heading, level).otherwise("p"))
    out = _stretches(rows, F.when(F.col("kind") == "p", F.lit(1)), "part", BLOCK)
    out = out.withColumn("__said", F.max(F.when(said, F.col("line"))).over(Window.partitionBy(*BLOCK).orderBy("line")))
    return out.where((F.col("__said") >= F.col("part")) & _placed(BLOCK)).select(*lines.columns, "part", "kind")


def split_footnote_zone(lines: DataFrame, modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(body lines with markers, notes) — the numbered small print at the foot of a block (W-31).

    The zone opens at the first low, small, numbered line of a block and runs to
    its end. Inside, a note opens only at the next number in sequence.
    """
    extra = [c for c in ("part", "kind") if c in lines.columns]
    keys = [*BLOCK, *(["part"] if "part" in extra else [])]
    sized = lines.join(modes, "doc_id", "left")
    lead = F.col("text").rlike(NOTE_LEAD)
    low = (F.col("y0") > F.col("page_height") * NOTE_BAND) & (F.col("size") > 0) & (F.col("size") <= F.col("body_size") * NOTE_SIZE)
    start = sized.where(lead & low & (F.col("body_size") > 0)).groupBy(*keys).agg(F.min("line").alias("__zone"))
    rows = cut_lineage(lines.join(start, keys, "left"))
    zone = rows.where((F.col("line") >= F.col("__zone")) & (F.col("text") != ""))
    number = F.when(lead, F.regexp_extract("text", NOTE_LEAD, 1).try_cast("int"))
    items = zone.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", number.alias("n"), "text"))).alias("z"))
    # the current number advances when its successor shows up; a blank state takes any number
    state = F.struct(F.lit(None).cast("int").alias("cur"), F.array().cast("array<struct<line:int,n:int>>").alias("at"))

    def step(acc, r):
        opens = r["n"].isNotNull() & (acc["cur"].isNull() | (r["n"] == acc["cur"] + 1))
        mark = F.array(F.struct(r["line"].cast("int").alias("line"), r["n"].alias("n")))
        return F.when(opens, F.struct(r["n"].alias("cur"), F.concat(acc["at"], mark).alias("at"))).otherwise(acc)

    opened = items.withColumn("at", F.aggregate("z", state, step)["at"])

    def body_of(a, i):
        stop = F.coalesce(F.get(F.col("at"), i + 1)["line"], F.lit(2**31 - 1))
        inside = F.filter("z", lambda r: (r["line"] >= a["line"]) & (r["line"] < stop))
        first = tx.strip(F.regexp_extract(inside[0]["text"], NOTE_LEAD, 2))
        rest = F.transform(F.slice(inside, F.lit(2), F.size(inside)), lambda r: tx.strip(r["text"]))
        return F.struct(a["n"].alias("local_num"), tx.strip(F.array_join(F.concat(F.array(first), rest), " ")).alias("text"))

    notes = opened.select(*keys, F.posexplode(F.transform("at", body_of)).alias("k", "note")).select(*keys, "k", "note.*").where(F.length("text") >= 6)
    order = [F.col(c) for c in (*keys[1:], "k")]
    numbered = cut_lineage(number_rows(notes, ["doc_id"], order, [F.col("page")], "n").withColumn("n", F.col("n").cast("int")))
    lifted = numbered.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "n", "local_num"))).alias("l"))
    kept = rows.where(F.col("__zone").isNull() | (F.col("line") < F.col("__zone")))
    last = kept.where(F.col("text") != "").groupBy(*keys).agg(F.max("line").alias("__last"))
    marked = kept.join(last, keys).join(lifted, keys, "left")
    mark = F.array_join(F.transform("l", lambda x: F.concat(F.lit("[^"), x["n"].cast("string"), F.lit("]"))), "")
    local = F.col("l")[0]["local_num"].cast("string")
    hit = (F.col("line") == F.col("__last")) & F.col("l").isNotNull()
    glued = lambda c: F.regexp_replace(F.col(c), F.concat(F.lit(r"(?<=\D)"), local, F.lit(r"\s*$")), F.lit(""))
    fixed = {c: F.when(hit, F.concat(tx.rstrip(glued(c)), mark)).otherwise(F.col(c)) for c in ("text", "md")}
    return cut_lineage(marked.withColumns(fixed).select(*lines.columns)), numbered.select("doc_id", "page", "block", "n", "local_num", "text")


# ---------------------------------------------------------------- captions


def _clip(text: Column, limit: int = 240) -> Column:
    return F.when(F.length(text) > limit, F.concat(tx.rstrip(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def _claim(max_lines: int, gap: float = 10.0):
    """Give each image of a page, in reading order, its unclaimed candidates chained from the top.

    Rows come sorted by page and image; a task holds the claims of one page.
    """
    names = ["doc_id", "page", "image", "cand", "nth", "text"]

    def claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken, image, chosen, bottom = None, set(), None, 0, None
        for pdf in batches:
            out = []
            for doc, page, picture, cand, y0, y1, text in zip(*(pdf[c].tolist() for c in ("doc_id", "page", "image", "cand", "y0", "y1", "text"))):
                if (doc, page) != at:
                    at, taken, image = (doc, page), set(), None
                if picture != image:
                    image, chosen, bottom = picture, 0, None
                if cand in taken or chosen < 0:
                    continue
                if chosen == max_lines or (bottom is not None and y0 - bottom > gap):
                    chosen = -1
                    continue
                out.append((doc, page, image, cand, chosen, text))
                taken.add(cand)
                chosen, bottom = chosen + 1, y1
            yield pd.DataFrame(out, columns=names)

    return claim


def _captions(candidates: DataFrame, max_lines: int) -> tuple[DataFrame, DataFrame]:
    schema = "doc_id long, page int, image int, cand string, nth int, text string"
    # Few bytes, but rows for Python: as many tasks as the session names.
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    claims = candidates.repartition(parts, *PAGE).sortWithinPartitions(*PAGE, "image", "y0", "cand").mapInPandas(_claim(max_lines), schema)
    claims = cut_lineage(claims)
    texts = F.filter(F.sort_array(F.collect_list(F.struct("nth", "text")))["text"], lambda t: t != "")
    captions = claims.groupBy("doc_id", "page", "image").agg(_clip(tx.strip(F.array_join(texts, " "))).alias("caption"))
    return captions, claims.select("doc_id", "page", "cand")


def _below(reach_up: float = 35.0, reach_down: float = 40.0) -> Column:
    return F.col("y0").between(F.col("iy1") - reach_up, F.col("iy1") + reach_down)


def _across() -> Column:
    return F.greatest(F.lit(0.0), F.least("x1", "ix1") - F.greatest("x0", "ix0"))


def _boxes(images: DataFrame) -> DataFrame:
    return images.select("doc_id", "page", "image", *[F.col(c).alias(f"i{c}") for c in ("x0", "x1", "y0", "y1")])


def caption_blocks(images: DataFrame, blocks: DataFrame, modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions, claimed blocks): small text right below an image, each block claimed once (J-09).

    ``images``: doc_id, page, image (reading order), box. A range join per page
    finds the candidates; only those reach the claiming step.
    """
    pairs = _boxes(images).join(blocks, ["doc_id", "page"]).join(modes, "doc_id", "left")
    size_ok = (F.coalesce(F.col("body_size"), F.lit(0.0)) <= 0) | (F.col("size") <= F.col("body_size") * CAPTION_SIZE)
    wide = F.greatest(F.lit(1.0), F.col("ix1") - F.col("ix0"))
    fits = _below() & (_across() / wide >= 0.25) & size_ok & (F.length("text") <= 240)
    cand = pairs.where(fits).select("doc_id", "page", "image", F.format_string("%08d", "block").alias("cand"), "y0", "y1", tx.strip(tx.squeeze(F.col("text"))).alias("text"))
    captions, claims = _captions(cand, 4)
    return captions, claims.select("doc_id", "page", F.col("cand").cast("int").alias("block"))


def caption_lines(images: DataFrame, lines: DataFrame, captioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions, claimed lines) for images no block gave a caption: lines inside the image's column (J-10)."""
    left = images.join(captioned.where(F.col("caption") != "").select("doc_id", "page", "image"), ["doc_id", "page", "image"], "left_anti")
    pairs = _boxes(left).join(lines.where(F.col("text") != ""), ["doc_id", "page"])
    inside = _across() / F.greatest(F.lit(1e-6), F.col("x1") - F.col("x0"))
    cand = pairs.where(_below() & (inside >= 0.7) & (F.length("text") <= 180)).select(
        "doc_id", "page", "image", F.format_string("%08d-%08d", "block", "line").alias("cand"), "y0", "y1", "text"
    )
    captions, claims = _captions(cand, 3)
    return captions, claims.select(
        "doc_id", "page", F.split_part("cand", F.lit("-"), F.lit(1)).cast("int").alias("block"), F.split_part("cand", F.lit("-"), F.lit(2)).cast("int").alias("line")
    )


# ---------------------------------------------------------------- tiles


#: Boxes of a page up to which all are compared with all, which is faster than a sweep there.
FEW_BOXES = 128


def _meet(box: np.ndarray, i, j: np.ndarray, band: int, edge: int) -> np.ndarray:
    """Which boxes j (x0, y0, x1, y1) meet box i: their bands agree by the overlap share of both, their edges are within the gap."""
    lo, hi, start, end = box[j, band], box[j, band + 2], box[j, edge], box[j, edge + 2]
    shared = np.maximum(0, np.minimum(hi, box[i, band + 2]) - np.maximum(lo, box[i, band]))
    longer = np.maximum(1e-6, np.maximum(hi - lo, box[i, band + 2] - box[i, band]))
    gap = np.maximum(start, box[i, edge]) - np.minimum(end, box[i, edge + 2])
    return (shared / longer >= TILE_OVERLAP) & (np.abs(gap) <= TILE_GAP)


def _root(label: list[int], i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = label[i]
    return i


def _few_pictures(box: np.ndarray) -> np.ndarray:
    """The same for a page of few boxes, compared all at once."""
    pairs = np.arange(len(box))
    meet = np.eye(len(box), dtype=bool)
    for band, edge in ((0, 1), (1, 0)):
        meet |= _meet(box, pairs[:, None], pairs[None, :], band, edge)
    label = pairs
    while True:
        lower = np.where(meet, label[None, :], len(box)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _pictures(box: np.ndarray) -> np.ndarray:
    """The least box that each box is connected with, by a sweep along each axis and union-find.

    Boxes that meet have bands of lengths within ``1 / TILE_OVERLAP`` of each other that begin within one length, so a
    box looks only into cells of its own and the two neighbouring powers of two. In a cell the boxes stand sorted by
    their end, and only those that end near this one's start are compared (or, where a box is no longer than the gap,
    those around it).
    """
    label = list(range(len(box)))
    for band, edge in ((0, 1), (1, 0)):
        long = box[:, band + 2] - box[:, band]
        level = np.floor(np.log2(np.maximum(long, 1e-6))).astype(int)
        cell = np.floor(box[:, band] / 2.0 ** (level + 1)).astype(int)
        found: dict[tuple[int, int], list[int]] = {}
        for i in np.argsort(box[:, edge + 2], kind="stable").tolist():
            found.setdefault((int(level[i]), int(cell[i])), []).append(i)
        cells = {k: (np.array(v), box[v, edge + 2]) for k, v in found.items()}
        for i in range(len(box)):
            start, thin = box[i, edge], box[i, edge + 2] - box[i, edge] <= TILE_GAP
            for k in range(level[i] - 1, level[i] + 2):
                reach = 2.0 ** (max(k, int(level[i])) + 1)
                for c in range(int(np.floor((box[i, band] - reach) / 2.0 ** (k + 1))), int(np.floor((box[i, band] + reach) / 2.0 ** (k + 1))) + 1):
                    if (k, c) not in cells:
                        continue
                    there, ends = cells[k, c]
                    lo = np.searchsorted(ends, start - TILE_GAP - 1e-6)
                    hi = len(ends) if thin else np.searchsorted(ends, start + TILE_GAP + 1e-6, "right")
                    for j in there[lo:hi][_meet(box, i, there[lo:hi], band, edge)].tolist():
                        a, b = _root(label, i), _root(label, j)
                        label[max(a, b)] = min(a, b)
    return np.array([_root(label, i) for i in range(len(box))], dtype=int)


def _page_pictures(page: pd.DataFrame) -> dict:
    box = page[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
    label = _few_pictures(box) if len(box) <= FEW_BOXES else _pictures(box)
    tile = page["tile"].to_numpy()
    rows = []
    order = np.argsort(label, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        rows.append((sorted(tile[mine].tolist()), *box[mine][:, :2].min(axis=0), *box[mine][:, 2:].max(axis=0)))
    rows.sort(key=lambda r: (round(r[2], 1), r[1], r[0][0]))
    out = dict(zip(("tiles", "x0", "y0", "x1", "y1"), map(list, zip(*rows))))
    return {"doc_id": [page["doc_id"].iloc[0]] * len(rows), "page": [page["page"].iloc[0]] * len(rows), **out, "image": list(range(len(rows)))}


def tile_components(images: DataFrame) -> DataFrame:
    """Connected tiles as one box with its tiles in document order, ranked by (y, x) per page (A-14).

    A picture lies on one printed page, so one shuffle by page settles it; a task holds the boxes of a page and looks at
    neighbours only.
    """
    schema = "doc_id long, page int, tiles array<int>, x0 double, y0 double, x1 double, y1 double, image int"
    return grouped_map(images.select("doc_id", "page", "tile", "x0", "y0", "x1", "y1"), ["doc_id", "page"], ["tile"], _page_pictures, schema)


# ---------------------------------------------------------------- paragraphs


def paragraph_groups(lines: DataFrame, thresholds: DataFrame, claimed_lines: DataFrame | None = None, claimed_blocks: DataFrame | None = None) -> DataFrame:
    """Draft rows in reading order: headings, and paragraphs split at blank lines (W-34).

    ``lines`` as left by the heading and note steps (with part and kind). They are written once, so that the sizes of a
    document can be dealt to its pages without the text; the lines then move once, to their page.
    """
    rows = lines = written(lines, "lines")
    if claimed_blocks is not None:
        rows = rows.join(claimed_blocks, BLOCK, "left_anti")
    if claimed_lines is not None:
        rows = rows.join(claimed_lines.withColumn("__claimed", F.lit(True)), LINE, "left").where(
            F.col("__claimed").isNull() | (F.col("text") == "")
        ).drop("__claimed")
    if claimed_blocks is None and claimed_lines is None:
        rows = _block_size(rows.join(_by_pages(lines, thresholds), PAGE, "left"))
    else:
        # A block's size is that of all its lines, claimed ones too.
        blocks = text_blocks(lines).select(*BLOCK, F.col("size").alias("__bsize"))
        rows = rows.join(blocks, BLOCK, "left").join(_by_pages(lines, thresholds), PAGE, "left")
    sized = rows.withColumn("kind", F.when(F.col("kind") == "p", size_kind(F.col("__bsize"))).otherwise(F.col("kind")))
    keys = [*BLOCK, "part"]
    grouped = _stretches(sized, F.when((F.col("text") != "") & (F.col("kind") == "p"), F.lit(1)), "group", keys).where(F.col("text") != "")
    # a large heading is one row per part even across blank lines
    group = F.when(F.col("kind") == "p", F.col("group")).otherwise(F.col("part"))
    shown = F.when(F.col("kind") == "p", F.col("md")).otherwise(F.col("text"))
    paras = grouped.withColumn("group", group).groupBy(*keys, "group", "kind").agg(
        tx.strip(F.array_join(F.sort_array(F.collect_list(F.struct("line", shown.alias("t"))))["t"], " ")).alias("text"),
        F.min_by("y0", "line").alias("__first_y"), F.min("y0").alias("__top"), F.max("size").alias("size"),
    )
    y = F.when(F.col("kind") == "p", F.col("__first_y")).otherwise(F.col("__top"))
    order = [F.col(c) for c in ("page", "y", "block", "part", "group")]
    # Numbered inside the page while the rows are there, written once, and moved on by the rows of the pages before.
    inside = paras.where(F.col("text") != "").withColumn("y", y).withColumn("__rn", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)))
    inside = written(inside.select(*PAGE, "kind", "text", "size", "__rn"), "paragraphs")
    earlier = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    bases = inside.groupBy(*PAGE).agg(F.count("*").alias("__n")).select(*PAGE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    same = reduce(lambda a, b: a & b, [inside[k].eqNullSafe(F.col(f"__{k}")) for k in PAGE])
    out = inside.join(bases.withColumnsRenamed({k: f"__{k}" for k in PAGE}), same)
    return out.select("doc_id", (F.col("__rn") + F.col("__base") - 1).cast("int").alias("pos"), "page", "kind", "text", "size")


def _by_pages(lines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The thresholds of a document for each of its pages."""
    return lines.select(*PAGE).distinct().join(thresholds, "doc_id")


def _block_size(rows: DataFrame) -> DataFrame:
    """``__bsize``: the most frequent size among a block's lines with text, first seen wins ties."""
    counts = (F.col("text") != "") & (F.col("size") > 0)
    alike = Window.partitionBy(*BLOCK, "size")
    rows = rows.withColumns({"__same": F.count(F.when(counts, F.lit(1))).over(alike), "__since": F.min(F.when(counts, F.col("line"))).over(alike)})
    rank = F.when(counts, F.struct("__same", -F.col("__since")))
    size = F.max_by("size", rank).over(Window.partitionBy(*BLOCK))
    return rows.withColumn("__bsize", F.when(_placed(BLOCK), size)).drop("__same", "__since")
