"""Cleaning steps over ingest-draft rows (doc_id, pos, kind h1/h2/h3/p/image, text, image).

Positions order the rows and may have gaps; a step that drops rows leaves the
others' positions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import runs as rn
from quire.functions import text as tx
from quire.operators.membership import sifted
from quire.operators.ordered import SEG, following, islands, latest, number_rows, prev, running, scan, segment
from quire.session import cut_lineage, written

# How a paragraph end is judged.
BREAK_END = r"[.?!…:\"'’”)\]}]\z"
SENTENCE_END = r"[.!?…][\"”’')\]]*\z"
LOWER_START = r"\A[\"“‘'(\[]*\p{Ll}"
MARKER = r"\[\^(\d+)\]"


def _at(rows: DataFrame, places: DataFrame, by: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(rows that may lie at one of the places (doc_id, ``by``), the others): what a step leaves alone does not move."""
    key = F.xxhash64("doc_id", by)
    may, rest = sifted(rows.withColumn("__at", key), "__at", places.select(key.alias("__at")), "__at")
    return may.select(*rows.columns), (rows.limit(0) if rest is None else rest.select(*rows.columns))


def _digest(text: Column) -> Column:
    """128 bits that stand for a text where it is only compared."""
    return F.unhex(F.md5(text))


# ---------------------------------------------------------------- Markdown source


def md_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Markdown text to draft rows with images and figure captions split out (S-02, S-09, S-10).

    Everything happens inside the document's own row, so nothing is shuffled:
    doc_id, pos, kind (h1–h3, p, image, figcaption), text, src.
    """
    whole = F.regexp_replace(join_img_tags(F.col(text_col)), r"[ \t]*</?figure>[ \t]*", "")
    paras = F.filter(F.transform(F.split(tx.strip(whole), r"\n\s*\n"), tx.strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paras, image_segments))
    rows = docs.select("doc_id", F.posexplode(pieces).alias("pos", "s")).select("doc_id", "pos", "s.*")
    head = r"(?s)\A(#{1,3})\s+(.*?)\s*#*\s*\z"
    cap = r"(?is)<figcaption\b[^>]*>(.*?)</figcaption>"
    t = F.col("text")
    one_line = ~t.contains("\n")
    kind = (
        F.when(F.col("src").isNotNull(), "image")
        .when(t.rlike(cap), "figcaption")
        .when(t.rlike(head) & one_line, F.concat(F.lit("h"), F.length(F.regexp_extract(t, head, 1)).cast("string")))
        .otherwise("p")
    )
    text = (
        F.when(F.col("kind") == "figcaption", tx.strip_html(F.regexp_extract(t, cap, 1)))
        .when(F.col("kind").isin("h1", "h2", "h3"), tx.strip(F.regexp_extract(t, head, 2)))
        .when(F.col("kind") == "p", tx.strip(tx.strip_sup_sub(t)))
    )
    rows = rows.withColumn("kind", kind)
    return rows.withColumn("text", text).where((F.col("kind") != "p") | (F.col("text") != ""))


def join_img_tags(c: Column) -> Column:
    """Put every multi-line <img …> tag on one line."""
    tag = r"(?is)<img\b[^>]*?>"
    tags = F.regexp_extract_all(c, F.lit(r"(?is)(<img\b[^>]*?>)"), 1)
    pieces = F.split(c, tag, -1)
    return F.array_join(
        F.flatten(F.zip_with(pieces, tags, lambda p, t: F.array(p, F.coalesce(tx.squeeze(t), F.lit(""))))), ""
    )


def image_segments(paragraph: Column) -> Column:
    """Ordered array of {text, src} over one paragraph; a whole image token is consumed (S-09)."""
    token = r"""(?is)!\[[^\]]*\]\([^)]+\)|<img\b[^>]*?\bsrc\s*=\s*["'][^"']+["'][^>]*?>"""
    tokens = F.regexp_extract_all(paragraph, F.lit("(" + token + ")"), 1)
    pieces = F.split(paragraph, token, -1)

    def pair(piece, tok):
        md = F.regexp_extract(tok, r"(?s)\A!\[[^\]]*\]\(([^)]+)\)", 1)
        html = F.regexp_extract(tok, r"""(?is)\bsrc\s*=\s*["']([^"']+)["']""", 1)
        src = F.when(tok.isNotNull(), F.when(md != "", md).otherwise(html))
        text = F.nullif(tx.strip(piece), F.lit(""))
        return F.array(
            F.struct(text.alias("text"), F.lit(None).cast("string").alias("src")),
            F.struct(F.lit(None).cast("string").alias("text"), src.alias("src")),
        )

    return F.filter(F.flatten(F.zip_with(pieces, tokens, pair)), lambda s: s["text"].isNotNull() | s["src"].isNotNull())


def figcaptions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions per image source, rows without caption segments); first non-blank wins (S-12)."""
    at = scan(rows, near=latest(F.col("src")))
    caps = (
        at.where((F.col("kind") == "figcaption") & (F.col("text") != "") & F.col("near").isNotNull())
        .groupBy("doc_id", F.col("near").alias("src"))
        .agg(F.min_by("text", "pos").alias("caption"))
    )
    return caps, rows.where(F.col("kind") != "figcaption")


def footnote_defs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, rows without definition paragraphs); empty definitions vanish from both (S-11)."""
    shape = r"(?s)\A\[\^(\d+)\]:\s*(.*)\z"
    t = tx.strip(F.col("text"))
    number = F.regexp_extract(t, shape, 1).try_cast("int")
    # a number no int holds makes no note: the paragraph stays text
    is_def = (F.col("kind") == "p") & F.coalesce(t.rlike(shape), F.lit(False)) & number.isNotNull()
    notes = (
        rows.where(is_def)
        .select("doc_id", number.alias("n"), "pos", tx.strip(F.regexp_extract(t, shape, 2)).alias("text"))
        .where(F.col("text") != "")
    )
    return notes, rows.where(~is_def)


# ---------------------------------------------------------------- bold headings and captions

BOLD_ONLY = r"(?s)\A\*\*(.+?)\*\*\z"
ITALIC_ONLY = r"(?s)\A\*(?!\*)(.+?)\*\z"


def _trimmed() -> Column:
    return tx.strip(F.coalesce(F.col("text"), F.lit("")))


def is_prose() -> Column:
    t = _trimmed()
    return (F.col("kind") != "image") & (t != "") & ~t.rlike(BOLD_ONLY) & ~t.rlike(ITALIC_ONLY)


def mark_gallery_captions(rows: DataFrame, out: str = "gallery_caption") -> DataFrame:
    """True for rows next to an image with no prose on either side (W-10)."""
    side = F.struct((F.col("kind") == "image").alias("image"), is_prose().alias("prose"))
    near = scan(rows, __before=prev(side), __after=following(side))
    either = lambda f: F.coalesce(F.col("__before")[f], F.lit(False)) | F.coalesce(F.col("__after")[f], F.lit(False))
    return near.withColumn(out, either("image") & ~either("prose")).drop("__before", "__after")


def promote_bold_headings(rows: DataFrame, max_chars: int = 100) -> DataFrame:
    """Wholly bold short paragraphs become h2 (all caps) or h3; a document left without h1 lifts its first heading (W-09)."""
    t = _trimmed()
    inner = tx.strip(F.regexp_extract(t, BOLD_ONLY, 1))
    clean = tx.strip(F.replace(inner, F.lit("\\"), F.lit("")))
    fits = (
        (F.col("kind") == "p") & t.rlike(BOLD_ONLY) & (inner != "") & ~inner.contains("**")
        & (F.length(inner) <= max_chars) & ~inner.rlike(r"[.!?]\z") & (clean != "") & ~F.col("gallery_caption")
    )
    caps = clean.rlike(r"\p{L}") & ~clean.rlike(r"[\p{L}&&[^\p{Lu}]]")
    marked = mark_gallery_captions(rows).withColumn("__promote", fits)
    marked = marked.withColumns(
        {
            "kind": F.when(F.col("__promote"), F.when(caps, "h2").otherwise("h3")).otherwise(F.col("kind")),
            "text": F.when(F.col("__promote"), clean).otherwise(F.col("text")),
        }
    ).select(*rows.columns)
    tops = marked.groupBy("doc_id").agg(
        F.min(F.when(F.col("kind") == "h1", F.col("pos"))).alias("__h1"),
        F.min(F.when(F.col("kind").isin("h2", "h3"), F.col("pos"))).alias("__head"),
    )
    lift = F.col("__h1").isNull() & (F.col("pos") == F.col("__head"))
    return marked.join(tops, "doc_id").withColumn("kind", F.when(lift, "h1").otherwise(F.col("kind"))).select(*rows.columns)


def harvest_bold_captions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(caption per image, rows without caption paragraphs): a bold line right after a run of images (W-11)."""
    image = F.when(F.col("kind") == "image", F.lit(1))
    runs = cut_lineage(islands(rows, image, image, "__run"))
    near = scan(runs, __above=prev(F.when(F.col("kind") == "image", F.col("__run"))))
    inner = F.regexp_extract(_trimmed(), BOLD_ONLY, 1)
    clean = tx.strip(F.replace(inner, F.lit("\\"), F.lit("")))
    hit = (F.col("kind") == "p") & F.col("__above").isNotNull() & (clean != "") & ~inner.contains("**")
    found = near.withColumn("__hit", hit)
    captions = found.where("__hit").select("doc_id", F.col("__above").alias("__run"), "pos", clean.alias("caption"))
    images = runs.where(F.col("kind") == "image").select("doc_id", "__run", "image")
    best = images.join(captions, ["doc_id", "__run"]).groupBy("doc_id", "image").agg(F.min_by("caption", "pos").alias("caption"))
    return best, found.where(~F.col("__hit")).select(*rows.columns)


# ---------------------------------------------------------------- document normalisation


def strip_front_matter(rows: DataFrame) -> DataFrame:
    """Drop everything up to the first h1 except images, unless an h2/h3 comes first (W-06)."""
    cuts = rows.groupBy("doc_id").agg(
        F.min(F.when(F.col("kind") == "h1", F.col("pos"))).alias("__h1"),
        F.min(F.when(F.col("kind").isin("h2", "h3"), F.col("pos"))).alias("__sub"),
    )
    cuts = cuts.select("doc_id", F.when(F.coalesce(F.col("__sub") > F.col("__h1"), F.col("__h1").isNotNull()), F.col("__h1")).alias("__cut"))
    keep = F.col("__cut").isNull() | (F.col("pos") > F.col("__cut")) | (F.col("kind") == "image")
    return rows.join(cuts, "doc_id").where(keep).select(*rows.columns)


def demote_extra_h1(rows: DataFrame) -> DataFrame:
    """Second and later h1 become h2 (W-07)."""
    first = rows.where(F.col("kind") == "h1").groupBy("doc_id").agg(F.min("pos").alias("__h1"))
    later = (F.col("kind") == "h1") & (F.col("pos") > F.col("__h1"))
    return rows.join(first, "doc_id", "left").withColumn("kind", F.when(later, "h2").otherwise(F.col("kind"))).select(*rows.columns)


def lift_h3_when_no_h2(rows: DataFrame) -> DataFrame:
    """A document without any h2 turns its h3 into h2 (W-12)."""
    with_h2 = rows.where(F.col("kind") == "h2").select("doc_id").distinct().withColumn("__has", F.lit(True))
    lift = F.col("__has").isNull() & (F.col("kind") == "h3")
    return rows.join(with_h2, "doc_id", "left").withColumn("kind", F.when(lift, "h2").otherwise(F.col("kind"))).select(*rows.columns)


def relocate_figures(rows: DataFrame, short: int = 100) -> DataFrame:
    """Rejoin a sentence split by figures; the figures follow the joined paragraph (W-05).

    A figure run can fire when the paragraph before it does not end a sentence
    and the one after starts lower-case. Two runs that share a paragraph cannot
    both fire, so within a chain of such runs every other one does, from the first.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    filler = F.when(
        (F.col("kind") == "image") | (F.col("kind").isin("h2", "h3") & (F.length(t) <= short)), F.lit(1)
    )
    para = F.col("kind") == "p"
    flags = rows.select(
        "doc_id", "pos", filler.alias("filler"), (F.col("kind") == "image").alias("image"),
        (para & ~tx.rstrip(t).rlike(SENTENCE_END)).alias("open"),
        (para & tx.lstrip(t).rlike(LOWER_START)).alias("lower"),
    )
    groups = islands(flags, F.col("filler"), F.col("filler"), "run").groupBy("doc_id", F.col("run").alias("pos")).agg(
        F.max("filler").alias("filler"), F.min_by("image", "pos").alias("image"), F.max("open").alias("open"), F.max("lower").alias("lower")
    )
    side = F.struct("pos", "open", "lower")
    runs = scan(cut_lineage(groups), before=prev(side), after=following(side)).where((F.col("filler") == 1) & F.col("image"))
    fits = runs.where(F.col("before.open") & F.col("after.lower")).select(
        "doc_id", "pos", F.col("before.pos").alias("into"), F.col("after.pos").alias("moved")
    )
    chained = scan(cut_lineage(islands(fits, F.col("moved"), F.col("into"), "chain")), nth=running(F.lit(1)))
    chained = cut_lineage(chained)
    at_start = scan(chained, first=latest(F.when(F.col("pos") == F.col("chain"), F.col("nth"))))
    fired = at_start.where((F.col("nth") - F.col("first")) % 2 == 0).select("doc_id", "into", "moved")
    fired = cut_lineage(fired)
    touched, rest = _at(rows, fired.select("doc_id", F.explode(F.array("into", "moved")).alias("pos")))
    tails = touched.join(fired.withColumnRenamed("moved", "pos"), ["doc_id", "pos"]).select(
        "doc_id", F.col("into").alias("pos"), tx.lstrip(F.col("text")).alias("__tail")
    )
    joined = touched.join(tails, ["doc_id", "pos"], "left").withColumn(
        "text",
        F.when(F.col("__tail").isNotNull(), tx.strip(F.concat(tx.rstrip(t), F.lit(" "), F.col("__tail")))).otherwise(F.col("text")),
    )
    kept = joined.select(*rows.columns).join(fired.select("doc_id", F.col("moved").alias("pos")), ["doc_id", "pos"], "left_anti")
    return kept.select(*rows.columns).unionByName(rest)


def drop_caption_duplicates(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """Remove the neighbour that repeats an image's caption, the row above first (W-08).

    Where one row sits between two images, the later image can only take it
    when the earlier one did not; that settled-or-inherited choice is carried
    along the images.
    """
    caption = tx.strip(F.col("caption"))
    caps = captions.where(caption != "").select("doc_id", "image", _digest(caption).alias("__cap"))
    can_go = F.when(F.col("kind").isin("h2", "h3", "p"), _digest(_trimmed()))
    narrow = rows.select("doc_id", "pos", "kind", "image", can_go.alias("__text"))
    with_cap = narrow.where("image is not null").join(caps, ["doc_id", "image"], "left").unionByName(narrow.where("image is null"), allowMissingColumns=True)
    side = F.struct(F.col("pos").alias("pos"), F.col("__text").alias("text"))
    near = scan(with_cap, __up=prev(side), __down=following(side)).where(F.col("kind") == "image")
    same = lambda s: F.coalesce(F.col(s)["text"] == F.col("__cap"), F.lit(False))
    picks = near.select(
        "doc_id", "pos", F.col("__up.pos").alias("up"), F.col("__down.pos").alias("down"), same("__up").alias("l"), same("__down").alias("r")
    )
    shared = scan(cut_lineage(picks), last_down=prev(F.col("down")))
    tied = F.coalesce(F.col("last_down") == F.col("up"), F.lit(False))
    settled = F.when(~F.col("r"), F.lit(False)).when(~F.col("l"), F.lit(True)).when(~tied, F.lit(False))
    chosen = cut_lineage(scan(cut_lineage(shared.withColumn("settled", settled)), takes_down=latest(F.col("settled"))))
    before = scan(chosen, stolen=prev(F.col("takes_down")))
    taken = F.col("l") & ~(F.coalesce(F.col("stolen"), F.lit(False)) & tied)
    gone = before.select(
        "doc_id", F.when(taken, F.col("up")).when(F.col("takes_down"), F.col("down")).alias("pos")
    ).where(F.col("pos").isNotNull())
    gone = cut_lineage(gone.distinct())
    touched, rest = _at(rows, gone)
    return touched.join(gone, ["doc_id", "pos"], "left_anti").select(*rows.columns).unionByName(rest)


def rejoin_paragraphs(rows: DataFrame) -> DataFrame:
    """Merge a paragraph into the one before when that did not end (W-04)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    end = tx.rstrip(F.regexp_replace(tx.rstrip(t), r"\*+\z", ""))
    start = tx.lstrip(F.regexp_replace(tx.lstrip(t), r"\A\*+", ""))
    para = F.col("kind") == "p"
    tail = F.when(para & (end != "") & ~end.rlike(BREAK_END), F.lit(1))
    head = F.when(para & (start != ""), F.lit(1))
    rest = [c for c in rows.columns if c not in ("doc_id", "pos", "text")]
    seam = f"{tx.BLANK}*\x00{tx.BLANK}*"
    # Groups are put together where their segment lies; only those that go on into another segment are moved for it.
    grouped = islands(rows, tail, head, "__lead", seg_out="__sg")
    parts = grouped.groupBy("doc_id", "__sg", "__lead").agg(
        F.collect_list(F.struct("pos", t.alias("t"))).alias("__parts"), F.count("text").alias("__n"), F.min("pos").alias("__first"), *[F.min_by(c, "pos").alias(c) for c in rest]
    )
    parts = parts.drop("__sg")
    text = F.when(F.col("__n") > 0, F.regexp_replace(F.array_join(F.sort_array("__parts")["t"], "\x00"), seam, " "))
    done = lambda d: d.withColumn("text", text).withColumn("pos", F.col("__lead")).select(*rows.columns)
    if rows.where((F.col("pos") >= SEG) | (F.col("pos") < 0)).isEmpty():
        return done(parts)
    across = cut_lineage(grouped.where(segment("__lead") != F.col("__sg")).select("doc_id", "__lead").distinct())
    split, whole = _at(parts, across, "__lead")
    met = split.groupBy("doc_id", "__lead").agg(
        F.flatten(F.collect_list("__parts")).alias("__parts"), F.sum("__n").alias("__n"), F.min("__first").alias("__first"), *[F.min_by(c, "__first").alias(c) for c in rest]
    )
    return done(whole.unionByName(met))


def clean_text(rows: DataFrame) -> DataFrame:
    """Smart quotes, then paragraph rejoining."""
    return rejoin_paragraphs(rows.withColumn("text", tx.fix_smart_quotes(F.col("text"))))


# ---------------------------------------------------------------- footnotes


def note_refs(rows: DataFrame) -> DataFrame:
    """One row per inline marker: doc_id, pos, idx within the row, n (null where no int holds the number)."""
    found = F.regexp_extract_all("text", F.lit(MARKER), 1)
    return rows.where(F.col("text").contains("[^")).select("doc_id", "pos", F.posexplode(found).alias("idx", "n")).withColumn(
        "n", F.col("n").try_cast("int")
    )


def first_reference_order(refs: DataFrame, notes: DataFrame, key: str = "n") -> DataFrame:
    """doc_id, old number, new number 1..N by first reference, for numbers that have a note."""
    firsts = refs.groupBy("doc_id", key).agg(F.min(F.struct("pos", "idx")).alias("at"))
    known = firsts.join(notes.select("doc_id", key).distinct(), ["doc_id", key])
    rows = known.select("doc_id", key, "at.pos", "at.idx")
    return number_rows(rows, ["doc_id"], [F.col("pos"), F.col("idx")], [segment("pos")], "new_n").select(
        "doc_id", key, F.col("new_n").cast("int").alias("new_n")
    )


def renumber_footnotes(rows: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """Notes renumbered by first reference (W-15): rows, notes, dropped notes, orphan references."""
    refs = note_refs(rows)
    order = cut_lineage(first_reference_order(refs, notes))
    new_notes = notes.join(order, ["doc_id", "n"]).withColumn("n", F.col("new_n")).drop("new_n")
    dropped = notes.select("doc_id", "n").distinct().join(order, ["doc_id", "n"], "left_anti")
    numbered = refs.join(order, ["doc_id", "n"], "left").groupBy("doc_id", "pos").agg(
        F.sort_array(F.collect_list(F.struct("idx", "new_n")))["new_n"].alias("__new")
    )
    pieces, marks = F.split("text", MARKER, -1), F.regexp_extract_all("text", F.lit(r"(\[\^\d+\])"), 1)
    fresh = F.zip_with(marks, "__new", lambda m, n: F.coalesce(F.concat(F.lit("[^"), n.cast("string"), F.lit("]")), m))
    woven = F.array_join(F.flatten(F.zip_with(pieces, fresh, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    refers = F.coalesce(F.col("text").contains("[^"), F.lit(False))
    new_rows = rows.where(refers).join(numbered, ["doc_id", "pos"], "left").withColumn(
        "text", F.when(F.col("__new").isNotNull(), woven).otherwise(F.col("text"))
    ).select(*rows.columns).unionByName(rows.where(~refers))
    return {
        "rows": new_rows.select(*rows.columns),
        "notes": new_notes.select(*notes.columns),
        "dropped": dropped,
        "orphans": orphan_refs(rows, notes),
    }


def orphan_refs(rows: DataFrame, notes: DataFrame, around: int = 20) -> DataFrame:
    """References to missing notes with the text around them."""
    marks = F.regexp_extract_all("text", F.lit(r"(\[\^\d+\])"), 1)
    pieces = F.split("text", MARKER, -1)
    at = rows.where(F.col("text").contains("[^")).select(
        "doc_id", "pos", "text", pieces.alias("pieces"), marks.alias("marks"), F.posexplode(marks).alias("idx", "mark")
    )
    before = F.length(F.array_join(F.slice("pieces", F.lit(1), F.col("idx") + 1), "")) + F.length(
        F.array_join(F.slice("marks", F.lit(1), F.col("idx")), "")
    )
    start = F.greatest(before - around, F.lit(0))
    stop = before + F.length("mark") + around
    snippet = tx.strip(F.substring(F.col("text"), start + 1, stop - start))
    found = at.select("doc_id", "pos", "idx", F.regexp_extract("mark", r"\d+", 0).try_cast("int").alias("n"), snippet.alias("snippet"))
    return found.join(notes.select("doc_id", "n").distinct(), ["doc_id", "n"], "left_anti")


def colocate_footnotes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows plus one note row right after the first paragraph that refers to it (W-16).

    ``slot`` 0 is the row itself, 1… are its notes in order of reference.
    """
    refs = note_refs(rows.where(F.col("kind") == "p"))
    firsts = refs.groupBy("doc_id", "n").agg(F.min(F.struct("pos", "idx")).alias("at"))
    one_each = notes.groupBy("doc_id", "n").agg(F.max(F.struct(*[c for c in notes.columns if c not in ("doc_id", "n")])).alias("__note"))
    placed = firsts.join(one_each, ["doc_id", "n"]).select(
        "doc_id", "at.pos", (F.col("at.idx") + 1).alias("slot"), F.lit("footnote").alias("kind"), tx.strip(F.col("__note.text")).alias("text"), "n"
    )
    own = rows.select("doc_id", "pos", F.lit(0).alias("slot"), "kind", "text", F.lit(None).cast("int").alias("n"))
    return own.unionByName(placed)


def split_orphan_notes(rows: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, new notes): 'prose. 3 Capitalised tail…' becomes a marker and a note (W-32).

    The first paragraph claiming a free number wins; later claims stay as text.
    """
    shape = r"(?s)\A(.+?[.!?])\s+(\d{1,2})\s+([A-Z][a-z]+\b.{25,})\z"
    last_letter = r"(?s)\A(.*\p{L})(\P{L}*)\z"
    prose = F.regexp_extract("text", shape, 1)
    claims = rows.where((F.col("kind") == "p") & F.col("text").rlike(shape) & prose.rlike(last_letter)).select(
        "doc_id", "pos", F.regexp_extract("text", shape, 2).cast("int").alias("n"), prose.alias("prose"),
        tx.strip(F.regexp_extract("text", shape, 3)).alias("rest"),
    ).where(F.length("rest") >= 25)
    free = claims.join(notes.select("doc_id", "n").distinct(), ["doc_id", "n"], "left_anti")
    won = free.groupBy("doc_id", "n").agg(F.min_by(F.struct("pos", "prose", "rest"), "pos").alias("w")).select("doc_id", "n", "w.*")
    marked = F.concat(
        F.regexp_extract("prose", last_letter, 1), F.lit("[^"), F.col("n").cast("string"), F.lit("]"), F.regexp_extract("prose", last_letter, 2)
    )
    edits = won.select("doc_id", "pos", marked.alias("__text"))
    out = rows.join(edits, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("__text", "text")).select(*rows.columns)
    return out, won.select("doc_id", "n", "pos", F.col("rest").alias("text"))


def nearby_captions(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Per image row: the text before it, cut to ``limit`` characters (W-35)."""
    near = scan(rows, nearby=latest(F.when(F.col("kind") != "image", F.col("text"))))
    return near.where(F.col("kind") == "image").select(
        "doc_id", "pos", "image", F.substring(F.coalesce("nearby", F.lit("")), 1, limit).alias("nearby_caption")
    )


def dedup_images(rows: DataFrame) -> DataFrame:
    """Every image row with its document-wide order by first appearance; a later caption fills a missing one (A-18)."""
    images = nearby_captions(rows)
    first = images.groupBy("doc_id", "image").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("nearby_caption", F.when(F.col("nearby_caption") != "", F.col("pos"))).alias("caption"),
    )
    ordered = number_rows(first, ["doc_id"], [F.col("first_pos")], [segment("first_pos")], "order")
    return images.select("doc_id", "pos", "image").join(ordered, ["doc_id", "image"]).select(
        "doc_id", "pos", "image", (F.col("order") - 1).alias("order"), F.coalesce("caption", F.lit("")).alias("caption")
    )


def caption_precedence(images: DataFrame, styled: DataFrame, figcaption: DataFrame, bold: DataFrame) -> DataFrame:
    """Best caption per image: styled, then figcaption, then bold line, then nearby text (J-17)."""
    out = images
    for name, source in (("styled", styled), ("figcaption", figcaption), ("bold", bold)):
        out = out.join(source.select("doc_id", "image", F.col("caption").alias(f"__{name}")), ["doc_id", "image"], "left")
    pick = [F.nullif(F.col(c), F.lit("")) for c in ("__styled", "__figcaption", "__bold", "nearby_caption")]
    return out.select(*images.columns, F.coalesce(*pick, F.lit("")).alias("caption"))


def normalise(rows: DataFrame, captions: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """The whole cleaning pass over extracted drafts, in its fixed order.

    Each step reads its input more than once, so the rows are written out
    between steps instead of growing one plan.
    """
    rows = written(demote_extra_h1(strip_front_matter(rows)), "draft")
    rows = written(relocate_figures(rows), "draft")
    rows = written(drop_caption_duplicates(rows, captions), "draft")
    rows = written(clean_text(rows), "draft")
    return renumber_footnotes(rows, notes)


def draft_to_blocks(rows: DataFrame, notes: DataFrame, images: DataFrame) -> DataFrame:
    """Cleaned drafts to block rows (W-16): the h1 is the title and stays out, notes follow their first reference.

    ``images``: doc_id, image, caption, width, height. Positions are dense again.
    """
    placed = colocate_footnotes(rows.where(F.col("kind") != "image"), notes)
    pictures = rows.where(F.col("kind") == "image").join(images, ["doc_id", "image"], "left")
    none = F.create_map().cast("map<string,string>")
    caption = F.coalesce("caption", F.lit(""))
    picture_props = F.create_map(
        F.lit("asset_id"), F.col("image"), F.lit("sketch_id"), F.lit(""), F.lit("caption"), caption, F.lit("alt_text"), caption,
        F.lit("approval"), F.lit("pending"), F.lit("display_width"), tx.display_width(F.col("width"), F.col("height")),
    )
    text = tx.strip(F.col("text"))
    words = placed.where((F.col("kind") != "h1") & (text != "")).select(
        "doc_id", "pos", "slot",
        F.when(F.col("kind").isin("h2", "h3"), "heading").when(F.col("kind") == "footnote", "footnote").otherwise("paragraph").alias("type"),
        F.when(F.col("kind").isin("h2", "h3"), F.substring("kind", 2, 1).cast("int")).alias("level"),
        F.when(F.col("kind") != "footnote", text).otherwise("").alias("text"),
        F.when(F.col("kind") == "footnote", F.create_map(F.lit("marker"), F.col("n").cast("string"), F.lit("text"), text)).otherwise(none).alias("props"),
    )
    shown = pictures.select(
        "doc_id", "pos", F.lit(0).alias("slot"), F.lit("image").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), picture_props.alias("props")
    )
    both = words.unionByName(shown)
    numbered = number_rows(both, ["doc_id"], [F.col("pos"), F.col("slot")], [segment("pos")], "__at")
    at = (F.col("__at") - 1).cast("int")
    return numbered.select(
        "doc_id", at.alias("pos"), F.concat_ws("-", "doc_id", at.cast("string")).alias("block_id"), F.lit(None).cast("int").alias("parent_pos"), F.lit(0).alias("depth"),
        "type", "level", "text", rn.runs_of(F.col("text")).alias("runs"), "props",
    )


def detect_title(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Metadata title, else the largest h1 where font sizes are known, else the first
    heading or paragraph, else the file stem (W-36)."""
    line = F.substring(F.split_part(tx.strip(F.col("text")), F.lit("\n"), F.lit(1)), 1, 200)
    text = tx.strip_emphasis(line)
    rank = F.struct(F.col("pos"))
    if "size" in rows.columns:
        big = F.col("kind") == "h1"
        rank = F.struct(F.when(big, 0).otherwise(1), F.when(big, -F.col("size")), F.col("pos"))
    found = rows.where(F.col("kind").isin("h1", "h2", "p") & (text != "")).groupBy("doc_id").agg(F.min_by(text, rank).alias("__t"))
    title = F.coalesce(F.nullif(tx.strip(F.col("title")), F.lit("")), "__t", "stem")
    return docs.select("doc_id", "title", "stem").join(found, "doc_id", "left").select("doc_id", title.alias("title"))
