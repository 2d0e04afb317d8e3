"""Structure of block rows: chapters, chunks, figure and note numbers, headings, lists."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import runs as rn
from quire.functions import text as tx
from quire.operators.blocks import heading_level, prop
from quire.operators.ordered import (
    SEG, grouped_batches, islands, latest, number_rows, prev, running, scan, segment,
)
from quire.session import cut_lineage

LISTS = ("bulletListItem", "numberedListItem")
#: Neighbouring stretches of a document that one task folds while chunks are packed.
TREE = 64


def _prop(name: str) -> Column:
    return F.coalesce(prop(name), F.lit(""))


def _says() -> Column:
    return tx.strip(rn.inline_text(F.col("runs")))


# ---------------------------------------------------------------- chapters


def block_lines() -> Column:
    """Analysis text of one body block; null when it has none (W-02)."""
    caption = F.coalesce(F.nullif(tx.strip_html(_prop("caption")), F.lit("")), tx.strip(_prop("alt_text")))
    note = tx.strip_html(_prop("text"))
    marker = _prop("marker")
    text = _says()
    kind = F.col("type")
    return (
        F.when((kind == "image") & (caption != ""), F.concat(F.lit("[Figure: "), caption, F.lit("]")))
        .when((kind == "footnote") & (note != ""), F.when(marker != "", F.concat(F.lit("["), marker, F.lit("] "), note)).otherwise(note))
        .when(kind.isin("narrative", "quote") & (text != ""), F.concat(F.lit("> "), text))
        .when((kind == "paragraph") & (text != ""), text)
        .when(kind.isin(*LISTS) & (text != ""), F.concat(F.lit("- "), text))
    )


def chapters(blocks: DataFrame, opening: str = "Opening") -> DataFrame:
    """One chunk per chapter: doc_id, idx, title, sections, text (W-01)."""
    top = (F.col("type") == "heading") & (heading_level() <= 2) & (F.col("depth") == 0)
    sec = (F.col("type") == "heading") & (heading_level() == 3) & (F.col("depth") == 0)
    section = F.when(sec, F.nullif(_says(), F.lit("")))
    line = F.when(sec, F.concat(F.lit("### "), section)).when(F.col("type") != "heading", block_lines())
    rows = blocks.select(
        "doc_id", "pos", top.alias("top"), F.when(top, F.coalesce(F.nullif(_says(), F.lit("")), F.lit("(untitled)"))).alias("title"),
        section.alias("section"), line.alias("line"),
    )
    numbered = scan(rows, chapter=running(F.when(F.col("top"), 1).otherwise(0)))
    items = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c))))[c]
    grouped = numbered.groupBy("doc_id", "chapter").agg(
        F.max("title").alias("title"), items("section").alias("sections"), tx.strip(F.array_join(items("line"), "\n")).alias("body")
    )
    title = F.coalesce("title", F.lit(opening))
    kept = grouped.where((F.col("chapter") > 0) | (F.col("body") != "")).select(
        "doc_id", "chapter", title.alias("title"), "sections",
        F.concat(F.lit("## "), title, F.when(F.col("body") != "", F.concat(F.lit("\n"), F.col("body"))).otherwise("")).alias("text"),
    )
    out = number_rows(kept, ["doc_id"], [F.col("chapter")], [segment("chapter")], "idx")
    return out.select("doc_id", (F.col("idx") - 1).alias("idx"), "title", "sections", "text")


# ---------------------------------------------------------------- token-budget chunks


def _breaks(tokens: np.ndarray, heading: np.ndarray, target: int):
    """For a chunk opened at each row: the next row that must open another one (n when none)."""
    n = len(tokens)
    cum = np.concatenate([[0], np.cumsum(tokens)])
    over = np.searchsorted(cum, cum[:-1] + np.maximum(target, tokens), side="right") - 1
    over = np.maximum(over, np.arange(n) + 1)
    return np.minimum(np.minimum(over, _next_heading(heading)), n)


def _at_or_after(mask: np.ndarray) -> np.ndarray:
    """Index of the first true row at or after each row, and past the end (n when none)."""
    n = len(mask)
    return np.append(np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1], n)


def _next_heading(heading: np.ndarray) -> np.ndarray:
    """First heading after the first body row at or after each row."""
    return _at_or_after(heading)[_at_or_after(~heading)[:-1]]


def _first_break(tokens, heading, held, has_body, target):
    """First row that cannot join a chunk already holding ``held`` tokens (one number or many)."""
    n = len(tokens)
    over = np.searchsorted(np.cumsum(tokens), target - np.asarray(held), side="right")
    first = _at_or_after(heading)[0] if has_body else (_next_heading(heading)[0] if n else n)
    return np.minimum(np.minimum(over, first), n)


# The chunk state after a stretch of rows as a function of the tokens held before it, once for an open chunk without body
# text and once for one with: steps (upto, held, body, opened, open). A step holds for tokens up to ``upto``; where
# ``open`` is 1 the chunk goes on through the stretch and ``held`` is added to what it held, else it is the result.
# A function is kept as one array, five numbers a step.
STEPS = "array<int>"
Step = tuple[int, int, int, int, int]


def _segment_steps(tokens: np.ndarray, heading: np.ndarray, target: int) -> list[list[Step]]:
    """The two functions of one segment, by pointers: a chunk opened at a row ends where the next one opens.

    What a chunk opened at row j leads to at the end of the segment follows from the row that its pointer names; the
    pointers are doubled (twice as far each time), so it takes as many rounds as the chunks' number has bits.
    """
    n, cap = len(tokens), target + 1
    cum, nxt = np.concatenate([[0], np.cumsum(tokens)]), np.append(_breaks(tokens, heading, target), n)
    last, opened = np.arange(n + 1), np.append(np.ones(n, int), 0)
    jump = nxt.copy()
    while True:
        go = jump < n
        if not go.any():
            break
        opened[go] += opened[jump[go]]
        last[go] = last[jump[go]]
        jump[go] = jump[jump[go]]
    next_body = np.append(_at_or_after(~heading)[:-1], n)
    total, body = np.minimum(cap, cum[n] - cum[last]), (next_body[last] < n).astype(int)
    out = []
    for has_body in (0, 1):
        held = np.arange(cap + 1)
        first = _first_break(tokens, heading, held, has_body, target)
        ends = np.flatnonzero(np.append(np.diff(first) != 0, True))
        whole = int(has_body or (~heading).any())
        out.append([
            (int(held[e]), int(cum[n]), whole, 0, 1) if first[e] >= n else (int(held[e]), int(total[first[e]]), int(body[first[e]]), int(opened[first[e]]), 0)
            for e in ends
        ])
    return out


def _apply(steps: list[list[Step]], held: int, body: int, cap: int) -> tuple[int, int, int]:
    """(held, body, chunks opened) after a stretch that begins in a state."""
    mine = steps[body]
    upto, plus, after, opened, is_open = mine[bisect_left(mine, (held,))]
    return min(cap, held + plus) if is_open else plus, after, opened


def _after(first: list[list[Step]], second: list[list[Step]], cap: int) -> list[list[Step]]:
    """The two functions of one stretch and then another."""
    out = []
    for body in (0, 1):
        steps: list[Step] = []
        low = 0
        for upto, plus, after, opened, is_open in first[body]:
            if not is_open:
                held, next_body, more = _apply(second, plus, after, cap)
                steps.append((upto, held, next_body, opened + more, 0))
            else:
                # The tokens go on growing here, so the steps of the second stretch show through, moved by ``plus``.
                for upto2, plus2, after2, opened2, open2 in second[after]:
                    end = upto if upto2 >= cap else min(upto, upto2 - plus)
                    if end >= low and (not steps or end > steps[-1][0]):
                        steps.append((end, plus + plus2 if open2 else plus2, after2, opened + opened2, open2))
            low = upto + 1
        merged: list[Step] = []
        for step in steps:
            if merged and merged[-1][1:] == step[1:]:
                merged.pop()
            merged.append(step)
        out.append(merged)
    return out


def _steps_of(pdf: pd.DataFrame) -> list[list[list[Step]]]:
    return [[[tuple(x) for x in np.reshape(side, (-1, 5)).tolist()] for side in both] for both in zip(pdf["steps0"], pdf["steps1"])]


def _rows_of(found: list[list[list[Step]]]) -> dict:
    return {f"steps{b}": [np.array(steps[b], dtype=np.int32).ravel() for steps in found] for b in (0, 1)}


def _segment_summary(target: int):
    def summarise(pdf: pd.DataFrame, cuts: np.ndarray) -> dict:
        tokens, heading = pdf["tokens"].to_numpy(), pdf["heading"].to_numpy(dtype=bool)
        found = [_segment_steps(tokens[a:b], heading[a:b], target) for a, b in zip(cuts, cuts[1:])]
        return {"doc_id": pdf["doc_id"].to_numpy()[cuts[:-1]], "seg": pdf["seg"].to_numpy()[cuts[:-1]], **_rows_of(found)}

    return summarise


def _fold_steps(target: int):
    """Neighbouring stretches, at most ``TREE`` of them, as one."""

    def fold(pdf: pd.DataFrame, cuts: np.ndarray) -> dict:
        steps = _steps_of(pdf)
        found = [reduce(lambda x, y: _after(x, y, target + 1), steps[a:b]) for a, b in zip(cuts, cuts[1:])]
        return {"doc_id": pdf["doc_id"].to_numpy()[cuts[:-1]], "seg": pdf["parent"].to_numpy()[cuts[:-1]], **_rows_of(found)}

    return fold


def _enter_steps(target: int):
    """The state before each of at most ``TREE`` neighbours, from the one before the first."""

    def enter(pdf: pd.DataFrame, cuts: np.ndarray) -> dict:
        steps, states = _steps_of(pdf), []
        begins = list(zip(*(pdf[c].to_numpy()[cuts[:-1]].tolist() for c in ("held", "body", "opened"))))
        for (held, body, opened), a, b in zip(begins, cuts, cuts[1:]):
            for k in range(a, b):
                states.append((held, body, opened))
                held, body, more = _apply(steps[k], held, body, target + 1)
                opened += more
        return {"doc_id": pdf["doc_id"].to_numpy(), "seg": pdf["seg"].to_numpy(), **dict(zip(("held", "body", "opened"), map(list, zip(*states))))}

    return enter


def _states(summaries: DataFrame, target: int) -> DataFrame:
    """doc_id, seg, held, body, opened before each segment: the functions are folded up a tree and the states go down it."""
    schema = f"doc_id long, seg long, steps0 {STEPS}, steps1 {STEPS}"
    levels = [cut_lineage(summaries)]
    while not levels[-1].groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > TREE).isEmpty():
        up = levels[-1].withColumn("parent", F.expr(f"seg div {TREE}"))
        levels.append(cut_lineage(grouped_batches(up, ["doc_id", "parent"], ["seg"], _fold_steps(target), schema)))
    state = levels[-1].select("doc_id").distinct().select("doc_id", F.lit(target + 1).alias("held"), F.lit(0).alias("body"), F.lit(0).alias("opened"))
    out = "doc_id long, seg long, held int, body int, opened int"
    for depth, level in enumerate(reversed(levels)):
        if depth == 0:
            entered, keys = level.join(state, "doc_id"), ["doc_id"]
        else:
            parents = state.withColumnRenamed("seg", "parent")
            keys = ["doc_id", "parent"]
            entered = level.withColumn("parent", F.expr(f"seg div {TREE}")).join(parents, keys)
        state = cut_lineage(grouped_batches(entered, keys, ["seg"], _enter_steps(target), out))
    return state


def _assign(target: int):
    def assign(pdf: pd.DataFrame, cuts: np.ndarray) -> dict:
        all_tokens, all_heading = pdf["tokens"].to_numpy(), pdf["heading"].to_numpy(dtype=bool)
        begins = list(zip(*(pdf[c].to_numpy()[cuts[:-1]].tolist() for c in ("held", "body", "opened"))))
        chunks = np.empty(len(pdf), dtype=np.int64)
        for (held, body, opened), a, b in zip(begins, cuts, cuts[1:]):
            tokens, heading, chunk = all_tokens[a:b], all_heading[a:b], chunks[a:b]
            nxt = _breaks(tokens, heading, target)
            chunk[:] = opened - 1
            j = _first_break(tokens, heading, held, body, target)
            while j < len(tokens):
                chunk[j : nxt[j]] = opened
                opened += 1
                j = nxt[j]
        return {"doc_id": pdf["doc_id"].to_numpy(), "pos": pdf["pos"].to_numpy(), "chunk": chunks}

    return assign


def pack_chunks(rows: DataFrame, target: int = 3500, seg: int = SEG) -> DataFrame:
    """Greedy chunk number per polishable row: doc_id, pos, chunk (W-03).

    The greedy fold depends on a document only through the tokens the open chunk holds and whether it has body text.
    Each segment is reduced to the few steps in which the state after it depends on the state before it, the steps of
    ``TREE`` neighbours are folded into one, and so on up; then the states go down and the segments are numbered in
    parallel. Only token counts and steps are shuffled, and no task sees more than ``TREE`` segments of a document.
    """
    narrow = cut_lineage(rows.select(
        "doc_id", "pos", segment("pos", seg).alias("seg"), F.col("kind").isin("h1", "h2", "h3").alias("heading"),
        tx.estimated_tokens(F.col("text")).alias("tokens"),
    ))
    segs = narrow.groupBy("doc_id").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    long = segs.where(F.col("lo") < F.col("hi")).select("doc_id")
    summaries = grouped_batches(
        narrow.join(long, "doc_id", "left_semi"), ["doc_id", "seg"], ["pos"], _segment_summary(target), f"doc_id long, seg long, steps0 {STEPS}, steps1 {STEPS}"
    )
    states = _states(summaries, target)
    started = narrow.join(states, ["doc_id", "seg"], "left").na.fill({"held": target + 1, "body": 0, "opened": 0})
    return grouped_batches(started, ["doc_id", "seg"], ["pos"], _assign(target), "doc_id long, pos int, chunk int")


def chunk_table(rows: DataFrame, target: int = 3500, max_tokens: int | None = None, overlap: int = 1) -> DataFrame:
    """One row per chunk: blocks, tokens, the block before it as context, oversize note (W-03).

    ``contexts`` holds the ids of up to ``overlap`` blocks before the chunk, in order; ``context`` is the last of them.
    """
    limit = max_tokens or 2 * target
    tokens = tx.estimated_tokens(F.col("text"))
    placed, last = rows.join(pack_chunks(rows, target), ["doc_id", "pos"]), "block_id"
    for k in range(overlap):
        placed = scan(placed, **{f"__c{k}": prev(F.col(last))})
        last = f"__c{k}"
    before = F.array(*[F.col(f"__c{k}") for k in reversed(range(overlap))]).cast("array<string>")
    chunks = placed.withColumn("__before", before).groupBy("doc_id", "chunk").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_blocks"), F.sum(tokens).alias("tokens"),
        F.filter(F.min_by("__before", "pos"), lambda b: b.isNotNull()).alias("contexts"), F.max(tokens > limit).alias("oversize"),
    )
    return chunks.select("doc_id", "chunk", "first_pos", "last_pos", "n_blocks", "tokens", F.try_element_at("contexts", F.lit(-1)).alias("context"), "contexts", "oversize")


# ---------------------------------------------------------------- numbering


def number_first_seen(rows: DataFrame, key: str, blank_counts: bool) -> DataFrame:
    """Number per distinct ``key`` by first appearance; blanks take a fresh number or none (W-13, W-14).

    Repeats collapse map-side to one row per (document, key) before numbering.
    """
    known = rows.where(F.col(key) != "").groupBy("doc_id", key).agg(F.min("pos").alias("pos"))
    own = F.lit(None).cast("string")
    if blank_counts:
        blanks = rows.where(F.coalesce(F.col(key), F.lit("")) == "").select("doc_id", own.alias(key), "pos")
        known = known.select("doc_id", key, "pos").unionByName(blanks)
    numbers = number_rows(known, ["doc_id"], [F.col("pos")], [segment("pos")], "n").select(
        F.col("doc_id").alias("__d"), F.col(key).alias("__k"), F.col("pos").alias("__p"), F.col("n").cast("int").alias("n")
    )
    same = (F.col("doc_id") == F.col("__d")) & (
        F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("\x00"), "pos")) == F.coalesce("__k", F.concat(F.lit("\x00"), "__p"))
    )
    return rows.join(numbers, same, "left").drop("__d", "__k", "__p")


def figure_numbers(blocks: DataFrame) -> DataFrame:
    """Figure number per image row: repeats reuse theirs, blank assets and omitted figures still count (W-13)."""
    images = blocks.where(F.col("type") == "image").select("doc_id", "pos", _prop("asset_id").alias("asset_id"))
    return number_first_seen(images, "asset_id", blank_counts=True)


def bundle_numbers(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Published file names per distinct asset; blank assets do not count (W-14)."""
    images = blocks.where(F.col("type") == "image").select(
        "doc_id", "pos", _prop("asset_id").alias("asset_id"), _prop("sketch_id").alias("sketch_id")
    ).where(F.col("asset_id") != "")
    firsts = number_first_seen(images, "asset_id", blank_counts=False)
    one = firsts.groupBy("doc_id", "asset_id", "n").agg(F.min_by("sketch_id", "pos").alias("sketch_id"))
    kinds = F.explode(F.array(
        F.struct(F.lit("original").alias("role"), F.col("asset_id").alias("sha256")),
        F.struct(F.lit("silhouette").alias("role"), F.col("sketch_id").alias("sha256")),
    ))
    files = one.select("doc_id", "n", "asset_id", kinds.alias("f")).select("doc_id", "n", "asset_id", "f.*")
    originals = assets.select(F.col("sha256").alias("asset_id"))
    named = F.concat(F.lit("figure-"), F.col("n").cast("string"), F.lit("-"), F.col("role"), F.col("ext"))
    return files.join(originals, "asset_id", "left_semi").join(assets.select("sha256", "ext"), "sha256").select(
        "doc_id", "n", "role", named.alias("name"), "sha256"
    )


def eligible_figures(blocks: DataFrame) -> DataFrame:
    """Images still waiting for a sketch (P-01)."""
    mode = F.coalesce(F.nullif(_prop("safe_mode"), F.lit("")), F.lit("sketch"))
    done = (_prop("sketch_id") != "") & (_prop("approval") == "approved")
    return blocks.where((F.col("type") == "image") & (_prop("asset_id") != "") & ~mode.isin("original", "omit") & ~done)


# ---------------------------------------------------------------- editor footnotes


def _refs(blocks: DataFrame) -> DataFrame:
    refs = F.transform("runs", lambda r, i: F.struct(i.alias("idx"), tx.strip(r["text"]).alias("marker"), r["fn_ref"].alias("is_ref")))
    return blocks.select("doc_id", "pos", F.explode(F.filter(refs, lambda r: r["is_ref"])).alias("r")).select(
        "doc_id", "pos", "r.idx", "r.marker"
    )


def _notes(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("type") == "footnote").select("doc_id", "pos", tx.strip(_prop("marker")).alias("marker"))


def renumber_notes(blocks: DataFrame) -> DataFrame:
    """Editor twin of the draft renumbering: notes keep their place, unreferenced ones stay (W-15)."""
    refs, notes = _refs(blocks), _notes(blocks)
    firsts = refs.groupBy("doc_id", "marker").agg(F.min(F.struct("pos", "idx")).alias("at")).join(
        notes.select("doc_id", "marker").distinct(), ["doc_id", "marker"]
    ).select("doc_id", "marker", "at.pos", "at.idx")
    order = number_rows(firsts, ["doc_id"], [F.col("pos"), F.col("idx")], [segment("pos")], "n").select(
        "doc_id", "marker", F.col("n").cast("string").alias("fresh")
    )
    order = cut_lineage(order)
    per_row = refs.join(order, ["doc_id", "marker"]).groupBy("doc_id", "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "fresh"))).alias("__fresh")
    )
    note_fresh = notes.join(order, ["doc_id", "marker"]).select("doc_id", "pos", F.col("fresh").alias("__note"))
    out = blocks.join(per_row, ["doc_id", "pos"], "left").join(note_fresh, ["doc_id", "pos"], "left")
    runs = F.transform("runs", lambda r, i: r.withField("text", F.coalesce(F.try_element_at("__fresh", i), r["text"])))
    props = F.map_concat(F.map_filter("props", lambda k, v: k != "marker"), F.create_map(F.lit("marker"), F.col("__note")))
    return out.withColumns(
        {
            "runs": F.when(F.col("__fresh").isNotNull(), runs).otherwise(F.col("runs")),
            "props": F.when(F.col("__note").isNotNull(), props).otherwise(F.col("props")),
        }
    ).select(*blocks.columns)


def remove_footnotes(blocks: DataFrame, markers: DataFrame) -> DataFrame:
    """Drop notes and references for (doc_id, marker) rows, then renumber the rest (W-17)."""
    wanted = markers.select("doc_id", tx.strip(F.col("marker")).alias("marker")).distinct()
    gone_notes = _notes(blocks).join(wanted, ["doc_id", "marker"], "left_semi").select("doc_id", "pos")
    gone_refs = _refs(blocks).join(wanted, ["doc_id", "marker"], "left_semi").groupBy("doc_id", "pos").agg(F.collect_list("idx").alias("__gone"))
    kept = blocks.join(gone_notes, ["doc_id", "pos"], "left_anti").join(gone_refs, ["doc_id", "pos"], "left")
    runs = F.filter("runs", lambda r, i: ~F.array_contains("__gone", i))
    out = kept.withColumn("runs", F.when(F.col("__gone").isNotNull(), runs).otherwise(F.col("runs"))).select(*blocks.columns)
    return renumber_notes(cut_lineage(out))


def next_marker(blocks: DataFrame) -> DataFrame:
    """Largest leading number over note markers and references, plus one (W-18)."""
    both = _refs(blocks).select("doc_id", "marker").unionByName(_notes(blocks).select("doc_id", "marker"))
    number = F.nullif(F.regexp_extract("marker", r"\A\s*(\d+)", 1), F.lit("")).try_cast("long")
    top = both.groupBy("doc_id").agg(F.max(number).alias("top"))
    return blocks.select("doc_id").distinct().join(top, "doc_id", "left").select(
        "doc_id", (F.coalesce("top", F.lit(0)) + 1).cast("string").alias("marker")
    )


# ---------------------------------------------------------------- headings


def toc_headings(blocks: DataFrame) -> DataFrame:
    """Non-blank headings at the level shown in a table of contents (2 or 3)."""
    text = rn.inline_text(F.col("runs"))
    level = F.when(F.coalesce(F.col("level"), F.lit(2)) >= 3, 3).otherwise(2)
    return blocks.where(F.col("type") == "heading").select("doc_id", "pos", level.alias("level"), tx.strip(text).alias("text")).where(
        F.col("text") != ""
    )


def _unique_names(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    used, nexts, out = set(), {}, []
    for base in pdf["base"]:
        k = nexts.get(base, 1)
        name = base if k == 1 else f"{base}-{k}"
        while name in used:
            k += 1
            name = f"{base}-{k}"
        nexts[base] = k + 1
        used.add(name)
        out.append(name)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "anchor": out})


def heading_anchors(headings: DataFrame) -> DataFrame:
    """Unique anchors per document: repeats take -2, -3 … past names in use (W-19).

    Names can only collide within one root (the slug without its trailing
    numbers). Roots with a single slug are numbered natively; only a root that
    mixes slugs and repeats one of them is resolved in order, on names alone.
    """
    named = headings.withColumn("base", F.coalesce(F.nullif(tx.slugify(F.col("text")), F.lit("")), F.lit("section")))
    named = named.withColumn("root", F.regexp_replace("base", r"(-\d+)+$", ""))
    per_base = named.groupBy("doc_id", "root", "base").agg(F.count("*").alias("n"))
    mixed = per_base.groupBy("doc_id", "root").agg(F.count("*").alias("k"), F.max("n").alias("n")).where((F.col("k") > 1) & (F.col("n") > 1))
    mixed = mixed.select("doc_id", "root")
    plain = named.join(mixed, ["doc_id", "root"], "left_anti")
    plain = number_rows(plain, ["doc_id", "base"], [F.col("pos")], [segment("pos")], "__nth")
    anchor = F.when(F.col("__nth") > 1, F.concat_ws("-", "base", F.col("__nth").cast("string"))).otherwise(F.col("base"))
    plain = plain.select("doc_id", "pos", anchor.alias("anchor"))
    hard = named.join(mixed, ["doc_id", "root"], "left_semi").select("doc_id", "root", "pos", "base")
    hard = hard.groupBy("doc_id", "root").applyInPandas(_unique_names, "doc_id long, pos int, anchor string")
    return headings.join(plain.unionByName(hard), ["doc_id", "pos"])


def heading_tree(toc: DataFrame) -> DataFrame:
    """Group position per heading: h3 belongs to the last h2, or stands alone (W-20)."""
    near = scan(toc, __h2=latest(F.when(F.col("level") == 2, F.col("pos"))))
    return near.withColumn("group_pos", F.coalesce("__h2", "pos")).drop("__h2")


def outline(blocks: DataFrame) -> DataFrame:
    """Heading outline: parent position, level-skip warning, whether it has children (W-21)."""
    heads = blocks.where(F.col("type") == "heading").select("doc_id", "pos", heading_level().alias("level"), rn.inline_text(F.col("runs")).alias("text"))
    near = scan(
        heads, l1=latest(F.when(F.col("level") == 1, F.col("pos"))), l2=latest(F.when(F.col("level") == 2, F.col("pos"))), before=prev(F.col("level"))
    )
    base = heads.groupBy("doc_id").agg(F.min("level").alias("base"))
    parent = F.when(F.col("level") == 2, F.col("l1")).when(F.col("level") == 3, F.greatest("l1", "l2"))
    out = near.join(base, "doc_id").select(
        "doc_id", "pos", "level", "text", parent.alias("parent_pos"),
        (F.col("level") > F.coalesce(F.col("before"), F.col("base") - 1) + 1).alias("skips"),
    )
    out = cut_lineage(out)
    parents = out.where(F.col("parent_pos").isNotNull()).select("doc_id", F.col("parent_pos").alias("pos")).distinct().withColumn("has_children", F.lit(True))
    return out.join(parents, ["doc_id", "pos"], "left").na.fill(False, ["has_children"])


def show_toc(docs: DataFrame, blocks: DataFrame, threshold: int = 15) -> DataFrame:
    """Explicit setting, else more headings than the threshold (F-28)."""
    counts = toc_headings(blocks).groupBy("doc_id").agg(F.count("*").alias("__n"))
    auto = F.coalesce("__n", F.lit(0)) > threshold
    return docs.join(counts, "doc_id", "left").select("doc_id", F.coalesce(F.col("show_toc"), auto).alias("show_toc"))


# ---------------------------------------------------------------- body rows


def emitted(blocks: DataFrame) -> DataFrame:
    """Body rows that render: blank paragraphs, headings and panels are left out."""
    blank = F.col("type").isin("paragraph", "heading", "narrative") & (_says() == "")
    return blocks.where((F.col("depth") == 0) & ~blank)


def list_runs(blocks: DataFrame) -> DataFrame:
    """Consecutive list items of one kind share ``run`` (W-22)."""
    kind = F.when(F.col("type").isin(*LISTS), F.col("type"))
    return islands(emitted(blocks), kind, kind, "run").where(F.col("type").isin(*LISTS))


def merge_narrative(blocks: DataFrame) -> DataFrame:
    """Consecutive narrative rows become one panel with its paragraphs in order (W-23)."""
    panel = F.when(F.col("type") == "narrative", F.lit(1))
    rows = islands(emitted(blocks), panel, panel, "panel").where(F.col("type") == "narrative")
    return rows.groupBy("doc_id", F.col("panel").alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), rn.inline_html(F.col("runs")).alias("h"))))["h"].alias("paragraphs")
    )


def lead_flags(blocks: DataFrame) -> DataFrame:
    """The first non-blank paragraph of each document is its lead (W-26)."""
    paras = emitted(blocks).where(F.col("type") == "paragraph")
    first = paras.groupBy("doc_id").agg(F.min("pos").alias("__first"))
    return paras.join(first, "doc_id").withColumn("lead", F.col("pos") == F.col("__first")).drop("__first")
