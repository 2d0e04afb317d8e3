"""Functions over inline run arrays (text plus style flags), as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.sources.tables import RUN

# Wrapper tags from outermost to innermost.
STYLE_TAGS = (("italic", "em"), ("bold", "strong"), ("underline", "u"), ("strike", "s"), ("code", "code"))
RUNS = T.ArrayType(RUN)


def _flag(run: Column, name: str) -> Column:
    return F.coalesce(run[name], F.lit(False))


def _joined(runs: Column, one) -> Column:
    return F.array_join(F.transform(F.coalesce(runs, F.array().cast(RUNS)), one), "", "")


def inline_text(runs: Column) -> Column:
    return _joined(runs, lambda r: F.coalesce(r["text"], F.lit("")))


def _lines_to(text: Column, brk: str) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(brk))


def _if(flag: Column, text: str | Column) -> Column:
    return F.when(flag, text).otherwise("")


def _around(r, before: Column, text: Column, after: Column, link_open: Column, link_close: Column) -> Column:
    """The run's text once, between its marks and inside its link when it has one."""
    linked = r["href"].isNotNull()
    return F.concat(_if(linked, link_open), before, text, after, _if(linked, link_close))


def inline_html(runs: Column) -> Column:
    """Escaped text, style wrappers, note markers and links (F-03)."""

    def one(r):
        text = _lines_to(tx.html_escape(F.coalesce(r["text"], F.lit(""))), "<br>")
        note = _flag(r, "fn_ref")
        opens = F.concat(*[_if(_flag(r, name), f"<{tag}>") for name, tag in STYLE_TAGS])
        closes = F.concat(*[_if(_flag(r, name), f"</{tag}>") for name, tag in reversed(STYLE_TAGS)])
        before = F.when(note, '<sup class="fn-ref">').otherwise(opens)
        after = F.when(note, "</sup>").otherwise(closes)
        link = F.concat(F.lit('<a href="'), tx.html_escape(r["href"], True), F.lit('">'))
        return _around(r, before, text, after, link, F.lit("</a>"))

    return _joined(runs, one)


def _stars(r) -> Column:
    bold, italic = _flag(r, "bold"), _flag(r, "italic")
    return F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")


def _md_link_end(r) -> Column:
    return F.concat(F.lit("]("), r["href"], F.lit(")"))


def inline_md(runs: Column) -> Column:
    """Markdown with [N] note ties; code sits inside bold and italic (F-04)."""

    def one(r):
        text = _lines_to(F.coalesce(r["text"], F.lit("")), "  \n")
        note, tick = _flag(r, "fn_ref"), _if(_flag(r, "code"), "`")
        before = F.when(note, "[").otherwise(F.concat(_stars(r), tick))
        after = F.when(note, "]").otherwise(F.concat(tick, _stars(r)))
        return _around(r, before, text, after, F.lit("["), _md_link_end(r))

    return _joined(runs, one)


def polish_text(runs: Column) -> Column:
    """Markdown with [^N] markers; code excludes the other marks (F-05)."""

    def one(r):
        note, mark = _flag(r, "fn_ref"), F.when(_flag(r, "code"), "`").otherwise(_stars(r))
        before, after = F.when(note, "[^").otherwise(mark), F.when(note, "]").otherwise(mark)
        return _around(r, before, F.coalesce(r["text"], F.lit("")), after, F.lit("["), _md_link_end(r))

    return _joined(runs, one)


def spoken_text(runs: Column) -> Column:
    """Run text with every rendered tag turned into a space, for word counting (A-01)."""

    def one(r):
        tagged = _flag(r, "fn_ref") | r["href"].isNotNull()
        for name, _ in STYLE_TAGS:
            tagged = tagged | _flag(r, name)
        gap = _if(tagged, " ")
        return F.concat(gap, _lines_to(F.coalesce(r["text"], F.lit("")), " "), gap)

    return _joined(runs, one)


def fully_italic(runs: Column) -> Column:
    """Every word-bearing, non-note run is italic and there is at least one (F-18)."""
    spoken = F.filter(
        F.coalesce(runs, F.array().cast(RUNS)), lambda r: ~_flag(r, "fn_ref") & r["text"].rlike(r"[\p{L}\p{N}]")
    )
    return (F.size(spoken) > 0) & F.forall(spoken, lambda r: _flag(r, "italic"))


def _set_italic(runs: Column, value: bool) -> Column:
    return F.transform(runs, lambda r: r.withField("italic", F.when(_flag(r, "fn_ref"), r["italic"]).otherwise(F.lit(value))))


def strip_italic(runs: Column) -> Column:
    return _set_italic(runs, False)


def add_italic(runs: Column) -> Column:
    return _set_italic(runs, True)


def coalesce_runs(runs: Column) -> Column:
    """Adjacent text runs with the same styles become one; links never merge (W-24).

    Each run learns from its left neighbour whether it opens a new group; a run
    that does gathers the text up to the next opener.
    """
    flags = [f.name for f in RUN.fields[1:7]]

    def opens(run, left):
        same = left["href"].isNull() & run["href"].isNull()
        for name in flags:
            same = same & (_flag(left, name) == _flag(run, name))
        return ~same

    # one-element arrays hold intermediate results, so each is computed once
    def start_points(all_runs):
        pairs = F.zip_with(
            all_runs,
            F.concat(F.array(F.lit(None).cast(RUN)), F.slice(all_runs, F.lit(1), F.size(all_runs) - 1)),
            lambda run, left: F.struct(run.alias("run"), left.alias("left")),
        )
        marks = F.transform(pairs, lambda p, i: F.when((i == 0) | opens(p["run"], p["left"]), i))
        return F.struct(all_runs.alias("runs"), F.filter(marks, lambda i: i.isNotNull()).alias("starts"))

    def gather(b):
        stops = F.concat(F.slice(b["starts"], 2, F.size(b["starts"])), F.array(F.size(b["runs"])))

        def piece(start, stop):
            text = F.array_join(F.transform(F.slice(b["runs"], start + 1, stop - start), lambda r: r["text"]), "")
            return F.get(b["runs"], start).withField("text", text)

        return F.zip_with(b["starts"], stops, piece)

    bound = F.transform(F.transform(F.array(runs), start_points), gather)
    return F.when(F.size(runs) > 0, F.get(bound, F.lit(0))).otherwise(runs)


# The marks of a polished text.
NOTE_MARK, LINK_MARK, STARRED = r"\[\^\d+\]", r"\[[^\]]*\]\([^)]*\)", r"(?s)(\*{1,3})(.+?)\1"


def _woven(c: Column, pattern: str, piece, token) -> Column:
    """Arrays made of what lies between the matches of a pattern and of the matches, in turn."""
    between, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    none = F.slice(F.array(piece(F.lit(""))), 1, 0)
    return F.flatten(F.zip_with(between, found, lambda p, t: F.concat(F.array(piece(p)), F.when(t.isNotNull(), F.array(token(t))).otherwise(none))))


def runs_of(text: Column) -> Column:
    """Inverse of ``polish_text`` (F-06): links are cut out first, then note marks, then starred spans."""

    def run(words, href, bold=None, italic=None, note=False):
        off = F.lit(False)
        return F.struct(
            words.alias("text"), (off if bold is None else bold).alias("bold"), (off if italic is None else italic).alias("italic"), off.alias("underline"),
            off.alias("strike"), off.alias("code"), F.lit(note).alias("fn_ref"), href.alias("href"),
        )

    def starred(part):
        def styled(t):
            stars = F.length(F.regexp_extract(t, STARRED, 1))
            return run(F.regexp_extract(t, STARRED, 2), part["href"], stars >= 2, stars != 2)

        plain = F.array(run(part["text"], part["href"], note=True))
        return F.when(part["note"], plain).otherwise(_woven(part["text"], STARRED, lambda p: run(p, part["href"]), styled))

    def part(words, href, note):
        return F.struct(words.alias("text"), href.alias("href"), F.lit(note).alias("note"))

    def noted(link):
        return _woven(link["text"], NOTE_MARK, lambda p: part(p, link["href"], False), lambda t: part(F.regexp_extract(t, r"\d+", 0), link["href"], True))

    def link(words, href):
        return F.struct(words.alias("text"), href.alias("href"))

    nowhere = F.lit(None).cast("string")
    linked = _woven(
        text, LINK_MARK, lambda p: link(p, nowhere),
        lambda t: link(F.regexp_extract(t, r"\A\[([^\]]*)\]", 1), F.regexp_extract(t, r"\(([^)]*)\)\z", 1)),
    )
    runs = F.flatten(F.transform(F.flatten(F.transform(linked, noted)), starred))
    return F.filter(runs, lambda r: r["text"] != "").cast(RUNS)
