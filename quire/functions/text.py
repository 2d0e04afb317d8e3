"""Scalar text functions: Column in, Column out, JVM-side but for character references."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points Python's str.split()/strip() treat as blank.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# the same set as a character class: single Latin characters share one table, the rest one property
_CLASS = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\p{Z}"
BLANK = f"[{_CLASS}]"
WORD = f"[^{_CLASS}]+"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANK_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse every run of blanks to one space."""
    return F.regexp_replace(c, f"{BLANK}+", " ")


def words(c: Column) -> Column:
    """Whitespace tokens; an empty array for blank text."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def casefold(c: Column) -> Column:
    return _swap(F.lower(c), (("ß", "ss"), ("ς", "σ"), ("ſ", "s")))


def _swap(c: Column, pairs) -> Column:
    for bad, good in pairs:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def norm_key(c: Column) -> Column:
    """Comparison key: trimmed, casefolded, blanks collapsed (F-10)."""
    return squeeze(casefold(strip(c)))


def key_digest(c: Column) -> Column:
    """The comparison key itself when short, else its sha256: groups alike without shuffling long text."""
    k = norm_key(c)
    return F.when(F.length(k) <= 40, k).otherwise(F.sha2(k, 256))


def reading_time(n_words: Column, wpm: int = 200) -> Column:
    """'' / '~N min read' / '~N½ hr read', rounding halves to even (F-08)."""
    minutes = n_words / F.lit(wpm)
    fives = F.greatest(F.lit(5), (F.bround(minutes / 5, 0) * 5).cast("int"))
    halves = F.bround(minutes / 30, 0).cast("int")
    hours = F.floor(halves / 2).cast("string")
    return (
        F.when(n_words <= 0, "")
        .when(minutes < 60, F.concat(F.lit("~"), fives.cast("string"), F.lit(" min read")))
        .otherwise(F.concat(F.lit("~"), hours, F.when(halves % 2 == 1, "½").otherwise(""), F.lit(" hr read")))
    )


def start_year(slug: Column, strict: bool = False) -> Column:
    """Leading year of a slug, 9999 without one (F-09).

    ``strict`` asks for the whole part before the first '-' to be digits.
    """
    lead = F.split_part(slug, F.lit("-"), F.lit(1)) if strict else slug
    digits = F.regexp_extract(lead, r"^(\d+)$" if strict else r"^(\d+)", 1)
    beyond = F.when(digits != "", F.lit(2**63 - 1))  # more digits than a bigint holds sort last
    return F.coalesce(digits.try_cast("long"), beyond, F.lit(9999))


def fix_smart_quotes(c: Column) -> Column:
    """Low-9 openers to English ones; a double quote between letters is an apostrophe (F-13)."""
    for bad, good in (("„", "“"), ("‚", "‘"), ("‟", "”"), ("‘‘", "“")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return F.regexp_replace(c, '(?<=[A-Za-z])[”"](?=[A-Za-z])', "’")


# Typographic marks and what they are compared as.
TYPOGRAPHY = (
    ("“", '"'), ("”", '"'), ("„", '"'), ("‘", "'"), ("’", "'"), ("‚", "'"), ("—", "-"), ("–", "-"), ("\xa0", " "), ("…", "..."), ("*", ""),
)


def normalise_typography(c: Column) -> Column:
    """Drop emphasis stars and unify quotes, dashes, ellipsis and no-break space."""
    for mark, plain in TYPOGRAPHY:
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def tokenize_words(c: Column) -> Column:
    """Words compared by the fidelity check (F-23)."""
    bare = F.transform(words(normalise_typography(c)), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.filter(bare, lambda w: w != "")


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def collapse_repeats(c: Column) -> Column:
    """'X X' becomes 'X' when both halves agree up to blanks (F-15)."""
    t = squeeze(strip(c))
    half = F.floor((F.length(t) - 1) / 2).cast("int")
    left, right = F.substring(t, F.lit(1), half), F.substring(t, half + 2, half)
    doubled = (F.length(t) % 2 == 1) & (half > 0) & (left == right) & (F.substring(t, half + 1, F.lit(1)) == " ")
    return F.when(doubled, left).otherwise(t)


def strip_emphasis(c: Column) -> Column:
    """Remove one wholly wrapping bold or italic span and backslash escapes (F-16)."""
    t = strip(c)
    bold, italic = r"(?s)\A\*\*(.+?)\*\*\z", r"(?s)\A\*(?!\*)(.+?)\*\z"
    inner = F.when(t.rlike(bold), F.regexp_extract(t, bold, 1)).when(t.rlike(italic), F.regexp_extract(t, italic, 1))
    return strip(F.replace(F.coalesce(strip(inner), t), F.lit("\\"), F.lit("")))


def strip_sup_sub(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)</?su[pb][^>]*>", "")


def is_caps(c: Column) -> Column:
    """At least one letter, and upper-casing changes nothing (F-17)."""
    return c.rlike(r"\p{L}") & (F.upper(c) == c)


def is_year_heading(c: Column) -> Column:
    """A year or a year range, edge punctuation ignored (F-17)."""
    bare = F.btrim(strip(c), F.lit(".,;:"))
    return bare.rlike(r"\A(1[89]|20)\d{2}(\s*[–—-]\s*(1[89]|20)\d{2})?\z")


def slugify(c: Column) -> Column:
    """Lower-case words joined by '-': Latin letters without marks, letters of other scripts as they are (F-21)."""
    folded = fold_latin(_swap(casefold(c), FOLDS_WIDE.items()))
    return F.btrim(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", "-"), F.lit("-"))


def _fold_pair() -> tuple[str, str]:
    """Latin letters whose Unicode decomposition starts with an ASCII letter."""
    import unicodedata

    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if chr(code).islower() and base.isascii() and base.isalpha():
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_PAIR = _fold_pair()


def fold_latin(c: Column) -> Column:
    """Lower-case Latin letters without their marks; pure ASCII text is passed through."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, *_FOLD_PAIR)).otherwise(c)


FOLDS_WIDE = {"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d"}


def html_escape(c: Column, quote: bool = False) -> Column:
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    if quote:
        c = F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    return c


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """All named and numeric character references decoded; only texts that hold one leave the JVM."""
    some = c.rlike("&(?:#|[A-Za-z])")
    return F.when(some, _unescape(F.when(some, c))).otherwise(c)


def strip_html(c: Column) -> Column:
    """Tags out, entities decoded, trimmed (F-07)."""
    return strip(html_unescape(F.regexp_replace(c, r"<[^>]+>", "")))


def html_fragment_to_md(c: Column) -> Column:
    """em/i, strong/b and a to Markdown, other tags unwrapped; text without a tag stays as it is (F-07)."""
    plain = c
    c = F.regexp_replace(c, r"(?is)</?(?:em|i)(?:\s[^>]*)?>", "*")
    c = F.regexp_replace(c, r"(?is)</?(?:strong|b)(?:\s[^>]*)?>", "**")
    c = F.regexp_replace(c, r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    return F.when(plain.contains("<"), html_unescape(F.regexp_replace(c, r"<[^>]+>", ""))).otherwise(plain)


def footer(notice: Column, label: Column, url: Column) -> Column:
    """Escaped notice and label joined by ' · ', linked when a url is set (F-27)."""
    n, t, u = strip(F.coalesce(notice, F.lit(""))), strip(F.coalesce(label, F.lit(""))), strip(F.coalesce(url, F.lit("")))
    shown = F.when(
        (u != "") & (t != ""),
        F.concat(F.lit('<a href="'), html_escape(u, True), F.lit('">'), html_escape(t), F.lit("</a>")),
    ).otherwise(html_escape(t))
    return F.concat_ws(" · ", F.nullif(html_escape(n), F.lit("")), F.nullif(shown, F.lit("")))


def year_display(lo: Column, hi: Column, sep: str = "–") -> Column:
    """'lo–hi', or one year when both agree (F-30)."""
    return (
        F.when(lo.isNull(), "")
        .when(lo == hi, lo.cast("string"))
        .otherwise(F.concat(lo.cast("string"), F.lit(sep), hi.cast("string")))
    )


def published_number(src: Column) -> Column:
    """n of 'figure-n-original' (F-26)."""
    return F.nullif(F.regexp_extract(src, r"figure-(\d+)-original", 1), F.lit("")).try_cast("int")


def display_width(width: Column, height: Column) -> Column:
    """'portrait' when taller than wide, else 'full' (F-29)."""
    return F.when((width > 0) & (height > 0) & (height > width), "portrait").otherwise("full")


def bind_digit_refs(text: Column, known: Column) -> Column:
    """'Vietnam1' to 'Vietnam[^1]' for note numbers in the array ``known`` (F-14).

    The text is cut right after every letter-plus-1–2-digits token, so each
    piece ends in at most one candidate and is rewritten on its own.
    """
    pieces = F.split(text, r"(?<=(?<!\d)[A-Za-z]\d{1,2})(?!\d)", -1)

    def mark(piece: Column, i: Column) -> Column:
        head = F.regexp_extract(piece, r"(?<!\d)[A-Za-z](\d{1,2})\z", 1)
        rest = F.regexp_extract(piece, r"(?<=\D)[A-Za-z](\d{1,2})\z", 1)
        n = F.when(i == 0, head).otherwise(rest)
        hit = (n != "") & F.array_contains(known, F.nullif(n, F.lit("")).cast("int"))
        kept = F.substring(piece, F.lit(1), F.length(piece) - F.length(n))
        return F.when(hit, F.concat(kept, F.lit("[^"), n.cast("int").cast("string"), F.lit("]"))).otherwise(piece)

    worth = (F.size(known) > 0) & text.rlike(r"[A-Za-z]\d")
    return F.when(worth, F.array_join(F.transform(pieces, mark), "")).otherwise(text)
