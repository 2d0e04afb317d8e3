"""Scans, block rows and scalar functions over the corpus documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import runs as rn
from quire.functions import text as tx
from quire.operators import blocks as bl
from quire.operators.tracks import keep_first_lines
from quire.plans.inputs import (
    SQL_LINES, SQL_TYPED, lines, sql_count_words, sql_norm_key, sql_strip, table, typed,
)
from quire.plans.registry import check
from quire.sources.tables import align_schema, read_documents


def _time_sql(w: str) -> str:
    m = f"({w} / 200.0)"
    halves = f"CAST(round_even({m} / 30.0, 0) AS BIGINT)"
    return (
        f"CASE WHEN {w} <= 0 THEN '' WHEN {m} < 60 THEN '~' || greatest(5, CAST(round_even({m} / 5.0, 0) AS BIGINT) * 5)"
        f" || ' min read' ELSE '~' || ({halves} // 2) || CASE WHEN {halves} % 2 = 1 THEN '½' ELSE '' END || ' hr read' END"
    )


@check(
    "corpus_profile",
    f"""WITH {SQL_LINES},
keyed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_norm_key('text')} ORDER BY pos) AS nth,
          {sql_count_words('text')} AS w FROM lines),
doc AS (SELECT doc_id, source, lang, count(*) AS paragraphs, sum(w) AS words, count(*) FILTER (nth > 1) AS repeats
        FROM keyed GROUP BY ALL),
g AS (SELECT source, lang, count(*) AS documents, CAST(sum(paragraphs) AS BIGINT) AS paragraphs,
      CAST(sum(words) AS BIGINT) AS words, CAST(sum(repeats) AS BIGINT) AS repeats FROM doc GROUP BY ALL)
SELECT *, {_time_sql('words')} AS reading_time, round(repeats / paragraphs, 6) AS repeat_share FROM g""",
)
def corpus_profile(spark, sf):
    """Per source and language: size, reading time, share of repeated lines."""
    rows = lines(spark, sf, "source", "lang")
    one = rows.select("doc_id", "source", "lang", tx.key_digest(F.col("text")).alias("k"), tx.word_count(F.col("text")).alias("w"))
    per_key = one.groupBy("doc_id", "source", "lang", "k").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    per_doc = per_key.groupBy("doc_id", "source", "lang").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") - 1).alias("r")
    )
    out = per_doc.groupBy("source", "lang").agg(
        F.count("*").alias("documents"), F.sum("n").alias("paragraphs"), F.sum("w").alias("words"), F.sum("r").alias("repeats")
    )
    return out.withColumns(
        {"reading_time": tx.reading_time(F.col("words")), "repeat_share": F.round(F.col("repeats") / F.col("paragraphs"), 6)}
    )


@check("read_documents", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def _(spark, sf):
    return read_documents(spark, f"{sf}/documents.parquet").where(F.col("lang") == "en").select("doc_id", "source", "n_chars")


@check("paragraphs", f"WITH {SQL_LINES} SELECT doc_id, pos, text FROM lines")
def _(spark, sf):
    return lines(spark, sf)


@check("align_schema", "SELECT doc_id, text, 'memoir' AS kind, CAST(NULL AS BIGINT) AS group_id, n_chars FROM documents")
def _(spark, sf):
    target = T.StructType.fromDDL("doc_id long, kind string, group_id long, n_chars long")
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return align_schema(align_schema(docs, target, {"kind": F.lit("memoir")}), target, {"kind": F.lit("other")})


@check(
    "word_counts",
    f"""WITH {SQL_TYPED} SELECT doc_id, CAST(sum(CASE WHEN type IN ('paragraph', 'heading', 'quote', 'bulletListItem',
    'numberedListItem') THEN {sql_count_words('text')} ELSE 0 END) AS BIGINT) AS words FROM typed GROUP BY doc_id""",
)
def _(spark, sf):
    return bl.word_counts(typed(spark, sf))


@check(
    "plain_text",
    f"""WITH {SQL_TYPED} SELECT doc_id, string_agg(CASE type WHEN 'image' THEN caption ELSE line END, chr(10) ORDER BY pos) AS body
    FROM typed GROUP BY doc_id""",
)
def _(spark, sf):
    return bl.plain_text(typed(spark, sf))


def styled(spark, sf):
    """Block rows whose runs are the line's sentences, styled by their length."""
    n = lambda s: F.length(s)

    def one(s, i):
        return F.struct(
            s.alias("text"), (n(s) % 2 == 0).alias("bold"), (n(s) % 3 == 0).alias("italic"),
            (n(s) % 5 == 0).alias("underline"), (n(s) % 7 == 0).alias("strike"), (n(s) % 11 == 0).alias("code"),
            (n(s) <= 6).alias("fn_ref"),
            F.when(n(s) % 13 == 0, F.concat(F.lit("https://e.org/?a=1&b="), i.cast("string"))).alias("href"),
        )

    rows = typed(spark, sf)
    return rows.withColumn("runs", F.when(F.col("text") != "", F.transform(F.split("text", r"\. "), one)).otherwise(F.col("runs")))


def _runs_sql(one: str) -> str:
    """Rendered runs: ``one`` renders sentence s with 1-based index i."""
    return f"array_to_string(list_transform(string_split(text, '. '), lambda s, i: {one}), '')"


def _rendered(one: str) -> str:
    return f"WITH {SQL_TYPED} SELECT doc_id, pos, CASE WHEN text = '' THEN '' ELSE {_runs_sql(one)} END AS out FROM typed"


_html = "replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
for _div, _tag in ((11, "code"), (7, "s"), (5, "u"), (2, "strong"), (3, "em")):
    _html = f"CASE WHEN length(s) % {_div} = 0 THEN '<{_tag}>' || {_html} || '</{_tag}>' ELSE {_html} END"
_html = f"""CASE WHEN length(s) <= 6 THEN '<sup class="fn-ref">' || replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</sup>' ELSE {_html} END"""
_html = f"""CASE WHEN length(s) % 13 = 0 THEN '<a href="https://e.org/?a=1&amp;b=' || (i - 1) || '">' || {_html} || '</a>' ELSE {_html} END"""
_stars = "repeat('*', CASE WHEN length(s) % 6 = 0 THEN 3 WHEN length(s) % 2 = 0 THEN 2 WHEN length(s) % 3 = 0 THEN 1 ELSE 0 END)"
_coded = "CASE WHEN length(s) % 11 = 0 THEN '`' || s || '`' ELSE s END"


def _link(shown: str) -> str:
    return f"CASE WHEN length(s) % 13 = 0 THEN '[' || ({shown}) || '](https://e.org/?a=1&b=' || (i - 1) || ')' ELSE ({shown}) END"


_md = _link(f"CASE WHEN length(s) <= 6 THEN '[' || s || ']' ELSE {_stars} || ({_coded}) || {_stars} END")
_polish = _link(
    f"CASE WHEN length(s) <= 6 THEN '[^' || s || ']' WHEN length(s) % 11 = 0 THEN '`' || s || '`' ELSE {_stars} || s || {_stars} END"
)

for _name, _fn, _sql in (
    ("inline_text", rn.inline_text, _rendered("s")),
    ("inline_html", rn.inline_html, _rendered(_html)),
    ("inline_md", rn.inline_md, _rendered(_md)),
    ("runs_to_polish_text", rn.polish_text, _rendered(_polish)),
):

    def _render(spark, sf, _fn=_fn):
        return styled(spark, sf).select("doc_id", "pos", _fn(F.col("runs")).alias("out"))

    check(_name, _sql)(_render)


@check(
    "fully_italic",
    f"""WITH {SQL_TYPED}, r AS (SELECT *, list_filter(string_split(text, '. '), lambda s: length(s) > 6 AND
    regexp_matches(s, '[\\p{{L}}\\p{{N}}]')) AS spoken FROM typed)
    SELECT doc_id, pos, text <> '' AND len(spoken) > 0 AND len(list_filter(spoken, lambda s: length(s) % 3 <> 0)) = 0 AS italic FROM r""",
)
def _(spark, sf):
    return styled(spark, sf).select("doc_id", "pos", rn.fully_italic(F.col("runs")).alias("italic"))


_ITALIC = """r AS (SELECT *, list_filter(string_split(text, '. '), lambda s: length(s) > 6 AND
    regexp_matches(s, '[\\p{L}\\p{N}]')) AS spoken FROM typed),
it AS (SELECT *, type = 'paragraph' AND text <> '' AND len(spoken) > 0
       AND len(list_filter(spoken, lambda s: length(s) % 3 <> 0)) = 0 AS turned,
       replace(text, '. ', '') AS plain FROM r)"""


@check(
    "to_narrative",
    f"""WITH {SQL_TYPED}, {_ITALIC}
    SELECT doc_id, pos, CASE WHEN turned THEN 'narrative' ELSE type END AS type,
    CASE WHEN text = '' THEN 0 ELSE len(list_filter(string_split(text, '. '),
      lambda s: length(s) % 3 = 0 AND (length(s) <= 6 OR NOT turned))) END AS italic_runs FROM it""",
)
def _(spark, sf):
    out = bl.to_narrative(bl.to_narrative(styled(spark, sf)))
    return out.select("doc_id", "pos", "type", F.size(F.filter("runs", lambda r: r["italic"])).cast("long").alias("italic_runs"))


@check(
    "conversion_scan",
    f"""WITH {SQL_TYPED}, {_ITALIC}
    SELECT d.doc_id, count(*) FILTER (turned) AS conversions, count(*) FILTER (turned AND {sql_count_words('plain')} < 12) AS flagged
    FROM documents d LEFT JOIN it ON it.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark, sf):
    return bl.conversion_scan(styled(spark, sf), table(spark, sf, "documents"))


@check(
    "conversions",
    f"""WITH {SQL_TYPED}, {_ITALIC}
    SELECT doc_id, pos, {sql_count_words('plain')} AS words, CASE WHEN length(plain) > 90 THEN substring(plain, 1, 90) || '…'
    ELSE plain END AS preview, {sql_count_words('plain')} < 12 AS flagged FROM it WHERE turned""",
)
def _(spark, sf):
    return bl.conversions(styled(spark, sf))


@check(
    "add_italic",
    f"""WITH {SQL_TYPED} SELECT doc_id, pos, len(list_filter(string_split(text, '. '), lambda s: length(s) > 6 OR length(s) % 3 = 0)) AS italic_runs
    FROM typed WHERE text <> ''""",
)
def _(spark, sf):
    rows = styled(spark, sf).where(F.col("text") != "")
    return rows.select(
        "doc_id", "pos", F.size(F.filter(rn.add_italic(F.col("runs")), lambda r: r["italic"])).cast("long").alias("italic_runs")
    )


@check(
    "coalesce_runs",
    f"""WITH {SQL_TYPED}, w AS (SELECT doc_id, pos, unnest(string_split(text, ' ')) AS s, generate_subscripts(string_split(text, ' '), 1) AS i
      FROM typed WHERE text <> ''),
    f AS (SELECT *, length(s) > 4 AS b, length(s) = 9 AS link FROM w),
    g AS (SELECT *, CASE WHEN i > 1 AND b = lag(b) OVER x AND NOT link AND NOT lag(link) OVER x THEN 0 ELSE 1 END AS opens FROM f WINDOW x AS (PARTITION BY doc_id, pos ORDER BY i)),
    h AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, pos ORDER BY i) AS g FROM g),
    k AS (SELECT doc_id, pos, g, string_agg(s, '' ORDER BY i) AS t, bool_or(b) AS b FROM h GROUP BY ALL)
    SELECT doc_id, pos, string_agg(t || CASE WHEN b THEN '!' ELSE '.' END, '|' ORDER BY g) AS out FROM k GROUP BY ALL""",
)
def _(spark, sf):
    """Runs are the line's words: bold when longer than 4, a link when 9 long."""

    def one(s):
        off = [F.lit(False).alias(n) for n in ("italic", "underline", "strike", "code", "fn_ref")]
        return F.struct(s.alias("text"), (F.length(s) > 4).alias("bold"), *off, F.when(F.length(s) == 9, F.lit("u")).alias("href"))

    rows = typed(spark, sf).where(F.col("text") != "").withColumn("runs", F.transform(F.split("text", " "), one))
    merged = rn.coalesce_runs(F.col("runs"))
    shown = F.transform(merged, lambda r: F.concat(r["text"], F.when(r["bold"], "!").otherwise(".")))
    return rows.select("doc_id", "pos", F.array_join(shown, "|").alias("out"))


@check("polish_text_round_trip", f"WITH {SQL_TYPED} SELECT doc_id, pos, text AS out, true AS same FROM typed WHERE text <> ''")
def _(spark, sf):
    """Words become runs (bold, italic, note, link); text -> runs -> text must not change."""

    def one(s, i):
        digit = (F.length(s) % 10).cast("string")
        note = i % 5 == 4
        return F.struct(
            F.when(note, digit).otherwise(F.concat(s, F.lit("_"))).alias("text"),
            (~note & (i % 5 == 1)).alias("bold"), (~note & (i % 5 == 2)).alias("italic"),
            F.lit(False).alias("underline"), F.lit(False).alias("strike"), F.lit(False).alias("code"), note.alias("fn_ref"),
            F.when(i % 5 == 3, F.lit("https://e.org/x")).alias("href"),
        )

    rows = typed(spark, sf).where(F.col("text") != "")
    clean = F.translate("text", "*[]()", "")
    rows = rows.select("doc_id", "pos", "text", F.transform(F.split(clean, " "), one).alias("runs"))
    rows = rows.select("*", rn.polish_text(F.col("runs")).alias("md"))
    rows = rows.withColumn("back", rn.runs_of(F.col("md")))
    return rows.select("doc_id", "pos", F.col("text").alias("out"), (rn.polish_text(F.col("back")) == F.col("md")).alias("same"))


# the references that the page corpus holds, named and numeric; a bare ampersand and an unknown name stay
_REFERENCES = {
    "&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&#x27;": "chr(39)", "&#39;": "chr(39)", "&apos;": "chr(39)", "&nbsp;": "chr(160)", "&copy;": "'©'",
    "&middot;": "'·'", "&eacute;": "'é'", "&#8217;": "'’'", "&hellip;": "'…'", "&amp;": "'&'",
}


def sql_unescape(expr: str) -> str:
    for name, plain in _REFERENCES.items():
        expr = f"replace({expr}, '{name}', {plain})"
    return expr


@check(
    "strip_html",
    f"""SELECT page_id, {sql_strip(sql_unescape("regexp_replace(html || '<i>caf&eacute; &#8217;x&#8217; &hellip; A&B &nosuch; ' || page_id || '</i>', '<[^>]+>', '', 'g')"))} AS out FROM pages""",
)
def _(spark, sf):
    more = F.concat("html", F.lit("<i>caf&eacute; &#8217;x&#8217; &hellip; A&B &nosuch; "), F.col("page_id").cast("string"), F.lit("</i>"))
    return table(spark, sf, "pages").select("page_id", tx.strip_html(more).alias("out"))


@check("html_fragment_plain", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || ' &amp; x' ELSE url || ' & x' END AS out FROM pages")
def _(spark, sf):
    """Text without a tag is handed back as it is, references and all."""
    tail = F.when(F.col("page_id") % 2 == 0, " &amp; x").otherwise("<a name='t'> &amp; x</a>")
    return table(spark, sf, "pages").select("page_id", tx.html_fragment_to_md(F.concat("url", tail)).alias("out"))


@check(
    "html_fragment_to_md",
    """WITH h AS (SELECT page_id, url, replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM pages)
    SELECT page_id, '**' || t || '** *' || lower(url) || '* [' || url || '](' || url || ')' AS out FROM h""",
)
def _(spark, sf):
    title = F.regexp_extract("html", r"<h1>(.*?)</h1>", 1)
    fragment = F.concat(
        F.lit("<strong>"), title, F.lit("</strong> <em>"), F.lower("url"), F.lit('</em> <span><a class="x" href="'), F.col("url"),
        F.lit('">'), F.col("url"), F.lit("</a></span>"),
    )
    return table(spark, sf, "pages").select("page_id", tx.html_fragment_to_md(fragment).alias("out"))


@check(
    "reading_time",
    f"SELECT l_orderkey, l_linenumber, CAST(l_quantity * l_quantity * 20 AS BIGINT) AS words, {_time_sql('CAST(l_quantity * l_quantity * 20 AS BIGINT)')} AS label FROM lineitem",
)
def _(spark, sf):
    words = (F.col("l_quantity") * F.col("l_quantity") * 20).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", words.alias("words"), tx.reading_time(words).alias("label"))


@check(
    "start_year",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '2024010112' || o_orderkey || '-x' WHEN o_orderstatus = 'F' THEN year(o_orderdate) || '_' || o_orderkey
      WHEN o_orderstatus = 'O' THEN year(o_orderdate) || '-' || o_orderkey ELSE 'x' || o_orderkey END AS slug FROM orders)
    SELECT o_orderkey, slug, CAST(CASE WHEN regexp_matches(slug, '^[0-9]') THEN regexp_extract(slug, '^[0-9]+') ELSE '9999' END AS BIGINT) AS lenient,
    CAST(CASE WHEN regexp_matches(split_part(slug, '-', 1), '^[0-9]+$') THEN split_part(slug, '-', 1) ELSE '9999' END AS BIGINT) AS strict FROM s""",
)
def _(spark, sf):
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    slug = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("2024010112"), k, F.lit("-x")))
        .when(F.col("o_orderstatus") == "F", F.concat(y, F.lit("_"), k))
        .when(F.col("o_orderstatus") == "O", F.concat(y, F.lit("-"), k))
        .otherwise(F.concat(F.lit("x"), k))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", slug.alias("slug"))
    return rows.withColumns({"lenient": tx.start_year(F.col("slug")), "strict": tx.start_year(F.col("slug"), strict=True)})


@check("norm_key", f"WITH {SQL_LINES} SELECT doc_id, pos, {sql_norm_key('text')} AS k FROM lines")
def _(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", tx.norm_key(F.col("text")).alias("k"))


@check(
    "content_hash",
    f"""WITH {SQL_TYPED}, b AS (SELECT doc_id, pos, sha256(concat_ws(chr(31), type, coalesce(CAST(level AS VARCHAR), ''), '0',
      replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
      CASE type WHEN 'image' THEN 'asset_id' || chr(30) || asset_id || chr(29) || 'caption' || chr(30) || caption
        WHEN 'footnote' THEN 'marker' || chr(30) || marker || chr(29) || 'text' || chr(30) || line ELSE '' END)) AS h FROM typed),
    s AS (SELECT doc_id, pos // 4096 AS seg, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM b GROUP BY ALL)
    SELECT doc_id, sha256(string_agg(h, '' ORDER BY seg)) AS content_hash FROM s GROUP BY doc_id""",
)
def _(spark, sf):
    return bl.content_hash(typed(spark, sf))


@check(
    "fix_smart_quotes",
    f"""WITH {SQL_LINES}, q AS (SELECT doc_id, pos, '„' || replace(replace(text, 'th', 't"h'), 'an', 'a”n') || '”' AS t FROM lines),
    a AS (SELECT doc_id, pos, regexp_replace(replace(t, '„', '“'), '([A-Za-z])[”"]([A-Za-z])', '\\1’\\2', 'g') AS t FROM q)
    SELECT doc_id, pos, regexp_replace(t, '([A-Za-z])[”"]([A-Za-z])', '\\1’\\2', 'g') AS out FROM a""",
)
def _(spark, sf):
    odd = F.concat(F.lit("„"), F.replace(F.replace("text", F.lit("th"), F.lit('t"h')), F.lit("an"), F.lit("a”n")), F.lit("”"))
    return lines(spark, sf).select("doc_id", "pos", tx.fix_smart_quotes(odd).alias("out"))


@check(
    "collapse_repeats",
    f"""WITH {SQL_LINES}, s AS (SELECT doc_id, pos, regexp_replace(text, '{tx.BLANK}+', ' ', 'g') AS t FROM lines),
    h AS (SELECT *, (length(t) - 1) // 2 AS half FROM s)
    SELECT doc_id, pos, t AS doubled, CASE WHEN length(t) % 2 = 1 AND half > 0 AND substring(t, half + 1, 1) = ' ' AND
    substring(t, 1, half) = substring(t, half + 2, half) THEN substring(t, 1, half) ELSE t END AS once FROM h""",
)
def _(spark, sf):
    twice = F.concat_ws("  ", "text", "text")
    return lines(spark, sf).select(
        "doc_id", "pos", tx.collapse_repeats(twice).alias("doubled"), tx.collapse_repeats(F.col("text")).alias("once")
    )


@check(
    "strip_emphasis",
    f"""WITH {SQL_LINES} SELECT doc_id, pos, trim(replace(text, chr(92), '')) AS bold, trim(replace(text, chr(92), '')) AS italic,
    '1st ' || text AS plain FROM lines""",
)
def _(spark, sf):
    mark = lambda m: F.concat(F.lit(m), F.col("text"), F.lit(m))
    sup = F.concat(F.lit('1<SUP class="o">st</sup> '), F.col("text"))
    return lines(spark, sf).select(
        "doc_id", "pos", tx.strip_emphasis(mark("**")).alias("bold"), tx.strip_emphasis(mark("*")).alias("italic"),
        tx.strip_sup_sub(sup).alias("plain"),
    )


@check(
    "is_caps",
    f"""WITH {SQL_LINES} SELECT doc_id, pos, regexp_matches(text, '\\p{{L}}') AND upper(text) = text AS caps,
    regexp_matches(trim(text, '.,;:'), '^(1[89]|20)[0-9][0-9](\\s*[–—-]\\s*(1[89]|20)[0-9][0-9])?$') AS is_year FROM lines""",
)
def _(spark, sf):
    return lines(spark, sf).select(
        "doc_id", "pos", tx.is_caps(F.col("text")).alias("caps"), tx.is_year_heading(F.col("text")).alias("is_year")
    )


@check("estimated_tokens", f"WITH {SQL_LINES} SELECT doc_id, pos, greatest(1, length(text) // 4) AS tokens FROM lines")
def _(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", tx.estimated_tokens(F.col("text")).alias("tokens"))


@check(
    "slugify",
    f"""WITH {SQL_LINES}, c AS (SELECT doc_id, pos, replace(replace(replace(replace(replace(replace({sql_norm_key('text')}, 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'đ', 'd'), 'ł', 'l'), 'ð', 'd') AS t FROM lines)
    SELECT doc_id, pos, trim(regexp_replace(strip_accents(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM c""",
)
def _(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", tx.slugify(F.col("text")).alias("slug"))


_PUNCT = "chr(34) || '!#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(39)"
_TYPO = "replace(translate(text, '“”‘’„‚—–' || chr(160) || '*', chr(34) || chr(34) || chr(39) || chr(39) || chr(34) || chr(39) || '-- '), '…', '...')"


@check(
    "tokenize_words",
    f"""WITH {SQL_LINES}
    SELECT doc_id, pos, array_to_string(list_filter(list_transform(regexp_extract_all({_TYPO}, '{tx.WORD}'), lambda w: trim(w, {_PUNCT})), lambda w: w <> ''), ' ') AS out FROM lines""",
)
def _(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", F.array_join(tx.tokenize_words(F.col("text")), " ").alias("out"))


@check(
    "bind_digit_refs",
    f"""WITH {SQL_LINES}, t AS (SELECT doc_id, pos, replace(replace(regexp_replace(text, '[0-9]', '', 'g'), 'er ', 'er1 '), 'th ', 'th23 ') AS t FROM lines)
    SELECT doc_id, pos, replace(t, 'er1 ', 'er[^1] ') AS one, replace(replace(t, 'er1 ', 'er[^1] '), 'th23 ', 'th[^23] ') AS both FROM t""",
)
def _(spark, sf):
    odd = F.replace(F.replace(F.regexp_replace("text", "[0-9]", ""), F.lit("er "), F.lit("er1 ")), F.lit("th "), F.lit("th23 "))
    return lines(spark, sf).select(
        "doc_id", "pos", tx.bind_digit_refs(odd, F.array(F.lit(1), F.lit(7))).alias("one"),
        tx.bind_digit_refs(odd, F.array(F.lit(1), F.lit(23))).alias("both"),
    )


@check(
    "published_number",
    "SELECT l_orderkey, l_linenumber, l_linenumber AS n, CAST(NULL AS INTEGER) AS none FROM lineitem",
)
def _(spark, sf):
    src = F.concat(F.lit("x_assets/figure-"), F.col("l_linenumber").cast("string"), F.lit("-original.png"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.published_number(src).alias("n"),
        tx.published_number(F.col("l_returnflag")).alias("none"),
    )


@check(
    "footer",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '© ' || c_name || ' &amp; co' WHEN c_mktsegment = 'MACHINERY' THEN
    '© ' || c_name || ' &amp; co · ' || c_mktsegment WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE '© ' || c_name || ' &amp; co · <a href="https://e.org/?q=&quot;' || c_custkey || '">' || c_mktsegment || '</a>' END AS out FROM customer""",
)
def _(spark, sf):
    seg = F.col("c_mktsegment")
    notice = F.when(seg != "AUTOMOBILE", F.concat(F.lit(" © "), F.col("c_name"), F.lit(" & co ")))
    label = F.when(~seg.isin("BUILDING", "AUTOMOBILE"), seg).otherwise(" ")
    url = F.when(~seg.isin("MACHINERY"), F.concat(F.lit('https://e.org/?q="'), F.col("c_custkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", tx.footer(notice, label, url).alias("out"))


@check(
    "display_width",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_linenumber * 8 > l_quantity THEN 'portrait' ELSE 'full' END AS width FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.display_width(F.col("l_quantity"), F.col("l_linenumber") * 8).alias("width")
    )


@check(
    "year_display",
    """SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR)
    ELSE min(year(o_orderdate)) || '–' || max(year(o_orderdate)) END AS shown,
    CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR)
    ELSE min(year(o_orderdate)) || '-' || max(year(o_orderdate)) END AS file FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    lo, hi = F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        tx.year_display(lo, hi).alias("shown"), tx.year_display(lo, hi, "-").alias("file")
    )


@check(
    "polishable",
    f"""WITH {SQL_TYPED} SELECT doc_id, pos, block_id, CASE WHEN type = 'heading' THEN 'h' || level ELSE 'p' END AS kind, text
    FROM typed WHERE type NOT IN ('image', 'footnote')""",
)
def _(spark, sf):
    return bl.polishable(typed(spark, sf))


@check(
    "dedup_lines",
    f"""WITH {SQL_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_norm_key('text')} ORDER BY pos) AS nth FROM lines)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS seq, text FROM f WHERE nth = 1""",
)
def _(spark, sf):
    return keep_first_lines(lines(spark, sf))
