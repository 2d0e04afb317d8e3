"""Published pages to ordered block rows, metadata and DOM tokens."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.sources.tables import RUN

# Tags without an end, tags that end an open paragraph, style tags.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
STYLES = {"em": "italic", "i": "italic", "strong": "bold", "b": "bold", "u": "underline", "s": "strike", "del": "strike", "code": "code"}
FLAGS = [f.name for f in RUN.fields[1:7]]
PAGE_ROWS = (
    f"page_id long, pos int, parent_pos int, depth int, type string, level int, runs array<{RUN.simpleString()}>, "
    f"props map<string,string>, cells array<array<array<{RUN.simpleString()}>>>"
)


class ArticleReader(HTMLParser):
    """Streams one page and keeps a row per body block of its article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.links = [], [], 0

    # an open element: (tag, role, row or None, styles, link number, href)
    def add_row(self, kind, level=None, props=None, parent=None, cells=None):
        row = {"type": kind, "level": level, "runs": [], "props": props or {}, "cells": cells, "parent": parent}
        self.rows.append(row)
        return row

    def push(self, tag, role, row=None, styles=frozenset(), link=None):
        self.open.append((tag, role, row, styles, link))

    def top(self):
        return self.open[-1] if self.open else (None, "outside", None, frozenset(), None)

    def close_paragraph(self):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "p":
                del self.open[i:]
                return
            if self.open[i][1] in ("container", "list", "li", "cell", "quote"):
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self.close_paragraph()
        if tag in ("li", "tr", "td", "th"):
            self.close_item(tag)
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        _, role, row, styles, link = self.top()
        if role == "outside":
            if tag == "article":
                self.push(tag, "container")
            return
        if role in ("raw", "rawdone"):
            if role == "raw" and not ({"fignum", "fn-num"} & set(classes)):
                row["raw"] += self.get_starttag_text()
                if tag not in VOID:
                    self.push(tag, "raw", row)
            elif tag not in VOID:
                self.push(tag, "marker", row)
            return
        new = self.start_in(role, tag, a, classes, row, styles, link)
        if tag not in VOID:
            self.push(tag, *new)

    def start_in(self, role, tag, a, classes, row, styles, link):
        if role == "container":
            return self.start_block(tag, a, classes)
        if role == "quote" and tag == "p":
            row["drop"] = True
            return ("leaf", self.add_row("quote"))
        if role == "narrative":
            return ("leaf", self.add_row("narrative")) if tag == "p" and "narrative-label" not in classes else ("skip",)
        if role == "list":
            return ("li", self.add_row(row["item"], parent=row["parent"])) if tag == "li" else ("skip",)
        if role == "li" and tag in ("ul", "ol"):
            return ("list", {"item": "numberedListItem" if tag == "ol" else "bulletListItem", "parent": row})
        if role == "figure":
            if tag == "img" and "src" not in row["props"]:
                row["props"].update(src=a.get("src", ""), alt_text=a.get("alt", ""))
            if tag == "figcaption":
                row["raw"] = ""
                return ("raw", row)
            return ("figure", row)
        if role == "table":
            if tag == "tr":
                row["cells"].append([])
            if tag in ("td", "th"):
                holder = {"runs": []}
                row["cells"][-1:] or row["cells"].append([])
                row["cells"][-1].append(holder["runs"])
                return ("cell", holder)
            return ("table", row)
        if role in ("leaf", "li", "cell", "quote", "inline"):
            if tag == "br":
                self.add_text("\n")
            if tag == "sup" and "fn-ref" in classes:
                styles = styles | {"fn_ref"}
            elif tag in STYLES:
                styles = styles | {STYLES[tag]}
            if tag == "a":
                self.links += 1
                link = (self.links, a.get("href", ""))
            return ("inline", row, styles, link)
        return ("skip",)

    def start_block(self, tag, a, classes):
        if tag in ("h2", "h3"):
            return ("leaf", self.add_row("heading", int(tag[1])))
        if tag == "p":
            return ("leaf", self.add_row("paragraph"))
        if tag == "figure":
            shape = "portrait" if "portrait" in classes else "full"
            return ("figure", self.add_row("image", props={"display_width": shape, "approval": "approved"}))
        if tag == "aside" and "footnote" in classes:
            row = self.add_row("footnote", props={"marker": ""})
            row["raw"] = ""
            return ("raw", row)
        if tag == "blockquote":
            return ("quote", self.add_row("quote"))
        if tag in ("ul", "ol"):
            return ("list", {"item": "numberedListItem" if tag == "ol" else "bulletListItem", "parent": None})
        if tag == "hr":
            self.add_row("divider")
        if tag == "table":
            return ("table", self.add_row("table", cells=[]))
        if tag == "div" and "narrative" in classes:
            return ("narrative",)
        return ("container",) if tag in ("div", "section", "article") else ("skip",)

    def close_item(self, tag):
        ends = {"li": ("li", ("list",)), "tr": ("tr", ("container",)), "td": ("cell", ("container",)), "th": ("cell", ("container",))}[tag]
        for i in range(len(self.open) - 1, -1, -1):
            name, role = self.open[i][:2]
            if role in ends[1] or name == "table":
                return
            if role == ends[0] or name == ends[0]:
                del self.open[i:]
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if self.open[i][1] == "raw" and tag not in ("figcaption", "aside"):
                    self.open[i][2]["raw"] += f"</{tag}>"
                del self.open[i:]
                return

    def handle_data(self, data):
        role, row = self.top()[1:3]
        if role == "raw":
            row["raw"] += escape(data, quote=False)
        elif role == "marker" and row["type"] == "footnote":
            row["props"]["marker"] += data
        elif role in ("leaf", "li", "cell", "quote", "inline"):
            self.add_text(data)

    def add_text(self, text):
        _, _, row, styles, link = self.top()
        runs = row["runs"]
        run = {"text": text, **{f: f in styles for f in FLAGS}, "href": link[1] if link else None}
        same = runs and row.get("last_link") == (link[0] if link else None) and all(runs[-1][f] == run[f] for f in FLAGS)
        if same:
            runs[-1]["text"] += text
        else:
            runs.append(run)
        row["last_link"] = link[0] if link else None

    def finished(self, page_id):
        self.close()
        kept = [r for r in self.rows if not r.get("drop")]
        at = {id(r): i for i, r in enumerate(kept)}
        out, depth = [], {}
        for i, r in enumerate(kept):
            parent = at.get(id(r["parent"])) if r["parent"] is not None else None
            depth[i] = 0 if parent is None else depth[parent] + 1
            raw = r.get("raw")
            if raw is not None:
                r["props"]["text" if r["type"] == "footnote" else "caption"] = raw.strip() if r["type"] == "footnote" else raw
            out.append((page_id, i, parent, depth[i], r["type"], r["level"], r["runs"], r["props"], r["cells"]))
        return out


def read_article(page_id: int, html: str) -> list[tuple]:
    reader = ArticleReader()
    reader.feed(html or "")
    return reader.finished(page_id)


_COLUMNS = ["page_id", "pos", "parent_pos", "depth", "type", "level", "runs", "props", "cells"]


def extract_pages(pages: DataFrame) -> DataFrame:
    """Article body of every page as ordered block rows (S-03)."""

    def read(batches):
        for pdf in batches:
            rows = [r for page_id, html in zip(pdf["page_id"], pdf["html"]) for r in read_article(page_id, html)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("parent_pos", "level"):
                out[c] = out[c].astype("Int32")
            yield out

    return pages.select("page_id", "html").mapInPandas(read, PAGE_ROWS)


# ---------------------------------------------------------------- metadata, JVM-side


def _element(html: Column, tag: str, cls: str) -> Column:
    return F.regexp_extract(html, rf"""(?is)<{tag}\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{cls}(?:\s[^"']*)?["'][^>]*>(.*?)</{tag}>""", 1)


def _text(fragment: Column) -> Column:
    return tx.strip(tx.squeeze(tx.html_unescape(F.regexp_replace(fragment, "<[^>]+>", ""))))


def _attr(tag: Column, name: str) -> Column:
    return tx.html_unescape(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1))


def _tag(html: Column, tag: str, key: str, value: str) -> Column:
    return F.regexp_extract(html, rf"""(?is)(<{tag}\b(?=[^>]*\b{key}\s*=\s*["']{value}["'])[^>]*>)""", 1)


def jsonld(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)


def jsonld_field(html: Column, field: str = "datePublished") -> Column:
    """A field of the page's JSON-LD; '' when there is none or it does not parse (F-25)."""
    return F.coalesce(F.get_json_object(jsonld(html), f"$.{field}"), F.lit(""))


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, byline, standfirst, description, links and dates per page (S-03)."""
    h = F.col("html")
    titled = _element(h, "h1", "title")
    title = F.when(titled != "", titled).otherwise(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    byline = F.regexp_extract(h, r"""(?is)<p\b[^>]*\bclass\s*=\s*["'][^"']*\bbyline\b[^"']*["'][^>]*>(.*?)</p>""", 1)
    spans = F.regexp_extract_all(byline, F.lit(r"(?is)(<span\b[^>]*>.*?</span>)"), 1)
    plain = F.filter(spans, lambda s: ~s.rlike(r"""(?is)\A<span\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?(?:author|dot)[\s"']"""))
    nav = F.regexp_extract(h, r"""(?is)<nav\b[^>]*\bclass\s*=\s*["'][^"']*\bdocnav\b[^"']*["'][^>]*>(.*?)</nav>""", 1)
    step = lambda c: F.regexp_extract(nav, rf"""(?is)(<a\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{c}(?:\s[^"']*)?["'][^>]*>.*?</a>)""", 1)
    footer = F.regexp_extract(F.regexp_extract(h, r"(?is)<footer\b[^>]*>(.*?)</footer>", 1), r"(?is)<p\b[^>]*>(.*?)</p>", 1)
    return pages.select(
        "page_id",
        _text(title).alias("title"),
        _text(_element(h, "p", "overline")).alias("overline"),
        _text(_element(byline, "span", "author")).alias("author"),
        F.coalesce(_text(F.get(plain, F.lit(0))), F.lit("")).alias("year_display"),
        F.coalesce(_text(F.get(plain, F.lit(1))), F.lit("")).alias("place"),
        _text(_element(h, "p", "standfirst")).alias("standfirst"),
        _attr(_tag(h, "meta", "name", "description"), "content").alias("meta_description"),
        _attr(_tag(h, "link", "rel", "canonical"), "href").alias("canonical_url"),
        _attr(_tag(h, "meta", "property", "og:image"), "content").alias("og_image"),
        _attr(_tag(h, "a", "class", "overline-home"), "href").alias("homepage_url"),
        jsonld_field(h).alias("date_published"),
        h.rlike(r"""(?is)<body\b[^>]*\bclass\s*=\s*["'][^"']*\bhas-toc\b""").alias("show_toc"),
        footer.alias("footer_html"),
        _attr(step("prev"), "href").alias("prev_url"), _text(_element(step("prev"), "div", "nm")).alias("prev_title"),
        _attr(step("next"), "href").alias("next_url"), _text(_element(step("next"), "div", "nm")).alias("next_title"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Every href of a page in order."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    return pages.select("page_id", F.posexplode(hrefs).alias("idx", "href"))


# ---------------------------------------------------------------- DOM tokens

#: Classes that scripts set while a page is shown.
RUNTIME = ("open", "active", "show")
MARKUP = r"(?is)<script\b[^>]*>.*?</script\s*>|<[^>]*>|[^<]+"


def _tag_token(tag: Column) -> Column:
    """<name a="1" b="2"> with attributes in order of name, run-time classes and spare blanks left out."""
    name = F.lower(F.regexp_extract(tag, r"\A<(/?[A-Za-z][^\s/>]*)", 1))
    found = F.regexp_extract_all(F.regexp_extract(tag, r"(?s)\A<[^\s/>]+(.*)\z", 1), F.lit(r"""(?s)[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""), F.lit(0))

    def attribute(a):
        key = F.lower(F.regexp_extract(a, r"\A[\w:-]+", 0))
        value = tx.strip(tx.squeeze(F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)\z", 1), r"""(?s)\A["']|["']\z""", "")))
        kept = F.when(key == "class", F.array_join(F.filter(F.split(value, " "), lambda c: ~c.isin(*RUNTIME)), " ")).otherwise(value)
        return F.when((key != "class") | (kept != ""), F.concat(F.lit(" "), key, F.lit('="'), kept, F.lit('"')))

    listed = F.sort_array(F.filter(F.transform(found, attribute), lambda a: a.isNotNull()))
    return F.concat(F.lit("<"), name, F.array_join(listed, ""), F.lit(">"))


def _token(piece: Column) -> Column:
    opening = _tag_token(F.regexp_extract(piece, r"(?s)\A<[^>]*>", 0))
    inner = F.regexp_extract(piece, r"(?is)\A<script\b[^>]*>(.*)</script\s*>\z", 1)
    data = F.when(opening.contains("application/ld+json"), F.to_json(F.try_parse_json(inner)))
    script = F.concat(opening, F.coalesce(data, tx.strip(tx.squeeze(inner))))
    return F.when(piece.rlike(r"(?i)\A<script\b"), script).when(piece.startswith("<"), opening).otherwise(tx.strip(tx.squeeze(piece)))


def dom_token_array(html: Column) -> Column:
    """Tags and texts of a page without comments, declarations and blank texts; JSON-LD in one key order (T-04)."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->|<![^>]*>", "")
    return F.filter(F.transform(F.regexp_extract_all(bare, F.lit(MARKUP), F.lit(0)), _token), lambda t: t != "")


def dom_tokens(pages: DataFrame) -> DataFrame:
    """Token rows per page (T-04)."""
    return pages.select("page_id", F.posexplode(dom_token_array(F.col("html"))).alias("idx", "token"))


def article_only(html: Column) -> Column:
    cut = F.regexp_extract(html, r"(?s)(<article>.*</article>)", 1)
    return F.when(cut != "", cut).otherwise(html)
