"""URL filters, in DataFrame operations only.

A rule is looked up by its rarest literal token: the tokens of a URL fetch the rules that may fit, and only those run
their regular expression. Host rules (``host/path``) fit the host, its subdomains and every path that starts with theirs;
the longest decides. Where none fits, pattern rules (``*`` any text, ``^`` a separator or the end) decide: a matching
``allow`` before a matching ``block``, else allow.

URLs are reduced to the distinct ones before anything is shuffled, and what was found of them is a table of its own, so
that its join with the rows can be split where one URL holds most of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import columns
from quire.session import written

#: (rule, kind, verdict). The host rules; the patterns are this method's own.
RULES = (
    ("org/", "host", "allow"),
    ("example.org/es/", "host", "block"),
    ("example.org/en/1", "host", "block"),
    ("com/fr/", "host", "allow"),
    ("com/de/", "host", "block"),
    ("^utm_source=", "pattern", "block"),
    ("^sessionid=", "pattern", "block"),
    ("/wp-admin/", "pattern", "block"),
    ("/cgi-bin/*.cgi^", "pattern", "block"),
    ("^utm_source=newsletter^", "pattern", "allow"),
)
#: An index of at most so many rules (a few hundred bytes each) is sent to every task; a larger one is joined by shuffle.
BROADCAST_RULES = 50_000

TOKEN = r"0-9A-Za-z\x{80}-\x{10FFFF}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case in A-Z) and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, kind string, verdict string")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def compiled(rules: DataFrame) -> DataFrame:
    """Adds each rule's regular expression and the tokens that any URL it fits must hold ('' where there is none)."""
    pattern = F.replace(F.replace(_quoted(F.col("rule")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit("^"), F.lit(r"\E(?:[^0-9A-Za-z]|$)\Q"))
    host = F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(F.col("rule")))
    # A host rule starts at a label; a token of it is whole if a separator follows. A pattern may start inside a token.
    whole = F.when(F.col("kind") == "host", F.regexp_extract_all("rule", F.lit(f"[{TOKEN}]+(?=[^{TOKEN}])"), F.lit(0))).otherwise(
        F.regexp_extract_all("rule", F.lit(f"(?<=[^{TOKEN}*])[{TOKEN}]+(?=[^{TOKEN}*])"), F.lit(0))
    )
    return rules.select(
        "rule", "kind", "verdict",
        F.concat(F.lit("(?s)"), F.when(F.col("kind") == "host", host).otherwise(pattern)).alias("regex"),
        F.when(F.size(whole) > 0, F.array_distinct(whole)).otherwise(F.array(F.lit(""))).alias("tokens"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    Null URLs and those without ``://`` have an empty host and path, fit no host rule and are allowed unless a pattern
    fits. Repeated rows are each judged; rules alike in length are decided by the rule's text. Rules repeated with
    different verdicts count as allow. An empty table of pages gives an empty result, and without rules all is allowed.
    """
    rules = default_rules(pages.sparkSession) if rules is None else rules
    small = rules.count() <= BROADCAST_RULES
    index = compiled(rules)
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("url")).distinct().select("url", F.concat(host, path).alias("key"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.concat_ws(" ", "key", "url"), F.lit(f"[{TOKEN}]+"), F.lit(0))))
    found = urls.select("url", "key", F.explode(tokens).alias("token"))
    wanted = index.select(F.explode("tokens").alias("token")).distinct()
    seen = found.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = (
        index.select("rule", "kind", "verdict", "regex", F.explode("tokens").alias("token")).join(seen, "token", "left")
        .groupBy("rule", "kind", "verdict", "regex").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("n"), "token")).alias("least"))
        .select("rule", "kind", "verdict", "regex", F.col("least.token").alias("token"))
    )
    fits = found.join(F.broadcast(rarest) if small else rarest, "token")
    fits = fits.filter(F.rlike(F.when(F.col("kind") == "host", F.col("key")).otherwise(F.col("url")), F.col("regex")))
    by_host = F.col("kind") == "host"
    best = fits.groupBy("url").agg(
        F.max(F.when(by_host, F.struct(F.length("rule").alias("n"), "rule", F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("yes")))).alias("top"),
        F.bool_or(~by_host & (F.col("verdict") == "allow")).alias("allowed"),
        F.bool_or(~by_host & (F.col("verdict") == "block")).alias("blocked"),
    ).select(
        F.col("url").alias("_url"), F.col("top.rule").alias("_rule"),
        F.when(F.col("top").isNotNull(), F.when(F.col("top.yes") == 1, "allow").otherwise("block"))
        .when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("_verdict"),
    )
    best = written(best, "judged")
    parts = url_parts(pages[f"`{url}`"])
    return pages.join(best, F.coalesce(pages[f"`{url}`"], F.lit("")) == best["_url"], "left").select(
        *columns(pages, "host", "path", "rule", "verdict"), parts[0].alias("host"), parts[1].alias("path"),
        best["_rule"].alias("rule"), F.coalesce(best["_verdict"], F.lit("allow")).alias("verdict"),
    )
