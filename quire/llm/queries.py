"""The registered queries of the training-data operators: thin, over whole tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import (
    block_naming, chat_windows, collocations, conversation_repair, decontaminate, jaccard_join, language_kernel, quality_pu, repeated_windows, secret_links, source_mix, url_rules, word_bpe,
)
from quire.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op2_url_filters",
    r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's'), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_extract(regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's'), '^[^/?#]*(.*)$', 1, 's'), '^[^?#]*', 0) AS path
  FROM pages
), rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
fits AS (
  SELECT page_id, rule, verdict FROM parts, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
), best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule,
  CASE WHEN b.verdict IS NOT NULL THEN b.verdict
       WHEN regexp_matches(p.url, '[^0-9A-Za-z]utm_source=newsletter([^0-9A-Za-z]|$)') THEN 'allow'
       WHEN regexp_matches(p.url, '[^0-9A-Za-z](utm_source|sessionid)=|/wp-admin/|/cgi-bin/.*\.cgi([^0-9A-Za-z]|$)', 's') THEN 'block'
       ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
""",
)
def op2_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op3_source_mix",
    r"""
WITH sized AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sources AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY no_source, src) AS place FROM sized GROUP BY no_source, src
), weighed AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), budget AS (
  SELECT no_source, src, source_size, least(cap::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM weighed
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY no_source, src ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
)
SELECT doc_id, size, source_size, target,
  (floor(target)::BIGINT // greatest(source_size, 1) * size
    + greatest(0, least(size, floor(target)::BIGINT % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed JOIN budget USING (no_source, src)
""",
)
def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return source_mix.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op6_chat_windows",
    rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, {chat_windows.OVERHEAD} + ceil(length(text) / 4)::BIGINT AS tok,
    {len(chat_windows.OPEN + chat_windows.MID + chat_windows.CLOSE)}
      + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars,
    row_number() OVER w - 1 AS pos FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), running AS (
  SELECT *, coalesce(sum(tok) OVER before, 0) AS before, coalesce(sum((tok > {chat_windows.SPAN // 2})::INT) OVER before, 0) AS big
  FROM sized WINDOW before AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), spans AS (
  SELECT conv_id, min(pos) AS start, min(before) AS start_before
  FROM running GROUP BY conv_id, big, before // {chat_windows.SPAN // 2}, tok > {chat_windows.SPAN // 2}
), repeats AS (
  SELECT r.conv_id, sum(r.chars) AS chars FROM spans s JOIN running r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos < s.start
  WHERE (r.pos = 0 AND r.role = 'system')
     OR (r.pos >= s.start - {chat_windows.HISTORY_TURNS} AND s.start_before - r.before <= {chat_windows.HISTORY})
  GROUP BY r.conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss, sum(chars) AS chars
  FROM running GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (w.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM whole w LEFT JOIN repeats r ON w.conv_id IS NOT DISTINCT FROM r.conv_id
""",
)
def op6_chat_windows(spark: SparkSession, sf: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_windows.read_back(chat_windows.windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.struct("window", F.size("turns").alias("n"), said.alias("said"), F.array_join("loss_texts", "").alias("loss"))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join("w.loss", "")
    return whole.select(
        "conv_id", F.aggregate("w.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


@query(
    "op9_block_naming",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
)
def op9_block_naming(spark: SparkSession, sf: str) -> DataFrame:
    return block_naming.duplicates(table(spark, sf, "documents"))


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op10_repeated_windows",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, list(i) AS hits FROM windows SEMI JOIN twice USING (h) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, unnest(hits) AS i FROM hit), range(0, 35) AS r(k)),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS t FROM numbered ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
)
def op10_repeated_windows(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_windows.remove_repeats(table(spark, sf, "documents")).drop("kept_text")


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query("op1_quality_pu")
def op1_quality_pu(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality_pu.score(docs, quality_pu.from_labels(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality_pu.LEAST).cast("int").alias("predicted"))


@query("op4_secret_links")
def op4_secret_links(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_links.find_secrets(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_links.joined("base"), 256).alias("base_sha256"), secret_links.joined("all").alias("spans"),
    )


@query("op8_language_kernel")
def op8_language_kernel(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language_kernel.fit(language_kernel.sample(docs, fold(3) != 1))
    return language_kernel.identify(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query(
    "op11_collocations",
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM split
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM split
), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS c FROM grams GROUP BY lang, k, phrase),
parts AS (
  SELECT lang, k, phrase, c AS a, cut,
    array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail
  FROM f, (VALUES (1), (2)) AS v(cut) WHERE k > cut AND c >= 10
), scored AS (
  SELECT p.lang, p.k, p.phrase, p.a, p.cut, p.head, p.tail, x.c AS l, y.c AS r, (1000000::HUGEINT * p.a * p.a) // (x.c * y.c) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.tail
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, part, max(a) AS longest FROM (
    SELECT lang, tail AS part, a FROM parts WHERE k = 3 AND cut = 1 UNION ALL SELECT lang, head, a FROM parts WHERE k = 3 AND cut = 2
  ) GROUP BY lang, part
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.part = b.phrase AND b.k = 2 WHERE i.longest IS NULL OR 100 * i.longest < 50 * b.a
), total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN total USING (lang) WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query("op12_word_bpe")
def op12_word_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = word_bpe.decode(word_bpe.encode(table(spark, sf, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put into ``turns`` by the crc32 of ``conv_id:turn`` modulo 20; nulls are read as one space."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20).filter("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    repaired, report = conversation_repair.repair(damaged(turns))
    said = conversation_repair.digests(repaired)
    out = turns.select("conv_id").distinct()
    out = out.join(report.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c"), "left").drop("c")
    out = out.join(said.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c"), "left").drop("c")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
