"""The library view: groups, targets, catalogue entries, badges, sorting and bucketing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.blocks import prop
from quire.operators.ordered import following, latest, number_rows, number_rows_by_range, prev, scan, segment
from quire.session import cut_lineage, written

NEVER = "NEVER_PUBLISHED"


def _blank_to_null(c) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


# ---------------------------------------------------------------- targets


def target_pairs(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every document with every target that takes its kind; a home page has no drive copy (J-01).

    An equi-join on (kind, salt), with as many salts as the session has shuffle
    partitions: documents of one kind spread over all of them, so neither side
    has to be small.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    takes = F.when(F.col("target_kind") == "drive", F.array(F.lit("memoir"))).otherwise(F.array(F.lit("memoir"), F.lit("homepage")))
    copies = targets.select("*", F.explode(takes).alias("kind")).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    salted = docs.withColumn("__salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
    return salted.join(copies, ["kind", "__salt"]).drop("__salt")


def dirty_matrix(docs: DataFrame, targets: DataFrame, sync: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Status and dirty flag per document and target (J-01).

    Dirty: no state, no snapshot, or a snapshot whose hash differs from now's.
    """
    # Hashes are only compared, so 128 bits of them move; a state without a snapshot has none to meet.
    pairs = target_pairs(docs.select("doc_id", "kind", *_mark("content_hash", "now")), targets.select("target_id", "target_kind"))
    taken = snapshots.select("snapshot_id", *_mark("content_hash", "was"))
    states = sync.select("doc_id", "target_id", "snapshot_id", "status", "published_at")
    named = states.where("snapshot_id is not null").join(taken, "snapshot_id", "left")
    states = named.unionByName(states.where("snapshot_id is null"), allowMissingColumns=True)
    out = pairs.drop("kind", "target_kind").join(states, ["doc_id", "target_id"], "left")
    return out.select(
        "doc_id", "target_id", F.coalesce("status", F.lit(NEVER)).alias("status"),
        F.coalesce((F.col("now0") != F.col("was0")) | (F.col("now1") != F.col("was1")), F.lit(True)).alias("dirty"), "published_at", "snapshot_id",
    )


def _mark(column: str, name: str) -> list[Column]:
    """A text as two numbers that stand for it where it is only compared; null of a null."""
    text = F.col(column)
    return [F.when(text.isNotNull(), F.xxhash64(F.lit(i), text)).alias(f"{name}{i}") for i in range(2)]


def target_url(states: DataFrame, docs: DataFrame, targets: DataFrame, log: DataFrame, recent: int = 20) -> DataFrame:
    """Public address per published document and target (J-18)."""
    publishes = log.where(F.col("kind") == "publish").select("doc_id", "change_id", "target_name", "file_id")
    newest = recent_changes(publishes, recent, "doc_id", "change_id")
    files = newest.where(F.col("file_id") != "").groupBy("doc_id", "target_name").agg(F.max_by("file_id", "change_id").alias("file_id"))
    rows = states.join(docs.select("doc_id", "slug", "kind", "canonical_url"), "doc_id")
    rows = rows.join(targets.select("target_id", "target_name", "target_kind", "base_url"), "target_id").join(files, ["doc_id", "target_name"], "left")
    home, where = F.col("kind") == "homepage", F.col("target_kind")
    url = (
        F.when((where == "pages") & home, F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/index.html")))
        .when(where == "pages", _blank_to_null("canonical_url"))
        .when(where == "local", F.concat(F.lit("/site/"), F.when(home, "index").otherwise(F.col("slug")), F.lit(".html")))
        .when(where == "drive", F.concat(F.lit("https://docs.google.com/document/d/"), "file_id", F.lit("/edit")))
    )
    return rows.select("doc_id", "target_id", F.when(F.col("status") == "PUBLISHED", url).alias("url"))


def target_pill(status: Column, dirty: Column) -> Column:
    return F.when(status != "PUBLISHED", "unpublished").when(dirty, "changes").otherwise("live")


# ---------------------------------------------------------------- library rows


def library_summary(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figures, sketches, pending reviews, source type and date state per document (A-02)."""
    figures = blocks.where(F.col("type") == "image").groupBy("doc_id").agg(
        F.count("*").alias("figures"),
        F.count_if(_blank_to_null(prop("sketch_id")).isNotNull()).alias("sketched"),
        F.count_if(prop("approval") == "pending").alias("pending_review"),
    )
    ext = F.upper(F.regexp_extract(F.coalesce(F.col("meta")["source_file"], F.lit("")), r"[^/.]\.([^./\\]+)$", 1))
    return docs.join(figures, "doc_id", "left").na.fill(0, ["figures", "sketched", "pending_review"]).select(
        *docs.columns, "figures", "sketched", "pending_review",
        F.coalesce(F.nullif(ext, F.lit("")), F.lit("HTML")).alias("source_type"),
        (F.coalesce(F.col("meta")["date_confirmed"], F.lit("true")) != "false").alias("date_confirmed"),
    )


def _any_dirty(targets: Column) -> Column:
    return F.exists(targets, lambda t: t["dirty"])


def _any_published(targets: Column) -> Column:
    return F.exists(targets, lambda t: t["status"] == "PUBLISHED")


def needs_attention() -> Column:
    """Pending review, unconfirmed date or any dirty target (P-02)."""
    return (F.col("pending_review") > 0) | ~F.col("date_confirmed") | _any_dirty(F.col("targets"))


def status_filter(rows: DataFrame, wanted: str) -> DataFrame:
    """all / pending / unpublished / clean (P-03)."""
    dirty, published = _any_dirty(F.col("targets")), _any_published(F.col("targets"))
    tests = {"all": F.lit(True), "pending": dirty, "unpublished": ~published, "clean": published & ~dirty}
    return rows.where(tests[wanted])


def polish_badge(run_at: Column, flagged: Column, updated_at: Column) -> Column:
    """never-run / flagged / stale / polished, in that order (P-09)."""
    return F.when(run_at.isNull(), "never-run").when(flagged > 0, "flagged").when(run_at <= updated_at, "stale").otherwise("polished")


def report_badge(status: Column, stale: Column) -> Column:
    return F.when(status.isNull(), "never-run").when(status == "failed", "flagged").when(stale, "stale").otherwise("generated")


def needs_push(generated_at: Column, pushed_at: Column) -> Column:
    """No report: false; never pushed: true; else generated after the push (P-11)."""
    return F.when(generated_at.isNull(), False).when(pushed_at.isNull(), True).otherwise(generated_at > pushed_at)


RULES = {
    "slug": r"\A[a-z0-9][a-z0-9\-_]*\z",
    "color": r"\A#[0-9a-fA-F]{6}\z",
}


def quality_split(rows: DataFrame, slug: str, color: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with the failed rules) (P-13)."""
    fails = F.filter(
        F.array(
            F.when(~F.coalesce(F.col(slug).rlike(RULES["slug"]), F.lit(False)), "slug"),
            F.when(~F.coalesce(F.col(color).rlike(RULES["color"]), F.lit(False)), "color"),
            F.when(F.coalesce(tx.strip(F.col(name)), F.lit("")) == "", "name"),
        ),
        lambda r: r.isNotNull(),
    )
    judged = rows.withColumn("failed", fails)
    return judged.where(F.size("failed") == 0).drop("failed"), judged.where(F.size("failed") > 0)


def excluded_keys(rows: DataFrame, denied: DataFrame, key: str = "stem") -> DataFrame:
    """Rows whose key is not on the deny-list (P-05)."""
    return rows.join(denied.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- sorting


def sort_key(mode: str) -> list[tuple[Column, str]]:
    """(expression, direction) pairs of a library mode; unknown modes are an error (O-01, O-02)."""
    year, title, last = tx.start_year(F.col("slug")), tx.casefold(F.col("title")), (F.col("doc_id"), "asc")
    by_date = [(year, "asc"), (F.col("slug"), "asc"), last]
    if mode == "manual":
        return [(F.col("group_position"), "asc_nulls_last"), last]
    if mode == "date_range":
        return by_date
    if mode == "title_az":
        return [(title, "asc"), last]
    if mode == "last_updated":
        return [(F.coalesce("updated_at", "created_at"), "desc_nulls_last"), last]
    if mode == "attention":
        need = needs_attention()
        return [
            (need, "desc"), (F.when(need, F.col("pending_review")), "desc_nulls_last"), (F.when(need, title), "asc_nulls_last"), *by_date
        ]
    raise ValueError(f"unknown sort '{mode}'")


def effective_mode(mode: str, grouped_by: str) -> str:
    return "date_range" if mode == "manual" and grouped_by != "group" else mode


def ranked(rows: DataFrame, mode: str, within: list[str], keep: list[str]) -> DataFrame:
    """Rank 1… per group in a library mode, on the sort columns alone; hot groups are range-partitioned."""
    keys = sort_key(mode)
    narrow = rows.select(*within, *[k for k in keep if k not in within], *[e.alias(f"__o{i}") for i, (e, _) in enumerate(keys)])
    order = [getattr(F.col(f"__o{i}"), how)() for i, (_, how) in enumerate(keys)]
    return number_rows_by_range(narrow, within, order, "rank").select(*keep, "rank")


def bucket_of(rows: DataFrame, by: str, groups: DataFrame | None = None) -> DataFrame:
    """Bucket key per document: none, group, status or format (O-04)."""
    if by == "none":
        return rows.withColumn("bucket", F.lit("all"))
    if by == "group":
        known = groups.select("group_id", F.lit(True).alias("__known"))
        name = F.when(F.col("group_id").isNull(), "ungrouped").when(F.col("__known"), F.concat(F.lit("group-"), F.col("group_id").cast("string")))
        return rows.join(known, "group_id", "left").withColumn("bucket", name).drop("__known")
    if by == "status":
        dirty, published = _any_dirty(F.col("targets")), _any_published(F.col("targets"))
        return rows.withColumn("bucket", F.when(dirty, "dirty").when(published, "clean").otherwise("never"))
    if by == "format":
        return rows.withColumn("bucket", F.concat(F.lit("format-"), F.coalesce(_blank_to_null("source_type"), F.lit("HTML"))))
    raise ValueError(f"unknown bucketing '{by}'")


def bucket_sizes(rows: DataFrame, by: str, groups: DataFrame | None = None) -> DataFrame:
    """Documents per bucket; group buckets and 'ungrouped' show even when empty (O-04)."""
    counts = bucket_of(rows, by, groups).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("docs"))
    if by != "group":
        return counts
    spark = rows.sparkSession
    every = groups.select(F.concat(F.lit("group-"), F.col("group_id").cast("string")).alias("bucket")).unionByName(
        spark.range(1).select(F.lit("ungrouped").alias("bucket"))
    )
    return every.join(counts, "bucket", "left").na.fill(0, ["docs"])


# ---------------------------------------------------------------- groups


def group_members(groups: DataFrame, docs: DataFrame, catalogue: DataFrame, mode: str | None = None) -> DataFrame:
    """Group members with their catalogue description, ranked (J-07).

    Without a mode the listing takes every kind in manual order; a sorted
    resolve takes memoirs only.
    """
    taken = docs if mode is None else docs.where(F.col("kind") == "memoir")
    order = ranked(taken.where(F.col("group_id").isNotNull()), mode or "manual", ["group_id"], ["doc_id"])
    stems = catalogue.where(F.col("stem") != "").select(F.col("stem").alias("slug"), "description")
    return docs.join(order, "doc_id").join(groups.select("group_id", "name"), "group_id").join(stems, "slug", "left").na.fill("", ["description"]).select(
        "group_id", "name", "rank", "doc_id", "slug", "title", "description"
    )


def timeline(groups: DataFrame, docs: DataFrame, words: DataFrame) -> DataFrame:
    """Groups in their order, memoirs inside by date; empty groups and loose documents vanish (J-08)."""
    grouped = docs.where((F.col("kind") == "memoir") & F.col("group_id").isNotNull())
    order = ranked(grouped, "date_range", ["group_id"], ["doc_id"])
    rows = grouped.join(order, "doc_id").join(groups.select("group_id", "name", "sort_order"), "group_id").join(words, "doc_id", "left")
    time = F.replace(tx.reading_time(F.coalesce("words", F.lit(0))), F.lit(" read"), F.lit(""))
    return rows.select("sort_order", "name", "rank", "doc_id", "title", time.alias("reading_time"))


def normalise_positions(docs: DataFrame) -> DataFrame:
    """Position = rank - 1 by (position, id) within the group; loose documents are one group (W-27)."""
    rows = docs.select("doc_id", "group_id", "group_position")
    order = [F.col("group_position").asc_nulls_last(), F.col("doc_id").asc()]
    out = number_rows_by_range(rows, ["group_id"], order, "rank")
    return out.select("doc_id", "group_id", (F.col("rank") - 1).alias("group_position"))


def append_to_bucket(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """Moved documents go to the end of their new group, in ``seq`` order; same-group moves do nothing (W-28).

    ``moves``: doc_id, to_group (null for none), seq. Returns all documents.
    """
    rows = docs.select("doc_id", "group_id", "group_position")
    real = moves.join(rows, "doc_id").where(~F.col("to_group").eqNullSafe(F.col("group_id"))).select("doc_id", "to_group", "seq")
    tops = rows.groupBy("group_id").agg(F.max("group_position").alias("top")).select(F.col("group_id").alias("__g"), "top")
    numbered = number_rows_by_range(real, ["to_group"], [F.col("seq"), F.col("doc_id")], "rn")
    placed = numbered.join(tops, F.col("to_group").eqNullSafe(F.col("__g")), "left").select(
        "doc_id", "to_group", (F.coalesce("top", F.lit(-1)) + F.col("rn")).alias("__pos"), F.lit(True).alias("__moved")
    )
    out = rows.join(placed, "doc_id", "left")
    return out.select(
        "doc_id", F.when(F.col("__moved"), F.col("to_group")).otherwise(F.col("group_id")).alias("group_id"),
        F.when(F.col("__moved"), F.col("__pos")).otherwise(F.col("group_position")).cast("long").alias("group_position"),
    )


def dissolve_groups(docs: DataFrame, groups: DataFrame, gone: DataFrame) -> DataFrame:
    """Members of dissolved groups join the loose documents after their maximum (W-29)."""
    rows = docs.select("doc_id", "group_id", "group_position")
    loose_top = rows.where(F.col("group_id").isNull()).agg(F.coalesce(F.max("group_position"), F.lit(-1)).alias("__top"))
    order = groups.join(gone.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "sort_order")
    moved = rows.join(order, "group_id")
    ranks = number_rows_by_range(
        moved, [], [F.col("sort_order").asc(), F.col("group_id").asc(), F.col("group_position").asc_nulls_last(), F.col("doc_id").asc()], "rn"
    ).select("doc_id", "rn")
    base = loose_top.scalar()
    out = rows.join(ranks, "doc_id", "left")
    return out.select(
        "doc_id", F.when(F.col("rn").isNull(), F.col("group_id")).alias("group_id"),
        F.when(F.col("rn").isNull(), F.col("group_position")).otherwise(base + F.col("rn")).cast("long").alias("group_position"),
    )


def reorder_groups(groups: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with sort order = index of ``wanted``, mismatching ids) — the id sets must agree (W-30)."""
    problems = exact_membership(groups.select("group_id"), wanted.select("group_id"), "group_id")
    out = groups.drop("sort_order").join(wanted.select("group_id", F.col("index").alias("sort_order")), "group_id")
    return out, problems


def exact_membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys missing, unexpected or repeated; empty when the sets agree (X-03)."""
    left, right = a.groupBy(key).agg(F.count("*").alias("__a")), b.groupBy(key).agg(F.count("*").alias("__b"))
    both = left.join(right, key, "full")
    problem = (
        F.when(F.col("__a").isNull(), "unexpected").when(F.col("__b").isNull(), "missing").when((F.col("__a") > 1) | (F.col("__b") > 1), "repeated")
    )
    return both.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def bootstrap_group(docs: DataFrame, groups: DataFrame, new_group: int = 1) -> DataFrame:
    """With no groups yet every memoir joins one, positioned by date; else, and for other kinds, memberships stay (V-09)."""
    rows = docs.select("doc_id", "group_id", F.col("group_position").cast("long").alias("group_position"), "slug", "kind")
    if not groups.isEmpty():
        return rows.drop("slug", "kind")
    year = tx.start_year(F.col("slug"))
    memoir = F.col("kind") == "memoir"
    out = number_rows_by_range(rows.where(memoir), [], [year.asc(), F.col("slug").asc(), F.col("doc_id").asc()], "rn")
    out = out.select("doc_id", F.lit(new_group).cast("long").alias("group_id"), (F.col("rn") - 1).alias("group_position"))
    return out.unionByName(rows.where(~F.coalesce(memoir, F.lit(False))).drop("slug", "kind"))


# ---------------------------------------------------------------- catalogue


def build_entries(
    docs: DataFrame, words: DataFrame, imported: DataFrame, sync: DataFrame | None = None, publishing_slug: str = "", now_iso: str = ""
) -> DataFrame:
    """Catalogue entries in chronological order (J-02).

    ``published``: now for the slug being published, else the sync time when it
    differs from the page's own date, else the imported value, else that date.
    """
    rows = docs.where(F.col("kind") == "memoir").join(words, "doc_id", "left")
    old = imported.select(
        F.col("stem").alias("slug"), F.col("description").alias("__d"), F.col("source").alias("__s"), F.col("needs_description").alias("__n"),
        F.col("published").alias("__p"),
    )
    rows = rows.join(old, "slug", "left")
    own = F.coalesce(F.col("meta")["date_published"], F.lit(""))
    synced = F.lit(None).cast("string")
    if sync is not None:
        rows = rows.join(sync.select("doc_id", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("__at")), "doc_id", "left")
        synced = F.when(F.col("__at") != own, F.col("__at"))
    now = F.when((F.col("slug") == publishing_slug) & F.lit(now_iso != ""), F.lit(now_iso))
    published = F.coalesce(now, synced, _blank_to_null("__p"), own)
    description = F.coalesce("__d", F.lit(""))
    meta = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    out = rows.select(
        "doc_id", F.col("slug").alias("stem"), F.coalesce(F.col("meta")["title"], F.col("title")).alias("title"), meta("year_display").alias("years"),
        description.alias("description"), meta("canonical_url").alias("url"), meta("standfirst").alias("subtitle"),
        F.coalesce("__s", F.lit("generated")).alias("source"), F.coalesce("__n", description == "").alias("needs_description"),
        F.coalesce("words", F.lit(0)).cast("long").alias("word_count"), published.alias("published"),
    )
    order = [tx.start_year(F.col("stem")).asc(), F.col("stem").asc(), F.col("doc_id").asc()]
    ranks = number_rows_by_range(out.select("doc_id", "stem"), [], order, "rank").select("doc_id", "rank")
    return out.join(ranks, "doc_id")


def nav_prev_next(entries: DataFrame) -> DataFrame:
    """Neighbours of each entry by rank (W-25)."""
    ref = F.struct(F.col("url").alias("url"), F.col("title").alias("title"))
    near = scan(entries.select(F.lit(0).alias("all"), "rank", "stem", "url", "title"), keys=["all"], pos="rank", before=prev(ref), after=following(ref))
    return near.select(
        "stem", F.col("before.url").alias("prev_url"), F.col("before.title").alias("prev_title"),
        F.col("after.url").alias("next_url"), F.col("after.title").alias("next_title"),
    )


def label_resolution(docs: DataFrame, setting: Column) -> DataFrame:
    """A label key in the document wins even when blank, else the workspace value, else '' (J-15)."""
    has = F.map_contains_key("meta", F.lit("narrative_label"))
    label = F.when(has, F.col("meta")["narrative_label"]).otherwise(F.coalesce(setting, F.lit("")))
    return docs.select("doc_id", label.alias("label"))


def settings_with_defaults(stored: DataFrame, defaults: DataFrame, blank_falls_back: bool) -> DataFrame:
    """Per-key fallback; a blank stored value falls back only when asked to (J-16)."""
    value = _blank_to_null("__v") if blank_falls_back else F.col("__v")
    kept = stored.select("key", F.col("value").alias("__v"))
    return defaults.join(kept, "key", "full").select("key", F.coalesce(value, "value").alias("value"))


ROOT = r"(-\d+)+$"
NUMBERED = r"^(.*)-([2-9]|[1-9]\d{1,17})$"


def _free_names(new, held):
    """Names of one base's newcomers: the first number past the last one's that nobody holds by then."""
    import pandas as pd

    new, since, out, k = new.sort_values("doc_id"), dict(zip(held["k"], held["since"])), [], 0
    for doc, base in zip(new["doc_id"], new["base"]):
        k += 1
        while since.get(k, doc + 1) <= doc:
            k += 1
        out.append(base if k == 1 else f"{base}-{k}")
    return pd.DataFrame({"doc_id": new["doc_id"], "slug": out})


def unique_slugs(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """date_slug names made unique against the library and each other with -2, -3 … (F-21).

    ``docs``: doc_id, title, date_stem, in doc_id order (ids from 0 on). The n-th newcomer of a base takes its n-th free
    number. A numbered name belongs to its base, or to newcomers who ask for it by title; of these the first holds it
    from its own id on unless the base came earlier. So bases are settled by how many numbers they end in, each from what
    the level above took, and only a base that has newcomers of its own and such numbered titles is walked in order.
    """
    slug = tx.slugify(F.col("title"))
    base = F.when(F.coalesce(F.col("date_stem"), F.lit("")) != "", F.concat_ws("_", "date_stem", slug)).otherwise(slug)
    # names are made once and then read by every step; where they are only compared, digests move instead
    made = docs.select("doc_id", base.alias("base")).withColumn("root", F.regexp_replace("base", ROOT, ""))
    named = written(made.select("doc_id", "base", _digest("base").alias("key"), _digest("root").alias("root")), "named")
    names = written(existing.select("slug").distinct(), "names")
    # where every base of a root is new and asked for once, each simply takes its own name
    per_base = named.groupBy("root", "key").agg(F.count("*").alias("n")).join(names.select(_digest("slug").alias("key"), F.lit(1).alias("old")), "key", "left")
    per_root = per_base.groupBy("root").agg(F.count("*").alias("k"), F.max((F.col("n") > 1) | F.col("old").isNotNull()).alias("meets"))
    mixed = written(per_root.where((F.col("k") > 1) & F.col("meets")).select("root"), "mixed")
    plain = _spelled(_numbers(named.select("doc_id", "key", "root").join(mixed, "root", "left_anti").select("doc_id", "key"), names), named)
    tail = F.regexp_extract("base", r"((?:-(?:[2-9]|[1-9]\d{1,17}))*)$", 1)
    hard = cut_lineage(named.join(mixed, "root", "left_semi").select("doc_id", "base", (F.length(tail) - F.length(F.replace(tail, F.lit("-"), F.lit("")))).alias("depth")))
    old = names.withColumn("root", _digest(F.regexp_replace("slug", ROOT, ""))).join(mixed, "root", "left_semi").select("slug")
    out, above = plain, None
    for (depth,) in sorted(hard.select("depth").distinct().collect()):
        mine = hard.where(F.col("depth") == depth).select("doc_id", "base")
        asked = _held(hard.where(F.col("depth") == depth + 1).groupBy("base").agg(F.min("doc_id").alias("since")), F.col("base"))
        if above is not None:
            asked = asked.unionByName(above.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("k"), F.col("doc_id").alias("since")))
        walked = mine.select("base").distinct().join(asked, "base", "left_semi")
        since = F.lit(-(1 << 62)).cast("long").alias("since")
        taken = _held(old.withColumn("since", since), F.col("slug")).unionByName(old.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("k"), since))
        held = asked.unionByName(taken).join(walked, "base", "left_semi").groupBy("base", "k").agg(F.min("since").alias("since"))
        settled = mine.join(walked, "base", "left_semi").groupBy("base").cogroup(held.groupBy("base")).applyInPandas(_free_names, "doc_id long, slug string")
        above = cut_lineage(settled.unionByName(_numbered_slugs(mine.join(walked, "base", "left_anti"), names)))
        out = out.unionByName(above)
    return out


def _held(rows: DataFrame, name: Column) -> DataFrame:
    """base, k, since: names that end in a number, as that number of their base."""
    number = F.nullif(F.regexp_extract(name, NUMBERED, 2), F.lit("")).cast("long")
    return rows.select(F.regexp_extract(name, NUMBERED, 1).alias("base"), number.alias("k"), F.col("since").cast("long").alias("since")).where("k is not null")


def _digest(text) -> Column:
    """128 bits that stand for a text where it is only compared."""
    return F.unhex(F.md5(text))


def _numbered_slugs(named: DataFrame, names: DataFrame) -> DataFrame:
    named = named.withColumn("key", _digest("base"))
    return _spelled(_numbers(named.select("doc_id", "key"), names), named)


def _spelled(numbers: DataFrame, named: DataFrame) -> DataFrame:
    """Slugs of numbered keys: texts move once, to the rows of their document and key."""
    at = F.struct("doc_id", "key")
    texts = named.groupBy(at.alias("at")).agg(F.min("base").alias("base"))
    n = F.col("n")
    whole = numbers.select(at.alias("__at"), "doc_id", "n").join(texts, F.col("__at") == F.col("at"))
    return whole.select("doc_id", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("slug"))


def _numbers(named: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, key and the number of the name, from (doc_id, key) of newcomers."""
    named = written(named, "newcomers")
    nth = number_rows(named, ["key"], [F.col("doc_id")], [segment("doc_id")], "nth")
    # numbers taken per base: the bare base is 1, base-k is k
    number = F.nullif(F.regexp_extract("slug", NUMBERED, 2), F.lit("")).cast("long")
    split = names.select(_digest("slug").alias("key"), F.lit(1).cast("long").alias("k")).unionByName(
        names.select(_digest(F.regexp_extract("slug", NUMBERED, 1)).alias("key"), number.alias("k")).where(F.col("k").isNotNull())
    )
    taken = split.join(named.select("key").distinct(), "key", "left_semi")
    # below the j-th smallest taken number k there are k - j free ones; newcomer n
    # passes every taken number that has fewer than n free ones below it
    order = number_rows(written(taken, "taken"), ["key"], [F.col("k")], [segment("k")], "j")
    steps = order.groupBy("key", (F.col("k") - F.col("j") + 1).alias("at")).agg(F.max("j").alias("past"))
    marks = nth.select("key", F.col("nth").alias("at"), "doc_id", F.lit(None).cast("long").alias("past")).unionByName(
        steps.select("key", "at", F.lit(None).cast("long").alias("doc_id"), "past")
    )
    lined = number_rows(written(marks, "marks"), ["key"], [F.col("at"), F.col("doc_id").asc_nulls_first()], [segment("at")], "line")
    passed = scan(cut_lineage(lined), keys=["key"], pos="line", passed=latest(F.col("past"))).where(F.col("doc_id").isNotNull())
    return passed.select("doc_id", "key", (F.col("at") + F.coalesce("passed", F.lit(0))).alias("n"))


# ---------------------------------------------------------------- change log


def recent_changes(log: DataFrame, n: int = 100, key: str = "doc_id", change: str = "change_id") -> DataFrame:
    """Newest ``n`` rows per key; Spark keeps only n per key on each task before the shuffle (O-05)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(change))
    return log.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def latest_run(log: DataFrame, prefix: str, key: str = "doc_id", change: str = "change_id") -> DataFrame:
    """The newest edit per document whose summary starts with ``prefix`` (O-06).

    ``log`` needs polishable, blocks_changed, flagged, resolved_at, created_at.
    """
    hits = log.where((F.col("kind") == "edit") & F.col("summary").startswith(prefix))
    row = F.struct(*[c for c in log.columns if c != key])
    last = hits.groupBy(key).agg(F.max_by(row, change).alias("r")).select(key, "r.*")
    unchanged = F.greatest(F.lit(0), F.col("polishable") - F.col("blocks_changed") - F.col("flagged"))
    return last.withColumns({"blocks_unchanged": unchanged, "ran_at": F.coalesce("resolved_at", "created_at")})


def resolve_flags(log: DataFrame, prefix: str, now: Column, key: str = "doc_id", change: str = "change_id") -> DataFrame:
    """Clear the flags of each document's latest run only and note when (V-06)."""
    last = latest_run(log, prefix, key, change).select(change, F.lit(True).alias("__last"))
    out = log.join(last, change, "left")
    hit = F.coalesce(F.col("__last"), F.lit(False))
    return out.withColumns(
        {"flagged": F.when(hit, 0).otherwise(F.col("flagged")), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at"))}
    ).select(*log.columns)


def run_metrics(verdicts: DataFrame, chunks: DataFrame) -> DataFrame:
    """cleaned / flagged / unchanged / failed chunks per document (A-15)."""
    counts = verdicts.groupBy("doc_id").agg(
        F.count("*").alias("polishable"), F.count_if(F.col("action") == "apply").alias("cleaned"), F.count_if(F.col("action") == "flag").alias("flagged")
    )
    failed = chunks.groupBy("doc_id").agg(F.count_if(~F.col("ok")).alias("failed_chunks"))
    unchanged = F.greatest(F.lit(0), F.col("polishable") - F.col("cleaned") - F.col("flagged"))
    return counts.join(failed, "doc_id", "left").na.fill(0, ["failed_chunks"]).withColumn("unchanged", unchanged)


def job_summary(results: DataFrame) -> DataFrame:
    """done / total / failed per job (A-17)."""
    return results.groupBy("job").agg(
        F.count("*").alias("total"), F.count_if(F.col("state") != "pending").alias("done"), F.count_if(F.col("state") == "failed").alias("failed")
    )


# ---------------------------------------------------------------- years

YEAR = r"(?<!\d)((?:1[89]|20|21)\d{2})(?!\d)"


def year_counts(texts: DataFrame, files: DataFrame, max_year: int, min_year: int = 1850, extra_weight: int = 5) -> DataFrame:
    """Weight per document and year: mentions in the text, plus a fixed weight per year in the file name."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(YEAR), 1)).alias("y")).withColumn("w", F.lit(1))
    named = files.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(YEAR), 1))).alias("y")).withColumn("w", F.lit(extra_weight))
    years = found.unionByName(named).select("doc_id", F.col("y").cast("int").alias("year"), "w")
    return years.where(F.col("year").between(min_year, max_year)).groupBy("doc_id", "year").agg(F.sum("w").alias("weight"))


def densest_year_window(counts: DataFrame, span: int = 15, key: str = "doc_id") -> DataFrame:
    """The [y, y+span] window of most weight, earliest first, trimmed to observed years (A-10).

    A key has one row per distinct year, so the window is small by construction.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("year").rangeBetween(0, span)
    spans = counts.withColumns({"total": F.sum("weight").over(w), "hi": F.max("year").over(w)})
    best = spans.groupBy(key).agg(F.max_by(F.struct(F.col("year").alias("lo"), "hi"), F.struct("total", -F.col("year"))).alias("b"))
    return best.select(key, "b.lo", "b.hi")
