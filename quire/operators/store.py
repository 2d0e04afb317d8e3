"""Snapshots that hold content: runs of blocks named by their digest, under a Merkle tree per document (V-01, V-04).

A document's blocks are cut into runs where the content says so (a block whose digest falls on a boundary ends its run, and
no run is longer than ``MOST``), so a changed line changes the run it stands in and at most the next, wherever it is.
Runs are grouped in the same way by their digests, level by level, until one node is left: the root that a snapshot
names. Runs and nodes are rows named by their digests, so what a store holds already is not written again, and two
versions are compared by following only digests that differ.

A store is a folder of three tables: ``runs`` (digest, blocks), ``nodes`` (digest, level, children with their sizes) and
``snapshots``. Every save adds files and changes none. The shape of a tree depends on a document's blocks alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.membership import sifted
from quire.operators.ordered import islands, number_rows_by_range, segment
from quire.operators.versions import replace_by_key
from quire.session import cut_lineage

#: One in so many blocks (or nodes) ends its group, and the most that a group holds.
USUAL, MOST = 32, 256
#: Positions whose blocks are collected together.
STRETCH = 8 * MOST
KEY = ("doc_id",)
NODE = "digest string, level int, children array<struct<child:string,size:bigint>>"
SNAPSHOT = "snapshot_id long, doc_id long, root string, level int, size long, meta map<string,string>, content_hash string, note string, created_at timestamp"


def _name(row: Column) -> Column:
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def _ends(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % USUAL == 0


def _grouped(rows: DataFrame, ends: Column, seg_out: str | None = None) -> DataFrame:
    """Adds ``grp``, the content-defined group of each row (doc_id, pos): those up to a boundary, at most MOST."""
    # A boundary row still belongs to the group that it ends.
    led = islands(rows, F.when(~ends, 1), F.lit(1), "__first", KEY, seg_out=seg_out)
    part = F.floor((F.col("pos") - F.col("__first")) / MOST)
    return led.withColumn("grp", F.struct("__first", part.alias("part"))).drop("__first")


def _numbered(groups: DataFrame, *keep: str) -> DataFrame:
    """Groups of a document numbered in order from 0 on; ``first`` rises along a document."""
    numbered = number_rows_by_range(groups, list(KEY), [F.col("first")], "__n")
    return numbered.select(*KEY, (F.col("__n") - 1).alias("pos"), *keep)


def _runs(blocks: DataFrame, row: Column) -> DataFrame:
    """doc_id, first, last, digest, size, again of every run, from the digests of its blocks; no block moves.

    Rows of one position count each against all of it; ``again`` lists such positions, once for each of their digests.
    """
    sha = _name(row)
    rows = blocks.dropna(subset=[*KEY, "pos"]).select(*KEY, "pos", F.unhex(sha).alias("digest"), _ends(sha).alias("__ends"))
    rows = _grouped(rows, F.col("__ends"), "__seg").withColumn("__k", F.count("*").over(Window.partitionBy(*KEY, "__seg", "pos")))
    pieces = rows.groupBy(*KEY, "__seg", "grp").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", F.col("__k").alias("k")))).alias("c"))
    hexes = F.array_join(F.transform("c", lambda c: F.repeat(F.lower(F.hex(c["digest"])), c["k"].cast("int"))), "")
    start = F.col("grp.__first") + F.col("grp.part") * MOST
    # Digests go on only where the group may reach into another segment; the others have their name here.
    whole = segment(start) == segment(start + (MOST - 1))
    pieces = pieces.select(
        *KEY, "grp", F.array_min("c.pos").alias("first"), F.array_max("c.pos").alias("last"), F.aggregate("c.k", F.lit(0).cast("long"), lambda a, k: a + k).alias("size"),
        F.when(whole, F.sha2(hexes, 256)).alias("digest"), F.when(~whole, hexes).alias("hexes"),
        F.when(F.exists("c", lambda c: c["k"] > 1), F.transform(F.filter("c", lambda c: c["k"] > 1), lambda c: c["pos"])).alias("again"),
    )
    runs = pieces.groupBy(*KEY, "grp").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"), F.first("digest", True).alias("digest"),
        F.sort_array(F.collect_list(F.struct("first", "hexes"))).alias("h"), F.flatten(F.collect_list("again")).alias("again"),
    )
    return runs.select(*KEY, "first", "last", F.coalesce("digest", F.sha2(F.array_join("h.hexes", ""), 256)).alias("digest"), "size", "again")


def _near(pos: Column) -> Column:
    """The stretch of positions that one holds; a run lies in one, or around the start of one."""
    return (pos / STRETCH).cast("long")


def _collected(blocks: DataFrame, row: Column, runs: DataFrame) -> DataFrame:
    """digest, blocks of ``runs`` (as ``_runs`` has them, each digest once): their blocks move once, to their stretch.

    Blocks around the start of a stretch go there too, for a run that reaches over it.
    """
    pos, low, high = F.col("pos"), _near(F.col("first")), _near(F.col("last"))
    before, after = _near(pos - MOST), _near(pos + MOST)
    homes = F.when(before == after, F.array(2 * _near(pos))).otherwise(F.array(2 * _near(pos), 2 * after + 1))
    named = runs.select(*KEY, F.when(low == high, 2 * low).otherwise(2 * high + 1).alias("home"), "digest", "first", "last", "again")
    placed = blocks.select(*KEY, "pos", row.alias("block"), F.explode(homes).alias("home")).join(named, [*KEY, "home"])
    placed = placed.where(pos.between(F.col("first"), F.col("last")))
    whole = placed.groupBy(*KEY, "home", "digest").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b"), F.first("again").alias("again"))
    times = lambda b: F.greatest(F.lit(1), F.size(F.filter("again", lambda p: p == b["pos"])))
    again = F.flatten(F.transform("b", lambda b: F.array_repeat(b["block"], times(b))))
    return whole.select("digest", F.when(F.size("again") > 0, again).otherwise(F.col("b.block")).alias("blocks"))


def trees(blocks: DataFrame, content: Sequence[str], docs: DataFrame | None = None, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, nodes, roots) of blocks (doc_id, pos and the columns ``content``).

    runs: digest, blocks (array of the content). nodes: digest, level, children (digest and blocks below, in order).
    roots: doc_id, root, level, size. Positions need not be dense. A digest stands for its content whatever document it
    is in. A document without blocks has no root. ``docs`` (doc_id) names the documents meant, where not all are;
    ``held`` (digest) are runs not wanted again.

    Runs are found from digests alone; blocks are moved for the runs wanted only.
    """
    row = F.struct(*content)
    found = _runs(blocks, row)
    beside = Window.partitionBy(*KEY)
    runs = found if docs is None else found.join(docs.select(*KEY), list(KEY), "left_semi")
    runs = cut_lineage(runs.withColumn("n", F.count("*").over(beside)))
    wanted = runs.groupBy("digest").agg(F.min_by(F.struct(*KEY, "first", "last", "again"), F.struct(*KEY, "first", "last")).alias("r"))
    if held is not None:
        wanted = cut_lineage(wanted.join(held, "digest", "left_anti"))
    wanted = wanted.select("digest", "r.*")
    stored = _collected(blocks if held is None else sifted(blocks, "doc_id", wanted, "doc_id")[0], row, wanted)
    level, nodes, roots = 0, None, None
    below = runs.select(*KEY, "first", "digest", "size", "n")
    while True:
        alone = below.where("n = 1").select(*KEY, F.col("digest").alias("root"), F.lit(level).alias("level"), "size")
        roots = alone if roots is None else roots.unionByName(alone)
        rest = below.where("n > 1")
        if rest.isEmpty():
            empty = blocks.sparkSession.createDataFrame([], NODE)
            return stored, empty if nodes is None else nodes.dropDuplicates(["digest"]), roots
        rest = cut_lineage(_numbered(rest.select(*KEY, "first", "digest", "size"), "digest", "size"))
        level += 1
        # The digests of the children decide again; a level's name enters its digests, so levels never meet.
        grouped = _grouped(rest.withColumn("__ends", _ends(F.col("digest"))), F.col("__ends")).groupBy(*KEY, "grp").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("c"))
        built = cut_lineage(
            grouped.select(
                *KEY, F.array_min("c.pos").alias("first"), F.sha2(F.concat(F.lit(f"{level}:"), F.array_join("c.digest", "")), 256).alias("digest"),
                F.aggregate("c.size", F.lit(0).cast("long"), lambda a, n: a + n).alias("size"),
                F.transform("c", lambda c: F.struct(c["digest"].alias("child"), c["size"].alias("size"))).alias("children"),
            ).withColumn("n", F.count("*").over(beside))
        )
        own = built.select("digest", F.lit(level).alias("level"), "children")
        nodes = own if nodes is None else nodes.unionByName(own)
        below = built.select(*KEY, "first", "digest", "size", "n")


class ContentStore:
    """Runs, nodes and snapshots in a shared folder; each save writes folders of its own and rewrites nothing."""

    def __init__(self, spark: SparkSession, folder: str, block_schema: str):
        """``block_schema`` names a block's content columns, such as ``type string, text string``."""
        self.spark, self.folder, self.block_schema = spark, folder.rstrip("/"), block_schema
        self.content = [f.name for f in spark.createDataFrame([], block_schema).schema]

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsparkSession.sparkContext().hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, save long")
        return self.spark.read.schema(f"{schema}, save long").parquet(f"{self.folder}/{name}")

    def runs(self) -> DataFrame:
        columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], self.block_schema).schema)
        return self._table("runs", f"digest string, blocks array<struct<{columns}>>")

    def nodes(self) -> DataFrame:
        return self._table("nodes", NODE)

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOT).drop("save")

    def saves(self) -> DataFrame:
        """save, runs, blocks, bytes: what each save added to the runs (bytes of the blocks as JSON)."""
        return self.runs().groupBy("save").agg(
            F.count("*").alias("runs"), F.sum(F.size("blocks")).alias("blocks"), F.sum(F.octet_length(F.to_json("blocks"))).alias("bytes")
        )

    def save(self, blocks: DataFrame, docs: DataFrame, note: str, now: Column) -> DataFrame:
        """Snapshot of every row of ``docs`` (doc_id, meta, content_hash), numbered after the last; the rows added (V-01).

        A document without blocks is held with an empty root. The snapshots are written last, so a save that fails
        leaves runs and nodes that the next one finds stored already, and no snapshot that misses any.
        """
        done = self.snapshots().agg(F.coalesce(F.max("snapshot_id"), F.lit(0)).alias("top")).first()["top"]
        number = self._table("snapshots", SNAPSHOT).agg(F.coalesce(F.max("save"), F.lit(0))).first()[0] + 1
        # A failed save may have left folders of this number: they are written anew, against the saves before it only.
        before = lambda held: held.where(F.col("save") < number).select("digest")
        runs, nodes, roots = trees(blocks, self.content, docs, before(self.runs()) if number > 1 else None)
        for name, rows in (("runs", runs), ("nodes", nodes.join(before(self.nodes()), "digest", "left_anti"))):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/save={number}")
        rows = number_rows_by_range(docs.select("doc_id", "content_hash"), [], [F.col("doc_id")], "__n").join(docs.select("doc_id", "meta"), "doc_id")
        rows = rows.join(roots, "doc_id", "left")
        rows = rows.select(
            (F.col("__n") + done).alias("snapshot_id"), "doc_id", "root", "level", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "meta", "content_hash",
            F.lit(note).alias("note"), now.alias("created_at"),
        )
        path = f"{self.folder}/snapshots/save={number}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(SNAPSHOT).parquet(path)

    def blocks_of(self, roots: DataFrame, *keep: str) -> DataFrame:
        """*keep, pos and the content columns of the trees in ``roots`` (root, level and ``keep``), positions dense from 0.

        Every node knows the blocks below its children, so a block's position is summed up on the way down.
        """
        at = roots.where(F.col("root").isNotNull()).select(*keep, F.col("root").alias("digest"), "level", F.lit(0).cast("long").alias("at"))
        nodes = self.nodes().select("digest", "children")
        for level in range(self._top(at), 0, -1):
            high = at.where(F.col("level") == level).drop("level").join(nodes, "digest")
            ends = F.transform(F.sequence(F.lit(0), F.size("children") - 1), lambda i: F.aggregate(F.slice("children", F.lit(1), i), F.lit(0).cast("long"), lambda a, c: a + c["size"]))
            below = high.withColumn("ends", ends).select(*keep, "at", "ends", F.posexplode("children").alias("i", "c"))
            below = below.select(*keep, F.col("c.child").alias("digest"), F.lit(level - 1).alias("level"), (F.col("at") + F.get("ends", F.col("i"))).alias("at"))
            at = at.where(F.col("level") != level).unionByName(below)
        found = self._with_blocks(at)
        placed = found.select(*keep, "at", F.posexplode("blocks").alias("i", "b"))
        return placed.select(*keep, (F.col("at") + F.col("i")).alias("pos"), *[F.col("b")[c].alias(c) for c in self.content])

    def _with_blocks(self, at: DataFrame) -> DataFrame:
        """``at`` (digest and more) with the blocks of its runs; runs that it does not name stay where they are."""
        at = cut_lineage(at)
        return at.join(sifted(self.runs().select("digest", "blocks"), "digest", at, "digest")[0], "digest")

    def _top(self, rows: DataFrame) -> int:
        return rows.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]

    def restored(self, choice: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(snapshots, blocks, rejected) of ``choice`` (doc_id, snapshot_id): a snapshot must belong to its document (V-04)."""
        owned = self.snapshots().withColumnRenamed("doc_id", "__owner")
        rows = choice.select("doc_id", "snapshot_id").join(owned, "snapshot_id", "left")
        fits = F.col("__owner").eqNullSafe(F.col("doc_id"))
        good = rows.where(fits).drop("__owner")
        return good, self.blocks_of(good.select("doc_id", "root", "level"), "doc_id"), rows.where(~fits).select("doc_id", "snapshot_id")

    def rollback(self, choice: DataFrame, blocks: DataFrame, docs: DataFrame, now: Column) -> dict[str, DataFrame]:
        """Content and meta as the chosen snapshots hold them (V-04): blocks, docs, log, rejected.

        The documents named are replaced whole, a snapshot without blocks leaving none, and each is logged. ``reindex``
        names the documents whose index entries follow.
        """
        good, old, rejected = self.restored(choice)
        good = cut_lineage(good)
        keys = good.select("doc_id")
        meta = good.select("doc_id", F.col("meta").alias("__meta"), F.lit(True).alias("__back"))
        named = docs.join(meta, "doc_id", "left")
        back = F.coalesce("__back", F.lit(False))
        columns = {"meta": F.when(back, F.col("__meta")).otherwise(F.col("meta"))}
        if "updated_at" in docs.columns:
            columns["updated_at"] = F.when(back, now).otherwise(F.col("updated_at"))
        log = good.select(
            "doc_id", F.lit("rollback").alias("kind"), F.concat(F.lit("rolled back to snapshot "), F.col("snapshot_id").cast("string")).alias("summary"),
            "snapshot_id", "content_hash", now.alias("created_at"),
        )
        return {
            "blocks": replace_by_key(blocks.select("doc_id", "pos", *self.content), old.select("doc_id", F.col("pos").cast(blocks.schema["pos"].dataType).alias("pos"), *self.content), keys, within=True),
            "docs": named.withColumns(columns).select(*docs.columns), "log": log, "rejected": rejected, "reindex": keys,
        }

    def changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """doc_id, the content columns and n: blocks that ``new`` has more (n > 0) or less often (n < 0) than ``old``.

        Both are rows of snapshots. Digests are counted with their sign and go down only where the counts differ, so
        equal subtrees, wherever they stand, are never read; a document whose blocks only changed places has no row. Blocks are
        counted by their digests as well, and only those that differ are moved.
        """
        side = lambda d, n: d.where(F.col("root").isNotNull()).select("doc_id", F.col("root").alias("digest"), "level", F.lit(n).cast("long").alias("n"))
        met = lambda d: d.groupBy("doc_id", "digest", "level").agg(F.sum("n").alias("n")).where("n != 0")
        at = met(side(old, -1).unionByName(side(new, 1)))
        nodes = self.nodes().select("digest", "children")
        for level in range(self._top(at), 0, -1):
            below = at.where(F.col("level") == level).join(nodes, "digest").select("doc_id", F.explode("children.child").alias("digest"), F.lit(level - 1).alias("level"), "n")
            at = cut_lineage(met(at.where(F.col("level") != level).unionByName(below)))
        at = cut_lineage(at)
        runs = sifted(self.runs().select("digest", "blocks"), "digest", at, "digest")[0]
        names = runs.select("digest", F.transform("blocks", lambda b: F.unhex(_name(b))).alias("names"))
        found = at.join(names, "digest").select("doc_id", "n", F.explode("names").alias("name"))
        found = cut_lineage(found.groupBy("doc_id", "name").agg(F.sum("n").alias("n")).where("n != 0"))
        block = runs.select(F.explode("blocks").alias("b")).withColumn("name", F.unhex(_name(F.col("b"))))
        block = sifted(block, "name", found, "name")[0].groupBy("name").agg(F.first("b").alias("b"))
        return found.join(block, "name").select("doc_id", *[F.col("b")[c].alias(c) for c in self.content], "n")
