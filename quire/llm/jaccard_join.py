"""N-gram Jaccard join with Bayesian candidate pruning: classes of near-duplicate documents.

Texts are compared as sets of five-word shingles; texts are linked at a Jaccard similarity of 0.8 or more, and a class is
what links connect. Exact copies are one node from the start.

Candidates. MinHash bands put texts of similarity 0.8 into a common bucket but for a chance below 1e-7. All pairs of a
small bucket are candidates. Texts of larger buckets, which may hold any share of the corpus, are joined exactly by prefix
filter instead: of each text the rarest shingles by a sketch of their counts in these texts, as many as guarantee that two
linked texts share one. Each shared shingle links its texts to one leader, the text in which the fewest rarer shingles come
first; the few that are not of the leader's class afterwards meet the other classes there. Length and position bounds
apply before a pair is made, so a group of near copies costs about its size, and no link between classes is lost.

Counting. Texts of larger buckets that are of one class have their links counted without making pairs: the class is cut
into blocks of a bounded size, and every two blocks meet in a task that counts, per text, the others it is linked to.
That is exact, and quadratic in the group's size in time, but not in rows.

Pruning. A pair's MinHash values are compared sixteen at a time; it is dropped as soon as the posterior probability that
its similarity reaches the threshold (uniform prior) falls below ``TOLERANCE``. The rest is verified on the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prefix_sums, same, text_or_empty
from quire.llm.kernel import U64, mix64, shingles, slices, spread
from quire.session import cut_lineage, written

SHINGLE, SIMILARITY = 5, 0.8
#: MinHash values, values in a band, values compared at a time.
HASHES, BAND, STEP = 128, 4, 16
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-7
#: Texts in a bucket up to which all its pairs are made.
SMALL = 48
#: Cells of the sketch that orders the shingles of texts in larger buckets (4 bytes each in every task).
CELLS = 1 << 21
#: Bytes of text (and 2,048 a text) in a block of a class, texts compared at once with a block, and shingles at a time.
BLOCK, STRIP, COLUMNS = 1 << 23, 512, 2048

KEYS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def least_matches(similarity: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> np.ndarray:
    """For each prefix of the signature the fewest equal values with which the posterior stays at ``tolerance`` or more."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            density = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(density - density.max())
            if density[x >= similarity].sum() / density.sum() >= tolerance:
                out.append(m)
                break
    return np.array(out)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            s, row = shingles(data, offsets, SHINGLE)
            if not len(s):
                continue
            docs, first = np.unique(row, return_index=True)
            signature = np.empty((len(docs), HASHES), dtype=">u4")
            for j in range(HASHES):
                signature[:, j] = np.minimum.reduceat((s ^ KEYS[j]) * (KEYS[-1 - j] | U64(1)), first) >> U64(32)
            part = batch.slice(lo, hi - lo).take(pa.array(docs))
            ends = pa.py_buffer((np.arange(len(docs) + 1) * 4 * HASHES).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(docs), [None, ends, pa.py_buffer(signature.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=["doc_id", "digest", "signature"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for lo, hi, data, offsets in slices(column):
        s, row = shingles(data, offsets, SHINGLE)
        ends = np.searchsorted(row, np.arange(hi - lo + 1))
        out += [np.unique(s[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs (a, b, signatures, texts) that pass: first sixteen values at a time, then on their sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=">u4").reshape(-1, HASHES) for i in (2, 3))
        alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
        for k, need in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
            stay = matches >= need
            alive, matches = alive[stay], matches[stay]
        if not len(alive):
            continue
        rest = batch.take(pa.array(alive))
        linked = []
        for i, (a, b) in enumerate(zip(_sets(rest.column(4)), _sets(rest.column(5)))):
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                linked.append(i)
        yield rest.select([0, 1]).take(pa.array(linked, pa.int64()))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The links among ``pairs`` (a, b).

    One text may be ``a`` of very many pairs. The pairs are a table of their own and take the text of ``b`` first, so that
    the text of ``a`` is not sent again for each of its pairs and the join on ``a`` can be split.
    """
    least = least_matches(similarity, TOLERANCE)
    pairs = written(pairs, "pairs")
    a = texts.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("text").alias("tb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb", "ta", "tb")
    links = both.mapInArrow(lambda batches: _verify(batches, similarity, least), "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """id, class (the smallest id that links reach): least neighbour label and label of the label, until nothing changes."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut_lineage(edges)
    label = cut_lineage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("class")).withColumnRenamed("a", "id"))
    while True:
        near = edges.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("class").alias("near"))
        lower = cut_lineage(label.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("class", "near").alias("class"), F.col("class").alias("was")))
        jump = lower.select(F.col("id").alias("class"), F.col("class").alias("far"))
        # The label of one's label; classes with many members read it once per partial group, so it is joined on the label.
        lower = cut_lineage(lower.join(jump, "class").select("id", F.least("class", "far").alias("class"), "was"))
        if lower.filter("class != was").isEmpty():
            return lower.select("id", "class")
        label = lower.select("id", "class")


def cells(shingle: np.ndarray) -> np.ndarray:
    return (mix64(shingle ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell, n = np.unique(cells(np.concatenate([*_sets(batch.column(0)), np.zeros(0, dtype=np.uint64)])), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], shared, similarity: float) -> Iterator[pa.RecordBatch]:
    common = shared.value
    for batch in batches:
        sets = _sets(batch.column(1))
        ranked = [s[np.lexsort((s, common[cells(s)]))][: len(s) - int(np.ceil(len(s) * similarity - 1e-9)) + 1] for s in sets]
        lens = np.array([len(r) for r in ranked], dtype=np.int64)
        flat = np.concatenate([*ranked, np.zeros(0, dtype=np.uint64)])
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        shared_by_some = common[cells(flat)] > 1
        of = np.repeat(np.arange(len(lens)), lens)[shared_by_some]
        size = np.array([len(s) for s in sets], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of)), pa.array(size[of]), pa.array(place[shared_by_some].astype(np.int32)), pa.array(flat[shared_by_some].view(np.int64))],
            names=["id", "n", "place", "shingle"],
        )


def _prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """id, n, place, shingle: the shared ones among each text's rarest shingles, as many as the threshold asks for.

    Any one order of shingles finds all pairs; counts from a sketch of fixed width put the rare ones first. A sketch
    never counts too little, so a shingle it counts once is in no other text.
    """
    counts = texts.select("text").mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    common = np.ones(CELLS, dtype=np.int64)
    found = counts.toPandas()
    common[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(common.clip(max=2**31 - 1).astype(np.int32))
    prefix = texts.select("id", "text").mapInArrow(lambda b: _rarest(b, shared, similarity), "id long, n int, place int, shingle long")
    return written(prefix, "prefix")


def _may_link(similarity: float):
    """Bounds by length and by the places of a shared shingle (the first one shared), for columns n, place and n2, place2."""
    need = F.ceil((F.col("n") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-9)
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) - 1
    return (F.least("n", "n2") >= F.greatest("n", "n2") * similarity - 1e-9) & (most >= need)


def _once(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (id, id2), each once; ``a`` is an ``id2``, which may lead very many pairs."""
    low, high = F.least("id", "id2").alias("low"), F.greatest("id", "id2").alias("high")
    once = pairs.filter("id != id2").groupBy(low, high).agg(F.max("id2").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def text_links(docs: DataFrame, text: str, doc_id: str, similarity: float, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, crowd): a node per distinct lower-cased text with words (id, digest, first_doc), verified links (a, b)
    that connect all classes, and the texts of larger buckets (id, text), among which links inside a class may be missing."""
    lower = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text_or_empty(text)).alias("text"))
    lower = lower.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    signed = lower.mapInArrow(_signatures, f"doc_id {kind}, digest binary, signature binary")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.first("signature").alias("signature"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * (4 * BAND) + 1, F.lit(4 * BAND)))
    )
    member = nodes.select("id", F.explode(bands).alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    member = written(member.join(sizes, "bucket"), "buckets")
    needed = member.select("id").distinct().join(nodes, "id")
    texts = lower.join(needed, same(lower, needed, ["digest"]) & lower["doc_id"].eqNullSafe(needed["first_doc"]))
    texts = written(texts.select("id", "signature", "text").dropDuplicates(["id"]), "texts")

    few = member.filter(F.col("size") <= small)
    pairs = few.join(few.select("bucket", F.col("id").alias("id2")), "bucket").filter("id < id2")
    many = member.filter(F.col("size") > small).select("id").distinct()
    crowd = texts.join(many, "id", "left_semi").select("id", "text")
    prefix = _prefixes(crowd, similarity)
    lead = prefix.groupBy("shingle").agg(F.min(F.struct("place", "n", "id")).alias("lead"), F.count("*").alias("texts")).filter("texts > 1")
    lead = cut_lineage(lead)  # a table of its own, so that the join on a hot shingle can be split
    lead = lead.select("shingle", F.col("lead.place").alias("place2"), F.col("lead.n").alias("n2"), F.col("lead.id").alias("id2"))
    star = prefix.join(lead, "shingle").filter(_may_link(similarity))
    links = written(verified(_once(pairs.select("id", "id2").unionByName(star.select("id", "id2"))), texts, similarity), "links")

    of = components(links)
    classed = prefix.join(of, "id", "left").withColumn("class", F.coalesce("class", "id"))
    leader = lead.select("shingle", "id2").join(of.withColumnRenamed("id", "id2"), "id2", "left").select("shingle", F.coalesce("class", "id2").alias("lead_class"), "id2")
    aside = classed.join(leader, "shingle").filter("class != lead_class").select("shingle", "id", "n", "place", "class", F.col("id2").alias("lead_id"))
    aside = cut_lineage(aside)
    other = classed.select("shingle", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("class").alias("class2"))
    cross = aside.join(other, "shingle").filter((F.col("class") != F.col("class2")) & (F.col("id2") != F.col("lead_id")) & _may_link(similarity))
    return nodes, links.unionByName(verified(_once(cross), texts, similarity)), crowd


def _common(strip: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], width: int) -> np.ndarray:
    """Shingles in common of every text of a strip and every other text; both are (row, column) lists, sorted by column."""
    common = np.zeros(shape, dtype=np.float32)
    (row, col), (row2, col2) = strip, other
    n, n2 = np.bincount(col, minlength=width), np.bincount(col2, minlength=width)
    first2 = np.cumsum(n2) - n2
    # Shingles of few texts pair by pair, the others as a product of matrices.
    few = n * n2 * 256 <= shape[0] * shape[1]
    at = np.flatnonzero(few[col] & (n2[col] > 0))
    ends = np.cumsum(n2[col[at]])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(at) else 0, 1 << 22)))
    for part in np.split(at, cuts[1:]):
        lens = n2[col[part]]
        _, _, where = spread(first2[col[part]], lens)
        common += np.bincount(np.repeat(row[part], lens) * shape[1] + row2[where], minlength=common.size).reshape(shape)
    many = np.flatnonzero(~few)
    place = np.cumsum(~few) - 1
    for k in range(0, len(many), COLUMNS):
        sides = []
        for r, c, height in ((row, col, shape[0]), (row2, col2, shape[1])):
            a, b = np.searchsorted(c, many[k]), np.searchsorted(c, many[min(k + COLUMNS, len(many)) - 1], "right")
            inside = ~few[c[a:b]]
            side = np.zeros((height, COLUMNS), dtype=np.float32)
            side[r[a:b][inside], place[c[a:b][inside]] - k] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    return common


def link_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """For each set the links between ``left`` and ``right`` (indices, disjoint or the same) that it takes part in."""
    lens = np.array([len(s) for s in sets])
    kinds, col = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(lens) - lens

    def lists(of):
        row, _, where = np.repeat(np.arange(len(of)), lens[of]), *spread(begin[of], lens[of])[1:]
        order = np.argsort(col[where], kind="stable")
        return row[order], col[where][order]

    other, itself = lists(right), np.array_equal(left, right)
    out = np.zeros(len(sets), dtype=np.int64)
    for k in range(0, len(left), STRIP):
        strip = left[k : k + STRIP]
        common = _common(lists(strip), other, (len(strip), len(right)), len(kinds)).astype(np.float64)
        linked = common >= similarity * (lens[strip][:, None] + lens[right][None, :] - common) - 1e-9
        if itself:
            linked[np.arange(len(strip)), k + np.arange(len(strip))] = False
        else:
            out[right] += linked.sum(axis=0)
        out[strip] += linked.sum(axis=1)
    return out


def _counted_links(table: pa.Table, similarity: float) -> pa.Table:
    block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
    n = link_counts(_sets(table.column("text")), np.flatnonzero(block == low), np.flatnonzero(block == high), similarity)
    return pa.table({"id": table.column("id"), "n": pa.array(n, pa.int64())})


def degrees(links: DataFrame, of: DataFrame, crowd: DataFrame, similarity: float) -> DataFrame:
    """id, n_links: all links of every text that has one. ``of`` holds the classes (id, class)."""
    ids = cut_lineage(crowd.select("id"))
    inside = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    outside = links.join(inside, ["a", "b"], "left_anti")
    known = outside.select(F.col("a").alias("id")).unionByName(outside.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    sized = crowd.join(of, "id").select("id", "class", (F.octet_length("text") + 2048).alias("size"))
    dealt = prefix_sums(sized, ["class"], ["id"], {"before": F.col("size")}).select("id", "class", F.expr(f"before div {BLOCK}").alias("block"))
    dealt = written(dealt, "blocks")
    blocks = dealt.groupBy("class").agg(F.max("block").alias("last"), F.count("*").alias("texts")).filter("texts > 1").select("class", "last")
    met = dealt.join(blocks, "class").join(crowd, "id").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = met.select("id", "class", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "text")
    counted = met.groupBy("class", "low", "high").applyInArrow(lambda t: _counted_links(t, similarity), "id long, n long")
    return known.unionByName(counted).groupBy("id").agg(F.sum("n").alias("n_links"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """doc_id, class_id, n_links, copies: one row per row of ``docs``.

    ``class_id`` is the smallest id in the class, ``copies`` the rows with the same lower-cased text, ``n_links`` the
    different texts that text is linked to, whatever the size of its group (``small`` only says how they are found). Texts of one to four words have one
    shingle, of all their words; texts without words (null and empty ones too) are linked to nothing and are classes of
    their own. Repeated rows share a class; rows without id take part, and count only where all ids of a class are null.
    An empty table gives an empty result. A text is worked on whole, in about 40 bytes for each of its own. Only the id and
    the text are read.
    """
    return _classed(docs, text, doc_id, similarity, small, counted=True)


def _classed(docs: DataFrame, text: str, doc_id: str, similarity: float, small: int, counted: bool) -> DataFrame:
    """The rows of ``near_duplicates``, with ``n_links`` 0 unless the links are ``counted``."""
    nodes, links, crowd = text_links(docs, text, doc_id, similarity, small)
    links = written(links, "links")
    of = components(links)
    node = nodes.select("id", "digest").join(of, "id", "left")
    node = node.join(degrees(links, of, crowd, similarity), "id", "left") if counted else node.withColumn("n_links", F.lit(None).cast("long"))
    node = node.select("digest", F.coalesce("class", "id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.lower(text_or_empty(text)))).alias("digest"))
    rows = cut_lineage(rows.join(node, "digest", "left"))
    counts = rows.filter("class is not null").groupBy("digest", "class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    heads = counts.groupBy("class").agg(F.min("first").alias("class_id"))
    counts = counts.join(heads, "class").select(F.col("digest"), "class_id", "copies")
    rows = rows.join(counts, "digest", "left")
    return rows.select(
        "doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` that head their class (ids identify documents here); all columns kept."""
    gone = _classed(docs, text, doc_id, similarity, small, counted=False).filter("doc_id != class_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_id"]), "left_anti")
