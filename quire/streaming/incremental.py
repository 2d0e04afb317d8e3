"""Incremental maintenance of library results with Structured Streaming.

Each micro-batch writes only its own rows, into its own ``batch=`` partition
(overwritten on a replay, so results are exactly-once). Readers keep, per key,
the rows of the newest batch that touched it; nothing older is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.operators import library as lb
from quire.operators import live_index as li
from quire.operators import search as se
from quire.session import cut_lineage


class BatchTable:
    """A table in a shared folder, one partition per micro-batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, batch_id: int, rows: DataFrame, by: str | None = None) -> None:
        if by:
            rows = rows.repartitionByRange(by).sortWithinPartitions(by)
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def newest(self, key: str = "doc_id") -> DataFrame:
        """The last batch that touched each key."""
        return self.read().groupBy(key).agg(F.max("batch").alias("batch"))


def current(table: BatchTable, owners: BatchTable | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of the newest batch per key; ``owners`` names the touched keys when a key may have no rows left."""
    newest = (owners or table).newest(key)
    return table.read().join(newest, [key, "batch"], "left_semi").drop("batch")


def compact(table: BatchTable, into: BatchTable, owners: BatchTable | None = None, by: str | None = None) -> None:
    """Fold all batches into the first batch of a fresh table."""
    into.write(0, current(table, owners), by)


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_latest_run(log: DataFrame, prefix: str, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """Latest matching edit per document and batch; ``latest_runs`` reduces them on reading (R-01)."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        hits = batch.where((F.col("kind") == "edit") & F.col("summary").startswith(prefix))
        table.write(batch_id, newest_per_doc(hits, "change_id"))

    return run_available(log, on_batch, checkpoint)


def latest_runs(table: BatchTable) -> DataFrame:
    return newest_per_doc(table.read().drop("batch"), "change_id")


def newest_per_doc(batch: DataFrame, version: str) -> DataFrame:
    row = F.struct(*[c for c in batch.columns if c != "doc_id"])
    return batch.groupBy("doc_id").agg(F.max_by(row, version).alias("r")).select("doc_id", "r.*")


def stream_reindex(docs: DataFrame, version: str, postings: BatchTable, lengths: BatchTable, checkpoint: str) -> StreamingQuery:
    """Each changed document replaces its postings; the newest version in a batch wins (R-02).

    Read with ``current(postings, owners=lengths)``: every indexed document has
    a length row, so one that lost all its words drops its old postings too.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        fresh_postings, fresh_lengths = se.build_index(newest_per_doc(batch, version))
        postings.write(batch_id, fresh_postings, by="term")
        lengths.write(batch_id, fresh_lengths)

    return run_available(docs, on_batch, checkpoint)


def stream_live_index(docs: DataFrame, version: str, index: li.LiveIndex, checkpoint: str, fan: int = li.FAN) -> StreamingQuery:
    """Changed documents into the index that ``LiveIndex.search`` reads; a null body removes a document (R-02).

    A micro-batch is one folder of the index, and folders are folded as they gather, so neither a batch nor a search
    depends on how many came before. A batch that runs again finds its folder and changes nothing.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        newest = cut_lineage(newest_per_doc(batch, version))
        gone = newest.where("body IS NULL").select("doc_id")
        index.apply(batch_id, newest.where("body IS NOT NULL").select("doc_id", *se.FIELDS), gone)
        index.fold(fan)

    return run_available(docs, on_batch, checkpoint)


def stream_dirty(
    changes: DataFrame, version: str, targets: DataFrame, sync: DataFrame, snapshots: DataFrame, table: BatchTable, checkpoint: str
) -> StreamingQuery:
    """Dirty flags re-evaluated for changed documents only (R-03). ``changes``: doc_id, kind, content_hash, version."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        changed = newest_per_doc(batch, version)
        touched = sync.join(batch.select("doc_id"), "doc_id", "left_semi")
        table.write(batch_id, lb.dirty_matrix(changed, targets, touched, snapshots))

    return run_available(changes, on_batch, checkpoint)


def stream_progress(results: DataFrame, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """done / total / failed per job and batch, in the shared folder; ``progress`` adds them up (R-04)."""
    return run_available(results, lambda batch, batch_id: table.write(batch_id, lb.job_summary(batch)), checkpoint)


def progress(table: BatchTable) -> DataFrame:
    return table.read().groupBy("job").agg(*[F.sum(c).alias(c) for c in ("total", "done", "failed")])


# The same two results with state that Spark keeps by key: repeated rows are dropped by their id within the watermark, and
# a batch writes only the keys it changed. Read both with ``current``.


def run_updates(stream: DataFrame, table: BatchTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of a stateful stream as a partition of ``table``: the keys that it changed."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        table.write(batch_id, batch)

    query = stream.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _newest(seconds: int):
    """The newest change of a key so far; the state is its id, given up ``seconds`` after the last change was due."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, row, last = (state.get[0] if state.exists else None), None, 0
        for pdf in frames:
            last = max(last, int(pdf["at_ms"].max()))
            k = pdf["change_id"].idxmax()
            if best is None or pdf["change_id"][k] > best:
                best, row = int(pdf["change_id"][k]), pdf.loc[[k]]
        if row is not None:
            state.update((best,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * seconds)
        if row is not None:
            yield pd.DataFrame({"doc_id": [key[0]], "change_id": [best], "row": [row["row"].iloc[0]]})

    return step


def _packed(schema: T.StructType):
    """(a row as one string, how to read it): times go as microseconds, so that nothing is rounded."""
    wire = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema])
    time = lambda f: isinstance(f.dataType, T.TimestampType)
    out = F.to_json(F.struct(*[(F.unix_micros(f.name) if time(f) else F.col(f.name)).alias(f.name) for f in schema]), {"ignoreNullFields": "false"})
    back = [(F.timestamp_micros(F.col(f"r.{f.name}")) if time(f) else F.col(f"r.{f.name}")).alias(f.name) for f in schema]
    return out, wire, back


def stream_latest_keyed(log: DataFrame, prefix: str, table: BatchTable, checkpoint: str, seconds: int = 86_400) -> StreamingQuery:
    """The newest matching edit per document, kept as state by document (R-01).

    A change that comes again, or later than ``seconds`` behind the newest one seen, changes nothing. The state of a
    document is one id, removed ``seconds`` after its last change; the result stays in ``table``. Change ids rise in time.
    """
    hits = log.where((F.col("kind") == "edit") & F.col("summary").startswith(prefix))
    own = T.StructType([f for f in log.schema if f.name not in ("doc_id", "change_id")])
    out, wire, back = _packed(own)
    once = hits.withWatermark("created_at", f"{seconds} seconds").dropDuplicatesWithinWatermark(["change_id"])
    rows = once.select("doc_id", "change_id", F.unix_millis("created_at").alias("at_ms"), "created_at", out.alias("row"))
    newest = rows.groupBy("doc_id").applyInPandasWithState(
        _newest(seconds), "doc_id long, change_id long, row string", "change_id long", "update", GroupStateTimeout.EventTimeTimeout
    )
    return run_updates(newest.select("doc_id", "change_id", F.from_json("row", wire).alias("r")).select("doc_id", "change_id", *back), table, checkpoint)


def stream_progress_keyed(results: DataFrame, table: BatchTable, checkpoint: str, seconds: int = 86_400) -> StreamingQuery:
    """done / total / failed per job, kept as state by job (R-04). ``results``: job, item, state, at; an item counts once."""
    once = results.withWatermark("at", f"{seconds} seconds").dropDuplicatesWithinWatermark(["job", "item"])
    return run_updates(lb.job_summary(once), table, checkpoint)
