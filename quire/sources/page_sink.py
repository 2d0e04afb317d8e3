"""Published pages with a commit: a run is seen whole or not at all (V-07).

A Spark data source whose tasks write pages and, beside them, their keys, and report the two files. Committing writes one
manifest of these files and moves it into place, which is what makes the run visible; files that no manifest names (of
failed or speculative tasks, or of a run that broke off) are never read, and aborting removes those that are known. State
rows come from the key files of the manifest, so nothing reads the pages back.

The folder is one that the executors share and that pyarrow can open (a mounted path, hdfs, s3).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quire.operators.versions import asked_pages, by_document, publish_state
from quire.sources.files import open_folder

KEYS = ("doc_id", "target_id")


@dataclass
class Wrote(WriterCommitMessage):
    """The files of one task and the rows in them."""

    name: str
    rows: int


class PageWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: int):
        self.folder, self.run = folder, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, path = open_folder(f"{self.folder}/files/run={self.run}")
        system.create_dir(path, recursive=True)
        name, rows, pages, keys = uuid.uuid4().hex, 0, None, None
        try:
            for batch in iterator:
                if pages is None:
                    pages = pq.ParquetWriter(f"{path}/{name}.pages", batch.schema, filesystem=system, compression="zstd")
                    keys = pq.ParquetWriter(f"{path}/{name}.keys", batch.select(list(KEYS)).schema, filesystem=system, compression="zstd")
                pages.write_batch(batch)
                keys.write_batch(batch.select(list(KEYS)))
                rows += batch.num_rows
        finally:
            for open_file in (pages, keys):
                if open_file is not None:
                    open_file.close()
        return Wrote(name if pages is not None else "", rows)

    def commit(self, messages: list[Wrote | None]) -> None:
        """One line a task; the move is what publishes."""
        system, path = open_folder(f"{self.folder}/manifests")
        system.create_dir(path, recursive=True)
        lines = [json.dumps({"run": self.run, "file": m.name, "rows": m.rows}) for m in messages if m and m.rows]
        with system.open_output_stream(f"{path}/.run-{self.run}") as out:
            out.write("\n".join(lines).encode())
        system.move(f"{path}/.run-{self.run}", f"{path}/run-{self.run}.json")

    def abort(self, messages: list[Wrote | None]) -> None:
        system, path = open_folder(f"{self.folder}/files/run={self.run}")
        for m in messages:
            if m and m.name:
                for kind in ("pages", "keys"):
                    system.delete_file(f"{path}/{m.name}.{kind}")


class PageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["folder"], int(self.options["run"]))


def committed(spark: SparkSession, folder: str, kind: str, schema: str, run: int | None = None) -> DataFrame:
    """run and the rows of all committed files of a ``kind`` (pages or keys), of one run if asked."""
    system, path = open_folder(f"{folder}/manifests")
    from pyarrow import fs

    found = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("run-")]
    out = spark.createDataFrame([], f"{schema}, run long")
    for manifest in sorted(found):
        with system.open_input_stream(manifest) as stream:
            lines = [json.loads(x) for x in stream.read().decode().splitlines()]
        files = [f"{folder}/files/run={x['run']}/{x['file']}.{kind}" for x in lines]
        if files and run in (None, lines[0]["run"]):
            out = out.unionByName(spark.read.schema(schema).parquet(*files).withColumn("run", F.lit(lines[0]["run"]).cast("long")))
    return out


def publish_run(dirty: DataFrame, render: DataFrame, folder: str, spark: SparkSession, now: Column, run: int) -> dict[str, DataFrame]:
    """Writes the rendered pages of a run and commits it, then gives the state and log rows of what was committed (V-07).

    Arguments as for ``publish_all``. A run whose writing fails raises, and leaves no page, no state and no log.
    """
    spark.dataSource.register(PageSink)
    dirty = by_document(dirty)
    pages = render.join(asked_pages(dirty), "doc_id").select(*KEYS, "html")
    pages.write.format("quire_pages").option("folder", folder).option("run", run).mode("append").save()
    found = committed(spark, folder, "keys", "doc_id long, target_id long", run).select(*KEYS).distinct()
    return publish_state(dirty, found, now)


def committed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The newest committed page per document and target: doc_id, target_id, run, html."""
    rows = committed(spark, folder, "pages", "doc_id long, target_id long, html string")
    newest = rows.select(*KEYS, "run").groupBy(*KEYS).agg(F.max("run").alias("run"))
    return rows.join(newest, [*KEYS, "run"]).select(*KEYS, "run", "html")
