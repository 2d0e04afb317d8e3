"""Manifests, binary assets and page discovery over file folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "stem string, session_id string, source_file string, figures array<struct<n:string, anchor:string, source_sha256:string, caption:string, "
    "included:boolean, use_original:boolean, prompt_override:string, silhouette:struct<file:string, model:string, approved:boolean>>>"
)

# File extension to media type.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "html": "text/html", "txt": "text/plain", "pdf": "application/pdf", "json": "application/json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def _named(reader, names: str | None):
    """The names asked for go into the listing, so files of other names are neither planned nor opened."""
    return reader if names is None else reader.option("pathGlobFilter", names)


def file_rows(spark: SparkSession, folder: str, names: str | None = None) -> DataFrame:
    """path, length, modificationTime of every file; contents are not read (S-06, S-08)."""
    return _named(spark.read.format("binaryFile"), names).load(folder).select("path", "length", "modificationTime")


def read_manifests(spark: SparkSession, glob: str, stems: str | None = None) -> DataFrame:
    """One row per figure of every JSON manifest, with defaults (S-05); ``stems`` is a glob on the file's stem."""
    reader = _named(spark.read.schema(MANIFEST).option("multiLine", "true"), None if stems is None else f"{stems}.json")
    return manifest_figures(reader.json(glob).withColumn("path", F.input_file_name()))


def manifest_figures(manifests: DataFrame) -> DataFrame:
    """Figures with defaults; within a manifest the last one of a content hash wins and blank hashes go (S-05)."""
    f = F.col("f")
    text = lambda c: F.coalesce(c, F.lit(""))
    stem = F.coalesce("stem", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    rows = manifests.select(stem.alias("stem"), "path", text(F.col("source_file")).alias("source_file"), F.posexplode("figures").alias("idx", "f")).select(
        "stem", "path", "source_file", "idx", text(f["n"]).alias("n"), text(f["anchor"]).alias("anchor"), text(f["source_sha256"]).alias("source_sha256"),
        text(f["caption"]).alias("caption"), F.coalesce(f["included"], F.lit(True)).alias("included"),
        F.coalesce(f["use_original"], F.lit(False)).alias("use_original"), text(f["prompt_override"]).alias("prompt_override"),
        text(f["silhouette"]["file"]).alias("sketch_file"), text(f["silhouette"]["model"]).alias("sketch_model"),
        F.coalesce(f["silhouette"]["approved"], F.lit(False)).alias("approved"),
    ).where(F.col("source_sha256") != "")
    rest = [c for c in rows.columns if c not in ("path", "source_sha256")]
    return rows.groupBy("path", "source_sha256").agg(F.max_by(F.struct(*rest), "idx").alias("r")).select("path", "source_sha256", "r.*").drop("idx")


def mime_of(ext: Column) -> Column:
    known = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))


def read_binary_assets(spark: SparkSession, glob: str, kind: str, names: str | None = None, largest: int | None = None) -> DataFrame:
    """Files as content-addressed rows; equal bytes are one row, the first file wins (S-06).

    ``names`` is a glob on the file's name. Files above ``largest`` bytes are left to their listing (``file_rows``): the
    size is compared before a file is opened, and Spark packs files into tasks by size, the largest ones alone.
    """
    files = _named(spark.read.format("binaryFile"), names).load(glob)
    return asset_rows(files if largest is None else files.where(F.col("length") <= largest), kind)


def asset_rows(files: DataFrame, kind: str) -> DataFrame:
    rows = files.select(
        F.sha2("content", 256).alias("sha256"), "path", "length", "modificationTime", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename")
    )
    first = F.min_by(F.struct("filename", "length", "modificationTime"), F.struct("modificationTime", "path")).alias("f")
    ext = F.lower(F.regexp_extract("f.filename", r"\.([^.]+)$", 1))
    return rows.groupBy("sha256").agg(first).select(
        "sha256", F.lit(kind).alias("kind"), "f.filename", F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("").alias("ext"), mime_of(ext).alias("mime"),
        F.col("f.length").alias("size_bytes"), F.col("f.modificationTime").alias("created_at"),
    )


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file per row (name, content) and gives name and bytes of each; tasks write their own rows.

    The folder is one that the executors share and that pyarrow can open. A task that runs again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents):
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64())], names=["name", "size"])

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "name string, size long")


def open_folder(folder: str):
    """(file system, path) of a folder, from a task or the driver."""
    from pyarrow import fs

    plain = folder.removeprefix("file:")
    return fs.FileSystem.from_uri("/" + plain.lstrip("/") if plain != folder or "://" not in folder else folder)


def discover(paths: DataFrame) -> DataFrame:
    """Page stems: *.html files whose name does not start with 'index' (S-08)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return paths.where(name.endswith(".html") & ~name.startswith("index")).select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("stem"))
