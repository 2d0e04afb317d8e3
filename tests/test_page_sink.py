"""A run is seen whole or not at all."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.sources import page_sink as ps

DIRTY = "doc_id long, target_id long, kind string, target_kind string, content_hash string"


def dirty(spark, ids):
    return spark.createDataFrame([(i, t, "memoir", "pages", f"h{i}") for i in ids for t in (1, 2)], DIRTY)


def now():
    return F.lit("2024-01-01").cast("timestamp")


def pages(spark, folder):
    return {(r.doc_id, r.target_id): (r.run, r.html) for r in ps.committed_pages(spark, folder).collect()}


def test_runs_and_their_state(spark, tmp_path):
    folder = str(tmp_path / "site")
    assert pages(spark, folder) == {}
    render = spark.range(1, 30).select(F.col("id").alias("doc_id"), F.concat(F.lit("<p>a"), "id").alias("html")).repartition(4)
    out = ps.publish_run(dirty(spark, range(1, 33)), render, folder, spark, now(), 1)
    assert out["marked"].count() == 58 and out["log"].count() == 58
    again = spark.range(5, 7).select(F.col("id").alias("doc_id"), F.lit("<p>b").alias("html"))
    assert ps.publish_run(dirty(spark, [5, 6, 7]), again, f"file:{folder}", spark, now(), 2)["marked"].count() == 4
    got = pages(spark, folder)
    assert len(got) == 58 and got[5, 1] == (2, "<p>b") and got[4, 2] == (1, "<p>a4")
    assert ps.publish_run(dirty(spark, [8]), again.limit(0), folder, spark, now(), 3)["marked"].count() == 0


def test_a_failed_task_shows_nothing(spark, tmp_path):
    folder = str(tmp_path / "site")

    @F.udf("string")
    def breaks(i):
        if i == 17:
            raise ValueError("no page for 17")
        return f"<p>{i}"

    render = spark.range(0, 40, 1, 8).select(F.col("id").alias("doc_id"), breaks("id").alias("html"))
    with pytest.raises(PySparkException, match="no page for 17"):
        ps.publish_run(dirty(spark, range(40)), render, folder, spark, now(), 1)
    assert pages(spark, folder) == {} and not (tmp_path / "site" / "manifests").exists()
    fine = render.where("doc_id <> 17")
    assert ps.publish_run(dirty(spark, range(40)), fine, folder, spark, now(), 2)["marked"].count() == 78
    assert {run for run, _ in pages(spark, folder).values()} == {2}


def test_files_without_a_manifest_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "site")
    render = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("html"))
    ps.publish_run(dirty(spark, range(3)), render, folder, spark, now(), 1)
    # A task that wrote and was never committed.
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [99], "target_id": [1], "html": ["lost"]})
    assert ps.PageWriter(folder, 1).write(iter([batch])).rows == 1
    assert (99, 1) not in pages(spark, folder) and len(pages(spark, folder)) == 6


def test_names_and_sizes_decide_before_files_are_opened(spark, tmp_path):
    from quire.sources import files as fl

    folder = str(tmp_path / "in")
    rows = [(f"{kind}-{i}.json", '{"figures":[{"source_sha256":"%s%d"}]}' % (kind, i)) for kind in "ab" for i in range(20)] + [("big.bin", "x" * 100_000), ("bad.json", "{")]
    out = fl.write_files(spark.createDataFrame(rows, "name string, content string").repartition(3), folder).collect()
    assert {r.name: r.size for r in out} == {n: len(c) for n, c in rows}
    some = fl.read_manifests(spark, folder, "a-1*")
    assert {r.source_sha256 for r in some.collect()} == {"a1", *(f"a{i}" for i in range(10, 20))}
    assert len(some.inputFiles()) == 11
    assert fl.file_rows(spark, folder).count() == 42 and len(fl.file_rows(spark, folder, "b-*").collect()) == 20
    small = fl.read_binary_assets(spark, folder, "originals", largest=1000)
    assert small.count() == 41 and "big.bin" not in {r.filename for r in small.collect()}
    assert {f.rsplit("/", 1)[1].split("-")[0] for f in fl.read_binary_assets(spark, folder, "x", "a-*").inputFiles()} == {"a"}
