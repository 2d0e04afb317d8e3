"""Streams with state by key: repeats and late rows change nothing, and state is bounded and given up."""

import datetime as dt

from quire.streaming import incremental as inc

LOG = "change_id long, doc_id long, kind string, summary string, created_at timestamp, note string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def feed(spark, folder, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_latest_edit_by_key(spark, tmp_path):
    src, out = str(tmp_path / "in"), inc.BatchTable(spark, str(tmp_path / "out"))

    def run(rows):
        feed(spark, src, LOG, rows)
        stream = spark.readStream.schema(LOG).parquet(src)
        return inc.stream_latest_keyed(stream, "polish", out, str(tmp_path / "cp"), seconds=600)

    def now():
        return {r.doc_id: (r.change_id, r.note, r.created_at) for r in inc.current(out).collect()}

    run([(1, 1, "edit", "polish a", at(0), None), (2, 2, "edit", "polish b", at(1), "n"), (3, 1, "import", "polish c", at(2), "x")])
    assert now() == {1: (1, None, at(0)), 2: (2, "n", at(1))}
    run([(1, 1, "edit", "polish a", at(0), None), (4, 1, "edit", "polish d", at(3), "m"), (5, 1, "edit", "other", at(4), "o")])
    assert now() == {1: (4, "m", at(3)), 2: (2, "n", at(1))}
    before = len(list((tmp_path / "out").glob("batch=*/*.parquet")))
    run([(2, 2, "edit", "polish b", at(1), "replayed"), (4, 1, "edit", "polish d", at(3), "replayed")])
    assert now() == {1: (4, "m", at(3)), 2: (2, "n", at(1))}
    query = run([(9, 3, "edit", "polish z", at(500), "far")])
    states = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    # A change far ahead moves the watermark: the documents before it are given up, the result stays.
    assert states[-1][0]["numRowsTotal"] <= 1
    assert now() == {1: (4, "m", at(3)), 2: (2, "n", at(1)), 3: (9, "far", at(500))}
    run([(6, 1, "edit", "polish late", at(5), "late")])
    assert now()[1] == (4, "m", at(3))
    run([(10, 1, "edit", "polish again", at(501), "back")])
    assert now()[1] == (10, "back", at(501))
    assert before > 0


def test_progress_by_key(spark, tmp_path):
    schema = "job long, item long, state string, at timestamp"
    src, out = str(tmp_path / "in"), inc.BatchTable(spark, str(tmp_path / "out"))
    for rows in (
        [(1, 1, "ok", at(0)), (1, 2, "pending", at(0)), (2, 1, "failed", at(1))], [(1, 1, "ok", at(0)), (1, 3, "failed", at(2))], [(2, 1, "failed", at(1))],
    ):
        feed(spark, src, schema, rows)
        query = inc.stream_progress_keyed(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp"), seconds=3600)
    got = {r.job: (r.total, r.done, r.failed) for r in inc.current(out, key="job").collect()}
    assert got == {1: (3, 2, 1), 2: (1, 1, 1)}
    assert min(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) == 2  # one row of counts per job
