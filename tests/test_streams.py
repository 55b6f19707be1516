"""Streams with state: rows of features that arrive more than once, and heartbeats that fall silent."""

import datetime
from pathlib import Path

from pyspark.sql import functions as F

from zonalspark.sources.fixtures import view
from zonalspark.streaming.coverage import coverage_run
from zonalspark.streaming.heartbeats import release_run

AT = datetime.datetime(2020, 1, 1)
BEAT = "task_id long, status int, at timestamp"


def test_features_that_come_again_have_their_rows_once(spark, tmp_path):
    new, datasets = str(tmp_path / "new"), spark.createDataFrame([(7, -10.0, -10.0, 10.0, 10.0), (8, 0.0, 0.0, 3.0, 3.0)], "dataset_id long, minx double, miny double, maxx double, maxy double")
    boxes = "geom_id long, minx double, miny double, maxx double, maxy double"
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (2, -1.0, 0.0, 1.0, 1.0), (3, 5.0, 5.0, 11.0, 6.0)]
    spark.createDataFrame(rows, boxes).coalesce(1).write.parquet(f"{new}/1")
    first = coverage_run(spark, new, datasets, str(tmp_path / "out"))
    assert sorted(map(tuple, first.collect())) == [(1, 7), (1, 8), (2, 7)]
    # the stream goes on where it ended: a second delivery of the same rows, and a new one
    spark.createDataFrame([*rows, (4, 2.0, 2.0, 3.0, 3.0), (4, 2.0, 2.0, 3.0, 3.0)], boxes).coalesce(1).write.parquet(f"{new}/2")
    for _ in range(2):
        again = coverage_run(spark, new, datasets, str(tmp_path / "out"))
        assert sorted(map(tuple, again.collect())) == [(1, 7), (1, 8), (2, 7), (4, 7), (4, 8)]
    assert again.columns == ["geom_id", "dataset_id"]


def test_silent_tasks_wait_again(spark, tmp_path):
    minutes = lambda n: AT + datetime.timedelta(minutes=n)
    batches = [
        [(1, -1, minutes(0)), (2, -1, minutes(0)), (3, -1, minutes(0)), (4, 1, minutes(0)), (5, -1, minutes(20))],
        [(2, -1, minutes(25)), (3, 1, minutes(25))],  # 2 is alive, 3 is done
        [(9, 0, minutes(45))],  # a clock: 1 is silent by now
        [(9, 0, minutes(54))],  # 5 is silent, 2 not yet
        [(9, 0, minutes(54))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, BEAT).coalesce(1).write.parquet(f"{tmp_path}/beats/{k}")
    out = release_run(spark, f"{tmp_path}/beats", str(tmp_path / "out"), groups=2)
    assert sorted(map(tuple, out.collect())) == [(1, 0), (5, 0)]
    assert out.where(F.col("status") != 0).count() == 0


def test_all_files_of_a_batch_in_any_order(spark, tmp_path):
    minutes = lambda n: AT + datetime.timedelta(minutes=n)
    rows = [(k, -1, minutes(0)) for k in range(100)] + [(k, 1 if k % 3 else -1, minutes(20)) for k in range(0, 100, 2)] + [(200, 0, minutes(45))]
    spark.createDataFrame(rows, BEAT).orderBy(F.desc("at")).repartition(8).write.parquet(f"{tmp_path}/beats")
    out = release_run(spark, f"{tmp_path}/beats", str(tmp_path / "out"), 5, None)
    assert sorted(map(tuple, out.collect())) == [(k, 0) for k in range(1, 100, 2)]


def test_no_task_of_the_query_writes_all_heartbeats(spark, tmp_path, monkeypatch):
    from zonalspark.plans import stream_queries

    data, files = "/root/testdata/sf0.01", []
    run = stream_queries.release_run
    monkeypatch.setattr(stream_queries, "release_run", lambda s, source, *more: files.extend(Path(source).glob("1/*.parquet")) or run(s, source, *more))
    monkeypatch.setattr(stream_queries, "view", lambda s, d, name: view(s, d, name).repartition(6))
    assert stream_queries.heartbeat_release(spark, data).count() > 0
    assert len(files) == 6
