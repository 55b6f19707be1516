"""Queries of streams with state, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonalspark.sources.fixtures import view, with_views
from zonalspark.sources.shared import shared_dir
from zonalspark.streaming.coverage import coverage_run
from zonalspark.streaming.heartbeats import release_run

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def put(f):
        QUERIES[name], SQL[name] = f, f"{with_views(*views)} {sql}"
        return f

    return put


@query("feature_inserts", "SELECT event_id AS geom_id, dataset_id FROM fx_points JOIN fx_datasets ON minx <= lon - 0.5 AND miny <= lat - 0.5 AND maxx >= lon + 0.5 AND maxy >= lat + 0.5", "fx_points", "fx_datasets")
def feature_inserts(s, d):
    """Boxes around events arrive as new features, in batches of which one is delivered again; rows of the datasets that hold
    them appear once."""
    at = f"{shared_dir(s)}/inserts-{uuid.uuid4().hex}"
    boxes = view(s, d, "fx_points").select(F.col("event_id").alias("geom_id"), *((F.col(c) + F.lit(v)).alias(n) for n, c, v in (("minx", "lon", -0.5), ("miny", "lat", -0.5), ("maxx", "lon", 0.5), ("maxy", "lat", 0.5))))
    odd = F.col("geom_id") % 2 == 1
    for name, rows in (("1", boxes.where(~odd)), ("2", boxes.where(odd)), ("3", boxes.where(~odd))):
        rows.coalesce(8).write.parquet(f"{at}/new/{name}")
    return coverage_run(s, f"{at}/new", view(s, d, "fx_datasets"), at, 8)


NOW = "1998-01-01"


@query("heartbeat_release", f"SELECT task_id, CASE WHEN last.status = -1 AND last.at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE THEN 0 ELSE last.status END AS status FROM (SELECT task_id, max({{'at': update_time, 'status': status}}) AS last FROM fx_tasks WHERE update_time <= TIMESTAMP '{NOW}' GROUP BY task_id)", "fx_tasks")
def heartbeat_release(s, d):
    """Running tasks whose last heartbeat is more than half an hour before now wait again: heartbeats go through state and
    timers, a clock that ticks at now moves the watermark. Heartbeats lie in as many files as tasks write, in one batch, and
    a group of tasks keeps its size as they grow in number."""
    at = f"{shared_dir(s)}/beats-{uuid.uuid4().hex}"
    now = F.lit(NOW).cast("timestamp")
    beats = view(s, d, "fx_tasks").select("task_id", F.col("status").cast("int").alias("status"), F.col("update_time").cast("timestamp").alias("at")).where(F.col("at") <= now)
    beats.write.parquet(f"{at}/beats/1")
    s.range(1).select(F.lit(-1).cast("long").alias("task_id"), F.lit(0).alias("status"), now.alias("at")).coalesce(1).write.parquet(f"{at}/beats/2")
    groups = max(64, s.read.parquet(f"{at}/beats/1").count() // 50_000)
    free = release_run(s, f"{at}/beats", at, groups, None).withColumnRenamed("status", "new")
    last = beats.groupBy("task_id").agg(F.max(F.struct("at", "status")).alias("last"))
    return last.join(free, "task_id", "left").select("task_id", F.coalesce("new", "last.status").alias("status"))
