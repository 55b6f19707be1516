"""Queries of names, listings, joins of results and set operations, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonalspark.operators import control, naming
from zonalspark.operators.spatial import bounded
from zonalspark.sources.fixtures import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def put(f):
        QUERIES[name], SQL[name] = f, f"{with_views(*views)} {sql}" if views else sql
        return f

    return put


KWARGS = {"outcome": "fatalities", "year": {"type": "range", "start": 1995, "end": 1997}}
ENDING = hashlib.md5(json.dumps(KWARGS, sort_keys=True).encode()).hexdigest()[:8]


@query("column_naming", f"SELECT DISTINCT concat(CAST(label AS VARCHAR), '.', po_name, '_{ENDING}') AS name FROM fx_tasks", "fx_tasks")
def column_naming(s, d):
    return view(s, d, "fx_tasks").select(naming.column_name(F.col("label").cast("string"), F.col("po_name"), KWARGS).alias("name")).distinct()


@query("none_rename", "SELECT task_id, geom_id, CASE WHEN status = 1 THEN 'sum_total' WHEN status = 0 THEN 'sum_none' ELSE 'mean' END AS name FROM fx_tasks", "fx_tasks")
def none_rename(s, d):
    name, outcome = F.when(F.col("status") == -1, "mean").otherwise("sum_none"), F.when(F.col("status") == 1, "total")
    return view(s, d, "fx_tasks").select("task_id", "geom_id", naming.without_none(name, outcome).alias("name"))


@query("filter_description", "SELECT event_type, 'value: 10–50; event_type: click, view; user_id: ; note: 3; mode: {\"type\": \"any\", \"of\": [1, null]}' AS filters, count(*) AS n FROM fx_points WHERE value BETWEEN 10 AND 50 AND event_type IN ('click', 'view') GROUP BY event_type", "fx_points")
def filter_description(s, d):
    from zonalspark.operators.spatial import filter_of

    filters = {"value": {"type": "range", "start": 10, "end": 50}, "event_type": {"type": "categorical", "selected": ["click", "view"]}, "user_id": {"type": "categorical", "selected": []}, "note": 3, "mode": {"type": "any", "of": [1, None]}}
    return view(s, d, "fx_points").where(filter_of(filters)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("filters", F.lit(naming.filter_text(filters)))


@query("temporal_display", "SELECT req_id, CASE priority WHEN 1 THEN strftime(submit_time, '%Y') WHEN 2 THEN strftime(submit_time, '%Y-%m') ELSE strftime(submit_time, '%Y-%m-%d') END AS period FROM fx_requests", "fx_requests")
def temporal_display(s, d):
    kind = F.when(F.col("priority") == 1, "year").when(F.col("priority") == 2, "year month").otherwise("date")
    return view(s, d, "fx_requests").select("req_id", naming.period(F.col("submit_time"), kind).alias("period"))


@query("related_counts", "SELECT r.req_id, count(t.task_id) AS n_tasks FROM fx_requests r LEFT JOIN fx_tasks t USING (req_id) GROUP BY r.req_id", "fx_requests", "fx_tasks")
def related_counts(s, d):
    tasks = view(s, d, "fx_tasks").groupBy("req_id").agg(F.count("task_id").alias("n_tasks"))  # counted before the join
    return view(s, d, "fx_requests").select("req_id").join(tasks, "req_id", "left").fillna(0, ["n_tasks"])


@query("dataset_frequency", "SELECT label, count(DISTINCT req_id) AS n FROM fx_tasks GROUP BY label", "fx_tasks")
def dataset_frequency(s, d):
    return view(s, d, "fx_tasks").groupBy("label").agg(F.count_distinct("req_id").alias("n"))


@query("available_tasks", "SELECT count(*) AS n FROM fx_tasks WHERE status = 0", "fx_tasks")
def available_tasks(s, d):
    return view(s, d, "fx_tasks").where("status = 0").agg(F.count(F.lit(1)).alias("n"))


@query("nested_collections", "SELECT fc_id, string_agg(concat(CAST(geom_id AS VARCHAR), ' ', name), '; ' ORDER BY geom_id) AS features FROM fx_features GROUP BY fc_id", "fx_features")
def nested_collections(s, d):
    nested = view(s, d, "fx_features").groupBy("fc_id").agg(F.array_sort(F.collect_list(F.struct("geom_id", "name"))).alias("l"))
    return nested.select("fc_id", F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["geom_id"].cast("string"), x["name"])), "; ").alias("features"))


@query("default_chart", "SELECT source_name, type AS track FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY labels DESC, type) AS k FROM (SELECT source_name, type, count(DISTINCT group_level) AS labels FROM fx_catalog GROUP BY ALL HAVING count(DISTINCT group_level) >= 2)) WHERE k = 1", "fx_catalog")
def default_chart(s, d):
    tracks = view(s, d, "fx_catalog").groupBy("source_name", "type").agg(F.count_distinct("group_level").alias("labels")).where("labels >= 2")
    return control.first_rows(tracks, ["source_name"], [F.desc("labels"), F.asc("type")]).select("source_name", F.col("type").alias("track"))


@query("unique_names", "SELECT id, CASE WHEN k > 1 THEN concat(title, '_', CAST(k - 1 AS VARCHAR)) ELSE title END AS title FROM (SELECT id, title, row_number() OVER (PARTITION BY source_name, title ORDER BY id) AS k FROM fx_catalog)", "fx_catalog")
def unique_names(s, d):
    return naming.unique_names(view(s, d, "fx_catalog"), ["source_name"], "title", "id").select("id", "title")


@query("newest_labels", "SELECT geom_id, concat(array_to_string(list_sort(list(DISTINCT CAST(label AS VARCHAR)), 'DESC')[1:3], ', '), CASE WHEN count(DISTINCT label) > 3 THEN ', ...' ELSE '' END) AS labels FROM fx_tasks GROUP BY geom_id", "fx_tasks")
def newest_labels(s, d):
    return naming.newest_labels(view(s, d, "fx_tasks"), ["geom_id"], "label", 3)


@query("request_results", "SELECT r.req_id, t.task_id, f.name, g.name AS collection FROM fx_requests r LEFT JOIN fx_tasks t USING (req_id) LEFT JOIN fx_features f USING (geom_id) LEFT JOIN fx_strips g ON g.geom_id = f.fc_id", "fx_requests", "fx_tasks", "fx_features", "fx_strips")
def request_results(s, d):
    requests = view(s, d, "fx_requests").select("req_id")
    features = bounded(view(s, d, "fx_features").select("geom_id", "fc_id", "name"))
    collections = bounded(view(s, d, "fx_strips").select(F.col("geom_id").alias("fc_id"), F.col("name").alias("collection")))
    return requests.join(view(s, d, "fx_tasks").select("req_id", "task_id", "geom_id"), "req_id", "left").join(features, "geom_id", "left").join(collections, "fc_id", "left").select("req_id", "task_id", "name", "collection")


@query("feature_parents", "SELECT f.geom_id, p.name AS parent FROM fx_features f LEFT JOIN fx_features p ON p.geom_id = f.fc_id AND f.geom_id <> f.fc_id", "fx_features")
def feature_parents(s, d):
    features = view(s, d, "fx_features")
    parents = bounded(features.select(F.col("geom_id").alias("parent_id"), F.col("name").alias("parent")))
    return features.select("geom_id", F.when(F.col("geom_id") != F.col("fc_id"), F.col("fc_id")).alias("parent_id")).join(parents, "parent_id", "left").select("geom_id", "parent")


@query("cart_covered", "SELECT DISTINCT geom_id, label FROM fx_tasks WHERE geom_id IN (SELECT f.geom_id FROM fx_features f JOIN fx_datasets d ON d.dataset_id = 1 AND d.minx <= f.minx AND d.miny <= f.miny AND d.maxx >= f.maxx AND d.maxy >= f.maxy)", "fx_tasks", "fx_features", "fx_datasets")
def cart_covered(s, d):
    extent = view(s, d, "fx_datasets").where("dataset_id = 1").withColumnsRenamed({c: f"d_{c}" for c in ("minx", "miny", "maxx", "maxy")})
    covered = view(s, d, "fx_features").crossJoin(F.broadcast(extent.limit(1))).where("d_minx <= minx and d_miny <= miny and d_maxx >= maxx and d_maxy >= maxy").select("geom_id")
    return view(s, d, "fx_tasks").select("geom_id", "label").distinct().join(covered, "geom_id", "left_semi")


@query("selection_union", "SELECT geom_id FROM fx_tasks WHERE label = 1995 UNION SELECT geom_id FROM fx_tasks WHERE label = 1996 AND status = 1", "fx_tasks")
def selection_union(s, d):
    tasks = view(s, d, "fx_tasks")
    return tasks.where("label = 1995").select("geom_id").union(tasks.where("label = 1996 and status = 1").select("geom_id")).distinct()


@query("selection_difference", "SELECT req_id FROM fx_tasks WHERE status = 1 EXCEPT SELECT req_id FROM fx_tasks WHERE status = -1", "fx_tasks")
def selection_difference(s, d):
    tasks = view(s, d, "fx_tasks")
    return tasks.where("status = 1").select("req_id").subtract(tasks.where("status = -1").select("req_id"))


@query("selection_toggle", "(SELECT req_id FROM fx_tasks WHERE status = 1 EXCEPT SELECT req_id FROM fx_tasks WHERE status = -1) UNION ALL (SELECT req_id FROM fx_tasks WHERE status = -1 EXCEPT SELECT req_id FROM fx_tasks WHERE status = 1)", "fx_tasks")
def selection_toggle(s, d):
    """In one of two selections, not in both, from one aggregation."""
    both = view(s, d, "fx_tasks").groupBy("req_id").agg(F.bool_or(F.col("status") == 1).alias("a"), F.bool_or(F.col("status") == -1).alias("b"))
    return both.where("a <> b").select("req_id")


@query("queue_two_phase", "SELECT req_id, row_number() OVER (PARTITION BY priority ORDER BY CASE status WHEN -1 THEN 0 ELSE 1 END, submit_time, req_id) AS place FROM fx_requests WHERE status IN (-1, 0)", "fx_requests")
def queue_two_phase(s, d):
    order = Window.partitionBy("priority").orderBy(F.when(F.col("status") == -1, 0).otherwise(1), "submit_time", "req_id")
    return view(s, d, "fx_requests").where("status in (-1, 0)").select("req_id", F.row_number().over(order).cast("long").alias("place"))


@query("autocomplete", "SELECT id, title FROM fx_catalog WHERE starts_with(lower(title), 'la') ORDER BY title, id LIMIT 10", "fx_catalog")
def autocomplete(s, d):
    return view(s, d, "fx_catalog").where(F.startswith(F.lower("title"), F.lit("la"))).orderBy("title", "id").limit(10).select("id", "title")


@query("extent_flags", "SELECT f.geom_id, d.dataset_id, d.minx <= f.maxx AND d.maxx >= f.minx AND d.miny <= f.maxy AND d.maxy >= f.miny AS overlaps FROM fx_features f CROSS JOIN fx_datasets d", "fx_features", "fx_datasets")
def extent_flags(s, d):
    sets = bounded(view(s, d, "fx_datasets").withColumnsRenamed({c: f"d_{c}" for c in ("minx", "miny", "maxx", "maxy")}))
    return view(s, d, "fx_features").crossJoin(sets).select("geom_id", "dataset_id", F.expr("d_minx <= maxx and d_maxx >= minx and d_miny <= maxy and d_maxy >= miny").alias("overlaps"))
