"""Queries of task upkeep, look-ups, derived fields and reports, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalspark.operators import upkeep
from zonalspark.operators.spatial import bounded, filter_of
from zonalspark.sources.fixtures import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def put(f):
        QUERIES[name], SQL[name] = f, f"{with_views(*views)} {sql}"
        return f

    return put


@query("filter_defaults", "SELECT min(value) AS start_value, max(value) AS end_value, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS selected FROM fx_points", "fx_points")
def filter_defaults(s, d):
    every = F.array_join(F.array_sort(F.collect_set("event_type")), ", ")
    return view(s, d, "fx_points").agg(F.min("value").alias("start_value"), F.max("value").alias("end_value"), every.alias("selected"))


@query("filter_boolean", "SELECT status, count(*) AS n FROM (SELECT status, CASE WHEN contact % 2 = 1 THEN 1 ELSE 0 END AS flag FROM fx_requests) WHERE flag IN (1) GROUP BY status", "fx_requests")
def filter_boolean(s, d):
    flags = view(s, d, "fx_requests").withColumn("flag", (F.col("contact") % 2 == 1).cast("int"))
    return flags.where(filter_of({"flag": {"type": "categorical", "selected": [True]}})).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("active_public", "SELECT id, source_name FROM fx_catalog WHERE group_level > 5 AND val > 910 AND source_name IN (SELECT source_name FROM fx_catalog GROUP BY source_name HAVING max(group_level) >= 48)", "fx_catalog")
def active_public(s, d):
    rows = view(s, d, "fx_catalog")
    active = rows.groupBy("source_name").agg(F.max("group_level").alias("most")).where("most >= 48")
    return rows.where("group_level > 5 and val > 910").select("id", "source_name").join(bounded(active), "source_name", "left_semi").select("id", "source_name")


@query("status_lookup", "SELECT task_id, status FROM fx_tasks WHERE status IN (0, -1) AND req_id IN (1, 2, 3, 5, 8, 13, 21)", "fx_tasks")
def status_lookup(s, d):
    return view(s, d, "fx_tasks").where(F.col("status").isin(0, -1) & F.col("req_id").isin(1, 2, 3, 5, 8, 13, 21)).select("task_id", "status")


@query("user_activity", "SELECT contact, count(*) AS n, sum(CASE WHEN status = 1 THEN 1 ELSE 0 END)::BIGINT AS completed, strftime(min(submit_time), '%Y-%m-%d') AS earliest, strftime(max(submit_time), '%Y-%m-%d') AS latest FROM fx_requests GROUP BY contact", "fx_requests")
def user_activity(s, d):
    day = [F.date_format(f("submit_time"), "yyyy-MM-dd") for f in (F.min, F.max)]
    return view(s, d, "fx_requests").groupBy("contact").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 1).alias("completed"), day[0].alias("earliest"), day[1].alias("latest"))


@query("time_buckets", "SELECT unit, period, count(*) AS n FROM (SELECT 'day' AS unit, strftime(submit_time, '%Y-%m-%d') AS period FROM fx_requests UNION ALL SELECT 'month', strftime(submit_time, '%Y-%m') FROM fx_requests UNION ALL SELECT 'year', strftime(submit_time, '%Y') FROM fx_requests) GROUP BY ALL", "fx_requests")
def time_buckets(s, d):
    return upkeep.periods(view(s, d, "fx_requests"), "submit_time", {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"})


@query("period_join", "SELECT coalesce(a.period, b.period) AS period, requests, results FROM (SELECT strftime(submit_time, '%Y-%m') AS period, count(*) AS requests FROM fx_requests GROUP BY 1) a FULL JOIN (SELECT strftime(update_time, '%Y-%m') AS period, count(*) AS results FROM fx_tasks WHERE status = 1 GROUP BY 1) b ON a.period = b.period", "fx_requests", "fx_tasks")
def period_join(s, d):
    requests = view(s, d, "fx_requests").groupBy(F.date_format("submit_time", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("requests"))
    results = view(s, d, "fx_tasks").where("status = 1").groupBy(F.date_format("update_time", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("results"))
    return requests.join(results, "period", "full")


@query("describe_values", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM fx_points GROUP BY event_type", "fx_points")
def describe_values(s, d):
    found = upkeep.five_numbers(view(s, d, "fx_points"), "event_type", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q1", "q2", "q3")})


@query("resource_naming", "SELECT DISTINCT concat('grid_', coalesce(CAST(nullif(label, 1992) AS VARCHAR), 'none')) AS name FROM fx_pixels", "fx_pixels")
def resource_naming(s, d):
    label = F.nullif("label", F.lit(1992)).cast("string")
    return view(s, d, "fx_pixels").select(F.concat_ws("_", F.lit("grid"), F.coalesce(label, F.lit("none"))).alias("name")).distinct()


@query("dataset_derivation", "SELECT class, min(label) AS first, max(label) AS last, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, CASE WHEN max(label) IS NULL THEN 'Temporally Invariant' ELSE 'Datetime' END AS temporal FROM (SELECT class, x, y, CASE WHEN class <> '5-LOW' THEN label END AS label FROM fx_pixels) GROUP BY class", "fx_pixels")
def dataset_derivation(s, d):
    return upkeep.derived(view(s, d, "fx_pixels"), "class", F.when(F.col("class") != "5-LOW", F.col("label")), "x", "y")


@query("result_encode_union", "SELECT task_id, geom_id, CASE status WHEN 1 THEN 'int' WHEN 0 THEN 'float' ELSE 'str' END AS data_column, CASE WHEN status = 1 THEN CAST(floor(float_value) AS BIGINT) END AS int_value, CASE WHEN status = 0 THEN float_value END AS float_value, CASE WHEN status = -1 THEN 'None' END AS str_value FROM fx_tasks", "fx_tasks")
def result_encode_union(s, d):
    kind, known = F.when(F.col("status") == 1, "int").otherwise("float"), F.when(F.col("status") >= 0, F.when(F.col("status") == 1, F.floor("float_value").cast("double")).otherwise(F.col("float_value")))
    return upkeep.encoded(view(s, d, "fx_tasks"), kind, known, F.lit(None).cast("string")).select("task_id", "geom_id", "data_column", "int_value", "float_value", "str_value")


@query("flag_updates", "SELECT id, CASE WHEN source_name = 'Brand#11' THEN false ELSE group_level > 3 END AS active FROM fx_catalog", "fx_catalog")
def flag_updates(s, d):
    rows = view(s, d, "fx_catalog").withColumn("active", F.col("group_level") > 3)
    return upkeep.flagged(rows, "active", F.col("source_name") == "Brand#11", False).select("id", "active")


@query("heartbeat", "SELECT task_id, geom_id, strftime(CASE WHEN status = -1 THEN greatest(update_time, TIMESTAMP '1997-06-01') ELSE update_time END, '%Y-%m-%d') AS update_day FROM fx_tasks", "fx_tasks")
def heartbeat(s, d):
    beat = F.when(F.col("status") == -1, F.greatest("update_time", F.expr("timestamp_ntz '1997-06-01'"))).otherwise(F.col("update_time"))
    return view(s, d, "fx_tasks").select("task_id", "geom_id", F.date_format(beat, "yyyy-MM-dd").alias("update_day"))


@query("coverage_recheck", "SELECT c.geom_id, c.dataset_id, CASE WHEN status = -1 THEN CASE WHEN d.minx <= f.minx AND d.miny <= f.miny AND d.maxx >= f.maxx AND d.maxy >= f.maxy THEN 1 ELSE 0 END ELSE status END AS status FROM (SELECT DISTINCT geom_id, label % 5 AS dataset_id, CASE WHEN geom_id % 3 = 0 THEN 1 ELSE -1 END AS status FROM fx_tasks) c JOIN fx_features f USING (geom_id) JOIN fx_datasets d USING (dataset_id)", "fx_tasks", "fx_features", "fx_datasets")
def coverage_recheck(s, d):
    known = view(s, d, "fx_tasks").select("geom_id", (F.col("label") % 5).alias("dataset_id")).distinct().withColumn("status", F.when(F.col("geom_id") % 3 == 0, 1).otherwise(-1))
    return upkeep.rechecked(known, view(s, d, "fx_features"), view(s, d, "fx_datasets"))


@query("rate_limit", "SELECT user_id, strftime(period, '%Y-%m-%d %H') AS period, n, greatest(n - 2, 0) AS refused FROM (SELECT user_id, date_trunc('hour', ts) AS period, count(*) AS n FROM fx_points GROUP BY ALL)", "fx_points")
def rate_limit(s, d):
    return upkeep.beyond_limit(view(s, d, "fx_points"), "user_id", "ts", 2).withColumn("period", F.date_format("period", "yyyy-MM-dd HH"))


@query("task_reuse", "SELECT geom_id, label, po_name, min(task_id) AS task_id, count(DISTINCT req_id) AS requests FROM fx_tasks GROUP BY geom_id, label, po_name", "fx_tasks")
def task_reuse(s, d):
    return view(s, d, "fx_tasks").groupBy("geom_id", "label", "po_name").agg(F.min("task_id").alias("task_id"), F.count_distinct("req_id").alias("requests"))


@query("title_fallback", "SELECT id, coalesce(nullif(CASE WHEN group_level % 3 = 0 THEN source_name ELSE '' END, ''), nullif(CASE WHEN group_level % 3 = 1 THEN title END, ''), type, '') AS title FROM fx_catalog", "fx_catalog")
def title_fallback(s, d):
    third = F.col("group_level") % 3
    short, title = F.when(third == 0, F.col("source_name")).otherwise(""), F.when(third == 1, F.col("title"))
    return view(s, d, "fx_catalog").select("id", upkeep.first_filled(short, title, F.col("type")).alias("title"))


@query("legacy_names", "SELECT DISTINCT concat_ws('.', 'grid', CAST(label AS VARCHAR), po_name) AS name FROM fx_tasks", "fx_tasks")
def legacy_names(s, d):
    return view(s, d, "fx_tasks").select(F.concat_ws(".", F.lit("grid"), F.col("label").cast("string"), "po_name").alias("name")).distinct()


@query("history_newest", "SELECT req_id, strftime(submit_time, '%Y-%m-%d') AS submitted FROM fx_requests ORDER BY submit_time DESC, req_id LIMIT 50", "fx_requests")
def history_newest(s, d):
    newest = view(s, d, "fx_requests").select("req_id", "submit_time").orderBy(F.desc("submit_time"), "req_id").limit(50)
    return newest.select("req_id", F.date_format("submit_time", "yyyy-MM-dd").alias("submitted"))


@query("extremes15", "(SELECT id, val, 'top' AS side FROM fx_catalog ORDER BY val DESC, id LIMIT 15) UNION ALL (SELECT id, val, 'bottom' FROM fx_catalog ORDER BY val, id LIMIT 15)", "fx_catalog")
def extremes15(s, d):
    return upkeep.extremes(view(s, d, "fx_catalog").select("id", "val"), "val", "id", 15)


@query("equal_boxes", "SELECT minx, miny, maxx, maxy, min(poly_id) AS kept, count(*) AS n FROM fx_polys GROUP BY ALL", "fx_polys")
def equal_boxes(s, d):
    return view(s, d, "fx_polys").groupBy("minx", "miny", "maxx", "maxy").agg(F.min("poly_id").alias("kept"), F.count(F.lit(1)).alias("n"))


@query("results_geometry", "SELECT t.geom_id, n_f, n_o, minx, miny, maxx, maxy FROM (SELECT geom_id, count(*) FILTER (po_name = 'F') AS n_f, count(*) FILTER (po_name = 'O') AS n_o FROM fx_tasks GROUP BY geom_id) t LEFT JOIN fx_features USING (geom_id)", "fx_tasks", "fx_features")
def results_geometry(s, d):
    wide = view(s, d, "fx_tasks").groupBy("geom_id").agg(*(F.count_if(F.col("po_name") == c).alias(f"n_{c.lower()}") for c in "FO"))
    boxes = bounded(view(s, d, "fx_features").select("geom_id", "minx", "miny", "maxx", "maxy"))
    return wide.join(boxes, "geom_id", "left")


@query("collections_behind", "SELECT f.fc_id, count(DISTINCT t.geom_id) AS features FROM fx_tasks t JOIN fx_features f USING (geom_id) WHERE t.req_id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34) GROUP BY f.fc_id", "fx_tasks", "fx_features")
def collections_behind(s, d):
    chosen = view(s, d, "fx_tasks").where(F.col("req_id").isin(1, 2, 3, 4, 5, 6, 7, 32, 33, 34)).select("geom_id").distinct()
    features = bounded(view(s, d, "fx_features").select("geom_id", "fc_id"))
    return chosen.join(features, "geom_id").groupBy("fc_id").agg(F.count("geom_id").alias("features"))


@query("boundary_levels", "SELECT id, CASE WHEN group_level % 4 = 0 THEN 'parent' ELSE 'child' END AS group_class, group_level % 4 AS level FROM fx_catalog", "fx_catalog")
def boundary_levels(s, d):
    kind = F.concat(F.lit("ADM"), (F.col("group_level") % 4).cast("string"))
    return view(s, d, "fx_catalog").select("id", F.when(kind == "ADM0", "parent").otherwise("child").alias("group_class"), F.substr(kind, F.lit(4)).cast("int").alias("level"))


@query("preset_order", "SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY coalesce(nullif(group_level, 7), 999), id) AS place FROM fx_catalog", "fx_catalog")
def preset_order(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("source_name").orderBy(F.coalesce(F.nullif("group_level", F.lit(7)), F.lit(999)), "id")
    return view(s, d, "fx_catalog").select("id", F.row_number().over(order).cast("long").alias("place"))
