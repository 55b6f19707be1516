"""Queue, request, result, search, usage and chart queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonalspark.functions import scalar
from zonalspark.operators import breaks, charts, control, naming
from zonalspark.sources.fixtures import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{with_views(*views)} {sql}" if views else sql
        return f

    return put


def task_order():
    return [F.desc("float_value"), F.asc("task_id"), F.asc("update_time"), F.asc("geom_id")]


@query("task_candidates", "SELECT req_id, geom_id, label, po_name, count(*) AS n FROM fx_tasks GROUP BY ALL", "fx_tasks")
def task_candidates(s, d):
    return view(s, d, "fx_tasks").groupBy("req_id", "geom_id", "label", "po_name").agg(F.count(F.lit(1)).alias("n"))


@query("task_new_only", "SELECT DISTINCT req_id, geom_id, label, po_name FROM fx_tasks t WHERE NOT EXISTS (SELECT 1 FROM fx_tasks k WHERE k.req_id = t.req_id AND k.geom_id = t.geom_id AND k.label = t.label AND k.po_name = t.po_name AND k.status = 1)", "fx_tasks")
def task_new_only(s, d):
    return control.unmet(view(s, d, "fx_tasks"), ["req_id", "geom_id", "label", "po_name"], F.col("status") == 1)


@query("queue_topk", "SELECT task_id, geom_id, float_value FROM fx_tasks WHERE status = 0 ORDER BY float_value DESC, task_id, update_time, geom_id LIMIT 1000", "fx_tasks")
def queue_topk(s, d):
    return control.queue(view(s, d, "fx_tasks"), 1000, task_order(), F.col("status") == 0).select("task_id", "geom_id", "float_value")


@query("queue_release_stale", "SELECT task_id, CASE WHEN status = -1 AND update_time < TIMESTAMP '1998-01-01' - INTERVAL 30 MINUTE THEN 0 ELSE status END AS status FROM fx_tasks", "fx_tasks")
def queue_release_stale(s, d):
    return control.release_stale(view(s, d, "fx_tasks"), F.expr("timestamp_ntz '1998-01-01'"), 30, -1).select("task_id", "status")


@query("queue_retry", "SELECT task_id, geom_id, CASE WHEN status = -1 THEN 0 ELSE status END AS status, CASE WHEN status = -1 THEN 2 ELSE 1 END AS attempts, CASE WHEN status = -1 THEN TIMESTAMP '2003-01-01' ELSE update_time END AS update_time FROM fx_tasks", "fx_tasks")
def queue_retry(s, d):
    tasks = view(s, d, "fx_tasks").withColumn("attempts", F.lit(1))
    return control.retried(tasks, F.expr("timestamp_ntz '2003-01-01'")).select("task_id", "geom_id", "status", "attempts", "update_time")


@query("request_retry", "SELECT req_id, CASE WHEN status = -2 THEN -1 ELSE status END AS status FROM (SELECT req_id, CASE WHEN priority = 5 THEN -2 ELSE status END AS status FROM fx_requests)", "fx_requests")
def request_retry(s, d):
    rows = view(s, d, "fx_requests").withColumn("status", F.when(F.col("priority") == 5, -2).otherwise(F.col("status")))
    return control.requeued(rows).select("req_id", "status")


@query("request_complete", "SELECT req_id, count(status) AS n_tasks FROM fx_tasks GROUP BY req_id HAVING count(status) = sum(CASE WHEN status = 1 THEN 1 ELSE 0 END)", "fx_tasks")
def request_complete(s, d):
    return control.complete(view(s, d, "fx_tasks")).select("req_id", "n_tasks")


@query("request_queue_order", "SELECT req_id, row_number() OVER (PARTITION BY status ORDER BY priority DESC, submit_time, req_id) AS place FROM fx_requests", "fx_requests")
def request_queue_order(s, d):
    order = [("priority", True), ("submit_time", False), ("req_id", False)]
    return control.places(view(s, d, "fx_requests"), "status", order).select("req_id", "place")


YEARS = list(range(1992, 2003))


@query("result_pivot", "SELECT geom_id, " + ", ".join(f'round(sum(float_value) FILTER (label = {y}), 2) AS "y{y}"' for y in YEARS) + " FROM fx_tasks GROUP BY geom_id", "fx_tasks")
def result_pivot(s, d):
    wide = control.pivoted(view(s, d, "fx_tasks"), ["geom_id"], "label", "float_value", YEARS)
    return wide.select("geom_id", *(F.round(f"`{y}`", 2).alias(f"y{y}") for y in YEARS))


@query("result_decode_union", "SELECT task_id, geom_id, CASE po_name WHEN 'O' THEN CAST(label AS VARCHAR) ELSE CAST(float_value AS VARCHAR) END AS text FROM fx_tasks", "fx_tasks")
def result_decode_union(s, d):
    kind = F.when(F.col("po_name") == "O", "int").otherwise("float")
    rows = view(s, d, "fx_tasks").select("task_id", "geom_id", kind.alias("data_column"), F.col("label").alias("int_value"), "float_value", F.lit(None).cast("string").alias("str_value"))
    return control.decoded(rows).select("task_id", "geom_id", "text")


@query("result_attr_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS boundary_k FROM events")
def result_attr_flatten(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("boundary_k"))


@query("result_columns", "SELECT DISTINCT concat(CAST(label AS VARCHAR), '.', po_name) AS name FROM fx_tasks", "fx_tasks")
def result_columns(s, d):
    return view(s, d, "fx_tasks").select(F.concat_ws(".", F.col("label").cast("string"), "po_name").alias("name")).distinct()


@query("column_groups", "SELECT CAST(label AS VARCHAR) AS resource, array_to_string(list_sort(list(DISTINCT concat(CAST(label AS VARCHAR), '.', po_name))), ',') AS names FROM fx_tasks GROUP BY label", "fx_tasks")
def column_groups(s, d):
    return view(s, d, "fx_tasks").groupBy(F.col("label").cast("string").alias("resource")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(".", F.col("label").cast("string"), "po_name"))), ",").alias("names"))


@query("first_nonempty", "SELECT geom_id, arg_min(po_name, struct_pack(a := task_id, b := update_time, c := po_name)) AS first_name FROM fx_tasks WHERE status <> 0 GROUP BY geom_id", "fx_tasks")
def first_nonempty(s, d):
    return view(s, d, "fx_tasks").where("status <> 0").groupBy("geom_id").agg(F.min_by("po_name", F.struct("task_id", "update_time", "po_name")).alias("first_name"))


@query("search_ilike", "SELECT id, title FROM fx_catalog WHERE title ILIKE '%re%' OR type ILIKE '%BRASS%'", "fx_catalog")
def search_ilike(s, d):
    return view(s, d, "fx_catalog").where(F.col("title").ilike("%re%") | F.col("type").ilike("%BRASS%")).select("id", "title")


def tags():
    return F.split("title", " ")


#: Each names what it asks for; what it leaves out matches anything, and all its tags must be there.
PRESETS = [{"name": "cold", "source_name": "Brand#11", "tags": ["cold"]}, {"name": "level", "group_level": 7}, {"name": "both", "type": "PROMO", "tags": ["small", "widget"]}, {"name": "all", "tags": []}]


@query("preset_match", "SELECT 'cold' AS preset, id FROM fx_catalog WHERE source_name = 'Brand#11' AND list_contains(string_split(title, ' '), 'cold') UNION ALL SELECT 'level', id FROM fx_catalog WHERE group_level = 7 UNION ALL SELECT 'both', id FROM fx_catalog WHERE type = 'PROMO' AND list_contains(string_split(title, ' '), 'small') AND list_contains(string_split(title, ' '), 'widget') UNION ALL SELECT 'all', id FROM fx_catalog", "fx_catalog")
def preset_match(s, d):
    rows = view(s, d, "fx_catalog").withColumn("tags", tags())
    return control.preset_matches(rows, PRESETS, ["source_name", "type", "group_level"], "tags").select("preset", "id")


@query("category_list", "SELECT DISTINCT lower(t) AS tag FROM (SELECT unnest(string_split(title, ' ')) AS t FROM fx_catalog) WHERE t <> ''", "fx_catalog")
def category_list(s, d):
    return view(s, d, "fx_catalog").select(F.explode(tags()).alias("t")).where("t <> ''").select(F.lower("t").alias("tag")).distinct()


@query("group_by_level", "SELECT CASE WHEN group_level > 45 THEN 'Unspecified' ELSE CAST(group_level AS VARCHAR) END AS level, count(*) AS n FROM fx_catalog GROUP BY ALL", "fx_catalog")
def group_by_level(s, d):
    return view(s, d, "fx_catalog").groupBy(F.when(F.col("group_level") > 45, "Unspecified").otherwise(F.col("group_level").cast("string")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("group_by_tag", "SELECT t AS tag, count(DISTINCT id) AS n FROM (SELECT id, unnest(string_split(title, ' ')) AS t FROM fx_catalog) GROUP BY t", "fx_catalog")
def group_by_tag(s, d):
    return view(s, d, "fx_catalog").select("id", F.explode_outer(tags()).alias("tag")).groupBy("tag").agg(F.count_distinct("id").alias("n"))


@query("featured_topk", "SELECT id, val FROM fx_catalog WHERE group_level < 25 ORDER BY val DESC, id LIMIT 12", "fx_catalog")
def featured_topk(s, d):
    return view(s, d, "fx_catalog").where("group_level < 25").orderBy(F.desc("val"), "id").limit(12).select("id", "val")


@query("dataset_order", "SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY title, id) AS place FROM fx_catalog", "fx_catalog")
def dataset_order(s, d):
    return view(s, d, "fx_catalog").select("id", F.row_number().over(Window.partitionBy("source_name").orderBy("title", "id")).cast("long").alias("place"))


@query("options_nested", "SELECT source_name, string_agg(concat(type, ':', CAST(n AS VARCHAR)), '|' ORDER BY type) AS options FROM (SELECT source_name, type, count(*) AS n FROM fx_catalog GROUP BY ALL) GROUP BY source_name", "fx_catalog")
def options_nested(s, d):
    counts = view(s, d, "fx_catalog").groupBy("source_name", "type").agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("o"))
    return nested.select("source_name", F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["type"], x["n"].cast("string"))), "|").alias("options"))


@query("status_groups", "SELECT CASE WHEN status < 0 THEN 'failed' WHEN status = 0 THEN 'waiting' ELSE 'done' END AS grp, count(*) AS n, sum(priority) AS priorities FROM fx_requests GROUP BY ALL", "fx_requests")
def status_groups(s, d):
    return view(s, d, "fx_requests").groupBy(F.expr("case when status < 0 then 'failed' when status = 0 then 'waiting' else 'done' end").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("priorities"))


@query("status_percent", "SELECT status, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM fx_requests GROUP BY status", "fx_requests")
def status_percent(s, d):
    counts = view(s, d, "fx_requests").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("status", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


for unit, form in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
    query(f"requests_by_{unit}", f"SELECT strftime(submit_time, '{form}') AS period, count(*) AS n FROM fx_requests WHERE submit_time IS NOT NULL GROUP BY ALL", "fx_requests")(lambda s, d, unit=unit: control.bucket_counts(view(s, d, "fx_requests"), "submit_time", unit))


@query("users_by_month", "SELECT strftime(submit_time, '%Y-%m') AS period, count(*) AS n, count(DISTINCT contact) AS users FROM fx_requests GROUP BY ALL", "fx_requests")
def users_by_month(s, d):
    return view(s, d, "fx_requests").groupBy(F.date_format("submit_time", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("contact").alias("users"))


WEEK = "CAST(greatest(date_trunc('year', t)::DATE, date_trunc('year', t)::DATE + CAST(floor((dayofyear(t) + 6 - dayofweek(t)) / 7) * 7 - 7 AS INTEGER)) AS VARCHAR)"


@query("week_key", f"SELECT {WEEK} AS week, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS t FROM events) GROUP BY ALL")
def week_key(s, d):
    day = F.to_date("ts")
    return s.read.parquet(f"{d}/events.parquet").groupBy(scalar.week_key(day).cast("string").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("repeat_users_gain", "SELECT period, users, users - lag(users, 1, 0) OVER (ORDER BY period) AS gain FROM (SELECT strftime(t, '%Y-%m') AS period, sum(count(*)) OVER (ORDER BY strftime(t, '%Y-%m')) AS users FROM (SELECT contact, submit_time AS t, row_number() OVER (PARTITION BY contact ORDER BY submit_time, req_id) AS k FROM fx_requests) WHERE k = 2 GROUP BY strftime(t, '%Y-%m'))", "fx_requests")
def repeat_users_gain(s, d):
    """Contacts with a second request by the end of each month, and how many more than the month before. A contact counts
    from its second request on, so months aren't joined with all requests; only months meet in one window."""
    order = Window.partitionBy("contact").orderBy("submit_time", "req_id")
    second = view(s, d, "fx_requests").withColumn("k", F.row_number().over(order)).where("k = 2")
    months = second.groupBy(F.date_format("submit_time", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("new"))
    every = Window.orderBy("period")
    total = months.withColumn("users", F.sum("new").over(every))
    return total.select("period", "users", (F.col("users") - F.lag("users", 1, 0).over(every)).alias("gain"))


@query("contact_outreach", "SELECT contact, count(*) AS n, max(submit_time) AS latest FROM fx_requests GROUP BY contact HAVING count(*) > 5 AND max(submit_time) < TIMESTAMP '2001-06-01' AND sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) = 0", "fx_requests")
def contact_outreach(s, d):
    by = view(s, d, "fx_requests").groupBy("contact").agg(F.count(F.lit(1)).alias("n"), F.max("submit_time").alias("latest"), F.count_if(F.col("status") == 0).alias("flags"))
    return by.where((F.col("n") > 5) & (F.col("latest") < F.expr("timestamp_ntz '2001-06-01'")) & (F.col("flags") == 0)).drop("flags")


@query("contact_exclude_regex", "SELECT c_custkey AS contact FROM customer WHERE NOT regexp_matches(c_name, '0[0-4]$')")
def contact_exclude_regex(s, d):
    return s.read.parquet(f"{d}/customer.parquet").where(~F.col("c_name").rlike("0[0-4]$")).select(F.col("c_custkey").alias("contact"))


VALS = "(SELECT val AS v FROM fx_catalog)"


@query("histogram20", f"SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 20, 6) AS lo, count(v) AS n FROM (SELECT min(v) AS lo, max(v) AS hi FROM {VALS}) m CROSS JOIN range(20) r(b) LEFT JOIN {VALS} x ON least(floor((v - lo) / ((hi - lo) / 20)), 19) = b GROUP BY b, lo, hi", "fx_catalog")
def histogram20(s, d):
    return charts.histogram(view(s, d, "fx_catalog"), "val").select("bin", F.round("lo", 6).alias("lo"), "n")


@query("breaks_quantile", f"SELECT CAST(i AS INTEGER) AS i, v AS cut FROM range(6) r(i) JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM {VALS}) x ON k = CAST(floor(i / 5.0 * (n - 1) + 0.5) AS BIGINT)", "fx_catalog")
def breaks_quantile(s, d):
    return charts.quantile_breaks(view(s, d, "fx_catalog"), "val")


@query("breaks_equal", f"SELECT CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 5, 6) AS cut FROM range(6) r(i) CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM {VALS})", "fx_catalog")
def breaks_equal(s, d):
    return charts.equal_breaks(view(s, d, "fx_catalog"), "val").select("i", F.round("cut", 6).alias("cut"))


BREAKS = [900.0, 1100.0, 1300.0, 1500.0, 2200.0]


@query("class_assign", "SELECT id, CASE WHEN val <= 900 THEN 0 WHEN val <= 1100 THEN 0 WHEN val <= 1300 THEN 1 WHEN val <= 1500 THEN 2 WHEN val <= 2200 THEN 3 ELSE 3 END AS class FROM fx_catalog", "fx_catalog")
def class_assign(s, d):
    return view(s, d, "fx_catalog").select("id", charts.class_of(F.col("val"), BREAKS).alias("class"))


@query("boxplot", "SELECT source_name, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(CASE WHEN val BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN val END) AS low, max(CASE WHEN val BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN val END) AS high, sum(CASE WHEN val BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS n_outliers FROM fx_catalog JOIN (SELECT source_name, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.5) AS median, quantile_cont(val, 0.75) AS q3 FROM fx_catalog GROUP BY source_name) USING (source_name) GROUP BY source_name, q1, median, q3", "fx_catalog")
def boxplot(s, d):
    return charts.box_plot(view(s, d, "fx_catalog"), "source_name", "val").withColumns({k: F.round(k, 4) for k in ("q1", "median", "q3")})


for name, way in (("top15", "DESC"), ("bottom15", "ASC")):
    query(name, f"SELECT id, title, val FROM fx_catalog ORDER BY val {way}, title, id LIMIT 15", "fx_catalog")(lambda s, d, way=way: view(s, d, "fx_catalog").orderBy(F.desc("val") if way == "DESC" else F.asc("val"), "title", "id").limit(15).select("id", "title", "val"))


@query("binary_bar", "SELECT source_name, sum(CASE WHEN group_level % 2 = 1 THEN 1 ELSE 0 END) AS present, sum(CASE WHEN group_level % 2 = 0 THEN 1 ELSE 0 END) AS absent FROM fx_catalog GROUP BY source_name", "fx_catalog")
def binary_bar(s, d):
    v = F.col("group_level") % 2
    return view(s, d, "fx_catalog").groupBy("source_name").agg(F.count_if(v == 1).alias("present"), F.count_if(v == 0).alias("absent"))


@query("detect_binary", "SELECT count(*) > 0 AND bool_and(group_level IN (0, 1)) AS level_binary, count(*) > 0 AND bool_and(group_level % 2 IN (0, 1)) AS parity_binary FROM fx_catalog", "fx_catalog")
def detect_binary(s, d):
    some = F.count(F.lit(1)) > 0
    return view(s, d, "fx_catalog").agg((some & F.bool_and(F.col("group_level").isin(0, 1))).alias("level_binary"), (some & F.bool_and((F.col("group_level") % 2).isin(0, 1))).alias("parity_binary"))


@query("field_track", "SELECT DISTINCT regexp_replace(replace(regexp_replace(regexp_replace(concat('set.', CASE WHEN status = 1 THEN 'Numeric_' WHEN status = 0 THEN 'a_binary_' ELSE '' END, po_name, '_mean_', CAST(label AS VARCHAR)), '^[^.]*\\.', ''), concat('[_.]?', CAST(label AS VARCHAR), '$'), ''), '_', ' '), '^(categorical|binary|numeric|ordinal)\\s+', '', 'i') AS track FROM fx_tasks", "fx_tasks")
def field_track(s, d):
    label = F.col("label").cast("string")
    kind = F.when(F.col("status") == 1, "Numeric_").when(F.col("status") == 0, "a_binary_").otherwise("")
    name = F.concat(F.lit("set."), kind, F.col("po_name"), F.lit("_mean_"), label)
    return view(s, d, "fx_tasks").select(naming.field_track(name, label).alias("track")).distinct()


@query("temporal_series", "SELECT CAST(label AS VARCHAR) AS label, round(avg(val), 4) AS mean, min(val) AS low, max(val) AS high FROM fx_pixels GROUP BY label", "fx_pixels")
def temporal_series(s, d):
    return view(s, d, "fx_pixels").groupBy(F.col("label").cast("string").alias("label")).agg(F.round(F.avg("val"), 4).alias("mean"), F.min("val").alias("low"), F.max("val").alias("high"))


@query("feature_lines50", "SELECT contact, string_agg(concat(CAST(y AS VARCHAR), '=', CAST(n AS VARCHAR)), ',' ORDER BY y) AS line FROM (SELECT contact, year(submit_time) AS y, count(*) AS n FROM fx_requests WHERE contact IN (SELECT DISTINCT contact FROM fx_requests ORDER BY contact LIMIT 50) GROUP BY ALL) GROUP BY contact", "fx_requests")
def feature_lines50(s, d):
    rows = view(s, d, "fx_requests")
    first = rows.select("contact").distinct().orderBy("contact").limit(50)
    counts = rows.join(F.broadcast(first), "contact").groupBy("contact", F.year("submit_time").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    lines = counts.groupBy("contact").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("l"))
    return lines.select("contact", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["y"].cast("string"), x["n"].cast("string"))), ",").alias("line"))


@query("pearson_guarded", "SELECT source_name, round(coalesce(CASE WHEN count(*) < 2 OR stddev_pop(val) = 0 OR stddev_pop(group_level) = 0 THEN 0 ELSE corr(val, group_level) END, 0), 6) AS r, 0.0::DOUBLE AS r_constant FROM fx_catalog GROUP BY source_name", "fx_catalog")
def pearson_guarded(s, d):
    a, b = F.col("val"), F.col("group_level").cast("double")
    return view(s, d, "fx_catalog").groupBy("source_name").agg(F.round(charts.correlation(a, b), 6).alias("r"), charts.correlation(a, F.lit(1.0)).alias("r_constant"))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(c, c) for c in COLS] + [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@query("pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def pearson_matrix(s, d):
    return charts.correlation_matrix(s.read.parquet(f"{d}/lineitem.parquet"), COLS).withColumn("r", F.round("r", 6))


@query("scatter_points", "SELECT id, val AS x, CAST(group_level AS DOUBLE) AS y, dense_rank() OVER (ORDER BY source_name) - 1 AS colour FROM fx_catalog WHERE val IS NOT NULL AND group_level IS NOT NULL", "fx_catalog")
def scatter_points(s, d):
    rows = view(s, d, "fx_catalog").where("val is not null and group_level is not null")
    names = rows.select("source_name").distinct()  # a colour a collection; only their names are put in order
    colours = names.withColumn("colour", F.row_number().over(Window.orderBy("source_name")).cast("long") - 1)
    return rows.join(F.broadcast(colours), "source_name").select("id", F.col("val").alias("x"), F.col("group_level").cast("double").alias("y"), "colour")


@query("partial_columns", "SELECT count(*) AS n, sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS nulls, sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) < count(*) AS partial FROM fx_requests", "fx_requests")
def partial_columns(s, d):
    v = F.when(F.col("status") != 0, F.col("status"))
    return view(s, d, "fx_requests").agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), ((F.count_if(v.isNull()) > 0) & (F.count_if(v.isNull()) < F.count(F.lit(1)))).alias("partial"))


@query("describe_means", "SELECT round(avg(val), 4) AS val, round(avg(group_level), 4) AS group_level, min(val) AS low, max(val) AS high, count(*) AS n FROM fx_catalog", "fx_catalog")
def describe_means(s, d):
    return view(s, d, "fx_catalog").agg(F.round(F.avg("val"), 4).alias("val"), F.round(F.avg("group_level"), 4).alias("group_level"), F.min("val").alias("low"), F.max("val").alias("high"), F.count(F.lit(1)).alias("n"))


for name, text, sql in (("formula_arith", "([val] + 2 * [group_level]) / 4 - 1", "(val + 2 * group_level) / 4 - 1"), ("formula_div_zero", "[val] / ([group_level] - 10)", "val / nullif(group_level - 10, 0)"), ("formula_null", "[val] + [title]", "NULL::DOUBLE")):
    query(name, f"SELECT id, round({sql}, 6) AS v FROM fx_catalog", "fx_catalog")(lambda s, d, text=text: (lambda c: c.select("id", F.round(scalar.formula(text, c.columns), 6).alias("v")))(view(s, d, "fx_catalog")))


@query("year_islands", "SELECT contact, string_agg(CASE WHEN b - a >= 2 THEN concat(CAST(a AS VARCHAR), '-', CAST(b AS VARCHAR)) WHEN b > a THEN concat(CAST(a AS VARCHAR), ', ', CAST(b AS VARCHAR)) ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) AS text FROM (SELECT contact, min(y) AS a, max(y) AS b FROM (SELECT contact, y, y - row_number() OVER (PARTITION BY contact ORDER BY y) AS g FROM (SELECT DISTINCT contact, year(submit_time) AS y FROM fx_requests)) GROUP BY contact, g) GROUP BY contact", "fx_requests")
def year_islands(s, d):
    return control.runs_of_numbers(view(s, d, "fx_requests").withColumn("y", F.year("submit_time")), ["contact"], "y")


@query("mask_parse", "SELECT fname, CAST(substr(fname, 6, 4) AS INTEGER) AS y, CAST(substr(fname, 11, 2) AS INTEGER) AS m FROM fx_files", "fx_files")
def mask_parse(s, d):
    """Year and month from the places where the mask has Y and M."""
    part = lambda c: F.substr("fname", F.instr("mask", c), F.char_length("mask") - F.char_length(F.replace("mask", F.lit(c), F.lit("")))).cast("int")
    return view(s, d, "fx_files").select("fname", part("Y").alias("y"), part("M").alias("m"))


@query("upsert_latest", "SELECT task_id, last.status, last.value AS float_value FROM (SELECT task_id, max({'new': CASE WHEN status = 0 THEN 1 ELSE 0 END, 'value': float_value, 'status': status}) AS last FROM fx_tasks GROUP BY task_id)", "fx_tasks")
def upsert_latest(s, d):
    """Waiting tasks written over a table of the others: of a task in both, the waiting one stays."""
    tasks = view(s, d, "fx_tasks").select("task_id", "status", "float_value")
    return control.upsert(tasks.where("status <> 0"), tasks.where("status = 0"), ["task_id"], [F.desc("float_value"), F.desc("status")])


@query("orphan_delete", "SELECT req_id FROM fx_requests WHERE req_id NOT IN (SELECT req_id FROM fx_tasks)", "fx_requests", "fx_tasks")
def orphan_delete(s, d):
    return control.missing(view(s, d, "fx_requests").select("req_id"), view(s, d, "fx_tasks"), ["req_id"])


@query("dedupe_first", "SELECT task_id, geom_id, label FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY geom_id, label, update_time) AS k FROM fx_tasks) WHERE k = 1", "fx_tasks")
def dedupe_first(s, d):
    return control.first_rows(view(s, d, "fx_tasks"), ["task_id"], [F.asc("geom_id"), F.asc("label"), F.asc("update_time")]).select("task_id", "geom_id", "label")


@query("sha_dedupe", "SELECT sha256(concat(CAST(CAST(minx AS BIGINT) AS VARCHAR), ',', CAST(CAST(miny AS BIGINT) AS VARCHAR))) AS h, min(poly_id) AS poly_id, count(*) AS n FROM fx_polys GROUP BY h", "fx_polys")
def sha_dedupe(s, d):
    text = F.concat_ws(",", F.col("minx").cast("long").cast("string"), F.col("miny").cast("long").cast("string"))
    return view(s, d, "fx_polys").groupBy(F.sha2(text, 256).alias("h")).agg(F.min("poly_id").alias("poly_id"), F.count(F.lit(1)).alias("n"))


@query("label_safe", "SELECT id, substr(trim(regexp_replace(concat(source_name, ' - ', type, '!?'), '[^0-9A-Za-z]+', '_', 'g'), '_'), 1, 32) AS label FROM fx_catalog", "fx_catalog")
def label_safe(s, d):
    return view(s, d, "fx_catalog").select("id", scalar.safe_label(F.concat("source_name", F.lit(" - "), "type", F.lit("!?"))).alias("label"))


@query("slug", "SELECT id, trim(regexp_replace(lower(concat(source_name, ' / ', title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM fx_catalog", "fx_catalog")
def slug(s, d):
    return view(s, d, "fx_catalog").select("id", scalar.slug(F.concat("source_name", F.lit(" / "), "title")).alias("slug"))


@query("text_truncate", "SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(substr(text, 1, 120), '…') ELSE text END AS short, substr(md5(text), 1, 8) AS hash FROM documents")
def text_truncate(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", scalar.truncated(F.col("text")).alias("short"), scalar.short_hash(F.col("text")).alias("hash"))


def jenks_level(k: int) -> str:
    price = "b.best + greatest(0, p.s2 - q.s2 - (p.s1 - q.s1) * (p.s1 - q.s1) / (p.s0 - q.s0))"
    return f"b{k} AS MATERIALIZED (SELECT j, (m).c AS best, (m).i AS prev FROM (SELECT p.j, min({{{{'c': {price}, 'i': b.j}}}}) AS m FROM p JOIN b{k - 1} b ON b.j < p.j JOIN p q ON q.j = b.j GROUP BY p.j))".replace("{{", "{").replace("}}", "}")


@query("jenks5", ", c AS (SELECT CAST(val AS DOUBLE) AS v, count(*) AS w FROM fx_catalog GROUP BY 1), o AS (SELECT v, w, v - (SELECT sum(v * w) / sum(w) FROM c) AS x, row_number() OVER (ORDER BY v) AS j FROM c), p AS MATERIALIZED (SELECT j, v, sum(w) OVER g AS s0, sum(w * x) OVER g AS s1, sum(w * x * x) OVER g AS s2 FROM o WINDOW g AS (ORDER BY j)), b1 AS MATERIALIZED (SELECT j, greatest(0, s2 - s1 * s1 / s0) AS best, 0 AS prev FROM p), " + ", ".join(map(jenks_level, range(2, 6))) + ", e5 AS (SELECT max(j) AS j FROM p), " + ", ".join(f"e{k} AS (SELECT prev AS j FROM b{k + 1} JOIN e{k + 1} USING (j))" for k in range(4, 0, -1)) + " SELECT i, v AS cut FROM (SELECT 0 AS i, 1 AS j " + " ".join(f"UNION ALL SELECT {k}, j FROM e{k}" for k in range(1, 6)) + ") JOIN p USING (j)", "fx_catalog")
def jenks5(s, d):
    return breaks.jenks(view(s, d, "fx_catalog"), "val", 5)
