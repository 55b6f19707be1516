"""Queries of joins behind queues and results, details of datasets, searches, orders and texts, each with the SQL that
gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalspark.functions import scalar
from zonalspark.operators import charts, control
from zonalspark.operators.spatial import bounded, covered
from zonalspark.sources.fixtures import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def put(f):
        QUERIES[name], SQL[name] = f, f"{with_views(*views)} {sql}" if views else sql
        return f

    return put


HOLDS = "e.minx <= f.minx AND e.miny <= f.miny AND e.maxx >= f.maxx AND e.maxy >= f.maxy"


@query("candidate_joins", f"SELECT r.resource_id, f.geom_id, o.po_id FROM fx_features f JOIN fx_datasets e ON {HOLDS} JOIN fx_collections c ON c.fc_id = f.fc_id JOIN fx_resources r ON r.dataset_id = e.dataset_id JOIN fx_options o ON o.dataset_id = e.dataset_id JOIN fx_sets d ON d.dataset_id = e.dataset_id WHERE o.active AND c.active AND NOT c.is_user_upload AND d.active", "fx_features", "fx_datasets", "fx_collections", "fx_resources", "fx_options", "fx_sets")
def candidate_joins(s, d):
    return control.candidates(covered(view(s, d, "fx_features"), view(s, d, "fx_datasets")), *(view(s, d, f"fx_{n}") for n in ("features", "collections", "resources", "options", "sets")))


KEYED = "SELECT *, (label % 5) * 10000 + label AS resource_id, (label % 5) * 10 + CASE po_name WHEN 'O' THEN 0 ELSE 2 END AS po_id FROM fx_tasks"


def keyed_tasks(s, d):
    dataset = F.col("label") % 5
    return view(s, d, "fx_tasks").withColumns({"resource_id": dataset * 10000 + F.col("label"), "po_id": dataset * 10 + F.when(F.col("po_name") == "O", 0).otherwise(2)})


CATALOGUE = "LEFT JOIN fx_features f ON f.geom_id = t.geom_id LEFT JOIN fx_collections c ON c.fc_id = f.fc_id LEFT JOIN fx_resources r ON r.resource_id = t.resource_id LEFT JOIN fx_sets d ON d.dataset_id = r.dataset_id LEFT JOIN fx_options o ON o.po_id = t.po_id"
CATALOGUE_VIEWS = ("fx_tasks", "fx_features", "fx_collections", "fx_resources", "fx_sets", "fx_options")


def with_catalogue(tasks, s, d):
    """tasks with their feature, collection, resource, dataset and option; what is unknown is null. All five sides are catalogue
    tables, broadcast behind a check of their size."""
    features = view(s, d, "fx_features").select("geom_id", "fc_id", F.col("name").alias("feature"))
    collections = view(s, d, "fx_collections").select("fc_id", F.col("active").alias("c_active"), F.col("name").alias("collection"))
    resources = view(s, d, "fx_resources").select("resource_id", "dataset_id", F.col("label").alias("resource"))
    sets = view(s, d, "fx_sets").select("dataset_id", F.col("active").alias("d_active"), F.col("name").alias("dataset"), "title")
    options = view(s, d, "fx_options").select("po_id", F.col("active").alias("o_active"), "short_name")
    out = tasks
    for side, key in ((features, "geom_id"), (collections, "fc_id"), (resources, "resource_id"), (sets, "dataset_id"), (options, "po_id")):
        out = out.join(bounded(side), key, "left")
    return out


@query("queue_joins", f"SELECT t.task_id, t.geom_id, f.name AS feature, d.name AS dataset, r.label AS resource, o.short_name FROM (SELECT * FROM ({KEYED}) WHERE status = 0 ORDER BY float_value DESC, task_id, update_time, geom_id LIMIT 1000) t {CATALOGUE} WHERE c.active AND d.active AND o.active", *CATALOGUE_VIEWS)
def queue_joins(s, d):
    """The first thousand waiting tasks with all that working on them needs, if nothing about them is inactive."""
    order = [F.desc("float_value"), F.asc("task_id"), F.asc("update_time"), F.asc("geom_id")]
    first = control.queue(keyed_tasks(s, d), 1000, order, F.col("status") == 0)
    return with_catalogue(first, s, d).where("c_active and d_active and o_active").select("task_id", "geom_id", "feature", "dataset", "resource", "short_name")


@query("request_joins", f"SELECT q.req_id, t.task_id, t.float_value, f.name AS feature, c.name AS collection, r.label AS resource, d.name AS dataset, o.short_name FROM fx_requests q LEFT JOIN ({KEYED}) t ON t.req_id = q.req_id {CATALOGUE}", "fx_requests", *CATALOGUE_VIEWS)
def request_joins(s, d):
    """All results of all requests with what they are of."""
    tasks = keyed_tasks(s, d).drop("label", "status")
    requests = view(s, d, "fx_requests").select("req_id")
    return with_catalogue(requests.join(tasks, "req_id", "left"), s, d).select("req_id", "task_id", "float_value", "feature", "collection", "resource", "dataset", "short_name")


@query("payload_groups", f"SELECT coalesce(d.title, d.name) AS title, concat(r.label, '.', o.short_name) AS col, count(*) AS n, count(DISTINCT t.geom_id) AS features FROM ({KEYED}) t {CATALOGUE} WHERE t.status = 1 AND r.resource_id IS NOT NULL GROUP BY ALL", *CATALOGUE_VIEWS)
def payload_groups(s, d):
    """Columns with a time label, by their dataset's title (its name where it has none)."""
    rows = with_catalogue(keyed_tasks(s, d).where("status = 1"), s, d).where("resource is not null")
    return rows.groupBy(F.coalesce("title", "dataset").alias("title"), F.concat_ws(".", "resource", "short_name").alias("col")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("geom_id").alias("features"))


@query("dataset_detail", "SELECT d.dataset_id, (SELECT string_agg(label, ',' ORDER BY label) FROM fx_resources r WHERE r.dataset_id = d.dataset_id) AS resources, (SELECT string_agg(short_name, ',' ORDER BY short_name) FROM fx_options o WHERE o.dataset_id = d.dataset_id AND active AND public) AS extract_types, CASE WHEN dataset_id = 0 THEN '{\"k\":1}' END AS filters, CASE WHEN dataset_id = 0 THEN '[\"a\",\"b\"]' END AS outcomes FROM fx_sets d", "fx_sets", "fx_resources", "fx_options")
def dataset_detail(s, d):
    resources = view(s, d, "fx_resources").groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("resources"))
    options = view(s, d, "fx_options").where("active and public").groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_list("short_name")), ",").alias("extract_types"))
    sets = view(s, d, "fx_sets").select("dataset_id", *(F.get_json_object("other", f"$.{k}").alias(k) for k in ("filters", "outcomes")))
    return sets.join(bounded(resources), "dataset_id", "left").join(bounded(options), "dataset_id", "left").select("dataset_id", "resources", "extract_types", "filters", "outcomes")


@query("dataset_search", "SELECT id FROM fx_catalog WHERE list_contains(string_split(title, ' '), 'cold') AND (contains(lower(CASE WHEN group_level % 2 = 0 THEN type ELSE source_name END), 'o') OR list_contains(list_transform(string_split(lower(title), ' '), lambda t: contains(t, 'rod')), true))", "fx_catalog")
def dataset_search(s, d):
    """Those of a category that is one of their tags, whose title, or name where they have none, or any tag holds a text."""
    shown = F.coalesce(F.when(F.col("group_level") % 2 == 0, F.col("type")), "source_name")
    tags = F.split("title", " ")
    return view(s, d, "fx_catalog").where(F.array_contains(tags, "cold") & (F.contains(F.lower(shown), F.lit("o")) | F.exists(tags, lambda t: F.contains(F.lower(t), F.lit("rod"))))).select("id")


@query("featured_tagged", "SELECT id, title FROM fx_catalog WHERE list_contains(string_split(title, ' '), 'small') ORDER BY val DESC, id LIMIT 3", "fx_catalog")
def featured_tagged(s, d):
    return view(s, d, "fx_catalog").where(F.array_contains(F.split("title", " "), "small")).orderBy(F.desc("val"), "id").limit(3).select("id", "title")


@query("category_display", "SELECT DISTINCT tag, array_to_string(list_transform(string_split(replace(tag, '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS display FROM (SELECT unnest([lower(concat(type, '_', string_split(title, ' ')[1])), string_split(title, ' ')[2]]) AS tag FROM fx_catalog WHERE group_level > 10)", "fx_catalog")
def category_display(s, d):
    """Distinct tags of rows that have any; level 10 and below stands for none, 3 and below for null."""
    own = F.array(F.lower(F.concat("type", F.lit("_"), F.get(F.split("title", " "), 0))), F.get(F.split("title", " "), 1))
    tags = F.when(F.col("group_level") > 10, own).when(F.col("group_level") > 3, F.array().cast("array<string>"))
    rows = view(s, d, "fx_catalog").withColumn("tags", tags).where("tags is not null and size(tags) > 0")
    return rows.select(F.explode("tags").alias("tag")).distinct().select("tag", scalar.title_case(F.col("tag")).alias("display"))


@query("hidden_collections", "SELECT CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 5, 6) AS cut FROM range(6) r(i) CROSS JOIN (SELECT min(val) AS lo, max(val) AS hi FROM fx_catalog WHERE NOT source_name IN ('Brand#1', 'Brand#11'))", "fx_catalog")
def hidden_collections(s, d):
    visible = view(s, d, "fx_catalog").where(~F.col("source_name").isin("Brand#1", "Brand#11"))
    return charts.equal_breaks(visible, "val").select("i", F.round("cut", 6).alias("cut"))


@query("outreach_window", "SELECT contact, count(*) AS n FROM fx_requests GROUP BY contact HAVING count(*) > 5 AND sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN priority = 1 THEN 1 ELSE 0 END) = 0 AND TIMESTAMP '2002-01-01' - min(submit_time) > INTERVAL 2000 DAY AND TIMESTAMP '2002-01-01' - max(submit_time) > INTERVAL 100 DAY", "fx_requests")
def outreach_window(s, d):
    """More than five requests, nothing flagged, the first and the last long enough ago."""
    by = view(s, d, "fx_requests").groupBy("contact").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") == 0) | (F.col("priority") == 1)).alias("flags"), F.min("submit_time").alias("first"), F.max("submit_time").alias("last"))
    before = lambda days: F.expr(f"timestamp_ntz '2002-01-01' - interval {days} days")
    return by.where((F.col("n") > 5) & (F.col("flags") == 0) & (F.col("first") < before(2000)) & (F.col("last") < before(100))).select("contact", "n")


@query("boxplot_outliers", "SELECT event_type, value FROM fx_points JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM fx_points GROUP BY event_type) USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)", "fx_points")
def boxplot_outliers(s, d):
    """A row for each value beyond the whiskers; groups' lists of them aren't gathered."""
    rows = view(s, d, "fx_points")
    ends = charts.box_plot(rows, "event_type", "value").select("event_type", "low", "high")
    return rows.select("event_type", "value").join(bounded(ends), "event_type").where("value < low or value > high").select("event_type", "value")


@query("null_as_zero", "SELECT source_name, round(avg(coalesce(v, 0)), 4) AS mean_zero, count(*) AS n_zero, round(avg(v), 4) AS mean_known, count(v) AS n_known FROM (SELECT source_name, CASE WHEN group_level % 5 <> 0 THEN val END AS v FROM fx_catalog WHERE group_level % 7 <> 0) GROUP BY source_name", "fx_catalog")
def null_as_zero(s, d):
    """Two readings of a field of a record: a null counts as 0 in one kind of chart and isn't counted in the other; what has no
    such field is in neither."""
    level = F.col("group_level")
    fields = F.when(level % 7 != 0, F.create_map(F.lit("v"), F.when(level % 5 != 0, F.col("val")))).otherwise(F.create_map().cast("map<string,double>"))
    there = F.map_contains_key("fields", "v")
    v = F.try_element_at("fields", F.lit("v"))
    zero = F.when(there, F.coalesce(v, F.lit(0.0)))
    rows = view(s, d, "fx_catalog").withColumn("fields", fields).where(there)
    return rows.groupBy("source_name").agg(F.round(F.avg(zero), 4).alias("mean_zero"), F.count(zero).alias("n_zero"), F.round(F.avg(v), 4).alias("mean_known"), F.count(v).alias("n_known"))


@query("label_runs", "SELECT contact, CASE WHEN bool_and(l NOT LIKE '%x') THEN string_agg(CASE WHEN b - a >= 2 THEN concat(CAST(a AS VARCHAR), '-', CAST(b AS VARCHAR)) WHEN b > a THEN concat(CAST(a AS VARCHAR), ', ', CAST(b AS VARCHAR)) ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) FILTER (k = 1) ELSE string_agg(l, ', ' ORDER BY l) END AS text FROM (SELECT contact, l, min(y) OVER (PARTITION BY contact, g) AS a, max(y) OVER (PARTITION BY contact, g) AS b, row_number() OVER (PARTITION BY contact, g ORDER BY y, l) AS k FROM (SELECT contact, l, y, y - row_number() OVER (PARTITION BY contact ORDER BY y, l) AS g FROM (SELECT DISTINCT contact, year(submit_time) AS y, CASE WHEN contact % 3 = 0 AND priority = 1 THEN concat(CAST(year(submit_time) AS VARCHAR), 'x') ELSE CAST(year(submit_time) AS VARCHAR) END AS l FROM fx_requests))) GROUP BY contact", "fx_requests")
def label_runs(s, d):
    year = F.year("submit_time").cast("string")
    label = F.when((F.col("contact") % 3 == 0) & (F.col("priority") == 1), F.concat(year, F.lit("x"))).otherwise(year)
    return control.runs_of_labels(view(s, d, "fx_requests").withColumn("l", label), ["contact"], "l")


@query("dataset_newest", "SELECT id, row_number() OVER (PARTITION BY type ORDER BY val DESC, id) AS place FROM fx_catalog", "fx_catalog")
def dataset_newest(s, d):
    """Place of each within its type, the latest first, counted range by range."""
    return control.places(view(s, d, "fx_catalog"), "type", [("val", True), ("id", False)]).select("id", "place")


@query("queue_phases", "SELECT req_id, row_number() OVER (ORDER BY CASE status WHEN -1 THEN 0 ELSE 1 END, priority DESC, submit_time, req_id) AS place FROM fx_requests WHERE status IN (-1, 0)", "fx_requests")
def queue_phases(s, d):
    return control.in_phases(view(s, d, "fx_requests"))


@query("selection_merge", "SELECT geom_id, 0 AS part, min(req_id) AS req_id FROM fx_tasks WHERE label = 1995 AND po_name = 'F' GROUP BY geom_id UNION ALL SELECT geom_id, 1, min(req_id) FROM fx_tasks WHERE label = 1996 AND geom_id NOT IN (SELECT geom_id FROM fx_tasks WHERE label = 1995 AND po_name = 'F') GROUP BY geom_id", "fx_tasks")
def selection_merge(s, d):
    tasks = view(s, d, "fx_tasks")
    first, second = (tasks.where(w).groupBy("geom_id").agg(F.min("req_id").alias("req_id")) for w in ("label = 1995 and po_name = 'F'", "label = 1996"))
    return control.merged_selection(first, second, "geom_id", "req_id")


SMALL = "WHEN round(abs(v), 3) >= 1 THEN printf('%.2f', v) " + " ".join(f"WHEN round(abs(v), {k + 2}) >= 1e-{k} THEN printf('%.{k + 2}f', v)" for k in range(1, 7))
TINY = "concat(CASE WHEN v < 0 THEN '-' ELSE '' END, CASE WHEN round(abs(v) * pow(10, -floor(log10(abs(v)))), 2) >= 10 THEN concat('1.00e', (floor(log10(abs(v))) + 1)::BIGINT) ELSE concat(printf('%.2f', abs(v) * pow(10, -floor(log10(abs(v))))), 'e', floor(log10(abs(v)))::BIGINT) END)"


@query("number_text", f"SELECT id, k, CASE WHEN v IS NULL THEN '—' WHEN abs(v) >= 10000 THEN format('{{:,.0f}}', v) WHEN abs(v) >= 100 THEN printf('%.1f', v) WHEN abs(v) >= 1 THEN printf('%.3f', v) WHEN v = 0 THEN '0' {SMALL} ELSE {TINY} END AS text FROM (SELECT id, k, CASE WHEN group_level = k THEN 0 WHEN group_level = k + 1 THEN NULL WHEN group_level = k + 2 THEN 0.9999 * pow(10, -k) ELSE (val / 7 + 0.000123) * pow(10, 2 - k) * CASE WHEN group_level % 2 = 0 THEN -1 ELSE 1 END END AS v FROM fx_catalog CROSS JOIN (SELECT unnest(range(12)) AS k))", "fx_catalog")
def number_text(s, d):
    level, k = F.col("group_level"), F.col("k")
    v = F.when(level == k, 0.0).when(level == k + 1, None).when(level == k + 2, 0.9999 * F.pow(F.lit(10.0), -k)).otherwise((F.col("val") / 7 + 0.000123) * F.pow(F.lit(10.0), 2 - k) * F.when(level % 2 == 0, -1).otherwise(1))
    rows = view(s, d, "fx_catalog").select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    return rows.select("id", "k", scalar.number_text(v).alias("text"))


ODD = "concat('<', title, ' & \"', type, '\" it''s>')"


@query("text_escapes", f"SELECT id, replace(replace(replace(replace(replace({ODD}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, substr(concat('ValueError(''', repeat({ODD}, 4), ''')'), 1, 100) AS error FROM fx_catalog", "fx_catalog")
def text_escapes(s, d):
    odd = F.concat(F.lit("<"), "title", F.lit(' & "'), "type", F.lit("\" it's>"))
    return view(s, d, "fx_catalog").select("id", scalar.html_escaped(odd).alias("escaped"), scalar.error_text(F.lit("ValueError"), F.repeat(odd, 4)).alias("error"))


@query("link_styles", "SELECT id, CASE WHEN group_level % 3 = 0 THEN '' WHEN group_level % 3 = 1 THEN concat('http://', type, '.example') ELSE concat('https://', type, '.example') END AS url, ['red', 'green', 'blue'][((group_level - 10) % 3 + 3) % 3 + 1] AS colour, CAST(CASE WHEN group_level % 6 = 5 THEN 1.5 ELSE greatest(0.75, 4.5 - (group_level % 6) * 0.5) END AS DOUBLE) AS width FROM fx_catalog", "fx_catalog")
def link_styles(s, d):
    third = F.col("group_level") % 3
    address = F.concat(F.when(third == 1, "http://").otherwise(""), "type", F.lit(".example"))
    return view(s, d, "fx_catalog").select("id", scalar.absolute_url(F.when(third != 0, address)).alias("url"), scalar.cycled(F.col("group_level") - 10, ["red", "green", "blue"]).alias("colour"), scalar.line_width(F.col("group_level") % 6).cast("double").alias("width"))


@query("boundary_items", "SELECT iso, concat('ADM', level) AS kind, level, CASE WHEN level = 0 THEN 'parent' ELSE 'child' END AS group_class FROM (SELECT upper(substr(n_name, 1, 3)) AS iso, n_regionkey AS level, n_name FROM nation) WHERE length(n_name) > 5 AND NOT n_name LIKE 'I%' AND level < 4")
def boundary_items(s, d):
    """Items that have both a layer and its description, of countries asked for, from the names of files alone."""
    nation = s.read.parquet(f"{d}/nation.parquet")
    stem = F.concat(F.lit("boundaries-"), F.upper(F.substring("n_name", 1, 3)), F.lit("-ADM"), F.col("n_regionkey").cast("string"))
    layers = nation.where("char_length(n_name) > 5").select(F.concat(stem, F.lit(".gpkg")).alias("fname"), "n_nationkey")
    said = nation.where("n_name not like 'I%'").select(F.concat(F.lit("raw_"), stem, F.lit(".json")).alias("fname"), "n_nationkey")
    own = lambda f: f.select(F.regexp_extract("fname", r"^(?:raw_)?(.*)\.(?:gpkg|json)$", 1).alias("stem"), "n_nationkey")
    items = own(layers).join(own(said), ["stem", "n_nationkey"]).withColumn("part", F.split("stem", "-"))
    kind = F.element_at("part", 3)
    level = F.substr(kind, F.lit(4)).cast("int")
    return items.select(F.element_at("part", 2).alias("iso"), kind.alias("kind"), level.alias("level"), F.when(level == 0, "parent").otherwise("child").alias("group_class")).where("level < 4")


@query("dataset_kinds", "SELECT class, arg_min(kind, label) AS kind FROM (SELECT class, label, CASE WHEN label % 2 = 0 THEN 'year' ELSE 'year month' END AS kind FROM fx_pixels) GROUP BY class", "fx_pixels")
def dataset_kinds(s, d):
    """The kind of label of each dataset's first resource."""
    kind = F.when(F.col("label") % 2 == 0, "year").otherwise("year month")
    return view(s, d, "fx_pixels").groupBy("class").agg(F.min_by(kind, "label").alias("kind"))
