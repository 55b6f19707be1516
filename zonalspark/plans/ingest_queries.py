"""Queries of sources, uploads, written tables, regions and named statistics, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from zonalspark.operators import geometry as G
from zonalspark.operators import ingest, overlay, processors, regions, shapes
from zonalspark.sources.fixtures import view, with_views
from zonalspark.sources.shared import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def put(f):
        QUERIES[name], SQL[name] = f, f"{with_views(*views)} {sql}" if views else sql
        return f

    return put


@query("mask_kinds", "SELECT fname, mask, CASE kind WHEN 0 THEN strftime(day, '%Y') WHEN 1 THEN strftime(day, '%Y%m') WHEN 2 THEN strftime(day, '%Y%m%d') WHEN 3 THEN strftime(day, '%Y%j') END AS label, CASE kind WHEN 0 THEN strftime(day, '%Y-01-01') WHEN 1 THEN strftime(day, '%Y-%m-01') WHEN 2 THEN strftime(day, '%Y-%m-%d') WHEN 3 THEN strftime(day, '%Y-%m-%d') END AS temporal, CASE kind WHEN 0 THEN 'year' WHEN 1 THEN 'year month' WHEN 2 THEN 'year month day' WHEN 3 THEN 'day of year' END AS kind, CASE kind WHEN 4 THEN 'no year' WHEN 5 THEN 'year' END AS problem FROM fx_dated", "fx_dated")
def mask_kinds(s, d):
    return ingest.dated(view(s, d, "fx_dated").select("fname", "mask")).withColumn("temporal", F.col("temporal").cast("string"))


@query("file_discovery", "SELECT fname, CAST(strftime(o_orderdate, '%Y%m') AS VARCHAR) AS label, count(*) AS n FROM (SELECT *, concat('grid_', strftime(o_orderdate, '%Y_%m'), '.tif') AS fname FROM orders) GROUP BY ALL")
def file_discovery(s, d):
    """A folder for each month's orders, as text; what is found there by name, dated by the mask, with the lines it holds."""
    at = f"{shared_dir(s)}/discovery-{uuid.uuid4().hex}"
    orders = s.read.parquet(f"{d}/orders.parquet")
    orders.select(F.concat(F.lit("grid_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit(".tif")).alias("fname"), F.col("o_orderkey").cast("string").alias("value")).repartition("fname").write.partitionBy("fname").text(at)
    found = ingest.discovered(s, at, ".txt", "grid_YYYY_MM.tif").select(F.element_at(F.split("path", "/"), -2).alias("folder"))
    names = found.select(F.substring_index("folder", "=", -1).alias("fname"), F.lit("grid_YYYY_MM.tif").alias("mask")).distinct()
    lines = s.read.text(at).groupBy("fname").agg(F.count(F.lit(1)).alias("n"))
    return ingest.dated(names).join(lines, "fname").select("fname", "label", "n")


MODES = ("insert", "update", "update_or_insert")


@query("ingest_modes", "SELECT m AS mode, id, CASE m WHEN 'insert' THEN CASE WHEN group_level <= 30 THEN 'refused' ELSE 'inserted' END WHEN 'update' THEN CASE WHEN group_level <= 30 THEN 'updated' ELSE 'refused' END ELSE CASE WHEN group_level <= 30 THEN 'updated' ELSE 'inserted' END END AS action FROM fx_catalog, (SELECT unnest(['insert', 'update', 'update_or_insert']) AS m) WHERE group_level >= 20", "fx_catalog")
def ingest_modes(s, d):
    rows = view(s, d, "fx_catalog")
    current, changes = rows.where("group_level <= 30").select("id"), rows.where("group_level >= 20").select("id")
    every = [ingest.written(current, changes, ["id"], m).select(F.lit(m).alias("mode"), "id", "action") for m in MODES]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("collection_modes", "SELECT 'skip_existing' AS mode, fc_id, geom_id, name FROM fx_features WHERE fc_id < 3 UNION ALL SELECT 'skip_existing', fc_id, geom_id + 10, lower(name) FROM fx_features WHERE fc_id > 2 UNION ALL SELECT 'replace_features', fc_id, geom_id, name FROM fx_features WHERE fc_id < 2 UNION ALL SELECT 'replace_features', fc_id, geom_id + 10, lower(name) FROM fx_features WHERE fc_id > 1 UNION ALL SELECT 'update_features', fc_id, geom_id, arg_max(name, k) FROM (SELECT fc_id, geom_id, name, 0 AS k FROM fx_features WHERE fc_id < 3 UNION ALL SELECT fc_id, geom_id + 10, lower(name), 1 FROM fx_features WHERE fc_id > 1) GROUP BY fc_id, geom_id", "fx_features")
def collection_modes(s, d):
    rows = view(s, d, "fx_features").select("fc_id", "geom_id", "name")
    current, changes = rows.where("fc_id < 3"), rows.where("fc_id > 1").select("fc_id", (F.col("geom_id") + 10).alias("geom_id"), F.lower("name").alias("name"))
    every = [ingest.collection_written(current, changes, "fc_id", "geom_id", m).select(F.lit(m).alias("mode"), "fc_id", "geom_id", "name") for m in ("skip_existing", "replace_features", "update_features")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("mapping_sync", "SELECT source_name, title, min(id) AS value FROM fx_catalog WHERE NOT source_name IN (SELECT source_name FROM fx_catalog WHERE group_level = 50) GROUP BY ALL UNION ALL SELECT source_name, upper(title), max(id) FROM fx_catalog WHERE group_level = 50 GROUP BY source_name, upper(title)", "fx_catalog")
def mapping_sync(s, d):
    rows = view(s, d, "fx_catalog")
    current = rows.groupBy("source_name", "title").agg(F.min("id").alias("value"))
    changes = rows.where("group_level = 50").groupBy("source_name", F.upper("title").alias("title")).agg(F.max("id").alias("value"))
    return ingest.replaced(current, changes, ["source_name"])


@query("request_script", "SELECT geom_id, label, coalesce(w.priority, t.priority) AS priority FROM (SELECT geom_id, label, max(0) AS priority FROM fx_tasks WHERE status = 0 GROUP BY ALL) t FULL JOIN (SELECT geom_id, label, max(CAST(label % 3 AS INTEGER) + 1) AS priority FROM fx_tasks WHERE status = 1 GROUP BY ALL) w USING (geom_id, label)", "fx_tasks")
def request_script(s, d):
    tasks = view(s, d, "fx_tasks")
    known = tasks.where("status = 0").select("geom_id", "label").distinct().withColumn("priority", F.lit(0))
    wanted = tasks.where("status = 1").select("geom_id", "label", ((F.col("label") % 3).cast("int") + 1).alias("priority"))
    return ingest.prioritised(known, wanted, ["geom_id", "label"])


@query("cascade_delete", "SELECT geom_id FROM fx_features WHERE fc_id IN (SELECT fc_id FROM fx_collections WHERE active) UNION SELECT geom_id FROM (SELECT geom_id + 1 AS geom_id, fc_id FROM fx_features WHERE geom_id < 24) WHERE fc_id IN (SELECT fc_id FROM fx_collections WHERE active)", "fx_features", "fx_collections")
def cascade_delete(s, d):
    """Features are also held by the collection of the feature before them."""
    features = view(s, d, "fx_features").select("geom_id", "fc_id")
    members = features.union(features.where("geom_id < 24").select((F.col("geom_id") + 1).alias("geom_id"), "fc_id"))
    return ingest.cascaded(view(s, d, "fx_collections"), members, features.select("geom_id"), ~F.col("active"))[2]


@query("upload_names", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'one' WHEN event_type = 'view' THEN 'TWO' END AS name FROM events WHERE event_type <> 'error' AND event_type <> 'signup'")
def upload_names(s, d):
    """Kinds of events stand for: a name, only a NAME (the name is empty), no name, no geometry, another kind of geometry."""
    said = {"click": {"name": "one", "NAME": "x"}, "view": {"name": "", "NAME": "TWO"}, "purchase": {"other": "y"}}
    at = F.col("event_type")
    properties = F.coalesce(*(F.when(at == k, F.create_map(*(F.lit(x) for pair in v.items() for x in pair))) for k, v in said.items()))
    kind = F.when(at == "error", None).when(at == "signup", "GeometryCollection").otherwise("Polygon")
    return ingest.uploaded(s.read.parquet(f"{d}/events.parquet").select("event_id", properties.alias("properties"), kind.alias("geometry_type"))).select("event_id", "name")


@query("upload_checks", "SELECT poly_id, CASE WHEN amount < 0 THEN 'no geometry' WHEN amount < 1000 THEN 'kind' WHEN poly_id < 200 AND (minx * 4 < -180 OR maxx * 4 > 180 OR miny * 2 < -90 OR maxy * 2 > 90) THEN 'coordinates' END AS problem FROM fx_polys", "fx_polys")
def upload_checks(s, d):
    rows = view(s, d, "fx_polys")
    kind = F.when(F.col("amount") < 0, None).when(F.col("amount") < 1000, "Circle").otherwise("Polygon")
    ring = G.box_ring(F.col("minx") * 4, F.col("miny") * 2, F.col("maxx") * 4, F.col("maxy") * 2)
    small = F.array(F.array(G.box_ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))
    # the box is the second part, after a small one that is always right
    return rows.select("poly_id", ingest.upload_problem(kind, F.concat(small, F.array(F.array(ring))), F.col("poly_id")).alias("problem"))


@query("selection_upserts", "SELECT event_type, props, min(event_id) AS first, max(event_id) AS event_id FROM events GROUP BY event_type, props")
def selection_upserts(s, d):
    return ingest.selections(s.read.parquet(f"{d}/events.parquet"), "event_type", "props", "event_id")


@query("argument_precedence", "SELECT id, CASE WHEN group_level > 40 THEN 'task' WHEN group_level > 20 THEN 'option' ELSE title END AS name, CASE WHEN group_level > 40 THEN '2' WHEN group_level > 20 THEN '1' END AS level, CASE WHEN group_level > 20 THEN 'kept' END AS other FROM fx_catalog", "fx_catalog")
def argument_precedence(s, d):
    option = F.when(F.col("group_level") > 20, F.create_map(*map(F.lit, ("name", "option", "level", "1", "other", "kept"))))
    task = F.when(F.col("group_level") > 40, F.create_map(*map(F.lit, ("level", "2", "name", "task"))))
    rows = ingest.with_arguments(view(s, d, "fx_catalog").withColumns({"o": option, "t": task}), {"name": F.col("title")}, "o", "t")
    return rows.select("id", *(F.try_element_at("arguments", F.lit(k)).alias(k) for k in ("name", "level", "other")))


@query("upload_metadata", "SELECT id, CASE WHEN group_level % 3 = 0 THEN 'own ops' WHEN group_level % 3 = 1 THEN 'their ops' ELSE '' END AS operations, CASE WHEN group_level % 3 <> 2 THEN CASE WHEN group_level % 2 = 0 THEN 'own file' WHEN group_level % 3 = 1 THEN 'their file' END WHEN group_level % 2 = 0 THEN 'own file' END AS file_name FROM fx_catalog", "fx_catalog")
def upload_metadata(s, d):
    """What a request says of its upload; where it says no operations, the collection's record fills what is missing."""
    third = F.col("group_level") % 3
    request = F.to_json(F.struct(F.when(third == 0, "own ops").alias("ops"), F.when(F.col("group_level") % 2 == 0, "own file").alias("file")))
    record = F.when(third == 1, F.to_json(F.struct(F.lit("their ops").alias("ops"), F.lit("their file").alias("file"))))
    said = {k: F.get_json_object(request, f"$.{k}") for k in ("ops", "file")}
    theirs = {k: F.when(said["ops"].isNull(), F.get_json_object(record, f"$.{k}")) for k in ("ops", "file")}
    return view(s, d, "fx_catalog").select("id", F.coalesce(said["ops"], theirs["ops"], F.lit("")).alias("operations"), F.coalesce(said["file"], theirs["file"]).alias("file_name"))


@query("wkb_area", "SELECT poly_id, round((maxx - minx) * (maxy - miny) / 2, 6) AS area, 101 AS size FROM fx_polys", "fx_polys")
def wkb_area(s, d):
    """Triangles written as well-known binary and read again."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("minx", "miny"), at("maxx", "miny"), at("minx", "maxy"))
    rows = view(s, d, "fx_polys").select("poly_id", F.array(F.array(ring)).alias("shape"))
    rows = shapes.decoded(shapes.encoded(rows, kind="Polygon"))
    return rows.select("poly_id", F.round(shapes.shape_area(F.col("geometry.parts")), 6).alias("area"), (F.octet_length("wkb") + 24).alias("size"))


@query("ring_validity", "SELECT poly_id, unnest(['box', 'bow', 'line', 'notched', 'spike', 'none']) AS shape, unnest([true, false, false, true, false, false]) AS valid FROM fx_polys", "fx_polys")
def ring_validity(s, d):
    at = lambda a, b: F.struct((F.col("minx") + a * (F.col("maxx") - F.col("minx"))).alias("x"), (F.col("miny") + b * (F.col("maxy") - F.col("miny"))).alias("y"))
    shapes = {"box": ((0, 0), (1, 0), (1, 1), (0, 1)), "bow": ((0, 0), (1, 1), (1, 0), (0, 1)), "line": ((0, 0), (1, 0)), "notched": ((0, 0), (1, 0), (1, 1), (0.5, 0.5), (0, 1)), "spike": ((0, 0), (1, 0), (0.5, 0), (0.5, 1))}
    rings = F.array(*(F.struct(F.lit(k).alias("shape"), F.array(*(at(*p) for p in v)).alias("ring")) for k, v in shapes.items()), F.struct(F.lit("none").alias("shape"), F.lit(None).cast(G.RING).alias("ring")))
    rows = view(s, d, "fx_polys").select("poly_id", F.explode(rings).alias("r")).select("poly_id", "r.*")
    return regions.checked(rows).select("poly_id", "shape", "valid")


WIDE = f"(maxx - minx) * {regions.DEGREE!r} * cos(radians((miny + maxy) / 2))"
HIGH = f"(maxy - miny) * {regions.DEGREE!r}"


@query("buffer_area", f"SELECT poly_id, round(({WIDE}) * ({HIGH}) + 2 * 80.4672 * (({WIDE}) + ({HIGH})) + 80.4672 * 80.4672 * 16 * sin(2 * pi() / 32), 2) AS area FROM fx_polys", "fx_polys")
def buffer_area(s, d):
    """Square kilometres of boxes widened by 50 miles, with corners of eight sides."""
    rows = view(s, d, "fx_polys").withColumn("ring", G.box_ring(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))))
    scale = F.cos(F.radians((F.col("miny") + F.col("maxy")) / 2)) * regions.DEGREE * regions.DEGREE
    widened = overlay.buffers(rows.select("poly_id", F.array(F.array("ring")).alias("shape")), "poly_id", 50, "miles")
    area = widened.groupBy("poly_id").agg(F.sum(G.ring_area(F.col("ring"))).alias("area"))
    return rows.join(area, "poly_id").select("poly_id", F.round(F.col("area") * scale, 2).alias("area"))


@query("union_area", ", b AS (SELECT poly_id % 5 AS grp, minx, miny, maxx, maxy FROM fx_polys), x AS (SELECT grp, v AS lo, lead(v) OVER (PARTITION BY grp ORDER BY v) AS hi FROM (SELECT grp, minx AS v FROM b UNION SELECT grp, maxx FROM b)), y AS (SELECT grp, v AS lo, lead(v) OVER (PARTITION BY grp ORDER BY v) AS hi FROM (SELECT grp, miny AS v FROM b UNION SELECT grp, maxy FROM b)) SELECT grp, round(sum((x.hi - x.lo) * (y.hi - y.lo)), 4) AS area FROM x JOIN y USING (grp) WHERE EXISTS (SELECT 1 FROM b WHERE b.grp = x.grp AND b.minx <= x.lo AND b.maxx >= x.hi AND b.miny <= y.lo AND b.maxy >= y.hi) GROUP BY grp", "fx_polys")
def union_area(s, d):
    rows = view(s, d, "fx_polys").select((F.col("poly_id") % 5).alias("grp"), F.array(F.array(G.box_ring(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))))).alias("shape"))
    return overlay.union_shapes(rows, "grp").groupBy("grp").agg(F.round(F.sum(shapes.crossed(F.col("ring")) / 2), 4).alias("area"))


IN_BOX = "x > minx AND x < maxx AND y > miny AND y < maxy"
AT_BOX = "lon > minx AND lon < maxx AND lat > miny AND lat < maxy"
AREA = "greatest(0, least(f.maxx, p.maxx) - greatest(f.minx, p.minx)) * greatest(0, least(f.maxy, p.maxy) - greatest(f.miny, p.miny))"
TASK = {"event_type": {"type": "categorical", "selected": ["click", "view"], "aggregate": False}, "value": {"type": "range", "start": 5, "end": 90}}
DIGEST = hashlib.md5(json.dumps(TASK, sort_keys=True).encode()).hexdigest()[:8]
NAMED = {"5-LOW": "low", "9-NONE": "none"}


def raster_sql(stat: str, value: str) -> str:
    return f"SELECT geom_id, '{stat}' AS name, CAST(round({value}, 4) AS DOUBLE) AS value FROM fx_features LEFT JOIN px ON {IN_BOX} GROUP BY geom_id"


@query(
    "processor_dispatch",
    ", px AS (SELECT x, y, val, class FROM fx_pixels WHERE NOT is_nodata) "
    + " UNION ALL ".join([raster_sql("min", "min(val)"), raster_sql("max", "max(val)"), raster_sql("mean", "avg(val) + 1e-7"), raster_sql("sum", "sum(val)"), raster_sql("count", "count(val)")])
    + f" UNION ALL SELECT geom_id, concat('class_', c), CAST(sum(n) AS DOUBLE) FROM (SELECT geom_id, unnest(['low', 'none']) AS c, 0 AS n FROM fx_features UNION ALL SELECT geom_id, CASE class WHEN '5-LOW' THEN 'low' ELSE class END, 1 FROM fx_features JOIN px ON {IN_BOX}) GROUP BY geom_id, c"
    + f" UNION ALL SELECT geom_id, concat('events_{DIGEST}_', k), CAST(count(event_id) AS DOUBLE) FROM fx_features CROSS JOIN (SELECT unnest(['click', 'view']) AS k) LEFT JOIN fx_points ON {AT_BOX} AND event_type = k AND value BETWEEN 5 AND 90 GROUP BY geom_id, k"
    + f" UNION ALL SELECT geom_id, 'within', CAST(trunc(coalesce(sum(value), 0)) AS DOUBLE) FROM fx_features LEFT JOIN fx_points ON {AT_BOX} GROUP BY geom_id"
    + f" UNION ALL SELECT f.geom_id, 'weighted', CAST(trunc(coalesce(sum(CAST(amount * (({AREA}) / nullif((p.maxx - p.minx) * (p.maxy - p.miny), 0)) AS DECIMAL(38, 12))), 0)) AS DOUBLE) FROM fx_features f LEFT JOIN fx_polys p ON {AREA} > 0 GROUP BY f.geom_id"
    + f" UNION ALL SELECT f.geom_id, 'overlapping', CAST(count(poly_id) AS DOUBLE) FROM fx_features f LEFT JOIN fx_polys p ON {AREA} > 0 GROUP BY f.geom_id",
    "fx_features",
    "fx_pixels",
    "fx_points",
    "fx_polys",
)
def processor_dispatch(s, d):
    """Every statistic of the registry by its name, with the arguments of an option and of a task. Means of eight prices may
    end in half of the last digit, so a little is added before they are rounded."""
    features, events, polys = (view(s, d, f"fx_{n}") for n in ("features", "points", "polys"))
    pixels = view(s, d, "fx_pixels").where("not is_nodata")
    calls = [(f"raster_{k}", pixels, processors.arguments(k, None, None)) for k in ("min", "max", "mean", "sum", "count")]
    calls += [("raster_categorical", pixels, processors.arguments("class", {}, None, NAMED)), ("events_filtered", events, processors.arguments("events", {"outcome": "event_count"}, TASK))]
    calls += [("events_within", events, processors.arguments("other", {"name": "within", "field": "value"}, None)), ("polygons_weighted", polys, processors.arguments("weighted", {"outcome": "amount"}, None)), ("boxes_overlapping", polys, processors.arguments("overlapping", None, None))]
    out = None
    for function, layer, arguments in calls:
        found = processors.run(function, features, layer, **arguments).select("geom_id", "name", F.round(F.col("value") + 1e-7, 4).alias("value"))
        out = found if out is None else out.unionByName(found)
    return out
