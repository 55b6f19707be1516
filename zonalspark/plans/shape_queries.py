"""Queries of shapes of any form: several parts, holes, notches, unions, buffers, zonal statistics, tiles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonalspark.functions.scalar import MERCATOR
from zonalspark.operators import cells, ingest, overlay, processors, shapes
from zonalspark.operators.geometry import RING, box_ring
from zonalspark.sources.fixtures import view, with_views
from zonalspark.sources.shared import shared_dir
from zonalspark.sources.vector import read_geojson, write_csv, write_geojson

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def put(f):
        QUERIES[name], SQL[name] = f, f"{with_views(*views)} {sql}" if views else sql
        return f

    return put


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points)).cast(RING)


def share(a: float, b: float) -> tuple[Column, Column]:
    """A place in a polygon's box, by shares of its width and height."""
    return F.col("minx") + a * (F.col("maxx") - F.col("minx")), F.col("miny") + b * (F.col("maxy") - F.col("miny"))


def two_parts() -> Column:
    """A box of three quarters by three quarters with a hole of a quarter, and a triangle beside it."""
    holed = F.array(ring(share(0, 0), share(0.75, 0), share(0.75, 0.75), share(0, 0.75)), ring(share(0.25, 0.25), share(0.25, 0.5), share(0.5, 0.5), share(0.5, 0.25)))
    return F.array(holed, F.array(ring(share(0.875, 0), share(1, 0), share(1, 1))))


def triangle() -> Column:
    return F.array(F.array(ring(share(0, 0), share(1, 0), share(0, 1))))


def feature_boxes(s, d):
    return view(s, d, "fx_features").select("geom_id", F.array(F.array(box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))))).alias("shape"))


@query("wkb_parts", "SELECT poly_id, CASE poly_id % 3 WHEN 0 THEN 'MultiPolygon' WHEN 1 THEN 'MultiPolygon' END AS kind, CASE WHEN poly_id % 3 < 2 THEN CASE poly_id % 3 WHEN 0 THEN 2 ELSE 0 END END AS n_parts, CASE poly_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS n_rings, CASE poly_id % 3 WHEN 0 THEN 4326 WHEN 1 THEN 4326 END AS srid, CASE poly_id % 3 WHEN 0 THEN round((maxx - minx) * (maxy - miny) * (0.5625 - 0.0625 + 0.0625), 6) WHEN 1 THEN 0.0 END AS area FROM fx_polys", "fx_polys")
def wkb_parts(s, d):
    """Multi-polygons with a hole and a reference system written as well-known binary and read again; of three rows one is
    empty and one is empty binary."""
    third = F.col("poly_id") % 3
    rows = view(s, d, "fx_polys").withColumn("shape", F.when(third == 0, two_parts()).otherwise(F.array().cast(shapes.SHAPE)))
    binary = shapes.encoded(rows, srid=4326).withColumn("wkb", F.when(third < 2, F.col("wkb")).otherwise(F.lit(b"")))
    g = shapes.decoded(binary.select("poly_id", "wkb"))
    counts = F.col("geometry.parts").isNotNull()
    return g.select("poly_id", "geometry.kind", F.when(counts, F.size("geometry.parts")).alias("n_parts"), F.when(counts, F.size(F.flatten("geometry.parts"))).alias("n_rings"), "geometry.srid", F.round(shapes.shape_area(F.col("geometry.parts")), 6).alias("area"))


@query("upload_skipped", "SELECT upload, problem, count(*) AS n FROM (SELECT poly_id % 4 AS upload, CASE poly_id % 7 WHEN 2 THEN 'no geometry' WHEN 3 THEN 'coordinates' WHEN 4 THEN 'kind' WHEN 6 THEN 'coordinates' END AS problem FROM fx_polys) WHERE problem IS NOT NULL GROUP BY ALL", "fx_polys")
def upload_skipped(s, d):
    """What four uploads leave out and why: features are boxes, pairs of boxes, nothing, text, circles, points, and boxes
    whose coordinates have the depth of another kind."""
    kind = F.element_at(F.array(*map(F.lit, ("Polygon", "MultiPolygon", None, "Polygon", "Circle", "Point", "MultiPolygon"))), (F.col("poly_id") % 7 + 1).cast("int"))
    points = F.transform(box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))), lambda p: F.array(p["x"], p["y"]))
    box = F.array(points)
    text = F.element_at(F.array(F.to_json(box), F.to_json(F.array(box, box)), F.lit(None), F.lit("none"), F.to_json(box), F.lit("[1.5, 2.5]"), F.to_json(box)), (F.col("poly_id") % 7 + 1).cast("int"))
    features = view(s, d, "fx_polys").select((F.col("poly_id") % 4).alias("upload"), kind.alias("kind"), text.alias("coordinates"))
    return ingest.skipped(ingest.taken(features), "upload")


@query("geojson_parts", "SELECT poly_id, 'MultiPolygon' AS kind, round((maxx - minx) * (maxy - miny) * (0.5625 - 0.0625 + 0.0625), 6) AS area FROM fx_polys", "fx_polys")
def geojson_parts(s, d):
    """Polygons of several parts with holes written as GeoJSON lines and read again."""
    at = f"{shared_dir(s)}/geojson-{uuid.uuid4().hex}"
    write_geojson(view(s, d, "fx_polys").withColumn("shape", two_parts()), at, ["poly_id"])
    back = read_geojson(s, at, lines=True).where("problem is null")
    return back.select(F.element_at("properties", "poly_id").cast("long").alias("poly_id"), "kind", F.round(shapes.shape_area(F.col("shape")), 6).alias("area"))


@query("wide_csv", "SELECT geom_id, count(*) FILTER (status = 1) AS done, count(*) FILTER (status = 0) AS open, count(*) FILTER (status = -1) AS failed FROM fx_tasks GROUP BY geom_id", "fx_tasks")
def wide_csv(s, d):
    """A wide result table written as CSV and read again."""
    at = f"{shared_dir(s)}/wide-{uuid.uuid4().hex}"
    names = {"done": 1, "open": 0, "failed": -1}
    write_csv(view(s, d, "fx_tasks").groupBy("geom_id").agg(*(F.count_if(F.col("status") == v).alias(k) for k, v in names.items())), at)
    return s.read.option("header", True).schema("geom_id long, done long, open long, failed long").csv(at)


@query("upload_limits", "SELECT source AS upload, count(*) AS n, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size, count(*) <= 10 AND sum(octet_length(encode(coalesce(text, '')))) <= 30000 AS fits FROM documents GROUP BY source")
def upload_limits(s, d):
    """Uploads of as many features and bytes as each source has documents, under limits of 10 and of 30,000."""
    rows = s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("upload"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return ingest.uploads_fit(rows, "upload", "bytes", 10, 30_000)


#: Diamonds are boxes in the turned coordinates u = x + y and v = x - y, which hold twice the area.
TURNED = "SELECT poly_id % 5 AS grp, u + dx AS minx, v + dy AS miny, u + dx + w AS maxx, v + dy + h AS maxy FROM (SELECT poly_id, (minx + maxx) / 2 + (miny + maxy) / 2 - r AS u, (minx + maxx) / 2 - (miny + maxy) / 2 - r AS v, r FROM (SELECT *, (maxx - minx) / 2 AS r FROM fx_polys)), LATERAL (SELECT unnest([0, 0]) AS dx, unnest([0, 0]) AS dy, unnest([2 * r, r]) AS w, unnest([r, 2 * r]) AS h)"


@query("union_rings", f", b AS ({TURNED}), x AS (SELECT grp, v AS lo, lead(v) OVER (PARTITION BY grp ORDER BY v) AS hi FROM (SELECT grp, minx AS v FROM b UNION SELECT grp, maxx FROM b)), y AS (SELECT grp, v AS lo, lead(v) OVER (PARTITION BY grp ORDER BY v) AS hi FROM (SELECT grp, miny AS v FROM b UNION SELECT grp, maxy FROM b)) SELECT grp, round(sum((x.hi - x.lo) * (y.hi - y.lo)) / 2, 4) AS area FROM x JOIN y USING (grp) WHERE EXISTS (SELECT 1 FROM b WHERE b.grp = x.grp AND b.minx <= x.lo AND b.maxx >= x.hi AND b.miny <= y.lo AND b.maxy >= y.hi) GROUP BY grp", "fx_polys")
def union_rings(s, d):
    """Area that turned L shapes of each group cover together: rings with notches that cross, with the holes between them."""
    r = (F.col("maxx") - F.col("minx")) / 2
    u, v = (F.col("minx") + F.col("maxx")) / 2 + (F.col("miny") + F.col("maxy")) / 2 - r, (F.col("minx") + F.col("maxx")) / 2 - (F.col("miny") + F.col("maxy")) / 2 - r
    at = lambda a, b: (((u + a * r) + (v + b * r)) / 2, ((u + a * r) - (v + b * r)) / 2)
    ell = ring(*(at(a, b) for a, b in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))))
    rows = view(s, d, "fx_polys").select((F.col("poly_id") % 5).alias("grp"), F.array(F.array(ell)).alias("shape"))
    return overlay.union_shapes(rows, "grp").groupBy("grp").agg(F.round(F.sum(shapes.crossed(F.col("ring")) / 2), 4).alias("area"))


@query("union_holes", "SELECT poly_id, round((maxx - minx) * (maxy - miny) * (1 - 0.25 + 0.0625), 6) AS area, 2 AS n_outer, 1 AS n_holes FROM fx_polys", "fx_polys")
def union_holes(s, d):
    """Four strips around a hole that holds an island, united by polygon."""
    strips = [((0, 0), (1, 0), (1, 0.25), (0, 0.25)), ((0, 0.75), (1, 0.75), (1, 1), (0, 1)), ((0, 0), (0.25, 0), (0.25, 1), (0, 1)), ((0.75, 0), (1, 0), (1, 1), (0.75, 1)), ((0.375, 0.375), (0.625, 0.375), (0.625, 0.625), (0.375, 0.625))]
    every = F.array(*(F.array(F.array(ring(*(share(*p) for p in own)))) for own in strips))
    found = overlay.union_shapes(view(s, d, "fx_polys").select("poly_id", F.explode(every).alias("shape")), "poly_id")
    return found.groupBy("poly_id").agg(F.round(F.sum(shapes.crossed(F.col("ring")) / 2), 6).alias("area"), F.count_if(~F.col("hole")).cast("int").alias("n_outer"), F.count_if("hole").cast("int").alias("n_holes"))


#: An L of a degree across in km around the equator, buffered by 5 km, with corners of 8 sides.
SIDE, REACH = overlay.DEGREE, 5.0


@query("buffer_notched", f"SELECT poly_id, round(0.75 * {SIDE!r} * {SIDE!r} * k * k + 4 * {SIDE!r} * k * {REACH!r} - {REACH!r} * {REACH!r} + 1.25 * 16 * sin(2 * pi() / 32) * {REACH!r} * {REACH!r}, 2) AS area, 1 AS n FROM (SELECT poly_id, 1 + poly_id % 4 AS k FROM fx_polys)", "fx_polys")
def buffer_notched(s, d):
    """Square km within 5 km of an L over the equator, whose notch isn't filled."""
    k = (1 + F.col("poly_id") % 4).cast("double")
    at = lambda a, b: (F.col("minx") + a * k, (F.lit(b) - 0.5) * k)
    ell = ring(*(at(a, b) for a, b in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))))
    rows = view(s, d, "fx_polys").select("poly_id", F.array(F.array(ell)).alias("shape"))
    found = overlay.buffers(rows, "poly_id", REACH)
    return found.groupBy("poly_id").agg(F.round(F.sum(shapes.crossed(F.col("ring")) / 2) * SIDE * SIDE, 2).alias("area"), F.count(F.lit(1)).cast("int").alias("n"))


IN_TRIANGLE = "x > minx AND y > miny AND (x - minx) / (maxx - minx) + (y - miny) / (maxy - miny) < 1"
GRID = (-50.0, -50.0, 0.5, 0.5)


@query("zonal_triangles", f"SELECT poly_id, count(val) AS n, CAST(sum(CAST(val AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(sum(CAST(val AS DECIMAL(18, 2))) AS DOUBLE) / count(val) AS mean, CAST(min(val) AS DOUBLE) AS least FROM fx_polys LEFT JOIN (SELECT * FROM fx_pixels WHERE NOT is_nodata) ON {IN_TRIANGLE} GROUP BY poly_id", "fx_polys", "fx_pixels")
def zonal_triangles(s, d):
    """Statistics of the pixels in triangles; the raster's rows are scanned, nodata left out."""
    rows = view(s, d, "fx_polys").select(F.col("poly_id").alias("geom_id"), triangle().alias("shape"))
    pixels = view(s, d, "fx_pixels").withColumn("val", F.col("val").cast("decimal(18,2)"))
    found = cells.zonal_shapes(rows, pixels, GRID, nodata=F.col("is_nodata"))
    return found.select(F.col("geom_id").alias("poly_id"), F.col("count").alias("n"), F.col("sum").cast("double").alias("total"), (F.col("sum").cast("double") / F.col("count")).alias("mean"), F.col("min").cast("double").alias("least"))


def corner(x: str, y: str) -> str:
    """Share of a unit triangle's box that is left of x and below y and inside the triangle."""
    a, b = (f"least(greatest({v}, 0), 1)" for v in (x, y))
    return f"({a} * {b} - CASE WHEN {a} + {b} > 1 THEN ({a} + {b} - 1) * ({a} + {b} - 1) / 2 ELSE 0 END)"


X0, X1, Y0, Y1 = "(f.minx - p.minx) / (p.maxx - p.minx)", "(f.maxx - p.minx) / (p.maxx - p.minx)", "(f.miny - p.miny) / (p.maxy - p.miny)", "(f.maxy - p.miny) / (p.maxy - p.miny)"
COMMON = f"({corner(X1, Y1)} - {corner(X0, Y1)} - {corner(X1, Y0)} + {corner(X0, Y0)})"


@query("triangle_overlaps", f"SELECT poly_id, geom_id, round({COMMON} * (p.maxx - p.minx) * (p.maxy - p.miny), 6) AS area FROM fx_polys p JOIN fx_features f ON round({COMMON} * (p.maxx - p.minx) * (p.maxy - p.miny), 6) > 0", "fx_polys", "fx_features")
def triangle_overlaps(s, d):
    """Area that triangles and features share."""
    polys = view(s, d, "fx_polys").select("poly_id", triangle().alias("shape"))
    return cells.shape_overlaps(polys, feature_boxes(s, d), "poly_id", "geom_id").withColumn("area", F.round("area", 6)).where("area > 0")


@query("triangle_weighted", f"SELECT geom_id, CAST(trunc(coalesce(sum(CAST(amount * round(2 * {COMMON}, 9) AS DECIMAL(38, 9))), 0)) AS BIGINT) AS weighted FROM fx_features f LEFT JOIN fx_polys p ON {COMMON} > 0 GROUP BY geom_id", "fx_polys", "fx_features")
def triangle_weighted(s, d):
    """Amounts of triangles by the share of their area that is inside each feature, to nine decimals."""
    polys = view(s, d, "fx_polys").select("poly_id", "amount", triangle().alias("shape"))
    return cells.area_weighted_shapes(feature_boxes(s, d), polys, "amount", digits=9)


AT_TRIANGLE = IN_TRIANGLE.replace("x >", "lon >").replace("(x -", "(lon -").replace("y >", "lat >").replace("(y -", "(lat -")
SHARE = COMMON.replace("f.", "q.")


@query(
    "processor_shapes",
    ", px AS (SELECT x, y, val, class FROM fx_pixels WHERE NOT is_nodata)"
    + " SELECT poly_id AS geom_id, 'mean' AS name, round(avg(val) + 1e-7, 4) AS value FROM fx_polys LEFT JOIN px ON {0} GROUP BY ALL UNION ALL SELECT poly_id, 'count', count(val) FROM fx_polys LEFT JOIN px ON {0} GROUP BY ALL".format(IN_TRIANGLE)
    + f" UNION ALL SELECT poly_id, concat('class_', c), sum(n) FROM (SELECT poly_id, unnest(['low', 'none']) AS c, 0 AS n FROM fx_polys UNION ALL SELECT poly_id, CASE class WHEN '5-LOW' THEN 'low' ELSE class END, 1 FROM fx_polys JOIN px ON {IN_TRIANGLE}) GROUP BY ALL"
    + f" UNION ALL SELECT poly_id, 'within', CAST(trunc(coalesce(sum(value), 0)) AS DOUBLE) FROM fx_polys LEFT JOIN fx_points ON {AT_TRIANGLE} GROUP BY ALL"
    + f" UNION ALL SELECT poly_id, 'weighted', CAST(trunc(coalesce(sum(CAST(q.geom_id * (({SHARE}) * (p.maxx - p.minx) * (p.maxy - p.miny) / 400) AS DECIMAL(38, 9))), 0)) AS DOUBLE) FROM fx_polys p LEFT JOIN fx_features q ON ({SHARE}) * (p.maxx - p.minx) * (p.maxy - p.miny) > 1e-9 GROUP BY ALL"
    + f" UNION ALL SELECT poly_id, 'overlapping', count(q.geom_id) FROM fx_polys p LEFT JOIN fx_features q ON ({SHARE}) * (p.maxx - p.minx) * (p.maxy - p.miny) > 1e-9 GROUP BY ALL",
    "fx_polys",
    "fx_features",
    "fx_pixels",
    "fx_points",
)
def processor_shapes(s, d):
    """Statistics of the registry, by name, of features that are triangles."""
    features = view(s, d, "fx_polys").select(F.col("poly_id").alias("geom_id"), triangle().alias("shape"))
    pixels, events = view(s, d, "fx_pixels").where("not is_nodata"), view(s, d, "fx_points")
    layer = feature_boxes(s, d).select(F.col("geom_id").alias("poly_id"), F.col("geom_id").cast("double").alias("amount"), "shape")
    calls = [(f"raster_{k}", pixels, {"name": k, "grid": GRID}) for k in ("mean", "count")]
    calls += [("raster_categorical", pixels, {"name": "class", "grid": GRID, "category_map": {"5-LOW": "low", "9-NONE": "none"}}), ("events_within", events, {"name": "within", "field": "value"})]
    calls += [("polygons_weighted", layer, {"name": "weighted", "outcome": "amount"}), ("boxes_overlapping", layer, {"name": "overlapping"})]
    out = None
    for function, rows, arguments in calls:
        found = processors.run(function, features, rows, **arguments).select("geom_id", "name", F.round(F.col("value") + 1e-7, 4).alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


EDGE = 2 * MERCATOR / 16
EAST = f"(CAST({{}} AS DOUBLE) * {MERCATOR!r}e0 / 180 + {MERCATOR!r}e0) / {EDGE!r}e0"
SOUTH = f"({MERCATOR!r}e0 - ln(tan((90 + {{}}) * pi() / 360)) / (pi() / 180) * {MERCATOR!r}e0 / 180) / {EDGE!r}e0"
STEPS = "CAST(round(least(greatest(({v} - {t}) * 4096, -256), 4352)) AS INTEGER)"


@query("tile_shapes", ", m AS (SELECT poly_id, {} AS w, {} AS e, {} AS n, {} AS s FROM fx_polys), t AS (SELECT *, unnest(generate_series(greatest(0, floor(w - 0.0625))::INTEGER, least(15, floor(e + 0.0625))::INTEGER)) AS tx FROM m), u AS (SELECT *, unnest(generate_series(greatest(0, floor(n - 0.0625))::INTEGER, least(15, floor(s + 0.0625))::INTEGER)) AS ty FROM t) SELECT poly_id, tx::INTEGER AS tx, ty::INTEGER AS ty, {} AS low_x, {} AS high_x, {} AS low_y, {} AS high_y FROM u".format(EAST.format("minx"), EAST.format("maxx"), SOUTH.format("maxy"), SOUTH.format("miny"), STEPS.format(v="w", t="tx"), STEPS.format(v="e", t="tx"), STEPS.format(v="n", t="ty"), STEPS.format(v="s", t="ty")), "fx_polys")
def tile_shapes(s, d):
    """Boxes in each tile of zoom 4 that they touch, cut 256 steps of 4,096 beyond its edges."""
    rows = view(s, d, "fx_polys").select("poly_id", F.array(F.array(box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))))).alias("shape"))
    bounds = shapes.shape_bounds(F.col("tile"))
    return cells.tiled(rows, 4).select("poly_id", "tx", "ty", *(b.cast("int").alias(k) for k, b in zip(("low_x", "low_y", "high_x", "high_y"), bounds, strict=True)))
