"""Queries of geometry kernels, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonalspark.functions.scalar import MERCATOR
from zonalspark.operators import geometry as G
from zonalspark.operators.cells import forms, of_forms, within_shapes
from zonalspark.operators.overlay import union_shapes
from zonalspark.operators.shapes import crossed
from zonalspark.sources.fixtures import view, with_views
from zonalspark.sources.shared import shared_dir
from zonalspark.streaming.requests import run_once

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{with_views(*views)} {sql}" if views else sql
        return f

    return put


def rings(s, d):
    return view(s, d, "fx_polys").withColumn("ring", G.box_ring(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))))


@query("ring_area", "SELECT poly_id, round((maxx - minx) * (maxy - miny), 6) AS area FROM fx_polys", "fx_polys")
def ring_area(s, d):
    return rings(s, d).select("poly_id", F.round(G.ring_area(F.col("ring")), 6).alias("area"))


@query("ring_bounds", "SELECT poly_id, minx, miny, maxx, maxy FROM fx_polys", "fx_polys")
def ring_bounds(s, d):
    return rings(s, d).select("poly_id", *G.ring_bounds(F.col("ring")))


SHARES = (-0.25, 0.15, 0.45, 0.75)


@query("point_in_ring", f"SELECT poly_id, a, b, a > 0 AND b > 0 AND a + b < 1 AND NOT (a > 0.2 AND a < 0.5 AND b < 0.2) AS inside FROM fx_polys, (SELECT unnest({list(SHARES)}::DOUBLE[]) AS a), (SELECT unnest({list(SHARES)}::DOUBLE[]) AS b)", "fx_polys")
def point_in_ring(s, d):
    """Places in and around a triangle whose base has a notch between a fifth and a half of it, a fifth high."""
    at = lambda a, b: F.struct((F.col("minx") + a * (F.col("maxx") - F.col("minx"))).alias("x"), (F.col("miny") + b * (F.col("maxy") - F.col("miny"))).alias("y"))
    notched = F.array(*(at(a, b) for a, b in ((0, 0), (0.2, 0), (0.2, 0.2), (0.5, 0.2), (0.5, 0), (1, 0), (0, 1))))
    shares = F.array(*map(F.lit, SHARES))
    tried = view(s, d, "fx_polys").withColumn("ring", notched).select("*", F.explode(shares).alias("a")).select("*", F.explode(shares).alias("b"))
    p = at(F.col("a"), F.col("b"))
    return tried.select("poly_id", "a", "b", G.point_in_ring(p["x"], p["y"], F.col("ring")).alias("inside"))


@query("simplify_tier", "SELECT poly_id, 4 AS n_points, round((maxx - minx) * (maxy - miny), 6) AS area FROM fx_polys", "fx_polys")
def simplify_tier(s, d):
    """Boxes with many points along an edge, simplified for zoom 9: the corners stay."""
    edge = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((F.col("minx") + (F.col("maxx") - F.col("minx")) * i / 20).alias("x"), F.col("miny").alias("y")))
    corners = F.array(F.struct(F.col("maxx").alias("x"), F.col("maxy").alias("y")), F.struct(F.col("minx").alias("x"), F.col("maxy").alias("y")))
    many = view(s, d, "fx_polys").select("poly_id", F.concat(edge, corners).alias("ring"))
    return G.simplified(many, "ring", G.TOLERANCES[9]).select("poly_id", F.size("ring").alias("n_points"), F.round(G.ring_area(F.col("ring")), 6).alias("area"))


@query("coverage_simplify", "SELECT geom_id, 4 + CASE WHEN geom_id % 5 < 4 THEN 1 ELSE 0 END + CASE WHEN geom_id % 5 > 0 THEN 1 ELSE 0 END AS n_points, CAST(400 + CASE WHEN geom_id % 5 < 4 THEN 10 ELSE 0 END - CASE WHEN geom_id % 5 > 0 THEN 10 ELSE 0 END AS DOUBLE) AS area FROM fx_features", "fx_features")
def coverage_simplify(s, d):
    """Cells of a grid whose upright borders between cells bulge by one degree to the east and have many points besides:
    the bulge stays, the same on both sides, and all other points but the corners go."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    steps = [F.lit(k / 8) for k in range(8)]
    x0, x1, y0, y1 = (F.col(c) for c in ("minx", "maxx", "miny", "maxy"))
    bulge = lambda k, x: x + F.when((F.abs(x) < 50) & (k > 0), (0.5 - F.abs(k - 0.5)) * 2).otherwise(0)
    ring = [at(x0 + (x1 - x0) * k, y0) for k in steps] + [at(bulge(k, x1), y0 + (y1 - y0) * k) for k in steps] + [at(x1 + (x0 - x1) * k, y1) for k in steps] + [at(bulge(1 - k, x0) if i else x0, y1 + (y0 - y1) * k) for i, k in enumerate(steps)]
    grid = view(s, d, "fx_features").select("geom_id", F.lit(1).alias("grp"), F.array(*ring).alias("ring"))
    return G.coverage_simplified(grid, "geom_id", "grp", "ring", 0.1).select("geom_id", F.size("ring").alias("n_points"), F.round(G.ring_area(F.col("ring")), 6).alias("area"))


#: With an exponent, so that they are floats in SQL, too.
HALF, WHOLE, EDGE = (f"{x!r}e0" for x in (MERCATOR, 2 * MERCATOR, 2 * MERCATOR / 64))
NORTH = f"{HALF} - ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * {HALF} / 180"


@query("mvt_tile", f"SELECT tx, ty, count(*) AS n, min(px) AS low, max(px) AS high FROM (SELECT tx, ty, CAST(floor((east - tx * {EDGE}) / {EDGE} * 4096) AS INTEGER) AS px FROM (SELECT east, CAST(floor(east / {WHOLE} * 64) AS INTEGER) AS tx, CAST(floor(({NORTH}) / {WHOLE} * 64) AS INTEGER) AS ty FROM (SELECT lon * {HALF} / 180 + {HALF} AS east, lat FROM fx_points))) GROUP BY tx, ty", "fx_points")
def mvt_tile(s, d):
    """Points of each tile of zoom 6, quantised to the tile's grid."""
    return G.quantised(view(s, d, "fx_points"), "lon", "lat", 6).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("low"), F.max("px").alias("high"))


@query("buffer_union", ", b AS (SELECT fc_id, minx - 0.5 AS minx, miny - 0.5 AS miny, maxx + 0.5 AS maxx, maxy + 0.5 AS maxy FROM fx_features), x AS (SELECT fc_id, v AS lo, lead(v) OVER (PARTITION BY fc_id ORDER BY v) AS hi FROM (SELECT fc_id, minx AS v FROM b UNION SELECT fc_id, maxx FROM b)), y AS (SELECT fc_id, v AS lo, lead(v) OVER (PARTITION BY fc_id ORDER BY v) AS hi FROM (SELECT fc_id, miny AS v FROM b UNION SELECT fc_id, maxy FROM b)) SELECT fc_id, round(sum((x.hi - x.lo) * (y.hi - y.lo)), 4) AS area FROM x JOIN y USING (fc_id) WHERE EXISTS (SELECT 1 FROM b WHERE b.fc_id = x.fc_id AND b.minx <= x.lo AND b.maxx >= x.hi AND b.miny <= y.lo AND b.maxy >= y.hi) GROUP BY fc_id", "fx_features")
def buffer_union(s, d):
    """Area of what the features of each collection cover, each widened by half a degree with square corners."""
    box = G.box_ring(F.col("minx") - 0.5, F.col("miny") - 0.5, F.col("maxx") + 0.5, F.col("maxy") + 0.5)
    rings = union_shapes(view(s, d, "fx_features").select("fc_id", F.array(F.array(box)).alias("shape")), "fc_id")
    return rings.groupBy("fc_id").agg(F.round(F.sum(crossed(F.col("ring")) / 2), 4).alias("area"))


@query("points_in_triangles", "SELECT poly_id, count(event_id) AS n, round(coalesce(sum(CAST(value AS DECIMAL(18, 4))), 0)::DOUBLE, 4) AS total FROM fx_polys LEFT JOIN fx_points ON lon > minx + 0.0033 AND lat > miny + 0.0017 AND (lon - minx - 0.0033) / (maxx - minx) + (lat - miny - 0.0017) / (maxy - miny) < 1 GROUP BY poly_id", "fx_polys", "fx_points")
def points_in_triangles(s, d):
    """Events within regions that are no boxes; regions without any have 0."""
    at = lambda x, y: F.struct((F.col(x) + 0.0033).alias("x"), (F.col(y) + 0.0017).alias("y"))
    regions = view(s, d, "fx_polys").select(F.col("poly_id").alias("geom_id"), F.array(F.array(F.array(at("minx", "miny"), at("maxx", "miny"), at("minx", "maxy")))).alias("shape"))
    points = view(s, d, "fx_points").select("event_id", F.col("value").cast("decimal(18,4)").alias("value"), "lon", "lat")
    members, once = forms(regions, "geom_id")
    found = within_shapes(points, once, "lon", "lat").groupBy("geom_id").agg(F.count("event_id").alias("n"), F.sum("value").alias("total"))
    every = of_forms(members, found, "geom_id", "left")
    return every.select(F.col("geom_id").alias("poly_id"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0)).cast("double"), 4).alias("total"))


@query("stream_day_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_day_counts(s, d):
    counts = run_once(s, d, f"{shared_dir(s)}/day-counts-{uuid.uuid4().hex}")
    return counts.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
