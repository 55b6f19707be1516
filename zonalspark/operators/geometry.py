"""Geometry kernels on rings of points, and what is built on them.

A polygon is an array of points struct(x, y), the first not repeated at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Simplification tolerances in degrees by map zoom.
TOLERANCES = {5: 0.044, 9: 0.003, 12: 0.0003}
RING = "array<struct<x:double,y:double>>"


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy))


def ring_area(ring: Column) -> Column:
    """Planar area by the shoelace formula; 0 for fewer than three points."""
    n = F.size(ring)
    step = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(step, F.lit(0.0), lambda a, b: a + b)) / 2


def ring_bounds(ring: Column) -> list[Column]:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy")]


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; points on an edge may fall either way."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        across = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return F.when(across & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1


def simplify_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that stay when those nearer than tolerance to the line between kept ones go (farthest point first)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, v = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        far = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / length if length else np.hypot(v[:, 0], v[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            spans += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[keep]


def simplified(rows: DataFrame, ring: str, tolerance: float) -> DataFrame:
    """rows with the ring simplified; rings that would fall under three points stay as they are. Null stays null."""
    names, at = rows.columns, rows.columns.index(ring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for points in batch.column(at).to_pylist():
                if points:
                    given = np.array([(p["x"], p["y"]) for p in [*points, points[0]]])
                    left = simplify_points(given, tolerance)[:-1]
                    points = [{"x": float(x), "y": float(y)} for x, y in left] if len(left) >= 3 else points
                out.append(points)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def coverage_simplified(rows: DataFrame, key: str, by: str, ring: str, tolerance: float) -> DataFrame:
    """rows(key, by, ring) with the rings of a collection (by) simplified so that borders that two of them share stay the
    same: points where more than two lines of a collection meet stay, and what lies between them is simplified in one
    direction, whichever ring it is of. Points meet by their coordinates in a shuffle; no collection is gathered. Null and
    empty rings stay as they are."""
    n = F.size(ring)
    near = lambda i: F.get(F.col(ring), F.pmod(i, n))
    points = rows.select(key, by, F.explode(F.transform(F.col(ring), lambda p, i: F.struct(i.alias("i"), p.alias("p"), F.array(near(i - 1), near(i + 1)).alias("near")))).alias("v")).select(key, by, "v.*")
    ways = points.select(by, "p", F.explode("near").alias("q")).distinct().groupBy(by, "p").agg(F.count(F.lit(1)).alias("ways")).where("ways > 2").select(by, "p", F.lit(True).alias("stays"))
    marked = points.drop("near").join(ways, [by, "p"], "left")
    rings = marked.groupBy(key, by).agg(F.array_sort(F.collect_list(F.struct("i", "p", F.coalesce("stays", F.lit(False)).alias("stays")))).alias(ring))

    def shorten(found: list[dict]) -> list[dict]:
        points = [(v["p"]["x"], v["p"]["y"]) for v in found]
        ends = [i for i, v in enumerate(found) if v["stays"]]
        if not ends:  # an island: its least point and the one farthest from it
            first = points.index(min(points))
            ends = sorted({first, max(range(len(points)), key=lambda i: (math.dist(points[i], points[first]), points[i]))})
        out: list[tuple] = []
        for a, b in zip(ends, [*ends[1:], ends[0] + len(points)], strict=True):
            arc = [points[i % len(points)] for i in range(a, b + 1)]
            turned = (arc[-1], arc[-2]) < (arc[0], arc[1])
            left = simplify_points(np.array(arc[::-1] if turned else arc), tolerance).tolist()
            out += (left[::-1] if turned else left)[:-1]
        return [{"x": float(x), "y": float(y)} for x, y in (out if len(out) >= 3 else points)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(shorten, batch.column(2).to_pylist()), kind)], names=[key, by, ring])

    kinds = dict(rows.dtypes)
    done = rings.mapInArrow(run, f"{key} {kinds[key]}, {by} {kinds[by]}, {ring} {RING}")
    return done.unionByName(rows.where(F.coalesce(n, F.lit(0)) <= 0).select(key, by, F.col(ring).cast(RING).alias(ring)))


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile that a point is in."""
    from zonalspark.functions.scalar import MERCATOR, mercator_x, mercator_y

    n = 1 << zoom
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v))).cast("int")
    return place((mercator_x(lon) + MERCATOR) / (2 * MERCATOR) * n), place((MERCATOR - mercator_y(lat)) / (2 * MERCATOR) * n)


def quantised(rows: DataFrame, lon: str, lat: str, zoom: int, extent: int = 4096) -> DataFrame:
    """rows with tx, ty (tile) and px, py (place in it, 0 to extent)."""
    from zonalspark.functions.scalar import MERCATOR, mercator_x, mercator_y

    tx, ty = tile_of(F.col(lon), F.col(lat), zoom)
    edge = 2 * MERCATOR / (1 << zoom)
    out = rows.withColumns({"tx": tx, "ty": ty})
    px = F.floor((mercator_x(F.col(lon)) + MERCATOR - F.col("tx") * edge) / edge * extent).cast("int")
    py = F.floor((MERCATOR - mercator_y(F.col(lat)) - F.col("ty") * edge) / edge * extent).cast("int")
    return out.withColumns({"px": px, "py": py})
