"""Geometries of several parts, unions, buffers, zonal statistics and tiles of shapes of any form against plain versions."""

import json
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonalspark.operators import cells, overlay, shapes
from zonalspark.operators.shapes import SHAPE

BOX = [[(0, 0), (4, 0), (4, 4), (0, 4)]]
HOLED = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 6), (6, 6), (6, 2)]]
TWO = [BOX, [[(20, 20), (25, 20), (20, 25)]]]


def numbers(shape):
    return [[np.array(r, float) for r in part] for part in shape]


def listed(shape):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in shape]


def frame(spark, rows, key="geom_id long"):
    return spark.createDataFrame([(k, None if s is None else listed(s), *more) for k, s, *more in rows], f"{key}, shape {SHAPE}")


def star(r, n, at=(0, 0), size=10.0):
    """A ring with notches."""
    return [(at[0] + size * (0.4 + 0.6 * r.random()) * math.cos(2 * math.pi * k / n), at[1] + size * (0.4 + 0.6 * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def plain_length(shape, y):
    """Stretches of a level line inside a shape."""
    xs = []
    for part in shape:
        for r in part:
            for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]], strict=True):
                if (y0 > y) != (y1 > y):
                    xs.append(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    xs.sort()
    return list(zip(xs[::2], xs[1::2], strict=True))


def plain_area(many, how):
    """Exact area covered by all (any, or every) shapes: between the heights of corners and crossings lengths change evenly."""
    sides = [(a, b) for s in many for part in s for r in part for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    heights = {y for a, b in sides for _, y in (a, b)}
    for i, (a, b) in enumerate(sides):
        for c, d in sides[:i]:
            e, f = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
            turn = e[0] * f[1] - e[1] * f[0]
            if turn:
                t = ((c[0] - a[0]) * f[1] - (c[1] - a[1]) * f[0]) / turn
                heights.add(a[1] + t * e[1]) if 0 <= t <= 1 else None
    total, heights = 0.0, sorted(heights)
    for lo, hi in zip(heights, heights[1:], strict=False):
        own = [plain_length(s, (lo + hi) / 2) for s in many]
        if how == "any":
            at = -math.inf
            for a, b in sorted(x for o in own for x in o):
                total += (hi - lo) * max(0.0, b - max(a, at))
                at = max(at, b)
        else:
            total += (hi - lo) * sum(max(0.0, min(b, d) - max(a, c)) for a, b in own[0] for c, d in own[1])
    return total


def ewkb(shape, order="<", srid=None, z=False, iso=False):
    """A multi-polygon as databases write it."""
    flags = (0x20000000 if srid else 0) | (0x80000000 if z and not iso else 0)
    code = lambda k: k + (1000 if z and iso else 0) + flags
    first = b"\x01" if order == "<" else b"\x00"

    def polygon(part):
        out = first + struct.pack(f"{order}I", code(3) & ~0x20000000) + struct.pack(f"{order}I", len(part))
        for r in part:
            closed = [*r, r[0]]
            out += struct.pack(f"{order}I", len(closed)) + b"".join(struct.pack(f"{order}{2 + z}d", *p, *([7.0] if z else [])) for p in closed)
        return out

    return first + struct.pack(f"{order}I", code(6)) + (struct.pack(f"{order}I", srid) if srid else b"") + struct.pack(f"{order}I", len(shape)) + b"".join(map(polygon, shape))


def test_wkb_of_all_forms(spark):
    shape = [HOLED, TWO[1]]
    forms = [ewkb(shape), ewkb(shape, ">"), ewkb(shape, srid=4326), ewkb(shape, ">", 4326, z=True), ewkb(shape, z=True), ewkb(shape, z=True, iso=True)]
    rows = [(i, b) for i, b in enumerate(forms)] + [(6, b""), (7, b"\x01\x06"), (8, None), (9, forms[0][:-5]), (10, b"\x09" + forms[0][1:]), (11, struct.pack("<BII", 1, 7, 0)), (12, struct.pack("<BII", 1, 6, 0))]
    out = {r.i: r.geometry for r in shapes.decoded(spark.createDataFrame(rows, "i int, wkb binary").repartition(3)).collect()}
    for i in range(6):
        assert out[i].kind == "MultiPolygon" and out[i].srid == (4326 if i in (2, 3) else None)
        assert [[[tuple(p) for p in r] for r in part] for part in out[i].parts] == shape
    assert [out[i] for i in range(6, 12)] == [None] * 6
    assert out[12].parts == []


def test_wkb_round_trip(spark):
    r = random.Random(1)
    rows = [(i, [[star(r, 7), star(r, 5)], [star(r, 4)]][: i % 3]) for i in range(20)] + [(99, None)]
    out = shapes.decoded(shapes.encoded(frame(spark, rows), srid=3857)).select("*", shapes.shape_area(F.col("shape")).alias("a"), shapes.shape_area(F.col("geometry.parts")).alias("b")).collect()
    assert all(x["shape"] == (x.geometry and x.geometry.parts) and x.a == x.b for x in out)
    for kind, shape in (("Point", [[[(1, 2)]]]), ("LineString", [[[(1, 2), (3, 4), (1, 2)]]]), ("MultiPoint", [[[(1, 2)]], [[(3, 4)]]]), ("MultiLineString", [[[(1, 2), (3, 4)]], [[(5, 6), (7, 8)]]]), ("Polygon", [HOLED]), ("Point", []), ("Polygon", [])):
        got = shapes.read_wkb(shapes.wkb(numbers(shape), kind))
        assert got[0] == kind and [[r.tolist() for r in p] for p in got[2]] == [[np.array(r, float).tolist() for r in p] for p in shape]


def test_columns_of_shapes_keep_nulls_and_slices():
    column = shapes.shapes_out([numbers(TWO), None, [], numbers([HOLED])])
    back = shapes.shapes_in(column.slice(1))
    assert back[0] is None and back[1] == [] and [r.tolist() for r in back[2][0]] == [np.array(r, float).tolist() for r in HOLED]
    assert shapes.shapes_in(shapes.shapes_out([])) == [] and len(shapes.shapes_out([None])) == 1


def test_areas_and_places(spark):
    rows = frame(spark, [(1, [HOLED]), (2, TWO), (3, []), (4, None)])
    got = {r.geom_id: r for r in rows.select("geom_id", shapes.shape_area(F.col("shape")).alias("area"), *shapes.shape_bounds(F.col("shape"))).collect()}
    assert got[1].area == 84 and got[2].area == 28.5 and got[3].area == 0 and got[4].area is None
    assert tuple(got[2])[2:] == (0, 0, 25, 25)
    places = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (2.0, 3.0), (0.0, 1.0), (10.0, 10.0), (6.0, 6.0), (5.0, 9.0), (2.0, 2.0), (-1.0, 2.0), (1.0, 2.0), (1.0, 6.0)], "x double, y double")
    inside = {tuple(r) for r in places.crossJoin(rows.where("geom_id = 1")).where(shapes.strictly_within(F.col("x"), F.col("y"), F.col("shape"))).select("x", "y").collect()}
    assert inside == {(1, 1), (5, 9), (1, 2), (1, 6)}


def test_common_area_of_notched_shapes(spark):
    r = random.Random(5)
    pairs = [([[star(r, 9, (r.random() * 8, r.random() * 8))]], [HOLED] if i % 3 == 0 else [[star(r, 11, (r.random() * 8, 5))]]) for i in range(25)]
    for a, b in pairs:
        assert shapes.common_area(numbers(a), numbers(b)) == pytest.approx(plain_area([a, b], "both"), abs=1e-9)
    assert shapes.common_area(numbers([BOX]), numbers([[[(4, 0), (8, 0), (8, 4)]]])) == 0
    left = frame(spark, [(i, a) for i, (a, _) in enumerate(pairs)])
    right = frame(spark, [(i, b) for i, (_, b) in enumerate(pairs)] + [(50, None)], "poly_id long")
    got = {(x.geom_id, x.poly_id): x.area for x in cells.shape_overlaps(left, right, "geom_id", "poly_id", 5.0).collect()}
    for i in range(0, 25, 4):
        for j in range(25):
            want = plain_area([pairs[i][0], pairs[j][1]], "both")
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=1e-8)


def union_of(spark, rows, **more):
    out = {}
    for x in overlay.union_shapes(frame(spark, rows, "grp long").repartition(3), "grp", **more).collect():
        out.setdefault(x.grp, []).append(([(p.x, p.y) for p in x.ring], x.hole))
    return out


def area_of(rings):
    return sum(shapes.signed_area(np.array(r)) for r, _ in rings)


def test_union_of_crossing_rings(spark):
    r = random.Random(9)
    groups = {g: [[[star(r, 8 + g, (r.random() * 20, r.random() * 20), 8)]] for _ in range(12)] for g in range(4)}
    groups[4] = [[HOLED], [HOLED]]  # equal ones
    groups[5] = [[HOLED], [[[(3, 3), (5, 3), (5, 5), (3, 5)]]], [[[(10, 0), (20, 0), (20, 10), (10, 10)]]]]  # an island in a hole, a shared side
    groups[6] = [[BOX], [[[(4, 4), (8, 4), (8, 8), (4, 8)]]]]  # touch at a corner
    groups[7] = [[[[(k, 0), (k + 2, 0), (k + 2, 3), (k, 3)]]] for k in range(0, 40)]  # a long row
    rows = [(g, s) for g, own in groups.items() for s in own] + [(8, None), (9, [])]
    for more in ({}, {"sides": 12, "size": float(1 << 31)}):
        out = union_of(spark, rows, **more)
        assert set(out) == set(range(8))
        for g, own in groups.items():
            assert area_of(out[g]) == pytest.approx(plain_area(own, "any"), abs=1e-5)
            assert all((shapes.signed_area(np.array(ring)) < 0) == hole for ring, hole in out[g])
        assert sorted(len(ring) for ring, _ in out[5]) == [4, 4, 4] or len(out[5]) == 3
        assert len(out[6]) == 2 and len(out[7]) == 1 and len(out[7][0][0]) == 4
        assert sorted(hole for _, hole in out[4]) == [False, True]


def test_union_of_one_large_group(spark):
    """Hundreds of boxes of one group, most of them alike, over many cells."""
    r = random.Random(2)
    boxes = [(x, y, x + 1 + r.random(), y + 1 + r.random()) for x, y in ((r.randint(0, 30), r.randint(0, 30)) for _ in range(300))] * 2
    rows = [(1, [[[(a, b), (c, b), (c, d), (a, d)]]]) for a, b, c, d in boxes]
    xs, ys = (sorted({v for box in boxes for v in (box[k], box[k + 2])}) for k in (0, 1))
    grid = np.zeros((len(xs), len(ys)), bool)
    for a, b, c, d in boxes:
        grid[xs.index(a) : xs.index(c), ys.index(b) : ys.index(d)] = True
    want = (np.diff(xs)[:, None] * np.diff(ys)[None] * grid[:-1, :-1]).sum()
    assert area_of(union_of(spark, rows, size=float(1 << 32), sides=100)[1]) == pytest.approx(want, abs=1e-5)


def test_buffer_keeps_notches(spark):
    """An L whose notch isn't filled: strips, sectors of 32nds of a circle, less the square counted twice in the notch."""
    step = 1 / overlay.DEGREE
    ell = [[[(0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40)]]]
    scaled = [[[(x * step, (y - 20) * step) for x, y in r] for r in part] for part in ell]
    line = [[[(0.0, 0.0), (30 * step, 0.0)]]]
    rows = spark.createDataFrame([(1, listed(scaled), "Polygon"), (2, listed(line), "LineString"), (3, listed([[[(1.0, 0.0)]]]), "Point"), (4, None, "Polygon"), (5, [], "Polygon")], f"geom_id long, shape {SHAPE}, kind string")
    got = {}
    for x in overlay.buffers(rows, "geom_id", 3, kind="kind").collect():
        got[x.geom_id] = got.get(x.geom_id, 0) + shapes.signed_area(np.array([(p.x, p.y) for p in x.ring])) * overlay.DEGREE**2
    scale = math.cos(math.radians(0))
    disc = 32 / 2 * math.sin(2 * math.pi / 32) * 9
    assert got[1] == pytest.approx((700 + 160 * 3 - 9 + 5 / 4 * disc) * scale, rel=1e-6)
    assert got[2] == pytest.approx(30 * 6 + disc, rel=1e-6) and got[3] == pytest.approx(disc, rel=1e-6) and set(got) == {1, 2, 3}


def test_buffer_by_hand_in_other_units(spark):
    one = overlay.buffers(frame(spark, [(1, [BOX])]), "geom_id", 2, "miles").collect()
    two = overlay.buffers(frame(spark, [(1, [BOX])]), "geom_id", 3218.688, "meters").collect()
    assert len(one) == len(two) == 1 and shapes.signed_area(np.array(one[0].ring)) == pytest.approx(shapes.signed_area(np.array(two[0].ring)), rel=1e-6)


def test_points_through_the_covering(spark):
    r = random.Random(4)
    many = [(i, [[star(r, 60, (r.random() * 40 - 20, r.random() * 40 - 20), 15)]]) for i in range(6)] + [(6, [HOLED]), (7, [[[(-16, -16), (16, -16), (16, 16), (-16, 16)]]]), (8, None), (9, [])]
    places = [(i, r.choice([r.random() * 40 - 20, float(r.randint(-20, 20)), 8.0]), r.choice([r.random() * 40 - 20, float(r.randint(-20, 20)), 0.0])) for i in range(600)]
    points = spark.createDataFrame(places, "p long, lon double, lat double").repartition(4)
    rows = frame(spark, many)
    got = sorted((x.p, x.geom_id) for x in cells.within_shapes(points, rows, "lon", "lat", sides=8).collect())
    want = sorted((x.p, x.geom_id) for x in points.crossJoin(rows).where(shapes.strictly_within(F.col("lon"), F.col("lat"), F.col("shape"))).collect())
    assert got == want and len(got) > 300
    assert {x.whole for x in cells.covering(rows, sides=8).select("whole").distinct().collect()} == {True, False}


def test_all_points_in_one_cell(spark):
    points = spark.range(5000).select("id", (F.col("id") / 10_000).alias("lon"), (F.col("id") % 100 / 1000).alias("lat"))
    rows = frame(spark, [(1, [[[(0, 0), (0.3, 0), (0, 0.3)]]]), (2, [[[(-20, -20), (20, -20), (20, 20), (-20, 20)]]])])
    found = cells.within_shapes(points, rows, "lon", "lat")
    assert {x.geom_id: x["count"] for x in found.groupBy("geom_id").count().collect()} == {1: sum(0 < i / 10_000 and 0 < i % 100 / 1000 and i / 10_000 + i % 100 / 1000 < 0.3 for i in range(5000)), 2: 5000}


def test_zonal_statistics_of_shapes(spark):
    r = random.Random(8)
    many = [(i, [[star(r, 12, (r.random() * 20, r.random() * 20), 6)]]) for i in range(8)] + [(8, [HOLED]), (9, None), (10, [[[(50, 50), (51, 50), (50, 51)]]]), (11, [[[(0.25, 0.25), (3.25, 0.25), (3.25, 3.25), (0.25, 3.25)]]])]
    pixels = spark.range(6400).select(((F.col("id") % 80) * 0.5 - 7.75).alias("x"), (F.floor(F.col("id") / 80) * 0.5 - 7.75).alias("y"), (F.col("id") % 97).cast("double").alias("val"))
    rows = frame(spark, many)
    got = {x.geom_id: (x["count"], x["sum"], x["min"]) for x in cells.zonal_shapes(rows, pixels, (-8.0, -8.0, 0.5, 0.5)).collect()}
    want = {k: (0, None, None) for k, _ in many}
    found = pixels.crossJoin(rows).where(shapes.strictly_within(F.col("x"), F.col("y"), F.col("shape"))).groupBy("geom_id").agg(F.count("val").alias("n"), F.sum("val").alias("s"), F.min("val").alias("m"))
    want |= {x.geom_id: (x.n, x.s, x.m) for x in found.collect()}
    assert got == want and got[10] == (0, None, None) and got[11][0] == 25


def test_area_weights_of_shapes(spark):
    features = frame(spark, [(1, [[[(0, 0), (10, 0), (0, 10)]]]), (2, [HOLED]), (3, [[[(90, 0), (91, 0), (90, 1)]]]), (4, None)])
    polys = spark.createDataFrame([(1, listed([BOX]), 160.0), (2, listed([[[(8, 8), (12, 8), (12, 12), (8, 12)]]]), 100.0), (3, listed([[[(1, 1), (2, 2), (3, 3)]]]), 50.0)], f"poly_id long, shape {SHAPE}, amount double")
    got = {x.geom_id: x.weighted for x in cells.area_weighted_shapes(features, polys, "amount").collect()}
    assert got == {1: 160, 2: 120 + 25, 3: 0, 4: 0}


def test_tiles_are_cut_with_a_rim(spark):
    rows = frame(spark, [(1, [[[(-170, -80), (170, -80), (170, 80), (-170, 80)]]]), (2, [[[(1, 1), (2, 1), (2, 2), (1, 2)]]]), (3, None)])
    got = cells.tiled(rows, 2)
    assert set(got.columns) == {"geom_id", "tx", "ty", "tile"}
    found = {(x.geom_id, x.tx, x.ty): x.tile for x in got.collect()}
    assert len([k for k in found if k[0] == 1]) == 16 and {k[1:] for k in found if k[0] == 2} == {(2, 1), (1, 1)} | {k[1:] for k in found if k[0] == 2}
    middle = [(p.x, p.y) for p in found[1, 1, 1][0][0]]
    assert sorted(middle) == sorted([(-256, -256), (4352, -256), (4352, 4352), (-256, 4352)])


def test_geojson_coordinates(spark):
    rows = [("Polygon", json.dumps([[[*p] for p in [*r, r[0]]] for r in HOLED])), ("MultiPolygon", json.dumps([[[[*p] for p in [*r, r[0]]] for r in part] for part in TWO])), ("Point", "[1, 2]"), ("LineString", "[[1,2],[3,4]]"), ("MultiPoint", "[[1,2],[3,4]]"), ("MultiLineString", "[[[1,2],[3,4]]]"), ("Polygon", "[[1,2]]"), ("Polygon", "broken"), ("Circle", "[1,2]"), (None, None), ("Point", "[1]")]
    got = [x[0] for x in spark.createDataFrame(rows, "kind string, c string").coalesce(1).select(shapes.parsed(F.col("kind"), F.col("c"))).collect()]
    plain = [None if s is None else [[[tuple(p) for p in r] for r in part] for part in s] for s in got]
    assert plain == [[HOLED], TWO, [[[(1, 2)]]], [[[(1, 2), (3, 4)]]], [[[(1, 2)]], [[(3, 4)]]], [[[(1, 2), (3, 4)]]], None, None, None, None, None]


def test_shapes_of_nothing(spark):
    none = frame(spark, [(1, None)]).where("false")
    assert overlay.union_shapes(none.withColumnRenamed("geom_id", "grp"), "grp").count() == 0
    assert cells.covering(none).count() == 0 and shapes.encoded(none).count() == 0
    assert pa.types.is_list(shapes.shapes_out([]).type)


def test_union_of_a_coverage_with_crooked_borders(spark):
    """Cells of a bent grid whose borders have many shared places: one ring is left, none of the inner borders."""
    r, n, borders = random.Random(5), 6, {}
    corner = {(i, j): (i * 3 + r.uniform(-1, 1) + 0.123456789012, j * 3 + r.uniform(-1, 1)) for i in range(n + 1) for j in range(n + 1)}

    def border(a, b):
        low, high = min(a, b), max(a, b)
        if (low, high) not in borders:
            p, q = corner[low], corner[high]
            borders[low, high] = [(p[0] + (q[0] - p[0]) * t + r.uniform(-0.2, 0.2), p[1] + (q[1] - p[1]) * t + r.uniform(-0.2, 0.2)) for t in (0.25, 0.5, 0.75)]
        return borders[low, high][:: 1 if low == a else -1]

    cells_of = []
    for i in range(n):
        for j in range(n):
            round_ = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            cells_of.append([[[v for a, b in zip(round_, [*round_[1:], round_[0]], strict=True) for v in (corner[a], *border(a, b))]]])
    rings = union_of(spark, [(1, s) for s in cells_of], size=float(1 << 32), sides=60)[1]
    assert [(len(ring), hole) for ring, hole in rings] == [(n * 4 * 4, False)]
    assert area_of(rings) == pytest.approx(sum(shapes.signed_area(np.array(s[0][0])) for s in cells_of), abs=1e-6)
