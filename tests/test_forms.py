"""Equal shapes are worked out once: what is joined grows with the different shapes, results with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_shapes import BOX, frame

from zonalspark.operators import cells, overlay, processors, shapes

COPIES, GRID = 40, (0.0, 0.0, 1.0, 1.0)
CUT = [[(0, 0), (6, 0), (0, 6)]]


@pytest.fixture
def rows(spark):
    return frame(spark, [(k, [BOX] if k % 2 else [CUT]) for k in range(COPIES)] + [(COPIES, None)])


def test_equal_shapes_have_one_form(rows):
    members, once = cells.forms(rows, "geom_id")
    assert once.count() == 2 and members.count() == COPIES + 1 and members.where("_form is null").count() == 1


def counted(monkeypatch, module, name, held):
    """Puts down how many shapes a step is given."""
    step = getattr(module, name)

    def run(*a, **k):
        held.append((name, [x.count() for x in a if "shape" in getattr(x, "columns", ())]))
        return step(*a, **k)

    monkeypatch.setattr(module, name, run)


def test_statistics_by_name_join_each_shape_once(spark, rows, monkeypatch):
    held = []
    for name in ("within_shapes", "pixels_within", "form_overlaps"):
        counted(monkeypatch, cells, name, held)
    pixels = spark.range(64).select((F.col("id") % 8 + 0.5).alias("x"), (F.floor(F.col("id") / 8) + 0.5).alias("y"), F.lit(2.0).alias("val"), F.lit("a").alias("class"))
    points = pixels.select(F.col("x").alias("lon"), F.col("y").alias("lat"), "val")
    layer = frame(spark, [(k, [BOX]) for k in range(5)], "poly_id long").withColumn("amount", F.lit(3.0))
    of = lambda function, data, **more: {x.geom_id: x.value for x in processors.run(function, rows, data, name="n", **more).collect()}
    box, cut, none = 1, 0, COPIES
    got = of("raster_count", pixels, grid=GRID)
    assert (got[box], got[cut], got[none], len(got)) == (16, 15, 0, COPIES + 1)
    got = of("raster_categorical", pixels, grid=GRID, category_map={"a": "b"})
    assert (got[box], got[cut]) == (16, 15)
    got = of("events_within", points, field="val")
    assert (got[box], got[cut], got[none]) == (32, 30, 0)
    got = of("polygons_weighted", layer)
    assert (got[box], got[cut], got[none]) == (15, 13, 0)  # 5 boxes of 3, of which the triangle has 14 of 16
    got = of("boxes_overlapping", layer)
    assert (got[box], got[cut], got[none]) == (5, 5, 0)
    assert {n for n, _ in held} == {"within_shapes", "pixels_within", "form_overlaps"}
    assert all(max(sizes) <= 2 for _, sizes in held)


def test_query_of_points_joins_different_triangles_only(spark, monkeypatch):
    from zonalspark.plans import geometry_queries

    held = []
    counted(monkeypatch, geometry_queries, "within_shapes", held)
    assert geometry_queries.points_in_triangles(spark, "/root/testdata/sf0.1").columns == ["poly_id", "n", "total"]
    assert held == [("within_shapes", [180])]  # of 1,000


def test_zonal_statistics_join_each_shape_once(spark, rows, monkeypatch):
    held = []
    counted(monkeypatch, cells, "pixels_within", held)
    pixels = spark.range(64).select((F.col("id") % 8 + 0.5).alias("x"), (F.floor(F.col("id") / 8) + 0.5).alias("y"), F.lit(2.0).alias("val"), (F.col("id") % 8 < 2).alias("west"))
    got = {x.geom_id: (x["count"], x["sum"]) for x in cells.zonal_shapes(rows, pixels, GRID).collect()}
    assert len(got) == COPIES + 1 and (got[0], got[1], got[COPIES]) == ((15, 30.0), (16, 32.0), (0, None))
    got = {(x.geom_id, x.west): x["count"] for x in cells.zonal_shapes(rows, pixels, GRID, ["west"]).collect()}
    assert len(got) == 2 * COPIES and (got[1, True], got[1, False]) == (8, 8)
    assert all(max(sizes) <= 2 for _, sizes in held) and held


def test_weights_of_equal_polygons_keep_their_own_values(spark, rows, monkeypatch):
    held = []
    counted(monkeypatch, cells, "form_overlaps", held)
    features = frame(spark, [(1, [BOX]), (2, [BOX]), (3, None)])
    polys = rows.select(F.col("geom_id").alias("poly_id"), "shape").withColumn("amount", F.col("poly_id") * 18.0)
    got = {x.geom_id: x.weighted for x in cells.area_weighted_shapes(features, polys, "amount").collect()}
    # triangles have 14 of 18 inside
    whole = sum(k * 18 if k % 2 else k * 14 for k in range(COPIES))
    assert got[1] == got[2] and abs(got[1] - whole) <= 1 and got[3] == 0
    assert held == [("form_overlaps", [2, 1])]


def test_shared_areas_are_worked_out_once(spark, rows, monkeypatch):
    held = []
    counted(monkeypatch, cells, "form_overlaps", held)
    layer = frame(spark, [(k, [BOX]) for k in range(5)] + [(9, [[[(90, 0), (91, 0), (91, 1)]]])], "poly_id long")
    got = {(x.poly_id, x.geom_id): x.area for x in cells.shape_overlaps(layer, rows, "poly_id", "geom_id").collect()}
    assert got == {(p, k): 16.0 if k % 2 else 14.0 for p in range(5) for k in range(COPIES)}
    assert held == [("form_overlaps", [2, 2])]


def test_equal_shapes_are_widened_once(spark, monkeypatch):
    held = []
    counted(monkeypatch, overlay, "united", held)
    rows = frame(spark, [(k, [BOX] if k % 2 else [CUT]) for k in range(COPIES)] + [(COPIES, None)]).withColumn("kind", F.when(F.col("geom_id") == 3, "MultiLineString").otherwise("Polygon"))
    found = overlay.buffers(rows, "geom_id", 3, kind="kind").collect()
    rings = {}
    for x in found:
        rings.setdefault(x.geom_id, []).append((x.hole, sorted((p.x, p.y) for p in x.ring)))
    assert set(rings) == set(range(COPIES))
    assert all(rings[k] == rings[k % 2] for k in range(COPIES) if k != 3)
    assert rings[3] != rings[1]  # a line, of equal points, is another form
    assert len(held) == 1 and held[0][1][0] < 40


def test_groups_of_the_same_shapes_are_united_once(spark, monkeypatch):
    held = []
    counted(monkeypatch, overlay, "united", held)
    far = [[(2, 2), (9, 2), (9, 3), (2, 3)]]
    sets = [[BOX], [BOX, far], [far, BOX, BOX], [far]]
    rows = [(k, [s]) for k in range(COPIES) for s in sets[k % 4]] + [(None, [far]), (None, [BOX]), (COPIES, None)]
    got = {x.grp: (x.n, x.area) for x in overlay.union_shapes(frame(spark, rows, "grp long").repartition(3), "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(shapes.crossed(F.col("ring")) / 2), 6).alias("area")).collect()}
    area = {0: 16.0, 1: 21.0, 2: 21.0, 3: 7.0}
    assert got == {k: (1, area[k % 4]) for k in range(COPIES)} | {None: (1, 21.0)}
    assert held == [("united", [4])]  # one box, one strip, and both


def test_shapes_meet_blocks_of_pixels_not_pixels(spark, monkeypatch):
    held = []
    step = cells.pixels_within
    monkeypatch.setattr(cells, "pixels_within", lambda pixels, *a: held.append(pixels.where("level = 0").count()) or step(pixels, *a))
    places = spark.range(64).select((F.col("id") % 8 + 0.5).alias("x"), (F.floor(F.col("id") / 8) + 0.5).alias("y"))
    pixels = places.crossJoin(spark.range(10).select((F.col("id") + 1).cast("decimal(18,2)").alias("val"))).unionByName(places.withColumn("val", F.lit(None).cast("decimal(18,2)")))
    pixels = pixels.unionByName(spark.sql("SELECT double('NaN') AS x, 0.5D AS y, CAST(99 AS decimal(18,2)) AS val"))
    shapes_ = frame(spark, [(k, [[[(0, 0), (8 - k / 4, 0), (0, 8)]]]) for k in range(12)] + [(90, [[[(90, 90), (91, 90), (90, 91)]]])])
    got = {x.geom_id: (x["count"], x["sum"], x["mean"], x["min"], x["max"]) for x in cells.zonal_shapes(shapes_, pixels, GRID).collect()}
    at = [(x.x, x.y) for x in places.collect()]
    for k in range(12):
        n = sum(x / (8 - k / 4) + y / 8 < 1 for x, y in at)
        assert got[k] == (10 * n, 55 * n, 5.5, 1, 10)
    assert got[90] == (0, None, None, None, None)
    assert held == [65 - 1]  # of 705 pixels


def test_long_stretches_are_few_blocks(spark):
    one = np.zeros(1)
    owner, row, level, block, low, high = cells.blocks_of(one.astype(int), one.astype(int), one + 0.25, one + 9999.75, 0.0, 1.0)
    assert len(block) < 9999 / cells.BASE**cells.LEVELS + 6 * (cells.LEVELS + 1)
    columns = np.concatenate([np.arange(b * cells.BASE**n, (b + 1) * cells.BASE**n) for n, b in zip(level, block, strict=True)])
    assert sorted(columns) == list(range(10000))
    assert (low[block == 0].max(), high[(level == 0) & (block == 9999)].min()) == (0.25, 9999.75)


def test_small_groups_are_united_without_cells(spark, monkeypatch):
    held = []
    step = overlay.cells_split
    monkeypatch.setattr(overlay, "cells_split", lambda rows, by, *a: held.append({x[by] for x in rows.select(by).collect()}) or step(rows, by, *a))
    rng = np.random.default_rng(3)
    walk = lambda: [[[tuple(map(float, p)) for p in rng.integers(-12, 12, 2) + rng.integers(1, 9, (4, 2))]]]
    rows = [(k, walk()) for k in range(6) for _ in range(4)] + [(3, []), (50, [])]
    sums = lambda sides: {x.grp: (x.outer, x.holes, x.area) for x in overlay.union_shapes(frame(spark, rows, "grp long"), "grp", sides=sides).groupBy("grp").agg(F.count_if(~F.col("hole")).alias("outer"), F.count_if("hole").alias("holes"), F.round(F.sum(shapes.crossed(F.col("ring")) / 2), 4).alias("area")).collect()}
    plain = sums(300)
    assert held == [] and set(plain) == set(range(6))
    cut = sums(15)
    assert len(held[0]) == 6  # forms
    assert plain == cut


def test_large_groups_are_still_cut_to_cells(spark, monkeypatch):
    held = []
    step = overlay.cells_split
    monkeypatch.setattr(overlay, "cells_split", lambda rows, by, *a: held.append(rows.count()) or step(rows, by, *a))
    steps = [(7, [[[(2 * k, 0), (2 * k + 3, 0), (2 * k + 3, 1), (2 * k, 1)]]]) for k in range(90)]
    got = {x.grp: x.area for x in overlay.union_shapes(frame(spark, [*steps, (1, [BOX]), (1, [CUT])], "grp long"), "grp").groupBy("grp").agg(F.round(F.sum(shapes.crossed(F.col("ring")) / 2), 6).alias("area")).collect()}
    assert got == {7: 181.0, 1: 20.0} and held == [90]


def test_buffers_are_united_without_cells(spark, monkeypatch):
    monkeypatch.setattr(overlay, "cells_split", None)
    rows = frame(spark, [(k, [[[(0, 0), (1 + k / 10, 0), (1 + k / 10, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]]]) for k in range(8)])
    found = overlay.buffers(rows, "geom_id", 5).collect()
    assert sorted(x.geom_id for x in found) == list(range(8)) and not any(x.hole for x in found)


def test_pairs_of_few_sides_are_not_cut_and_meet_once(spark, monkeypatch):
    held = {"rows": 0}
    areas = cells.shared_areas
    monkeypatch.setattr(cells, "shared_areas", lambda pairs, *a: held.update(rows=pairs.count()) or areas(pairs, *a))
    cut = lambda k: [[[(k, 0), (k + 9, 0), (k, 9)]]]
    left = frame(spark, [(k, cut(float(k))) for k in range(6)], "poly_id long")
    many = [[[(np.cos(a) * 30.0, np.sin(a) * 30.0) for a in np.arange(200) * np.pi / 100]]]
    right = frame(spark, [(1, [[[(-20, -20), (20, -20), (20, 20), (-20, 20)]]]), (2, [[[(0, -9), (3, -9), (3, 0), (0, 0)]]])])
    got = {(x.poly_id, x.geom_id): x.area for x in cells.shape_overlaps(left, right, "poly_id", "geom_id").collect()}
    assert got == {(k, 1): pytest.approx(40.5) for k in range(6)}  # what only touches has none
    assert held["rows"] == 6  # once a pair, not once a cell
    round_ = frame(spark, [(3, many)])
    got = {(x.poly_id, x.geom_id): x.area for x in cells.shape_overlaps(left, round_, "poly_id", "geom_id").collect()}
    assert got == {(k, 3): pytest.approx(40.5) for k in range(6)}


def test_areas_of_many_pairs_are_those_of_each_pair():
    rng = np.random.default_rng(5)
    ring = lambda: rng.integers(-6, 7, (rng.integers(3, 7), 2)) / 2 if rng.integers(2) else rng.normal(0, 3, (5, 2))
    shape = lambda: [[ring()] for _ in range(rng.integers(0, 3))] if rng.integers(9) else None
    first, second = ([shape() for _ in range(600)] for _ in range(2))
    calls = []
    plain = shapes.common_area
    want = [None if a is None or b is None else plain(a, b) for a, b in zip(first, second, strict=True)]
    shapes.common_area = lambda a, b: calls.append(1) or plain(a, b)
    try:
        got = shapes.areas_of(first, second)
    finally:
        shapes.common_area = plain
    assert [x is None for x in got] == [x is None for x in want]
    assert all(x is None or (x == pytest.approx(y, abs=1e-9) and (x > 0) == (y > 0)) for x, y in zip(got, want, strict=True))
    assert len(calls) < 400


def test_shapes_of_one_group_of_a_form_are_kept(spark):
    rows = [(k, [BOX]) for k in range(COPIES)] + [(k, [CUT]) for k in range(0, COPIES, 2)] + [(0, [CUT]), (None, [CUT]), (COPIES, None)]
    groups, once = overlay.alike(frame(spark, rows, "grp long"), "grp")
    assert sorted(x["count"] for x in groups.groupBy("_form").count().collect()) == [1, COPIES // 2, COPIES // 2]
    assert sorted(x["count"] for x in once.groupBy("grp").count().collect()) == [1, 1, 2]
    # no shapes are sorted but those of the groups that stand for their form
    assert once._jdf.queryExecution().optimizedPlan().toString().count("first(shape") == 1


def test_small_unions_keep_coordinates_of_their_shapes(spark):
    """Places between two quanta; corners where sides of boxes cross are of their coordinates too."""
    x = [1 / 3, 1 + 1 / 7, 2 + 1 / 9, 3 + 1 / 11]
    box = lambda a, b, c, d: [[[(a, b), (c, b), (c, d), (a, d)]]]
    rows = [(1, box(x[0], x[0], x[2], x[1])), (1, box(x[1], x[0], x[3], x[3])), (2, [[[(x[0], x[0]), (x[3], x[1]), (x[2], x[3])]]])]
    got = {g.grp: {(p.x, p.y) for p in g.ring} for g in overlay.union_shapes(frame(spark, rows, "grp long"), "grp").collect()}
    assert got[1] == {(x[0], x[0]), (x[3], x[0]), (x[3], x[3]), (x[1], x[3]), (x[1], x[1]), (x[0], x[1])}
    assert got[2] == {(x[0], x[0]), (x[3], x[1]), (x[2], x[3])}
    crossing = overlay.union_shapes(frame(spark, [(1, [[[(0, 0), (3, 1), (0, 1)]]]), (1, [[[(1, 0), (2, 0), (1, 2)]]])], "grp long"), "grp").collect()
    want = [(0, 0), (1, 1 / 3), (1, 0), (2, 0), (12 / 7, 4 / 7), (3, 1), (1.5, 1), (1, 2), (1, 1), (0, 1)]
    assert len(crossing) == 1 and np.abs(np.array(sorted((p.x, p.y) for p in crossing[0].ring)) - sorted(want)).max() < 2 * overlay.QUANTUM


def test_weights_are_rounded_as_their_sql_does(spark, tmp_path):
    """Amounts so large that the tenth decimal of a share shows in the sums."""
    import duckdb

    from zonalspark.plans import shape_queries

    tables = {t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("nation", "supplier")}
    tables["supplier"] = tables["supplier"].withColumn("s_acctbal", F.col("s_acctbal") * 1e6)
    duck = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = shape_queries.triangle_weighted(spark, str(tmp_path)).select("geom_id", "weighted").collect()
    want = duck.execute(f"select geom_id, weighted from ({shape_queries.SQL['triangle_weighted']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
