"""Edge cases of the operators."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalspark.functions.scalar import formula
from zonalspark.operators import breaks, charts, control, geometry, ingest, processors, regions, shapes, spatial, upkeep
from zonalspark.plans.relational_queries import QUERIES
from zonalspark.sources.fixtures import view
from zonalspark.sources.vector import read_geojson, write_csv, write_geojson
from zonalspark.streaming.requests import merge_batch

BOXES = [(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0)]


@pytest.fixture
def boxes(spark):
    return spark.createDataFrame(BOXES, "geom_id long, minx double, miny double, maxx double, maxy double")


def test_points_on_an_edge_are_in_no_box(spark, boxes):
    points = spark.createDataFrame([(10.0, 5.0), (9.99, 5.0), (0.0, 0.0)], "lon double, lat double")
    assert [r.geom_id for r in spatial.within(points, boxes, "lon", "lat").collect()] == [1]


def test_empty_selection_is_no_filter_but_disaggregates_into_nothing():
    empty = {"kind": {"type": "categorical", "selected": [], "aggregate": False}}
    assert spatial.disaggregations(empty) == []
    assert spatial.safe_label("__a b/c!" + "x" * 40) == ("a_b_c_" + "x" * 40)[:32]


def test_sums_skip_nan_and_truncate_toward_zero(spark, boxes):
    points = spark.createDataFrame([(1.0, 1.0, 1.9), (1.0, 2.0, float("nan")), (1.0, 3.0, None), (12.0, 1.0, -1.9)], "lon double, lat double, value double")
    out = spatial.filter_aggregate(boxes, points, {"total": (F.col("value"), F.lit(True))})
    assert {r.geom_id: r.total for r in out.collect()} == {1: 1, 2: -1}


def test_box_without_area_weighs_nothing(spark, boxes):
    polys = spark.createDataFrame([(5.0, 5.0, 5.0, 5.0, 100.0), (8.0, 0.0, 12.0, 10.0, 100.0)], "minx double, miny double, maxx double, maxy double, amount double")
    assert {r.geom_id: r.weighted for r in spatial.area_weighted(boxes, polys, "amount").collect()} == {1: 50, 2: 50}


def test_constant_histogram_and_breaks(spark):
    rows = spark.createDataFrame([(3.0,)] * 5 + [(None,)], "v double")
    assert [(r.bin, r.n) for r in charts.histogram(rows, "v").collect()] == [(0, 5)]
    assert {r.cut for r in charts.quantile_breaks(rows, "v").collect()} == {3.0}
    assert charts.histogram(rows.where("v > 9"), "v").count() == 0


def test_correlation_guards(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "a double, b double")
    assert rows.agg(charts.correlation(F.col("a"), F.col("b")).alias("r")).first().r == pytest.approx(1.0)
    assert rows.limit(1).agg(charts.correlation(F.col("a"), F.col("b")).alias("r")).first().r == 0.0


def cuts_of(rows, value, n, size=7):
    return [r.cut for r in breaks.jenks(rows, value, n, size).orderBy("i").collect()]


def test_jenks_finds_the_gaps(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 50, 51, 52, 99, 100)], "v double")
    assert cuts_of(rows, "v", 3) == [1.0, 3.0, 52.0, 100.0]


def spread(values: dict[float, int], cuts: list[float]) -> float:
    """Sum of squares within the classes that end at the cuts."""
    out, low = 0.0, -math.inf
    for cut in cuts[1:]:
        own = [(v, w) for v, w in values.items() if low < v <= cut]
        mean = sum(v * w for v, w in own) / sum(w for _, w in own)
        out, low = out + sum(w * (v - mean) ** 2 for v, w in own), cut
    return out


def test_jenks_takes_every_distinct_value(spark):
    values = {float(v): 1 + v * v % 7 for v in (1, 2, 4, 9, 11, 30, 31, 33, 70, 75, 76, 99)} | {500.0: 9901}
    rows = spark.createDataFrame([(v,) for v, w in values.items() for _ in range(w)] + [(None,)], "v double")
    keys = sorted(values)
    for n in (2, 4, 5):
        cuts = cuts_of(rows, "v", n)
        every = ([keys[0], *ends, keys[-1]] for ends in itertools.combinations(keys[:-1], n - 1))
        assert len(cuts) == n + 1 and spread(values, cuts) == pytest.approx(min(spread(values, x) for x in every))
    assert cuts_of(rows, "v", 50) == [keys[0], *keys]


def test_jenks_of_many_skewed_values(spark):
    """20,000 distinct values in 13 ranges against a plain programme over all of them; most rows hold few of the values."""
    r = np.random.default_rng(3)
    v = np.unique(np.round(np.exp(r.normal(0, 2, 24_000)) * 100, 6))[:20_000]
    w = np.where(np.arange(len(v)) % 1000 == 0, 5_000, r.integers(1, 4, len(v)))
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w, strict=True)], "v double, w long")
    every = rows.select("v", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("k"))
    cuts = cuts_of(every, "v", 4, 1600)
    x = v - np.average(v, weights=w)
    s0, s1, s2 = (np.concatenate([[0], np.cumsum(y)]) for y in (w, w * x, w * x * x))
    best = np.concatenate([[0], np.full(len(v), np.inf)])
    for _ in range(4):
        price = lambda i, j: best[i] + s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (s0[j] - s0[i])  # noqa: B023, E731
        best = np.array([np.inf] + [price(np.arange(j), j).min() for j in range(1, len(v) + 1)])
    assert len(cuts) == 5 and cuts[0] == v[0] and cuts[-1] == v[-1]
    assert spread(dict(zip(v.tolist(), w.tolist(), strict=True)), cuts) == pytest.approx(best[-1], rel=1e-9)


def test_jenks_of_few_and_no_values(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (2.0,)], "v double")
    assert cuts_of(rows, "v", 5) == [2.0, 2.0] and cuts_of(rows.where("v is null"), "v", 5) == []


def test_jenks_query_has_no_merged_classes(spark):
    values = {}
    for r in view(spark, "/root/testdata/sf0.01", "fx_catalog").collect():
        values[r.val] = values.get(r.val, 0) + 1
    v, w = (np.array(x) for x in zip(*sorted(values.items()), strict=True))
    s0, s1, s2 = (np.concatenate([[0], np.cumsum(x)]) for x in (w, w * v, w * v * v))
    best = np.concatenate([[0], np.full(len(v), np.inf)])
    for _ in range(5):
        best = np.array([np.inf] + [min(best[:j] + s2[j] - s2[:j] - (s1[j] - s1[:j]) ** 2 / (s0[j] - s0[:j])) for j in range(1, len(v) + 1)])
    cuts = [r.cut for r in QUERIES["jenks5"](spark, "/root/testdata/sf0.01").orderBy("i").collect()]
    assert len(v) > 300 and len(cuts) == 6 and spread(values, cuts) == pytest.approx(best[-1], rel=1e-9)


def test_formula_rejects_what_it_does_not_know(spark):
    for text in ("[nope] + 1", "-1", "(1", "1 +", "1 ; 2"):
        with pytest.raises(ValueError):
            formula(text, ["a"])


def test_upsert_and_islands(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in control.upsert(old, new, ["k"], [F.desc("t")]).collect()) == [(1, "a"), (2, "d")]
    years = spark.createDataFrame([(1, y) for y in (2000, 2001, 2002, 2005, 2007, 2008, 2008)], "k int, y int")
    assert control.runs_of_numbers(years, ["k"], "y").first().text == "2000-2002, 2005, 2007, 2008"


def test_places_of_a_whole_queue_need_no_task_with_a_whole_status(spark):
    rows = view(spark, "/root/testdata/sf0.001", "fx_requests")
    out = control.places(rows, "status", [("priority", True), ("submit_time", False), ("req_id", False)])
    want, n = [], {}
    for r in sorted(rows.collect(), key=lambda r: (-r.priority, r.submit_time, r.req_id)):
        n[r.status] = n.get(r.status, 0) + 1
        want.append((r.req_id, n[r.status]))
    assert sorted((r.req_id, r.place) for r in out.collect()) == sorted(want)
    alone = control.places(rows.withColumn("status", F.lit(7)), "status", [("req_id", False)])
    assert alone.select(F.spark_partition_id()).distinct().count() > 1 and alone.agg(F.count_distinct("place"), F.max("place")).first()[:] == (len(want),) * 2


def test_geojson_round_trip(spark, tmp_path):
    ring = geometry.box_ring(*(F.col(c) for c in spatial.BOX))
    rows = spark.createDataFrame(BOXES, "geom_id long, minx double, miny double, maxx double, maxy double").withColumn("shape", F.array(F.array(ring), F.array(ring)))
    write_geojson(rows, str(tmp_path / "out"), ["geom_id"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    odd = ['{"type": "Feature", "properties": null, "geometry": null}', '{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [1, 2]}}', '{"type": "Feature", "geometry": {"type": "Circle", "coordinates": [1, 2]}}', '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 3]}}']
    (tmp_path / "in.json").write_text('{"type": "FeatureCollection", "features": [' + ",".join(lines + odd) + "]}")
    back = read_geojson(spark, str(tmp_path / "in.json"))
    found = [(r.properties and r.properties.get("geom_id"), r.kind, r.problem, r.a) for r in back.select("*", shapes.shape_area(F.col("shape")).alias("a")).orderBy("feature").collect()]
    assert sorted(found[:2]) == [("1", "MultiPolygon", None, 200.0), ("2", "MultiPolygon", None, 200.0)]
    assert [x[1:3] for x in found[2:]] == [(None, "no geometry"), ("Polygon", "coordinates"), ("Circle", "kind"), ("Point", None)]
    assert sorted(tuple(r) for r in ingest.skipped(back).collect()) == [("coordinates", 1), ("kind", 1), ("no geometry", 1)]
    (tmp_path / "bare.json").write_text(lines[0])
    (tmp_path / "none.json").write_text('{"type": "FeatureCollection", "features": null}')
    assert read_geojson(spark, str(tmp_path / "bare.json")).count() == 1 and read_geojson(spark, str(tmp_path / "none.json")).count() == 0
    assert read_geojson(spark, str(tmp_path / "out"), lines=True).count() == 2


def test_uploads_have_limits(spark):
    rows = spark.range(6)
    assert ingest.upload_fits(rows, 10, 6) and not ingest.upload_fits(rows, 10, 5) and not ingest.upload_fits(rows, ingest.BYTES + 1, 6)


def test_discovery_wants_one_file_or_a_mask(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.tif").write_text("x")
    assert [r.fname for r in ingest.discovered(spark, str(tmp_path), ".tif").collect()] == ["a.tif"]
    (tmp_path / "b.tif").write_text("xy")
    assert sorted(r.length for r in ingest.discovered(spark, str(tmp_path), ".tif", "Y").collect()) == [1, 2]
    for extension in (".tif", ".none"):
        with pytest.raises(ValueError):
            ingest.discovered(spark, str(tmp_path), extension)


def test_csv_round_trip(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string"), str(tmp_path / "out"))
    assert sorted((r.k, r.v) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == [("1", "a,b"), ("2", None)]


def test_batches_keep_the_newest_row_of_a_key(spark, tmp_path):
    merge = merge_batch(str(tmp_path), ["k"], "t")
    merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int"), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        merge(spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int"), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "v1")).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_statistics_are_found_by_name_only(spark, boxes):
    assert processors.arguments("n", {"name": "o", "k": 1}, {"k": 2}, {"a": "b"}) == {"name": "n_" + hashlib.md5(b'{"k": 2}').hexdigest()[:8], "k": 2, "category_map": {"a": "b"}}
    assert processors.arguments("n", {"name": "o"}, None) == {"name": "o"}
    with pytest.raises(ValueError):
        processors.run("os.system", boxes, boxes)


def plainly_simple(points):
    """All pairs of sides, by exact whole numbers."""
    n = len(points)
    if n < 3 or len(set(points)) < n:
        return False
    sides = [(points[i], points[(i + 1) % n]) for i in range(n)]
    for i, (a, b) in enumerate(sides):
        for j, (c, d) in enumerate(sides[:i]):
            ways = [regions.turn(*x) for x in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))]
            touched = {p for w, (s, e), p in zip(ways, ((a, b), (a, b), (c, d), (c, d)), (c, d, a, b), strict=True) if w == 0 and regions.on(s, e, p)}
            if ways[0] * ways[1] < 0 and ways[2] * ways[3] < 0 or touched and not ((i - j) % n in (1, n - 1) and len(touched) == 1):
                return False
    return True


def test_sweep_finds_what_all_pairs_find():
    r, seen = random.Random(6), [0, 0]
    for k in range(4000):
        wide = r.choice([2, 3, 5, 30])
        points = [(r.randint(0, wide), r.randint(0, wide)) for _ in range(r.randint(3, 7))]
        if k % 3 == 0:  # around a middle, so that many are simple
            points = sorted(set(points), key=lambda p: (math.atan2(p[1] - wide / 2.1, p[0] - wide / 1.9), p))
        want = plainly_simple(points)
        assert regions.simple_ring(np.array(points, float).reshape(-1, 2)) == want, points
        seen[want] += 1
    assert min(seen) > 200


def test_sweep_of_a_long_ring(spark):
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    ring = np.stack([np.cos(turn), np.sin(turn)], 1) * (1 + 0.3 * np.sin(50 * turn))[:, None]
    began = time.time()
    assert regions.simple_ring(ring)
    crossed = ring.copy()
    crossed[40_000] = -2 * ring[40_000]
    assert not regions.simple_ring(crossed) and time.time() - began < 30
    rows = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]), (2, None), (3, []), (4, [{"x": 0.0, "y": 0.0}, {"x": float("nan"), "y": 0.0}, {"x": 0.0, "y": 1.0}])], f"k int, ring {geometry.RING}")
    assert sorted((x.k, x.valid) for x in regions.checked(rows).collect()) == [(1, True), (2, False), (3, False), (4, False)]


def test_simplify_keeps_corners():
    line = np.array([(x / 10, 0.0) for x in range(11)] + [(1.0, 1.0)])
    assert geometry.simplify_points(line, 0.01).tolist() == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]


def test_coverages_keep_rows_without_a_ring(spark):
    box = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    rows = spark.createDataFrame([(1, 1, box), (2, 1, None), (3, 1, [])], f"k int, grp int, ring {geometry.RING}")
    assert sorted((r.k, r.ring and len(r.ring)) for r in geometry.coverage_simplified(rows, "k", "grp", "ring", 0.1).collect()) == [(1, 4), (2, None), (3, [])]


def test_quartiles_of_one_large_group_are_spread(spark):
    """Quantiles between two values, with ties, nulls and a group of one value; a null group is a group too."""
    r = random.Random(8)
    rows = [("hot", float(r.randint(0, 300))) for _ in range(3000)] + [("one", 4.0)] + [("two", 1.0), ("two", 2.0), (None, 5.0), (None, 7.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: (x.q1, x.q2, x.q3) for x in upkeep.quartiles(frame, "g", "v").collect()}
    want = {g: tuple(np.quantile([v for k, v in rows if k == g], (0.25, 0.5, 0.75))) for g in ("hot", "one", "two", None)}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert {x.g: x.n for x in upkeep.five_numbers(frame, "g", "v").collect()} == {"hot": 3000, "one": 1, "two": 2, None: 2, "none": 0}


def test_unmet_keys_with_nulls_in_parts_of_bounded_size(spark):
    rows = [(1, "a", 0), (1, "a", 1), (2, "a", 0), (2, "a", None), (3, None, 1), (None, "a", 1), (None, "a", 0), (4, "b", -1)]
    tasks = spark.createDataFrame(rows, "req_id long, po_name string, status int")
    keys = ["req_id", "po_name"]
    tasks.createOrReplaceTempView("unmet_tasks")
    told = spark.sql("SELECT DISTINCT req_id, po_name FROM unmet_tasks t WHERE NOT EXISTS (SELECT 1 FROM unmet_tasks k WHERE k.req_id = t.req_id AND k.po_name = t.po_name AND k.status = 1)")
    got = control.unmet(tasks, keys, F.col("status") == 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, told.collect()))
    many = control.unmet(spark.range(2000).withColumn("status", F.lit(0)), ["id"], F.col("status") == 1, 100)
    assert many.count() == 2000
    assert many.rdd.getNumPartitions() == 20
