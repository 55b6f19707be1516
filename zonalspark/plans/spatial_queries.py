"""Spatial queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.operators import spatial as S
from zonalspark.sources.fixtures import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


IN_BOX = "x > minx AND x < maxx AND y > miny AND y < maxy"
POINT_IN = "lon > minx AND lon < maxx AND lat > miny AND lat < maxy"
BASE = with_views("fx_features", "fx_pixels")


def zonal(stat: str, nodata: bool = True):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pixels = view(spark, d, "fx_pixels").withColumn("val", F.col("val").cast("decimal(18,2)"))  # sums are then exact
        out = S.zonal_stats(view(spark, d, "fx_features"), pixels, ["label"], F.col("is_nodata") if nodata else None)
        value = F.col("count") if stat == "count" else F.col("sum").cast("double") / F.col("count") if stat == "mean" else F.col(stat).cast("double")
        return out.select("geom_id", "label", value.alias(stat))

    return run


EXACT = "CAST(sum(CAST(val AS DECIMAL(18, 2))) AS DOUBLE)"
for stat, sql in {"min": "min(val)", "max": "max(val)", "mean": f"{EXACT} / count(val)", "sum": EXACT, "count": "count(val)"}.items():
    query(f"zonal_{stat}", f'{BASE} SELECT geom_id, label, {sql} AS "{stat}" FROM fx_features JOIN fx_pixels ON {IN_BOX} WHERE NOT is_nodata GROUP BY ALL')(zonal(stat))
query("zonal_nodata", f"{BASE} SELECT geom_id, label, count(val) AS count FROM fx_features JOIN fx_pixels ON {IN_BOX} GROUP BY ALL")(zonal("count", False))

EMPTY = "class = '5-LOW' AND label = 1995 AND x < -20"


@query("zonal_empty_zone", f"{BASE} SELECT geom_id, count(val) AS n, round(sum(val), 2) AS total FROM fx_features LEFT JOIN (SELECT * FROM fx_pixels WHERE {EMPTY} AND NOT is_nodata) p ON {IN_BOX} GROUP BY geom_id")
def zonal_empty_zone(spark, d):
    pixels = view(spark, d, "fx_pixels").where(EMPTY).where("not is_nodata")
    return S.within(pixels, view(spark, d, "fx_features"), "x", "y", "left").groupBy("geom_id").agg(F.count("val").alias("n"), F.round(F.sum("val"), 2).alias("total"))


#: The mapping leaves out a class that there is, and has one that there isn't.
CLASSES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low", "6-ABSENT": "absent"}


@query("zonal_categorical", f"{BASE}, c AS (SELECT unnest({list(CLASSES)}) AS raw, unnest({list(CLASSES.values())}) AS class), n AS (SELECT geom_id, coalesce(c.class, p.class) AS class, count(*) AS n FROM fx_features JOIN fx_pixels p ON {IN_BOX} LEFT JOIN c ON c.raw = p.class GROUP BY ALL) SELECT geom_id, class, coalesce(n, 0) AS n FROM (SELECT geom_id, class FROM fx_features CROSS JOIN c) FULL JOIN n USING (geom_id, class)")
def zonal_categorical(spark, d):
    return S.zonal_categories(view(spark, d, "fx_features"), view(spark, d, "fx_pixels"), CLASSES)


POINTS = with_views("fx_features", "fx_points")


def points_query(name: str, outcomes: dict[str, tuple[str, str]], build):
    """outcomes: SQL of value and predicate by column; build: the same from the operator's filters."""
    cols = ", ".join(f"CAST(trunc(coalesce(sum(CASE WHEN {p} THEN {v} END), 0)) AS BIGINT) AS {k}" for k, (v, p) in outcomes.items())
    query(name, f"{POINTS} SELECT geom_id, {cols} FROM fx_features LEFT JOIN fx_points ON {POINT_IN} GROUP BY geom_id")(lambda spark, d: S.filter_aggregate(view(spark, d, "fx_features"), view(spark, d, "fx_points"), build()))


def value():
    """The default outcome."""
    return F.col("value")


points_query("points_within_count", {"event_count": ("1", "event_id IS NOT NULL")}, lambda: {"event_count": (F.lit(1), F.lit(True))})
points_query("points_within_sum", {"total": ("value", "true")}, lambda: {"total": (value(), F.lit(True))})
RANGE = {"value": {"type": "range", "start": 10, "end": 50}}
points_query("points_filter_range", {"total": ("value", "value BETWEEN 10 AND 50")}, lambda: {"total": (value(), S.filter_of(RANGE))})
KINDS = {"event_type": {"type": "categorical", "selected": ["click", "purchase"]}, "user_id": {"type": "categorical", "selected": []}, "note": "ignored"}
points_query("points_filter_in", {"total": ("value", "event_type IN ('click', 'purchase')")}, lambda: {"total": (value(), S.filter_of(KINDS))})
ONE_KEY = {"event_type": {"type": "categorical", "selected": ["click", "purchase", "no such"], "aggregate": False}, "value": {"type": "range", "start": 1, "end": 80, "aggregate": False}}
points_query("points_disaggregate_1key", {S.safe_label(k): ("value", f"event_type = '{k}' AND value BETWEEN 1 AND 80") for k in ("click", "purchase", "no such")}, lambda: {label: (value(), p) for label, p in S.disaggregations(ONE_KEY)})
TWO_KEYS = {"event_type": {"type": "categorical", "selected": ["click", "view"], "aggregate": False}, "user_id": {"type": "categorical", "selected": [1, 2, 3], "aggregate": False}}
points_query("points_disaggregate_2key", {f"{k}_{u}": ("1", f"event_type = '{k}' AND user_id = {u}") for k in ("click", "view") for u in (1, 2, 3)}, lambda: {label: (F.lit(1), p) for label, p in S.disaggregations(TWO_KEYS)})
points_query("points_conditional_sum", {"inside": ("value", "true"), "large": ("value", "value > 90")}, lambda: {"inside": (value(), F.lit(True)), "large": (value(), F.col("value") > 90)})

POLYS = with_views("fx_features", "fx_polys")
AREA = "greatest(0, least(f.maxx, p.maxx) - greatest(f.minx, p.minx)) * greatest(0, least(f.maxy, p.maxy) - greatest(f.miny, p.miny))"


@query("polygon_overlap_pairs", f"{POLYS} SELECT poly_id, geom_id, round({AREA}, 6) AS area FROM fx_polys p JOIN fx_features f ON {AREA} > 0")
def polygon_overlap_pairs(spark, d):
    return S.overlaps(view(spark, d, "fx_polys"), view(spark, d, "fx_features")).select("poly_id", F.col("r_geom_id").alias("geom_id"), F.round("area", 6).alias("area"))


@query("polygon_area_weighted", f"{POLYS} SELECT f.geom_id, CAST(trunc(coalesce(sum(CAST(amount * (({AREA}) / nullif((p.maxx - p.minx) * (p.maxy - p.miny), 0)) AS DECIMAL(38, 12))), 0)) AS BIGINT) AS weighted FROM fx_features f LEFT JOIN fx_polys p ON {AREA} > 0 GROUP BY f.geom_id")
def polygon_area_weighted(spark, d):
    return S.area_weighted(view(spark, d, "fx_features"), view(spark, d, "fx_polys"), "amount")


@query("nested_levels_within", f"{with_views('fx_features', 'fx_strips', 'fx_points')}, every AS (SELECT 'cell' AS level, geom_id, minx, miny, maxx, maxy FROM fx_features UNION ALL SELECT 'strip', geom_id, minx, miny, maxx, maxy FROM fx_strips) SELECT level, geom_id, count(*) AS n FROM every JOIN fx_points ON {POINT_IN} GROUP BY ALL")
def nested_levels_within(spark, d):
    box = ["geom_id", *S.BOX]
    every = view(spark, d, "fx_features").select(F.lit("cell").alias("level"), *box).unionByName(view(spark, d, "fx_strips").select(F.lit("strip").alias("level"), *box))
    return S.within(view(spark, d, "fx_points"), every, "lon", "lat").groupBy("level", "geom_id").agg(F.count(F.lit(1)).alias("n"))


COVER = with_views("fx_features", "fx_datasets")
HOLDS = "d.minx <= f.minx AND d.miny <= f.miny AND d.maxx >= f.maxx AND d.maxy >= f.maxy"


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """geom_id, dataset_id, status of every pair of feature and dataset: 1 if the dataset's extent holds the feature."""
    features, datasets = view(spark, d, "fx_features"), S.bounded(view(spark, d, "fx_datasets"))
    return features.crossJoin(datasets.withColumnsRenamed({c: f"d_{c}" for c in S.BOX})).select("geom_id", "dataset_id", F.expr("if(d_minx <= minx and d_miny <= miny and d_maxx >= maxx and d_maxy >= maxy, 1, 0)").alias("status"))


@query("coverage_contains", f"{COVER} SELECT geom_id, dataset_id, CASE WHEN {HOLDS} THEN 1 ELSE 0 END AS status FROM fx_features f CROSS JOIN fx_datasets d")
def coverage_contains(spark, d):
    return coverage(spark, d)


@query("coverage_missing_pairs", f"{COVER} SELECT geom_id, dataset_id FROM fx_features f CROSS JOIN fx_datasets d WHERE NOT ({HOLDS})")
def coverage_missing_pairs(spark, d):
    known = S.covered(view(spark, d, "fx_features"), view(spark, d, "fx_datasets"))
    return view(spark, d, "fx_features").select("geom_id").crossJoin(S.bounded(view(spark, d, "fx_datasets").select("dataset_id"))).join(known, ["geom_id", "dataset_id"], "left_anti")


@query("coverage_covered_datasets", f"{COVER} SELECT dataset_id, count(*) AS n_features FROM fx_features f JOIN fx_datasets d ON {HOLDS} GROUP BY dataset_id")
def coverage_covered_datasets(spark, d):
    covered = S.covered(view(spark, d, "fx_features"), view(spark, d, "fx_datasets")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_features"))
    return view(spark, d, "fx_datasets").select("dataset_id").join(covered, "dataset_id")


@query("coverage_dependency", f"{COVER} SELECT a.dataset_id, c.geom_id FROM fx_datasets a JOIN (SELECT geom_id, dataset_id FROM fx_features f JOIN fx_datasets d ON {HOLDS}) c ON c.dataset_id = coalesce(CASE WHEN a.dataset_id % 2 = 1 THEN a.dataset_id - 1 END, a.dataset_id)")
def coverage_dependency(spark, d):
    """Datasets with odd ids take their coverage from the one before."""
    of = view(spark, d, "fx_datasets").select("dataset_id", F.coalesce(F.when(F.col("dataset_id") % 2 == 1, F.col("dataset_id") - 1), "dataset_id").alias("source"))
    covered = S.covered(view(spark, d, "fx_features"), view(spark, d, "fx_datasets")).withColumnRenamed("dataset_id", "source")
    return covered.join(S.bounded(of), "source").select("dataset_id", "geom_id")


@query("tile_bbox_filter", f"{with_views('fx_features')} SELECT geom_id FROM fx_features WHERE minx <= 0 AND maxx >= -45 AND miny <= 10 AND maxy >= -66.51326044311186")
def tile_bbox_filter(spark, d):
    return view(spark, d, "fx_features").where((F.col("minx") <= 0) & (F.col("maxx") >= -45) & (F.col("miny") <= 10) & (F.col("maxy") >= -66.51326044311186)).select("geom_id")


@query("resource_extent", f"{with_views('fx_pixels')} SELECT label, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM fx_pixels GROUP BY label")
def resource_extent(spark, d):
    return view(spark, d, "fx_pixels").groupBy("label").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


MERCATOR = 20037508.342789244


@query("mercator", f"{with_views('fx_features')} SELECT geom_id, round(minx * {MERCATOR} / 180, 3) AS x, round(ln(tan((90 + miny) * pi() / 360)) / (pi() / 180) * {MERCATOR} / 180, 3) AS y FROM fx_features")
def mercator(spark, d):
    from zonalspark.functions.scalar import mercator_x, mercator_y

    return view(spark, d, "fx_features").select("geom_id", F.round(mercator_x(F.col("minx")), 3).alias("x"), F.round(mercator_y(F.col("miny")), 3).alias("y"))


@query("tile_envelope", f"SELECT z, x, -{MERCATOR} + x * 2 * {MERCATOR} / (1 << z) AS minx, -{MERCATOR} + (x + 1) * 2 * {MERCATOR} / (1 << z) AS maxx, {MERCATOR} - (x + 1) * 2 * {MERCATOR} / (1 << z) AS miny, {MERCATOR} - x * 2 * {MERCATOR} / (1 << z) AS maxy FROM (SELECT CAST(r_regionkey AS INTEGER) AS z, CAST(r_regionkey // 2 AS INTEGER) AS x FROM region)")
def tile_envelope(spark, d):
    from zonalspark.functions.scalar import tile_box

    tiles = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("int").alias("z"), F.expr("cast(r_regionkey div 2 as int)").alias("x"))
    return tiles.select("z", "x", *tile_box(F.col("z"), F.col("x"), F.col("x")))
