"""Spatial joins of boxes and points, zonal statistics and filter-and-aggregate operators.

Joins go through an equi-join on grid cells and refine exactly, so neither side is crossed with the other. A box that
spans several cells is repeated once a cell; a point falls into one."""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge of a grid cell in degrees, and boxes up to which that side may be broadcast.
CELL, BROADCAST = 5.0, 100_000
BOX = ("minx", "miny", "maxx", "maxy")


def cell(v: Column, size: float = CELL) -> Column:
    return F.floor(v / F.lit(size))


def cells_of_boxes(boxes: DataFrame, size: float = CELL) -> DataFrame:
    """A row for each grid cell (cx, cy) that a box touches."""
    across = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("minx"), size), cell(F.col("maxx"), size))))
    return across.withColumn("cy", F.explode(F.sequence(cell(F.col("miny"), size), cell(F.col("maxy"), size))))


def bounded(small: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """Marked for broadcast if it has at most `limit` rows, else as it is (the join is then shuffled)."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def within(points: DataFrame, boxes: DataFrame, x: str, y: str, how: str = "inner") -> DataFrame:
    """Points strictly within boxes; points on an edge belong to none. how: inner, or left to keep boxes without points
    (columns of points are then null)."""
    dealt = points.withColumns({"cx": cell(F.col(x)), "cy": cell(F.col(y))})
    spread = bounded(cells_of_boxes(boxes))
    inside = (F.col(x) > F.col("minx")) & (F.col(x) < F.col("maxx")) & (F.col(y) > F.col("miny")) & (F.col(y) < F.col("maxy"))
    found = dealt.join(spread, ["cx", "cy"]).where(inside).drop("cx", "cy")
    if how == "inner":
        return found
    kept = [c for c in boxes.columns]
    return boxes.join(found.drop(*[c for c in kept if c != "geom_id"]), "geom_id", "left")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes with a common interior, with area (planar) of the intersection. Columns of the right side are
    prefixed r_. A pair that meets in several cells counts once, in the cell of its lower corner."""
    a = cells_of_boxes(left)
    b = bounded(cells_of_boxes(right.select([F.col(c).alias(f"r_{c}") if c in BOX else F.col(c).alias(f"r_{c}") for c in right.columns]).withColumnsRenamed({f"r_{c}": c for c in BOX})).withColumnsRenamed({c: f"r_{c}" for c in BOX}))
    pairs = a.join(b, ["cx", "cy"])
    low_x, low_y = F.greatest("minx", "r_minx"), F.greatest("miny", "r_miny")
    wide, high = F.least("maxx", "r_maxx") - low_x, F.least("maxy", "r_maxy") - low_y
    once = (F.col("cx") == cell(low_x)) & (F.col("cy") == cell(low_y))
    return pairs.where((wide > 0) & (high > 0) & once).withColumn("area", wide * high).drop("cx", "cy")


def contains(outer: DataFrame, inner: DataFrame) -> Column:
    return (outer.minx <= inner.minx) & (outer.miny <= inner.miny) & (outer.maxx >= inner.maxx) & (outer.maxy >= inner.maxy)


def covered(features: DataFrame, datasets: DataFrame) -> DataFrame:
    """geom_id, dataset_id: features whose box a dataset's box holds, rims included. A feature is looked up in the cell of its
    lower corner, which any box that holds it reaches into."""
    own = features.select("geom_id", *(F.col(c).alias(f"f_{c}") for c in BOX)).withColumns({"cx": cell(F.col("f_minx")), "cy": cell(F.col("f_miny"))})
    met = own.join(bounded(cells_of_boxes(datasets.select("dataset_id", *BOX))), ["cx", "cy"])
    return met.where("minx <= f_minx and miny <= f_miny and maxx >= f_maxx and maxy >= f_maxy").select("geom_id", "dataset_id")


def zonal_stats(features: DataFrame, pixels: DataFrame, by: list[str], nodata: Column | None = None) -> DataFrame:
    """min, max, mean, sum and count of pixels whose centre is in a feature, by feature and `by`; features without
    pixels have no row. One aggregation; partial sums form map-side before the shuffle."""
    valid = pixels.where(~nodata) if nodata is not None else pixels
    found = within(valid, features.select("geom_id", *BOX), "x", "y").groupBy("geom_id", *by)
    return found.agg(F.min("val").alias("min"), F.max("val").alias("max"), F.avg("val").alias("mean"), F.sum("val").alias("sum"), F.count("val").alias("count"))


def zonal_categories(features: DataFrame, pixels: DataFrame, names: dict[str, str], met: DataFrame | None = None) -> DataFrame:
    """Pixels of each class in each feature, named by the mapping; mapped classes without pixels have 0, values outside the
    mapping keep their own name. One row a feature and class. met: pixels, or blocks of _rows pixels, with the geom_id of
    their features, where these are no boxes."""
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("class")), F.col("class")) if names else F.col("class")
    met = within(pixels, features.select("geom_id", *BOX), "x", "y") if met is None else met
    counts = met.groupBy("geom_id", named.alias("class")).agg((F.sum("_rows") if "_rows" in met.columns else F.count(F.lit(1))).alias("n"))
    every = features.select("geom_id", F.explode(F.array(*map(F.lit, sorted(set(names.values()))))).alias("class"))
    return every.join(counts, ["geom_id", "class"], "full").select("geom_id", "class", F.coalesce("n", F.lit(0)).alias("n"))


def filter_of(filters: dict) -> Column:
    """A predicate from a filter catalogue: {'type': 'range', 'start', 'end'} (inclusive) or {'type': 'categorical',
    'selected'}; an empty selection and anything that isn't a dict is no filter; booleans compare as 0 and 1."""
    parts = []
    for field, f in filters.items():
        if not isinstance(f, dict):
            continue
        if f.get("type") == "range":
            parts.append(F.col(field).between(f["start"], f["end"]))
        elif f.get("type") == "categorical" and f.get("selected"):
            parts.append(F.col(field).isin([int(v) if isinstance(v, bool) else v for v in f["selected"]]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def safe_label(value: str) -> str:
    """Column-name part of a category: runs of anything but a-z, A-Z and 0-9 become _, trimmed, 32 characters at most."""
    return re.sub("[^a-zA-Z0-9]+", "_", str(value)).strip("_")[:32]


def disaggregations(filters: dict) -> list[tuple[str, Column]]:
    """A label and predicate for each combination of values of the categorical filters with aggregate false; the other
    filters hold in each. No combination if one of them selects nothing."""
    split = {k: f for k, f in filters.items() if isinstance(f, dict) and f.get("type") == "categorical" and f.get("aggregate") is False}
    rest = filter_of({k: f for k, f in filters.items() if k not in split})
    out = []
    for values in product(*(f["selected"] for f in split.values())):
        own = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(split, values, strict=True)], rest)
        out.append(("_".join(map(safe_label, values)), own))
    return out


def whole_sum(value: Column, when: Column) -> Column:
    """Sum of value where `when` holds, NaN and null skipped, truncated toward zero; 0 if nothing is left."""
    number = F.when(when & ~F.isnan(value), value)
    return F.coalesce(F.sum(number), F.lit(0.0)).cast("long")


def located(points: DataFrame, features: DataFrame, x: str, y: str) -> DataFrame:
    """points strictly within features, with geom_id: within their shapes, where features have a column shape, else their
    boxes."""
    if "shape" in features.columns:
        from zonalspark.operators.cells import within_shapes

        return within_shapes(points, features.select("geom_id", "shape"), x, y)
    return within(points, features.select("geom_id", *BOX), x, y)


def filter_aggregate(features: DataFrame, points: DataFrame, outcomes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row a feature (box, or shape of any form); a column for each outcome (value, predicate), in one aggregation.
    Features without points: 0. Points meet equal shapes once."""
    from zonalspark.operators.cells import forms, of_forms

    marked = {f"w_{k}": v for k, (v, _) in outcomes.items()} | {f"p_{k}": p for k, (_, p) in outcomes.items()}
    members, once = forms(features.select("geom_id", "shape"), "geom_id") if "shape" in features.columns else (None, features)
    found = located(points.withColumns(marked), once, "lon", "lat").groupBy("geom_id")
    sums = found.agg(*(whole_sum(F.col(f"w_{k}").cast("double"), F.col(f"p_{k}")).alias(k) for k in outcomes))
    every = of_forms(members, sums, "geom_id", "left") if members else features.select("geom_id").join(sums, "geom_id", "left")
    return every.fillna(0, list(outcomes))


def area_weighted(features: DataFrame, polys: DataFrame, value: str) -> DataFrame:
    """Sum of value by the share of each polygon's area inside a feature, truncated toward zero; a polygon without area
    counts 0. Shares are added up as decimals, so the sum doesn't depend on the order of rows."""
    pairs = overlaps(polys, features)
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    sums = pairs.groupBy(F.col("r_geom_id").alias("geom_id")).agg(F.sum((F.col(value) * F.coalesce(F.try_divide(F.col("area"), area), F.lit(0.0))).cast("decimal(38,12)")).cast("long").alias("weighted"))
    return features.select("geom_id").join(sums, "geom_id", "left").fillna(0, ["weighted"])
