"""The named statistics: an explicit registry from a name to a function of features and a layer.

Each takes features (geom_id and box, or a shape of any form), the layer's rows and arguments, and gives geom_id, name and
value rows. Rasters under shapes need the raster's grid among the arguments, polygons under shapes a shape of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalspark.operators import cells, spatial
from zonalspark.sources.shared import written

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def processor(name: str):
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return put


def shaped(rows: DataFrame) -> bool:
    return "shape" in rows.columns


def raster_statistic(stat: str):
    def run(features: DataFrame, layer: DataFrame, name: str, nodata=None, grid=None, **_) -> DataFrame:
        """None where a feature has no pixels; their count is 0."""
        found = cells.zonal_shapes(features, layer, grid, None, nodata) if shaped(features) else spatial.zonal_stats(features, layer, [], nodata)
        value = F.coalesce(F.col(stat), F.lit(0)) if stat == "count" else F.col(stat)
        return features.select("geom_id").join(found, "geom_id", "left").select("geom_id", F.lit(name).alias("name"), value.cast("double").alias("value"))

    return run


for stat in ("min", "max", "mean", "sum", "count"):
    processor(f"raster_{stat}")(raster_statistic(stat))


@processor("raster_categorical")
def raster_categorical(features: DataFrame, layer: DataFrame, name: str, category_map: dict[str, str], grid=None, **_) -> DataFrame:
    if shaped(features):
        members, once = cells.forms(features.select("geom_id", "shape"), "geom_id")
        blocks, _ = written(cells.pixel_blocks(layer.withColumn("val", F.lit(1)), ["class"], *grid), "pixel-blocks")
        found = cells.of_forms(members, spatial.zonal_categories(once, layer, category_map, cells.pixels_within(blocks, once, *grid)), "geom_id")
    else:
        found = spatial.zonal_categories(features, layer, category_map)
    return found.select("geom_id", F.concat(F.lit(f"{name}_"), "class").alias("name"), F.col("n").cast("double").alias("value"))


def outcome_of(outcome: str):
    return F.lit(1) if outcome == "event_count" else F.col(outcome)


@processor("events_filtered")
def events_filtered(features: DataFrame, layer: DataFrame, name: str, outcome: str = "event_count", **filters) -> DataFrame:
    """One sum, or one for each combination of values of filters with aggregate false."""
    split = [k for k, f in filters.items() if isinstance(f, dict) and f.get("aggregate") is False and f.get("type") == "categorical"]
    parts = spatial.disaggregations(filters) if split else [("", spatial.filter_of(filters))]
    if not parts:
        return features.select("geom_id", F.lit(name).alias("name"), F.lit(0.0).alias("value")).limit(0)
    wide = spatial.filter_aggregate(features, layer, {f"v{i}": (outcome_of(outcome), own) for i, (_, own) in enumerate(parts)})
    pairs = F.array(*(F.struct(F.lit(f"{name}_{label}" if label else name).alias("name"), F.col(f"v{i}").cast("double").alias("value")) for i, (label, _) in enumerate(parts)))
    return wide.select("geom_id", F.explode(pairs).alias("p")).select("geom_id", "p.*")


@processor("events_within")
def events_within(features: DataFrame, layer: DataFrame, name: str, field: str = "value", **filters) -> DataFrame:
    wide = spatial.filter_aggregate(features, layer, {"value": (F.col(field), spatial.filter_of(filters))})
    return wide.select("geom_id", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))


@processor("polygons_weighted")
def polygons_weighted(features: DataFrame, layer: DataFrame, name: str, outcome: str = "amount", **filters) -> DataFrame:
    weigh = cells.area_weighted_shapes if shaped(features) else spatial.area_weighted
    found = weigh(features, layer.where(spatial.filter_of(filters)), outcome)
    return found.select("geom_id", F.lit(name).alias("name"), F.col("weighted").cast("double").alias("value"))


@processor("boxes_overlapping")
def boxes_overlapping(features: DataFrame, layer: DataFrame, name: str, **_) -> DataFrame:
    if shaped(features):
        counts = cells.overlap_counts(layer, features, "poly_id", "geom_id")
    else:
        counts = spatial.overlaps(layer, features).groupBy(F.col("r_geom_id").alias("geom_id")).agg(F.count(F.lit(1)).alias("value"))
    return features.select("geom_id").join(counts, "geom_id", "left").select("geom_id", F.lit(name).alias("name"), F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def run(function: str, features: DataFrame, layer: DataFrame, **arguments) -> DataFrame:
    """All features of a statistic at once; a name that the registry lacks is an error."""
    if function not in REGISTRY:
        raise ValueError(f"no statistic {function!r}")
    return REGISTRY[function](features, layer, **arguments)


def arguments(name: str, option: dict | None, task: dict | None, mapping: dict | None = None) -> dict:
    """What a statistic is called with: the option's arguments over its name, the task's over those; then the mapping,
    and with arguments of a task the name ends in their digest."""
    import hashlib
    import json

    found = {"name": name} | (option or {}) | (task or {})
    if task:
        found["name"] = f"{name}_{hashlib.md5(json.dumps(task, sort_keys=True).encode()).hexdigest()[:8]}"
    if mapping is not None:
        found["category_map"] = mapping
    return found
