"""Sources and sinks of catalogue tables: file names, discovery, uploads, and the ways rows are written over others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.operators.control import first_rows

#: Geometry kinds that an upload may hold, features whose coordinates are looked at, and most features and bytes.
KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
SAMPLE, MOST, BYTES = 200, 100_000, 50 << 20


def masked(name: Column, mask: Column, letter: str) -> Column:
    """Digits of the name where the mask has the letter."""
    n = F.least(F.char_length(name), F.char_length(mask))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    digit = lambda i: F.when((F.substr(mask, i, F.lit(1)) == letter) & F.rlike(F.substr(name, i, F.lit(1)), F.lit("[0-9]")), F.substr(name, i, F.lit(1)))
    return F.array_join(F.transform(places, digit), "")


def dated(rows: DataFrame, name: str = "fname", mask: str = "mask") -> DataFrame:
    """rows with label, temporal (first day), kind and problem of file names under masks of Y, M and D: a year of four
    digits, alone, with a month, with month and day of month, or with a day of the year. What is malformed has a problem
    and nothing else."""
    held = rows.withColumns({f"_{c}": masked(F.col(name), F.col(mask), c) for c in "YMD"})
    y, m, d = (F.col(f"_{c}") for c in "YMD")
    of_year = (m == "") & (d != "")
    problem = F.when(y == "", "no year").when(F.char_length(y) != 4, "year").when((m != "") & (F.char_length(m) != 2), "month").when((m != "") & (d != "") & (F.char_length(d) != 2), "day of month").when(of_year & (F.char_length(d) != 3), "day of year")
    held = held.withColumn("problem", problem)
    label = F.when(F.col("problem").isNull(), F.concat(y, m, d))
    start = F.when(of_year, F.date_add(F.try_to_date(F.concat(y, F.lit("0101")), "yyyyMMdd"), d.try_cast("int") - 1)).otherwise(F.try_to_date(F.concat(y, F.when(m == "", "01").otherwise(m), F.when(d == "", "01").otherwise(d)), "yyyyMMdd"))
    n = F.char_length(label)
    kind = F.when(n == 4, "year").when(n == 6, "year month").when(n == 7, "day of year").when(n == 8, "year month day")
    return held.select(*rows.columns, label.alias("label"), F.when(label.isNotNull(), start).alias("temporal"), kind.alias("kind"), "problem")


def discovered(spark: SparkSession, folder: str, extension: str, mask: str | None = None) -> DataFrame:
    """path, fname and length of the files below a folder; several without a mask, and none at all, are errors. Only the
    listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", True).load(folder)
    found = files.select("path", F.element_at(F.split("path", "/"), -1).alias("fname"), "length")
    n = found.limit(2).count()
    if not n or (n > 1 and mask in (None, "None", "null")):
        raise ValueError("no files" if not n else "several files, but no mask")
    return found


def written(current: DataFrame, changes: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """changes with action: what writing them over current does. insert refuses keys that are there, update those that
    aren't, update_or_insert none."""
    known = current.select(*keys).distinct().withColumn("_known", F.lit(True))
    there = F.col("_known").isNotNull()
    action = {"insert": F.when(there, "refused").otherwise("inserted"), "update": F.when(there, "updated").otherwise("refused"), "update_or_insert": F.when(there, "updated").otherwise("inserted")}[mode]
    return changes.join(known, keys, "left").withColumn("action", action).drop("_known")


def replaced(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current without all rows of keys that changes has, and changes."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def collection_written(current: DataFrame, changes: DataFrame, collection: str, feature: str, mode: str) -> DataFrame:
    """Features of collections after an ingest: skip_existing leaves collections that are there, replace_features puts
    new features in place of all old ones, update_features writes over those of the same id."""
    if mode == "skip_existing":
        return current.unionByName(changes.join(current.select(collection).distinct(), collection, "left_anti"))
    if mode == "replace_features":
        return replaced(current, changes, [collection])
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_rows(both, [collection, feature], [F.desc("_new")]).drop("_new")


def cascaded(collections: DataFrame, members: DataFrame, features: DataFrame, gone: Column, fc: str = "fc_id", geom: str = "geom_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after collections go: their memberships go too, and features that no collection holds any more."""
    left = collections.where(~gone)
    held = members.join(left.select(fc), fc, "left_semi")
    return left, held, features.join(held.select(geom).distinct(), geom, "left_semi")


def uploaded(features: DataFrame) -> DataFrame:
    """features(properties map, geometry_type) that may be taken, with name: properties.name, NAME, or none."""
    name = lambda k: F.nullif(F.try_element_at("properties", F.lit(k)), F.lit(""))
    return features.where(F.col("geometry_type").isin(*KINDS)).withColumn("name", F.coalesce(name("name"), name("NAME")))


def taken(features: DataFrame) -> DataFrame:
    """features(kind, coordinates: text of GeoJSON coordinates, ...) with shape, and problem where there is none: no geometry,
    kind, or coordinates that aren't those of the kind. All parts and holes stay."""
    from zonalspark.operators.shapes import parsed

    held = features.withColumn("shape", parsed(F.col("kind"), F.col("coordinates")))
    problem = F.when(F.col("kind").isNull(), "no geometry").when(~F.col("kind").isin(*KINDS), "kind").when(F.col("shape").isNull(), "coordinates")
    return held.withColumn("problem", problem)


def skipped(features: DataFrame, *by: str) -> DataFrame:
    """by, problem, n: how many of taken() features of each upload are left out, for each reason."""
    return features.where("problem is not null").groupBy(*by, "problem").agg(F.count(F.lit(1)).alias("n"))


def upload_problem(kind: Column, shape: Column, place: Column) -> Column:
    """What is wrong with a feature of an upload: no geometry, another kind, or a coordinate out of range in any of its rings
    (of the first SAMPLE features, by place from 0); null if nothing."""
    bad = F.exists(F.flatten(F.flatten(shape)), lambda p: ~(p["x"].between(-180, 180) & p["y"].between(-90, 90)))
    return F.when(kind.isNull(), "no geometry").when(~kind.isin(*KINDS), "kind").when((place < SAMPLE) & bad, "coordinates")


def uploads_fit(features: DataFrame, upload: str, size: str, most: int = MOST, bytes_: int = BYTES) -> DataFrame:
    """upload, n, size, fits of many uploads at once: whether the features and bytes (summed) of each are within the limits."""
    counted = features.groupBy(upload).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    return counted.withColumn("fits", (F.col("n") <= most) & (F.col("size") <= bytes_))


def upload_fits(features: DataFrame, size: int, most: int = MOST) -> bool:
    """Whether an upload of so many bytes is within both limits; counts no further than the limit."""
    return size <= BYTES and features.limit(most + 1).count() <= most


def selections(events: DataFrame, dataset: str, arguments: str, order: str) -> DataFrame:
    """A selection after upserts one by one: with arguments an entry for each dataset and arguments, where the last one
    stays in the place of the first; without, one for each dataset. place counts from 1 by first appearance of a key."""
    entries = events.groupBy(dataset, arguments).agg(F.min(order).alias("first"), F.max_by(F.struct("*"), order).alias("last"))
    return entries.select(dataset, arguments, "first", f"last.{order}")


def prioritised(tasks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """tasks(keys, priority) after a request: what is there takes the request's priority, what isn't is added."""
    asked = wanted.groupBy(*keys).agg(F.max("priority").alias("_asked"))
    return tasks.join(asked, keys, "full").select(*keys, F.coalesce("_asked", "priority").alias("priority"))


def with_arguments(rows: DataFrame, base: dict[str, Column], *maps: str) -> DataFrame:
    """rows with arguments: base, then each map column over what came before it (null ones say nothing)."""
    start = F.create_map(*(x for k, v in base.items() for x in (F.lit(k), v)))
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    maps_of = [F.coalesce(F.col(m), F.create_map().cast("map<string,string>")) for m in maps]
    return rows.withColumn("arguments", reduce(later, maps_of, start))
