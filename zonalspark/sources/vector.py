"""Vector sources and result tables: GeoJSON features and CSV, by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.operators.ingest import taken

GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"struct<type:string,properties:map<string,string>,geometry:{GEOMETRY}>"
SCHEMA = f"type string, features array<{FEATURE}>, properties map<string,string>, geometry {GEOMETRY}"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """feature (its place), properties, kind, shape and problem of all features of the collections at path; a bare feature is
    a collection of one. Features that can't be taken have no shape, and a problem says why; none is dropped.

    A document is read in one task (uploads have 50 MB at most); with lines each line is a document, and files are split."""
    whole = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    bare = F.array(F.struct("type", "properties", "geometry"))
    features = F.when(F.col("type") == "Feature", bare).otherwise(F.col("features"))
    each = whole.select(F.posexplode(features).alias("feature", "f"))
    return taken(each.select("feature", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))).drop("coordinates")


def write_geojson(rows: DataFrame, path: str, properties: list[str], shape: str = "shape") -> None:
    """One feature a line (GeoJSON text sequence), each a multi-polygon of all parts and holes; tasks write side by side."""
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    coordinates = F.transform(shape, lambda part: F.transform(part, ring))
    geometry = F.when(F.col(shape).isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    rows.select(F.to_json(feature, {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A wide result table with a head line in every file; tasks write side by side."""
    rows.write.mode("overwrite").option("header", True).csv(path)
