"""Upkeep of tasks, coverage and resources: encodings, flags, limits and derived fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalspark.operators.spatial import bounded
from zonalspark.sources.shared import written


def encoded(rows: DataFrame, kind: Column, value: Column, text: Column) -> DataFrame:
    """A value as a tagged union: data_column says which of int_value, float_value and str_value holds it. What is
    neither a whole number nor a float is held as text, a missing value as the text None."""
    tag = F.when(value.isNull(), "str").otherwise(kind)
    return rows.withColumns({
        "data_column": tag,
        "int_value": F.when(tag == "int", value.cast("long")),
        "float_value": F.when(tag == "float", value.cast("double")),
        "str_value": F.when(tag == "str", F.coalesce(text, F.lit("None"))),
    })


def flagged(rows: DataFrame, flag: str, where: Column, value) -> DataFrame:
    """rows with flag set to value where a condition holds."""
    return rows.withColumn(flag, F.when(where, F.lit(value)).otherwise(F.col(flag)))


def beyond_limit(calls: DataFrame, client: str, at: str, limit: int, unit: str = "hour") -> DataFrame:
    """client, period, n and refused: calls beyond limit in a period. Counted before the shuffle, so a busy client is
    a row a task."""
    counted = calls.groupBy(client, F.date_trunc(unit, F.col(at)).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)).cast("long"))


def rechecked(coverage: DataFrame, features: DataFrame, datasets: DataFrame) -> DataFrame:
    """geom_id, dataset_id, status: only unchecked rows (-1) are tested against the dataset's extent, 1 if it holds the
    whole feature, else 0; the others stay. Both small sides join by their id."""
    box = ("minx", "miny", "maxx", "maxy")
    sets = bounded(datasets.select("dataset_id", *(F.col(c).alias(f"d_{c}") for c in box)))
    rows = coverage.join(bounded(features.select("geom_id", *box)), "geom_id").join(sets, "dataset_id")
    holds = F.expr("d_minx <= minx and d_miny <= miny and d_maxx >= maxx and d_maxy >= maxy")
    return rows.select("geom_id", "dataset_id", F.when(F.col("status") == -1, holds.cast("int")).otherwise(F.col("status")).alias("status"))


def periods(rows: DataFrame, at: str, units: dict[str, str]) -> DataFrame:
    """unit, period, n: rows counted by several units at once, one pass; rows without a time aren't counted."""
    keys = [F.struct(F.lit(unit).alias("unit"), F.date_format(at, form).alias("period")) for unit, form in units.items()]
    each = rows.where(F.col(at).isNotNull()).select(F.explode(F.array(*keys)).alias("k"))
    return each.groupBy("k.unit", "k.period").agg(F.count(F.lit(1)).alias("n"))


def derived(resources: DataFrame, by: str, label: Column, x: str, y: str) -> DataFrame:
    """First and last label, kind and extent of each dataset."""
    found = resources.groupBy(by).agg(F.min(label).alias("first"), F.max(label).alias("last"), F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))
    return found.withColumn("temporal", F.when(F.col("last").isNull(), "Temporally Invariant").otherwise("Datetime"))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, or the empty text."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def extremes(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n largest and the n smallest rows, side says which: two top-k, no whole sort."""
    sides = {"top": F.desc(value), "bottom": F.asc(value)}
    return reduce(DataFrame.unionByName, [rows.orderBy(o, order).limit(n).withColumn("side", F.lit(side)) for side, o in sides.items()])


def quartiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """by, q1, q2, ...: exact quantiles of each group, between two values in proportion. Values are counted, the distinct ones
    are put in order range by range, and a rank is looked up where the counts of the values before say that it is: no task
    holds a group. Ranges are written, since they are read twice and must be the same both times."""
    v = F.col(value)
    counted = rows.where(v.isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_k"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, _ = written(counted.repartitionByRange(n, by, value).withColumn("_part", F.spark_partition_id()), "quartiles")
    of = Window.partitionBy("_by")
    held = parts.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_at")).agg(F.sum("_k").alias("_held"))
    before = held.select("_by", "_at", (F.sum("_held").over(of.orderBy("_at")) - F.col("_held")).alias("_before"), F.sum("_held").over(of).alias("_all"))
    both = parts.join(bounded(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    within = Window.partitionBy("_part", by).orderBy(value)
    ends = both.withColumn("_end", F.col("_before") + F.sum("_k").over(within))
    first = F.col("_end") - F.col("_k")
    place = lambda q: (F.col("_all") - 1) * F.lit(q)
    at = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_end")), v))
    found = ends.groupBy(by).agg(F.first("_all").alias("_all"), *(at(f(place(q))).alias(f"_{name}{k}") for k, q in enumerate(shares) for f, name in ((F.floor, "low"), (F.ceil, "high"))))

    def between(k: int, q: float) -> Column:
        low, high, rest = F.col(f"_low{k}"), F.col(f"_high{k}"), place(q) - F.floor(place(q))
        return F.when(low == high, low.cast("double")).otherwise((1 - rest) * low + rest * high)

    return found.select(by, *(between(k, q).alias(f"q{k + 1}") for k, q in enumerate(shares)))


def five_numbers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each group."""
    v = F.col(value)
    moments = rows.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    return moments.join(quartiles(rows, by, value).withColumnRenamed(by, "_of"), F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")
