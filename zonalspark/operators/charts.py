"""Statistics behind charts: histograms, breaks, box plots, rankings, series, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalspark.operators.spatial import bounded
from zonalspark.operators.upkeep import quartiles
from zonalspark.sources.shared import written


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, lo, n of equal-width bins from min to max, the last closed, empty ones with 0; one bin if min is max. Nulls
    aren't counted. Two passes: bounds, then counts that are partial map-side."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    spark = rows.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, n long")
    n = 1 if lo == hi else bins
    width = (hi - lo) / n
    place = F.lit(0) if n == 1 else F.least(F.floor((F.col(value) - lo) / width), F.lit(n - 1)).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(n).select(F.col("id").cast("int").alias("bin"), (F.lit(float(lo)) + F.col("id") * width).alias("lo"))
    return every.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])


def ranked(rows: DataFrame, value: str) -> DataFrame:
    """rows with rank from 0 in the order of value and their number n. Ranks come from counts of each distinct value, so
    only distinct values are put in one order, range by range. Ranges are written, since they are read twice and must be
    the same both times."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    parts, _ = written(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("part").agg(F.sum("c").alias("held"))
    offsets = before.withColumn("offset", F.sum("held").over(Window.orderBy("part")) - F.col("held")).select("part", "offset")
    within = Window.partitionBy("part").orderBy(value)
    return parts.join(F.broadcast(offsets), "part").select(value, "c", (F.col("offset") + F.sum("c").over(within) - F.col("c")).alias("rank"))


def quantile_breaks(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    """i, cut for i from 0 to n: the value of rank round(i / n * (N - 1)), half up."""
    held = ranked(rows, value)
    total = held.agg(F.sum("c")).first()[0] or 0
    wanted = rows.sparkSession.createDataFrame([(i, int(i / n * (total - 1) + 0.5)) for i in range(n + 1)] if total else [], "i int, at long")
    return held.join(F.broadcast(wanted), (F.col("at") >= F.col("rank")) & (F.col("at") < F.col("rank") + F.col("c"))).select("i", F.col(value).alias("cut"))


def equal_breaks(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return bounds.select(F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"), "lo", "hi").select("i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / n).alias("cut"))


def class_of(value: Column, breaks: list[float]) -> Column:
    """The class of a value: the first break that it doesn't pass, less one (0 for the least), the last if it passes
    all; null for null and NaN."""
    out = F.lit(len(breaks) - 2)
    for i in range(len(breaks) - 1, -1, -1):
        out = F.when(value <= breaks[i], F.lit(max(0, i - 1))).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value), out)


def box_plot(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, q1, median, q3, low, high (last values within 1.5 times the quartiles' distance), n_outliers."""
    quarters = bounded(quartiles(rows, by, value).withColumnRenamed("q2", "median"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(quarters, by).groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("n_outliers"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over pairs without null; 0 with fewer than two pairs or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    flat = (F.count(x) < 2) | (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) == 0)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(flat, 0.0).otherwise(r)


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all pairs of columns, from one aggregation."""
    pairs = [(c, c) for c in columns] + list(combinations(columns, 2))
    wide = rows.agg(*(correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    every = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(every).alias("x")).select("x.*")
