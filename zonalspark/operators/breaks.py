"""Natural breaks (least squares within classes) of all distinct values, as an exact dynamic programme over ranges.

Distinct values are range-partitioned; a range is one row of packed prefix sums. The cheapest partition of the first j
values into k classes ends in a class that begins after some i, and the best i never falls as j grows. So for each level
the best i of every range's last value is found first, range by range of i; the values of a range then only try the ranges
of i between the best ones of the range's two ends. The driver holds a few numbers a range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalspark.sources.shared import written

#: Distinct values of a range.
SIZE = 1 << 16
DATA = "part int, data binary"


def packed(part: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.stack(columns).astype(np.float64).tobytes()], pa.binary())], names=["part", "data"])


def unpacked(data: bytes) -> np.ndarray:
    """Rows: values, prefix sums of weights, of weighted values and of their squares, and least cost, up to each value."""
    return np.frombuffer(data, np.float64).reshape(5, -1)


def least(of: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j below n the least of(i, j) over i from 0 to ends[j] - 1, and the first i that gives it, where neither ends
    nor that i falls as j grows; without any i, infinity and 0. Middles first: each halves the range of i left to both sides."""
    best, first = np.full(n, np.inf), np.zeros(n, np.int64)
    begin = int(np.searchsorted(ends, 1))
    jobs = np.array([[begin, n - 1, 0, int(ends[-1]) - 1]]) if begin < n else np.zeros((0, 4), np.int64)  # from, to of j; from, to of i
    while len(jobs):
        a, b, low, high = jobs.T
        j = (a + b) // 2
        count = np.minimum(high, ends[j] - 1) - low + 1
        start = np.cumsum(count) - count
        i = np.arange(count.sum()) - np.repeat(start - low, count)
        cost = of(i, np.repeat(j, count))
        best[j] = np.minimum.reduceat(cost, start)
        first[j] = np.minimum.reduceat(np.where(cost == np.repeat(best[j], count), i, np.iinfo(np.int64).max), start)
        jobs = np.concatenate([np.stack([a, j - 1, low, first[j]], 1), np.stack([j + 1, b, first[j], high], 1)])
        jobs = jobs[jobs[:, 0] <= jobs[:, 1]]
    return best, first


def cost(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least cost up to value i of one, and a class of all values after it up to value j of two."""
    w, s = two[1][j] - one[1][i], two[2][j] - one[2][i]
    return one[4][i] + np.maximum(0.0, two[3][j] - one[3][i] - s * s / np.maximum(w, 1e-300))


def prefixes(counted: DataFrame, ranges: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Ranges of values (v, w) in order as packed rows, with the cost of one class, and first place and number of each."""
    parts, _ = written(counted.repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id()), "breaks-values")
    held = {r.part: r for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("s")).collect()}
    order = sorted(held)
    mean = sum(held[p].s for p in order) / sum(held[p].w for p in order)
    squares = {r.part: r.q for r in parts.groupBy("part").agg(F.sum((F.col("v") - mean) * (F.col("v") - mean) * F.col("w")).alias("q")).collect()}
    before, bounds, at = {}, [], np.zeros(3)
    place = 1  # places count values from 1
    for number, p in enumerate(order):
        before[p] = (number, *at)
        bounds.append((place, held[p].m))
        place += held[p].m
        at = at + np.array([held[p].w, held[p].s - mean * held[p].w, squares[p]])

    def pack(table: pa.Table) -> pa.Table:
        number, *start = before[table.column("part")[0].as_py()]
        v, w = (table.column(c).to_numpy().astype(np.float64) for c in ("v", "w"))
        v, w = v[by := np.argsort(v)], w[by]
        x = v - mean
        s0, s1, s2 = (b + np.cumsum(y) for b, y in zip(start, (w, w * x, w * x * x), strict=True))
        return pa.Table.from_batches([packed(number, v, s0, s1, s2, np.maximum(0.0, s2 - s1 * s1 / s0))])

    rows, _ = written(parts.groupBy("part").applyInArrow(pack, DATA), "breaks-ranges")
    return rows, bounds


def next_level(rows: DataFrame, bounds: list[tuple[int, int]], k: int) -> tuple[DataFrame, DataFrame]:
    """rows with the least costs of k classes, and part, data: for each place the last place before its last class."""
    ends = rows.sparkSession.sparkContext.broadcast(np.stack([x[:, -1] for _, x in sorted((p, unpacked(d)) for p, d in ((r.part, r.data) for r in rows.mapInArrow(last_only, DATA).collect()))], 1))
    first, m = (np.array(x) for x in zip(*bounds, strict=True))

    def at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, last = unpacked(data), ends.value[:, p:]
                reach = np.full(last.shape[1], own.shape[1])
                reach[0] -= 1  # a class has a value at least
                best, i = least(lambda i, j: cost(own, last, i, j), last.shape[1], reach)  # noqa: B023
                there = np.flatnonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(p + there, pa.int32()), pa.array(best[there]), pa.array(first[p] + i[there])], names=["part", "best", "at"])

    found = rows.mapInArrow(at_ends, "part int, best double, at long").groupBy("part").agg(F.min(F.struct("best", "at")).alias("x")).select("part", "x.at")
    best_at = {r.part: r["at"] for r in found.collect()}
    pairs, low = [], 1
    for p in range(len(bounds)):
        high = best_at.get(p, low)
        pairs += [(p, q) for q in range(int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high, "right")))]
        low = high
    wanted = F.broadcast(rows.sparkSession.createDataFrame(pairs, "part int, other int"))
    both = rows.join(wanted, "part").join(rows.select(F.col("part").alias("other"), F.col("data").alias("theirs")), "other").select("part", "data", "other", "theirs")

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data, q, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, other = unpacked(data), unpacked(theirs)
                places = first[p] + np.arange(own.shape[1])
                reach = np.clip(places - first[q], 0, other.shape[1])
                best, i = least(lambda i, j: cost(other, own, i, j), own.shape[1], reach)  # noqa: B023
                best[places < k] = np.inf
                yield packed(p, best, first[q] + i)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            for p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(data, np.float64).reshape(2, -1)
                if p != part:
                    if part is not None:
                        yield packed(part, *held)
                    part, held = p, new
                else:
                    better = (new[0] < held[0]) | ((new[0] == held[0]) & (new[1] < held[1]))
                    held = np.where(better, new, held)
        if part is not None:
            yield packed(part, *held)

    ways, _ = written(both.mapInArrow(tried, DATA).repartition("part").sortWithinPartitions("part").mapInArrow(merged, DATA), "breaks-ways")

    def renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data, way in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield packed(p, *unpacked(data)[:4], np.frombuffer(way, np.float64).reshape(2, -1)[0])

    new, _ = written(rows.join(ways.withColumnRenamed("data", "way"), "part").mapInArrow(renewed, DATA), "breaks-ranges")
    return new, ways


def last_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield packed(p, *unpacked(data)[:, -1:])


def value_at(rows: DataFrame, bounds: list[tuple[int, int]], place: int, row: int, height: int) -> float:
    """One number of a packed table: of the value at a place."""
    part = int(np.searchsorted([f for f, _ in bounds], place, "right")) - 1
    offset = place - bounds[part][0]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(data, np.float64).reshape(height, -1)[row, offset])])], names=["v"])

    return rows.where(F.col("part") == part).mapInArrow(pick, "v double").first().v


def jenks(rows: DataFrame, value: str, n: int = 5, size: int = SIZE) -> DataFrame:
    """i, cut: the least value, then the greatest value of each of n classes whose squares about their means are least.

    Values count as often as they are there; nulls and NaN don't. With fewer distinct values than n each is a class; of
    equally good breaks the lowest ones; without values there are no rows. size: distinct values of a range."""
    v = F.col(value).cast("double")
    counted, _ = written(rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("w")), "breaks-counts")
    spark, distinct = rows.sparkSession, counted.count()
    if not distinct:
        return spark.createDataFrame([], "i int, cut double")
    now, bounds = prefixes(counted, -(-distinct // size))
    ways, values = [], now
    for k in range(2, min(n, distinct) + 1):
        now, way = next_level(now, bounds, k)
        ways.append(way)
    cuts, place = [distinct], distinct
    for way in reversed(ways):
        place = int(value_at(way, bounds, place, 1, 2))
        cuts.append(place)
    found = [value_at(values, bounds, 1, 0, 5), *(value_at(values, bounds, c, 0, 5) for c in reversed(cuts))]
    return spark.createDataFrame(list(enumerate(found)), "i int, cut double")
