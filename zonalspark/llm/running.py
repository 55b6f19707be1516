"""Running sums within groups over all rows of a table, through range partitions, so that no group is sorted in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from zonalspark.llm.common import stored

#: Rows of a table of offsets (one a group and range that it reaches into) up to which it is broadcast.
BROADCAST = 1_000_000


def ranges(rows: DataFrame, group: str, order: list[str], amount: str) -> DataFrame:
    """rows with range_no, and before: the sum of amount over the rows of the same group that come earlier in the same range.

    Rows are range-partitioned by group and order, sorted within and written, so a group of any size is spread over as many
    ranges as it needs. group holds no nulls; amount is a whole number; rows equal in group and order change places freely."""
    held = rows.schema.names
    at_group, at_amount = held.index(group), held.index(amount)
    schema = StructType([*rows.schema.fields, StructField("range_no", LongType()), StructField("before", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups, amounts = batch.column(at_group), batch.column(at_amount).to_numpy().astype(np.int64)
            first = np.ones(n, bool)
            first[1:] = pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)
            first[0] = groups[0].as_py() != last
            before = np.cumsum(amounts) - amounts
            starts, base = np.flatnonzero(first), np.zeros(n, np.int64)
            base[starts] = np.diff(before[starts], prepend=0)
            before = before - np.cumsum(base) + np.where(np.cumsum(first) == 0, carried, 0)
            last, carried = groups[n - 1].as_py(), int(before[-1] + amounts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, number, np.int64)), pa.array(before)], schema=pa.schema([*batch.schema, pa.field("range_no", pa.int64()), pa.field("before", pa.int64())]))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).mapInArrow(run, schema), "ranges")


def offsets(ranged: DataFrame, group: str, amount: str) -> DataFrame:
    """group, range_no, offset: the sum of amount over the group's earlier ranges, and total: over all of the group."""
    held = ranged.groupBy(group, "range_no").agg(F.sum(amount).alias("held"))
    of = Window.partitionBy(group)
    return held.select(group, "range_no", (F.sum("held").over(of.orderBy("range_no")) - F.col("held")).alias("offset"), F.sum("held").over(of).alias("total"))


def placed(ranged: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """ranged rows with before counted over the whole group, and the other columns of found, which holds offsets. The join is
    by group and range, so a large group is spread in it too."""
    few = found.limit(BROADCAST + 1).count() <= BROADCAST
    both = ranged.join(F.broadcast(found) if few else found, [group, "range_no"])
    return both.withColumn("before", F.col("before") + F.col("offset")).drop("range_no", "offset")


def running(rows: DataFrame, group: str, order: list[str], amount: str) -> DataFrame:
    """rows with before (the sum of amount over the earlier rows of the group) and total (over all of it)."""
    ranged = ranges(rows, group, order, amount)
    return placed(ranged, stored(offsets(ranged, group, amount), "offsets"), group)
