"""Units of distance, and validity of rings by a sweep.

A ring is an array of points struct(x, y), the first not repeated at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Kilometres a unit, and kilometres of a degree on a sphere of 6,371.0088 km.
UNITS = {"kilometers": 1.0, "miles": 1.609344, "meters": 0.001}
DEGREE = 6371.0088 * math.pi / 180


def turn(a: tuple, b: tuple, c: tuple) -> int:
    """1 if c lies to the left of the way from a to b, -1 to the right, 0 on it."""
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def on(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether c, on the line of a and b, lies between them."""
    return min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


class Sweep:
    """Whether two sides of a ring meet where they shouldn't: an upright line moves over the ring, the sides that it is on
    are kept in order, and only neighbours in that order are compared."""

    def __init__(self, points: list[tuple[float, float]]):
        n = self.n = len(points)
        self.sides = [tuple(sorted((points[i], points[(i + 1) % n]))) for i in range(n)]
        self.order: list[int] = []

    def meets(self, i: int, j: int) -> bool:
        (a, b), (c, d) = self.sides[i], self.sides[j]
        ways = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        if ways[0] * ways[1] < 0 and ways[2] * ways[3] < 0:
            return True
        touched = {p for w, s, p in zip(ways, ((a, b), (a, b), (c, d), (c, d)), (c, d, a, b), strict=True) if w == 0 and on(*s, p)}
        if not touched:
            return False
        # neighbours share one end and nothing else
        return not ((i - j) % self.n in (1, self.n - 1) and len(touched) == 1 and touched <= {a, b} & {c, d})

    def place(self, i: int) -> int:
        """Where side i comes in the order, by its lesser end, then by its other one."""
        p, q = self.sides[i]
        low, high = 0, len(self.order)
        while low < high:
            mid = (low + high) // 2
            a, b = self.sides[self.order[mid]]
            way = turn(a, b, p) or turn(a, b, q)
            if a[0] == b[0] and not way:
                way = (p[1] > b[1]) - (p[1] < a[1])
            if way > 0:
                low = mid + 1
            else:
                high = mid
        return low

    def simple(self) -> bool:
        events = sorted([(p, 0, i) for i, (p, _) in enumerate(self.sides)] + [(q, 1, i) for i, (_, q) in enumerate(self.sides)])
        if any(p == q for p, q in self.sides):
            return False
        order = self.order
        for _, ends, i in events:
            if not ends:
                at = self.place(i)
                if any(0 <= k < len(order) and self.meets(order[k], i) for k in (at - 1, at)):
                    return False
                order.insert(at, i)
            else:
                at = order.index(i)
                del order[at]
                if 0 < at < len(order) and self.meets(order[at - 1], order[at]):
                    return False
        return True


def simple_ring(points: np.ndarray) -> bool:
    """Three finite points or more, and no two sides that cross or lie on each other; sides that follow each other may only
    share their end."""
    return len(points) > 2 and bool(np.isfinite(points).all()) and len(np.unique(points, axis=0)) == len(points) and Sweep(list(map(tuple, points.tolist()))).simple()


def checked(rows: DataFrame, ring: str = "ring", name: str = "valid") -> DataFrame:
    """rows with name: whether the ring is simple, by a sweep that takes about n log n steps; false for null and empty rings."""
    schema, at = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} boolean").fields]), rows.columns.index(ring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = [bool(r) and simple_ring(np.array([(p["x"], p["y"]) for p in r], float)) for r in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(valid, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
