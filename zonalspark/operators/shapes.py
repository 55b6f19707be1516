"""Geometries of several parts with holes: well-known binary and GeoJSON in and out, areas, bounds, places within, clipping.

A shape is an array of parts; a part is an array of rings, the outer one first, or of one path for lines and points; a
ring is an array of points struct(x, y), the first not repeated at the end. Inside tasks rings are arrays of two columns."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonalspark.operators.geometry import RING

SHAPE = f"array<array<{RING}>>"
GEOMETRY = f"struct<kind:string,srid:int,parts:{SHAPE}>"
#: Names of the kinds of geometry by their codes in well-known binary.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
CODES = {name: code for code, name in KINDS.items()}
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
Shape = list[list[np.ndarray]]


def shapes_in(column: pa.Array) -> list[Shape | None]:
    """Shapes of an Arrow column."""
    offsets, at = [], column
    for _ in range(3):
        offsets.append(at.offsets.to_numpy())
        at = at.values
    xy = np.stack([at.field(0).to_numpy(zero_copy_only=False), at.field(1).to_numpy(zero_copy_only=False)], 1) if len(at) else np.zeros((0, 2))
    parts, rings, points = offsets
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [None if null[i] else [[xy[points[k] : points[k + 1]] for k in range(rings[j], rings[j + 1])] for j in range(parts[i], parts[i + 1])] for i in range(len(column))]


def shapes_out(shapes: list[Shape | None]) -> pa.Array:
    """Shapes as an Arrow column."""
    rings = [r for s in shapes for part in s or () for r in part]
    xy = np.concatenate(rings).astype(np.float64) if rings else np.zeros((0, 2))
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], fields=list(POINT))
    of_ring = pa.ListArray.from_arrays(ends([len(r) for r in rings]), points)
    of_part = pa.ListArray.from_arrays(ends([len(part) for s in shapes for part in s or ()]), of_ring)
    return pa.ListArray.from_arrays(ends([len(s or ()) for s in shapes]), of_part, mask=pa.array([s is None for s in shapes], pa.bool_()))


def per_shape(rows: DataFrame, shape: str, name: str, f: Callable[[Shape], object], kind: str = SHAPE) -> DataFrame:
    """rows with name: f of each shape, in Arrow batches; null stays null. f gives a shape unless another kind is named."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema, at = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields]), rows.columns.index(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if s is None else f(s) for s in shapes_in(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, shapes_out(found) if kind == SHAPE else pa.array(found, to_arrow_type(schema[-1].dataType))], names=schema.names)

    return rows.mapInArrow(run, schema)


def opened(ring: np.ndarray) -> np.ndarray:
    """The ring without its closing point."""
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


class Reader:
    """Reads one geometry of well-known binary: either byte order in each part, flags or thousands for further dimensions,
    a reference system where there is one."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, order: str) -> int:
        self.at += 4
        return struct.unpack_from(f"{order}I", self.data, self.at - 4)[0]

    def points(self, order: str, n: int, wide: int) -> np.ndarray:
        out = np.frombuffer(self.data, f"{order}f8", n * wide, self.at).reshape(n, wide)[:, :2].astype(np.float64)
        self.at += 8 * n * wide
        return out

    def geometry(self) -> tuple[str, int | None, Shape] | None:
        order = {0: ">", 1: "<"}.get(self.data[self.at])
        if order is None:
            return None
        self.at += 1
        code = self.number(order)
        srid = self.number(order) if code & 0x20000000 else None
        base = code & 0x0FFFFFFF
        kind = KINDS.get(base % 1000)
        more = bool(code & 0x80000000) + bool(code & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}.get(base // 1000, 9)
        if kind is None or more > 2:
            return None
        if kind == "Point":
            points = self.points(order, 1, 2 + more)
            return kind, srid, [] if np.isnan(points).any() else [[points]]
        n = self.number(order)
        if kind == "LineString":
            return kind, srid, [[self.points(order, n, 2 + more)]] if n else []
        if kind == "Polygon":
            rings = [opened(self.points(order, self.number(order), 2 + more)) for _ in range(n)]
            return kind, srid, [rings] if rings else []
        parts: Shape = []
        for _ in range(n):
            own = self.geometry()
            if own is None:
                return None
            parts += own[2]
        return kind, srid, parts


def read_wkb(data: bytes) -> tuple[str, int | None, Shape] | None:
    """kind, reference system and shape; null for kinds without a name here, and for binary that ends too early."""
    try:
        return Reader(data).geometry()
    except (struct.error, ValueError, IndexError):
        return None


def wkb(shape: Shape, kind: str = "MultiPolygon", srid: int | None = None) -> bytes:
    """A shape in well-known binary, little-endian; rings are closed."""

    def head(code: int, srid: int | None = None) -> bytes:
        return struct.pack("<BI", 1, code | (0x20000000 if srid is not None else 0)) + (struct.pack("<I", srid) if srid is not None else b"")

    def path(points: np.ndarray, close: bool) -> bytes:
        points = np.concatenate([points, points[:1]]) if close else points
        return struct.pack("<I", len(points)) + np.ascontiguousarray(points, "<f8").tobytes()

    def body(part: list[np.ndarray], base: str) -> bytes:
        if base == "Point":
            return np.ascontiguousarray(part[0][0], "<f8").tobytes()
        if base == "LineString":
            return path(part[0], False)
        return struct.pack("<I", len(part)) + b"".join(path(r, True) for r in part)

    if kind.startswith("Multi"):
        base = kind.removeprefix("Multi")
        return head(CODES[kind], srid) + struct.pack("<I", len(shape)) + b"".join(head(CODES[base]) + body(part, base) for part in shape)
    if not shape:
        return head(CODES[kind], srid) + (struct.pack("<dd", float("nan"), float("nan")) if kind == "Point" else struct.pack("<I", 0))
    return head(CODES[kind], srid) + body(shape[0], kind)


def decoded(rows: DataFrame, binary: str = "wkb", name: str = "geometry") -> DataFrame:
    """rows with name (GEOMETRY): kind, srid and parts of well-known binary. All parts and holes stay; third and fourth
    dimensions go. Null for null, for empty or broken binary and for kinds that have no name in KINDS."""
    schema, at = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {GEOMETRY}").fields]), rows.columns.index(binary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x and read_wkb(x) for x in batch.column(at).to_pylist()]
            found = [x or None for x in found]
            parts = [pa.array([x and x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32()))]
            whole = pa.StructArray.from_arrays([*parts, shapes_out([x and x[2] for x in found])], names=["kind", "srid", "parts"], mask=pa.array([x is None for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], names=schema.names)

    return rows.mapInArrow(run, schema)


def encoded(rows: DataFrame, shape: str = "shape", kind: str = "MultiPolygon", srid: int | None = None, name: str = "wkb") -> DataFrame:
    """rows with name: the shape in well-known binary."""
    return per_shape(rows, shape, name, lambda s: wkb(s, kind, srid), "binary")


def parsed(kind: Column, coordinates: Column) -> Column:
    """A shape from GeoJSON: kind and the text of coordinates; null for other kinds and for coordinates that are none."""
    at = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    read = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    path = lambda points: F.transform(points, at)
    ring = lambda points: path(F.when(F.get(points, 0) == F.element_at(points, -1), F.slice(points, 1, F.size(points) - 1)).otherwise(points))
    part = lambda rings: F.transform(rings, ring)
    whole = {
        "Point": F.array(F.array(F.array(at(read(1))))),
        "MultiPoint": F.transform(read(2), lambda p: F.array(F.array(at(p)))),
        "LineString": F.array(F.array(path(read(2)))),
        "MultiLineString": F.transform(read(3), lambda line: F.array(path(line))),
        "Polygon": F.array(part(read(3))),
        "MultiPolygon": F.transform(read(4), part),
    }
    found = F.coalesce(*(F.when(kind == k, v.cast(SHAPE)) for k, v in whole.items()))
    broken = F.exists(F.flatten(F.flatten(found)), lambda p: p["x"].isNull() | p["y"].isNull())
    return F.when(F.coalesce(broken, F.lit(True)), None).otherwise(found)


def rings(shape: Column) -> Column:
    """All rings of a shape."""
    return F.flatten(shape)


def crossed(ring: Column) -> Column:
    """Twice the signed area, positive against the clock."""
    n = F.size(ring)
    step = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(step, F.lit(0.0), lambda a, b: a + b)


def shape_area(shape: Column) -> Column:
    """Planar area: outer rings less their holes, whichever way they turn."""
    of_part = lambda part: F.aggregate(F.transform(part, lambda r, i: F.abs(crossed(r)) * F.when(i == 0, 0.5).otherwise(-0.5)), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(F.transform(shape, of_part), F.lit(0.0), lambda a, b: a + b)


def shape_bounds(shape: Column) -> list[Column]:
    """minx, miny, maxx, maxy; null without points."""
    points = F.flatten(F.flatten(shape))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy")]


def strictly_within(x: Column, y: Column, shape: Column) -> Column:
    """Whether a point is in the inside of a shape: an odd number of sides are passed on the way out, holes count, and a point
    on a side or corner is outside. False for null or empty shapes."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)

        def of_side(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            turn = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
            near = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
            across = (p["y"] > y) != (q["y"] > y)
            right = F.when(q["y"] > p["y"], turn > 0).otherwise(turn < 0)
            return F.when((turn == 0) & near, 2).when(across & right, 1).otherwise(0)

        return F.transform(ring, of_side)

    sides = F.flatten(F.transform(rings(shape), of_ring))
    odd = F.aggregate(sides, F.lit(0), lambda a, s: a + s) % 2 == 1
    return F.coalesce(~F.array_contains(sides, 2) & odd, F.lit(False))


def signed_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(x @ np.roll(y, -1) - np.roll(x, -1) @ y) / 2


def half(ring: np.ndarray, axis: int, at: float, below: bool, snap: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The part of a ring on one hand of an upright or level line; parts that the line divides stay joined along it. Where
    a side meets the line is worked out from its lesser end, so that both hands, and another ring with the same side, get
    the same point. snap rounds new points."""
    v = ring[:, axis]
    inside = v <= at if below else v >= at
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    after, then = np.roll(ring, -1, 0), np.roll(inside, -1)
    cross = inside != then
    p, q = ring[cross], after[cross]
    turned = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
    p, q = np.where(turned[:, None], q, p), np.where(turned[:, None], p, q)
    met = p + (q - p) * ((at - p[:, axis]) / (q[:, axis] - p[:, axis]))[:, None]
    met = snap(met) if snap else met
    met[:, axis] = at
    out = np.empty((int(inside.sum() + cross.sum()), 2))
    place = np.cumsum(inside.astype(np.int64) + cross) - cross - inside
    out[place[inside]] = ring[inside]
    out[(place + inside)[cross]] = met
    keep = (out != np.roll(out, 1, 0)).any(1)
    return out[keep] if keep.any() else out[:1]


def boxed(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a ring within a box."""
    for axis, at, below in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        if not len(ring):
            break
        ring = half(ring, axis, at, below)
    return ring


def within_triangle(ring: np.ndarray, corners: np.ndarray) -> float:
    """Signed area of a ring inside a triangle (corners against the clock), cut at one side after the other."""
    for k in range(3):
        a, b = corners[k], corners[(k + 1) % 3]
        if len(ring) < 3:
            return 0.0
        d = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
        inside = d >= 0
        if inside.all():
            continue
        if not inside.any():
            return 0.0
        after, e = np.roll(ring, -1, 0), np.roll(d, -1)
        cross = inside != np.roll(inside, -1)
        met = ring[cross] + (after[cross] - ring[cross]) * (d[cross] / (d[cross] - e[cross]))[:, None]
        out = np.empty((int(inside.sum() + cross.sum()), 2))
        place = np.cumsum(inside.astype(np.int64) + cross) - cross - inside
        out[place[inside]] = ring[inside]
        out[(place + inside)[cross]] = met
        ring = out
    return signed_area(ring)


def turned(shape: Shape) -> list[np.ndarray]:
    """All rings of a shape, outer ones against the clock and holes with it."""
    return [r if (signed_area(r) > 0) == (k == 0) else r[::-1] for part in shape for k, r in enumerate(part) if len(r) > 2]


def common_area(a: Shape, b: Shape) -> float:
    """Planar area that two shapes share. Rings may be notched and have holes: the second is taken as triangles from a
    corner of each ring, added or taken away as they turn, and the first is cut to each."""
    first, second = turned(a), turned(b)
    if not first or not second:
        return 0.0
    bounds = lambda own: (min(r[:, 0].min() for r in own), min(r[:, 1].min() for r in own), max(r[:, 0].max() for r in own), max(r[:, 1].max() for r in own))
    first = [r for r in (boxed(r, bounds(second)) for r in first) if len(r) > 2]
    if not first:
        return 0.0
    second = [r for r in (boxed(r, bounds(first)) for r in second) if len(r) > 2]
    total = 0.0
    for r in second:
        for k in range(1, len(r) - 1):
            corners = r[[0, k, k + 1]]
            sign = signed_area(corners)
            if sign:
                low, high = corners.min(0), corners.max(0)
                corners = corners if sign > 0 else corners[::-1]
                for own in first:
                    if (own.min(0) < high).all() and (own.max(0) > low).all():
                        total += within_triangle(own, corners) * (1 if sign > 0 else -1)
    return max(0.0, total)


#: Pairs of sides up to which areas are worked out together, of one pair of shapes and at once.
SIDE_PAIRS, AT_ONCE = 4096, 1 << 19


def flat_sides(shape: Shape) -> np.ndarray:
    """x0, y0, x1, y1 and sign of a shape's sides that aren't upright, from left to right: a shape is all below its upper sides
    (sign 1) less all below its lower ones."""
    own = turned(shape)
    if not own:
        return np.zeros((0, 5))
    p, q = np.concatenate(own), np.concatenate([np.concatenate([r[1:], r[:1]]) for r in own])
    back = q[:, 0] < p[:, 0]
    sides = np.concatenate([np.where(back[:, None], q, p), np.where(back[:, None], p, q), np.where(back, 1.0, -1.0)[:, None]], 1)
    return sides[p[:, 0] != q[:, 0]]


def common_areas(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Planar areas that pairs of shapes share, from their flat_sides: for each two sides that meet in x, what is below both."""
    n, m = np.array([len(a) for a in first]), np.array([len(b) for b in second])
    floor = np.array([min(a[:, [1, 3]].min(), b[:, [1, 3]].min()) for a, b in zip(first, second, strict=True)])
    pairs = n * m
    pair = np.repeat(np.arange(len(n)), pairs)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    e = np.concatenate(first)[np.repeat(np.cumsum(n) - n, pairs) + k // m[pair]]
    f = np.concatenate(second)[np.repeat(np.cumsum(m) - m, pairs) + k % m[pair]]
    low, high = np.maximum(e[:, 0], f[:, 0]), np.minimum(e[:, 2], f[:, 2])
    met = low < high
    e, f, low, high, pair = e[met], f[met], low[met], high[met], pair[met]
    at = lambda s, x: s[:, 1] + (x - s[:, 0]) * ((s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])) - floor[pair]
    e0, e1, f0, f1 = at(e, low), at(e, high), at(f, low), at(f, high)
    d0, d1 = e0 - f0, e1 - f1
    below = (np.minimum(e0, f0) + np.minimum(e1, f1)) / 2
    over = d0 * d1 < 0  # where they cross the lesser one changes
    t = np.where(over, d0 / np.where(over, d0 - d1, 1), 0)
    middle = e0 + t * (e1 - e0)
    below = np.where(over, (t * (np.minimum(e0, f0) + middle) + (1 - t) * (middle + np.minimum(e1, f1))) / 2, below)
    return np.bincount(pair, e[:, 4] * f[:, 4] * (high - low) * below, len(n))


def areas_of(first: list[Shape | None], second: list[Shape | None]) -> list[float | None]:
    """common_area of pairs of shapes, many at once. Pairs of very many sides, and those of next to no common area, are cut to
    each other one by one, so that what only touches has none."""
    out: list[float | None] = [None] * len(first)
    chunk: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        found = common_areas([a for _, a, _ in chunk], [b for _, _, b in chunk])
        for (i, a, b), area in zip(chunk, found.tolist(), strict=True):
            size = max(a[:, [0, 2]].max(), b[:, [0, 2]].max()) - min(a[:, [0, 2]].min(), b[:, [0, 2]].min())
            tall = max(a[:, [1, 3]].max(), b[:, [1, 3]].max()) - min(a[:, [1, 3]].min(), b[:, [1, 3]].min())
            out[i] = area if area > 1e-9 * size * tall else common_area(first[i], second[i])

    for i, (a, b) in enumerate(zip(first, second, strict=True)):
        if a is None or b is None:
            continue
        x, y = flat_sides(a), flat_sides(b)
        if not len(x) or not len(y):
            out[i] = 0.0
        elif len(x) * len(y) > SIDE_PAIRS:
            out[i] = common_area(a, b)
        else:
            chunk.append((i, x, y))
            held += len(x) * len(y)
            if held > AT_ONCE:
                settle()
                chunk.clear()
                held = 0
    if chunk:
        settle()
    return out


def shared_areas(pairs: DataFrame, left: str, right: str, name: str = "area") -> DataFrame:
    """pairs with name: the planar area that both shapes of a row share, pair by pair in Arrow batches; null with a null."""
    schema = StructType([*pairs.schema.fields, *StructType.fromDDL(f"{name} double").fields])
    at, other = pairs.columns.index(left), pairs.columns.index(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = areas_of(shapes_in(batch.column(at)), shapes_in(batch.column(other)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(areas, pa.float64())], names=schema.names)

    return pairs.mapInArrow(run, schema)
