"""Contents of map tiles: features clipped to each tile they touch, quantised, and encoded as vector tiles.

Clipping and quantising are expressions. A tile is one message, so its features meet in one task, which writes them one
after the other; nothing but the message is held.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import parts as partitions

EXTENT = 4096
#: Latitudes beyond this are not on the map.
MOST_LATITUDE = 85.0511287798066
#: Features that a task decodes at a time.
TOGETHER = 10_000
POINT, LINE, POLYGON = 1, 2, 3


def world(p: Column, zoom: int) -> Column:
    """A point in degrees -> its place on the map in tiles."""
    lat = F.radians(F.least(F.greatest(p["y"], F.lit(-MOST_LATITUDE)), F.lit(MOST_LATITUDE)))
    n = float(2**zoom)
    return F.struct(((p["x"] + 180.0) / 360.0 * n).alias("x"), ((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n).alias("y"))


def _once(rows: DataFrame, name: str, made: Column) -> DataFrame:
    """rows with a column that is evaluated once a row: a filter on a projected column goes below it and evaluates it again."""
    return rows.withColumn("_made", F.explode(F.array(made))).withColumn(name, F.col("_made")).drop("_made")


def fan_out(features: DataFrame, parts: str, zoom: int) -> DataFrame:
    """features once for each tile (tx, ty) that the box around their parts (arrays of points in degrees) touches; parts in tiles."""
    placed = _once(features.where(F.exists(parts, lambda r: F.size(r) > 0)), parts, F.transform(parts, lambda r: F.transform(r, lambda p: world(p, zoom))))
    ends = lambda c: (F.transform(F.flatten(parts), lambda p: p[c]))
    edge = 2**zoom - 1
    tile = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(edge)).cast("int")
    span = lambda c: F.sequence(tile(F.array_min(ends(c))), tile(F.array_max(ends(c))))
    return placed.withColumns({"_xs": span("x"), "_ys": span("y")}).withColumn("tx", F.explode("_xs")).withColumn("ty", F.explode("_ys")).drop("_xs", "_ys")


def _mix(a: Column, b: Column, t: Column) -> Column:
    return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))


def clip_line(line: Column, west: Column, north: Column) -> Column:
    """The pieces of a line inside the tile that begins at west, north: an array of lines. Points alone are no pieces."""

    def span(b, i):
        a = F.get(line, i)
        return F.struct(a.alias("a"), b.alias("b"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def inside(s):
        a, dx, dy = s["a"], s["dx"], s["dy"]
        lo, hi, miss = F.lit(0.0), F.lit(1.0), F.lit(False)
        for d, gap in ((-dx, a["x"] - west), (dx, west + 1 - a["x"]), (-dy, a["y"] - north), (dy, north + 1 - a["y"])):
            lo, hi = F.greatest(lo, F.when(d < 0, gap / d)), F.least(hi, F.when(d > 0, gap / d))
            miss = miss | ((d == 0) & (gap < 0))
        return F.struct(a.alias("a"), s["b"].alias("b"), lo.alias("lo"), hi.alias("hi"), miss.alias("miss"))

    def piece(s):
        a, b = s["a"], s["b"]
        return F.struct(F.when(s["lo"] > 0, _mix(a, b, s["lo"])).otherwise(a).alias("a"), F.when(s["hi"] < 1, _mix(a, b, s["hi"])).otherwise(b).alias("b"), (s["lo"] > 0).alias("cut"))

    # one step after the other, so that each number is made once
    spans = F.transform(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), span)
    cut = F.transform(F.filter(F.transform(spans, inside), lambda s: ~s["miss"] & (s["lo"] < s["hi"])), piece)
    point = "struct<x: double, y: double>"

    def add(done, s):
        last = F.element_at(done, -1)
        follows = (F.size(done) > 0) & ~s["cut"] & (F.element_at(last, -1) == s["a"])
        return F.when(follows, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(s["b"]))))).otherwise(F.concat(done, F.array(F.array(s["a"], s["b"]))))

    return F.aggregate(cut, F.array().cast(f"array<array<{point}>>"), add)


def _clip_side(ring: Column, axis: str, at: Column, sign: int) -> Column:
    """What of a ring (not closed) is on one side of a line: sign * (axis - at) >= 0."""
    depth = lambda p: sign * (p[axis] - at)
    none = F.array().cast("array<struct<x: double, y: double>>")

    def step(b, i):
        a = F.get(ring, F.when(i > 0, i - 1).otherwise(F.size(ring) - 1))
        crossing = F.array(_mix(a, b, depth(a) / (depth(a) - depth(b))))
        come = F.when((depth(a) >= 0) != (depth(b) >= 0), crossing).otherwise(none)
        return F.concat(come, F.when(depth(b) >= 0, F.array(b)).otherwise(none))

    return F.flatten(F.transform(ring, step))


def clip_polygons(rows: DataFrame, parts: str) -> DataFrame:
    """rows (tx, ty, parts: rings, closed or not, in tiles) with the parts inside of the tile, not closed; rings of fewer than three points go."""
    same = lambda r: F.get(r, 0) == F.element_at(r, -1)
    out = rows.withColumn(parts, F.transform(F.filter(parts, lambda r: F.size(r) > 2), lambda r: F.when(same(r), F.slice(r, 1, F.size(r) - 1)).otherwise(r)))
    for axis, tile in (("x", "tx"), ("y", "ty")):
        for sign in (1, -1):
            at = F.col(tile).cast("double") + (0.0 if sign > 0 else 1.0)
            out = out.withColumn(parts, F.transform(parts, lambda r: _clip_side(r, axis, at, sign)))  # noqa: B023
    return _once(out, parts, F.filter(parts, lambda r: F.size(r) > 2)).where(F.size(parts) > 0)


def clip_lines(rows: DataFrame, parts: str) -> DataFrame:
    pieces = F.flatten(F.transform(parts, lambda line: clip_line(line, F.col("tx").cast("double"), F.col("ty").cast("double"))))
    return _once(rows, parts, pieces).where(F.size(parts) > 0)


def clip_points(rows: DataFrame, parts: str) -> DataFrame:
    inside = lambda p: (F.floor(p["x"]) == F.col("tx")) & (F.floor(p["y"]) == F.col("ty"))
    return _once(rows, parts, F.transform(parts, lambda r: F.filter(r, inside))).where(F.exists(parts, lambda r: F.size(r) > 0))


def quantise(rows: DataFrame, parts: str, least: int, ring: bool = False, extent: int = EXTENT) -> DataFrame:
    """parts in whole units of the tile; repeated points, parts of fewer than `least` points and rows without parts go."""
    q = lambda v, t: F.floor((v - F.col(t)) * extent + 0.5).cast("int")
    whole = F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(q(p["x"], "tx").alias("x"), q(p["y"], "ty").alias("y"))))
    out = _once(rows, parts, whole) if least > 1 else rows.withColumn(parts, whole)
    fresh = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    if ring:  # the last point isn't the first again
        fresh = lambda r: F.filter(r, lambda p, i: p != F.get(r, F.when(i > 0, i - 1).otherwise(F.size(r) - 1)))
    return _once(out, parts, F.filter(F.transform(parts, fresh) if least > 1 else F.col(parts), lambda r: F.size(r) >= least)).where(F.size(parts) > 0)


def tile_rows(features: DataFrame, parts: str, zoom: int, kind: int) -> DataFrame:
    """A row for each feature and tile that it has something in: tx, ty, parts in units of the tile, other columns."""
    if kind == POINT:
        return quantise(clip_points(fan_out(features, parts, zoom), parts), parts, 1)
    # a small file is few tasks, and clipping is much work for its bytes
    fanned = fan_out(features.repartition(partitions(features)), parts, zoom)
    if kind == LINE:
        return quantise(clip_lines(fanned, parts), parts, 2)
    return quantise(clip_polygons(fanned, parts), parts, 3, ring=True)


# vector tiles: fixed values are those of the public format, version 2


_SHORT = [bytes([n]) for n in range(128)]


def varint(n: int) -> bytes:
    if n < 128:
        return _SHORT[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def number_field(number: int, n: int) -> bytes:
    return varint(number << 3) + varint(n)


def geometry(parts: list, kind: int) -> bytes:
    """Commands and zigzag differences of points."""
    out, x, y = bytearray(), 0, 0

    def move(points):
        nonlocal x, y
        for px, py in points:
            for d in (px - x, py - y):
                out.extend(varint(d << 1 ^ d >> 63))
            x, y = px, py

    if kind == POINT:
        points = [p for part in parts for p in part]
        out += varint(len(points) << 3 | 1)
        move(points)
        return bytes(out)
    for part in parts:
        out += varint(1 << 3 | 1)
        move(part[:1])
        out += varint(len(part) - 1 << 3 | 2)
        move(part[1:])
        if kind == POLYGON:
            out += varint(1 << 3 | 7)
    return bytes(out)


def value(v) -> bytes:
    if isinstance(v, bool):
        return number_field(7, int(v))
    if isinstance(v, int):
        return number_field(6, (v << 1) ^ (v >> 63))
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return field(1, str(v).encode())


class Layer:
    """One layer of one tile, written feature by feature."""

    def __init__(self, name: str, columns: list[str], kind: int, extent: int):
        self.name, self.columns, self.kind, self.extent = name, columns, kind, extent
        self.features, self.keys, self.values = bytearray(), {}, {}

    def add(self, row: tuple, parts: list, key: int | None) -> None:
        tags = bytearray()
        for c, v in zip(self.columns, row):
            if v is not None:
                packed = value(v)
                tags += varint(self.keys.setdefault(c, len(self.keys))) + varint(self.values.setdefault(packed, len(self.values)))
        body = (number_field(1, key) if key is not None and key >= 0 else b"") + field(2, bytes(tags)) + number_field(3, self.kind) + field(4, geometry(parts, self.kind))
        self.features += field(2, body)

    def message(self) -> bytes:
        keys = b"".join(field(3, k.encode()) for k in self.keys)
        values = b"".join(field(4, v) for v in self.values)
        return field(3, number_field(15, 2) + field(1, self.name.encode()) + bytes(self.features) + keys + values + number_field(5, self.extent))


def encode_tiles(rows: DataFrame, parts: str, name: str, kind: int, key: str | None = None, extent: int = EXTENT) -> DataFrame:
    """rows of tile_rows -> tx, ty, features, tile: a vector tile with one layer of each tile. Other columns are properties; key gives ids."""
    columns = [c for c in rows.columns if c not in ("tx", "ty", parts, key)]

    def run(batches):
        at, layer, n = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([layer.message()], pa.binary())], ["tx", "ty", "features", "tile"])
        for batch in batches:
            rest = [batch.column(c).to_pylist() for c in columns]
            keys = batch.column(key).to_pylist() if key else [None] * len(batch)
            for tile, own, k, shape in zip(zip(batch.column("tx").to_pylist(), batch.column("ty").to_pylist()), zip(*rest) if rest else [()] * len(batch), keys, _shapes(batch.column(parts))):
                if tile != at:
                    if layer is not None:
                        yield done()
                    at, layer, n = tile, Layer(name, columns, kind, extent), 0
                layer.add(own, shape, k)
                n += 1
        if layer is not None:
            yield done()

    order = ["tx", "ty"] + ([key] if key else [])
    return rows.repartition(partitions(rows), "tx", "ty").sortWithinPartitions(*order).mapInArrow(run, "tx int, ty int, features long, tile binary")


def _shapes(column: pa.ListArray) -> Iterator[list]:
    """The parts of each feature, as lists of (x, y)."""
    lines = column.values
    points = list(zip(*(lines.values.field(c).to_pylist() for c in ("x", "y"))))
    cuts, ends = lines.offsets.to_pylist(), column.offsets.to_pylist()
    for i, j in zip(ends, ends[1:]):
        yield [points[cuts[k] : cuts[k + 1]] for k in range(i, j)]


def _fields(data: bytes):
    at, end = 0, len(data)

    def number(at):
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, at
            shift += 7

    while at < end:
        tag, at = number(at)
        if tag & 7 == 0:
            n, at = number(at)
            yield tag >> 3, n
        elif tag & 7 == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            n, at = number(at)
            yield tag >> 3, data[at : at + n]
            at += n


def _numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def _value(data: bytes):
    number, v = next(_fields(data))
    zigzag = lambda n: n >> 1 ^ -(n & 1)
    return {1: lambda: v.decode(), 3: lambda: struct.unpack("<d", v)[0], 6: lambda: zigzag(v), 7: lambda: bool(v)}[number]()


def _shape(commands: list[int]) -> list:
    parts, x, y, i = [], 0, 0, 0
    while i < len(commands):
        what, count = commands[i] & 7, commands[i] >> 3
        i += 1
        for _ in range(count if what != 7 else 0):
            x += commands[i] >> 1 ^ -(commands[i] & 1)
            y += commands[i + 1] >> 1 ^ -(commands[i + 1] & 1)
            i += 2
            if what == 1:
                parts.append([(x, y)])
            else:
                parts[-1].append((x, y))
    return parts


def features_of(data: bytes) -> Iterator[dict]:
    """The features of a tile, one by one: layer, id, kind, properties, parts."""
    for number, layer in _fields(data):
        if number != 3:
            continue
        found, keys, values, name = [], [], [], ""
        for n, v in _fields(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                found.append(v)
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                values.append(_value(v))
        for v in found:
            f = dict(_fields(v))
            tags = _numbers(f.get(2, b""))
            yield {"layer": name, "id": f.get(1), "kind": f[3], "properties": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}, "parts": _shape(_numbers(f[4]))}


def decode_tile(data: bytes) -> list[dict]:
    """The features of a tile: layer, id, kind, properties, parts."""
    return list(features_of(data))


def _runs(lists: list) -> list[int]:
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    return ends


def read_tiles(tiles: DataFrame, schema: str) -> DataFrame:
    """tx, ty, tile -> tx, ty, id, layer, properties by schema (columns of the properties), parts of every feature in them."""
    properties = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for tx, ty, tile in zip(*(batch.column(c) for c in ("tx", "ty", "tile"))):
                features = features_of(tile.as_py())
                while found := list(islice(features, TOGETHER)):
                    lines = [p for f in found for p in f["parts"]]
                    xs, ys = ([p[k] for line in lines for p in line] for k in (0, 1))
                    points = pa.StructArray.from_arrays([pa.array(xs, pa.int32()), pa.array(ys, pa.int32())], ["x", "y"])
                    shapes = pa.ListArray.from_arrays(_runs([f["parts"] for f in found]), pa.ListArray.from_arrays(_runs(lines), points))
                    own = [pa.array([f["properties"].get(c.name) for f in found], c.type) for c in properties]
                    head = [pa.array([v.as_py()] * len(found), pa.int32()) for v in (tx, ty)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array([f["id"] for f in found], pa.int64()), pa.array([f["layer"] for f in found], pa.string()), *own, shapes], ["tx", "ty", "id", "layer", *properties.names, "parts"])

    return tiles.select("tx", "ty", "tile").mapInArrow(run, f"tx int, ty int, id long, layer string, {schema}, parts array<array<struct<x: int, y: int>>>")
