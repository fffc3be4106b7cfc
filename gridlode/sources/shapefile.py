"""Shapes and attributes of zipped shapefiles: one row per record, read from binary files by the executors."""

from __future__ import annotations

import io
import struct
import zipfile
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, layer string, record long, kind string, parts array<array<struct<x:double,y:double>>>, attributes map<string,string>"
KINDS = {1: "Point", 3: "LineString", 5: "Polygon"}


#: A task hands on so many records at a time.
BATCH = 2_000


def shape_of(body: bytes):
    """(kind, parts) of the body of a record; shapes with heights and measures are read without them."""
    code = struct.unpack("<i", body[:4])[0]
    kind = KINDS.get(code % 10)
    if kind == "Point":
        return kind, [[struct.unpack("<2d", body[4:20])]]
    if not kind:
        return None, []
    parts, points = struct.unpack("<2i", body[36:44])
    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
    xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    pts = list(zip(xy[::2], xy[1::2]))
    return kind, [pts[a:b] for a, b in zip(starts, starts[1:])]


def shapes(stream: BinaryIO):
    """The shape of each record of a .shp file, one after the other."""
    stream.read(100)
    while len(head := stream.read(8)) == 8:
        yield shape_of(stream.read(struct.unpack(">i", head[4:])[0] * 2))


def fields_of(stream: BinaryIO) -> tuple:
    """(number of rows, where they begin, bytes of a row, names and widths) of a .dbf file; leaves it after its fields."""
    n, begin, size = struct.unpack("<IHH", stream.read(32)[4:12])
    fields, read = [], 32
    while (first := stream.read(1)) not in (b"\r", b""):
        data = first + stream.read(31)
        read += 32
        fields.append((data[:11].split(b"\0")[0].decode("ascii", "replace"), data[16]))
    stream.read(max(0, begin - read - 1))
    return n, begin, size, fields


def values_of(row: bytes, fields: list, encoding: str = "utf-8") -> dict:
    pos, out = 1, {}
    for name, width in fields:
        out[name] = row[pos : pos + width].decode(encoding, "replace").strip("\0 ")
        pos += width
    return out


def attributes_of(stream: BinaryIO, head: tuple, record: int) -> dict:
    """The attributes of one record of a .dbf file that can be sought in; none beyond its end."""
    n, begin, size, fields = head
    if record >= n:
        return {}
    stream.seek(begin + record * size)
    return values_of(stream.read(size), fields)


def attributes(stream: BinaryIO):
    """A dict of each record of a .dbf file, one after the other."""
    n, _, size, fields = fields_of(stream)
    for _ in range(n):
        yield values_of(stream.read(size), fields)


def _records(batches):
    """Records of archives, unpacked as they are read, in bounded batches."""
    names_ = ["file", "layer", "record", "kind", "parts", "attributes"]
    for pdf in batches:
        out = []
        for file, content in zip(pdf["path"], pdf["content"]):
            if not zipfile.is_zipfile(io.BytesIO(content)):
                continue  # an error page under the name of an archive
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = {n.lower(): n for n in z.namelist()}
                for low, name in names.items():
                    if not low.endswith(".shp"):
                        continue
                    table = names.get(low[:-4] + ".dbf")
                    with z.open(name) as found, z.open(table) if table else io.BytesIO() as rows:
                        values = attributes(rows) if table else iter(())
                        for i, (kind, parts) in enumerate(shapes(found)):
                            pts = [[{"x": x, "y": y} for x, y in p] for p in parts]
                            out.append((file, name, i, kind, pts, next(values, {})))
                            if len(out) == BATCH:
                                yield pd.DataFrame(out, columns=names_)
                                out = []
        yield pd.DataFrame(out, columns=names_)


def read_shapefiles(spark: SparkSession, path: str, every: int = 1, most: int | None = None) -> DataFrame:
    """All layers of the archives at path, every n-th record of each, at most `most`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(_records, SCHEMA).where(F.col("record") % every == 0)
    return out if most is None else out.limit(most)


def _box(points) -> tuple:
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def archive(keys: list[str], rings: list[list[tuple]], layer: str = "cells") -> bytes:
    """A zipped shapefile of polygons of one ring each, with their keys as the attribute KEY."""
    bodies = [struct.pack("<i4d2ii", 5, *_box(ring), 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring) for ring in rings]
    size = 50 + sum(4 + len(b) // 2 for b in bodies)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, 5, *_box([p for r in rings for p in r]), 0, 0, 0, 0)
    shp = head + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    width = max(len(k.encode()) for k in keys)
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(keys), 65, width + 1) + struct.pack("<11sc4xBB14x", b"KEY", b"C", width, 0) + b"\r"
    dbf += b"".join(b" " + k.encode().ljust(width) for k in keys) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{layer}.shp", shp)
        z.writestr(f"{layer}.dbf", dbf)
    return out.getvalue()


def write_archives(cells: DataFrame, path: str) -> None:
    """cells: archive, key, ring -> a file per archive with its cells by key. An archive is made by one task: deal few cells to each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        rings = [[(p["x"], p["y"]) for p in ring] for ring in pdf["ring"]]
        return pd.DataFrame({"value": [archive([str(k) for k in pdf["key"]], rings)]})

    made = cells.groupBy("archive").applyInPandas(pack, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
