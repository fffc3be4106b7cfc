"""Shapefiles that lie unpacked in a folder all executors see, read by ranges of their index.

The index (.shx) has the place and length of every record, eight bytes each, so a partition is a range of records: it
reads its part of the index, then of the shapes and the attributes, record by record, and hands on bounded batches. A
file of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .shapefile import SCHEMA, attributes_of, fields_of, shape_of

RECORDS = 50_000
#: Records, and points, of a batch.
BATCH_RECORDS, BATCH_POINTS = 2_000, 200_000

ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("layer", pa.string()),
        ("record", pa.int64()),
        ("kind", pa.string()),
        ("parts", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))),
        ("attributes", pa.map_(pa.string(), pa.string())),
    ]
)


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")
        self.size = int(options.get("records", RECORDS))

    def partitions(self) -> list[Range]:
        files = [self.path] if self.path.lower().endswith(".shp") else sorted(f for f in glob(f"{self.path}/**", recursive=True) if f.lower().endswith(".shp"))
        if not files and not os.path.isdir(self.path):
            raise FileNotFoundError(f"there is no shapefile at {self.path}")
        out = []
        for f in files:
            n = (os.path.getsize(_beside(f, ".shx", True)) - 100) // 8
            out += [Range(f, i, min(i + self.size, n)) for i in range(0, n, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open(_beside(part.path, ".shx", True), "rb") as index:
            index.seek(100 + 8 * part.first)
            places = struct.iter_unpack(">2i", index.read(8 * (part.last - part.first)))
        table = _beside(part.path, ".dbf", False)
        rows, points = [], 0
        dbf = open(table, "rb") if table else None
        try:
            head = fields_of(dbf) if dbf else None
            with open(part.path, "rb") as shapes:
                for record, (at, length) in enumerate(places, part.first):
                    shapes.seek(2 * at + 8)
                    kind, parts = shape_of(shapes.read(2 * length))
                    values = attributes_of(dbf, head, record) if dbf else {}
                    rows.append({"file": part.path, "layer": os.path.basename(part.path), "record": record, "kind": kind, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts], "attributes": list(values.items())})
                    points += sum(map(len, parts))
                    if len(rows) >= BATCH_RECORDS or points >= BATCH_POINTS:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, points = [], 0
        finally:
            if dbf:
                dbf.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


def _beside(path: str, end: str, needed: bool) -> str | None:
    """The file beside a .shp file with another ending, in any case of letters."""
    stem = path[:-4]
    for e in (end, end.upper()):
        if os.path.exists(stem + e):
            return stem + e
    if needed:
        raise FileNotFoundError(f"{path} has no {end} file")
    return None


class ShapefileSource(DataSource):
    """spark.read.format("shapefile_ranges").option("records", n).load(path), path: a .shp file or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options)


def read_shapefile_ranges(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """file, layer, record, kind, parts, attributes of all records of the .shp files at path."""
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile_ranges").option("records", records).load(path)
