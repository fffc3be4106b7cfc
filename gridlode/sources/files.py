"""Readers of point, line and parcel files. Nothing is inferred: all columns come as text and are cast when cleaned."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, geo
from ..operators.shared import checkpoint, exists
from . import csv_records, geojson_records, sinks

GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"type string, properties string, geometry {GEOMETRY}"
#: A field after a comma, quoted or plain.
QUOTED = r',("(?:[^"]|"")*"|[^,]*)'


def read_csv(spark: SparkSession, path: str, strict: bool = False, encoding: str | None = None) -> DataFrame:
    """CSV files with headers, all text, split at true record bounds. strict: rows with another number of fields are dropped."""
    return csv_records.read_csv(spark, path, strict, encoding)


def csv_profile(rows: DataFrame) -> tuple[list[str], int]:
    """Headers and number of rows."""
    return rows.columns, rows.count()


def split_lines(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """Columns of lines (value) split at each separator, quoted or not; fields that a line lacks are null."""
    parts = F.split("value", re.escape(sep))
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def read_sheets(spark: SparkSession, path: str, fields: dict[str, list[str]], skip: int = 0) -> DataFrame:
    """CSV exports of sheets: file, and each field from the first of its possible headers that has a value.

    The first `skip` lines of a file are titles, the next one holds its headers. A sheet, and so a file, is one row: at
    most about a million lines by its format.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\r?\n"), lambda x: x != "").alias("l"))
    lines = text.select("file", F.get("l", skip).alias("head"), F.explode(F.slice("l", skip + 2, F.greatest(F.size("l") - skip - 1, F.lit(0)))).alias("line"))
    fields_of = lambda c: F.transform(F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(QUOTED), 1), lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"')))
    names, values = fields_of("head"), fields_of("line")
    cells = lines.where(F.size(values) == F.size(names)).select("file", F.map_from_arrays(names, values).alias("m"))
    pick = lambda options: F.coalesce(*[F.nullif(F.trim(F.try_element_at("m", F.lit(h))), F.lit("")) for h in options])
    return cells.select("file", *[pick(options).alias(field) for field, options in fields.items()])


def numbered(rows: DataFrame, name: str = "_i") -> DataFrame:
    """rows with their positions, from 0, in the order in which Spark deals them out: each partition's begin where the partition before it ends.

    The rows are checkpointed, so that they are dealt out alike when counted and when numbered; the driver sees one
    count per partition.
    """
    rows = checkpoint(rows)
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0)))]
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    # the id holds the partition above the lower 33 bits and the row's place in it below
    i = F.monotonically_increasing_id()
    return rows.withColumn(name, F.get(offsets, F.shiftright(i, 33).cast("int")) + i.bitwiseAND(F.lit((1 << 33) - 1)))


def rows_between(rows: DataFrame, skip: int = 0, most: int | None = None, every: int = 1) -> DataFrame:
    """rows after the first `skip`, every n-th, at most `most`: for resuming and sampling by position."""
    out = numbered(rows).where((F.col("_i") >= skip) & ((F.col("_i") - skip) % every == 0))
    return (out if most is None else out.where(F.col("_i") < skip + most * every)).drop("_i")


def first_of(*names: str):
    """The first non-null of the columns that carry a value under different names."""
    return F.coalesce(*[F.col(f"`{n}`") for n in names])


def once(rows: DataFrame, **columns) -> DataFrame:
    """Columns that are evaluated once per row, however often they are used: filters on them aren't pushed through a generator, which would copy them."""
    return rows.select(F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def points_from_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid points, rejected rows with their errors) of a CSV file, by the names of its headers.

    Coordinates come from their columns or from well-known text, in degrees or Web Mercator metres; units follow the
    headers. Values that mean missing become null.
    """
    fields = clean.detect_fields(rows.columns)
    if "geometry" in fields and not {"latitude", "longitude"} <= fields.keys():
        _, x, y = geo.parse_wkt_point(F.col(f"`{fields['geometry']}`"))
    else:
        x, y = (clean.parse_numeric(F.col(f"`{fields[k]}`")) if k in fields else F.lit(None).cast("double") for k in ("longitude", "latitude"))
    depth = clean.parse_numeric(F.col(f"`{fields['depth']}`")) if "depth" in fields else F.lit(None).cast("double")
    heat = clean.parse_numeric(F.col(f"`{fields['temperature']}`")) if "temperature" in fields else F.lit(None).cast("double")
    flat = once(rows, _x=x, _y=y, _depth=depth, _heat=heat)
    lon, lat = geo.mercator_to_lonlat("_x", "_y")
    metres = (F.abs("_x") > 1000) | (F.abs("_y") > 1000)
    heat = F.col("_heat")
    if "temperature" in fields and clean.header_is_celsius(fields["temperature"]):
        heat = clean.celsius_to_fahrenheit(heat)
    out = once(
        flat,
        latitude=F.when(metres, lat).otherwise(F.col("_y")),
        longitude=F.when(metres, lon).otherwise(F.col("_x")),
        depth_m=clean.depth_metres(F.col("_depth"), "depth" in fields and clean.header_is_feet(fields["depth"])),
        temperature_f=heat,
    )
    out = out.withColumn("errors", clean.point_errors()).withColumn("warnings", clean.point_warnings())
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)


def read_features(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """file, properties (JSON), kind, coordinates (JSON) of the features of GeoJSON files of any shape.

    A file may hold a FeatureCollection, one Feature, an array of features, or a bare geometry, and is read as one row.
    split: for files of any size, cut into features by many tasks.
    """
    if split:
        return feature_parts(geojson_records.read_elements(spark, path))
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    return normalise_features(text)


def feature_parts(rows: DataFrame) -> DataFrame:
    """rows: file, value (JSON of a feature or of a bare geometry) -> a feature's parts. Each text is read once."""
    top = rows.select("file", F.json_tuple("value", "properties", "geometry", "coordinates", "type").alias("properties", "_geometry", "_own", "_type"))
    bare = F.col("_own").isNotNull() & F.col("_geometry").isNull()
    parts = top.select("*", F.json_tuple("_geometry", "type", "coordinates").alias("_kind", "_at"))
    either = lambda own, inner: F.when(bare, F.col(own)).otherwise(F.col(inner))
    return parts.select("file", F.when(~bare, F.col("properties")).alias("properties"), either("_type", "_kind").alias("kind"), either("_own", "_at").alias("coordinates"))


def features_of(rows: DataFrame) -> DataFrame:
    """rows: file, f (a feature's JSON) -> its parts."""
    get = lambda p: F.get_json_object("f", p)
    return rows.select("file", get("$.properties").alias("properties"), get("$.geometry.type").alias("kind"), get("$.geometry.coordinates").alias("coordinates"))


def normalise_features(text: DataFrame) -> DataFrame:
    """text: file, value -> a row per feature."""
    kind = F.get_json_object("value", "$.type")
    collection = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    many = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).when(kind == "FeatureCollection", collection)
    bare = F.to_json(F.struct(F.lit("Feature").alias("type"), F.from_json("value", GEOMETRY).alias("geometry")))
    one = F.when(kind == "Feature", F.array("value")).when(F.get_json_object("value", "$.coordinates").isNotNull(), F.array(bare))
    return features_of(text.select("file", F.explode(F.coalesce(many, one)).alias("f")))


def read_lines_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON."""
    return spark.read.schema(schema).json(path)


def listing_of_file(name):
    """The listing's number in a name like 6406_parcels.geojson."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+)_[^/]*$", 1), F.lit(""))


def read_feature_folder(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Features of all files of a folder, with listing_id from their names."""
    return read_features(spark, path, split).withColumn("listing_id", listing_of_file("file"))


def lines_from_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with kv, class, owner, status and a multi-line geometry, rejected features with the error)."""
    p = F.from_json("properties", "map<string,string>")
    get = lambda *names: clean.clean_string(F.coalesce(*[F.try_element_at(p, F.lit(n)) for n in names]))
    text = F.coalesce(F.try_element_at(p, F.lit("voltage")), F.try_element_at(p, F.lit("VOLTAGE")))
    single = F.transform(F.from_json("coordinates", "array<array<double>>"), lambda c: geo.point(F.get(c, 0), F.get(c, 1)))
    multi = F.transform(F.from_json("coordinates", "array<array<array<double>>>"), lambda r: F.transform(r, lambda c: geo.point(F.get(c, 0), F.get(c, 1))))
    out = features.withColumn("error", clean.line_errors("kind", "coordinates")).select(
        get("id", "identifier").alias("id_text"),
        get("owner", "operator").alias("owner"),
        get("status").alias("status"),
        clean.parse_voltage(text).alias("kv"),
        get("volt_class", "voltage_class").alias("volt_class"),
        F.when(F.col("kind") == "LineString", geo.as_multiline(single)).otherwise(multi).alias("geom"),
        "error",
    )
    return out.where("error is null").drop("error"), out.where("error is not null")


def parcels_from_features(features: DataFrame, index: str | None = None) -> DataFrame:
    """Parcels with id, acres by their geometry, ring, centroid and the remaining properties; invalid rings are left out."""
    p = F.from_json("properties", "map<string,string>")
    part = "array<array<array<double>>>"
    rings = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", part))).otherwise(F.from_json("coordinates", f"array<{part}>"))
    shaped = F.transform(rings, lambda poly: F.transform(poly, lambda r: F.transform(r, lambda c: geo.point(F.get(c, 0), F.get(c, 1)))))
    shaped = F.transform(shaped, lambda poly: F.transform(poly, geo.ring_to_lonlat))
    rows = (features if index else numbered(features)).withColumn("geom", shaped).where(F.size("geom") > 0)
    rows = rows.where(F.forall("geom", lambda poly: geo.valid_polygon(F.get(poly, 0))))
    acres = F.aggregate(F.transform("geom", geo.polygon_acres), F.lit(0.0), lambda s, a: s + a)
    position = F.col(index) if index else F.col("_i")
    return rows.select(
        clean.pick_parcel_id(p, clean.PARCEL_ID_NAMES, position).alias("parcel_id"),
        F.try_element_at(p, F.lit("listing_id")).alias("listing_id"),
        F.coalesce(F.nullif(F.try_element_at(p, F.lit("state")), F.lit("")), F.lit("Unknown")).alias("state"),
        acres.alias("acres"),
        geo.ring_centroid(F.get(F.get("geom", 0), 0)).alias("centroid"),
        clean.other_props(p, ["listing_id", "parcel_id", "state", "acres", "description"]).alias("props"),
        "geom",
    )


def static_or(spark: SparkSession, path: str, query) -> DataFrame:
    """The stored table at path, or that of this name in its folder's manifest, if there is one, else the query's result.

    A table that can't be read is an error.
    """
    if exists(spark, path):
        return spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return sinks.cached_or(spark, folder, name, query)
