"""Writers: GeoJSON, CSV, manifests and partitioned tables."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, geo
from ..operators.shared import move_part
from ..operators.versions import Document

# The columns of an export.
EXPORT_COLUMNS = ("id", "name", "address_full", "city", "state", "postal_code", "country", "latitude", "longitude", "source", "source_url", "first_seen_at", "last_seen_at")
#: A response holds at most so many features; larger results are written as lines of features.
MOST_FEATURES = 100_000


def features(rows: DataFrame, lon: str = "longitude", lat: str = "latitude", key: str | None = None) -> DataFrame:
    """A GeoJSON feature as text per row."""
    props = F.struct(*[c for c in rows.columns if c not in (lon, lat)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    head = [F.lit("Feature").alias("type")] + ([F.col(key).alias("id")] if key else [])
    return rows.select(F.to_json(F.struct(*head, props.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_features(rows: DataFrame, path: str, **where) -> None:
    """Features as newline-delimited text, in parallel."""
    features(rows, **where).write.mode("overwrite").text(path)


def write_collection_file(found: DataFrame, path: str) -> None:
    """Features (value, JSON) as one FeatureCollection in one file of that name: made by many tasks, then written line by line by one, as a file is.

    Its first element is null, which readers pass over, so that no line needs to know whether it is the last.
    """
    spark = found.sparkSession
    line = lambda text: pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["value"])

    def run(batches):
        yield line('{"type":"FeatureCollection","features":[null')
        for batch in batches:
            yield batch.filter(pc.greater(pc.binary_length(batch.column(0)), 0))
        yield line("]}")

    # an empty line, so that there is a task without features too
    lines = found.select(F.concat(F.lit(","), "value").alias("value")).union(spark.createDataFrame([("",)], "value string"))
    whole = lines.repartition(1).mapInArrow(run, "value string")
    whole.write.text(f"{path}.parts")
    move_part(spark, f"{path}.parts", path)


def feature_collection(rows: DataFrame, total: str | None = None, as_of: str | None = None, **where) -> str:
    """A FeatureCollection with its count, and the sum of a column; refuses more than MOST_FEATURES rows."""
    found = features(rows, **where).limit(MOST_FEATURES + 1).collect()
    if len(found) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features; use write_features")
    meta = {"count": len(found), "generated": as_of}
    if total:
        meta[f"total_{total}"] = rows.agg(F.sum(F.coalesce(total, F.lit(0.0)))).head()[0] or 0.0
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(r["value"]) for r in found], "metadata": meta})


def write_csv(rows: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV with headers; quotes in fields are doubled, NULL is empty."""
    rows.write.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)


def export_frame(facilities: DataFrame) -> DataFrame:
    """The fixed columns of an export, times in ISO form."""
    have = set(facilities.columns)
    pick = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS]
    out = facilities.select(*pick)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return out.select(*[iso(c) if c.endswith("_seen_at") and dict(out.dtypes)[c] != "string" else F.col(c) for c in out.columns])


def export_csv(facilities: DataFrame, path: str, header: bool = True) -> bool:
    """Writes the export, NULL as empty; False and nothing written without rows."""
    if facilities.isEmpty():
        return False
    export_frame(facilities).write.mode("overwrite").option("header", header).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
    return True


def append_rows(rows: DataFrame, path: str) -> None:
    """Bulk load to staging."""
    rows.write.mode("append").parquet(path)


def replace_rows(rows: DataFrame, path: str) -> None:
    """Delete all, then insert; for tables that nobody reads or writes meanwhile. `KeyedTable.replace` is one step."""
    rows.write.mode("overwrite").parquet(path)


def write_by_month(rows: DataFrame, path: str, at: str = "created_at") -> None:
    """A table in a folder per month, so that a filter on year and month prunes files."""
    rows.withColumn("year", F.year(at)).withColumn("month", F.month(at)).write.mode("append").partitionBy("year", "month").parquet(path)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return Document(spark, f"{folder}/manifest").read()[1] or {"version": "1.0", "sources": {}}


def save_cache(rows: DataFrame, folder: str, name: str, as_of: str, depth: float | None = None) -> dict:
    """Writes a source's table beside the manifest, then its entry into it, by one rename.

    The table before it stays until then, and other writers' entries are kept.
    """
    spark = rows.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{table}")
    version = spark.range(1).select(extract.data_version(F.lit(as_of).cast("timestamp"))).head()[0]
    count = spark.read.parquet(f"{folder}/{table}").count()
    entry = {"cached": True, "defaultDepth": depth, "lastIngestion": as_of, "dataVersion": version, "featureCount": count, "table": table}

    def add(manifest):
        manifest = manifest or {"version": "1.0", "sources": {}}
        return {**manifest, "sources": {**manifest["sources"], name: entry}, "lastUpdated": as_of}

    return Document(spark, f"{folder}/manifest").change(add)


def cached_or(spark: SparkSession, folder: str, name: str, query) -> DataFrame:
    """The stored table of a source if the manifest has one, else the query's result."""
    entry = read_manifest(spark, folder)["sources"].get(name)
    return spark.read.parquet(f"{folder}/{entry['table']}") if entry else query()


def load_listing(spark: SparkSession, folder: str, listing: str) -> DataFrame:
    """The stored parcels of one listing: partition pruning reads its folder only."""
    return spark.read.parquet(folder).where(F.col("listing_id") == listing)


def save_listings(parcels: DataFrame, folder: str) -> None:
    parcels.write.mode("overwrite").partitionBy("listing_id").parquet(folder)


def with_geometry(rows: DataFrame, as_of: str | None = None) -> DataFrame:
    """Derived columns in place of triggers: the point and, with as_of, when the row was written."""
    out = rows.withColumn("geom", F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), geo.geojson_point("longitude", "latitude")))
    return out if as_of is None else out.withColumn("updated_at", F.lit(as_of).cast("timestamp"))


def with_centroid(rows: DataFrame, ring: str = "ring", as_of: str | None = None) -> DataFrame:
    """rows of parcels with the centroid of their outer ring (points x, y) as longitude and latitude where they lack one, and its point.

    Rows without a ring keep what they have; updated_at changes where something was filled in.
    """
    lacks = F.col("longitude").isNull() | F.col("latitude").isNull()
    centre = F.when(F.size(ring) > 0, geo.ring_centroid(F.col(ring)))
    fills = lacks & centre.isNotNull()
    out = rows.withColumn("_c", F.when(fills, centre))
    if as_of is not None:
        before = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None).cast("timestamp")
        out = out.withColumn("updated_at", F.when(F.col("_c").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(before))
    out = out.withColumns({"longitude": F.coalesce("_c.x", "longitude"), "latitude": F.coalesce("_c.y", "latitude")})
    return with_geometry(out.drop("_c"))
