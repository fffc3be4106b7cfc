"""What the service's routes answer, as DataFrames over named tables. Running SQL sent by a client is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, geo
from ..operators import spatial, stats
from ..sources import sinks


def datasets(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """Registered layers with their row counts (table_name, row_count), newest first; unknown tables count 0."""
    return registry.join(counts, "table_name", "left").fillna({"row_count": 0}).orderBy(F.col("created_at").desc_nulls_first())


def dataset_stats(layer: DataFrame, geometry: str) -> DataFrame:
    return stats.point_layer_stats(layer) if geometry == "POINT" else stats.line_layer_stats(layer)


def temperature_lookup(points: DataFrame, lat: float, lng: float, depth: float) -> DataFrame:
    """The nearest reading within 50 km and 100 m of depth. The parameters are known, so the box prunes the scan."""
    reach = 50.0 / 111.0
    near = points.where(F.col("latitude").between(lat - reach, lat + reach) & F.col("depth_m").between(depth - 100, depth + 100))
    far = near.withColumn("distance_km", geo.haversine_km(F.lit(lng), F.lit(lat), "longitude", "latitude"))
    return far.where("distance_km <= 50").orderBy("distance_km").limit(1).select("temperature_f", "distance_km", "depth_m", "latitude", "longitude")


def geothermal_tile_data(points: DataFrame, west: float, south: float, east: float, north: float, depth: float, tolerance: float = 50.0) -> DataFrame:
    inside = F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
    return points.where(inside & F.col("depth_m").between(depth - tolerance, depth + tolerance)).select("longitude", "latitude", "depth_m", "temperature_f")


def parcels(rows: DataFrame) -> DataFrame:
    return rows.where("is_active")


def pins(rows: DataFrame) -> DataFrame:
    """Active parcels by their centroids, ordered by listing."""
    return rows.where("is_active and longitude is not null").orderBy(F.col("sale_group").asc_nulls_last(), F.col("parcel_id").asc_nulls_last())


def datacenters(rows: DataFrame) -> DataFrame:
    return rows.where("latitude is not null and longitude is not null").orderBy(F.col("name").asc_nulls_last())


def emitters(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("total_emissions_2023").desc_nulls_last())


def emitter_categories(rows: DataFrame) -> DataFrame:
    return stats.category_counts(rows)


def mesh(points: DataFrame, depth: float) -> DataFrame:
    return spatial.hex_mesh(points.where(F.col("depth_m").between(depth - 50, depth + 50)))


def storage_sites(rows: DataFrame) -> DataFrame:
    """Carbon storage sites with coordinates, by name."""
    return datacenters(rows)


def ethanol_plants(rows: DataFrame) -> DataFrame:
    """Plants by emissions, unknown ones last."""
    return rows.orderBy(F.col("emissions").desc_nulls_last())


def geology(rows: DataFrame, least_depth: float | None = None) -> DataFrame:
    """Cells with their quality, from a depth on."""
    rows = rows if least_depth is None else rows.where(F.col("dt") >= least_depth)
    return rows.withColumn("quality", clean.geology_quality("dt", clean.described("code", clean.BASEMENT_TYPES)))


#: What each route of the service answers; health, configuration, crawling and schema changes are left out.
ROUTES = {
    "datasets": datasets,
    "datasets/stats": dataset_stats,
    "temperature lookup": temperature_lookup,
    "tile data": geothermal_tile_data,
    "parcels": parcels,
    "pins": pins,
    "datacenters": datacenters,
    "storage sites": storage_sites,
    "emitters": emitters,
    "emitter categories": emitter_categories,
    "ethanol plants": ethanol_plants,
    "geology": geology,
    "cached mesh": mesh,
    "save cache": sinks.save_cache,
}
