"""Statistics views: one aggregation each, combined before the shuffle. NULLs first or last as the sources define it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, geo

HEX_SQUARE_MILES = 65.0
ACRES_PER_SQUARE_MILE = 640
MW_PER_HEX = 13.0


def _nought(c):
    return F.coalesce(F.col(c), F.lit(0.0))


def grid_stats(points: DataFrame, step: float = 0.5, deviation: bool = True, only_measured: bool = True, digits: int | None = 1) -> DataFrame:
    """Temperatures of each cell of a grid around its multiples: count, averages, extremes and sample deviation."""
    rows = points.where("temperature_f is not null") if only_measured else points
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    measures = [
        F.count("*").alias("point_count"),
        r(F.avg("temperature_f")).alias("avg_temperature_f"),
        r(F.avg("depth_m")).alias("avg_depth_m"),
        r(F.min("temperature_f")).alias("min_temperature_f"),
        r(F.max("temperature_f")).alias("max_temperature_f"),
    ]
    if deviation:
        measures.append(r(F.stddev_samp("temperature_f")).alias("stddev_temperature_f"))
    return rows.groupBy(geo.snap("longitude", step).alias("lon"), geo.snap("latitude", step).alias("lat")).agg(*measures)


def point_layer_stats(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count("*").alias("total_features"),
        F.count("temperature_f").alias("with_temperature"),
        F.count("depth_m").alias("with_depth"),
        F.min("temperature_f").alias("min_temp"),
        F.max("temperature_f").alias("max_temp"),
        F.avg("temperature_f").alias("avg_temp"),
        F.min("depth_m").alias("min_depth"),
        F.max("depth_m").alias("max_depth"),
        F.min("longitude").alias("west"),
        F.min("latitude").alias("south"),
        F.max("longitude").alias("east"),
        F.max("latitude").alias("north"),
    )


def line_layer_stats(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count("*").alias("total_features"),
        F.count("kv").alias("with_voltage"),
        F.min("kv").alias("min_kv"),
        F.max("kv").alias("max_kv"),
        F.avg("kv").alias("avg_kv"),
        F.count("owner").alias("with_owner"),
        F.min(F.least("x0", "x1")).alias("west"),
        F.min(F.least("y0", "y1")).alias("south"),
        F.max(F.greatest("x0", "x1")).alias("east"),
        F.max(F.greatest("y0", "y1")).alias("north"),
    )


def listing_parcel_stats(listings: DataFrame, parcels: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts over listings joined with their parcels, so a listing counts once per parcel where it isn't distinct."""
    joined = listings.join(parcels.select("sale_group", "parcel_id", "acres"), "sale_group", "left")
    active = F.col("status") == "active"
    return joined.groupBy(*by).agg(
        F.countDistinct("sale_group").alias("total_listings"),
        F.count(F.when(active, 1)).alias("active_rows"),
        F.count(F.when(F.col("status") == "expired", 1)).alias("expired_rows"),
        F.count("parcel_id").alias("total_parcels"),
        F.sum("acres").alias("total_acres"),
        F.avg("acres").alias("avg_acres"),
        F.min("sale_start_date").alias("first_sale"),
        F.max("sale_start_date").alias("last_sale"),
    )


def listing_stats(listings: DataFrame, by: list[str] = ()) -> DataFrame:
    """The same from the sums that listings carry, without a join."""
    return listings.groupBy(*by).agg(
        F.count("*").alias("total_listings"),
        F.count_if(F.col("status") == "active").alias("active_listings"),
        F.count_if(F.col("status") == "expired").alias("expired_listings"),
        F.sum(F.coalesce("parcel_count", F.lit(0))).alias("total_parcels"),
        F.sum(_nought("total_acres")).alias("total_acres"),
    )


def datacenter_stats(sites: DataFrame) -> DataFrame:
    return sites.agg(
        F.count("*").alias("total_datacenters"),
        F.count_if("is_us").alias("us_datacenters"),
        F.count_if(~F.col("is_us")).alias("international_datacenters"),
        F.countDistinct("country").alias("countries_covered"),
        F.countDistinct("state").alias("states_covered"),
        F.countDistinct("operator").alias("unique_operators"),
        F.sum(_nought("power_capacity_mw")).alias("total_power_capacity_mw"),
        F.avg(_nought("power_capacity_mw")).alias("avg_power_capacity_mw"),
        F.count(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), 1)).alias("geocoded_count"),
        F.count_if(F.size("missing_fields") > 5).alias("low_quality_count"),
    )


def country_stats(sites: DataFrame) -> DataFrame:
    return sites.groupBy("country", "is_us").agg(
        F.count("*").alias("datacenter_count"),
        F.countDistinct("operator").alias("unique_operators"),
        F.sum(_nought("power_capacity_mw")).alias("total_power_mw"),
        F.avg(_nought("power_capacity_mw")).alias("avg_power_mw"),
        F.count("latitude").alias("geocoded_count"),
    )


def operator_stats(sites: DataFrame, top: int = 50) -> DataFrame:
    """The operators with most facilities; of equals those first in the alphabet."""
    out = sites.where("operator is not null").groupBy("operator").agg(
        F.count("*").alias("facility_count"),
        F.countDistinct("country").alias("countries"),
        F.sum(_nought("power_capacity_mw")).alias("total_power_mw"),
        F.count_if("is_us").alias("us_facilities"),
        F.count_if(~F.col("is_us")).alias("international_facilities"),
    )
    return out.orderBy(F.desc("facility_count"), "operator").limit(top)


def category_counts(emitters: DataFrame) -> DataFrame:
    """Emitters per category with the total; the total sums the few categories, not the rows."""
    found = emitters.groupBy(clean.sector_category("industry_type_sectors").alias("category")).agg(F.count("*").alias("n"))
    return found.crossJoin(found.agg(F.sum("n").alias("total")))


def distinct_categories(emitters: DataFrame) -> DataFrame:
    """The categories that occur."""
    return emitters.select(clean.sector_category("industry_type_sectors").alias("category")).distinct()


def valid_sample(rows: DataFrame, required: list[str], positive: str, most: int = 1000) -> DataFrame:
    """How many of the first `most` rows are usable: all required columns set and not 0, and one of them above 0."""
    ok = F.col(positive) > 0
    for c in required:
        ok = ok & clean.falsy_to_null(c).isNotNull()
    return rows.limit(most).agg(F.count_if(ok).alias("valid"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


def emission_range(emitters: DataFrame) -> DataFrame:
    e = "total_emissions_2023"
    return emitters.agg(F.coalesce(F.min(e), F.lit(0.0)).alias("min_emissions"), F.coalesce(F.max(e), F.lit(0.0)).alias("max_emissions"), F.avg(e).alias("avg_emissions"))


def depth_slice(points: DataFrame, depth: float = 3000.0) -> DataFrame:
    t = "temperature_f"
    return points.where(F.col("depth_m") == depth).agg(F.count("*").alias("n"), F.min(t).alias("min_t"), F.max(t).alias("max_t"), F.avg(t).alias("avg_t"))


def distinct_coordinates(points: DataFrame, depth: float) -> DataFrame:
    return points.where(F.col("depth_m") == depth).agg(F.count("*").alias("n"), F.countDistinct("longitude").alias("lons"), F.countDistinct("latitude").alias("lats"))


def top_longitudes(points: DataFrame, top: int = 10) -> DataFrame:
    return points.groupBy("longitude").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "longitude").limit(top)


def duplicate_coordinates(points: DataFrame, top: int = 5) -> DataFrame:
    return points.groupBy("longitude", "latitude").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "longitude", "latitude").limit(top)


def state_counts(facilities: DataFrame) -> DataFrame:
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return facilities.groupBy("state").agg(F.count("*").alias("facilities"), F.count_if(located).alias("with_coordinates"))


def facility_summary(facilities: DataFrame) -> DataFrame:
    """Totals of an export; no row when there are no facilities. Zero coordinates count as missing."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    located = (_nought("latitude") != 0) & (_nought("longitude") != 0)
    out = facilities.agg(
        F.count("*").alias("total_facilities"),
        F.count_if(located).alias("facilities_with_coordinates"),
        F.count_if(filled("address_full")).alias("facilities_with_full_address"),
        F.countDistinct(F.when(filled("state"), F.col("state"))).alias("unique_states"),
        F.countDistinct(F.when(filled("city") & filled("state"), F.concat_ws(", ", "city", "state"))).alias("unique_cities"),
    )
    rate = F.round(F.col("facilities_with_coordinates") * 100.0 / F.col("total_facilities"), 1)
    return out.where("total_facilities > 0").withColumn("coordinate_success_rate", rate)


def resource_stats(mesh: DataFrame) -> DataFrame:
    """Hexagons hot enough for each working fluid, with their area and capacity."""
    t = F.col("avg_temperature_f")
    out = mesh.agg(F.count_if((t >= clean.EGS_CO2_F) & (t < clean.EGS_WATER_F)).alias("co2_only"), F.count_if(t >= clean.EGS_WATER_F).alias("both_fluids"))
    n = F.col("co2_only") + F.col("both_fluids")
    out = out.withColumn("total_hexes", n).withColumn("square_miles", n * HEX_SQUARE_MILES).withColumn("acres", n * HEX_SQUARE_MILES * ACRES_PER_SQUARE_MILE)
    return out.withColumn("total_gw", n * MW_PER_HEX / 1000).withColumn("co2_only_gw", F.col("co2_only") * MW_PER_HEX / 1000)


def compare_meshes(conventional: DataFrame, deep: DataFrame, conventional_c: float = 200.0, deep_c: float = 150.0) -> DataFrame:
    """Hexagons over each threshold, and how many more the second one has; never under 0. Two rows meet."""
    hot = lambda m, c, name: m.agg(F.count_if(F.col("avg_temperature_f") >= c * 9 / 5 + 32).alias(name))
    both = hot(conventional, conventional_c, "conventional").crossJoin(hot(deep, deep_c, "co2"))
    more = F.greatest(F.lit(0), F.col("co2") - F.col("conventional"))
    return both.withColumn("unlocked", more).withColumn("unlocked_gw", more * MW_PER_HEX / 1000).withColumn("conventional_gw", F.col("conventional") * MW_PER_HEX / 1000)


def ring_bounds(shapes: DataFrame, ring: str) -> DataFrame:
    p = shapes.select(F.explode(ring).alias("p"))
    return p.agg(F.min("p.x").alias("west"), F.min("p.y").alias("south"), F.max("p.x").alias("east"), F.max("p.y").alias("north"))


def crawl_stats(records: DataFrame) -> DataFrame:
    """Records, US and other, with and without coordinates, and the rate."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    out = records.agg(F.count("*").alias("total"), F.count_if("is_us").alias("us"), F.count_if(~F.col("is_us")).alias("international"), F.count_if(located).alias("located"))
    return out.withColumn("coordinate_rate", F.round(F.when(F.col("total") > 0, F.col("located") * 100.0 / F.col("total")), 1))
