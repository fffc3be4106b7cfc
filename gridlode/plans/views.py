"""Geographic test views over the star schema: integer arithmetic, then one division, so that any engine agrees.

Each view is a list of SQL expressions over one table or join, written so that Spark and DuckDB read them alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str]]] = {
    "geo_points": (
        "lineitem",
        [
            "l_orderkey * 10 + l_linenumber as gid",
            "cast((l_orderkey * 7919 + l_linenumber * 104729) % 58500 as double) / 1000.0 - 125.0 as longitude",
            "cast((l_partkey * 6007 + l_suppkey * 3571 + l_orderkey * 31) % 25600 as double) / 1000.0 + 24.0 as latitude",
            "cast(1000 * (1 + (l_partkey % 7)) as double) as depth_m",
            "case when l_orderkey % 17 = 0 then null else l_quantity * 5.0 + cast(l_partkey % 7 as double) * 25.0 + 90.0 end as temperature_f",
        ],
    ),
    "geo_lines": (
        "part",
        [
            "p_partkey as gid",
            "case when p_partkey % 11 = 0 then null when p_partkey % 5 = 0 then cast(p_size * 4 as string) || '-' || cast(p_size * 9 as string) || ' kV' when p_partkey % 7 = 0 then '-9999' when p_partkey % 13 = 0 then 'n/a' else cast(p_size * 10 as string) || 'kV' end as voltage",
            "case when p_partkey % 11 = 0 then null else cast(p_size * 10 as double) end as kv",
            "case when p_partkey % 3 = 0 then null else p_brand end as owner",
            "cast((p_partkey * 7919) % 120000 as double) / 1000.0 - 180.0 as x0",
            "cast((p_partkey * 6007) % 70000 as double) / 1000.0 + 5.0 as y0",
            "cast((p_partkey * 7919) % 120000 + (p_partkey * 31) % 9000 as double) / 1000.0 - 182.0 as x1",
            "cast((p_partkey * 6007) % 70000 + (p_partkey * 17) % 9000 as double) / 1000.0 + 3.0 as y1",
        ],
    ),
    "listings": (
        "orders",
        [
            "o_orderkey as sale_group",
            "o_orderpriority as region",
            "case when o_orderstatus = 'O' then 'active' else 'expired' end as status",
            "cast(o_orderdate as date) as sale_start_date",
            "cast(cast(o_orderdate as date) + interval '45' day as date) as sale_end_date",
            "o_orderdate as last_scraped_at",
            "case o_orderkey % 8 when 0 then 'BLM Wyoming Oil & Gas Lease' when 1 then 'New Mexico State Land Sale' when 2 then 'Utah Geothermal Sale DNR' when 3 then 'City of Las Vegas Land Sale' when 4 then 'Nevada CLO auction' when 5 then 'BLM West Virginia sale' when 6 then 'Kansas lease' else 'Unknown Title' end as title",
            "cast(o_custkey % 5 as bigint) as parcel_count",
            "case when o_custkey % 7 = 0 then null else o_totalprice end as total_acres",
        ],
    ),
    "parcels": (
        "lineitem",
        [
            "l_orderkey as sale_group",
            "l_orderkey * 10 + l_linenumber as parcel_id",
            "l_quantity as acres",
            "l_linestatus = 'O' as is_active",
            "cast(l_suppkey % 50 as string) as state",
            "cast((l_orderkey * 7919 + l_linenumber * 104729) % 58500 as double) / 1000.0 - 125.0 as longitude",
            "cast((l_partkey * 6007 + l_suppkey * 3571 + l_orderkey * 31) % 25600 as double) / 1000.0 + 24.0 as latitude",
        ],
    ),
    "datacenters": (
        "customer join nation on c_nationkey = n_nationkey",
        [
            "c_custkey as internal_id",
            "c_name as name",
            "case when c_custkey % 10 = 0 then null else c_mktsegment || '-' || cast(c_custkey % 40 as string) end as operator",
            "n_name as country",
            "n_name = 'UNITED STATES' or c_nationkey % 6 = 1 as is_us",
            "case when c_custkey % 4 = 0 then '' else cast(c_custkey % 30 as string) end as state",
            "case when c_custkey % 9 = 0 then null else c_name || ' City' end as city",
            "case when c_custkey % 5 = 0 then null else cast((c_custkey * 7919) % 58500 as double) / 1000.0 - 125.0 end as longitude",
            "case when c_custkey % 5 = 0 then null else cast((c_custkey * 6007) % 25600 as double) / 1000.0 + 24.0 end as latitude",
            "case when c_acctbal < 0 then null else c_acctbal end as power_capacity_mw",
            "case when c_custkey % 3 = 0 then null else c_mktsegment end as facility_type",
            "'https://example.org/dc/' || cast(c_custkey as string) as facility_url",
            "case when c_custkey % 6 = 0 then '' else cast(c_custkey as string) || ' Main St' end as address_full",
        ],
    ),
    "emitters": (
        "supplier",
        [
            "s_suppkey as site",
            "s_name as name",
            "case s_suppkey % 9 when 0 then 'Power Plants' when 1 then 'Petroleum and Natural Gas Systems' when 2 then 'Waste' when 3 then 'Chemicals' when 4 then 'Minerals,Power Plants' when 5 then 'Metals' when 6 then null when 7 then 'Natural Gas Supply' else 'Pulp and Paper' end as industry_type_sectors",
            "case when s_acctbal < 0 then null else s_acctbal * 2000.0 end as total_emissions_2023",
            "cast((s_suppkey * 7919) % 58500 as double) / 1000.0 - 125.0 as lon",
            "cast((s_suppkey * 6007) % 25600 as double) / 1000.0 + 24.0 as lat",
        ],
    ),
    "ethanol": (
        "customer",
        [
            "c_custkey as site",
            "c_name as name",
            "case when c_acctbal < 0 then null else c_acctbal * 60.0 end as emissions",
            "cast((c_custkey * 4973) % 58500 as double) / 1000.0 - 125.0 as lon",
            "cast((c_custkey * 6007) % 25600 as double) / 1000.0 + 24.0 as lat",
        ],
    ),
    "geology": (
        "part",
        [
            "p_partkey as cell_id",
            "cast((p_partkey * 7919) % 58500 as double) / 1000.0 - 125.0 as longitude",
            "cast((p_partkey * 6007) % 25600 as double) / 1000.0 + 24.0 as latitude",
            "cast(p_size * 200 as bigint) as dt",
            "case p_partkey % 5 when 0 then 'BSMT3' when 1 then 'BSMT1' when 2 then '' when 3 then 'BSMT9' else 'BSMT4' end as code",
        ],
    ),
    "found_facilities": (
        "customer",
        [
            "c_custkey as internal_id",
            "case when c_custkey % 2 = 0 then 'Site ' || cast(c_custkey % 20 as string) else 'SITE ' || cast(c_custkey % 6 as string) end as name",
            "case when c_custkey % 9 = 0 then null else 'City ' || cast(c_custkey % 3 as string) end as city",
            "case when c_custkey % 4 = 0 then '' else 'State ' || cast(c_custkey % 2 as string) end as state",
        ],
    ),
    "listed_cards": (
        "customer",
        [
            "c_custkey % 5 as page_id",
            "c_custkey as internal_id",
            "'Site ' || cast(c_custkey % 4 as string) as name",
            "c_mktsegment || ' ' || cast(c_custkey as string) as operator",
            "cast(c_custkey % 3 as string) || ' Main St' as street",
        ],
    ),
    "ethanol_owners": (
        "part",
        [
            "p_partkey as id",
            "p_type as company",
            "p_brand || ' site' as site",
            "case p_partkey % 9 when 0 then 'Nebraska' when 1 then 'NE' when 2 then 'Iowa' when 3 then 'IA' when 4 then 'Kansas' when 5 then 'Minnesota' when 6 then 'mn' when 7 then 'North Dakota' else 'South Dakota' end as state",
        ],
    ),
    "epa_sites": (
        "supplier",
        [
            "s_suppkey as fid",
            "case s_suppkey % 4 when 0 then 'Economy Brass LLC' when 1 then 'Large Burnished Corp' when 2 then 'Promo Steel Co' else 'Standard Plated Inc' end as facility",
            "'Brand#' || cast(s_suppkey % 30 as string) as city",
            "case s_suppkey % 7 when 0 then 'NE' when 1 then 'NEBRASKA' when 2 then 'Iowa' when 3 then 'KS' when 4 then 'MINNESOTA' when 5 then 'NORTH DAKOTA' else 'Indiana' end as state",
        ],
    ),
    "sightings": ("events", ["user_id", "ts", "event_id", "event_type", "value"]),
    "html": ("pages", ["page_id", "url", "html"]),
}


class Views:
    """The views of a data folder as DataFrames, and its tables by table()."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source, columns = VIEWS[name]
        first, _, rest = source.partition(" join ")
        rows = self.table(first)
        if rest:
            other, _, on = rest.partition(" on ")
            left, right = (x.strip() for x in on.split("="))
            there = self.table(other)
            rows = rows.join(there, rows[left] == there[right])
        return rows.selectExpr(*columns)


def duck(sql: str) -> str:
    """A DuckDB query with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    made = ", ".join(f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"with {made}, {body[5:]}" if body.lower().startswith("with ") else f"with {made} {body}"
