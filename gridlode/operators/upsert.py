"""Lifecycle of keyed tables as functions of (old, new) tables that return the merged one. `as_of` replaces the clock.

A table is written whole to a new path and swapped in; plain files have no update. Keys must not be null unless said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def flag_repeats(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows with `duplicate`: whether a row before it by `order` has the same key, the lower-cased keys joined by '|'; null counts as empty."""
    key = F.lower(F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in keys]))
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def first_cards(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and the fields of the list cards of each page; of cards with one name and street the first on its page counts."""
    cards = pages.select(key, F.posexplode(extract.facility_cards(html)).alias("_at", "c")).select(key, "_at", "c.name", "c.operator", "c.street", "c.postal_city", "c.href")
    return first_per_key(cards, [key, "name", "street"], [F.col("_at")]).drop("_at")


def keep_first(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert, doing nothing on conflict: old rows stay, and new keys come with their first row. Null keys equal each other."""
    fresh = first_per_key(new, keys, order).alias("n")
    same = None
    for k in keys:
        test = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        same = test if same is None else same & test
    return old.unionByName(fresh.join(old.alias("o"), same, "left_anti").select(*old.columns), allowMissingColumns=True)


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list, keep: list[str] = ()) -> DataFrame:
    """Upsert: rows of new replace those of old with the same key; columns `keep` stay as they were."""
    last = first_per_key(new, keys, order)
    before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_known"))
    merged = last.join(before, keys, "left")
    for c in keep:
        merged = merged.withColumn(c, F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    return old.join(last.select(*keys), keys, "left_anti").unionByName(merged.select(*old.columns))


def seen_upsert(sightings: DataFrame, keys: list[str], values: list[str], at: str, tie: list[str] = ()) -> DataFrame:
    """All sightings of a key -> its latest values, first_seen_at and last_seen_at. One aggregation, combined before the shuffle.

    Merging a table into itself works alike: give its rows as sightings at their first and last times.
    """
    latest = F.max_by(F.struct(*values), F.struct(at, *tie)).alias("v")
    out = sightings.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), latest)
    return out.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], "first_seen_at", "last_seen_at")


def merge_seen(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], at: str) -> DataFrame:
    """seen_upsert of new sightings into a table that it made before."""
    part = lambda df, t: df.select(*keys, *values, F.col(t).alias(at), F.lit(t == at).alias("_new"))
    every = part(old, "first_seen_at").unionByName(part(old, "last_seen_at")).unionByName(part(new, at))
    return seen_upsert(every, keys, values, at, ["_new"])


def rejects(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required columns, the others)."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return rows.where(ok), rows.where(~ok)


def update_by_key(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of old with the non-null values of changes (one row per key)."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(new, key, "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def with_parcel_stats(listings: DataFrame, parcels: DataFrame, key: str) -> DataFrame:
    """listings with parcel_count, total_acres and is_processed of their parcels."""
    sums = parcels.groupBy(key).agg(F.count("*").alias("parcel_count"), F.sum(F.coalesce("acres", F.lit(0.0))).alias("total_acres"))
    out = listings.join(sums, key, "left")
    return out.withColumn("is_processed", F.col("parcel_count").isNotNull()).fillna({"parcel_count": 0, "total_acres": 0.0})


def expire_missing(listings: DataFrame, active: DataFrame, key: str, only_active: bool = True) -> DataFrame:
    """Status 'expired' for listings that the active set lacks; with only_active, only those that are active now."""
    found = active.select(key).distinct().withColumn("_here", F.lit(True))
    gone = F.col("_here").isNull() & ((F.col("status") == "active") if only_active else F.lit(True))
    return listings.join(found, key, "left").withColumn("status", F.when(gone, "expired").otherwise(F.col("status"))).drop("_here")


def cleanup_expired(listings: DataFrame, parcels: DataFrame, active: DataFrame, key: str, only_active: bool = True) -> tuple[DataFrame, DataFrame]:
    """(listings, parcels): listings that the active set lacks are expired, and their parcels are not active."""
    found = active.select(key).distinct().withColumn("_here", F.lit(True))
    marked = parcels.join(found, key, "left").withColumn("is_active", F.col("is_active") & F.col("_here").isNotNull())
    return expire_missing(listings, active, key, only_active), marked.drop("_here")


def expire_by_date(listings: DataFrame, as_of, end: str = "sale_end_date") -> DataFrame:
    """Status 'expired' for active listings that ended before as_of; `changed` tells which."""
    over = F.coalesce((F.col("status") == "active") & (F.col(end) < F.lit(as_of)), F.lit(False))
    return listings.withColumn("changed", over).withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def purge_expired(listings: DataFrame, as_of, days: int = 30, end: str = "sale_end_date") -> DataFrame:
    """Listings without those expired for more than `days`."""
    old = (F.col("status") == "expired") & (F.col(end) < F.date_sub(F.lit(as_of), days))
    return listings.where(~F.coalesce(old, F.lit(False)))


def purge_children(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Children whose parent was kept."""
    return children.join(kept.select(key).distinct(), key, "left_semi")


def purge_unseen(facilities: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Facilities seen within the last `days`."""
    return facilities.where(F.col("last_seen_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days"))


def active_from_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children with is_active from their parent's status; null without a parent."""
    status = parents.select(key, (F.col("status") == "active").alias("_a"))
    return children.drop("is_active").join(status, key, "left").withColumnRenamed("_a", "is_active")


def register_dataset(registry: DataFrame, entry: DataFrame, order: list) -> DataFrame:
    """The catalogue with entries upserted by layer_name; created_at stays."""
    return latest_wins(registry, entry, ["layer_name"], order, keep=["created_at"])


def unnest(arrays: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from parallel arrays."""
    return arrays.select(F.inline(F.arrays_zip(*columns)))
