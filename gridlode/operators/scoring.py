"""Ranking of sites by emissions and the heat beneath them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _c, round_half_up
from . import spatial

# Emissions that score 100.
ETHANOL_FULL, EMITTER_FULL = 600_000.0, 20_000_000.0
TOP_EMITTERS = 500


def emission_score(emissions, full: float) -> Column:
    return F.least(F.lit(100.0), _c(emissions) / full * 100)


def geo_score(t) -> Column:
    """0 at 150 F, 100 at 400 F; 0 without a temperature or at exactly 0 F."""
    return F.when(F.coalesce(_c(t), F.lit(0.0)) == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (_c(t) - 150) / 250 * 100)))


def one_decimal(x) -> Column:
    return round_half_up(_c(x) * 10) / 10


def score_sites(sites: DataFrame, temperatures: DataFrame, key: str, full: float) -> DataFrame:
    """sites (key, emissions, ...) with their scores; those that score 0 are left out."""
    joined = sites.join(temperatures.select(key, "avg_temperature_f", "point_count"), key, "left")
    e, g = emission_score("emissions", full), geo_score("avg_temperature_f")
    both = e * 0.5 + g * 0.5
    return joined.where(both > 0).withColumn("emissions_score", one_decimal(e)).withColumn("geo_score", one_decimal(g)).withColumn("combined_score", one_decimal(both))


def optimal_sites(ethanol: DataFrame, emitters: DataFrame, mesh: DataFrame, top: int = 10) -> DataFrame:
    """The best sites of both sources (site, name, lon, lat, emissions), ranked by the rounded score.

    Of equal scores ethanol plants come first, then by site; of emitters the 500 largest take part.
    """
    parts, pyramid = [], spatial.mesh_pyramid(mesh)
    for seq, (name, rows, full) in enumerate((("ethanol", ethanol, ETHANOL_FULL), ("emitter", emitters, EMITTER_FULL))):
        rows = rows.where("emissions > 0").select("site", "name", "lon", "lat", "emissions")
        if name == "emitter":
            rows = rows.orderBy(F.desc("emissions"), "site").limit(TOP_EMITTERS)
        scored = score_sites(rows, spatial.temperature_at(rows, pyramid, "site"), "site", full)
        parts.append(scored.withColumn("source_type", F.lit(name)).withColumn("seq", F.lit(seq)))
    order = [F.desc("combined_score"), F.asc("seq"), F.desc("emissions"), F.asc("site")]
    best = parts[0].unionByName(parts[1], allowMissingColumns=True).orderBy(*order).limit(top)
    return spatial.ranked(best, order).drop("seq")
