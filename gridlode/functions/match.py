"""Company names made comparable, and the score of two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import _c

# Words that say nothing of a company.
STOP_WORDS = (
    "LLC", "INC", "CORP", "CORPORATION", "COMPANY", "CO", "LP", "LTD", "ETHANOL", "ENERGY", "BIOFUELS", "BIOENERGY", "RENEWABLE", "FUELS", "PLANT",
    "BIOREFINING", "BIOREFINERY",
)


def normalise_name(name) -> Column:
    """Upper case, letters and digits only, without stop words, single spaces."""
    plain = F.regexp_replace(F.upper(F.coalesce(_c(name), F.lit(""))), r"[^A-Z0-9\s]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(STOP_WORDS)})\b", ""), r"\s+", " "))


def parse_thousands(text) -> Column:
    """'197,928' -> 197928; '---' and other text -> null."""
    return F.replace(F.trim(_c(text)), F.lit(","), F.lit("")).try_cast("long")


def _within(a, b) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _words(x) -> Column:
    return F.filter(F.split(x, " "), lambda w: F.length(w) > 2)


def name_points(company, facility) -> Column:
    """50 for containment, 10 or 5 for each pair of words that are equal or within each other."""
    return F.when(_within(_c(company), _c(facility)), 50).otherwise(0) + _pairs(company, facility, lambda a, b: F.when(a == b, 10).when(_within(a, b), 5).otherwise(0))


def place_points(site, city) -> Column:
    """30 for containment, 15 for each pair of equal words."""
    return F.when(_within(_c(site), _c(city)), 30).otherwise(0) + _pairs(site, city, lambda a, b: F.when(a == b, 15).otherwise(0))


def _pairs(left, right, points) -> Column:
    each = lambda s, a: s + F.aggregate(_words(_c(right)), F.lit(0), lambda t, b: t + points(a, b))
    return F.aggregate(_words(_c(left)), F.lit(0), each)


def match_score(company, site, facility, city) -> Column:
    """Points for normalised names and places."""
    return name_points(company, facility) + place_points(site, city)


def same_state(a, b) -> Column:
    """Whether one state text holds the other, or the other's first two letters."""
    a, b = F.upper(F.coalesce(_c(a), F.lit(""))), F.upper(F.coalesce(_c(b), F.lit("")))
    return F.contains(a, b) | F.contains(b, F.substring(a, 1, 2))


def state_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """state, other: the upper-case states (null as the empty text) of both sides that match by same_state; one row each."""
    plain = F.upper(F.coalesce("state", F.lit("")))
    return left.select(plain.alias("state")).distinct().crossJoin(right.select(plain.alias("other")).distinct()).where(same_state("state", "other"))


def in_same_state(companies: DataFrame, facilities: DataFrame) -> DataFrame:
    """Each company with each facility whose state text matches its own by same_state. Both have a column state.

    The rule runs over the distinct states of both sides only; companies meet facilities by equi-joins through the
    pairs of states found. A null state counts as the empty text, which matches every state.
    """
    plain = F.upper(F.coalesce("state", F.lit("")))
    pairs = state_pairs(companies, facilities).select(F.col("state").alias("_c"), F.col("other").alias("_f"))
    return companies.withColumn("_c", plain).drop("state").join(pairs, "_c").join(facilities.withColumn("_f", plain).drop("state"), "_f").drop("_c", "_f")


def best_facilities(companies: DataFrame, facilities: DataFrame, least: int = 25) -> DataFrame:
    """The best facility of each company in a matching state: `operators.matching.best_facilities`."""
    from ..operators import matching

    return matching.best_facilities(companies, facilities, least)
