"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 60-bit integer from a hash of its id. A source's budget of words is met by the
documents below a threshold of that integer. The threshold is found without sorting: sum the words by
source and the leading 12 bits, find the bucket in which the running sum passes the budget, then refine
only that bucket by the next 12 bits, five times in all. Thresholds are nested: a larger budget takes a
superset of the documents of a smaller one. The documents whose integer is the threshold itself are
taken in part, in proportion to the rest of the budget.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its
own, after all others; a null doc_id hashes as the empty text; repeated rows are taken alike, each on its
own; without words every target is 0; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, checkpoint, join_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BITS, LEVELS = 12, 5


def word_count(text):
    """Number of whitespace-separated words of a text column; null and empty have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS}]+")).cast("long")


def hash60(doc_id):
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _source_key(source):
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: source, source_size -> plus weight and target. Weights repeat over the sources by code point, null last.

    A source stops at `most` times its size, which is where the words per weight reach most * size / weight.
    By that ratio, the first k sources are at their stop for the smallest k for which the level of all
    others is below the next ratio. The windows hold one row per source, never documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", "_rank")
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    left = F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = sources.withColumn("_rank", rank).withColumn("weight", weight)
    ranked = ranked.withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("weight")).withColumn("_level", level)
    settled = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(upto)
    stop = F.lit(most) * F.col("source_size")
    return ranked.withColumn("target", F.round(F.least(stop, F.coalesce(settled * F.col("weight"), stop)), 6)).select(
        "source", "source_size", "weight", "target"
    )


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sized: source, _size, _h of every document -> a row per source with its target and threshold.

    Columns: _key, source_size, target, _whole (copies of every document), _cut, _rest, _at_cut
    (documents below _cut get one more copy, those at it share _rest words of their _at_cut).
    """
    docs = sized.select(_source_key(F.col("source")).alias("_key"), "source", "_size", "_h")
    sources = docs.groupBy("_key", "source").agg(F.sum("_size").alias("source_size"))
    goals = checkpoint(
        targets(sources, weights, share, most)
        .withColumn("_key", _source_key(F.col("source")))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    )
    need = goals.select(
        "_key",
        (F.floor("target") - F.col("_whole") * F.col("source_size")).cast("long").alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
    ).where("rest > 0")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        # the documents of the boundary bucket only, summed on the map side before anything is shuffled
        at = docs.select("_key", F.shiftright("_h", shift + BITS).alias("prefix"), F.shiftright("_h", shift).alias("piece"), "_size")
        at = join_small(at, need.select("_key", "prefix"), ["_key", "prefix"], "left_semi")
        sums = at.groupBy("_key", "piece").agg(F.sum("_size").alias("w")).join(need.select("_key", "rest"), "_key")
        # at most 4,096 sums per source
        sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("_key").orderBy("piece")))
        first = F.min_by(F.struct("piece", "upto", "w", "rest"), F.col("piece"))
        need = checkpoint(
            sums.where("upto > rest")
            .groupBy("_key")
            .agg(first.alias("b"))
            .selectExpr("_key", "b.rest - (b.upto - b.w) as rest", "b.piece as prefix", "b.w as at_cut")
        )
    cuts = need.selectExpr("_key", "prefix as _cut", "rest as _rest", "at_cut as _at_cut")
    return goals.join(cuts, "_key", "left").select("_key", "source_size", "target", "_whole", "_cut", "_rest", "_at_cut")


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with source, _size, _h and anything else -> plus source_size, target, taken."""
    part = (
        F.when(F.col("_h") < F.col("_cut"), F.col("_size"))
        .when(
            F.col("_h") == F.col("_cut"),
            F.expr("cast(_size as decimal(19,0)) * cast(_rest as decimal(19,0)) div cast(_at_cut as decimal(19,0))"),
        )
        .otherwise(F.lit(0))
    )
    joined = join_small(docs.withColumn("_key", _source_key(F.col("source"))), plan, ["_key"])
    return joined.withColumn("taken", (F.col("_whole") * F.col("_size") + part).cast("long")).drop("_key", "_whole", "_cut", "_rest", "_at_cut")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, _size, _h of each row, read once from the texts."""
    return checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), hash60(F.col("doc_id")).alias("_h")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document."""
    sized = sized_documents(docs)
    out = apply_mix(sized, plan_mix(sized, weights, share, most))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
s as (select source, sum(size)::double as ss, row_number() over (order by source nulls last) as r from d group by source),
w as (select *, [5.0, 2.0, 1.0][(r - 1) % 3 + 1]::double as wt from s),
l as (select *, 2 * ss / wt as ratio,
    (1.5 * sum(ss) over () - 2 * coalesce(sum(ss) over (order by 2 * ss / wt, r rows between unbounded preceding and 1 preceding), 0))
    / (sum(wt) over () - coalesce(sum(wt) over (order by 2 * ss / wt, r rows between unbounded preceding and 1 preceding), 0)) as lev
  from w),
k as (select *, (select l2.lev from l l2 where l2.lev <= l2.ratio order by l2.ratio, l2.r limit 1) as level,
    (select l2.ratio from l l2 where l2.lev <= l2.ratio order by l2.ratio, l2.r limit 1) as at_ratio from l),
t as (select source, ss, round(least(2 * ss, case when ratio >= at_ratio then level * wt else 2 * ss end), 6) as target from k),
c as (select d.doc_id, d.size, t.ss, t.target, d.h,
    case when t.ss > 0 then floor(t.target / t.ss) else 0 end as whole,
    sum(d.size) over (partition by d.source order by d.h rows between unbounded preceding and current row) - d.size as below
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, ss::bigint as source_size, target,
  (whole * size + greatest(0, least(size, floor(target) - whole * ss - below)))::bigint as taken
from c
"""
