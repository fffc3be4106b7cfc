"""Company matching without meeting all pairs: an inverted index of words and names.

A score is made of names that hold each other (50), places that hold each other (30), and pairs of words. Which texts
hold which is found by automata over the distinct texts of one side, in slices of counted bytes, run over the distinct
texts of the other. So only pairs with points are made, of distinct names and of distinct places; a pair of names is worth
a facility on its own from `least` points on, and then only the least fid of those with that name stands for them: one with
points for its place too comes by the pair of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import match
from .shared import checkpoint, small

SLICE_BYTES = 16 << 20


def _slices(texts: DataFrame) -> Iterator[list[str]]:
    """The distinct texts (t) in lists of about SLICE_BYTES."""
    total = texts.agg(F.sum(F.octet_length("t") + 16)).head()[0] or 0
    parts = int(total // SLICE_BYTES) + 1
    for k in range(parts):
        yield [r["t"] for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).collect()]


def held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: distinct non-empty texts t -> i, o: each text of inner and each of outer that holds it."""
    spark, out = inner.sparkSession, None
    for part in _slices(inner):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t in shared.value:
                automaton.add_word(t, t)
            if shared.value:
                automaton.make_automaton()
            for batch in batches:
                found = [(i, o) for o in batch.column(0).to_pylist() for i in ({i for _, i in automaton.iter(o)} if shared.value else ())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["i", "o"])

        found = outer.select("t").mapInArrow(run, "i string, o string")
        out = found if out is None else out.unionByName(found)
    return out


def _words_of(texts: DataFrame) -> DataFrame:
    """t, w, n: the words of more than two letters, and how often each occurs."""
    return texts.select("t", F.explode(F.filter(F.split("t", " "), lambda w: F.length(w) > 2)).alias("w")).groupBy("t", "w").agg(F.count("*").alias("n"))


def text_pairs(left: DataFrame, right: DataFrame, whole: int, equal: int, within: int) -> DataFrame:
    """left, right: distinct non-empty texts t -> a, b, points of each pair that has any.

    whole: for texts that hold each other; equal, within: for each pair of words that are equal, or of which one holds the other.
    """
    both = held(left, right).select(F.col("i").alias("a"), F.col("o").alias("b")).unionByName(held(right, left).select(F.col("o").alias("a"), F.col("i").alias("b"))).distinct()
    parts = [both.withColumn("points", F.lit(whole))]
    lw, rw = checkpoint(_words_of(left)), checkpoint(_words_of(right))
    words = lambda w: w.select(F.col("w").alias("t")).distinct()
    if within:
        near = held(words(lw), words(rw)).select(F.col("i").alias("w"), F.col("o").alias("v")).unionByName(held(words(rw), words(lw)).select(F.col("o").alias("w"), F.col("i").alias("v"))).distinct()
    else:
        near = words(lw).join(words(rw), "t").select(F.col("t").alias("w"), F.col("t").alias("v"))
    worth = near.withColumn("p", F.when(F.col("w") == F.col("v"), equal).otherwise(within))
    met = lw.withColumnsRenamed({"t": "a", "n": "n1"}).join(worth, "w").drop("w").join(rw.withColumnsRenamed({"t": "b", "w": "v", "n": "n2"}), "v")
    parts.append(met.groupBy("a", "b").agg(F.sum(F.col("n1") * F.col("n2") * F.col("p")).alias("points")))
    return checkpoint(parts[0].unionByName(parts[1]).groupBy("a", "b").agg(F.sum("points").cast("long").alias("points")))


def best_facilities(companies: DataFrame, facilities: DataFrame, least: int = 25) -> DataFrame:
    """id, fid and score of the best facility of each company in a matching state, if it has `least` points; ties take the least fid.

    companies: id, company, site, state; facilities: fid, facility, city, state; names normalised, not null. Equal rows are
    one: companies of the same name, site and state share a result, and of such facilities the least fid counts. An empty
    text is held by every other; an empty state matches every state.
    """
    own = ["company", "site", "state"]
    state = F.upper(F.coalesce("state", F.lit(""))).alias("state")
    companies = companies.select("id", "company", "site", state)
    mine = checkpoint(companies.select(*own).distinct())
    each = checkpoint(facilities.select("fid", "facility", "city", state).groupBy("facility", "city", "state").agg(F.min("fid").alias("fid")))
    plain = lambda df, c: df.select(F.col(c).alias("t")).where("t <> ''").distinct()
    names = text_pairs(plain(mine, "company"), plain(each, "facility"), 50, 10, 5)
    places = text_pairs(plain(mine, "site"), plain(each, "city"), 30, 15, 0)
    states = small(checkpoint(match.state_pairs(mine.select("state"), each.select("state"))))
    meet = lambda df: df.join(states, "state").drop("state").withColumnsRenamed({"other": "state"})
    found = []
    pair_of = ["company", "site", "_state", "facility", "city", "fid"]
    there = each.select("facility", "city", "state", "fid")
    asked = mine.withColumn("_state", F.col("state"))
    pair = lambda df, a, b: df.select(F.col("a").alias(a), F.col("b").alias(b))
    # pairs of places with points, with all facilities there
    found.append(meet(asked.join(pair(places, "site", "city"), "site")).join(there, ["city", "state"]).select(*pair_of))
    # pairs of names that are enough alone: the least fid of a name; with points for its place it is above
    named = there.groupBy("facility", "state").agg(F.min_by(F.struct("city", "fid"), "fid").alias("s")).select("facility", "state", "s.city", "s.fid")
    found.append(meet(asked.join(pair(names.where(F.col("points") >= least), "company", "facility"), "company")).join(named, ["facility", "state"]).select(*pair_of))
    # an empty text is held by all: the least fid of a state stands for all that have no other points
    one = lambda df: df.groupBy("state").agg(F.min_by(F.struct("facility", "city", "fid"), "fid").alias("s")).select("state", "s.*")
    nameless, placeless = there.where("facility = ''"), there.where("city = ''")
    found.append(meet(asked.where("company = '' or site = ''")).join(one(there), "state").select(*pair_of))
    found.append(meet(asked.where("company = ''")).join(one(placeless), "state").select(*pair_of))
    for some in (nameless, placeless, nameless.where("city = ''")):
        found.append(meet(asked).join(one(some), "state").select(*pair_of))
    # and those that have, by their names; pairs of places are all made above
    by_names = asked.join(pair(names, "company", "facility"), "company")
    found.append(meet(by_names.where("site = ''")).join(there, ["facility", "state"]).select(*pair_of))
    found.append(meet(by_names).join(placeless, ["facility", "state"]).select(*pair_of))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # both kinds of points of each pair that may be the best
    worth = lambda df, a, b, n: df.select(F.col("a").alias(a), F.col("b").alias(b), F.col("points").alias(n))
    every = every.join(worth(names, "company", "facility", "_n"), ["company", "facility"], "left").join(worth(places, "site", "city", "_p"), ["site", "city"], "left")
    by_name = F.when((F.col("company") == "") | (F.col("facility") == ""), 50).otherwise(F.coalesce("_n", F.lit(0)))
    by_place = F.when((F.col("site") == "") | (F.col("city") == ""), 30).otherwise(F.coalesce("_p", F.lit(0)))
    every = every.select(F.struct("company", "site", F.col("_state").alias("state")).alias("own"), "fid", (by_name + by_place).cast("long").alias("score"))
    best = every.groupBy("own").agg(F.min_by("fid", F.struct(-F.col("score"), "fid")).alias("fid"), F.max("score").alias("score"))
    best = best.where(F.col("score") >= least).select("own.*", "fid", "score")
    return companies.join(best, own).select("id", "fid", "score")
