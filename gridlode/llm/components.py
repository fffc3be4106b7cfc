"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_counted, stored


def _star(edges: DataFrame) -> DataFrame:
    """edges: u, v -> for each u its least neighbour or itself as m, joined to its edges. Hubs are joined by broadcast."""
    least = checkpoint(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
    return join_counted(edges, least, ["u"]).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs) -> node, root: the least node of its component, for every node with an edge to another."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = checkpoint(edges), None
    while True:
        both = checkpoint(edges.select("u", "v").union(edges.select("v", "u")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpoint(large)
        joined = _star(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
