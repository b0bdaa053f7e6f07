"""Connected components of an edge table, by alternating large-star and small-star steps; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle

SHARES = 8


#: A node with more edges than its share of them, and than this, is joined apart.
CROWDED = 100_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u. A node with a large share of all edges would fill one task: there are at most
    SHARES x partitions of these, so they are broadcast and their edges stay where they are."""
    at_most = least.agg(F.max("n"), F.sum("n")).first()
    share = max(CROWDED, (at_most[1] or 0) // (SHARES * partitions(edges.sparkSession)))
    if (at_most[0] or 0) <= share:
        return edges.join(least.select("u", "m"), "u")
    crowded = F.broadcast(least.filter(F.col("n") > share).select("u", "m"))
    return edges.join(crowded, "u").unionByName(edges.join(crowded, "u", "left_anti").join(least.select("u", "m"), "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for each node with an edge. Loops, repeats and nulls are ignored."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = settle(e.distinct())
    while True:
        # settled: every node hangs below one node, which hangs below none
        odd = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        if odd.isEmpty() and e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = settle(_with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        hung = _with_least(large, least).filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = settle(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
