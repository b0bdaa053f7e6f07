"""Families, credit edges and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import settle


def families(members: DataFrame, n_items: int, least: int = 2) -> DataFrame:
    """family, size and specificity log2(N / size) of families with at least `least` members. members: family, item."""
    per = members.groupBy("family").agg(F.count_distinct("item").alias("size")).filter(F.col("size") >= least)
    return per.withColumn("specificity", F.round(F.log2(F.lit(float(n_items)) / F.col("size")), 6))


def family_scores(members: DataFrame, fams: DataFrame) -> DataFrame:
    """a, b, n_families, score: specificity x root of the smaller strength, over the families of an earlier a and a later b.

    members: family, item, time, strength; pairs with equal times are left out.
    """
    m = members.join(fams.select("family", "specificity"), "family")
    a, b = m.select("family", F.col("item").alias("a"), F.col("time").alias("ta"), F.col("strength").alias("sa"), "specificity"), m.select("family", F.col("item").alias("b"), F.col("time").alias("tb"), F.col("strength").alias("sb"))
    pairs = a.join(b, "family").filter("ta < tb")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_families"), F.round(F.sum(F.col("specificity") * F.sqrt(F.least("sa", "sb"))), 6).alias("score"))


def credits(pairs: DataFrame) -> DataFrame:
    """ref_count of each a: how many b it is the best source of (ties: the smaller a)."""
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("score"), "a"))).filter("n = 1")
    return best.groupBy("a").agg(F.count(F.lit(1)).alias("ref_count"))


def parents(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """a, b, score, ref_count: of the sources that score at least share of b's best, the most credited (then score, then the smaller a)."""
    close = pairs.withColumn("top", F.max("score").over(Window.partitionBy("b"))).filter(F.col("score") >= share * F.col("top"))
    close = close.join(credits(pairs), "a", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0)))
    w = Window.partitionBy("b").orderBy(F.desc("ref_count"), F.desc("score"), "a")
    return close.withColumn("n", F.row_number().over(w)).filter("n = 1").select("a", "b", "score", "ref_count")


def secondary(pairs: DataFrame, tree: DataFrame, k: int = 8) -> DataFrame:
    """The k best other sources of each b."""
    rest = pairs.join(tree.select("a", "b"), ["a", "b"], "left_anti")
    w = Window.partitionBy("b").orderBy(F.desc("score"), "a")
    return rest.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("a", "b", "score", "nth")


def ancestry(nodes: DataFrame, tree: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root, depth. tree: a (parent), b (child). Pointer doubling: a chain of length n takes log2 n joins."""
    up = nodes.select("node").join(tree.select(F.col("b").alias("node"), F.col("a").alias("up")), "node", "left")
    up = up.withColumn("depth", F.col("up").isNotNull().cast("int")).withColumn("root", F.coalesce("up", "node")).select("node", "root", "depth")
    for _ in range(rounds):
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = settle(up.join(step, "root").select("node", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        up = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            return up
    raise ValueError("the parent edges have a cycle")


def descendants(nodes: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """node and its number of descendants; chains up to depth edges long."""
    reach = tree.select("a", "b")
    level = reach
    for _ in range(depth - 1):
        level = level.select("a", F.col("b").alias("m")).join(tree.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        reach = reach.unionByName(level)
    per = reach.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("descendants"))
    return nodes.select("node").join(per, "node", "left").withColumn("descendants", F.coalesce("descendants", F.lit(0)))


def katz(nodes: DataFrame, edges: DataFrame, alpha: float = 0.2, places: int = 6, rounds: int = 10_000) -> DataFrame:
    """k(a) = sum over edges a -> b of (1 + alpha k(b)), to the fixpoint: as many rounds as the longest chain has edges."""
    n = nodes.select("node")
    walk = settle(edges.groupBy(F.col("a").alias("node")).agg(F.sum(F.lit(1.0)).alias("k")))
    for _ in range(rounds):
        # with the value before beside it; a sum in another order may differ in the last places
        nxt = edges.join(walk.withColumnRenamed("node", "b"), "b", "left").groupBy(F.col("a").alias("node")).agg(F.sum(1 + alpha * F.coalesce("k", F.lit(0.0))).alias("k"))
        nxt = settle(nxt.join(walk.withColumnRenamed("k", "was"), "node"))
        walk = nxt.drop("was")
        if nxt.filter(F.abs(F.col("k") - F.col("was")) > 1e-9 * F.col("k")).isEmpty():
            break
    else:
        raise ValueError("no fixpoint: the edges have a cycle")
    return n.join(walk, "node", "left").select("node", F.round(F.coalesce("k", F.lit(0.0)), places).alias("katz"))


def paths(edges: DataFrame, least: int, most: int, generic: int = 1) -> DataFrame:
    """path (nodes in order), n, score (sum) and n_generic of all chains of least..most nodes with at most `generic` generic edges. edges: a, b, score, generic."""
    step = edges.select(F.col("a").alias("end"), F.col("b").alias("next"), F.col("score").alias("s"), F.col("generic").cast("int").alias("g"))
    level = edges.select(F.array("a", "b").alias("path"), F.col("score"), F.col("generic").cast("int").alias("n_generic")).filter(F.col("n_generic") <= generic)
    out = None
    for n in range(2, most + 1):
        if n >= least:
            out = level if out is None else out.unionByName(level)
        if n < most:
            level = level.withColumn("end", F.element_at("path", -1)).join(step, "end").filter(~F.array_contains("path", F.col("next")) & (F.col("n_generic") + F.col("g") <= generic))
            level = level.select(F.concat("path", F.array("next")).alias("path"), (F.col("score") + F.col("s")).alias("score"), (F.col("n_generic") + F.col("g")).alias("n_generic"))
    return out.select("path", F.size("path").alias("n"), F.round("score", 6).alias("score"), "n_generic")
