"""Searching lines for stretches: runs between matched notes, refined offsets, loops of bars, agreement, similarity over chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import let


def best_runs(matches: DataFrame, by: list[str], order: str, hit: str, miss_cost: float, bonus: float, base: float) -> DataFrame:
    """by, first, last, weight: of all runs of a group's notes the one that is worth most, (hits - miss_cost x misses) x
    (1 + bonus x (hits - 1)) - base; ties: the earlier, then the shorter. matches: by, order, hit (0 or 1).

    Runs begin and end at hits. A run's hits and misses are differences of prefix sums, so a pair of ends is one row.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m = matches.withColumn("_n", F.row_number().over(w)).withColumn("_hits", F.sum(hit).over(upto)).filter(F.col(hit) == 1)
    x = m.select(*by, F.col(order).alias("first"), F.col("_n").alias("n0"), F.col("_hits").alias("h0"))
    y = m.select(*by, F.col(order).alias("last"), F.col("_n").alias("n1"), F.col("_hits").alias("h1"))
    j = x.join(y, by).filter("n1 >= n0")
    hits = F.col("h1") - F.col("h0") + 1
    misses = F.col("n1") - F.col("n0") + 1 - hits
    worth = F.round((hits - miss_cost * misses) * (1 + bonus * (hits - 1)) - base, 6)
    best = Window.partitionBy(*by).orderBy(F.desc("weight"), "n0", "n1")
    return j.withColumn("weight", worth).withColumn("_k", F.row_number().over(best)).filter("_k = 1").select(*by, "first", "last", "weight")


def refined(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, offset (the median of b - a), n and the mean distance from it."""
    m = pairs.groupBy(*by).agg(F.percentile(F.col(b) - F.col(a), 0.5).alias("offset"), F.count(F.lit(1)).alias("n"))
    far = pairs.join(m, by).groupBy(*by).agg(F.round(F.avg(F.abs(F.col(b) - F.col(a) - F.col("offset"))), 6).alias("spread"))
    return m.join(far, by).select(*by, F.round("offset", 6).alias("offset"), "n", "spread")


def looped(start: Column, length: Column, total: Column, period: Column) -> Column:
    """Bars of a stretch from `start`; past the end it jumps back by the period as often as it must."""
    bar = lambda i: F.when(start + i < total, start + i).otherwise(total - period + F.pmod(start + i - total, period))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), bar)).otherwise(F.array().cast("array<int>"))


def agreement(x: Column, y: Column) -> Column:
    """Of two lines of chords (arrays of tones, in step): 1 for equal chords, half for a common tone, else 0; the mean, null
    where there is nothing to compare."""
    one = lambda a, b: F.when(F.array_sort(a) == F.array_sort(b), 1.0).when(F.arrays_overlap(a, b), 0.5).otherwise(0.0)
    pairs = F.filter(F.arrays_zip(x.alias("a"), y.alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNotNull() & (F.size(z["a"]) > 0) & (F.size(z["b"]) > 0))
    return let(F.transform(pairs, lambda z: one(z["a"], z["b"])), lambda s: F.when(F.size(s) > 0, F.round(F.aggregate(s, F.lit(0.0), lambda t, v: t + v) / F.size(s), 6)))


def over_chance(pairs: DataFrame, chance: DataFrame, score: str) -> DataFrame:
    """pairs with `percentile`: the share of chance scores below each. chance: a sample of a stated size."""
    held = F.broadcast(chance.agg(F.array_sort(F.collect_list(score)).alias("_c")))  # one row, of the sample's size
    below = F.size(F.filter("_c", lambda c: c < F.col(score)))
    return pairs.crossJoin(held).withColumn("percentile", F.round(F.try_divide(below, F.size("_c")), 6)).drop("_c")


def hulls(hits: DataFrame, by: list[str], a: str, b: str, size: int) -> DataFrame:
    """by, and the stretches of both sides that the common runs of `size` places span."""
    end = lambda c: (F.max(c) + size)
    return hits.groupBy(*by).agg(F.min(a).alias("a_start"), end(a).alias("a_end"), F.min(b).alias("b_start"), end(b).alias("b_end"), F.count_distinct(b).alias("n"))
