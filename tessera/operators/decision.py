"""Deciding on scored windows: thresholds a channel, windows that one channel carries alone, known pairs, tuned rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_max(scores: DataFrame, by: list[str], channel: str, z: str) -> DataFrame:
    """by, channel and the best z over all windows."""
    return scores.groupBy(*by, channel).agg(F.max(z).alias(z))


def channel_thresholds(scores: DataFrame, channel: str, z: str, share: float = 0.99, least: float = 3.0) -> DataFrame:
    """channel, threshold: the quantile of each channel's scores, but `least` at least."""
    return scores.groupBy(channel).agg(F.round(F.greatest(F.percentile(z, share), F.lit(least)), 6).alias("threshold"))


def best_window(windows: DataFrame, by: list[str], fused: str, threshold: Column, alone: Column, order: list[str]) -> DataFrame:
    """The best window of each pair over the threshold that no single channel carries alone; `rescued` if a better one was
    left out for that. Pairs without such a window have no row."""
    w = Window.partitionBy(*by).orderBy(F.desc(fused), *order)
    over = windows.filter(F.col(fused) > threshold).withColumn("_place", F.row_number().over(w)).filter(~alone)
    first = Window.partitionBy(*by).orderBy("_place")
    return over.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("rescued", F.col("_place") > 1).drop("_n", "_place")


def known_pairs(known: DataFrame, scored: DataFrame, z: str, threshold: float) -> DataFrame:
    """a, b, z, found (over the threshold) and rank (b's place among the sources of a; null if unscored) of known pairs."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(z), "b"))
    return known.select("a", "b").join(scored.select("a", "b", z, place.alias("rank")), ["a", "b"], "left").select("a", "b", z, F.coalesce(F.col(z) > threshold, F.lit(False)).alias("found"), "rank")


def operating_curve(scores: DataFrame, z: str, truth: Column, cuts: list[float]) -> DataFrame:
    """cut, n (rows above it), n_true, share of the true rows that are above it."""
    at = F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut")
    rows = scores.select(z, truth.alias("_t")).groupBy(z, "_t").agg(F.count(F.lit(1)).alias("_n")).select("*", at)  # cuts: a short list
    above = F.col(z) > F.col("cut")
    count = lambda w: F.sum(F.when(w, F.col("_n")).otherwise(0))
    return rows.groupBy("cut").agg(count(above).alias("n"), count(above & F.col("_t")).alias("n_true"), F.round(F.try_divide(count(above & F.col("_t")), count(F.col("_t"))), 6).alias("share"))


def tuned(rows: DataFrame, truth: str, train: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, accuracy on training rows and on the others, and whether it is the one that training rows choose (ties: its name)."""
    tried = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), r.cast("int").alias("guess")) for n, r in rules.items()])).alias("r")
    right = (F.col("r.guess") == F.col(truth)).cast("int")
    per = rows.select(F.col(truth), train.alias("_train"), tried).groupBy(F.col("r.rule").alias("rule")).agg(F.round(F.avg(F.when(F.col("_train"), right)), 6).alias("train"), F.round(F.avg(F.when(~F.col("_train"), right)), 6).alias("held_out"))
    best = F.row_number().over(Window.orderBy(F.desc("train"), "rule"))  # a row a rule
    return per.withColumn("chosen", best == 1)


def ranking_report(ranks: DataFrame, by: str, rank: str) -> DataFrame:
    """by, n, top1, top2 and the mean rank of the true class."""
    return ranks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(rank) <= 1).cast("int")), 3).alias("top1"), F.round(F.avg((F.col(rank) <= 2).cast("int")), 3).alias("top2"), F.round(F.avg(rank), 2).alias("mean_rank"))
