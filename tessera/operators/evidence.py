"""Rare-n-gram evidence: how surprising is the material that two documents share, against an analytic null model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import settle

from .ranks import running

#: The largest document frequency that still counts, and the prior variance added to every score's.
DF_CAP, PRIOR_VARIANCE = 8, 4.0
#: The most (source, key) rows whose keys are sent to all tasks.
FEW = 1_000_000


def weight(d: Column, n: Column, cap: int = DF_CAP) -> Column:
    """log2((N + 1) / (d + 1/2)), 0 beyond the cap."""
    return F.when(d > cap, 0.0).otherwise(F.log2((n + 1) / (d + 0.5)))


def chance(d: Column, n: Column) -> Column:
    """Probability that another document holds a key of frequency d: (d - 2) / (N - 2) within 0..1."""
    return F.when(n <= 2, 0.0).otherwise(F.least(F.greatest((d - 2) / (n - 2), F.lit(0.0)), F.lit(1.0)))


def document_frequency(keys: DataFrame, doc: str = "doc", key: str = "key") -> DataFrame:
    """key, df. keys: distinct (doc, key)."""
    return keys.groupBy(key).agg(F.count(F.lit(1)).alias("df"))


def pair_evidence(targets: DataFrame, sizes: DataFrame, sources: DataFrame, n_docs: int, cap: int = DF_CAP, places: int = 6) -> DataFrame:
    """a, b, shared, s, mu, sigma, z of each target a and source document b that share a rare key.

    targets: (a, key), sizes: a, size (its distinct keys); sources: distinct (b, key). A key's frequency counts targets and sources, left out the
    two at hand and put back as two: d = max(df - [a has it] - [b has it], 0) + 2. S is the weight of the shared keys;
    mu and sigma^2 sum w p and w^2 p (1 - p) over b's keys; z = (S - r mu) / sqrt(r sigma^2 + 4) with r = |a| / mean |a|.

    Base and corrections: with only b counted out, b's sums are the same for all targets; a key that the target holds
    too changes its term, so a pair needs its shared keys only, and keys above the cap for either outcome, whose weight
    is 0, never enter the join. Targets lose all keys that no source has before they are shuffled, as long as the sources
    have FEW keys, which are then sent to all tasks; beyond that the two sides are joined by a shuffle.
    """
    wanted = sources.select("key").distinct()
    if not sources.limit(FEW).count() < FEW:
        targets = targets.join(wanted, "key", "left_semi").distinct()
    else:
        targets = targets.join(F.broadcast(wanted), "key", "left_semi").distinct()
    targets = settle(targets)  # frequencies and pairs both need them
    both = targets.select("key").unionByName(sources.select("key"))
    df = both.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= cap)
    n = F.lit(float(n_docs))

    def terms(d: Column) -> tuple[Column, Column, Column]:
        w, p = weight(d, n, cap), chance(d, n)
        return w, w * p, w * w * p * (1 - p)

    alone = terms(F.greatest(F.col("df") - 1, F.lit(0)) + 2)
    shared = terms(F.greatest(F.col("df") - 2, F.lit(0)) + 2)
    held = sources.join(df, "key").select("b", "key", *[t.alias(x) for t, x in zip((*alone, *shared), ("w1", "m1", "v1", "w2", "m2", "v2"), strict=True)])
    base = held.groupBy("b").agg(F.sum("m1").alias("mu0"), F.sum("v1").alias("var0"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    pairs = targets.join(held, "key").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum("w2").alias("s"), F.sum(F.col("m2") - F.col("m1")).alias("dm"), F.sum(F.col("v2") - F.col("v1")).alias("dv"))
    pairs = pairs.join(base, "b").join(sizes, "a").crossJoin(F.broadcast(mean))  # mean: one row
    r = F.col("size") / F.col("mean")
    mu, var = r * (F.col("mu0") + F.col("dm")), r * (F.col("var0") + F.col("dv"))
    z = (F.col("s") - mu) / F.sqrt(var + PRIOR_VARIANCE)
    return pairs.select("a", "b", "shared", *[F.round(x, places).alias(k) for k, x in (("s", F.col("s")), ("mu", mu), ("sigma", F.sqrt(F.greatest(var, F.lit(0.0)))), ("z", z))])


def stouffer(channels: list[tuple[Column, float]], places: int = 6) -> Column:
    """Sum of weight x z over the root of the squared weights, of the channels that are there."""
    top = sum((F.coalesce(z * w, F.lit(0.0)) for z, w in channels), F.lit(0.0))
    below = sum((F.when(z.isNotNull(), F.lit(w * w)).otherwise(0.0) for z, w in channels), F.lit(0.0))
    return F.round(F.try_divide(top, F.sqrt(below)), places)


def best_window(scored: DataFrame, pair: list[str], order: list[Column]) -> DataFrame:
    """The row of each pair that comes first in a total order."""
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy(*order))).filter("_n = 1").drop("_n")


def hubness(pairs: DataFrame, a: str, b: str, z: str, places: int = 6) -> DataFrame:
    """pairs with each score's distance from its a's mean and its b's mean, in population deviations (null if there is none)."""
    out = pairs
    for side in (a, b):
        stats = pairs.groupBy(side).agg(F.avg(z).alias("_mean"), F.stddev_pop(z).alias("_sd"))
        out = out.join(stats, side).withColumn(f"hub_{side}", F.round((F.col(z) - F.col("_mean")) / F.when(F.col("_sd") > 1e-9, F.col("_sd")), places)).drop("_mean", "_sd")
    return out


def tail_probability(scores: DataFrame, sample: DataFrame, z: str, places: int = 6) -> DataFrame:
    """scores with q: the share of the sample at or above z. One sort of both; the running count stands for a search."""
    n = sample.count()
    both = scores.withColumn("_kind", F.lit(0)).unionByName(sample.select(z).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    per = both.groupBy(z).agg(F.sum("_kind").alias("_here"))
    per = running(per, [F.desc(z)], {"_above": F.col("_here")})
    return scores.join(per.select(z, "_above"), z).withColumn("q", F.round(F.col("_above") / F.lit(float(max(n, 1))), places)).drop("_above")


def similarity(s: Column, half: float) -> Column:
    return F.round(1 - F.pow(F.lit(2.0), -s / half), 6)
