"""Weighted statistics, votes and classification measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import settle

from .ranks import running


def weighted_mode(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """The value with the most weight; ties: the smaller value."""
    per = rows.groupBy(by, value).agg(F.round(F.sum(weight), 6).alias("weight"))
    return per.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), value))).filter("n = 1").drop("n")


def weighted_median(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """The first value, in order, at which the weight so far reaches half."""
    per = rows.groupBy(by, value).agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("so_far", F.round(F.sum("w").over(run), 6)).withColumn("half", F.round(F.sum("w").over(Window.partitionBy(by)) / 2, 6))
    return per.filter("so_far >= half").groupBy(by).agg(F.min(value).alias("median"))


def exact_total(value: Column, mean: bool = False) -> Column:
    """Aggregate: sum or mean of doubles, worked out in decimals (12 places), so that it is the same whatever the order and
    the partitions; groups with a value of 18 digits or more before the point, infinite or no number are summed as doubles."""
    x = value.try_cast("decimal(30,12)")
    total = F.when(F.count(value) == F.count(x), F.try_sum(x).cast("double"))
    total = F.coalesce(total, F.sum(value.cast("double")))
    return F.try_divide(total, F.count(value)) if mean else total


def histogram(rows: DataFrame, by: str, bin_: Column, weight: str) -> DataFrame:
    return rows.groupBy(by, bin_.alias("bin")).agg(F.round(F.sum(weight), 6).alias("weight"))


def entropy(rows: DataFrame, by: str, symbol: str) -> DataFrame:
    """Shannon entropy in bits of the symbols of each group."""
    per = rows.groupBy(by, symbol).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return per.withColumn("p", p).groupBy(by).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.sum("n").alias("n"))


def steps(rows: DataFrame, by: str, order: list[str], value: str, clip: int) -> DataFrame:
    """Differences of successive values, clipped."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("step", F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(-clip)), F.lit(clip)))).filter("step is not null")


def profile_match(hist: DataFrame, by: str, profiles: list[tuple[str, list[float]]]) -> DataFrame:
    """The rotated profile that correlates best with each group's histogram (columns by, bin, weight).

    profiles: name and one value a bin; each is tried at all rotations. Ties: the smaller shift, then the name's place.
    """
    size = len(profiles[0][1])
    filled = hist.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "weight"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    spark = hist.sparkSession
    shapes = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("profile"), F.lit(s).alias("shift"), F.array(*[F.lit(float(v[(i - s) % size])) for i in range(size)]).alias("y")) for k, (n, v) in enumerate(profiles) for s in range(size)]))
    table = F.broadcast(spark.range(1).select(shapes.alias("p")).select("p.*"))  # profiles x rotations, fixed
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / size
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    r = filled.select(by, x.alias("x")).crossJoin(table)
    r = r.withColumn("xc", F.transform("x", lambda v: v - mean(F.col("x")))).withColumn("yc", F.transform("y", lambda v: v - mean(F.col("y"))))
    r = r.withColumn("r", F.round(F.try_divide(dot(F.col("xc"), F.col("yc")), F.sqrt(dot(F.col("xc"), F.col("xc")) * dot(F.col("yc"), F.col("yc")))), 6))
    best = Window.partitionBy(by).orderBy(F.col("r").desc_nulls_last(), "shift", "place")
    return r.withColumn("n", F.row_number().over(best)).filter("n = 1").select(by, "profile", "shift", "r")


def auc(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """n_pos, n_neg and ROC AUC, tied scores at their average rank."""
    per = rows.filter(F.col(score).isNotNull() & positive.isNotNull()).groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    per = running(per, [F.asc(score)], {"under": F.col("n")}).withColumn("under", F.col("under") - F.col("n"))
    return per.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.round(F.try_divide(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)), F.sum("p") * F.sum("n")), 9).alias("auc"))


def tpr_at_fpr(rows: DataFrame, positive: Column, score: str, rates: list[float]) -> DataFrame:
    """fpr, threshold (the (floor(fpr x n) + 1)-th largest negative score) and the share of positives strictly above it."""
    neg, pos = rows.filter(~positive).select(score), rows.filter(positive).select(F.col(score).alias("s"))
    per = ranked_values(neg, score)
    n = neg.agg(F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.array(*[F.lit(float(r)) for r in rates]))
    k = F.floor(F.col("fpr") * F.col("n")) + 1
    cut = per.crossJoin(F.broadcast(n)).select("*", wanted.alias("fpr")).filter((F.col("last") >= k) & (F.col("last") - F.col("here") < k)).select("fpr", F.col(score).alias("threshold"))
    return pos.crossJoin(F.broadcast(cut)).groupBy("fpr", "threshold").agg(F.round(F.avg((F.col("s") > F.col("threshold")).cast("int")), 9).alias("tpr"))


def ranked_values(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values, how many rows have each (here), and the last place of these in descending order."""
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("here"))
    return running(per, [F.desc(value)], {"last": F.col("here")})


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def exponential_tail(scores: DataFrame, score: str, fpr: float, least_above: int = 10) -> DataFrame:
    """threshold: the (floor(fpr x n) + 1)-th largest if at least least_above lie above it, else an exponential tail fitted over the 99th percentile."""
    per = settle(ranked_values(scores.filter(F.col(score).isNotNull()).select(score), score))
    total = per.agg(F.sum("here")).first()[0] or 0

    def place(k: float) -> Column:
        return (F.col("last") >= k) & (F.col("last") - F.col("here") < k)

    # the 99th percentile lies between two places of the ascending order
    at = 0.99 * (total - 1)
    low, high = total - int(at), total - min(int(at) + 1, max(total - 1, 0))
    u = (F.max(F.when(place(low), F.col(score))) * (1 - at % 1) + F.max(F.when(place(high), F.col(score))) * (at % 1)).alias("u")
    n = per.agg(F.sum("here").alias("n"), u, F.max(F.when(place(int(fpr * total) + 1), F.col(score))).alias("direct"))
    above = per.crossJoin(F.broadcast(n.select("u"))).filter(F.col(score) > F.col("u"))
    agg = n.crossJoin(F.broadcast(above.agg(F.try_divide(F.sum((F.col(score) - F.col("u")) * F.col("here")), F.sum("here")).alias("excess"))))
    tail = F.col("u") + F.log(F.lit(0.01 / fpr)) * F.coalesce("excess", F.lit(0.0))
    return agg.select("n", F.round(F.when(F.floor(fpr * F.col("n")) >= least_above, F.col("direct")).otherwise(tail), 6).alias("threshold"))
