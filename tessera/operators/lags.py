"""Lines against themselves and their neighbours: loop periods, diagonals, medians, phases, prefix sums, chord sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import let


def loop_period(tokens: Column, candidates: tuple[int, ...] = (2, 4, 6, 8, 12, 16), phrase: int = 8) -> Column:
    """How far to jump back when a line runs out: the lag at which it repeats best, multiples of 4 and of the phrase preferred;
    its length if no lag fits (1 at least)."""

    def of(t: Column) -> Column:
        n = F.size(t)

        def score(lag: int) -> Column:
            same = F.size(F.filter(F.sequence(F.lit(0), n - 1 - lag), lambda i: F.get(t, i) == F.get(t, i + lag))) / (n - lag)
            bonus = 0.04 * (lag % 4 == 0) + 0.08 * (lag % phrase == 0) + 0.002 * lag
            return F.when(n - 1 >= lag, F.struct(F.round(same + bonus, 9).alias("score"), F.lit(-lag).alias("back"), F.lit(lag).alias("lag")))

        best = F.array_max(F.array_compact(F.array(*map(score, candidates))))
        return F.coalesce(best["lag"], F.greatest(n, F.lit(1)))

    return let(tokens, of)


def diagonal_best(rows: DataFrame, by: str, at: str, value: str, offsets: tuple[int, ...], width: int) -> DataFrame:
    """by, at, offset, agreement: over the offsets, the largest share of `width` following places where the line equals itself
    moved by the offset (a moving mean on each diagonal; ties: the smaller offset). Windows that run out are left out."""
    w = Window.partitionBy(by).orderBy(at)
    out = None
    for off in offsets:
        same = (F.col(value) == F.lead(value, off).over(w)).cast("int")
        one = rows.select(by, at, same.alias("same"))
        ahead = w.rowsBetween(0, width - 1)
        one = one.select(by, at, F.avg("same").over(ahead).alias("agreement"), F.count("same").over(ahead).alias("n")).filter(F.col("n") == width).select(by, at, F.lit(off).alias("offset"), F.round("agreement", 6).alias("agreement"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(by, at).agg(F.max_by("offset", F.struct("agreement", -F.col("offset"))).alias("offset"), F.max("agreement").alias("agreement"))


def median_filter(rows: DataFrame, by: str, order: list[str], value: str, reach: int) -> DataFrame:
    """rows with `smooth`: the median of the values up to `reach` places away."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-reach, reach)
    near = F.array_sort(F.collect_list(value).over(w))
    middle = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    return rows.withColumn("smooth", F.round(let(near, middle), 6))


def change_phase(rows: DataFrame, by: str, at: str, value: str, period: int) -> DataFrame:
    """by, phase, n: the place modulo the period at which the value changes most often (ties: the lower place)."""
    new = rows.withColumn("_was", F.lag(value).over(Window.partitionBy(by).orderBy(at))).filter(F.col("_was").isNotNull() & (F.col("_was") != F.col(value)))
    per = new.groupBy(by, F.pmod(F.col(at), F.lit(period)).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(F.max_by("phase", F.struct("n", -F.col("phase"))).alias("phase"), F.max("n").alias("n"))


def range_sums(spans: DataFrame, points: DataFrame, by: str, at: str, weight: str) -> DataFrame:
    """spans (by, start, end) with `total`: the weight of the points in [start, end), as the difference of two prefix sums.

    One sort of points and bounds together.
    """
    run = Window.partitionBy(by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    bounds = spans.withColumn("_b", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("end").alias("t"), F.lit(1).alias("sign")))))
    bounds = bounds.select(*spans.columns, F.col("_b.t").cast("double").alias("_t"), F.col("_b.sign").alias("_sign"), F.lit(0).alias("_kind"), F.lit(0.0).alias("_w"))
    rows = bounds.unionByName(points.select(by, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.col(weight).cast("double").alias("_w")), allowMissingColumns=True)
    summed = rows.withColumn("_sum", F.sum("_w").over(run)).filter("_kind = 0")
    return summed.groupBy(*spans.columns).agg(F.round(F.sum(F.col("_sign") * F.col("_sum")), 6).alias("total"))


def chord_changes(chords: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, n (from 1), token, start, end: rests (token below 0) dropped and equal neighbours as one, across rests too."""
    c = chords.filter("token >= 0 and end > start")
    w = Window.partitionBy(by).orderBy("start", *order)
    new = F.when(F.lag("token").over(w).eqNullSafe(F.col("token")), 0).otherwise(1)
    c = c.withColumn("_new", new).withColumn("n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(by, "n").agg(F.min("token").alias("token"), F.min("start").alias("start"), F.max("end").alias("end"))


def key_free(changes: DataFrame, by: str, modulus: int = 12) -> DataFrame:
    """by, n, step: from each change to the next, modulo."""
    w = Window.partitionBy(by).orderBy("n")
    return changes.select(by, "n", F.pmod(F.lead("token").over(w) - F.col("token"), F.lit(modulus)).alias("step")).filter("step is not null")


def per_beat(chords: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, beat, token: what covers most of each beat that any chord touches (ties: the chord that comes first there)."""
    c = chords.filter("end > start").withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy("start", *order)))
    c = c.withColumn("beat", F.explode(F.sequence(F.floor("start"), F.ceil("end") - 1)))
    part = F.least("end", F.col("beat") + 1) - F.greatest("start", "beat")
    per = c.groupBy(by, "beat", "token").agg(F.round(F.sum(part), 6).alias("w"), F.min("_place").alias("first"))
    return per.groupBy(by, "beat").agg(F.max_by("token", F.struct("w", -F.col("first"))).alias("token"))


def without_graces(notes: DataFrame, by: str, onset: str, pitch: str, length: str, shortest: float, reach: int) -> DataFrame:
    """notes without those shorter than `shortest` whose next onset is that near and at most `reach` steps away."""
    w = Window.partitionBy(by).orderBy(onset, pitch)
    near = (F.lead(onset).over(w) - F.col(onset) <= shortest) & (F.abs(F.lead(pitch).over(w) - F.col(pitch)) <= reach)
    return notes.withColumn("_grace", F.coalesce((F.col(length) < shortest) & near, F.lit(False))).filter("not _grace").drop("_grace")


def slot_winners(notes: DataFrame, by: str, onset: str, pitch: str, highest: bool = True, grid: int = 12) -> DataFrame:
    """by, slot, pitch, length: the highest (lowest) note of each slot of a beat's grid, up to the next slot in use."""
    slot = F.floor(F.col(onset) * grid + 0.5)
    top = notes.groupBy(by, slot.alias("slot")).agg((F.max if highest else F.min)(pitch).alias(pitch))
    return top.withColumn("length", F.lead("slot").over(Window.partitionBy(by).orderBy("slot")) - F.col("slot"))
