"""Work that is not done twice: results kept by input and version, a ledger of attempts, settings that must agree, and
results that are published only when their checks find nothing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.sinks import replace_table


def fingerprint(params: dict) -> str:
    """Of settings, whatever their order."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def missing(inputs: DataFrame, kept: DataFrame, content: Column, version: str, key: str) -> DataFrame:
    """Inputs, with `sha` of their content, whose result of this version is not kept: new ones, and those whose content changed.

    kept: key, sha, version, and results.
    """
    have = kept.filter(F.col("version") == version).select(key, "sha").distinct()
    return inputs.withColumn("sha", F.sha2(content, 256)).join(have, [key, "sha"], "left_anti")


def with_kept(fresh: DataFrame, kept: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Results of this run with the kept ones of inputs it did not touch; results of inputs that are gone go."""
    old = kept.join(fresh.select(key), key, "left_anti").join(inputs.select(key).distinct(), key, "left_semi")
    return fresh.unionByName(old)


def due(jobs: DataFrame, ledger: DataFrame, key: str, most: int) -> DataFrame:
    """Jobs never done with success, with the number of attempts so far, as long as it is below `most`; fewest first.

    ledger: key, at, done.
    """
    per = ledger.groupBy(key).agg(F.bool_or("done").alias("done"), F.count(F.lit(1)).alias("attempts"), F.max("at").alias("last"))
    j = jobs.join(per, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return j.filter(~F.coalesce("done", F.lit(False)) & (F.col("attempts") < most)).drop("done")


def agreed(rows: DataFrame, settings: list[str], by: str | None = None) -> DataFrame:
    """One row (a group) with each setting that all rows agree on, null where they do not."""
    keys = [by] if by else []
    return rows.groupBy(*keys).agg(*[F.when(F.count_distinct(F.coalesce(F.col(s).cast("string"), F.lit("\x00"))) == 1, F.min(s)).alias(s) for s in settings])


def publish(df: DataFrame, path: str, violations: list[DataFrame]) -> None:
    """Replaces the table at path, if no check has a row; else raises with the first few."""
    for v in violations:
        found = v.limit(5).collect()
        if found:
            raise ValueError(f"not published: {[tuple(r) for r in found]}")
    replace_table(df, path)


def polite(rows: DataFrame, by: str, order: list[str], at: str, interval: float, name: str = "allowed") -> DataFrame:
    """rows with the time each may go: its own, but `interval` after the one before it of its group.

    The k-th goes at the largest, over those up to it, of their own time and as many intervals as lie between.
    """
    w = Window.partitionBy(by).orderBy(*order)
    n = F.row_number().over(w)
    base = F.max(F.col(at) - F.col("_n") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", n).withColumn(name, F.round(base + F.col("_n") * interval, 6)).drop("_n")


def report(rows: DataFrame, by: str, value: str, shares: list[float], width: float) -> DataFrame:
    """by, and a JSON text with count, quantiles and a histogram of the values."""
    q = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    h = rows.groupBy(by, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    h = h.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("histogram"))
    return q.join(h, by).select(by, F.to_json(F.struct("n", F.transform("q", lambda x: F.round(x, 4)).alias("quantiles"), "histogram")).alias("report"))
