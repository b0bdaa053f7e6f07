"""Data-quality rules: every violation as a row (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rows: DataFrame, rule: str, key: str, fine: Column, detail: Column) -> DataFrame:
    """Rows for which fine is not true."""
    return rows.filter(~F.coalesce(fine, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def orphans(rows: DataFrame, rule: str, key: str, ref: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose reference no parent has."""
    left = rows.join(parents.select(F.col(parent).alias("_p")), F.col(ref) == F.col("_p"), "left_anti")
    return left.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(ref).cast("string").alias("detail"))


def duplicates(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.col("n").cast("string").alias("detail"))


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
