"""Ranks and running sums over a whole table, without a task that sees all of it.

Rows are dealt to ranges of a total order; each range is ranked by itself and starts where the ranges before it end. What
meets in one place is a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import settle


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums, the row's own value included, in a total order (null values count as 0)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({f"_v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())})
    dealt = settle(dealt.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])  # a row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "_range")
    return out.select(*rows.columns, *[(F.col(f"_s{i}") + F.sum(f"_v{i}").over(own)).alias(name) for i, name in enumerate(sums)])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in a total order."""
    return running(rows, order, {name: F.lit(1).cast("long")})
