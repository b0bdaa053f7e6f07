"""Event-time windows as streaming queries, with the same results as their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums per window; late: how far behind a row may come, for streams."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, ts: str, size: str, hop: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.window(ts, size, hop).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(spark: SparkSession, df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over what is there and returns its result."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
