"""Half-open intervals and points on a line: unions, islands, as-of and overlap joins, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, by: str, start: str, end: str, gap: float = 0.0, touch: bool = True) -> DataFrame:
    """by, island (from 1), start, end, n: spans merged where the next begins at most gap after all before it end.

    touch=False keeps spans apart that only touch.
    """
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) > F.col("reach") + gap) if touch else (F.col(start) >= F.col("reach") + gap)
    new = F.when(F.col("reach").isNull() | apart, 1).otherwise(0)
    s = spans.withColumn("reach", reach).withColumn("new", new)
    s = s.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))


def union_length(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    return islands(spans, by, start, end).groupBy(by).agg(F.round(F.sum(F.col("end") - F.col("start")), 6).alias("covered"), F.count(F.lit(1)).alias("islands"))


def runs(rows: DataFrame, by: str, order: list[str], value: str, position: str) -> DataFrame:
    """by, run (from 1), value, first and last position, n: equal neighbours as one."""
    w = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    r = rows.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(by, "run").agg(F.first(value).alias(value), F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n"))


def skyline(notes: DataFrame, by: str, onset: str, pitch: str, highest: bool = True) -> DataFrame:
    """One row an onset: its highest (or lowest) pitch, and the length until the next onset (null at the last)."""
    top = notes.groupBy(by, onset).agg((F.max if highest else F.min)(pitch).alias(pitch))
    return top.withColumn("length", F.round(F.lead(onset).over(Window.partitionBy(by).orderBy(onset)) - F.col(onset), 6))


def as_of(points: DataFrame, regions: DataFrame, by: str, at: str, start: str, value: str, slack: float = 1e-6) -> DataFrame:
    """points with the value of the last region that starts at most slack after the point, else of the first region.

    One sort of points and regions together; no point meets more than one region.
    """
    cols = points.columns
    p = points.select("*", F.col(at).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).alias("_value"))
    r = regions.select(by, (F.col(start) - slack).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_value"))
    both = p.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_t", "_kind")
    last = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = both.withColumn("_found", F.coalesce(last, first))
    return both.filter("_kind = 1").select(*cols, F.col("_found.v").alias(value))


def overlaps(left: DataFrame, right: DataFrame, by: str, start: str, end: str, r_start: str, r_end: str, width: float) -> DataFrame:
    """Pairs of spans of one group that overlap, with from and to of the common part.

    Each span is filed under the cells of the given width that it meets, so the join is on (group, cell); a pair is
    reported in the cell where its common part begins.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.greatest(F.ceil(F.col(b) / width) - 1, F.floor(F.col(a) / width))))
    a = left.filter(F.col(end) > F.col(start)).withColumn("cell", cell(start, end))
    b = right.filter(F.col(r_end) > F.col(r_start)).withColumn("cell", cell(r_start, r_end))
    j = a.join(b, [by, "cell"]).filter((F.col(start) < F.col(r_end)) & (F.col(r_start) < F.col(end)))
    j = j.withColumn("from", F.greatest(start, r_start)).withColumn("to", F.least(end, r_end))
    return j.filter(F.floor(F.col("from") / width) == F.col("cell")).drop("cell")


def in_windows(points: DataFrame, at: str, size: float, hop: float) -> DataFrame:
    """points, once for each window [k x hop, k x hop + size) with k from 0 that holds them, with window = k.

    Arithmetic gives the windows of a point, so nothing is joined.
    """
    first = F.greatest(F.floor((F.col(at) - size) / hop) + 1, F.lit(0))
    last = F.floor(F.col(at) / hop)
    return points.filter(F.col(at) >= 0).withColumn("window", F.explode(F.sequence(first, last)))


def hops(lengths: DataFrame, by: str, length: str, size: float, hop: float, least: float) -> DataFrame:
    """Window starts 0, hop, ... that leave at least `least` before the end (one at 0 always)."""
    n = F.greatest(F.ceil((F.col(length) - least) / hop), F.lit(1))
    return lengths.select(by, F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), F.col(length)).select(by, "k", (F.col("k") * hop).alias("start"), F.least(F.col("k") * hop + size, F.col(length)).alias("end"))


def chunk_starts(n: Column, size: int, stride: int) -> Column:
    """Where windows of `size` begin, each `stride`, from 0; the last is anchored at the end."""
    last = F.greatest(n - size, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))


def line_chunks(docs: DataFrame, by: str, n_lines: str, size: int, stride: int) -> DataFrame:
    """Windows of `size` lines each `stride`; the last is anchored at the end. start counts from 0."""
    return docs.select(by, F.posexplode(chunk_starts(F.col(n_lines), size, stride)).alias("chunk", "start"), F.col(n_lines)).select(by, "chunk", "start", F.least(F.col("start") + size, F.col(n_lines)).alias("end"))


def grid_cells(spans: DataFrame, by: str, start: str, end: str, value: str, cell: float, share: float = 0.25) -> DataFrame:
    """The value that covers most of each cell, if it covers at least share of it; ties: the smaller value."""
    s = spans.filter(F.col(end) > F.col(start)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.greatest(F.ceil(F.col(end) / cell) - 1, F.floor(F.col(start) / cell)))))
    covered = F.least(F.col(end), (F.col("cell") + 1) * cell) - F.greatest(F.col(start), F.col("cell") * cell)
    per = s.groupBy(by, "cell", value).agg(F.round(F.sum(covered), 6).alias("covered"))
    best = per.withColumn("n", F.row_number().over(Window.partitionBy(by, "cell").orderBy(F.desc("covered"), value))).filter("n = 1").drop("n")
    return best.filter(F.col("covered") >= share * cell)
