"""Maps between clocks: piecewise-linear maps with their ends drawn out, seconds and bars of tempo and meter changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import as_of


def segments(grid: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, x0, y0 and slope from each grid point to the next; the last point's slope is that of the segment before it."""
    w = Window.partitionBy(by).orderBy(x)
    slope = lambda a, b: (F.lead(b).over(w) - F.col(b)) / (F.lead(a).over(w) - F.col(a))
    s = grid.withColumn("slope", slope(x, y))
    return s.select(by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.coalesce("slope", F.lag("slope").over(w)).alias("slope"))


def mapped(points: DataFrame, grid: DataFrame, by: str, at: str, x: str, y: str, name: str, places: int = 6) -> DataFrame:
    """points with `name`: the map through the grid (distinct x a group, two points at least) at each; beyond its ends the
    first and last segments go on. Grids are composed by mapping the points of one through another."""
    s = segments(grid, by, x, y).select(by, "x0", F.struct("x0", "y0", "slope").alias("_s"))
    found = as_of(points, s, by, at, "x0", "_s", slack=0.0)
    return found.withColumn(name, F.round(F.col("_s.y0") + (F.col(at) - F.col("_s.x0")) * F.col("_s.slope"), places)).drop("_s")


def tempo_seconds(changes: DataFrame, ends: DataFrame, by: str, at: str, per_beat: str) -> DataFrame:
    """by, seconds: the beats of each stretch times its seconds a beat. changes: by, at (beats), per_beat; ends: by, end."""
    w = Window.partitionBy(by).orderBy(at)
    s = changes.join(ends, by).withColumn("to", F.coalesce(F.lead(at).over(w), F.col("end")))
    return s.groupBy(by).agg(F.round(F.sum(F.greatest(F.col("to") - F.col(at), F.lit(0.0)) * F.col(per_beat)), 6).alias("seconds"))


def bar_count(meters: DataFrame, ends: DataFrame, by: str, at: str, beats: str, unit: str) -> DataFrame:
    """by, bars: the length of each stretch over its bar, beats x 4 / unit quarters. meters: by, at, beats, unit; ends: by, end."""
    w = Window.partitionBy(by).orderBy(at)
    s = meters.join(ends, by).withColumn("to", F.coalesce(F.lead(at).over(w), F.col("end"))).filter(F.col("to") > F.col(at))
    return s.groupBy(by).agg(F.round(F.sum((F.col("to") - F.col(at)) / (F.col(beats) * 4.0 / F.col(unit))), 6).alias("bars"))
