"""Lines out of lanes: choice by priority, the bass lane, lanes that double no other; key regions settled; pairs of ons and offs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least notes of a lane, pitch classes and changes of a line, and the share of its notes that make it a doubling.
LANE_NOTES, LINE_CLASSES, LINE_CHANGES, DOUBLING = 32, 3, 8, 0.9


def first_choice(options: list[tuple[str, DataFrame]], by: str, order: list[Column]) -> DataFrame:
    """by, method and the other columns of the first option that has the key; within an option the first row by order."""
    rows = None
    for i, (name, df) in enumerate(options):
        one = df.withColumn("method", F.lit(name)).withColumn("_p", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_p", *order))).filter("_n = 1").drop("_n", "_p")


def lowest_lane(notes: DataFrame, by: str, lane: str, pitch: str, least: int = LANE_NOTES, below: float = 60.0) -> DataFrame:
    """by, lane, mean: the lane of lowest mean pitch among those with enough notes, if that is below; ties to the smaller lane."""
    means = notes.groupBy(by, lane).agg(F.count(F.lit(1)).alias("_n"), F.round(F.avg(pitch), 9).alias("mean")).filter(F.col("_n") >= least)
    best = means.groupBy(by).agg(F.min(F.struct("mean", lane)).alias("b")).select(by, f"b.{lane}", "b.mean")
    return best.filter(F.col("mean") < below)


def distinct_lanes(keys: DataFrame, by: str, lane: str, key: str, share: float = DOUBLING) -> DataFrame:
    """by, lane, n of the lanes kept: largest first, a lane goes if a kept one has at least share of its keys.

    keys: distinct (by, lane, key). What two lanes share comes from a join on the key, so the fold sees counts per pair
    of lanes alone, not notes; a group's lanes are as many as an item has tracks and channels.
    """
    sizes = keys.groupBy(by, lane).agg(F.count(F.lit(1)).alias("n"))
    a, b = keys.select(by, key, F.col(lane).alias("a")), keys.select(by, key, F.col(lane).alias("b"))
    shared = a.join(b, [by, key]).filter("a <> b").groupBy(by, "a", "b").agg(F.count(F.lit(1)).alias("s"))
    rows = sizes.select(by, F.col(lane).alias("a"), F.lit(None).cast(sizes.schema[lane].dataType).alias("b"), "n").unionByName(
        shared.join(sizes.select(by, F.col(lane).alias("a"), "n"), [by, "a"]).filter(F.col("s") >= share * F.col("n")).select(by, "a", "b", "n")
    )
    schema = sizes.select(by, F.col(lane).alias("a"), "n").schema

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        doubles = group[group["b"].notna()].groupby("a")["b"].agg(set).to_dict()
        lanes = group[group["b"].isna()].sort_values(["n", "a"], ascending=[False, True])
        kept: set = set()
        for x in lanes["a"]:
            if not doubles.get(x, set()) & kept:
                kept.add(x)
        return lanes[lanes["a"].isin(kept)][[by, "a", "n"]]

    return rows.groupBy(by).applyInPandas(greedy, schema).withColumnRenamed("a", lane)


def merged_runs(runs: list[tuple[float, float, object]], least: float) -> list[tuple[float, float, object]]:
    """Runs (start, end, value) joined until none is shorter than least: the first short one goes to the run before it (the first run to the next), equal neighbours become one."""
    out = _joined(runs)
    while len(out) > 1:
        short = next((i for i, (s, e, _) in enumerate(out) if e - s < least), None)
        if short is None:
            break
        s, e, _ = out.pop(short)
        if short:
            out[short - 1] = (out[short - 1][0], e, out[short - 1][2])
        else:
            out[0] = (s, *out[0][1:])
        out = _joined(out)
    return out


def _joined(runs: list) -> list:
    out: list = []
    for s, e, v in runs:
        if out and out[-1][2] == v:
            out[-1] = (out[-1][0], e, v)
        else:
            out.append((s, e, v))
    return out


def settled_runs(runs: list[tuple[float, float, object]], home: object, stays: object) -> list[tuple[float, float, object]]:
    """Runs of which the shortest that does not stay beside home or a neighbour takes that value, until all stay.

    stays(run, value) says whether a run survives next to a value; a run of home always does.
    """
    out = _joined(runs)
    while len(out) > 1:
        for i in sorted((i for i, r in enumerate(out) if r[2] != home), key=lambda i: (out[i][1] - out[i][0], i)):
            beside = [home, *(out[j][2] for j in (i - 1, i + 1) if 0 <= j < len(out))]
            to = next((v for v in beside if not stays(out[i], v)), None)
            if to is not None:
                out[i] = (*out[i][:2], to)
                break
        else:
            break
        out = _joined(out)
    return out


def merge_short(runs: DataFrame, by: str, start: str, end: str, value: str, least: float, home: Column | None = None, stays: object = None) -> DataFrame:
    """by, start, end, value: merged_runs of each group, then settled_runs if home is given (stays is a Python function).

    A fixpoint over a group's runs in order, so one task folds a group; runs are few beside the rows they come from.
    """
    base = runs.select(by, F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"), F.col(value).alias("value"), (F.lit(None) if home is None else home).cast(runs.schema[value].dataType).alias("_home"))
    schema = base.drop("_home").schema

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["start", "end"])
        out = merged_runs(list(zip(g["start"], g["end"], g["value"], strict=True)), least)
        if stays is not None:
            out = settled_runs(out, g["_home"].iloc[0], stays)
        return pd.DataFrame([(g[by].iloc[0], *r) for r in out], columns=[by, "start", "end", "value"])

    return base.groupBy(by).applyInPandas(fold, schema)


def fifo_pairs(rows: DataFrame, by: list[str], order: list[str], is_on: Column, is_off: Column, position: str) -> DataFrame:
    """by, nth, opened, closed: ons and offs of a group paired first in, first out; closed is null for a note left open.

    The running sum of ons and offs falls to a new low below zero exactly at an off that finds nothing open; those
    aside, the n-th off closes the n-th on. Windows and the last grouping share one partitioning.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.filter(is_on | is_off).withColumn("_on", is_on).withColumn("_s", F.sum(F.when(is_on, 1).otherwise(-1)).over(upto))
    r = r.withColumn("_low", F.least(F.coalesce(F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0)))
    r = r.filter("_on OR _s >= _low")
    r = r.withColumn("nth", F.when(F.col("_on"), F.sum(F.col("_on").cast("long")).over(upto)).otherwise(F.sum((~F.col("_on")).cast("long")).over(upto)))
    return r.groupBy(*by, "nth").agg(F.max(F.when(F.col("_on"), F.col(position))).alias("opened"), F.max(F.when(~F.col("_on"), F.col(position))).alias("closed"))
