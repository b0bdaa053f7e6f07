"""Dense vectors: cosine, centroids, barycentres, force layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """by, n and the mean vector of each group."""
    e = rows.select(by, F.posexplode(vector).alias("i", "v"))
    per = e.groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"))


def nearest_centroids(rows: DataFrame, key: str, vector: str, table: DataFrame, by: str, k: int) -> DataFrame:
    """The k centroids most like each row. The table is one row a class; Spark broadcasts it where that is small."""
    j = rows.select(key, vector).crossJoin(table.select(by, "centroid"))
    j = j.withColumn("cosine", F.round(cosine(F.col(vector), F.col("centroid")), 6))
    w = Window.partitionBy(key).orderBy(F.desc("cosine"), by)
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", by, "cosine")


def sharpened(scores: DataFrame, by: str, score: str, gamma: float) -> DataFrame:
    """scores with weight: (score / best)^gamma, normalised within by."""
    w = Window.partitionBy(by)
    s = scores.withColumn("weight", F.pow(F.try_divide(F.col(score), F.max(score).over(w)), F.lit(gamma)))
    return s.withColumn("weight", F.round(F.col("weight") / F.sum("weight").over(w), 6))


def force_layout(edges: list[tuple[int, int, float]], time: list[float], steps: int = 200, seed: int = 1, spring: float = 0.05, push: float = 0.02) -> np.ndarray:
    """(n, 2): x is the given time; y moves by springs along edges and repulsion between all nodes, cooled to rest."""
    n = len(time)
    y = np.random.default_rng(seed).normal(size=n)
    x = np.asarray(time, dtype=float)
    for step in range(steps):
        dx, dy = x[:, None] - x[None], y[:, None] - y[None]
        f = (push * dy / (dx**2 + dy**2 + 0.05)).sum(axis=1)
        for a, b, w in edges:
            pull = spring * w * (y[b] - y[a])
            f[a] += pull
            f[b] -= pull
        y = y + np.clip(f, -0.5, 0.5) * (1 - step / steps)
    return np.stack([x, y - y.mean()], axis=1)


def layout(nodes: DataFrame, edges: DataFrame, by: str, steps: int = 200) -> DataFrame:
    """by, node, x, y: each component of the graph is laid out by itself. nodes: by, node, time; edges: by, a, b, weight."""

    def place(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node").reset_index(drop=True)
        at = {v: i for i, v in enumerate(n["node"])}
        xy = force_layout([(at[a], at[b], w) for a, b, w in sorted(zip(e["a"], e["b"], e["weight"], strict=True))], n["time"].tolist(), steps) if len(n) else np.zeros((0, 2))
        return pd.DataFrame({by: n[by], "node": n["node"], "x": xy[:, 0].round(6), "y": xy[:, 1].round(6)})

    t = dict(nodes.dtypes)
    return nodes.groupBy(by).cogroup(edges.groupBy(by)).applyInPandas(place, f"{by} {t[by]}, node {t['node']}, x double, y double")
