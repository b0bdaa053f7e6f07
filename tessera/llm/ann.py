"""Approximate nearest neighbours with a permutation index.

PIVOTS rows are the pivots and go to all tasks: their number is fixed. They are drawn from DRAWN times as many rows, those
with the smallest hash of the id, each the farthest from those before it, so a crowd of like vectors has few. A vector
is represented by its PREFIX nearest pivots in order. Rows are dealt by hash of the id to blocks of about BLOCK
rows; a block posts each of its vectors in the inverted file of every pivot of its prefix, with the position. A query
adds, list by list, what the footrule distance to each posted vector falls short of its greatest value:
2 x min(PREFIX - own position, PREFIX - its position). The best of the block's rows by footrule are then measured
exactly; the ten nearest of each block are merged. The share that is measured is ROOT over the root of the number of all
rows, and SHARE at least: it falls with the size of the table, as rankings of more rows are told apart by the same
footrule, but no further than SHARE. Every block gets the whole query set, a stated one, ASKED queries a task.

Defined cases: vectors that are null, zero, of another length than most or hold null or non-finite components take no
part; rows without id take no part; rows repeated with one id and vector count once; of an id with several vectors all
are candidates, an answer names the id once, with its nearest vector, and the least vector in array order is what is
asked; no row with the query's id is its neighbour; ties go to the smaller id; with fewer candidates than k all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX, BLOCK, ASKED = 512, 128, 32_768, 16_384
DRAWN, SHARE, ROOT = 4, 0.02, 5.0


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(x, lambda v: v != 0)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors: the first, then always the one farthest from all before it (ties: the earlier)."""
    picked, away = [0], np.full(len(vectors), np.inf)
    for _ in range(min(n, len(vectors)) - 1):
        away = np.minimum(away, ((vectors - vectors[picked[-1]]) ** 2).sum(axis=1))
        away[picked] = -1
        picked.append(int(away.argmax()))
    return vectors[picked[: len(vectors)]]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first, ties by number."""
    out = [np.empty((0, min(prefix, len(pivots))), dtype=np.int16)]
    for at in range(0, len(vectors), 4096):
        d = (pivots**2).sum(axis=1)[None] - 2 * vectors[at : at + 4096] @ pivots.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16))
    return np.concatenate(out)


class Block:
    """The inverted files of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.pivots, self.prefix = ids[order], rows[order], pivots, prefix
        perm = nearest_pivots(self.rows, pivots, prefix)
        width = perm.shape[1]
        flat = np.argsort(perm.ravel(), kind="stable").astype(np.int64)
        self.stops = np.searchsorted(perm.ravel()[flat], np.arange(len(pivots) + 1))
        self.holder, self.weight = (flat // width).astype(np.int32), (prefix - flat % width).astype(np.int16)

    def search(self, qid: int, q: np.ndarray, own: np.ndarray, n: int, k: int) -> list[tuple[int, int, float]]:
        """query id, id, distance: up to k, of the n rows that come first by footrule. own: the query's nearest pivots."""
        short = np.zeros(len(self.ids), dtype=np.int32)
        for at, p in enumerate(own):
            span = slice(self.stops[p], self.stops[p + 1])
            short[self.holder[span]] += np.minimum(self.prefix - at, self.weight[span])  # a row stands in a list once
        short[slice(*np.searchsorted(self.ids, [qid, qid + 1]))] = -1  # ids are sorted
        n = min(n, len(short))
        least = np.partition(short, len(short) - n)[len(short) - n]
        tied = np.flatnonzero(short == least)  # of rows with one footrule the smaller ids: equal vectors are ties to them
        pick = np.sort(np.concatenate([np.flatnonzero(short > least), tied[: n - int((short > least).sum())]]))
        pick = pick[short[pick] >= 0]
        d = np.sqrt(((self.rows[pick] - q) ** 2).sum(axis=1))
        best: dict[int, float] = {}
        for i in np.lexsort((self.ids[pick], d)):
            best.setdefault(int(self.ids[pick[i]]), float(d[i]))
            if len(best) == k:
                break
        return [(qid, i, x) for i, x in best.items()]


def permutation_search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, root: float = ROOT, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """query_id, rank (from 1), id_col, score (Euclidean distance) of each query's k nearest found."""
    vector = F.col(f"`{vector_col}`")
    good = rows.filter(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"), is_query.alias("q"))
    size = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("count"), F.count_if("q").alias("asked")).orderBy(F.desc("count"), "d").first()
    dim, total, n_asked = (size["d"], size["count"], size["asked"]) if size else (1, 0, 0)
    good = good.filter(F.size("v") == dim)
    drawn = good.select("v", F.xxhash64("id", F.lit("pivot")).alias("h")).orderBy("h", "v").limit(DRAWN * n_pivots).collect()
    pivots = far_apart(np.array([r["v"] for r in drawn]).reshape(-1, dim), n_pivots)
    prefix = min(prefix, len(pivots))
    measured = min(1.0, max(share, root / max(total, 1) ** 0.5))
    n_blocks, n_parts = max(1, round(total / block)), max(1, -(-n_asked // asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = good.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")).dropDuplicates(["id", "v"]).withColumn("part", every(n_parts))
    queries = good.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(n_parts)).cast("int").alias("part"), every(n_blocks).alias("block"))

    def run(key: tuple, held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(held) and len(asking):
            own = Block(held["id"].to_numpy(), np.stack(held["v"].to_numpy()).astype(np.float64), pivots, prefix)
            at = np.stack(asking["v"].to_numpy()).astype(np.float64)
            n = int(np.ceil(measured * len(held)))
            for qid, q, near in zip(asking["id"].tolist(), at, nearest_pivots(at, pivots, prefix), strict=True):
                found += own.search(qid, q, near, max(n, k), k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    found = placed.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
