"""Alignment of token sequences, as Arrow UDFs over pairs of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def local_score(a: np.ndarray, b: np.ndarray, match: float = 2.0, mismatch: float = -1.0, open_: float = 3.0, extend: float = 0.3) -> float:
    """Smith-Waterman with affine gaps (a gap of n costs open + (n - 1) extend); a row at a time."""
    a, b = np.asarray(a), np.asarray(b)
    if not len(a) or not len(b):
        return 0.0
    h, e, best = np.zeros(len(b) + 1), np.full(len(b) + 1, -np.inf), 0.0
    cost = extend * np.arange(len(b) + 1)
    for x in a:
        diagonal = h[:-1] + np.where(b == x, match, mismatch)
        e[1:] = np.maximum(h[1:] - open_, e[1:] - extend)
        new = np.zeros(len(b) + 1)
        new[1:] = np.maximum(0, np.maximum(diagonal, e[1:]))
        # a gap along the row: the best earlier cell less its cost; opening from such a gap never pays
        lead = np.maximum.accumulate(new + cost)
        new[1:] = np.maximum(new[1:], lead[:-1] - cost[:-1] - open_)
        h = new
        best = max(best, float(h.max()))
    return best


def agreement(a: list | None, b: list | None, **costs: float) -> float | None:
    """local_score over the root of both self scores, 0..1; null if either is empty."""
    if a is None or b is None or not len(a) or not len(b):
        return None
    x, y = np.asarray(a), np.asarray(b)
    top = costs.get("match", 2.0)
    return round(min(1.0, max(0.0, local_score(x, y, **costs) / (top * (len(x) * len(y)) ** 0.5))), 6)


def global_identity(a: list | None, b: list | None, open_: float = 12.0, extend: float = 6.0) -> float | None:
    """Identical positions of a Needleman-Wunsch alignment (match 1, mismatch 0, a gap of k costs open + extend k) over the mean length."""
    if a is None or b is None or not len(a) or not len(b):
        return None
    n, m = len(a), len(b)
    low = -1e9
    # states: 0 match, 1 gap in b, 2 gap in a; each cell holds (score, identities)
    row = [[(low, 0)] * 3 for _ in range(m + 1)]
    row[0][0] = (0.0, 0)
    for j in range(1, m + 1):
        row[j][2] = (-open_ - extend * j, 0)
    for i in range(1, n + 1):
        new = [[(low, 0)] * 3 for _ in range(m + 1)]
        new[0][1] = (-open_ - extend * i, 0)
        for j in range(1, m + 1):
            same = int(a[i - 1] == b[j - 1])
            s, k = max(row[j - 1])
            new[j][0] = (s + same, k + same)
            new[j][1] = max((row[j][0][0] - open_ - extend, row[j][0][1]), (row[j][1][0] - extend, row[j][1][1]))
            new[j][2] = max((new[j - 1][0][0] - open_ - extend, new[j - 1][0][1]), (new[j - 1][2][0] - extend, new[j - 1][2][1]))
        row = new
    return round(max(row[m])[1] / ((n + m) / 2), 6)


def local_hits(a: list | None, b: list | None, k: int = 3, least: int = 3) -> list[dict[str, int]]:
    """The k best equal runs that share no position of a or b with a better one: start in a and b, length."""
    if a is None or b is None:
        return []
    found: list[tuple[int, int, int]] = []
    before: dict[int, int] = {}
    for i in range(len(a)):
        now = {j: before.get(j - 1, 0) + 1 for j in range(len(b)) if b[j] == a[i]}
        for j, n in now.items():
            if n >= least and not (i + 1 < len(a) and j + 1 < len(b) and a[i + 1] == b[j + 1]):
                found.append((n, i - n + 1, j - n + 1))
        before = now
    out: list[dict[str, int]] = []
    for n, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if len(out) < k and all((i + n <= o["a"] or o["a"] + o["n"] <= i) and (j + n <= o["b"] or o["b"] + o["n"] <= j) for o in out):
            out.append({"a": i, "b": j, "n": n})
    return out


def agreement_column(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([agreement(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return f(a, b)


def identity_column(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([global_identity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return f(a, b)


def hits_column(a: str, b: str) -> Column:
    @F.pandas_udf("array<struct<a:int,b:int,n:int>>")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([local_hits(p, q) for p, q in zip(x, y, strict=True)])

    return f(a, b)
