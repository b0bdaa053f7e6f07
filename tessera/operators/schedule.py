"""Sequential choices within a group: interval scheduling, one-to-one matching, diverse selection, folds."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame


def best_schedule(starts: list[float], ends: list[float], weights: list[float]) -> list[int]:
    """Positions of non-overlapping spans with the greatest total weight (ties: the fewer spans, then the earlier ones)."""
    order = sorted(range(len(starts)), key=lambda i: (ends[i], starts[i], i))
    stops = [ends[i] for i in order]
    best: list[tuple[float, int]] = [(0.0, 0)]
    take: list[bool] = []
    back: list[int] = []
    for k, i in enumerate(order):
        p = bisect_right(stops, starts[i], 0, k)
        with_ = (round(best[p][0] + weights[i], 9), best[p][1] - 1)
        take.append(weights[i] > 0 and with_ > best[k])
        back.append(p)
        best.append(with_ if take[-1] else best[k])
    out, k = [], len(order)
    while k:
        if take[k - 1]:
            out.append(order[k - 1])
            k = back[k - 1]
        else:
            k -= 1
    return sorted(out, key=lambda i: starts[i])


def schedule(spans: DataFrame, by: str, start: str, end: str, weight: str) -> DataFrame:
    """The chosen spans of each group; a group is one entity's, and is worked in one task."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([start, end, weight], kind="stable").reset_index(drop=True)
        return g.loc[best_schedule(g[start].tolist(), g[end].tolist(), g[weight].tolist())]

    return spans.groupBy(by).applyInPandas(choose, spans.schema)


def match_in_order(a: list[float], b: list[float], within: float) -> list[tuple[int, int]]:
    """Greedy one-to-one pairs, nearest first, that never cross and lie within the tolerance."""
    near = sorted((abs(x - y), i, j) for i, x in enumerate(a) for j in range(bisect_right(b, x - within - 1e-9), len(b)) if (y := b[j]) <= x + within + 1e-9)
    out: list[tuple[int, int]] = []
    for _, i, j in near:
        if all((i < p and j < q) or (i > p and j > q) for p, q in out):
            out.append((i, j))
    return sorted(out)


def diverse(rows: list[tuple[float, list]], k: int, shared: int) -> list[int]:
    """Best first, those that share at most `shared` members with any chosen before; k at most."""
    out: list[int] = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], list(rows[i][1]))):
        if len(out) < k and all(len(set(rows[i][1]) & set(rows[j][1])) <= shared for j in out):
            out.append(i)
    return out


def diverse_paths(paths: DataFrame, by: str, score: str, path: str, k: int, shared: int = 0) -> DataFrame:
    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.reset_index(drop=True)
        return g.loc[diverse(list(zip(g[score].tolist(), [list(p) for p in g[path]], strict=True)), k, shared)]

    return paths.groupBy(by).applyInPandas(choose, paths.schema)


def absorb_short(rows: list[tuple[float, float, int]], least: float) -> list[tuple[float, float, int]]:
    """(start, end, value) in order: a row shorter than least extends the one before it if they touch, else goes; equal neighbours merge."""
    out: list[tuple[float, float, int]] = []
    for s, e, v in rows:
        if e - s < least:
            if out and abs(out[-1][1] - s) < 1e-6:
                out[-1] = (out[-1][0], e, out[-1][2])
        elif out and out[-1][2] == v:
            out[-1] = (out[-1][0], e, v)
        else:
            out.append((s, e, v))
    return out


def absorb(spans: DataFrame, by: str, start: str, end: str, value: str, least: float) -> DataFrame:
    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([start, end, value])
        out = absorb_short(list(zip(g[start], g[end], g[value], strict=True)), least)
        return pd.DataFrame([(g[by].iloc[0], *r) for r in out], columns=[by, start, end, value])

    types = dict(spans.dtypes)
    return spans.groupBy(by).applyInPandas(fold, ", ".join(f"{c} {types[c]}" for c in (by, start, end, value)))


def viterbi(scores: list[list[float]], switch: float) -> list[int]:
    """The best state at each step when every change costs `switch` (ties: the smaller state)."""
    if not scores:
        return []
    total, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(total)), key=lambda i: (total[i], -i))
        came = [i if total[i] >= total[top] - switch else top for i in range(len(row))]
        back.append(came)
        total = [row[i] + (total[i] if came[i] == i else total[top] - switch) for i in range(len(row))]
    state = max(range(len(total)), key=lambda i: (total[i], -i))
    out = [state]
    for came in reversed(back):
        state = came[state]
        out.append(state)
    return out[::-1]
