"""Quality by Bradley-Terry pairwise ranking.

Each text is described by FEATURES, shares and lengths worked out in one pass over the whole text. A preference pair is
a training text of label 1 over one of label 0; the chance that the first wins is the logistic function of the
difference of their latent scores, which are linear in the features, so the weights minimise the logistic loss on
feature differences: the mean over all pairs of a training text of label 1 and one of label 0, none left out, plus L2. A
text's pull depends on its own latent score and on the other class's, so pairs are not listed: each Newton step counts
the latent scores of all training texts on a grid of width GRID (a score counts for the two points beside it, by its
distance), and the pairs of grid points are weighed on the driver. What reaches the driver is a row a grid point.

The latent score is cut at a quantile: the share of label 0 among training labels of the training scores weighted
as the classes are. The score returned is the logistic function of the latent score, shifted so that the cut has the
score CUT = 0.3; whatever the input, scores mean the same.

Defined cases: a null text counts as empty; an empty text has all features zero and is scored; without training rows of
both classes every score is the share of label 1 (0 if none); repeated rows are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import running

from .common import UPPER, settle, small, whole
from .labels import held_out, training

CUT, GRID, L2, STEPS = 0.3, 0.125, 1e-4, 30
#: labels.sample() with this many texts a class leaves none out, as score_quality() does.
PER_CLASS = 2**31 - 1
FEATURES = ("words", "word_length", "upper", "digits", "symbols", "stops", "marks", "repeat_next", "distinct", "alone", "line_words", "repeat_lines", "longest", "shouts", "sentences")
_UPPER, _DIGITS, _STOPS = UPPER.encode(), b"0123456789", b".,;"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(FEATURES)
    lines = data.split(b"\n")
    count = lambda chars: size - len(data.translate(None, chars))
    kinds = set(words)
    return [
        np.log1p(n) / 10,
        min(sum(map(len, words)) / n, 30) / 10,
        count(_UPPER) / size,
        count(_DIGITS) / size,
        count(_SYMBOLS) / size,
        count(_STOPS) / n,
        sum(data.count(c) for c in (b"!", b"?")) / n,
        sum(map(eq, words, words[1:])) / n,
        (len(kinds) / n) * min(np.log1p(n) / 5, 1),
        sum(words.count(w) for w in (b"|", b"-", b"*")) / n,
        min(n / len(lines), 100) / 100,
        1 - len(set(lines)) / len(lines),
        min(max(map(len, kinds)), 60) / 60,
        data.count(b"!!") / n,
        data.count(b". ") / n,
    ]


def rooted(x: np.ndarray) -> np.ndarray:
    """Features, and their roots: small shares tell most."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def described(texts: list[str]) -> np.ndarray:
    return rooted(np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES)))


@dataclass
class Model:
    weights: np.ndarray
    shift: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.shift, -500, 500)))

    def score(self, texts: list[str]) -> np.ndarray:
        return self.of(described(texts))


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A row: rows, rows of label 1, sums and sums of squares."""
    return np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])[None, :]


def _points(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.floor(z / GRID)
    return low.astype(np.int64), z / GRID - low


def _gridded(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A row a label and grid point: label, point, rows there, sum of their features."""
    low, part = _points(x @ w)
    keys = np.concatenate([low, low + 1]) * 2 + np.concatenate([y, y])
    share = np.concatenate([1 - part, part])
    found, at = np.unique(keys, return_inverse=True)
    sums = np.zeros((len(found), x.shape[1] + 1))
    np.add.at(sums, at, np.concatenate([np.ones((2 * len(y), 1)), np.concatenate([x, x])], axis=1) * share[:, None])
    return np.concatenate([(found % 2)[:, None], (found // 2)[:, None], sums], axis=1)


def _curved(x: np.ndarray, y: np.ndarray, w: np.ndarray, first: int, bend: np.ndarray) -> np.ndarray:
    """A row: the sum of the rows' outer products, weighed by bend[label, point - first]."""
    low, part = _points(x @ w)
    at = np.clip(low - first, 0, bend.shape[1] - 2)
    a = bend[y, at] * (1 - part) + bend[y, at + 1] * part
    return ((x * a[:, None]).T @ x).reshape(1, -1)


def _merged(r: np.ndarray, keys: int) -> np.ndarray:
    """The sums of the rows of equal first `keys` columns, in their order."""
    found, at = np.unique(r[:, :keys], axis=0, return_inverse=True) if keys else (np.zeros((1, 0)), np.zeros(len(r), np.int64))
    sums = np.zeros((len(found), r.shape[1] - keys))
    np.add.at(sums, at.ravel(), r[:, keys:])
    return np.concatenate([found, sums], axis=1)


def _fit(add: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Weights of the scaled features, the scale, rows of label 0 and 1. add(f, keys, *more) has the sum over all training rows of
    f(x, y, *more), row by row of equal first `keys` columns; x as rooted() gives it."""
    m = add(_moments, 0)
    k = 2 * len(FEATURES)
    if not len(m) or not 0 < m[0, 1] < m[0, 0]:
        return np.zeros(k), np.ones(k), int(m[0, 0] - m[0, 1]) if len(m) else 0, int(m[0, 1]) if len(m) else 0
    n, n1 = int(m[0, 0]), int(m[0, 1])
    mean = m[0, 2 : 2 + k] / n
    scale = np.sqrt(np.maximum(m[0, 2 + k :] / n - mean * mean, 0)) + 1e-3
    w, step, best = np.zeros(k), np.zeros(k), np.inf
    for _ in range(STEPS):
        g = add(_gridded, 2, (w + step) / scale)
        one, zero = (g[g[:, 0] == label] for label in (1, 0))
        d = (one[:, 1:2] - zero[None, :, 1]) * GRID
        p = one[:, 2:3] * zero[None, :, 2] / n1 / (n - n1)
        loss = float((p * np.logaddexp(0, -d)).sum()) + L2 / 2 * float((w + step) @ (w + step))
        if loss > best + 1e-6:  # too far; the grid's own error is below that
            step = step / 2
            continue
        w, best = w + step, loss
        pull = 1 / (1 + np.exp(np.clip(d, -500, 500)))
        bend = pull * (1 - pull)
        x1, x0 = one[:, 3:] / scale / n1, zero[:, 3:] / scale / (n - n1)
        h1, h0 = zero[:, 2] / (n - n1), one[:, 2] / n1
        slope = -(pull @ h1) @ x1 + (h0 @ pull) @ x0 + L2 * w
        first = int(g[:, 1].min())
        table = np.zeros((2, int(g[:, 1].max()) - first + 2))
        table[1, one[:, 1].astype(int) - first], table[0, zero[:, 1].astype(int) - first] = (bend @ h1) / n1, (h0 @ bend) / (n - n1)
        cross = x1.T @ bend @ x0
        h = add(_curved, 0, w / scale, first, table).reshape(k, k) / scale / scale[:, None] - cross - cross.T + L2 * np.eye(k)
        step = -np.linalg.solve(h, slope)
        if np.abs(step).max() < 1e-7:
            break
        step = step * min(1, 20 / np.abs(step).max())
    return w, scale, n - n1, n1


def _share(n0: float, n1: float, of0: int, of1: int, rate: float) -> float:
    return n1 * rate / of1 + n0 * (1 - rate) / of0


def _constant(rate: float) -> Model:
    odds = np.clip(rate, 1e-9, 1 - 1e-9)
    return Model(np.zeros(2 * len(FEATURES)), float(np.log(odds / (1 - odds))))


def _model(w: np.ndarray, cut: float) -> Model:
    return Model(w, float(np.log(CUT / (1 - CUT)) - cut))


def train(texts: list[str], y: np.ndarray, rate: float) -> Model:
    """The model of some texts, on the driver."""
    x = described(texts)
    w, scale, n0, n1 = _fit(lambda f, keys, *more: f(x, y, *more))
    if not n0 or not n1:
        return _constant(rate)
    latent = x @ (w / scale)
    order = np.lexsort((y, latent))
    ones = np.cumsum(y[order])
    share = _share(np.arange(1, len(y) + 1) - ones, ones, n0, n1, rate)
    at = min(int(np.argmax(share >= 1 - rate - 1e-9)), len(order) - 2)
    return _model(w / scale, (latent[order[at]] + latent[order[at + 1]]) / 2)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return rooted(batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))


def learn(rows: DataFrame, rate: float) -> Model:
    """The model of all rows (x: features, y: label 0 or 1), where they lie."""

    # a task a core: what reaches the driver is a row a grid point and task, at any size
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def add(f: Callable[..., np.ndarray], keys: int, *more: object) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    r = f(_matrix(batch), batch.column("y").to_numpy().astype(np.int64), *more)
                    total = r if total is None else _merged(np.concatenate([total, r]), keys)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1], np.ascontiguousarray(total).ravel())], names=["v"])

        out = [r["v"] for r in rows.mapInArrow(run, "v array<double>").collect()]
        return _merged(np.array(out, dtype=np.float64), keys) if out else np.zeros((0, 2))

    w, scale, n0, n1 = _fit(add)
    if not n0 or not n1:
        return _constant(rate)
    w = w / scale

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_matrix(batch) @ w), batch.column("y")], names=["z", "y"])

    placed = settle(running(rows.mapInArrow(latent, "z double, y int"), [F.col("z"), F.col("y")], {"n": F.lit(1).cast("long"), "ones": F.col("y").cast("long")}))
    over = _share(F.col("n") - F.col("ones"), F.col("ones"), n0, n1, rate) >= 1 - rate - 1e-9
    at = min(placed.filter(over).agg(F.min("n")).first()[0], n0 + n1 - 1)
    return _model(w, placed.filter(F.col("n").isin(at, at + 1)).agg(F.avg("z")).first()[0])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = CUT) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([list(map(float, features(t))) for t in batch.column("t").to_pylist()], pa.list_(pa.float64()))], names=["id", "x"])

    described_ = settle(docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("t")).mapInArrow(describe, "id long, x array<double>"))
    marked = training(labels, label, id_col)
    rate = float(marked.agg(F.avg("_y")).first()[0] or 0.0)
    # of an id with several rows the least features count
    rows = described_.join(marked, F.col("id") == F.col("_id")).groupBy("id").agg(F.min("x").alias("x"), F.max("_y").alias("y"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(settle(rows.select("x", "y")), rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.of(_matrix(batch)))], names=["id", "score"])

    scored = described_.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
