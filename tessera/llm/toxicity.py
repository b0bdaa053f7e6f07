"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's words are its lower-cased runs of non-space characters without the punctuation around them. A word, between
boundary marks, gives its character n-grams of N; each n-gram is one of 2**BITS features by hash. A feature's value is
the number of distinct runs of the text with it, over the root of the number of distinct runs, times the feature's log-count ratio between
toxic and other training texts; weights come from logistic loss with an L2 penalty. The score is linear in the words, so a word's part
is worked out once a task and a text is read once.

Trained on the driver from at most PER_CLASS labelled texts of each class (a documented bound); scored in one pass with
no shuffle; the weights, 2**BITS floats, are broadcast. Every row of docs is scored over its whole text. N, the penalty
and the number of steps were chosen among training rows only (crc32 modulo 5 of 1 against 2 to 4), by logistic loss.

Defined cases: a null text counts as empty; an empty text scores by the intercept; without training rows of both classes every score is
the share of label 1 among training labels (0 if none); repeated rows are scored each; an empty table gives an empty
result; further columns, whatever their names, are kept by toxicity_filter() and ignored by score_toxicity().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, whole
from .labels import held_out, sample

N, BITS, PER_CLASS, KNOWN = (2, 3, 4, 5, 6), 18, 2500, 500_000
#: Words, and bytes of words, whose n-grams are spelt out at once, so memory does not grow with a batch's new words, nor
#: with a word's length: a longer one is spelt in parts. Characters of words whose parts of the score a task remembers.
BLOCK, BYTES, KNOWN_CHARS = 16_384, 1 << 19, 1 << 24
AROUND = ".,;:!?\"'()[]{}<>*%$#&|-_=+/\\~`^@"
MIX = np.uint64(0x9E3779B97F4A7C15)


def blocks(words: list[str]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Words between boundary marks, in blocks: number, bytes, and how many of them an n-gram may begin at. A word of more
    than BYTES is cut into parts that overlap by an n-gram less one byte, so each of its n-grams begins in one part."""
    out: list[tuple[int, bytes, int]] = []
    size = 0
    for i, w in enumerate(words):
        data = f"\x02{w.strip(AROUND)}\x03".encode("utf-8", "surrogatepass")
        for at in range(0, len(data), BYTES):
            part = data[at : at + BYTES + max(N) - 1]
            if out and (size + len(part) > 2 * BYTES or len(out) >= BLOCK):
                yield out
                out, size = [], 0
            out.append((i, part, min(BYTES, len(data) - at)))
            size += len(part)
    if out:
        yield out


def grams(block: list[tuple[int, bytes, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of a block, and the number of the word each belongs to."""
    data = np.frombuffer(b"".join(d for _, d, _ in block), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(d) for _, d, _ in block], dtype=np.int64)
    owner = np.repeat(np.array([i for i, _, _ in block], dtype=np.int64), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    begins = left > np.repeat(size - np.array([n for _, _, n in block], dtype=np.int64), size)
    features, owners = [], []
    h = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(N) + 1):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(n)
        if n in N:
            inside = np.nonzero((left[: len(h)] >= n) & begins[: len(h)])[0]
            features.append(((h[inside] * MIX) >> np.uint64(64 - bits)).astype(np.int32))
            owners.append(owner[inside])
    return np.concatenate(features), np.concatenate(owners)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for block in blocks(words):
            features, owners = grams(block)
            first = block[0][0]
            part = np.bincount(owners - first, weights=self.weights[features], minlength=1)
            out[first : first + len(part)] += part
        return out


class Scorer:
    """Scores of texts; a word's part is worked out once a task, as long as it is remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.chars = model, {}, 0

    def score(self, texts: list[str]) -> np.ndarray:
        split = [set(t.lower().split()) for t in texts]
        new = list(set().union(*split).difference(self.known))
        self.chars += sum(map(len, new))
        if len(self.known) + len(new) > KNOWN or self.chars > KNOWN_CHARS:
            new = list(set().union(*split))
            self.known, self.chars = {}, sum(map(len, new))
        self.known.update(zip(new, self.model.of_words(new).tolist(), strict=True))
        of = self.known.__getitem__
        z = np.array([sum(map(of, sorted(x))) / max(len(x), 1) ** 0.5 for x in split]) + self.model.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], y: np.ndarray, rate: float, steps: int = 100, l2: float = 1e-4, smooth: float = 10.0, rate_of: float = 0.05) -> Model:
    """By gradient steps with momentum and per-weight scaling; classes weigh as the share of label 1 says."""
    if len(set(y.tolist())) < 2:
        odds = np.clip(rate, 1e-9, 1 - 1e-9)
        return Model(np.zeros(1 << BITS), float(np.log(odds / (1 - odds))))
    number: dict[str, int] = {}
    held = [np.array(sorted({number.setdefault(w, len(number)) for w in dict.fromkeys(t.lower().split())}), dtype=np.int64) for t in texts]
    doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
    word = np.concatenate(held) if held else np.empty(0, dtype=np.int64)
    norm = np.sqrt(np.maximum(np.array([len(x) for x in held]), 1))
    size, words = 1 << BITS, list(number)
    # n-grams' features and words: 8 bytes an n-gram are kept, the rest is a block's
    held_grams = [(f, o.astype(np.int32)) for f, o in map(grams, blocks(words))]

    def per_feature(of_word: np.ndarray) -> np.ndarray:
        return sum((np.bincount(f, weights=of_word[o], minlength=size) for f, o in held_grams), np.zeros(size))

    def per_word_of(of_feature: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for f, o in held_grams:
            if len(o):
                part = np.bincount(o - o.min(), weights=of_feature[f])
                out[o.min() : o.min() + len(part)] += part
        return out

    per_word = [np.bincount(word[y[doc] == c], minlength=len(number)) for c in (0, 1)]
    low, high = (per_feature(n) for n in per_word)
    share_high, share_low = high.sum() / (high.sum() + low.sum()), low.sum() / (high.sum() + low.sum())
    # smoothed by the classes' own sizes, so a feature that was never seen has ratio 0
    ratio = np.log((high + smooth * share_high) / (low + smooth * share_low)) - np.log(share_high / share_low)
    share = np.array([(1 - rate) / max((y == 0).sum(), 1), rate / max((y == 1).sum(), 1)])[y]
    share /= share.sum()
    w, b = np.zeros(size), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        of_word = per_word_of(w * ratio)
        z = np.bincount(doc, weights=of_word[word], minlength=len(held)) / norm + b
        slope = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        down = np.bincount(word, weights=(slope / norm)[doc], minlength=len(number))
        g = per_feature(down) * ratio + l2 * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= rate_of * (m / a) / (np.sqrt(v / c) + 1e-6)
        b -= rate_of * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return Model(w * ratio, b)


def _scores(model: Model, rows: DataFrame) -> DataFrame:
    """rows (keep, t) with score instead of t."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scorer.score(batch.column("t").to_pylist()))], names=["id", "score"])

    return rows.mapInArrow(run, "id long, score double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    return train(*sample(docs, labels, label, per_class, id_col, text_col, lambda t: " ".join(sorted(set(t.lower().split())))))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted."""
    model = fit(docs, labels, label, id_col, text_col, per_class)
    scored = _scores(model, docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("t")))
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least threshold, all columns; one pass, no shuffle."""
    model = fit(docs, labels, label, id_col, text_col, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small(batches):
            yield batch.filter(pa.array(scorer.score([t or "" for t in batch.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
