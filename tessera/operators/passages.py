"""Texts that hold passages whole: found by the rarest of some byte runs of a passage, made sure by a digest of all of it.

Texts are read where they lie, in two passes: one counts the texts that have the runs, one looks for each passage's rarest
run and digests the bytes around it. No text is shuffled, and what leaves a task is a row a text and passage it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of a run: the widest that fits the passage.
WIDTHS = (24, 8, 3)
#: Runs counted of a passage, and distinct passages a pass over the texts (more passages take more passes).
PLACES, FEW = 16, 50_000
#: Bytes looked at in one go, and bits of the table that says which codes may be wanted.
_PART, _BITS = 1 << 20, 22
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def codes(data: np.ndarray, width: int) -> np.ndarray:
    """A number a place at which a run of so many bytes begins: the bytes themselves, or a mixture of 24."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width == 3:
        x = data.astype(np.uint64)
        return x[:n] | (x[1 : n + 1] << np.uint64(8)) | (x[2:] << np.uint64(16))
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return eight[:n].copy() if width == 8 else eight[:n] * _M[0] + eight[8 : n + 8] * _M[1] + eight[16:] * _M[2]


@dataclass
class Wanted:
    """Codes of one width, each once and in order; per code the passages filed under it."""

    width: int
    codes: np.ndarray
    filed: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.may = np.zeros(1 << _BITS, bool)
        self.may[self.slot(self.codes)] = True

    def slot(self, x: np.ndarray) -> np.ndarray:
        return (x * _M[0]) >> np.uint64(64 - _BITS)

    def found(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in data and the numbers of the codes there, part by part."""
        for start in range(0, len(data) - self.width + 1, _PART):
            x = codes(data[start : start + _PART + self.width - 1], self.width)
            at = np.nonzero(self.may[self.slot(x)])[0]
            x = x[at]
            k = np.minimum(np.searchsorted(self.codes, x), len(self.codes) - 1)
            same = self.codes[k] == x
            yield at[same] + start, k[same]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one after the other, and where each begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rows(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, "right") - 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, size, place, width and code of some runs of each passage, spread evenly over it."""
    for batch in batches:
        data, bounds = _bytes(batch.column("t"))
        out = []
        for key, a, b in zip(batch.column("key").to_pylist(), bounds[:-1], bounds[1:], strict=True):
            width = next(w for w in WIDTHS if w <= b - a)
            for p in np.unique(np.linspace(0, b - a - width, PLACES).astype(int)).tolist():
                out.append((key, int(b - a), p, width, int(codes(data[a + p : a + p + width], width).view(np.int64)[0])))
        yield pa.RecordBatch.from_pylist([dict(zip(_RUN.names, r, strict=True)) for r in out], _RUN)


_RUN = pa.schema([("key", pa.binary()), ("size", pa.int64()), ("at", pa.int64()), ("width", pa.int32()), ("code", pa.int64())])


def _filed(runs: dict[str, np.ndarray], own: np.ndarray) -> list[Wanted]:
    """The runs' codes by width; own: a number a run, to be filed under its code."""
    out = []
    for width in WIDTHS:
        mine = np.nonzero(runs["width"] == width)[0]
        if len(mine):
            distinct, k = np.unique(runs["code"][mine], return_inverse=True)
            filed: list[list[int]] = [[] for _ in distinct]
            for i, x in zip(k.tolist(), own[mine].tolist(), strict=True):
                filed[i].append(x)
            out.append(Wanted(width, distinct, filed))
    return out


def held(keyed: DataFrame, hay: DataFrame, text: str) -> DataFrame:
    """hay without its text, with _key, a row for each row whose text holds the passage t of that key (sha-256 of t).

    keyed: key, t, at most FEW rows of distinct keys and 3 bytes or more.
    """
    sc = hay.sparkSession.sparkContext
    table = keyed.select("key", "t").mapInArrow(_runs, "key binary, size long, at long, width int, code long").toArrow()
    runs = {c: table.column(c).to_numpy() for c in ("size", "at", "width", "code")}
    runs["code"] = runs["code"].view(np.uint64)
    keys, number = np.unique(np.array(table.column("key").to_pylist(), dtype=object), return_inverse=True)
    hay = hay.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    rest = [c for c in hay.columns if c != text]
    out = StructType([*hay.select(*rest).schema.fields, StructField("_key", BinaryType())])
    if not len(keys):
        return hay.select(*rest, F.lit(None).cast("binary").alias("_key")).limit(0)

    all_ = sc.broadcast(_filed(runs, number))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(w.codes), np.int64) for w in all_.value]
        for batch in batches:
            data, bounds = _bytes(batch.column(0))
            for w, total in zip(all_.value, n, strict=True):
                pairs = [np.zeros(0, np.int64)]
                for at, k in w.found(data):
                    row = _rows(bounds, at)
                    whole = at + w.width <= bounds[row + 1]
                    pairs.append(np.unique(row[whole] * len(total) + k[whole]))
                total += np.bincount(np.unique(np.concatenate(pairs)) % len(total), minlength=len(total))
        for w, total in zip(all_.value, n, strict=True):
            some = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), w.width, np.int32)), pa.array(w.codes[some].view(np.int64)), pa.array(total[some])], names=["width", "code", "n"])

    counted = hay.select(text).mapInArrow(count, "width int, code long, n long").groupBy("width", "code").agg(F.sum("n").alias("n")).toArrow()
    texts = dict(zip(zip(counted.column("width").to_pylist(), counted.column("code").to_pylist(), strict=True), counted.column("n").to_pylist(), strict=True))
    # the price of a run: texts that have it, times passages filed under it; a passage with a run that no text has is nowhere
    of = list(zip(runs["width"].tolist(), runs["code"].view(np.int64).tolist(), strict=True))
    shared: dict[tuple[int, int], int] = {}
    for c in of:
        shared[c] = shared.get(c, 0) + 1
    price = np.array([texts.get(c, 0) * shared[c] for c in of], dtype=np.int64)
    order = np.lexsort((runs["at"], price, number))
    first = order[np.unique(number[order], return_index=True)[1]]
    first = first[price[first] > 0]
    if not len(first):
        return hay.select(*rest, F.lit(None).cast("binary").alias("_key")).limit(0)
    chosen = {c: v[first] for c, v in runs.items()}
    rare = sc.broadcast((_filed(chosen, np.arange(len(first))), [keys[i] for i in number[first]], chosen["at"].tolist(), chosen["size"].tolist()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, key, place, size = rare.value
        for batch in batches:
            data, bounds = _bytes(batch.column(text))
            seen: dict[tuple[int, int], None] = {}
            for w in wanted:
                for at, k in w.found(data):
                    row = _rows(bounds, at)
                    for p, r, low, high, c in zip(at.tolist(), row.tolist(), bounds[row].tolist(), bounds[row + 1].tolist(), k.tolist(), strict=True):
                        for i in w.filed[c]:
                            a = p - place[i]
                            if a >= low and a + size[i] <= high and (r, i) not in seen and sha256(data[a : a + size[i]]).digest() == key[i]:
                                seen[r, i] = None
            got = batch.take(pa.array([r for r, _ in seen], pa.int64())).select(rest)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([key[i] for _, i in seen], pa.binary())], names=[*rest, "_key"])

    return hay.mapInArrow(find, out)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
