"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A batch's new units are concatenated and indexed by a suffix array (suffixes compared up to the longest piece). Every
piece of the model is looked up by binary search; its range of suffixes gives its occurrences, each an edge from where
it begins to where it ends. The edges are sorted by position and relaxed: the prefix of a unit that ends at a position
has exactly one BPE encoding, whose last piece is the edge that is compatible with the last piece of the prefix before
it (two pieces are compatible if BPE merges their concatenation into just them). A character that is no piece becomes
its UTF-8 bytes' pieces.

Units are what no piece reaches across: a run of spaces with the word after it, cut again between characters that stand
together in no piece; a line feed where no piece has one. A worker remembers up to KNOWN units with KNOWN_CHARS
characters, so a text is mostly looked up. At most SLICE bytes are indexed at once: a longer unit is matched slice after
slice, each with as many bytes before it as the longest piece has, and relaxed across them.

Decoding joins the pieces, bytes included, turns the space sign into a space and drops the space that encoding put first;
bytes that are no UTF-8 become U+FFFD, one each, as the library has it. A model with user-defined pieces is refused: the
library matches those before any merge.

Defined cases: a null text counts as empty, and an empty text has no ids; the space sign U+2581 in a text is a space, as
the model treats it; rows repeated are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, whole

SPACE, KNOWN, KNOWN_CHARS, BATCH, SLICE = "▁", 500_000, 1 << 24, 65_536, 1 << 20
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


codecs.register_error("tessera_fffd", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@dataclass
class Model:
    """Pieces of a BPE model."""

    data: bytes
    pieces: list[str] = field(default_factory=list)
    rank: dict[str, float] = field(default_factory=dict)  # lower merges first
    number: dict[str, int] = field(default_factory=dict)
    byte: dict[int, int] = field(default_factory=dict)
    unknown: int = 0

    def __post_init__(self) -> None:
        for i, (_, body) in enumerate(x for x in _fields(self.data) if x[0] == 1):
            f = dict(_fields(body))
            piece, score, kind = f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)
            self.pieces.append(piece)
            if kind == BYTE:
                self.byte[int(piece[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind == USER:
                raise ValueError("user-defined pieces are not supported")
            elif kind == NORMAL:
                self.number[piece] = i
                self.rank[piece] = -score

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: merge the best pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(np.inf, 0))
            if best == np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spelt(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]


class Matcher:
    def __init__(self, data: bytes):
        self.model = Model(data)
        self.order = sorted(self.model.number)  # match numbers, by piece
        coded = [p.encode() for p in self.order]
        self.bytes = np.array([len(p) for p in coded])
        self.width = -(-int(self.bytes.max()) // 8) if coded else 1
        pad = lambda p, with_: (p + with_ * (8 * self.width))[: 8 * self.width]
        self.low = np.array([np.frombuffer(pad(p, b"\0"), dtype=">u8") for p in coded], dtype=np.uint64)
        self.high = np.array([np.frombuffer(pad(p, b"\xff"), dtype=">u8") for p in coded], dtype=np.uint64)
        self.ids = np.array([self.model.number[p] for p in self.order], dtype="<u4")
        self.fits: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chars = 0
        self.together = {two for p in self.order for two in zip(p, p[1:], strict=False)}
        line = "\n" in {c for p in self.order for c in p}
        self.split = re.compile(r" *[^ ]+| +" if line else r" *[^ \n]+| +|\n").findall

    def _fit(self, key: int) -> bool:
        """Whether the matches key // n and key % n of n are compatible; remembered."""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        x, y = (self.order[i] for i in divmod(key, len(self.order)))
        ok = self.fits[key] = self.model.merged(x + y) == [x, y]
        return ok

    def cut(self, unit: str) -> list[str]:
        """unit between characters that stand together in no piece: no merge reaches across."""
        together = self.together
        if all(map(together.__contains__, zip(unit, unit[1:], strict=False))):
            return [unit]
        out, at, same = [], 0, {}
        for i, two in enumerate(zip(unit, unit[1:], strict=False), 1):
            if two not in together:
                out.append(same.setdefault(unit[at:i], unit[at:i]))
                at = i
        return [*out, unit[at:]]

    def occurrences(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces stand in data: positions, match numbers."""
        size = len(data)
        text = np.frombuffer(data + b"\0" * (8 * self.width), dtype=np.uint8)
        keys = []
        for k in range(self.width):
            key = np.zeros(size, dtype=np.uint64)
            for i in range(8):
                key = (key << np.uint64(8)) | text[8 * k + i : 8 * k + i + size].astype(np.uint64)
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        first = keys[0][suffixes]
        low, high = np.searchsorted(first, self.low[:, 0], "left"), np.searchsorted(first, self.high[:, 0], "right")
        for p in np.nonzero((self.bytes > 8) & (low < high))[0]:  # the rest of a longer piece, within the range of its beginning
            a, b = low[p], high[p]
            for k in range(1, -(-int(self.bytes[p]) // 8)):
                rest = keys[k][suffixes[a:b]]
                a, b = a + np.searchsorted(rest, self.low[p, k], "left"), a + np.searchsorted(rest, self.high[p, k], "right")
                if a >= b:
                    break
            low[p], high[p] = a, max(a, b)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        at = suffixes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return at, which

    def matches(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """Begin, end and match number of all pieces in data, by end and then begin."""
        reach = int(self.bytes.max()) if len(self.bytes) else 0
        for low in range(0, len(data), SLICE):
            first = max(0, low - reach)
            at, which = self.occurrences(data[first : low + SLICE])
            end = at + self.bytes[which]
            own = end > low - first  # those that end before are of the slice before
            at, end, which = at[own] + first, end[own] + first, which[own]
            order = np.lexsort((at, end))
            yield from zip(at[order].tolist(), end[order].tolist(), which[order].tolist(), strict=True)

    def encode_units(self, units: list[str]) -> list[bytes]:
        coded = [u.encode("utf-8", "surrogatepass") for u in units]
        size = np.array([len(c) for c in coded], dtype=np.int64)
        begin = np.cumsum(size + 1) - size - 1
        # by position in the text: the match that ends there (-1 where a unit begins, -2 for a character that is no piece, -9 none), and where that begins
        places = int(size.sum()) + len(units) + 1
        last, came = array("i", [-9]) * places, array("q", [0]) * places
        for b in begin.tolist():
            last[b] = -1
        # characters that are no piece are edges as well, met in the same order
        loose = sorted((b + off, b + off + n) for c, b, u in zip(coded, begin.tolist(), units, strict=True) for off, n in self._loose(u, c))
        k, fits, fit, kinds = 0, self.fits, self._fit, len(self.order)
        for s, e, w in self.matches(b"\0".join(coded) + b"\0"):
            while k < len(loose) and loose[k][1] <= e:
                if last[loose[k][0]] != -9:
                    last[loose[k][1]], came[loose[k][1]] = -2, loose[k][0]
                k += 1
            before = last[s]
            if before != -9 and last[e] == -9:
                if before >= 0:
                    key = before * kinds + w
                    ok = fits.get(key)
                    if not (fit(key) if ok is None else ok):
                        continue
                last[e], came[e] = w, s
        for s, e in loose[k:]:
            if last[s] != -9:
                last[e], came[e] = -2, s
        out = []
        ids = self.ids.tolist()
        for b, n, u in zip(begin.tolist(), size.tolist(), coded, strict=True):
            path, to = array("I"), b + n
            while to > b:
                w, s = last[to], came[to]
                if w >= 0:
                    path.append(ids[w])
                else:
                    path.extend(reversed(self.model.spelt(u[s - b : to - b].decode("utf-8", "surrogatepass"))))
                to = s
            out.append(np.array(path[::-1], dtype="<u4").tobytes())
        return out

    def _loose(self, unit: str, coded: bytes) -> list[tuple[int, int]]:
        number = self.model.number
        if all(c in number for c in unit):
            return []
        out, off = [], 0
        for c in unit:
            n = len(c.encode("utf-8", "surrogatepass"))
            if c not in number:
                out.append((off, n))
            off += n
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes."""
        split = [self.split(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.units) > KNOWN or self.chars > KNOWN_CHARS:
            self.units, self.chars = {}, 0
            self.parts = {}
        new = list(set().union(*split).difference(self.units))
        self.chars += sum(map(len, new))
        cuts = [self.cut(u.replace(" ", SPACE)) for u in new]
        if len(self.parts) > KNOWN:
            self.parts = {}
        own, size = [], 0
        for part in {p for c in cuts for p in c}.difference(self.parts):
            if own and (len(own) >= BATCH or size + len(part) > SLICE):
                self.parts.update(zip(own, self.encode_units(own), strict=True))
                own, size = [], 0
            own.append(part)
            size += len(part)
        if own:
            self.parts.update(zip(own, self.encode_units(own), strict=True))
        get = self.parts.__getitem__
        self.units.update((u, b"".join(map(get, c))) for u, c in zip(new, cuts, strict=True))
        return [b"".join(map(self.units.__getitem__, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        back = self.__dict__.get("back")
        if back is None:
            back = self.back = {i: p.encode() for i, p in enumerate(self.model.pieces) if p in self.model.number} | {i: bytes([b]) for b, i in self.model.byte.items()}
        text = b"".join(back.get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "tessera_fffd").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def matcher(data: bytes) -> Matcher:
    """One a worker process, kept from task to task with what it has learnt."""
    kept = sys.__dict__.setdefault("_tessera_matchers", {})
    key = hash(data)
    if key not in kept:
        kept.clear()
        kept[key] = Matcher(data)
    return kept[key]


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_pieces, ids_crc32, round_trip (decoding gives the text), ids (empty without with_ids).

    model: the content of a sentencepiece model file of type BPE, without normalisation rules."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for batch in small(batches, 1024):  # a batch's new units share one index
            texts = batch.column("t").to_pylist()
            ids = m.encode(texts)
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([_same(m, x, t) for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                pa.array([x if with_ids else b"" for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_pieces", "ids_crc32", "round_trip", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("t")).mapInArrow(run, "id long, n_pieces long, ids_crc32 long, round_trip boolean, ids binary").withColumnRenamed("id", id_col)


def _same(m: Matcher, ids: bytes, text: str) -> bool:
    return m.decode(ids) == text.replace(SPACE, " ")


def decode_pieces(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of rows with ids (little-endian unsigned 32-bit; null as none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([m.decode(x or b"") for x in batch.column("x").to_pylist()], pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("x")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
