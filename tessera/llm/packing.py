"""Hierarchical multi-length packing.

Context tiers are powers of two up to the longest. Each document is cut into full windows of the longest tier and a
rest; the rest is routed to the smallest tier that holds it. Tiers are packed from long to short: each rest opens a
window of its tier, and the gap is filled with the longest rests of shorter tiers that fit, then by the head of one
more rest, cut to measure if the gap is at least CUT ids; so a window ends at its tier's length exactly. When
rests run out, what the unfinished windows hold is cut into windows of powers of two, the last of them shorter than the
shortest tier; no window is padded. The shortest tier is filled one document after the other. Windows are dealt to step groups of
equal length and like attention cost: in descending order of the sum of squared piece lengths, to and fro.

One pass: texts are read, encoded and packed in one task and nothing is shuffled; a task holds at most HELD ids at a
time, so long or many documents only mean more rounds. A task computes the same pieces when it is run again.

Encoding is the tokenizer's own, per run of non-space characters: its rules drop white space and never look across it,
so the ids of a text are those of its runs; a worker remembers up to KNOWN runs and pieces of runs with KNOWN_CHARS
characters, and those of the BLOCK at hand. What stands for one of the tokenizer's added tokens in a text is that token, as
the tokenizer has it by default; the text around it is encoded by itself.

Defined cases: a null or empty text is a document with the end id only; rows are documents, repeated or not; ids are
carried as they are, null too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, whole

LONGEST, SHORTEST, CUT = 2048, 256, 32
#: Ids that a task gathers before it packs, runs of characters whose ids it remembers, and characters it encodes at once.
HELD, KNOWN, KNOWN_CHARS, BLOCK = 4_000_000, 500_000, 1 << 24, 1 << 22
GROUP = 64


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, by the tokenizer.

    The fast way holds for texts of ASCII and accented Latin letters (PLAIN): there the tokenizer's normaliser is lower(),
    and its pieces are those of PIECE. Pieces are encoded in bulk by the same BPE model, whose ids say where a piece ends.
    Other texts are encoded run by run, or as a whole if they have characters that split() takes for white space and the
    tokenizer may not. A tokenizer with other rules than RULES encodes all texts as a whole.
    """

    #: The normaliser's steps, the splitting pattern and the end of a word that the fast way holds for.
    RULES = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>")

    ODD = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]").search
    UNSPLIT = re.compile("[\x1c-\x1f]").search
    PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|\n|[^\\sa-z0-9\xdf-\xf6\xf8-\u017f]+").findall
    #: Stands for the end of a run; no id has these bytes.
    MARK = b"\xff\xff\xff\xff"

    def __init__(self, text: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_str(text), Tokenizer.from_str(text)
        self.known_rules = self._rules(json.loads(text)) == self.RULES
        self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.runs: dict[str, bytes] = {"\n": self.MARK}
        self.odd: dict[str, bytes] = {}
        self.chars = 0
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        #: Found in a text as they are, wherever they stand; others, with rules of their own, have the text encoded as one.
        self.bare_added = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", re.NOFLAG if self.bare_added else re.IGNORECASE)

    @staticmethod
    def _rules(held: dict) -> tuple:
        steps = (held.get("normalizer") or {}).get("normalizers") or []
        split = ((held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return [x.get("type") for x in steps], (split.get("pattern") or {}).get("Regex"), held["model"].get("end_of_word_suffix")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        """A piece is a run too, of itself only."""
        for at in range(0, len(new), 65536):
            chunk = new[at : at + 65536]
            got = self.bare.encode_batch([" ".join(chunk[i : i + 512]) for i in range(0, len(chunk), 512)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in got])
            stops = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(stops) != len(chunk):
                raise ValueError("the tokenizer does not mark the ends of its pieces")
            data = ids.tobytes()
            self.runs.update((x, data[i:j]) for x, i, j in zip(chunk, [0, *stops], stops, strict=False))

    def _learn_runs(self, new: list[str]) -> None:
        found = self.PIECE("\n".join(new))
        if missing := list(set(found).difference(self.runs)):
            self._learn_pieces(missing)
        self.runs.update(zip(new, b"".join(map(self.runs.__getitem__, found)).split(self.MARK), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.added:
            return self._plain(texts)
        at = {i for i, t in enumerate(texts) if self.at_added.search(t)}
        if not at:
            return self._plain(texts)
        if not self.bare_added:
            rest = iter(self._plain([t for i, t in enumerate(texts) if i not in at]))
            return [self._whole([t])[0] if i in at else next(rest) for i, t in enumerate(texts)]
        split = [self.at_added.split(t) if i in at else [t] for i, t in enumerate(texts)]  # text, token, text, ...
        rest = iter(self._plain([x for parts in split for x in parts[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(rest) for k, x in enumerate(parts)) for parts in split]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Of texts without added tokens."""
        if not self.known_rules:
            return self._whole(texts)
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < BLOCK:
                size += len(texts[end])
                end += 1
            out += self._block(texts[at:end])
            at = end
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not self.ODD(t)]
        split = [texts[i].lower().split() for i in plain]
        distinct = set().union(*split)
        missing = distinct.difference(self.runs)
        self.chars += sum(map(len, missing))
        if len(self.runs) + len(missing) > KNOWN or self.chars > KNOWN_CHARS:
            self.runs, missing, self.chars = {"\n": self.MARK}, distinct, sum(map(len, distinct))
        if missing:
            self._learn_runs(list(missing))
        get = self.runs.__getitem__
        for i, x in zip(plain, split, strict=True):
            out[i] = b"".join(map(get, x))
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self._by_run(t)
        return out

    def _by_run(self, text: str) -> bytes:
        if self.UNSPLIT(text):
            return self._whole([text])[0]
        split = text.split()
        if new := list(set(split).difference(self.odd)):
            if len(self.odd) + len(new) > KNOWN // 4:
                self.odd = {}
                new = list(set(split))
            self.odd.update(zip(new, self._whole(new), strict=True))
        return b"".join(map(self.odd.__getitem__, split))


def encoder(text: str) -> Encoder:
    """One a worker process, kept from task to task with what it has learnt."""
    kept = sys.__dict__.setdefault("_tessera_encoders", {})
    key = hash(text)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(text)
    return kept[key]


class Rests:
    """Pieces by length: the longest that fits, the shortest that does not."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []  # sorted; no more than a window has places

    def add(self, n: int, d: int, at: int) -> None:
        if n not in self.of:
            self.of[n] = []
            insort(self.lengths, n)
        self.of[n].append((d, at))

    def take(self, place: int) -> tuple[int, int, int]:
        """Length, document and start of a piece of lengths[place]."""
        n = self.lengths[place]
        own = self.of[n]
        d, at = own.pop()
        if not own:
            del self.of[n], self.lengths[place]
        return n, d, at


class Packer:
    """Packs pieces (row, start, ids as bytes) into windows of the tiers."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST, cut: int = CUT):
        self.tiers = [1 << b for b in range(longest.bit_length() - 1, shortest.bit_length() - 2, -1)]
        self.longest, self.cut = longest, cut

    def pack(self, docs: list[tuple[int, bytes]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Windows: tier, and pieces (document, start, length). docs: number, ids."""
        windows: list[tuple[int, list[tuple[int, int, int]]]] = []
        rests = Rests()
        for d, ids in docs:
            n, at = len(ids) // 4, 0
            while n - at >= self.longest:
                windows.append((self.longest, [(d, at, self.longest)]))
                at += self.longest
            if n > at:
                rests.add(n - at, d, at)
        for tier in self.tiers:
            floor = tier // 2 if tier != self.tiers[-1] else 0
            while rests.lengths and rests.lengths[-1] > floor:
                n, d, at = rests.take(-1)
                pieces, room = [(d, at, n)], tier - n
                while room and rests.lengths:
                    i = bisect_right(rests.lengths, room) - 1
                    fits = rests.lengths[i] if i >= 0 else 0
                    if fits and (fits == room or room < self.cut or fits > room // 2 or i == len(rests.lengths) - 1):
                        n, d, at = rests.take(i)
                        take = n
                    elif room >= self.cut or not fits and tier == self.tiers[-1]:
                        n, d, at = rests.take(i + 1)  # the shortest that is longer than the gap: its head fills it
                        take = room
                    else:
                        n, d, at = rests.take(0)  # less than a cut is left: the shortest document gives its head
                        take = min(n, room)
                    pieces.append((d, at, take))
                    room -= take
                    if n > take:
                        rests.add(n - take, d, at + take)
                windows.append((tier, pieces))
        return self._closed(windows)

    def _closed(self, windows: list[tuple[int, list[tuple[int, int, int]]]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """windows, with what lies in windows that ran out of rests dealt to windows of powers of two, so nothing is padded."""
        full = [w for w in windows if sum(p[2] for p in w[1]) == w[0]]
        left = deque(p for w in windows if sum(p[2] for p in w[1]) < w[0] for p in w[1])
        total = sum(p[2] for p in left)
        while total:
            size = room = min(self.longest, 1 << (total.bit_length() - 1))
            pieces = []
            while room:
                d, at, n = left.popleft()
                take = min(n, room)
                pieces.append((d, at, take))
                room -= take
                if n > take:
                    left.appendleft((d, at + take, n - take))
            full.append((size, pieces))
            total -= size
        return full


def groups(costs: list[tuple[int, int]], size: int = GROUP) -> list[int]:
    """A step group for each window (context, cost): windows of one context, size a group, of like total cost."""
    out = [0] * len(costs)
    first = 0
    for context in sorted({c for c, _ in costs}, reverse=True):
        own = sorted((i for i, c in enumerate(costs) if c[0] == context), key=lambda i: (-costs[i][1], i))
        n = -(-len(own) // size)
        for k, i in enumerate(own):
            turn, at = divmod(k, n)
            out[i] = first + (n - 1 - at if turn % 2 else at)
        first += n
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, shortest: int = SHORTEST, with_ids: bool = True) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group, ids.

    ids: the piece's, as little-endian unsigned 32-bit integers; empty without with_ids. tokenizer: the JSON text of a tokenizers file. A window of sequence_id is `context` ids long, a power of two.
    """
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long, ids binary"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).batch, Packer(longest, shortest)
        base = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        n_held, next_sequence, next_group = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, next_sequence, next_group
            windows = packer.pack([(i, ids) for i, (_, ids) in enumerate(held)])
            contexts = [t for t, _ in windows]
            group = groups([(c, sum(x[2] ** 2 for x in p)) for c, (_, p) in zip(contexts, windows, strict=True)])
            rows = []
            for w, ((_, pieces), context) in enumerate(zip(windows, contexts, strict=True)):
                offset = 0
                for d, at, n in pieces:
                    doc, ids = held[d]
                    part = ids[4 * at : 4 * (at + n)]
                    rows.append((doc, at, n, zlib.crc32(part), len(ids) // 4, base + next_sequence + w, offset, context, base + next_group + group[w], part if with_ids else b""))
                    offset += n
            next_sequence += len(windows)
            next_group += max(group, default=-1) + 1
            held, n_held = [], 0
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in small(batches):
            for doc, ids in zip(batch.column("id").to_pylist(), encode(batch.column("t").to_pylist()), strict=True):
                held.append((doc, ids + end))
                n_held += len(ids) // 4 + 1
            if n_held >= HELD:
                yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
