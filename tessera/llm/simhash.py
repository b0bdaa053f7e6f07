"""SimHash fingerprints, and near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most RADIUS = 3 of 64 bits agree fully on two of five blocks of bits, for some choice
of the two; each distinct fingerprint is therefore filed under ten keys, one a pair of blocks, and every link has its
two ends under a common key. A task walks its keys in order, in tiles of TILE fingerprints. A tile is held as 64 bit
planes, a word of a plane having a bit of 64 fingerprints; the planes are compared with a whole tile of fingerprints
at once, the differences are added by carry-save steps to counters of two bit planes and a plane for 'over three', and
the pair of tiles is abandoned when every pair in it is over. Of the links found only a spanning forest leaves a task,
so a dense group of n fingerprints gives n - 1 rows.

A key with more than HOT fingerprints is filed again under four finer keys (with three differences in the other bits,
one of four parts of all bits agrees), and so on until no key has more, so no link is lost and no task compares a larger
group. Equal fingerprints, however many rows hold them, are one node.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; rows
with a null id link like any other, and have the smallest id of their component (null if none of it has an id); rows that
share an id but not their text are linked each by its own text; repeated rows are returned each; an empty table gives an
empty result; other columns are ignored. keep_one() orders the rows of a component by id (nulls last), fingerprint and
SHA-256 of the text, keeps the first and drops the others, repeated rows too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, settle, small, whole
from .graph import components

RADIUS = 3
TILE = 256
HOT = 8192
SHINGLE = 3
#: Five blocks of bits, as bit ranges.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Of one text; bit set if set in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """id, fp (signed long), sig (the first 64 bits of the text's SHA-256) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("t").to_pylist()
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            sigs = [int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps), pa.array(sigs, pa.int64())], names=["id", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("t")).mapInArrow(run, "id long, fp long, sig long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of word i // 64 of plane b."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -bits.shape[1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")).view(np.uint64)


def close_pairs(left: np.ndarray, right: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left, in right) of pairs that differ in at most radius (0 to 3) bits; sliced: planes(right)."""
    n, words = len(left), sliced.shape[1]
    ones, twos, over = (np.zeros((n, words), dtype=np.uint64) for _ in range(3))
    last = np.uint64((1 << (len(right) % 64)) - 1) if len(right) % 64 else ~np.uint64(0)
    over[:, -1] = ~last  # padding counts as over from the start
    full = ~np.uint64(0)
    live = np.arange(n)
    for bit in range(64):
        mask = (np.uint64(0) - ((left[live] >> np.uint64(bit)) & np.uint64(1)))[:, None]
        differ = sliced[bit][None, :] ^ mask
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            open_rows = (over != full).any(axis=1)
            if not open_rows.any():
                return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            if open_rows.mean() < 0.5:  # rows of the tile that are all over are abandoned
                live, ones, twos, over = live[open_rows], ones[open_rows], twos[open_rows], over[open_rows]
    near = ~over  # at most three; the counters tell how many
    if radius < 3:
        near &= ~(ones & twos)
    if radius < 2:
        near &= ~twos
    if radius < 1:
        near &= ~ones
    hit = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
    i, j = np.nonzero(hit)
    return live[i], j


class Forest:
    """Union-find over row identifiers; joined() says whether a link is new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joined(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def forest_of(key: np.ndarray, fp: np.ndarray, node: np.ndarray, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows with a common key; rows come sorted by key."""
    alone = np.ones(len(key), dtype=bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    key, fp, node = key[~alone], fp[~alone], node[~alone]
    found, edges = Forest(), []
    cuts = range(0, len(key), tile)
    sliced: dict[int, np.ndarray] = {}
    for at in cuts:
        left = fp[at : at + tile]
        sliced = {k: v for k, v in sliced.items() if k >= at}
        for to in range(at, len(key), tile):
            if key[to] > key[min(at + tile, len(key)) - 1]:
                break
            right = fp[to : to + tile]
            if to not in sliced and len(sliced) < 4096:  # a long run of one key keeps its planes, a megabyte a thousand
                sliced[to] = planes(right)
            i, j = close_pairs(left, right, sliced[to] if to in sliced else planes(right))
            if to == at:
                i, j = i[(ok := i < j)], j[ok]
            for x, y in zip(node[at + i].tolist(), node[to + j].tolist(), strict=True):
                if found.joined(x, y):
                    edges.append((x, y))
    return edges


def _masks() -> list[int]:
    span = [((1 << (b - a)) - 1) << a for a, b in BLOCKS]
    return [span[i] | span[j] for i, j in combinations(range(len(BLOCKS)), 2)]


def _parts(level: int, n: int = 4) -> list[int]:
    """All bits in n parts, others on every level."""
    bits = np.random.RandomState(level).permutation(64).tolist()
    return [sum(1 << b for b in bits[i::n]) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def filed(reps: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, key: each fingerprint under its keys; no key has more than hot of them (or no bit is left to tell them apart).
    reps: fp (distinct)."""

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))

    rows = keyed(reps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in _masks()])).alias("mask")))
    done = None
    for level in range(64):
        crowded = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"))
        if crowded.isEmpty():
            break
        # a hot key has a row here; Spark broadcasts them if they are few
        light, heavy = rows.join(crowded, "key", "left_anti"), rows.join(crowded, "key", "left_semi")
        done = light.select("fp", "key") if done is None else done.unionByName(light.select("fp", "key"))
        finer = F.explode(F.array(*[F.lit(_signed(p)) for p in _parts(level)])).alias("part")
        rows = settle(keyed(heavy.select("fp", "mask", finer).select("fp", F.col("mask").bitwiseOR(F.col("part")).alias("mask")).distinct()))
        if rows.filter("mask != -1").isEmpty():
            break
    return rows.select("fp", "key") if done is None else done.unionByName(rows.select("fp", "key"))


def links(reps: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: a spanning forest of each task's links between fingerprints. reps: fp (distinct)."""
    rows = filed(reps, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            key, fp = (t.column(n).to_numpy() for n in ("key", "fp"))
            edges = forest_of(key, fp.view(np.uint64), fp)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])

    n = 4 * partitions(reps.sparkSession)  # a task holds 16 bytes for each of its rows
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, root (one fingerprint of its component), component_id (the component's smallest id). rows: id, fp."""
    reps = settle(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(reps.select("fp"), hot)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    linked = reps.join(found, "fp")  # fingerprints with a link only
    ids = linked.groupBy("root").agg(F.min("least").alias("of"))
    known = linked.join(ids, "root").select("fp", "root", F.col("of").alias("component_id"), F.lit(True).alias("linked"))
    known = reps.join(known, "fp", "left")
    return known.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id_col, fp (signed long), component_id (smallest id reachable by links)."""
    rows = settle(fingerprints(docs, id_col, text_col, width).select("id", "fp"))
    return rows.join(classes(rows, hot), "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """docs with one row of each component, all columns; the texts move once."""
    rows = settle(fingerprints(docs, id_col, text_col, width))
    order = F.struct(F.col("id").isNull().alias("late"), "id", "fp", "sig")
    # the first row of each fingerprint, then of each component: however many rows share a fingerprint, they meet in aggregates only
    heads = rows.groupBy("fp").agg(F.min(order).alias("at")).join(classes(rows, hot).select("fp", "root"), "fp")
    first = settle(heads.groupBy("root").agg(F.min("at").alias("at")).select("at.id", "at.sig"))
    many = rows.groupBy("id", "sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "sig")
    names = docs.columns
    keys = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.conv(F.substring(F.sha2(whole(text_col), 256), 1, 16), 16, -10).cast("long").alias("_sig"))
    same = lambda right: keys["_id"].eqNullSafe(right["id"]) & (keys["_sig"] == right["sig"])
    kept = keys.join(first, same(first), "left_semi")
    again = settle(many)
    if not again.isEmpty():  # rows repeated under one id and text
        alike = kept.join(again, same(again), "left_semi").dropDuplicates(["_id", "_sig"])
        kept = kept.join(again, same(again), "left_anti").unionByName(alike)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
