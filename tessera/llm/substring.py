"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words. The index holds, for each window, the hash of one of its GRAM-word pieces: the
one whose hash is smallest, so equal windows are filed under equal hashes wherever they stand, and neighbouring
windows mostly share theirs (about one hash for seven words of text). Each batch of documents is filed as an immutable
run: its hashes are dealt to buckets by hash once, when the run is written, and sorted within a bucket. A new batch is
merge-joined with the runs of earlier batches bucket by bucket, with no further exchange, to find hashes seen before,
besides those that the batch repeats itself. Runs have levels: FAN_IN runs of a level are merged, bucket by bucket, into
one run of the next, so a hash is rewritten once a level. A manifest in the index's folder lists the runs; an index can be
opened again, and a later call reads the runs filed by earlier ones.

The hashes that repeat are candidates only. The windows filed under them are verified on their words: windows are
grouped by a 128-bit BLAKE2b digest of the words themselves, and all but the earliest of a group count as repeats. A
word is removed if a repeat covers it. What a hash shared by copies of one text would add is left out: copies are
recognised by the text's SHA-256, only the first goes through verification, and the rest lose every word that a window
covers.

Defined cases: a document is an id with a text. Documents are ordered by id; those that share an id with another text,
or have none (they come last), by their text's SHA-256, which also tells them apart. Rows repeated under one id and text
are one document and have the same result each. A null text counts as empty; a document of fewer than WINDOW words keeps
all its words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, partitions, settle, shared_folder, small, whole

WINDOW, GRAM, FAN_IN, BATCHES = 20, 8, 4, 6
#: Odd multiplier of the piece hash.
MIX = 0xA0761D6478BD642F
#: Windows whose words are digested at once.
BLOCK = 65_536
#: What names a document: 0 if it has an id and 1 if not, the id (or more of the digest), the first 64 bits of the text's SHA-256.
KEY = ["late", "id", "sig"]
INDEX = "hash long, late byte, id long, sig long, n byte"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def polynomial(h: np.ndarray, n: int, by: int) -> np.ndarray:
    """A hash of each n consecutive values, mixed."""
    size = len(h) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out *= np.uint64(by)
        out += h[i : i + size]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def filed_under(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The hash that each window is filed under, and all piece hashes."""
    pieces = polynomial(h, gram, MIX)
    return least(pieces, window - gram + 1), pieces


def document_key(doc: int | None, text: str) -> tuple[int, int, int]:
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    sig, more = (int.from_bytes(sha[i : i + 8], "big", signed=True) for i in (0, 8))
    return (1, more, sig) if doc is None else (0, doc, sig)


def key_columns(doc: Column, text: Column) -> list[Column]:
    """document_key(), and the next 64 bits of the SHA-256 as `more`."""
    sha = F.sha2(text, 256)
    bits = lambda at: F.conv(F.substring(sha, at, 16), 16, -10).cast("long")
    return [doc.isNull().cast("byte").alias("late"), F.coalesce(doc, bits(17)).alias("id"), bits(1).alias("sig"), bits(17).alias("more")]


def index_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """hash, late, id, sig, n (2 if the piece stands there more than once). docs: own, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, names, counts = [], [], []
            for doc, text in zip(batch.column("own").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                filed, pieces = filed_under(word_hashes(words), window, gram)
                key, n = np.unique(pieces, return_counts=True)
                key_of = np.unique(filed)
                keys.append(key_of)
                counts.append(np.minimum(n[np.searchsorted(key, key_of)], 2).astype(np.int8))
                names.append(document_key(doc, text))
            if keys:
                size = [len(k) for k in keys]
                late, own, sig = (np.repeat(np.array(x, dtype=np.int64), size) for x in zip(*names, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(late.astype(np.int8)), pa.array(own), pa.array(sig), pa.array(np.concatenate(counts))], names=["hash", "late", "id", "sig", "n"])

    return docs.mapInArrow(run, INDEX)


@dataclass
class Run:
    name: str
    level: int


class FingerprintIndex:
    """Sorted immutable runs of window hashes, in a folder that driver and executors share.

    A run is a folder of Parquet files, in buckets by hash, one sorted file a bucket. Runs are read as partitions of one
    bucketed table, so a task has the same bucket of all of them. (A union of bucketed tables will not do: Spark 4.1 takes it
    for bucketed too, but runs its parts in tasks of their own.) Every change writes a new manifest; the one with the largest
    number holds. Runs that a merge has replaced stay until vacuum(), for readers that still use them.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN, buckets: int = 0):
        self.spark, self.folder, self.window, self.gram, self.fan_in = spark, folder, window, gram, fan_in
        self.buckets = buckets or partitions(spark)
        self.runs: list[Run] = []
        self.version, self.replaced, self.tables = 0, [], []
        self.given: set[str] = set()  # runs of earlier calls

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that a folder holds; a new one if it has no manifest."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*.json")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = sorted(str(s.getPath()) for s in fs.globStatus(path) or [])
        if not found:
            return cls(spark, folder)
        held = json.loads(spark.read.text(found[-1], wholetext=True).first()[0])
        index = cls(spark, folder, held["window"], held["gram"], held["fan_in"], held["buckets"])
        index.version = held["version"]
        index.runs = [Run(r["name"], r["level"]) for r in held["runs"]]
        index.given = {r.name for r in index.runs}
        return index

    def _publish(self) -> None:
        """Writes the next manifest aside and renames it, so a reader sees all of it or none."""
        self.version += 1
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        to, aside = (hadoop.Path(f"{self.folder}/{name}{self.version:09}.json") for name in ("manifest-", f"_{uuid.uuid4().hex}-"))
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        body = {"version": self.version, "window": self.window, "gram": self.gram, "fan_in": self.fan_in, "buckets": self.buckets, "runs": [{"name": r.name, "level": r.level} for r in self.runs]}
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(aside, to):
            raise RuntimeError(f"another writer has changed the index in {self.folder}")

    def _path(self, run: Run) -> str:
        return f"{self.folder}/run={run.name}"

    def _table(self) -> str:
        self.tables.append(f"tessera_index_{uuid.uuid4().hex}")
        return self.tables[-1]

    def _file(self, rows: DataFrame, level: int) -> Run:
        """rows come dealt by hash to as many tasks as there are buckets, so a bucket is one file."""
        run = Run(uuid.uuid4().hex, level)
        rows.write.option("compression", "zstd").option("path", self._path(run)).bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(self._table())
        return run

    def read(self, runs: list[Run]) -> DataFrame:
        """hash, late, id, sig, n and run of some runs, known to be in buckets by hash."""
        name = self._table()
        columns = INDEX.replace(" byte", " tinyint").replace(" long", " bigint")
        self.spark.sql(f"CREATE TABLE {name} ({columns}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        for run in runs:
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (run = '{run.name}') LOCATION '{self._path(run)}'")
        return self.spark.table(name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Files a batch (own, t) as a new run; the hashes that stand in it more than once or in it and an earlier run.

        Equal texts within one call are known otherwise, so a hash counts if it has several texts, or stands in a run of an earlier call.
        """
        new = self._file(index_rows(docs, self.window, self.gram).repartition(self.buckets, "hash"), 0)
        found = self.read([new]).groupBy("hash").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.max("n").alias("n"))
        repeated = F.expr("low != high or n > 1")
        if self.runs:
            old = self.read(self.runs).groupBy("hash").agg(F.min("sig").alias("was"), F.max("sig").alias("were"), F.max(F.col("run").isin(sorted(self.given))).alias("given"))
            found = found.hint("merge").join(old, "hash", "left")
            repeated = repeated | F.coalesce(F.expr("given or was != low or were != low"), F.lit(False))
        found = settle(found.filter(repeated).select("hash"))
        self.runs.append(new)
        self._publish()
        self.merge()
        return found

    def merge(self) -> None:
        """Merges FAN_IN runs of a level into one of the next, as long as there are so many: bucket by bucket, with no
        exchange; a row filed twice is kept once."""
        while True:
            levels = [r.level for r in self.runs]
            full = next((x for x in levels if levels.count(x) >= self.fan_in), None)
            if full is None:
                return
            old = [r for r in self.runs if r.level == full]
            run = self._file(self.read(old).groupBy("hash", *KEY).agg(F.max("n").alias("n")), full + 1)
            if any(r.name in self.given for r in old):
                self.given.add(run.name)
            self.runs = [r for r in self.runs if r.level != full] + [run]
            self.replaced += old
            self._publish()

    def holders(self, hashes: DataFrame) -> DataFrame:
        """late, id, sig, keys: the documents that hold one of hashes, with their own."""
        return self.read(self.runs).select("hash", *KEY).join(hashes, "hash").groupBy(*KEY).agg(F.collect_set("hash").alias("keys"))

    def close(self) -> None:
        """Forgets the tables' names; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []

    def vacuum(self) -> None:
        """Deletes what merges have replaced."""
        self.close()
        for run in self.replaced:
            delete(self.spark, self._path(run))
        self.replaced = []

    def delete(self) -> None:
        self.close()
        delete(self.spark, self.folder)


def _hashes(values: list | None) -> np.ndarray:
    return np.sort(np.array(values or [], dtype=np.int64).view(np.uint64))


def _candidates(words: list[bytes], keys: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of the windows filed under one of keys (sorted)."""
    filed, _ = filed_under(word_hashes(words), window, gram)
    at = np.minimum(np.searchsorted(keys, filed), len(keys) - 1)
    return np.nonzero(keys[at] == filed)[0]


def window_digests(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """128 bits, as two integers a row, of the words of the windows at starts."""
    data = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size + 1) - size - 1
    digest, parts = hashlib.blake2b, []
    for at in range(0, len(starts), BLOCK):
        low = starts[at : at + BLOCK]
        last = low + window - 1
        spans = zip(begin[low].tolist(), (begin[last] + size[last]).tolist(), strict=True)
        parts.append(np.frombuffer(b"".join([digest(data[a:b], digest_size=16).digest() for a, b in spans]), dtype=np.int64))
    return np.concatenate([np.empty(0, dtype=np.int64), *parts]).reshape(-1, 2)


def _windows(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """f1, f2 of each candidate window, once a document, with the start of its first place there. joined: old, late, id, tie, t, keys, first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            f, names, starts_of = [], [], []
            for text, keys, first, *name in zip(*(batch.column(c).to_pylist() for c in ("t", "keys", "first", "old", "late", "id", "tie")), strict=True):
                if not keys or not first:
                    continue
                words = words_of(text)
                starts = _candidates(words, _hashes(keys), window, gram)
                own = window_digests(words, starts, window)
                order = np.lexsort((own[:, 1], own[:, 0]))  # stable, so of equal windows the first place comes first
                own, starts = own[order], starts[order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]).any(axis=1)
                f.append(own[new])
                starts_of.append(starts[new])
                names.append(name)
            if f:
                size = [len(x) for x in f]
                f1, f2 = np.ascontiguousarray(np.concatenate(f).T)
                old, late, own_id, tie = (np.repeat(np.array(x, dtype=np.int64), size) for x in zip(*names, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f1, f2, old.astype(bool), late.astype(np.int8), own_id, tie, np.concatenate(starts_of).astype(np.int32))], names=["f1", "f2", "old", "late", "id", "tie", "start"])

    return joined.mapInArrow(run, "f1 long, f2 long, old boolean, late byte, id long, tie long, start int")


def _kept(joined: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_words, n_removed, kept = [], [], []
            for text, keys, first, new in zip(*(batch.column(c).to_pylist() for c in ("t", "keys", "first", "new")), strict=True):
                words = words_of(text)
                gone, rest = 0, words
                if len(words) >= window and not first:
                    gone, rest = len(words), []
                elif keys and len(words) >= window:
                    repeats = np.setdiff1d(_candidates(words, _hashes(keys), window, gram), np.array(new or [], dtype=np.int64), assume_unique=True)
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, repeats, 1)
                    np.add.at(cover, repeats + window, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    gone = int(len(words) - stay.sum())
                    rest = [words[i] for i in np.nonzero(stay)[0]] if gone else words
                n_words.append(len(words))
                n_removed.append(gone)
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") if with_text else "" for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["own", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return joined.mapInArrow(run, "own long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _later_copies(named: DataFrame) -> DataFrame:
    """late, id, sig of the documents whose text an earlier one has too. named: late, id, sig, more. A text's many copies
    are dealt to cells; a cell's least document and the text's least meet in a join that sees one row a cell."""
    cells = max(64, partitions(named.sparkSession))
    cell = F.pmod(F.xxhash64("late", "id"), F.lit(cells)).cast("int").alias("cell")
    at = F.struct("late", "id")
    named = named.select("sig", "more", cell, at.alias("at"))
    least_of = named.groupBy("sig", "more", "cell").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    text = least_of.groupBy("sig", "more").agg(F.min("low").alias("of"), F.max("high").alias("last")).filter("of != last")
    heads = least_of.select("sig", "more", "cell").join(text, ["sig", "more"]).select("sig", "more", "cell", "of")
    return named.join(heads, ["sig", "more", "cell"]).filter("at != of").select("at.late", "at.id", "sig", F.lit(False).alias("first")).distinct()


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, index: FingerprintIndex | None = None, history: DataFrame | None = None
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text (kept words joined by a space; empty without with_text), kept_sha256.

    Documents enter the index in n_batches of equal id ranges, as they would day by day; the result is the same for any number.
    index: one that is kept from call to call (FingerprintIndex.open); docs are filed in it, and its documents count as earlier
    than all of docs. history: the rows filed before, with the columns of docs; their texts are read where docs share a hash.
    """
    spark = docs.sparkSession
    if index is not None and index.runs and history is None:
        raise ValueError("an index that holds documents needs their texts as history")
    if index is not None:
        window, gram = index.window, index.gram

    def keyed(rows: DataFrame) -> DataFrame:
        own, text = F.col(id_col).cast("long"), whole(text_col)
        return rows.select(own.alias("own"), text.alias("t"), *key_columns(own, text))

    rows = docs.select(F.col(id_col).cast("long").alias("own"), whole(text_col).alias("t"))
    lasting = index is not None
    index = index or FingerprintIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", window, gram)
    cuts = rows.select(F.percentile_approx("own", F.array(*[F.lit(i / n_batches) for i in range(1, n_batches)]), 1000)).first()[0] if n_batches > 1 else []
    cuts = sorted(set(cuts or []))
    repeated = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows
        if low is not None:
            batch = batch.filter((F.col("own") > low) if high is not None else ((F.col("own") > low) | F.col("own").isNull()))
        if high is not None:
            batch = batch.filter(F.col("own") <= high)
        found = index.add(batch)
        repeated = found if repeated is None else repeated.unionByName(found)
    named = settle(keyed(docs).select(*KEY, "more"))
    # an id nearly always has one text, and then the id alone orders documents: a plainer aggregate does
    clash = named.filter("late = 0").groupBy("id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).filter("low != high")
    plain = history is None and named.filter("late = 1").isEmpty() and clash.isEmpty()
    notes = settle(index.holders(repeated.distinct()).join(_later_copies(named), KEY, "full"))
    if lasting:
        index.vacuum()
    else:
        index.delete()
    tie = F.lit(0).cast("long") if plain else F.col("sig")
    # the texts move once: both uses of this join take the same columns, so they read the same exchange
    columns = ["own", F.lit(False).alias("old"), "late", "id", tie.alias("tie"), "t", F.when(F.col("first").isNull(), F.col("keys")).alias("keys"), F.coalesce("first", F.lit(True)).alias("first")]
    joined = keyed(docs).join(notes, KEY, "left").select(*columns)
    asked = joined
    if history is not None:
        columns[1] = F.lit(True).alias("old")
        asked = joined.unionByName(keyed(history).join(notes.filter("keys is not null").select(*KEY, "keys", F.lit(None).cast("boolean").alias("first")), KEY).select(*columns))
    seen = _windows(asked, window, gram).groupBy("f1", "f2")
    if plain:
        earliest = seen.agg(F.min("id").alias("id"), F.min_by("start", "id").alias("start")).select(F.lit(0).cast("byte").alias("late"), "id", F.lit(0).cast("long").alias("tie"), "start")
    else:
        earliest = seen.agg(F.min(F.struct((~F.col("old")).alias("new"), "late", "id", "tie", "start")).alias("x")).filter("x.new").select("x.late", "x.id", "x.tie", "x.start")
    new = earliest.groupBy("late", "id", "tie").agg(F.collect_list("start").alias("new"))
    done = _kept(joined.join(new, ["late", "id", "tie"], "left"), window, gram, with_text)
    return done.withColumnRenamed("own", id_col)
