"""Standard MIDI files: lenient parse, note repair, features of tracks. A file is a row; the parse is an Arrow function over its bytes."""

from __future__ import annotations

import struct
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "track int, seq int, tick long, status int, meta int, data binary"
PARSED = f"path string, error string, ppq int, warnings array<string>, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"
NOTE = "path string, track int, channel int, pitch int, start long, end long, velocity int"
#: Data bytes of a channel message, by its upper four bits.
LENGTHS = {8: 2, 9: 2, 10: 2, 11: 2, 12: 1, 13: 1, 14: 2}
#: Keys of drum kits, and the most distinct ones that a drum track strikes.
DRUM_KEYS, DRUM_MAX = (27, 87), 12
HANGING_BEATS = 4


class Unusable(Exception):
    """The bytes are no MIDI file; the argument says why."""


def locate(data: bytes) -> tuple[int, list[str]]:
    """Where the header chunk is, past a RIFF wrapper or up to 4 KiB of junk."""
    if not data:
        raise Unusable("empty")
    if data.startswith(b"MThd"):
        return 0, []
    riff = data[:4] == b"RIFF" and data[8:12] == b"RMID"
    if not riff:
        head = data[:1024].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
        kinds = (("html", b"<html" in head or head.startswith((b"<!doctype html", b"<head", b"<body"))), ("xml", head[:1] == b"<"), ("json", head[:1] in (b"{", b"[") and head != b""))
        for kind, is_it in kinds:
            if is_it:
                raise Unusable(kind)
    at = data.find(b"MThd", 12) if riff else data.find(b"MThd", 0, 4096)
    if at < 0:
        raise Unusable("no_mthd")
    return at, ["rmid_unwrapped" if riff else "leading_junk"]


class Reader:
    """A track's bytes, read from the front; IndexError where they end too early."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise IndexError
        self.at += n
        return out

    def number(self) -> int:
        """Variable length, four bytes at most."""
        value = 0
        for _ in range(4):
            b = self.take(1)[0]
            value = value << 7 | b & 127
            if b < 128:
                return value
        raise IndexError


def track_events(data: bytes) -> tuple[list[tuple[int, int, int | None, bytes]], str | None]:
    """(tick, status, meta type, data) of a track up to its end or the first byte that makes no sense, and a warning."""
    out, r, tick, running = [], Reader(data), 0, 0
    try:
        while r.at < len(data):
            tick += r.number()
            status = r.take(1)[0]
            if status == 0xFF:
                meta = r.take(1)[0]
                body = r.take(r.number())
                if meta == 0x2F:
                    break
                out.append((tick, status, meta, body))
            elif status in (0xF0, 0xF7):
                out.append((tick, status, None, r.take(r.number())))
            elif status > 0xF0:
                return out, "illegal_status"
            else:
                if status < 0x80:  # running status: that was data
                    if not running:
                        return out, "data_without_status"
                    r.at -= 1
                else:
                    running = status
                out.append((tick, running, None, bytes(x & 127 for x in r.take(LENGTHS[running >> 4]))))
    except IndexError:
        return out, "truncated_track"
    return out, None


def chunks(data: bytes, at: int) -> Iterator[tuple[bytes | None, str | None]]:
    """(track bytes or None, warning or None) of the chunks from at on; lost, it goes on at the next track header."""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8])
        if name == b"MTrk":
            yield data[at + 8 : at + 8 + size], "truncated_file" if at + 8 + size > len(data) else None
            at += 8 + size
        elif name.isascii() and name.decode("ascii").isprintable():
            yield None, "unknown_chunk"
            at += 8 + size
        else:
            at = data.find(b"MTrk", at + 1)
            if at < 0:
                return
            yield None, "resync"


def parse_bytes(data: bytes) -> tuple[int, list[str], list[dict]]:
    """Ticks a beat, warnings, events. Raises Unusable."""
    at, warnings = locate(data)
    if len(data) < at + 14:
        raise Unusable("bad_header")
    size, kind, tracks, division = struct.unpack_from(">IHHH", data, at + 4)
    for reason, is_it in (("bad_header", size < 6 or kind > 2), ("smpte", division >= 0x8000), ("bad_header", division == 0), ("format2", kind == 2)):
        if is_it:
            raise Unusable(reason)
    events, n = [], 0
    for body, warning in chunks(data, at + 8 + size):
        warnings += [warning] if warning else []
        if body is not None:
            found, warning = track_events(body)
            warnings += [warning] if warning else []
            events += [{"track": n, "seq": i, "tick": t, "status": s, "meta": m, "data": d} for i, (t, s, m, d) in enumerate(found)]
            n += 1
    if not n:
        raise Unusable("no_tracks")
    if not any(e["status"] >> 4 == 9 and e["data"][1] for e in events):
        raise Unusable("no_notes")
    return division, sorted({*warnings, *(["track_count_mismatch"] if n != tracks else [])}), events


def _few_at_once(batches: Iterator[pa.RecordBatch], files: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, files):
            yield batch.slice(at, files)


def parse_midi(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, error (null if usable), ppq, warnings, events of binary files, as spark.read.format("binaryFile") gives them.

    A null content counts as empty; an unusable file keeps its row, with the reason."""
    kind = pa.struct([("track", pa.int32()), ("seq", pa.int32()), ("tick", pa.int64()), ("status", pa.int32()), ("meta", pa.int32()), ("data", pa.binary())])
    schema = pa.schema([("path", pa.string()), ("error", pa.string()), ("ppq", pa.int32()), ("warnings", pa.list_(pa.string())), ("events", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_at_once(batches):
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"path": p, "error": None, "ppq": None, "warnings": [], "events": []}
                try:
                    row["ppq"], row["warnings"], row["events"] = parse_bytes(data or b"")
                except Unusable as e:
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, PARSED)


def repair(events: list[dict], ppq: int) -> list[tuple[int, int, int, int, int, int]]:
    """(track, channel, pitch, start, end, velocity) of a file's notes: ons and offs of a track's key paired first in, first out.

    A key struck twice at a tick sounds once; an off without a note is ignored; a note left open ends at its key's next
    strike, HANGING_BEATS later or at the file's end, whichever is first, and is dropped if it begins there; a note
    without length gets a 32nd of a beat.
    """
    last = max((e["tick"] for e in events), default=0)
    open_, done, strikes = defaultdict(deque), [], defaultdict(list)
    for e in events:
        kind, key = e["status"] >> 4, (e["track"], e["status"] & 15, e["data"][0] if e["data"] else 0)
        if kind == 9 and e["data"][1]:
            queue = open_[key]
            if not queue or queue[-1][0] != e["tick"]:
                queue.append((e["tick"], e["data"][1]))
                strikes[key].append(e["tick"])
        elif kind in (8, 9) and open_[key]:
            start, velocity = open_[key].popleft()
            done.append((*key, start, e["tick"], velocity))
    for key, queue in open_.items():
        for start, velocity in queue:
            if start < last:
                end = min([last, start + HANGING_BEATS * ppq, *(t for t in strikes[key] if t > start)])
                done.append((*key, start, end, velocity))
    return sorted((t, c, p, s, e if e > s else s + max(1, ppq // 32), v) for t, c, p, s, e, v in done)


def notes(parsed: DataFrame) -> DataFrame:
    """path, track, channel (0..15), pitch, start, end (ticks), velocity of parse_midi's usable files."""
    names = [c.split()[0] for c in NOTE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 2, pa.int32()]
        for batch in _few_at_once(batches):
            for row in batch.to_pylist():
                found = repair(row["events"], row["ppq"])
                columns = [[row["path"]] * len(found), *(list(c) for c in zip(*found, strict=True))] if found else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return parsed.filter("error IS NULL").select("path", "ppq", "events").mapInArrow(run, NOTE)


def facts(parsed: DataFrame, meta: int) -> DataFrame:
    """path, tick, data: meta events of a type, the last of a tick counting (tempo 0x51, time signature 0x58, key signature 0x59)."""
    e = parsed.select("path", F.explode("events").alias("e")).select("path", "e.*").filter(F.col("meta") == meta)
    return e.groupBy("path", "tick").agg(F.max_by("data", F.struct("track", "seq")).alias("data"))


def track_names(parsed: DataFrame) -> DataFrame:
    """path, track, name: the first track name."""
    e = parsed.select("path", F.explode("events").alias("e")).select("path", "e.*").filter("meta = 3")
    return e.groupBy("path", "track").agg(F.trim(F.min_by(F.decode("data", "ISO-8859-1"), "seq")).alias("name"))


def move_drums(found: DataFrame, names: DataFrame, drums: str = r"(?i)\b(drums?|perc(ussion)?|kit)\b") -> DataFrame:
    """notes() with the notes of a drum-named track on channel 9 (the tenth), if the channel strikes few keys, all of them a kit's."""
    keys = found.groupBy("path", "track", "channel").agg(F.size(F.collect_set("pitch")).alias("_n"), F.min("pitch").alias("_low"), F.max("pitch").alias("_high"))  # 128 pitches at most
    fits = (F.col("_n") <= DRUM_MAX) & (F.col("_low") >= DRUM_KEYS[0]) & (F.col("_high") <= DRUM_KEYS[1])
    named = names.filter(F.col("name").rlike(drums)).select("path", "track", F.lit(True).alias("_named"))
    moved = keys.join(named, ["path", "track"]).filter(fits).select("path", "track", "channel", "_named")
    out = found.join(moved, ["path", "track", "channel"], "left")
    return out.withColumn("channel", F.when(F.col("_named"), 9).otherwise(F.col("channel"))).select(*found.columns)


def track_features(found: DataFrame, by: tuple[str, ...] = ("path", "track", "channel"), length: Column | None = None) -> DataFrame:
    """A row a lane: n_notes, mean_pitch, low, high, n_pitches, sounding (sum of lengths), polyphony (sounding over the span)."""
    lasts = F.col("end") - F.col("start") if length is None else length
    span = F.max("end") - F.min("start")
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_notes"), F.round(F.avg("pitch"), 4).alias("mean_pitch"), F.min("pitch").alias("low"), F.max("pitch").alias("high"),
        F.count_distinct("pitch").alias("n_pitches"), F.sum(lasts).alias("sounding"), F.round(F.try_divide(F.sum(lasts), span), 4).alias("polyphony"),
    )
