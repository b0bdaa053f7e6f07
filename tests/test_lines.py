"""Names, MIDI files, archives, lanes and progressions against plain restatements and edge cases."""

import io
import random
import struct
import tarfile
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import lines, matching, names, schemas, seeding, sequences
from tessera.sources import archives, midi


def test_artist_rules(spark):
    rows = [("Gaye, Marvin", "Marvin Gaye", 97, 100), ("Queen Latifah", "Queen", 0, 80), ("Pete Drake", "Drake", 0, 80), ("Elvis Presley and the Jordanaires", "Elvis Presley", 90, 100), ("Prince", "Prince & The Revolution", 90, 100), ("The Beatles", "Beatles", 100, 100), ("", "x", 0, 0), (None, "x", 0, 0), ("Queens", "Queen", 85, 100), ("Simon Garfunkel", "Simon & Garfunkel", 97, 100), ("feat. X", "X", 0, 0)]
    df = spark.createDataFrame([(w, a, float(names.sorted_ratio((w or "").lower(), a.lower())), 100.0) for w, a, _, _ in rows], "who string, act string, ratio double, sets double")
    got = df.select(names.act_score(F.col("who"), names.act_key(F.col("act")), F.col("ratio"), F.col("sets")).alias("s")).collect()
    for (who, act, low, high), r in zip(rows, got, strict=True):
        assert low <= r.s <= high, (who, act, r.s)


def test_ratios_by_sets():
    assert names.set_ratio("a b", "b a c") == 100 and names.set_ratio("", "a") == 0
    assert round(names.set_ratio("abba gold", "abba silver"), 4) == max(round(200 * 4 / 13, 4), round(200 * 4 / 15, 4), round(200 * 6 / 20, 4))


def test_filler_is_a_run_of_tokens(spark):
    known = {"": True, "2live": True, "kar12xg": True, "dancing": False, "1" * 59 + "é": False, "1" * 61: False}
    df = spark.createDataFrame([(t,) for t in known], "t string")
    assert {r.t: r.f for r in df.select("t", names.filler(F.col("t")).alias("f")).collect()} == known
    one = spark.createDataFrame([("2abbafeatcher", "abba", True), ("", "abba", False), ("abb", "abba", False), ("xabba", "abba", False), ("abba", "abba", True)], "t string, a string, want boolean")
    assert all(r.f == r.want for r in one.select("want", names.explained(F.col("t"), F.col("a")).alias("f")).collect())
    assert one.filter("t = ''").select(names.explained(F.col("t")).alias("f")).first().f


def test_names_match_works(spark):
    rows = [
        ("Queen/Bohemian Rhapsody.mid", "Bohemian Rhapsody", ["Queen"], "accept"),
        ("Abba - Dancing Queen (2).kar", "Dancing Queen", ["ABBA"], "accept"),
        ("queenbohemianrhapsody2.mid", "Bohemian Rhapsody", ["Queen"], "accept"),
        ("Elvis - Always On My Mind.mid", "Always On My Mind", ["Willie Nelson"], "other_artist"),
        ("midi/Imagine.mid", "Imagine", ["John Lennon"], "title_only"),
        ("Something Else.mid", "Imagine", ["John Lennon"], "no_title"),
        (None, "Imagine", None, "no_title"),
        ("", None, [None], "no_title"),
    ]
    df = spark.createDataFrame(rows, "name string, title string, artists array<string>, want string")
    for r in names.match_names(df).collect():
        assert (r.reason, r.accepted) == (r.want, r.want == "accept"), r
    assert names.match_names(df.unionByName(df)).count() == 2 * len(rows)
    scores = {r.name: (r.title_score, r.artist_score) for r in names.match_names(df).collect()}
    assert scores["queenbohemianrhapsody2.mid"] == (100.0, 100.0) and scores["midi/Imagine.mid"] == (100.0, 0.0) and scores[None] == (0.0, 0.0)
    assert scores["Elvis - Always On My Mind.mid"][0] == 100 and scores["Elvis - Always On My Mind.mid"][1] < 85
    assert names.match_names(df.limit(0)).collect() == []


def song(tracks, kind=1, ppq=96, count=None):
    return b"MThd" + struct.pack(">IHHH", 6, kind, len(tracks) if count is None else count, ppq) + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)


def test_midi_parse_and_warnings(spark):
    good = song([b"\x00\xff\x03\x04Kick\x00\x90\x3c\x40\x60\x3c\x00\x00\xff\x2f\x00"])  # running status
    cut = song([b"\x00\x90\x3c\x40\x60\x90\x3e"])
    files = {"good": good, "riff": b"RIFF\0\0\0\0RMIDdata\0\0\0\0" + good, "junk": b"\0" * 128 + good, "cut": cut, "html": b"<!DOCTYPE html><p>", "json": b" {}", "empty": b"", "null": None, "smpte": song([b""], ppq=0x8001), "silent": song([b"\x00\xff\x2f\x00"]), "count": song([good[22:]], count=3), "lost": good[:14] + b"\x01\x02\x03\x04\0\0\0\0" + good[14:]}
    df = midi.parse_midi(spark.createDataFrame(list(files.items()), "path string, content binary"))
    got = {r.path: r for r in df.collect()}
    assert got["good"].error is None and got["good"].ppq == 96 and got["good"].warnings == []
    assert [(e.tick, e.status, e.meta) for e in got["good"].events] == [(0, 255, 3), (0, 0x90, None), (96, 0x90, None)]
    assert got["riff"].warnings == ["rmid_unwrapped"] and got["junk"].warnings == ["leading_junk"]
    assert got["cut"].warnings == ["truncated_track"] and len(got["cut"].events) == 1
    assert got["count"].warnings == ["track_count_mismatch"] and got["lost"].warnings == ["resync"]
    assert {k: got[k].error for k in ("html", "json", "empty", "null", "smpte", "silent")} == {"html": "html", "json": "json", "empty": "empty", "null": "empty", "smpte": "smpte", "silent": "no_notes"}
    assert [(r.path, r.pitch, r.start, r.end) for r in midi.notes(df.filter("path = 'good'")).collect()] == [("good", 60, 0, 96)]
    moved = midi.move_drums(midi.notes(df), midi.track_names(df).withColumn("name", F.lit("Drum kit"))).filter("path = 'good'").collect()
    assert [r.channel for r in moved] == [9]


def test_note_repair():
    on, off = (lambda t, p, v=64: {"track": 0, "tick": t, "status": 0x90, "data": bytes((p, v))}), (lambda t, p: {"track": 0, "tick": t, "status": 0x80, "data": bytes((p, 0))})
    span = lambda events: [(s, e) for _, _, _, s, e, _ in midi.repair(events, 96)]
    assert span([on(0, 60), on(10, 60), off(10, 60), off(20, 60)]) == [(0, 10), (10, 20)]
    assert span([on(0, 60), on(0, 60), off(5, 60), off(6, 60)]) == [(0, 5)]
    assert span([off(0, 60), on(0, 60), off(0, 60), on(9, 62), off(12, 62)]) == [(0, 3), (9, 12)]
    assert span([on(0, 60), on(50, 60), off(70, 60), on(900, 61)]) == [(0, 70), (50, 434)]
    assert span([on(5, 60)]) == [] and span([]) == []


def test_fifo_pairs_equal_a_queue(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for g in range(20):
        queue, n = deque(), 0
        for t in range(rng.randint(0, 25)):
            kind = rng.choice(["on", "off", "other"])
            rows.append((g, t, kind))
            if kind == "on":
                n += 1
                queue.append((n, t))
            elif kind == "off" and queue:
                k, s = queue.popleft()
                want.add((g, k, s, t))
        want |= {(g, k, s, None) for k, s in queue}
    df = spark.createDataFrame(rows, "g int, t int, kind string")
    assert {tuple(r) for r in lines.fifo_pairs(df, ["g"], ["t"], F.col("kind") == "on", F.col("kind") == "off", "t").collect()} == want


def test_tar_members(spark):
    def pack(members, mode):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as tar:
            for name, body in members:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return out.getvalue()

    one = pack([("a/x1.mid", b"1"), ("a/x2.mid", b"22"), ("b/x1.mid", b"333")], "w:gz")
    df = spark.createDataFrame([("p", one), ("q", pack([("x3.tar.mid", b"")], "w")), ("bad", b"junk"), ("none", None)], "path string, content binary")
    assert {tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in archives.tar_members(df, size=2).collect()} == {("p", "a/x1.mid", "x1", b"1"), ("p", "a/x2.mid", "x2", b"22"), ("p", "b/x1.mid", "x1", b"333"), ("q", "x3.tar.mid", "x3", b"")}
    wanted = spark.createDataFrame([("x1",), ("x1",), ("zz",), (None,)], "md5 string")
    assert [(r.md5, r.member) for r in archives.wanted_members(df, wanted).collect()] == [("x1", "a/x1.mid")]


def test_runs_merge_and_settle():
    assert lines.merged_runs([(0, 4, "a"), (4, 5, "b"), (5, 9, "a"), (9, 20, "c")], 3) == [(0, 9, "a"), (9, 20, "c")]
    assert lines.merged_runs([(0, 1, "a"), (1, 9, "b")], 3) == [(0, 9, "b")] and lines.merged_runs([], 3) == []
    assert lines.merged_runs([(0, 1, "a")], 3) == [(0, 1, "a")]
    long = lambda run, value: run[1] - run[0] >= 5
    assert lines.settled_runs([(0, 8, "h"), (8, 10, "x"), (10, 30, "h"), (30, 40, "y")], "h", long) == [(0, 30, "h"), (30, 40, "y")]


def test_distinct_lanes_equal_the_loop(spark):
    rng = random.Random(2)
    rows, want = set(), set()
    for g in range(6):
        sets = {i: {rng.randint(0, 9) for _ in range(rng.randint(1, 8))} for i in range(6)}
        rows |= {(g, i, k) for i, s in sets.items() for k in s}
        kept = []
        for i in sorted(sets, key=lambda i: (-len(sets[i]), i)):
            if not any(len(sets[i] & sets[j]) >= 0.7 * len(sets[i]) for j in kept):
                kept.append(i)
        want |= {(g, i, len(sets[i])) for i in kept}
    df = spark.createDataFrame(sorted(rows), "g int, lane int, key int")
    assert {tuple(r) for r in lines.distinct_lanes(df, "g", "lane", "key", 0.7).collect()} == want


def test_blues_forms(spark):
    twelve = [0, 0, 0, 0, 5, 5, 0, 0, 7, 5, 0, 0]
    found = lambda roots, q=None: schemas.forms_of(*(np.array(x) for x in (roots, q or [0] * len(roots), roots, q or [0] * len(roots))))
    moved = [(r + 3) % 12 for r in twelve]
    assert found(moved * 2) == [("12-bar", 0, 12, "12-bar"), ("12-bar", 12, 24, "12-bar")]
    assert found([0] * 4 + twelve)[0][0] == "12-bar"
    assert found([1, 2] + [0] * 4 + twelve[:1] + twelve[1:]) != []
    eight = [0, 7, 5, 5, 0, 7, 0, 7]
    assert found(eight) == [] and [f[:3] for f in found(eight * 2)] == [("8-bar I-V-IV", 0, 8), ("8-bar I-V-IV", 8, 16)]
    assert found([]) == [] and found([-1] * 12) == []
    seventh = moved.copy()
    seventh[4] = (seventh[4] + 4) % 12  # the diminished chord that stands for the fourth bar's dominant
    assert found(seventh, [0] * 4 + [2] + [0] * 7) == [("12-bar", 0, 12, "12-bar")]
    rows = [("s", i, r, 0, r, 0) for i, r in enumerate(twelve)] + [("t", 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "song string, bar int, root1 int, quality1 int, root2 int, quality2 int")
    assert [tuple(r) for r in schemas.find_forms(df, "song", "bar").collect()] == [("s", "12-bar", 0, 12, "12-bar")]


def test_cycles_are_heard():
    c = lambda *roots, d=4.0: [(r, 0, d) for r in roots]
    four = [(0, 0), (9, 0), (5, 0), (7, 0)]
    assert schemas.cycle_heard(c(2, 5, 7, 0, 9), four) == 1
    assert schemas.cycle_heard(c(0, 9, 5), four) is None
    assert schemas.cycle_heard([(0, 0, 4.0), (2, 0, 2.0), (9, 1, 4.0), (5, 0, 4.0), (7, 0, 4.0)], four) == 0
    assert schemas.cycle_heard([(0, 0, 4.0), (2, 0, 3.0), (9, 0, 4.0), (5, 0, 4.0), (7, 0, 4.0)], four) is None
    assert schemas.cycle_heard(c(0, 5, 0, 5), [(0, 0), (5, 0)]) == 0 and schemas.cycle_heard(c(0, 5, 0), [(0, 0), (5, 0)]) is None
    assert schemas.cycle_heard([(0, 0, 8.0), (5, 0, 1.0), (0, 0, 8.0), (5, 0, 1.0)], [(0, 0), (5, 0)]) is None
    assert schemas.cycle_heard([], four) is None and schemas.cycle_heard(c(0), [(0, 0)]) is None


def test_readings_keep_digits_at_either_end(spark):
    df = spark.createDataFrame([("T/0 Act 20 - 1 Song 10 (2).mid",)], "n string")
    assert [tuple(x) for x in df.select(names.readings(F.col("n")).alias("r")).first().r] == [("0 Act 20", "1 Song 10"), ("1 Song 10", "0 Act 20"), ("T", "0 Act 20 - 1 Song 10"), ("T", "1 Song 10"), (None, "0 Act 20 - 1 Song 10")]


def test_seeds_of_lines_equal_the_join(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0, 1, 7]) for _ in range(rng.choice([0, 3, 5, 9, 30]))]) for i in rng.sample(range(1000), 60)]
    rows += [(1000 + i, t) for i, t in rows[:25]] + [(5000 + i, [1] * 20) for i in range(4)]
    df = spark.createDataFrame(rows, "line long, t array<int>").repartition(3)
    grams = df.select("line", F.posexplode(sequences.ngrams(F.col("t"), 3)).alias("at", "key"))
    want = sorted(tuple(r) for r in matching.seeds(grams, "line", "at", "key", 2).select("a", "b", "offset", "n", "first").collect())
    for block in (50_000, 20):
        monkeypatch.setattr(seeding, "BLOCK", block)
        got = seeding.line_seeds(df, "line", "t", 3, 2)
        assert sorted(map(tuple, got.collect())) == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no seed and no pair is shuffled
    assert len(want) > 1000 and seeding.line_seeds(df.limit(0), "line", "t", 3, 2).count() == 0
    assert seeding.line_seeds(df, "line", "t", 60, 2).count() == 0
