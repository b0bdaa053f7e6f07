"""Cadences against a plain scan, and names of cycles."""

import random

from tessera.operators import cadences as C

SCHEMA = "song int, start double, dur double, root int, quality int, detail string"


def scan(chords, loops, tonic=9, per=4.0):
    out = set()
    for name, minor, wanted in C.CADENCES:
        want = [((d + (tonic if minor else 0)) % 12, q) for d, q in wanted]
        runs = []
        for start, dur, root, quality, detail in chords:
            t = (root, quality)
            if quality == C.DIMINISHED and t not in want and ((root - 4) % 12, C.MAJOR) in want:
                t = ((root - 4) % 12, C.MAJOR)
            if runs and runs[-1][0] == t and abs(runs[-1][1] + runs[-1][2] - start) < 1e-6:
                runs[-1][2] += dur
            else:
                runs.append([t, start, dur, detail])
        i, n = 0, len(want)
        while i + n <= len(runs):
            part = runs[i : i + n]
            joined = all(abs(a[1] + a[2] - b[1]) < 1e-6 for a, b in zip(part, part[1:], strict=False))
            if [r[0] for r in part] != want or not joined or part[-1][1] % per > 1e-6:
                i += 1
                continue
            s, e = part[0][1], part[-1][1] + part[-1][2]
            variant = ".".join(f"{x:g}" for x in [*(r[2] for r in part[:-1]), min(part[-1][2], per)]) + "|" + ".".join(r[3] for r in part)
            if sum(max(0, min(e, b) - max(s, a)) for a, b in loops) < 0.5 * (e - s):
                out.add((name, s, e, variant))
            i += n
    return out


def test_cadences_equal_the_scan(spark):
    rng = random.Random(4)
    kinds = [(0, 0), (2, 1), (5, 0), (7, 0), (11, 2), (9, 1), (4, 0), (11, 2), (2, 1)]
    rows, spans, want = [], [], set()
    for song in range(40):
        at, line = 0.0, []
        for _ in range(rng.randint(0, 30)):
            chosen = [kinds[0], kinds[2], kinds[3]] * 3 + [kinds[0]] if rng.random() < 0.15 else rng.choice([[(2, 1), (7, 0), (0, 0)], [(11, 2), (4, 0), (9, 1)], [(9, 1), (2, 1), (4, 0), (9, 1)], [rng.choice(kinds)]])
            for root, quality in chosen:
                dur = rng.choice([4.0, 4.0, 4.0, 2.0, 1.5])
                line.append((at, dur, root, quality, rng.choice("xyz")))
                at += dur + rng.choice([0.0] * 12 + [2.0])
        loops = [(20.0, 36.0), (60.0, 66.0)] if song % 2 else []
        rows += [(song, *c) for c in line]
        spans += [(song, *x) for x in loops]
        want |= {(song, *x) for x in scan(line, loops)}
    found = C.find_cadences(spark.createDataFrame(rows, SCHEMA), "song", loops=spark.createDataFrame(spans, "song int, start double, end double"), detail="detail").collect()
    assert len({x[1] for x in want}) == 4 and len(want) > 50
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_cadences_of_nothing(spark):
    assert C.find_cadences(spark.createDataFrame([], SCHEMA), "song").count() == 0
    odd = spark.createDataFrame([(1, 0.0, 4.0, None, None, None), (None, 0.0, 4.0, 0, 0, None)], SCHEMA)
    assert C.find_cadences(odd, "song").count() == 0


def test_cycles_have_names(spark):
    axis = [(0, 0), (7, 0), (9, 1), (5, 0)]
    assert C.cycle_name(axis, 0, False) == ("axis progression I-V-vi-IV", True)
    assert C.cycle_name(axis, 2, False) == ("axis progression vi-IV-I-V", True)
    assert C.cycle_name(axis, 0, True) == ("axis progression i-bVI-bIII-bVII", True)
    assert C.cycle_name([(5, 0), (7, 0), (0, 0), (9, 0)], 0, False) == ("doo-wop progression I-VI-IV-V", True)
    assert C.cycle_name([(0, 0), (10, 0), (5, 0)], 1, False) == ("Mixolydian vamp I-bVII-IV", True)
    assert C.cycle_name([(0, 0), (10, 0), (5, 1)], 1, False) == ("bVII-iv-I", False)
    assert C.cycle_name([(5, 0), (9, 1)], 0, True) == ("two-chord vamp i-bVI", True)
    assert C.cycle_name([(0, 0), (5, 0)], 1, False) == ("two-chord vamp IV-I", True)
    assert C.numerals([(11, 2), (6, 0)], 0) == "viio-#IV"
    families = spark.createDataFrame([("a", [0, 7, 9, 5], [0, 0, 1, 0], 0, False), ("b", [0, 1, 2], [0, 1, 2], 0, False)], "f string, r array<int>, q array<int>, p int, m boolean")
    assert [(r.f, r.label, r.named) for r in C.name_cycles(families, "r", "q", "p", "m").orderBy("f").collect()] == [("a", "axis progression I-V-vi-IV", True), ("b", "I-bii-iio", False)]
