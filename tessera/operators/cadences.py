"""Cadences in chord lines, and names of chord cycles."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAJOR, MINOR, DIMINISHED = 0, 1, 2
#: Beats below which two times are one.
SAME = 1e-6

Chords = tuple[tuple[int, int], ...]

#: Cadences in the frame of a major key, and in that of its minor tonic; (semitones above the tonic, quality).
CADENCES: tuple[tuple[str, bool, Chords], ...] = (
    ("ii-V-I", False, ((2, MINOR), (7, MAJOR), (0, MAJOR))),
    ("iio-V-i", True, ((2, DIMINISHED), (7, MAJOR), (0, MINOR))),
    ("I-IV-V-I", False, ((0, MAJOR), (5, MAJOR), (7, MAJOR), (0, MAJOR))),
    ("i-iv-V-i", True, ((0, MINOR), (5, MINOR), (7, MAJOR), (0, MINOR))),
)

#: Named cycles: text around the numerals {r}, whether in the minor frame, whether shown in their own rotation, chords.
CYCLES: tuple[tuple[str, bool, bool, Chords], ...] = (
    ("axis progression {r}", False, False, ((0, MAJOR), (7, MAJOR), (9, MINOR), (5, MAJOR))),
    ("axis progression {r}", True, True, ((0, MINOR), (8, MAJOR), (3, MAJOR), (10, MAJOR))),
    ("doo-wop progression {r}", False, True, ((0, MAJOR), (9, MINOR), (5, MAJOR), (7, MAJOR))),
    ("Pachelbel ground {r}", False, True, ((0, MAJOR), (7, MAJOR), (9, MINOR), (4, MINOR), (5, MAJOR), (0, MAJOR), (5, MAJOR), (7, MAJOR))),
    ("Pachelbel ground (first half) {r}", False, True, ((0, MAJOR), (7, MAJOR), (9, MINOR), (4, MINOR))),
    ("Andalusian cadence {r}", True, True, ((0, MINOR), (10, MAJOR), (8, MAJOR), (7, MAJOR))),
    ("Mixolydian vamp {r}", False, True, ((0, MAJOR), (10, MAJOR), (5, MAJOR))),
    ("bVII-bVI shuttle {r}", False, True, ((0, MAJOR), (10, MAJOR), (8, MAJOR), (10, MAJOR))),
    ("bVII-bVI shuttle {r}", True, True, ((0, MINOR), (10, MAJOR), (8, MAJOR), (10, MAJOR))),
    ("Aeolian progression {r}", True, True, ((0, MINOR), (8, MAJOR), (10, MAJOR))),
    ("{r} turnaround", False, True, ((0, MAJOR), (9, MINOR), (2, MINOR), (7, MAJOR))),
    ("{r} cadence loop", False, True, ((2, MINOR), (7, MAJOR), (0, MAJOR))),
)

#: Numerals by semitones above the tonic.
NUMERALS = ("I", "bII", "II", "bIII", "III", "IV", "#IV", "V", "bVI", "VI", "bVII", "VII")


def numerals(chords: list[tuple[int, int]], tonic: int = 0) -> str:
    """Numerals joined by "-": minor ones in lower case, diminished ones with an "o" too."""
    out = []
    for root, quality in chords:
        name = NUMERALS[(root - tonic) % 12]
        out.append(name if quality == MAJOR else name.lower() + "o" * (quality == DIMINISHED))
    return "-".join(out)


def cycle_name(chords: list[tuple[int, int]], phase: int, minor: bool, minor_tonic: int = 9) -> tuple[str, bool]:
    """Label of a cycle, and whether it is a named one. phase: the rotation that most members start on; minor: most of them are.

    A named cycle has the same roots in some rotation and the same qualities, of four chords or more all but one. Names of
    the members' own frame come first.
    """
    n = len(chords)
    turned = lambda k: [chords[(k + i) % n] for i in range(n)]

    def members_rotation() -> list[tuple[int, int]]:
        shown = turned(phase)
        home = (minor_tonic % 12, MINOR)
        return turned(phase + shown.index(home)) if minor and home in shown else shown

    frame = minor_tonic if minor else 0
    for text, in_minor, own_rotation, named in sorted(CYCLES, key=lambda c: c[1] != minor):
        tonic = minor_tonic if in_minor else 0
        wanted = [((d + tonic) % 12, q) for d, q in named]
        starts = [k for k in range(n) if [r for r, _ in turned(k)] == [r for r, _ in wanted]]
        if not starts:
            continue
        agree = lambda k: sum(x == y for x, y in zip(turned(k), wanted, strict=True))  # noqa: E731, B023
        # of equal rotations the one that turns the named cycle least
        best = max(starts, key=lambda k: (agree(k), -((n - k) % n)))
        if agree(best) >= n - (n >= 4):
            return text.replace("{r}", numerals(turned(best), tonic) if own_rotation else numerals(members_rotation(), frame)), True
    label = numerals(members_rotation(), frame)
    return (f"two-chord vamp {label}", True) if n == 2 else (label, False)


def name_cycles(families: DataFrame, roots: str, qualities: str, phase: str, minor: str, minor_tonic: int = 9) -> DataFrame:
    """families with label and named; roots and qualities are arrays of a cycle's chords. One row a family, so Python's cost is small."""

    @F.pandas_udf("label string, named boolean")
    def of(r: pd.Series, q: pd.Series, p: pd.Series, m: pd.Series) -> pd.DataFrame:
        found = [cycle_name([(int(a), int(b)) for a, b in zip(x, y, strict=True)], int(k), bool(f), minor_tonic) for x, y, k, f in zip(r, q, p, m, strict=True)]
        return pd.DataFrame(found, columns=["label", "named"])

    return families.withColumn("_l", of(roots, qualities, phase, minor)).withColumn("label", F.col("_l.label")).withColumn("named", F.col("_l.named")).drop("_l")


def _short(beats: Column) -> Column:
    """Beats to two places, without closing zeros."""
    return F.regexp_replace(F.bround(beats, 2).cast("decimal(18,2)").cast("string"), r"\.?0+$", "")


def _one(chords: DataFrame, by: str, name: str, wanted: Chords, first_bar: Column, beats_per_bar: Column, detail: bool) -> DataFrame:
    n, tokens = len(wanted), [r * 3 + q for r, q in wanted]
    w = Window.partitionBy(by).orderBy("start")
    token, dominant = F.col("root") * 3 + F.col("quality"), F.pmod(F.col("root") - 4, F.lit(12)) * 3
    stands = (F.col("quality") == DIMINISHED) & ~token.isin(tokens) & dominant.isin(tokens)
    heard = chords.withColumn("_t", F.when(stands, dominant).otherwise(token))
    joins = F.lag("_t").over(w).eqNullSafe(F.col("_t")) & (F.abs(F.lag(F.col("start") + F.col("dur")).over(w) - F.col("start")) < SAME)
    runs = heard.withColumn("_r", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "_r").agg(
        F.min("_t").alias("_t"), F.min("start").alias("start"), F.sum("dur").alias("dur"), F.min(first_bar).alias("_bar"), F.min(beats_per_bar).alias("_per"),
        F.min_by("detail", "start").alias("detail"),
    )
    order = Window.partitionBy(by).orderBy("_r")
    ahead = lambda c, i: F.lead(c, i).over(order) if i else F.col(c)
    ends = lambda i: ahead("start", i) + ahead("dur", i)
    place = (ahead("start", n - 1) - F.col("_bar")) / F.col("_per")
    fits = [ahead("_t", i) == t for i, t in enumerate(tokens)] + [F.abs(ends(i) - ahead("start", i + 1)) < SAME for i in range(n - 1)] + [F.abs(place - F.round(place)) <= SAME]
    beats = [_short(ahead("dur", i) if i < n - 1 else F.least(ahead("dur", i), F.col("_per"))) for i in range(n)]
    variant = F.concat_ws(".", *beats)
    if detail:
        variant = F.concat(variant, F.lit("|"), F.concat_ws(".", *[F.coalesce(ahead("detail", i), F.lit("")) for i in range(n)]))
    found = runs.select(by, "_r", "start", ends(n - 1).alias("end"), variant.alias("variant"), reduce(Column.__and__, fits).alias("_ok")).filter("_ok")
    # a cadence that opens on the chord that closed the one before is none: in a chain of such, every other one stays
    chain = found.withColumn("_c", F.sum(F.when(F.col("_r") - F.lag("_r").over(order) < n, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(by, "_c").orderBy("_r"))
    return chain.withColumn("_n", nth).filter("_n % 2 = 1").select(by, F.lit(name).alias("cadence"), "start", "end", "variant")


def find_cadences(chords: DataFrame, by: str, minor_tonic: int = 9, loops: DataFrame | None = None, first_bar: str | float = 0.0, beats_per_bar: str | float = 4.0, detail: str | None = None) -> DataFrame:
    """by, cadence, start, end, variant: from left to right without overlap, the last chord on a bar line.

    chords: by, start, dur (beats), root, quality, in the normalised key. Neighbours on one chord count as one; a diminished
    chord that the cadence has not stands for its dominant. variant: beats of each chord, the last at most a bar's, and
    after "|" the chords' details where a column has them. loops (by, start, end; disjoint): cadences at least half inside are left out.
    """
    value = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    per = F.when(value(beats_per_bar) > 0, value(beats_per_bar)).otherwise(4.0)
    rows = chords.withColumn("detail", F.col(detail) if detail else F.lit(None).cast("string"))
    found = reduce(
        DataFrame.unionByName,
        [_one(rows, by, name, tuple(((d + (minor_tonic if minor else 0)) % 12, q) for d, q in wanted), value(first_bar), per, detail is not None) for name, minor, wanted in CADENCES],
    )
    if loops is None:
        return found
    spans = loops.select(F.col(by).alias("_by"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col(by) == F.col("_by")) & (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start"))
    inside = F.coalesce(F.sum(F.when(F.col("_s").isNotNull(), F.least("end", "_e") - F.greatest("start", "_s"))), F.lit(0.0))
    keys = [by, "cadence", "start", "end", "variant"]
    return found.join(spans, hit, "left").groupBy(*keys).agg(inside.alias("_in")).filter(F.col("_in") < 0.5 * (F.col("end") - F.col("start"))).select(*keys)
