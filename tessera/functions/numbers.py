"""Numbers as column expressions: roundings, glides, octaves, grids, keys and relations between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this many octaves a tempo is folded; semitones of a major scale.
FOLD_OCTAVES = 0.5
SCALE = (0, 2, 4, 5, 7, 9, 11)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def duration_class(beats: Column) -> Column:
    """0..5 for a half, 1, 2, 4, 8, 16 and more beats."""
    return F.when(beats <= 0, 0).otherwise((F.least(F.lit(4), F.greatest(F.lit(-1), half_up(F.log2(beats)))) + 1).cast("int"))


def smoothstep(u: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
    return x * x * (3 - 2 * x)


def glide(t: Column, start: Column, seconds: Column) -> Column:
    """Source seconds after t seconds of a glide from ratio `start` to 1 in `seconds`: the integral of the smoothed ratio."""
    u = F.greatest(F.lit(0.0), t / seconds)
    inside = start * t + (1 - start) * seconds * (F.pow(u, F.lit(3.0)) - F.pow(u, F.lit(4.0)) / 2)
    return F.when(seconds <= 0, t).when(t >= seconds, seconds * (1 + start) / 2 + (t - seconds)).otherwise(inside)


def octave_fold(heard: Column, target: Column) -> Column:
    """heard, or of its halves and doubles (up to two octaves) the one nearest to target, if heard is far from it."""
    f = F.when(target > 0, target).otherwise(120.0)
    p = F.when(heard > 0, heard).otherwise(f)
    options = F.array(*[F.struct(F.abs(F.log2(p * k / f)).alias("far"), F.lit(i).alias("i"), (p * k).alias("x")) for i, k in enumerate((1.0, 0.5, 2.0, 0.25, 4.0))])
    return F.when(F.abs(F.log2(p / f)) > FOLD_OCTAVES, F.array_min(options)["x"]).otherwise(p)


def share(a: Column, b: Column) -> Column:
    """The smaller over the larger; 1 for two zeros."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def to_bars(start: Column, end: Column, bar: Column, first: Column, total: Column, least: int = 8, most: int = 24) -> tuple[Column, Column]:
    """start and end moved outward to bars, with least..most bars where the song (first downbeat, end) has room."""
    last = first + F.ceil((F.greatest(total, end, first + bar) - first) / bar - 1e-9) * bar
    a = F.greatest(first + F.floor((start - first) / bar + 1e-9) * bar, first)
    e = F.least(first + F.ceil((end - first) / bar - 1e-9) * bar, last)
    e = F.when(e <= a, F.least(last, a + bar)).otherwise(e)
    e = F.when(e - a < least * bar, F.least(last, a + least * bar)).otherwise(e)
    low = F.when(e - a < least * bar, F.greatest(first, e - least * bar)).otherwise(a)
    return F.round(low, 6), F.round(F.when(e - low > most * bar, low + most * bar).otherwise(e), 6)


def to_twelfths(onset: Column, bar_start: Column) -> Column:
    """onset on the grid of twelfths of a beat that begins with its bar."""
    return F.round(bar_start + half_up((onset - bar_start) * 12) / 12, 6)


def relative_major(tonic: Column, minor: Column) -> Column:
    return F.pmod(tonic + F.when(minor, 3).otherwise(0), F.lit(12))


def collection(tonic: Column, minor: Column) -> Column:
    """Pitch classes of a key's scale (natural minor)."""
    return F.array_sort(F.transform(F.array(*map(F.lit, SCALE)), lambda x: F.pmod(relative_major(tonic, minor) + x, F.lit(12))))


def key_relation(a: Column, a_minor: Column, b: Column, b_minor: Column) -> Column:
    """same, parallel, relative, fifth, adjacent (scales one accidental apart) or none."""
    apart = F.pmod(relative_major(a, a_minor) - relative_major(b, b_minor), F.lit(12))
    tonics = F.pmod(a - b, F.lit(12))
    return F.when((tonics == 0) & (a_minor == b_minor), "same").when(tonics == 0, "parallel").when(apart == 0, "relative").when(tonics.isin(5, 7), "fifth").when(apart.isin(5, 7), "adjacent").otherwise("none")


def varied(tokens: Column, least: int = 3, periods: tuple[int, ...] = (2, 3)) -> Column:
    """Whether a run of tokens has at least so many different ones and repeats with none of the periods."""
    out = F.size(F.array_distinct(tokens)) >= least
    for p in periods:
        out = out & (tokens != F.concat(F.slice(tokens, F.lit(1), F.lit(p)), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - p, F.lit(0)))))
    return out


def available(*sizes: tuple[Column, int]) -> Column:
    """Bits of the channels that have enough: bit i for the i-th."""
    return sum((F.when(n >= least, 1 << i).otherwise(0) for i, (n, least) in enumerate(sizes)), F.lit(0))


def earlier(a: dict[str, Column], b: dict[str, Column], weeks: int = 4) -> Column:
    """Whether work a is earlier than b: by year; in one year by dates more than `weeks` apart, if both are known to the day,
    or by month, if both are to the month. A time value, if both have one, must not say otherwise. Keys: year, month, day, time."""
    known = lambda k: a[k].isNotNull() & b[k].isNotNull()
    day = lambda x: F.make_date(x["year"], x["month"], x["day"])
    days = F.datediff(day(b), day(a))
    inside = F.when(known("month") & known("day"), days > 7 * weeks).when(known("month"), a["month"] < b["month"]).otherwise(F.lit(False))
    by_date = F.when(a["year"] != b["year"], a["year"] < b["year"]).otherwise(inside)
    return F.coalesce(by_date & ~F.coalesce(a["time"] > b["time"], F.lit(False)), F.lit(False))


def covers(start: Column, end: Column, year: Column, slack: int = 1) -> Column:
    """Whether a membership (open ends count as always) covers a year; who joined the year after still counts."""
    return F.coalesce(start <= year + slack, F.lit(True)) & F.coalesce(end >= year, F.lit(True))
