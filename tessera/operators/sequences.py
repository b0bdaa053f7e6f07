"""Token sequences as arrays: n-grams, rotations, periods, encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All n consecutive tokens; empty if there are fewer. A costly expression for tokens goes through let()."""
    # element by element: slice() copies the whole array each time
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array(*[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array())


def rotate(tokens: Column, by: Column) -> Column:
    """Token `by` (from 0) comes first."""
    return F.concat(F.slice(tokens, by + 1, F.size(tokens) - by), F.slice(tokens, F.lit(1), by))


def least_rotation(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.array_min(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: rotate(tokens, i)))).otherwise(tokens)


def period(tokens: Column) -> Column:
    """Length of the shortest block whose repetition is the sequence (its own length at most)."""
    n = F.size(tokens)
    return F.when(n > 0, F.element_at(F.filter(F.sequence(F.lit(1), n), lambda p: (F.pmod(n, p) == 0) & (rotate(tokens, F.when(p == n, 0).otherwise(p)) == tokens)), 1)).otherwise(0)


def collapse(tokens: Column) -> Column:
    """Equal neighbours as one."""
    return F.when(F.size(tokens) > 1, F.transform(F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("x"), ((i == 0) | (F.get(tokens, i - 1) != x)).alias("new"))), lambda s: s["new"]), lambda s: s["x"])).otherwise(tokens)


def relative(tokens: Column, modulus: int) -> Column:
    """Tokens less the first, modulo."""
    return F.transform(tokens, lambda x: F.pmod(x - F.get(tokens, F.lit(0)), F.lit(modulus)))


def occurs(tokens: Column, pattern: Column) -> Column:
    """Whether pattern stands in tokens as consecutive tokens."""
    return F.when(F.size(pattern) == 0, True).when(F.size(tokens) < F.size(pattern), False).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(pattern) + 1, F.lit(1))), lambda i: F.slice(tokens, i, F.size(pattern)) == pattern))


def duration_class(beats: Column) -> Column:
    """0 for none, else 1 + log2 rounded half up, clipped to -1..4."""
    return F.when(beats <= 0, 0).otherwise(F.least(F.greatest(F.floor(F.log2(beats) + 0.5), F.lit(-1)), F.lit(4)) + 1).cast("int")


def key_shift(target: Column, tonic: Column) -> Column:
    """Semitones to move, -5..6."""
    return F.pmod(target - tonic + 5, F.lit(12)) - 5


def equal_share(a: Column, b: Column) -> Column:
    """Share of positions of the shorter sequence at which both agree."""
    n = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.round(F.try_divide(same, n), 6)


def jaccard(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), 6)


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct elements that b has."""
    return F.round(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), 6)
