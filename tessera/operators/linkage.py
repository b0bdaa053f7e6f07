"""Record linkage: normal forms, key joins with ambiguity rules, cascades, substring joins."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import passages


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition, marks off, is one other letter or digit; and those where it is several."""
    one, several = {}, {}
    for code in (*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if plain != c and re.fullmatch("[a-z0-9&+'’`]", plain):
            one[c] = plain
        elif len(plain) > 1 and re.search("[a-z0-9]", plain):
            several[c] = re.sub("[^a-z0-9]", " ", plain)
    return one, several


_ONE, _SEVERAL = _decomposed()


def fold(text: Column) -> Column:
    """Lower case, characters by their compatibility decomposition without marks, & and + as 'and', apostrophes out, the rest
    that is no letter or digit of ASCII as single spaces."""
    x = F.translate(F.lower(text), "".join(_ONE), "".join(_ONE.values()))
    wide = F.transform(F.regexp_extract_all(x, F.lit("(?s)."), 0), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in _SEVERAL.items() for v in p]), c), c))
    x = F.when(x.rlike("[" + "".join(_SEVERAL) + "]"), F.array_join(wide, "")).otherwise(x)
    x = F.regexp_replace(F.regexp_replace(x, r"\p{M}+", ""), r"\s*[&+]\s*", " and ")
    x = F.regexp_replace(x, "['’`]", "")
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def title_key(text: Column) -> Column:
    """fold without bracketed parts, a featured artist, version endings and a leading article; as one word."""
    x = F.regexp_replace(F.lower(text), r"\([^)]*\)|\[[^\]]*\]", " ")
    x = F.regexp_replace(x, r"\s(feat|ft|featuring)\.?\s.*$", "")
    for _ in range(3):
        x = F.regexp_replace(x, r"\s+-\s+(live|remaster(ed)?|mono|stereo|single version|radio edit)(\s+\d{4})?\s*$", "")
    x = F.regexp_replace(fold(x), r"^(the|a|an) ", "")
    return F.replace(x, F.lit(" "), F.lit(""))


def unique_match(left: DataFrame, right: DataFrame, key: str, target: str) -> DataFrame:
    """left with target where exactly one distinct target of right has the row's key, else null."""
    one = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target)).filter("n = 1").drop("n")
    return left.join(one, key, "left")


def cascade(rows: DataFrame, row_key: str, steps: list[tuple[str, DataFrame, str, float]], target: str) -> DataFrame:
    """rows with target, method and confidence of the first step that finds one.

    A step: name, right side, its key (a column of both), confidence; only keys with a single target count.
    """
    out = rows
    for i, (_, right, key, _) in enumerate(steps):
        out = unique_match(out, right.select(key, F.col(target).alias(f"_t{i}")), key, f"_t{i}")
    found = [F.col(f"_t{i}") for i in range(len(steps))]
    pick = lambda values: F.coalesce(*[F.when(f.isNotNull(), F.lit(v)) for f, v in zip(found, values, strict=True)])
    out = out.withColumn(target, F.coalesce(*found)).withColumn("method", pick([s[0] for s in steps])).withColumn("confidence", pick([s[3] for s in steps]))
    return out.drop(*[f"_t{i}" for i in range(len(steps))])


def contained(needles: DataFrame, hay: DataFrame, needle: str, text: str) -> DataFrame:
    """needles x hay rows where text contains needle (3 characters or more), with hay's columns but the text.

    Equal needles are looked for once; passages.FEW distinct needles take a pass over the texts.
    """
    n = needles.filter(F.char_length(needle) >= 3).withColumn("_key", passages.digest(F.col(needle)))
    distinct = n.select(F.col("_key").alias("key"), F.col(needle).alias("t")).dropDuplicates(["key"])
    parts = max(1, -(-n.select("_key").distinct().count() // passages.FEW))
    share = lambda i: distinct.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i)
    met = reduce(DataFrame.unionByName, [passages.held(share(i), hay, text) for i in range(parts)])
    return n.join(met, "_key").drop("_key")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def token_sort_ratio(a: str | None, b: str | None) -> float | None:
    """0..100: twice the longest common subsequence of the texts with sorted words, over their lengths."""
    if a is None or b is None:
        return None
    x, y = (" ".join(sorted(t.split())) for t in (a, b))
    return 100.0 if not x and not y else round(200 * _lcs(x, y) / (len(x) + len(y)), 4)


def ratio_column(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
