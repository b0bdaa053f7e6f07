"""Tables and delimited lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked_list(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited list with a header; columns: name -> header spellings, the first that the file has counts.

    A byte order mark before the first header is dropped; headers are compared without case and outer spaces; a column
    of which the file has no spelling is null.
    """
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=True)
    have = {c.strip().lstrip("﻿").strip().lower(): c for c in raw.columns}

    def pick(spellings: tuple[str, ...]) -> Column:
        found = next((have[s.lower()] for s in spellings if s.lower() in have), None)
        return F.trim(F.col(f"`{found}`")) if found else F.lit(None).cast("string")

    return raw.select(*[pick(s).alias(name) for name, s in columns.items()])


def earliest_week(rows: DataFrame, by: list[str], week: str) -> DataFrame:
    """The first week of each key in a weekly chart."""
    return rows.groupBy(*by).agg(F.min(week).alias(f"first_{week}"))


def map_entries(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """A JSON object key -> list of strings, as one row an element."""
    parsed = F.from_json(json_col, "map<string,array<string>>")
    return rows.select(key, F.explode(parsed).alias("entry", "values")).select(key, "entry", F.explode("values").alias("value"))
