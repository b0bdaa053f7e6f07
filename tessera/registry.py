"""Query name -> function over the driver's tables, and its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import graphs, lags, lanes, lineages, ranking, scalars, searches, texts, timelines

MODULES = (texts, ranking, timelines, graphs, lanes, scalars, lags, lineages, searches)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
