"""Writing results: upsert, replace by key, stale rows, atomic replacement, content hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows win over old ones of the same key, but for the columns keep, which an old row retains."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    is_new, is_old = (F.coalesce(*[F.col(f"{s}.{k}") for k in key]).isNotNull() for s in "no")
    return rows.select(*[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keep else F.when(is_new, F.col(f"n.{c}")).when(is_old, F.col(f"o.{c}")).alias(c) for c in old.columns])


def replace_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Delete-then-insert: all old rows of a key that new has go."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def stale(old: DataFrame, listed: DataFrame, referenced: DataFrame, key: str, blank: tuple[str, ...]) -> DataFrame:
    """Rows of old that are not listed any more: those still referenced stay with blank columns null, others go."""
    missing = old.join(listed.select(key).distinct(), key, "left_anti")
    held = missing.join(referenced.select(key).distinct(), key, "left_semi")
    held = held.select(*[F.lit(None).cast(t).alias(c) if c in blank else F.col(c) for c, t in old.dtypes])
    return old.join(listed.select(key).distinct(), key, "left_semi").unionByName(held)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside path, sets the old table aside, and renames the new one to path. A reader finds the old table, the new
    one or, between the two renames, none; a writer that is lost there leaves both whole, and restore_table() or the next
    call puts the old one back."""
    restore_table(df.sparkSession, path)
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    aside = hadoop(f"{path}.old")
    if fs.exists(hadoop(path)) and not fs.rename(hadoop(path), aside):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(hadoop(fresh), hadoop(path)):
        restore_table(spark, path)
        raise OSError(f"cannot publish {path}")
    fs.delete(aside, True)


def restore_table(spark: SparkSession, path: str) -> bool:
    """Puts back the table that a lost replace_table() had set aside; what it left beside a table in place goes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = hadoop(f"{path}.old")
    if not fs.exists(aside):
        return False
    if fs.exists(hadoop(path)):
        return bool(fs.delete(aside, True)) and False
    return bool(fs.rename(aside, hadoop(path)))


def content_hash(df: DataFrame, key: list[str], digits: int = 2, levels: int = 1) -> DataFrame:
    """content_sha256 and n_rows of a table, whatever the order of its rows.

    Rows are hashed; hashes are gathered in order within buckets of the leading digits x levels hash digits, hashed, and
    the buckets' hashes in the same way with digits less at each level: a tree, so nothing larger than a bucket meets in one
    task. One level of two digits suits up to some millions of rows; each further digit holds 16 times as many. The hash
    depends on digits and levels, not on how Spark deals the rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [*key, *sorted(set(df.columns) - set(key))]]), 256)
    per = df.select(row.alias("h")).select(F.col("h").alias("b"), "h", F.lit(1).cast("long").alias("n"))
    for level in range(levels, 0, -1):
        inner = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
        per = per.groupBy(F.substring("b", 1, digits * level).alias("b")).agg(F.sha2(F.concat_ws("", inner), 256).alias("h"), F.sum("n").alias("n"))
    return per.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256).alias("content_sha256"), F.sum("n").alias("n_rows"))
