"""Exact deduplication by content sort.

Rows are range-partitioned on the normalised text: splitters are sampled from its first SPLIT characters and its
SHA-256, so a splitter is small whatever the texts, and texts with a common beginning still spread out. Each partition
is sorted externally by the whole normalised text, equal texts become neighbours, and the window operator compares
neighbours in full. DataFrame operations only.

A text with many copies would fill one partition. A first pass, over the length and both ends of the texts, finds keys
with more than their share of rows (there can be at most SHARES x partitions of them, which bounds the broadcast);
their rows are dealt to several cells, each cell is sorted and compared like any other text, and the cells' heads,
one row a cell, are then merged by the text's SHA-256.

Defined cases: a null text counts as empty; texts are equal if identical after lower-casing A-Z; rows with a null id
are kept only if no equal text has an id; of several rows with the same id and text one is kept; an empty table gives
an empty result; further columns, whatever their names, are ignored by exact_dedup() and returned by keep_one().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, settle, whole

SPLIT = 64
SHARES = 8


def _sorted_cells(docs: DataFrame, id_col: str, text_col: str, carried: list) -> DataFrame:
    """carried, and _id, _sha, _salt, _cells, _norm: range-partitioned so that a (_head, _sha, _salt) lies in one partition."""
    spark = docs.sparkSession
    text = whole(text_col)
    lower = ascii_lower(text)
    ends = F.xxhash64(F.char_length(text), F.substring(lower, 1, SPLIT), F.substring(lower, -SPLIT, SPLIT))
    keys = docs.select(F.xxhash64(F.char_length(text), ascii_lower(F.substring(text, 1, SPLIT)), ascii_lower(F.substring(text, -SPLIT, SPLIT))).alias("_ends"))
    total = docs.count()
    share = max(32, total // (SHARES * partitions(spark)))
    hot = settle(keys.groupBy("_ends").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share))
    hot = hot.select("_ends", F.ceil(F.col("_n") / share).cast("int").alias("_cells"))
    rows = docs.select(*carried, F.col(id_col).cast("long").alias("_id"), lower.alias("_norm"), ends.alias("_ends"))
    rows = rows.join(F.broadcast(hot), "_ends", "left")  # at most SHARES x partitions rows
    # rows without an id go by the partition they are read in, which a repeated task has too
    salt = F.when(F.col("_cells") > 1, F.pmod(F.xxhash64(F.coalesce("_id", F.spark_partition_id().cast("long"))), F.col("_cells"))).otherwise(F.lit(0)).cast("int")
    rows = rows.select(*[F.col(c) for c in rows.columns if c not in ("_ends", "_cells")], F.coalesce("_cells", F.lit(1)).alias("_cells"), salt.alias("_salt"), F.substring("_norm", 1, SPLIT).alias("_head"), F.sha2("_norm", 256).alias("_sha"))
    return rows.repartitionByRange("_head", "_sha", "_salt")


def _cell() -> Window:
    return Window.partitionBy("_head", "_sha", "_salt", "_norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256. keep: 'smallest' or 'largest' id."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = _sorted_cells(docs, id_col, text_col, [])
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    rows = rows.select("_id", "_sha", "_salt", "_cells", F.count(F.lit(1)).over(_cell()).alias("_n"), best("_id").over(_cell()).alias("_best"), F.row_number().over(_cell().orderBy(order)).alias("_at"))
    rows = settle(rows)
    one = rows.filter("_cells = 1").select("_id", "_sha", "_at", F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"), F.lit(True).alias("_here"))
    # a hot text's cells: a row each, merged per text, then handed back per cell, so no join key holds more than a cell
    heads = rows.filter("_cells > 1 and _at = 1").select("_sha", "_salt", "_n", "_best")
    of_text = Window.partitionBy("_sha")
    heads = heads.select("_sha", "_salt", "_best", best("_best").over(of_text).alias("keep_id"), F.sum("_n").over(of_text).alias("group_size"))
    first = F.min(F.when(F.col("_best").eqNullSafe(F.col("keep_id")), F.col("_salt"))).over(of_text)  # rows without an id lie in several cells
    heads = heads.select("_sha", "_salt", "keep_id", "group_size", (F.col("_salt") == first).alias("_here"))
    many = rows.filter("_cells > 1").join(heads, ["_sha", "_salt"]).select("_id", "_sha", "_at", "keep_id", "group_size", "_here")
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_at") == 1) & F.col("_here")
    return one.unionByName(many).select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were; the texts move once."""
    names = docs.columns
    packed = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = _sorted_cells(docs, id_col, text_col, [packed])
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    heads = rows.withColumn("_at", F.row_number().over(_cell().orderBy(order))).filter("_at = 1")
    many = heads.filter("_cells > 1").withColumn("_at", F.row_number().over(Window.partitionBy("_sha").orderBy(order))).filter("_at = 1")
    return heads.filter("_cells = 1").select("_row").unionByName(many.select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in names])
