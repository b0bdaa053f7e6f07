"""Ranked lists: weighted reciprocal-rank fusion, quotas, null-aware combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import settle

from .ranks import ranked

#: Fixed value: the constant added to a rank before it is inverted.
RANK_OFFSET = 60


def fuse(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """work_id, score, n_lists, rank. entries: list_id, rank, work_id, weight_factor; lists: list_id, weight, pseudo_rank.

    An entry adds weight x factor / (60 + rank), where a list with a pseudo-rank gives that rank to all. Entries without
    work are left out. Order: score, then number of lists, both descending, then work_id.
    """
    e = entries.filter("work_id is not null").join(F.broadcast(lists) if lists.isLocal() else lists, "list_id")
    part = F.col("weight") * F.coalesce("weight_factor", F.lit(1.0)) / (RANK_OFFSET + F.coalesce("pseudo_rank", "rank"))
    works = e.groupBy("work_id").agg(F.round(F.sum(part), 9).alias("score"), F.count_distinct("list_id").alias("n_lists"))
    return ranked(settle(works), [F.desc("score"), F.desc("n_lists"), F.asc("work_id")]).withColumn("rank", F.col("rank").cast("int"))


def pool(ranked: DataFrame, top: int, floor: int, first: int, last: int) -> DataFrame:
    """The top works, and from the rest, in rank order, as many as bring each year of first..last to floor."""
    head, tail = ranked.filter(F.col("rank") <= top), ranked.filter((F.col("rank") > top) & F.col("year").between(first, last))
    have = head.groupBy("year").agg(F.count(F.lit(1)).alias("have"))
    tail = tail.withColumn("nth", F.row_number().over(Window.partitionBy("year").orderBy("rank"))).join(have, "year", "left")
    return head.unionByName(tail.filter(F.col("nth") + F.coalesce("have", F.lit(0)) <= floor).select(*head.columns))


def final_set(works: DataFrame, target: int, floor: int, first: int, last: int, key: str = "work_id") -> DataFrame:
    """key and whether it is protected: the best target works and the best floor of each year, less the worst unprotected beyond target."""
    g = ranked(works, [F.col("rank").asc_nulls_last(), F.asc(key)], "g")
    g = g.withColumn("nth", F.row_number().over(Window.partitionBy("year").orderBy("g")))
    protected = F.coalesce(F.col("year").between(first, last) & (F.col("nth") <= floor), F.lit(False))
    kept = g.withColumn("protected", protected).filter((F.col("g") <= target) | F.col("protected"))
    kept = settle(kept)
    over = max(kept.count() - target, 0)
    worst = kept.filter("not protected").orderBy(F.desc("g")).limit(over).select(key)  # as many as are protected beyond the best target
    return kept.join(worst, key, "left_anti").select(key, "protected")


def best_member(rows: DataFrame, group: str, member: str, score: str) -> DataFrame:
    """group, member with the highest total (ties: the smaller member), its total."""
    per = rows.groupBy(group, member).agg(F.round(F.sum(score), 6).alias("total"))
    return per.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), member))).filter("n = 1").drop("n")


def weighted_mean(terms: list[tuple[Column, float]], places: int = 4) -> Column:
    """Mean over the terms that are present, weights renormalised; null if none is."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in terms), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms), F.lit(0.0))
    return F.round(F.try_divide(value, total), places)


def penalised(start: Column, rules: list[tuple[Column, float, str]]) -> tuple[Column, Column]:
    """start times the factor of each rule that holds, and the names of those rules."""
    score = start
    for when, factor, _ in rules:
        score = score * F.when(when, factor).otherwise(1.0)
    return F.round(score, 4), F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, _, name in rules]))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("nth") <= k)


def hash_sample(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows with the smallest hashes of their keys: the same sample every time."""
    return rows.withColumn("h", F.md5(F.concat_ws("|", *keys))).orderBy("h", *keys).limit(k).drop("h")
