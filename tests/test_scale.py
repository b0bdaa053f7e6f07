"""Ranks and sums over ranges, quantile thresholds, tables replaced and hashed: against plain restatements."""

import random
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from math import log
from operator import add

import numpy as np
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import forest, fusion, ranks, stats
from tessera.sources import sinks


def test_running_sums_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 20), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "x int, i int, v int")
    got = {r.i: (r["rank"], r.s) for r in ranks.running(df, [F.desc("x"), F.asc("i")], {"rank": F.lit(1), "s": F.col("v")}).collect()}
    total = 0
    for k, (_, i, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += v or 0
        assert got[i] == (k, total)
    assert ranks.ranked(df.limit(0), [F.asc("i")]).collect() == []


def test_tail_threshold(spark):
    rng = np.random.default_rng(3)
    for n in (1, 7, 900, 4000):
        v = np.round(rng.exponential(size=n), 2)
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        for fpr in (0.01, 0.0001):
            u = np.quantile(v, 0.99)
            above = v[v > u]
            want = np.sort(v)[::-1][int(fpr * n)] if int(fpr * n) >= 10 else u + log(0.01 / fpr) * (np.mean(above - u) if len(above) else 0)
            r = stats.exponential_tail(df, "v", fpr).first()
            assert r.n == n and abs(r.threshold - want) < 1e-5


def test_final_set_evicts_the_worst(spark):
    rng = random.Random(9)
    for _ in range(3):
        works = [(i, rng.choice([None, *range(40)]), rng.choice([1990, 1991, 1992, None])) for i in range(40)]
        order = sorted(works, key=lambda w: (w[1] is None, w[1] or 0, w[0]))
        per, nth = {}, {}
        for i, _, y in order:
            per[y] = per.get(y, 0) + 1
            nth[i] = per[y]
        safe = {i for i, _, y in order if y in (1990, 1991) and nth[i] <= 4}
        kept = [i for k, (i, _, _) in enumerate(order) if k < 12 or i in safe]
        for i in [i for i in reversed(kept) if i not in safe][: max(0, len(kept) - 12)]:
            kept.remove(i)
        got = fusion.final_set(spark.createDataFrame(works, "work_id int, rank int, year int"), 12, 4, 1990, 1991).collect()
        assert {(r.work_id, r.protected) for r in got} == {(i, i in safe) for i in kept}


def test_katz_follows_long_chains(spark):
    nodes = spark.range(30).select(F.col("id").alias("node"))
    chain = spark.range(29).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.katz for r in forest.katz(nodes, chain, 0.9).collect()}
    want = [0.0]
    for _ in range(29):
        want.append(1 + 0.9 * want[-1])
    assert all(abs(got[i] - want[29 - i]) < 1e-6 for i in range(30))


def test_a_replaced_table_is_found_again(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and {p.name for p in tmp_path.iterdir()} == {"t"}
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a writer leaves it that is lost between the renames
    assert sinks.restore_table(spark, path) and spark.read.parquet(path).count() == 5
    assert not sinks.restore_table(spark, path)


def test_content_hash_in_levels(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    for digits, levels in ((2, 1), (1, 3)):
        one = sinks.content_hash(df, ["id"], digits, levels).first()
        assert one == sinks.content_hash(df.repartition(5), ["id"], digits, levels).first() and one.n_rows == 500
        assert one != sinks.content_hash(df.withColumn("v", F.col("v") + (F.col("id") == 3).cast("int")), ["id"], digits, levels).first()


def test_prices_that_tie_rank_by_part_whatever_the_order_of_rows(spark, tmp_path):
    rng, up = random.Random(5), lambda x: Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    mean = lambda v: reduce(add, v) / len(v)  # noqa: E731  sum() corrects its rounding
    while True:  # the mean is half way between two roundings, and the order of the sum decides
        low = [rng.randrange(1_000_000, 10_000_000) / 100 for _ in range(32)]
        high = rng.sample(low, 32)
        if up(mean(low)) < up(mean(high)):
            break
    rows = [(1, part, 1.0, price, 0.0) for part, prices in ((7, low), (8, high)) for price in prices]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.work_id: r.summary for r in registry.queries()["list_summary"](spark, str(tmp_path)).collect()}
    assert got == {k: f"price #{n}; quantity #{n}; revenue #{n}" for n, k in enumerate((7, 8), 1)}


def test_exact_totals_of_odd_values(spark):
    rows = [(1, 0.1), (1, 0.2), (1, None), (2, None), (3, float("inf")), (3, 1.0), (4, 1e20), (4, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(stats.exact_total(F.col("v")).alias("s"), stats.exact_total(F.col("v"), True).alias("m"))
    assert {r.k: (r.s, r.m) for r in df.collect()} == {1: (0.3, 0.15), 2: (None, None), 3: (float("inf"), float("inf")), 4: (1e20, 5e19)}
