"""Ranked lists over lineitem: suppliers by revenue, quantity and price rank the parts they sell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.durable import settle
from tessera.operators import fusion, ranks, stats
from tessera.sources.tables import table

#: name, value, whether its mean or its sum counts
MEASURES = (("revenue", "l_extendedprice * (1 - l_discount)", False), ("quantity", "l_quantity", False), ("price", "l_extendedprice", True))
#: list weights; a list with a pseudo-rank gives it to all its entries
LISTS = (("revenue", 6.0, None), ("quantity", 3.0, None), ("price", 1.5, 250))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[stats.exact_total(F.expr(e), mean).alias(n) for n, e, mean in MEASURES])
    # as DuckDB rounds: of the double, not of its shortest decimal form
    per = settle(per.select("l_partkey", *[(F.round(F.col(n) * 1e4) / 1e4).alias(n) for n, _, _ in MEASURES]))
    one = lambda n: ranks.ranked(per, [F.desc(n), F.asc("l_partkey")]).select(F.lit(n).alias("list_id"), F.col("rank").cast("int").alias("rank"), F.col("l_partkey").alias("work_id"), F.when(F.col("l_partkey") % 2 == 0, 1.0).otherwise(0.5).alias("weight_factor"))
    return one("revenue").unionByName(one("quantity")).unionByName(one("price"))


def _lists(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("list_id"), F.lit(w).alias("weight"), F.lit(p).cast("int").alias("pseudo_rank")) for i, w, p in LISTS]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_entries(spark, sf), _lists(spark))


_FUSED = """
per AS (SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1),
e AS (
  SELECT 'revenue' AS list_id, row_number() OVER (ORDER BY revenue DESC, l_partkey) AS rank, l_partkey AS work_id FROM per
  UNION ALL SELECT 'quantity', row_number() OVER (ORDER BY quantity DESC, l_partkey), l_partkey FROM per
  UNION ALL SELECT 'price', row_number() OVER (ORDER BY price DESC, l_partkey), l_partkey FROM per),
lists(list_id, weight, pseudo) AS (VALUES ('revenue', 6.0::DOUBLE, NULL::INT), ('quantity', 3.0, NULL), ('price', 1.5, 250)),
f AS (SELECT work_id, round(sum(weight * (CASE WHEN work_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5 END) / (60 + coalesce(pseudo, rank))), 9) AS score, count(DISTINCT list_id) AS n_lists FROM e JOIN lists USING (list_id) GROUP BY 1),
fused AS (SELECT work_id, score, n_lists, row_number() OVER (ORDER BY score DESC, n_lists DESC, work_id)::INT AS rank FROM f)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Parts ranked by fusion, with the year they were first ordered."""
    first = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("work_id")).agg(F.min(F.year("o_orderdate")).alias("year"))
    return rrf_fusion(spark, sf).join(first, "work_id", "left").select("work_id", "rank", "year")


_RANKED = (
    _FUSED
    + """,
first AS (SELECT l_partkey AS work_id, min(year(o_orderdate))::INT AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
ranked AS (SELECT work_id, rank, year FROM fused LEFT JOIN first USING (work_id))"""
)


def rrf_pool_floor(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.pool(_ranked(spark, sf), 100, 40, 1995, 2001)


def final_set_quota(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.final_set(_ranked(spark, sf), 150, 12, 1995, 2001)


def canonical_member(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return fusion.best_member(rows, "p_name", "p_brand", "l_extendedprice")


def list_summary(spark: SparkSession, sf: str) -> DataFrame:
    best = _entries(spark, sf).groupBy("work_id", "list_id").agg(F.min("rank").alias("rank"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "list_id")))
    return best.groupBy("work_id").agg(F.concat_ws("; ", F.transform(parts, lambda p: F.concat(p["list_id"], F.lit(" #"), p["rank"].cast("string")))).alias("summary"))


def null_aware_combine(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    size = F.when(F.col("n_chars") >= 50, F.least(F.col("n_chars") / 5000.0, F.lit(1.0)))
    score = fusion.weighted_mean([(F.col("quality").cast("double"), 0.35), ((1 - F.col("toxic")).cast("double"), 0.40), (size, 0.25)], places=6)
    return d.select("doc_id", score.alias("total"))


def static_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    score, flags = fusion.penalised(F.lit(1.0), [(F.col("n_chars") < 200, 0.5, "short"), (F.col("n_chars") > 20000, 0.7, "long"), (F.col("text").contains("!!"), 0.6, "shouting"), (F.col("text").contains(" | "), 0.4, "table")])
    return d.select("doc_id", score.alias("quality"), F.concat_ws(",", flags).alias("flags"))


def candidates_top(spark: SparkSession, sf: str) -> DataFrame:
    """Four best orders a customer after equal prices count once."""
    o = table(spark, sf, "orders")
    once = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", "o_totalprice").orderBy("o_orderkey"))).filter("n = 1")
    return fusion.top_k(once, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", "o_totalprice", "nth")


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hash_sample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"], 100)


def first_week(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.sources.tables import earliest_week

    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("week"))
    return earliest_week(o, ["o_custkey", "o_orderpriority"], "week")


SQL = {
    "rrf_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "rrf_pool_floor": f"""WITH {_RANKED},
head AS (SELECT * FROM ranked WHERE rank <= 100), have AS (SELECT year, count(*) AS have FROM head GROUP BY 1),
tail AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rank) AS nth FROM ranked WHERE rank > 100 AND year BETWEEN 1995 AND 2001)
SELECT * FROM head UNION ALL SELECT work_id, rank, year FROM tail LEFT JOIN have USING (year) WHERE nth + coalesce(have, 0) <= 40""",
    "final_set_quota": f"""WITH {_RANKED},
g AS (SELECT *, row_number() OVER (ORDER BY rank NULLS LAST, work_id) AS g FROM ranked),
n AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY g) AS nth FROM g),
k AS (SELECT *, coalesce(year BETWEEN 1995 AND 2001 AND nth <= 12, false) AS protected FROM n),
kept AS (SELECT * FROM k WHERE g <= 150 OR protected),
w AS (SELECT *, CASE WHEN NOT protected THEN row_number() OVER (PARTITION BY protected ORDER BY g DESC) END AS worst, count(*) OVER () AS size FROM kept)
SELECT work_id, protected FROM w WHERE worst IS NULL OR worst > greatest(size - 150, 0)""",
    "canonical_member": """WITH t AS (SELECT p_name, p_brand, round(sum(l_extendedprice), 6) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_name, p_brand, total FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY total DESC, p_brand) AS n FROM t) WHERE n = 1""",
    "list_summary": f"WITH {_FUSED} SELECT work_id, string_agg(list_id || ' #' || rank, '; ' ORDER BY rank, list_id) AS summary FROM e GROUP BY 1",
    "null_aware_combine": """WITH d AS (SELECT doc_id, quality::DOUBLE AS q, (1 - toxic)::DOUBLE AS t, CASE WHEN n_chars >= 50 THEN least(n_chars / 5000.0::DOUBLE, 1.0) END AS s FROM documents LEFT JOIN labels USING (doc_id)),
x AS (SELECT doc_id, coalesce(q * 0.35::DOUBLE, 0) + coalesce(t * 0.4::DOUBLE, 0) + coalesce(s * 0.25::DOUBLE, 0) AS v, (CASE WHEN q IS NULL THEN 0 ELSE 0.35::DOUBLE END) + (CASE WHEN t IS NULL THEN 0 ELSE 0.4::DOUBLE END) + (CASE WHEN s IS NULL THEN 0 ELSE 0.25::DOUBLE END) AS w FROM d)
SELECT doc_id, CASE WHEN w > 0 THEN round(v / w, 6) END AS total FROM x""",
    "static_quality": """SELECT doc_id, round(1.0::DOUBLE * (CASE WHEN n_chars < 200 THEN 0.5::DOUBLE ELSE 1 END) * (CASE WHEN n_chars > 20000 THEN 0.7::DOUBLE ELSE 1 END) * (CASE WHEN contains(text, '!!') THEN 0.6::DOUBLE ELSE 1 END) * (CASE WHEN contains(text, ' | ') THEN 0.4::DOUBLE ELSE 1 END), 4) AS quality,
concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'table' END) AS flags FROM documents""",
    "candidates_top": """WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_totalprice ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)
SELECT o_custkey, o_orderkey, o_totalprice, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM once) WHERE nth <= 4""",
    "hash_sample": "SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ORDER BY md5(l_orderkey || '|' || l_linenumber), 1, 2 LIMIT 100",
    "first_week": "SELECT o_custkey, o_orderpriority, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_week FROM orders GROUP BY 1, 2",
}
QUERIES = [rrf_fusion, rrf_pool_floor, final_set_quota, canonical_member, list_summary, null_aware_combine, static_quality, candidates_top, hash_sample, first_week]
