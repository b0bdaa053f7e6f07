"""Stretches of lines, kept results, ledgers, reports and politeness over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evidence, fusion, search, store
from tessera.sources.tables import table

from . import texts
from .lags import _SEQ, _lines, _numbered


def best_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's stretch of events that is richest in views and clicks."""
    m = _numbered(spark, sf).select("user_id", "i", F.col("token").isin(0, 4).cast("int").alias("hit"))
    return search.best_runs(m, ["user_id"], "i", "hit", 1.0, 0.2, 6.0)


def refined_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Days from order to shipping, by status."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date"))
    return search.refined(j.select("l_linestatus", day("o_orderdate").alias("a"), day("l_shipdate").alias("b")), ["l_linestatus"], "a", "b")


def looped_bars(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    total, period = F.lit(60), (F.col("p_partkey") % 7 + 2).cast("int")
    return p.select("p_partkey", F.array_join(F.transform(search.looped(F.col("p_size") + 4, F.lit(16), total, period), lambda x: x.cast("string")), ".").alias("bars"))


def chord_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """A user's line against itself one event later, each event a chord of its code and the next."""
    x = _lines(spark, sf).filter(F.size("tokens") >= 2)
    chord = F.transform("tokens", lambda t: F.array(t, F.pmod(t + 1, F.lit(5))))
    return x.select("user_id", search.agreement(chord, F.slice(chord, F.lit(2), F.size("tokens") - 1)).alias("agreement"))


def over_chance(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of documents' best passages against a sample of all pair scores."""
    p = texts._pairs(spark, sf).select("a", "b", "z")
    return search.over_chance(p, fusion.hash_sample(p, ["a", "b"], 1000), "z")


def shared_hulls(spark: SparkSession, sf: str) -> DataFrame:
    """Where the five-word runs that a document and a passage share lie in both."""
    grams = texts.sequences.let(texts.words("text"), lambda w: F.transform(texts.sequences.ngrams(w, 5), lambda g: F.array_join(g, " ")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("a"), F.posexplode(grams).alias("i", "key"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("b"), F.posexplode(grams).alias("j", "key"))
    if b.limit(evidence.FEW).count() < evidence.FEW:  # the passages' runs go to all tasks while there are few of them
        b = F.broadcast(b)
    return search.hulls(d.join(b, "key"), ["a", "b"], "i", "j", 5)


def kept_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of an earlier run (all parts but every fifth, some of another version or content), and what is still to do."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    kept = p.filter("p_partkey % 5 != 0").select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 7 == 0, F.lit("old")).otherwise(F.col("p_name")), 256).alias("sha"), F.when(F.col("p_partkey") % 11 == 0, "v0").otherwise("v1").alias("version"), F.lit(0).alias("length"))
    todo = store.missing(p, kept, F.col("p_name"), "v1", "p_partkey")
    fresh = todo.select("p_partkey", "sha", F.lit("v1").alias("version"), F.length("p_name").alias("length"))
    return store.with_kept(fresh, kept, p.filter("p_size > 3"), "p_partkey").select("p_partkey", "version", "length")


def due_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as jobs, their orders as attempts: done if one is finished."""
    ledger = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("done"))
    return store.due(table(spark, sf, "customer").select("c_custkey"), ledger, "c_custkey", 12).select("c_custkey", "attempts")


def agreed_settings(spark: SparkSession, sf: str) -> DataFrame:
    return store.agreed(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


def polite_times(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as requests that keep 30 hours apart."""
    return store.polite(_numbered(spark, sf), "user_id", ["i"], "beat", 30.0).select("event_id", F.round("allowed", 4).alias("allowed"))


def json_reports(spark: SparkSession, sf: str) -> DataFrame:
    r = store.report(table(spark, sf, "events"), "event_type", "value", [0.5, 0.9], 50.0)
    x = F.from_json("report", "struct<n:bigint,quantiles:array<double>,histogram:array<struct<bin:bigint,n:bigint>>>")
    return r.select("event_type", x.alias("x")).select("event_type", "x.n", F.get("x.quantiles", F.lit(0)).alias("median"), F.size("x.histogram").alias("n_bins"), F.element_at("x.histogram", -1)["n"].alias("last_bin"))


SQL = {
    "best_runs": f"""WITH {_SEQ}, m AS (SELECT user_id, i, (token IN (0, 4))::INT AS hit, sum((token IN (0, 4))::INT) OVER (PARTITION BY user_id ORDER BY i) AS h FROM seq), x AS (SELECT * FROM m WHERE hit = 1),
j AS (SELECT x.user_id, x.i AS first, y.i AS last, y.h - x.h + 1 AS hits, y.i - x.i + 1 - (y.h - x.h + 1) AS misses FROM x JOIN x y ON x.user_id = y.user_id AND y.i >= x.i),
w AS (SELECT user_id, first, last, round((hits - 1.0::DOUBLE * misses) * (1 + 0.2::DOUBLE * (hits - 1)) - 6, 6)::DOUBLE AS weight FROM j)
SELECT user_id, first::INT AS first, last::INT AS last, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, first, last) AS k FROM w) WHERE k = 1""",
    "refined_offsets": """WITH p AS (SELECT l_linestatus, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT l_linestatus, quantile_cont(d, 0.5)::DOUBLE AS o, count(*) AS n FROM p GROUP BY 1)
SELECT l_linestatus, round(o, 6) AS "offset", n, round(avg(abs(d - o)), 6) AS spread FROM p JOIN m USING (l_linestatus) GROUP BY 1, 2, 3""",
    "looped_bars": """WITH x AS (SELECT p_partkey, p_size + 4 AS s, p_partkey % 7 + 2 AS p FROM part) SELECT p_partkey, array_to_string(list_transform(range(16), lambda i: CASE WHEN s + i < 60 THEN s + i ELSE 60 - p + (s + i - 60) % p END), '.') AS bars FROM x""",
    "chord_agreement": f"""WITH {_SEQ} SELECT a.user_id, round(avg(CASE WHEN a.token = b.token THEN 1.0::DOUBLE WHEN (a.token - b.token + 5) % 5 IN (1, 4) THEN 0.5 ELSE 0 END), 6) AS agreement FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.i = a.i + 1 GROUP BY 1""",
    "over_chance": f"""WITH {texts._PAIRS}, smp AS (SELECT z FROM pairs ORDER BY md5(a || '|' || b), a, b LIMIT 1000) SELECT a, b, z, round((SELECT count(*) FROM smp WHERE smp.z < p.z) / (SELECT count(*) FROM smp)::DOUBLE, 6) AS percentile FROM pairs p""",
    "shared_hulls": r"""WITH d AS (SELECT doc_id AS a, w, unnest(range(len(w) - 4)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM documents) WHERE len(w) >= 5), b AS (SELECT item_id AS b, w, unnest(range(len(w) - 4)) AS j FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM benchmark) WHERE len(w) >= 5),
x AS (SELECT a, i, array_to_string(w[i + 1:i + 5], ' ') AS key FROM d), y AS (SELECT b, j, array_to_string(w[j + 1:j + 5], ' ') AS key FROM b)
SELECT a, b, min(i)::INT AS a_start, (max(i) + 5)::INT AS a_end, min(j)::INT AS b_start, (max(j) + 5)::INT AS b_end, count(DISTINCT j) AS n FROM x JOIN y USING (key) GROUP BY 1, 2""",
    "kept_results": """WITH s AS (SELECT p_partkey, p_name, p_size, p_partkey % 5 <> 0 AS kept, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS good FROM part)
SELECT p_partkey, 'v1' AS version, length(p_name)::INT AS length FROM s WHERE NOT (kept AND good) UNION ALL SELECT p_partkey, 'v1', 0 FROM s WHERE kept AND good AND p_size > 3""",
    "due_jobs": """WITH l AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n, 0) AS attempts FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE NOT coalesce(done, false) AND coalesce(n, 0) < 12""",
    "agreed_settings": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY 1",
    "polite_times": f"WITH {_SEQ} SELECT event_id, round(max(beat - i * 30) OVER (PARTITION BY user_id ORDER BY i) + i * 30, 4) AS allowed FROM seq",
    "json_reports": """WITH h AS (SELECT event_type, floor(value / 50) AS bin, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, count(*)::INT AS n_bins, arg_max(n, bin) AS last_bin FROM h GROUP BY 1)
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS median, n_bins, last_bin FROM events JOIN b USING (event_type) GROUP BY event_type, n_bins, last_bin""",
}
QUERIES = [best_runs, refined_offsets, looped_bars, chord_agreement, over_chance, shared_hulls, kept_results, due_jobs, agreed_settings, polite_times, json_reports]
