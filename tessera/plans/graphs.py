"""Families, credit forests, vectors, date evidence, upserts, reports and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.durable import settle
from tessera.operators import checks, dates, forest, schedule, vectors
from tessera.sources import sinks
from tessera.sources.tables import table


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who bought of a part on a market segment: family = (part, segment), time = first order, strength by quantity."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = j.groupBy(F.concat_ws("|", "l_partkey", "c_mktsegment").alias("family"), F.col("c_custkey").alias("item")).agg(F.sum("l_quantity").alias("q"))
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.min(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))).alias("time"))
    return m.filter("q >= 40").join(first, "item").select("family", "item", "time", F.least(F.col("q") / 80, F.lit(1.0)).alias("strength"))


_MEMBERS = """m0 AS (SELECT l_partkey || '|' || c_mktsegment AS family, c_custkey AS item, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ft AS (SELECT o_custkey AS item, min(datediff('day', DATE '1990-01-01', o_orderdate::DATE)) AS time FROM orders GROUP BY 1),
m AS (SELECT family, item, time, least(q / 80, 1.0) AS strength FROM m0 JOIN ft USING (item) WHERE q >= 40),
fam AS (SELECT family, count(DISTINCT item) AS size, round(log2((SELECT count(*) FROM customer)::DOUBLE / count(DISTINCT item)), 6) AS specificity FROM m GROUP BY 1 HAVING count(DISTINCT item) >= 2),
mm AS (SELECT m.*, specificity FROM m JOIN fam USING (family)),
pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS n_families, round(sum(x.specificity * sqrt(least(x.strength, y.strength))), 6) AS score FROM mm x JOIN mm y ON x.family = y.family AND x.time < y.time GROUP BY 1, 2),
cred AS (SELECT a, count(*) AS ref_count FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS k FROM pairs) WHERE k = 1 GROUP BY 1),
tree AS (SELECT a, b, score, ref_count FROM (SELECT p.*, coalesce(ref_count, 0) AS ref_count, row_number() OVER (PARTITION BY b ORDER BY coalesce(ref_count, 0) DESC, score DESC, a) AS k FROM (SELECT *, max(score) OVER (PARTITION BY b) AS top FROM pairs) p LEFT JOIN cred USING (a) WHERE score >= 0.5 * top) WHERE k = 1)"""


def families(spark: SparkSession, sf: str) -> DataFrame:
    return forest.families(_members(spark, sf), table(spark, sf, "customer").count())


def family_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = _members(spark, sf)
    return forest.family_scores(m, forest.families(m, table(spark, sf, "customer").count()))


def argmax_parent(spark: SparkSession, sf: str) -> DataFrame:
    return forest.parents(family_scores(spark, sf))


def secondary_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = family_scores(spark, sf)
    return forest.secondary(p, forest.parents(p), 8)


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("node")), settle(argmax_parent(spark, sf))


def forest_depth(spark: SparkSession, sf: str) -> DataFrame:
    nodes, tree = _tree(spark, sf)
    up = forest.ancestry(nodes, tree)
    deepest = up.agg(F.max("depth")).first()[0] or 0
    return up.join(forest.descendants(nodes, tree, max(1, deepest)), "node")


def katz(spark: SparkSession, sf: str) -> DataFrame:
    nodes, tree = _tree(spark, sf)
    return forest.katz(nodes, tree.select("a", "b"), 0.2)


def bounded_paths(spark: SparkSession, sf: str) -> DataFrame:
    _, tree = _tree(spark, sf)
    e = tree.select("a", "b", "score", (F.col("ref_count") >= 20).alias("generic"))
    return forest.paths(e, 3, 6, 1).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "n", "score", "n_generic")


def greedy_diverse(spark: SparkSession, sf: str) -> DataFrame:
    _, tree = _tree(spark, sf)
    p = forest.paths(tree.select("a", "b", "score", F.lit(False).alias("generic")), 3, 3, 0).select(F.element_at("path", 1).alias("root"), "path", "score")
    return schedule.diverse_paths(p, "root", "score", "path", 3, 1).select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "score")


def evidence_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """A part's year from order dates (authoritative), ship dates (a bound) and a size-derived claim."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    orders = j.groupBy(F.col("l_partkey").alias("work_id")).agg(F.min(F.year("o_orderdate")).alias("year")).select("work_id", F.lit("orders").alias("family"), "year", F.lit(11).alias("precision"), F.lit(True).alias("authoritative"), F.lit(False).alias("bound"))
    ships = j.groupBy(F.col("l_partkey").alias("work_id")).agg(F.min(F.year("l_shipdate")).alias("year")).select("work_id", F.lit("ships").alias("family"), "year", F.lit(11).alias("precision"), F.lit(False).alias("authoritative"), F.lit(True).alias("bound"))
    claim = table(spark, sf, "part").select(F.col("p_partkey").alias("work_id"), F.lit("claim").alias("family"), (F.col("p_size") % 12 + 1988).cast("int").alias("year"), F.when(F.col("p_size") % 5 == 0, 8).otherwise(9).alias("precision"), F.lit(False).alias("authoritative"), F.lit(False).alias("bound"))
    return dates.decide(orders.unionByName(ships).unionByName(claim))


def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    full = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, full).when(F.col("o_orderkey") % 3 == 1, F.substring(full, 1, 7)).otherwise(F.substring(full, 1, 4))
    p = table(spark, sf, "orders").select("o_orderkey", dates.partial(text).alias("d"))
    return p.select("o_orderkey", "d.precision", dates.time_value(F.col("d.year"), F.col("d.month"), F.col("d.day")).alias("time_value"))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.nearest_centroids(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", 3)


def barycentre(spark: SparkSession, sf: str) -> DataFrame:
    """Customers placed at the weighted mean of their segments' anchors, weights by orders sharpened."""
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    w = vectors.sharpened(o, "o_custkey", "n", 2.0)
    at = F.ascii("o_orderpriority") - F.lit(49)
    return w.groupBy("o_custkey").agg(F.round(F.sum(F.col("weight") * at), 6).alias("x"), F.round(F.sum(F.col("weight") * at * at), 6).alias("y"))


def force_layout(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias("node"), F.col("n_nationkey").cast("double").alias("time"))
    e = n.alias("x").join(n.alias("y"), (F.col("x.region") == F.col("y.region")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.region").alias("region"), F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(1.0).alias("weight"))
    return vectors.layout(n, e, "region")


def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return checks.report([
        checks.orphans(t("lineitem"), "line_order", "l_orderkey", "l_partkey", t("part").filter("p_size > 2"), "p_partkey"),
        checks.orphans(t("orders"), "order_customer", "o_orderkey", "o_custkey", t("customer"), "c_custkey"),
        checks.broken(t("lineitem"), "discount_range", "l_orderkey", F.col("l_discount").between(0.0, 0.09), F.col("l_linenumber")),
        checks.broken(t("events"), "value_range", "event_id", F.col("value") < 300, F.col("event_type")),
        checks.duplicates(t("lineitem"), "line_twice", ["l_orderkey", "l_linenumber"]),
    ])


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.content_hash(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    old = c.filter("c_custkey % 3 != 0").withColumn("c_mktsegment", F.lit("KEPT"))
    return sinks.upsert(old, c.filter("c_custkey % 3 != 1"), ["c_custkey"], keep=("c_mktsegment",))


def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return sinks.stale(c, c.filter("c_custkey % 4 = 0"), table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", ("c_acctbal",))


def done_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a finished order."""
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def symmetric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of each nation pair of a region, once."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), "n_regionkey")
    p = n.join(n.withColumnRenamed("a", "b"), "n_regionkey").filter("a < b").select("a", "b")
    return p.union(p.select("b", "a")).distinct()


def status_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the tables, and of distinct keys that others use."""
    one = lambda name, df, col: df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col).alias("n_distinct")).select(F.lit(name).alias("item"), "n", "n_distinct")
    t = lambda n: table(spark, sf, n)
    parts = [one("orders", t("orders"), "o_custkey"), one("lineitem", t("lineitem"), "l_partkey"), one("events", t("events"), "user_id"), one("documents", t("documents"), "source")]
    return checks.report(parts)


def source_report(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    base = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.round(F.avg(F.when(F.col("toxic").isNotNull(), F.col("n_chars"))), 4).alias("mean_labelled"))
    by_lang = d.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)))
    return base.join(by_lang.na.fill(0), "source")


def decade_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", F.array(F.lit(0.5), F.lit(0.99))).alias("q")).select("decade", "o_orderstatus", "n", F.round(F.get("q", F.lit(0)), 4).alias("median"), F.round(F.get("q", F.lit(1)), 4).alias("p99"))


def previous_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Days since a customer's previous order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


SQL = {
    "families": f"WITH {_MEMBERS} SELECT * FROM fam",
    "family_scores": f"WITH {_MEMBERS} SELECT * FROM pairs",
    "argmax_parent": f"WITH {_MEMBERS} SELECT a, b, score, ref_count FROM tree",
    "secondary_edges": f"""WITH {_MEMBERS} SELECT a, b, score, nth::INT AS nth FROM (SELECT p.a, p.b, p.score, row_number() OVER (PARTITION BY p.b ORDER BY p.score DESC, p.a) AS nth FROM pairs p ANTI JOIN tree t ON p.a = t.a AND p.b = t.b) WHERE nth <= 8""",
    "forest_depth": f"""WITH RECURSIVE {_MEMBERS},
up AS (SELECT c_custkey AS node, c_custkey AS root, 0 AS depth FROM customer UNION ALL SELECT up.node, tree.a, up.depth + 1 FROM up JOIN tree ON up.root = tree.b),
last AS (SELECT node, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1), dn AS (SELECT root AS node, count(*) AS d FROM up WHERE depth > 0 GROUP BY 1)
SELECT node, root, depth, coalesce(d, 0) AS descendants FROM last LEFT JOIN dn USING (node)""",
    "katz": f"""WITH RECURSIVE {_MEMBERS}, up AS (SELECT c_custkey AS node, c_custkey AS top, 0 AS depth FROM customer UNION ALL SELECT up.node, tree.a, up.depth + 1 FROM up JOIN tree ON up.top = tree.b)
SELECT c_custkey AS node, round(coalesce(k, 0), 6) AS katz FROM customer LEFT JOIN (SELECT top, sum(power(0.2::DOUBLE, depth - 1)) AS k FROM up WHERE depth > 0 GROUP BY 1) ON top = c_custkey""",
    "bounded_paths": f"""WITH RECURSIVE {_MEMBERS}, e AS (SELECT a, b, score, (ref_count >= 20)::INT AS g FROM tree),
p AS (SELECT a || '>' || b AS path, 2 AS n, score, g AS n_generic, b AS last FROM e WHERE g <= 1
UNION ALL SELECT path || '>' || e.b, n + 1, p.score + e.score, n_generic + g, e.b FROM p JOIN e ON last = e.a WHERE n < 6 AND n_generic + g <= 1)
SELECT path, n, round(score, 6) AS score, n_generic FROM p WHERE n >= 3""",
    "evidence_cascade": """WITH j AS (SELECT l_partkey AS w, min(year(o_orderdate)) AS o, min(year(l_shipdate)) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
x AS (SELECT p_partkey AS work_id, o, s, p_size % 12 + 1988 AS c, p_size % 5 <> 0 AS c1 FROM part LEFT JOIN j ON w = p_partkey),
y AS (SELECT *, CASE WHEN s IS NOT NULL THEN NOT (s < o - 2 AND (NOT c1 OR s < c - 2) AND NOT (abs(o - s) <= 1 OR (c1 AND abs(c - s) <= 1))) END AS s1 FROM x),
z AS (SELECT *, CASE WHEN o IS NOT NULL THEN NOT (s1 AND o > s) END AS o1 FROM y),
v AS (SELECT *, c1 AND NOT coalesce(o1 AND c < o AND NOT ((o1 AND abs(o - c) <= 1) OR (s1 AND abs(s - c) <= 1)), false) AS c2 FROM z),
r AS (SELECT work_id, CASE WHEN o1 THEN o END AS o, CASE WHEN s1 THEN s END AS s, CASE WHEN c2 THEN c END AS c, (CASE WHEN o IS NULL THEN 1 ELSE 3 END) AS total FROM v),
q AS (SELECT *, least(o, s, c) AS yr FROM r)
SELECT work_id, yr::INT AS year, CASE WHEN yr IS NULL THEN 'none' WHEN coalesce((o - yr <= 1)::INT, 0) + coalesce((s - yr <= 1)::INT, 0) + coalesce((c - yr <= 1)::INT, 0) >= 2 THEN 'high' WHEN greatest(o, s, c) > yr + 2 THEN 'review' ELSE 'medium' END AS confidence,
(o IS NOT NULL)::BIGINT + (s IS NOT NULL)::BIGINT + (c IS NOT NULL)::BIGINT AS n_accepted, total - ((o IS NOT NULL)::BIGINT + (s IS NOT NULL)::BIGINT + (c IS NOT NULL)::BIGINT) AS n_rejected FROM q""",
    "partial_dates": """SELECT o_orderkey, (11 - o_orderkey % 3)::INT AS precision, round(least(year(o_orderdate) + CASE o_orderkey % 3 WHEN 0 THEN (dayofyear(o_orderdate) - 0.5::DOUBLE) / 365.25::DOUBLE WHEN 1 THEN (month(o_orderdate) - 0.5::DOUBLE) / 12 ELSE 0.5::DOUBLE END, year(o_orderdate) + 0.99999::DOUBLE), 6) AS time_value FROM orders""",
    "cosine_topk": """WITH c AS (SELECT label, list(v ORDER BY i) AS centroid FROM (SELECT label, i, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT vec_id, label_c AS label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS cosine FROM embeddings, (SELECT label AS label_c, centroid FROM c))
SELECT vec_id, rank::INT AS rank, label, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank FROM j) WHERE rank <= 3""",
    "barycentre": """WITH o AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, power(n / max(n) OVER (PARTITION BY o_custkey)::DOUBLE, 2) AS w FROM o), w AS (SELECT *, round(w / sum(w) OVER (PARTITION BY o_custkey), 6) AS weight, ascii(o_orderpriority) - 49 AS pos FROM p)
SELECT o_custkey, round(sum(weight * pos), 6) AS x, round(sum(weight * pos * pos), 6) AS y FROM w GROUP BY 1""",
    "contract_violations": """SELECT 'line_order' AS rule, l_orderkey::VARCHAR AS key, l_partkey::VARCHAR AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)
UNION ALL SELECT 'order_customer', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'discount_range', l_orderkey::VARCHAR, l_linenumber::VARCHAR FROM lineitem WHERE NOT l_discount BETWEEN 0.0::DOUBLE AND 0.09::DOUBLE
UNION ALL SELECT 'value_range', event_id::VARCHAR, event_type FROM events WHERE NOT value < 300
UNION ALL SELECT 'line_twice', l_orderkey || '|' || l_linenumber, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "content_hash": """WITH h AS (SELECT sha256(n_nationkey || chr(31) || n_name || chr(31) || n_regionkey) AS h FROM nation), b AS (SELECT substring(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY b)) AS content_sha256, sum(n)::BIGINT AS n_rows FROM b""",
    "upsert_merge": "SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN 'KEPT' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "stale_rows": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "done_jobs": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "symmetric_pairs": "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey",
    "status_dashboard": """SELECT 'orders' AS item, count(*) AS n, count(DISTINCT o_custkey) AS n_distinct FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'events', count(*), count(DISTINCT user_id) FROM events UNION ALL SELECT 'documents', count(*), count(DISTINCT source) FROM documents""",
    "source_report": """SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, round(avg(n_chars) FILTER (WHERE toxic IS NOT NULL), 4) AS mean_labelled,
count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "decade_counts": "SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, o_orderstatus, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1, 2",
    "previous_orders": "SELECT o_orderkey, datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::INT AS days FROM orders",
}
QUERIES = [families, family_scores, argmax_parent, secondary_edges, forest_depth, katz, bounded_paths, greedy_diverse, evidence_cascade, partial_dates, cosine_topk, barycentre, force_layout, contract_violations, content_hash, upsert_merge, stale_rows, done_jobs, symmetric_pairs, status_dashboard, source_report, decade_counts, previous_orders]
