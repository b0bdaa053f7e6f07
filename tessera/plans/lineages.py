"""Families by majority, credited passages, labels, hubs, bounded walks, known pairs and tuned rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.durable import settle
from tessera.operators import decision, lineage, matching, vectors
from tessera.sources.tables import table

from . import graphs, texts
from .graphs import _MEMBERS
from .lags import _SEQ, _lines


def tolerant_families(spark: SparkSession, sf: str) -> DataFrame:
    """Users' first four events as loops, keyed by the first."""
    x = _lines(spark, sf).filter(F.size("tokens") >= 4).select("user_id", F.slice("tokens", 1, 4).alias("tokens"), F.get("tokens", F.lit(0)).alias("root"), F.size("tokens").alias("cover"))
    f = lineage.tolerant_keys(x, "root", "user_id", "tokens", "cover")
    return f.select("user_id", "root", "family")


def passage_credits(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of an order's parts, credited to suppliers; quantities stand for bits."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 80).cast("double").alias("start"), (F.col("l_partkey") % 80 + F.col("l_linenumber") + 4).cast("double").alias("end"), F.col("l_quantity").alias("bits"))
    return lineage.passage_credit(l, gap=8.0)


def top_families(spark: SparkSession, sf: str) -> DataFrame:
    """For each pair of nation and part size the brand that sold most."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    c = j.groupBy(F.col("s_nationkey").alias("a"), F.col("p_size").alias("b"), F.col("p_brand").alias("family")).agg(F.sum("l_quantity").alias("score"), F.count(F.lit(1)).alias("close"))
    return lineage.top_family(c)


def unique_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.unique_labels(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("hint")), "p_partkey", "label", "hint").select("p_partkey", "label")


def hub_sizes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, tree = graphs._tree(spark, sf)
    return lineage.hub_sizes(nodes, tree)


def rule_variants(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.rule_variants(settle(graphs.family_scores(spark, sf)), {"best": 1.0, "near": 0.8, "half": 0.5, "any": 0.0})


def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    label = F.lower("p_type")
    return table(spark, sf, "part").select("p_partkey", lineage.edge_weight(label, [("promo", 1.0), ("standard", 0.6), ("s", 0.4)], 0.2).alias("weight"))


def excerpt_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's dearest order over 450,000, else the first urgent one, else days 0 to 16."""
    o = table(spark, sf, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")))
    span = lambda rows, order: rows.withColumn("_n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))).filter("_n = 1").select(F.col("o_custkey").alias("node"), F.col("day").alias("start"), (F.col("day") + 8).alias("end"))
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    dear, urgent = span(o.filter("o_totalprice > 450000"), [F.desc("o_totalprice"), F.asc("o_orderkey")]), span(o.filter("o_orderpriority = '1-URGENT'"), [F.asc("day"), F.asc("o_orderkey")])
    return lineage.excerpts(nodes, [(dear, "edge"), (urgent, "loop"), (nodes.select("node", F.lit(0).alias("start"), F.lit(16).alias("end")), "first")])


def followed_links(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of an even number stand for the part of half the number."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    links = p.filter("node % 2 = 0").select(F.col("node").alias("from"), F.expr("node div 2").alias("to"))
    return matching.follow(p, links, "node", 3)


def class_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in a tree of threes: which of the first ten stand above each, at most five steps up."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    up = c.filter("node > 1").select("node", F.expr("(node + 1) div 3").alias("parent"))
    return matching.reaches(c, up, c.filter("node <= 10").select(F.col("node").alias("goal")), 5)


def edge_families(spark: SparkSession, sf: str) -> DataFrame:
    """Tree edges and the families of both ends whose segment is the later customer's."""
    m = graphs._members(spark, sf)
    _, tree = graphs._tree(spark, sf)
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("b"), F.col("c_mktsegment").alias("label"))
    labels = m.select("family", F.substring_index("family", "|", -1).alias("label")).distinct()
    return matching.edge_families(tree.join(seg, "b").select("a", "b", "label"), m, labels)


def known_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that a document holds whole, among the passages it shares rare runs with."""
    known = texts.substring_match(spark, sf).select(F.col("doc_id").alias("a"), F.col("item_id").alias("b")).distinct()
    return decision.known_pairs(known, texts._pairs(spark, sf), "z", 5.0)


def operating_curve(spark: SparkSession, sf: str) -> DataFrame:
    return decision.operating_curve(texts._guess(spark, sf), "score", F.col("quality") == 1, [0.9, 0.95, 0.98, 0.99])


def tuned_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts of a score, chosen on four fifths of the labelled documents."""
    rules = {f"over {c}": F.col("score") > c for c in (0.9, 0.95, 0.97, 0.98, 0.99)}
    return decision.tuned(texts._guess(spark, sf), "quality", F.col("doc_id") % 5 != 0, rules)


def ranking_report(spark: SparkSession, sf: str) -> DataFrame:
    """Where the own label stands among a vector's nearest centroids."""
    e = table(spark, sf, "embeddings")
    r = vectors.nearest_centroids(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", 100)
    own = r.join(e.select("vec_id", F.col("label").alias("truth")), "vec_id").filter("label = truth")
    return decision.ranking_report(own, "truth", "rank")


def ratio_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders by how far their unit price is from the part's retail price."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = F.abs(F.ln(F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice")))
    b = F.when(d <= 0.04, "<=4%").when(d <= 0.09, "4-9%").when(d <= 0.15, "9-15%").when(d <= 0.35, "15-35%").otherwise(">35%")
    return j.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((d <= 0.04).cast("int")), 6).alias("agree"))


_VARIANT = "SELECT '{n}' AS variant, count(*) AS n_edges, count(DISTINCT a) AS n_parents, round(sum(score), 4) AS total FROM (SELECT p.*, row_number() OVER (PARTITION BY b ORDER BY coalesce(ref_count, 0) DESC, score DESC, a) AS k FROM (SELECT *, max(score) OVER (PARTITION BY b) AS top FROM pairs) p LEFT JOIN cred USING (a) WHERE score >= {s}::DOUBLE * top) WHERE k = 1"
SQL = {
    "tolerant_families": f"""WITH {_SEQ}, l AS (SELECT user_id, list(token ORDER BY i)[1:4] AS t FROM seq GROUP BY 1 HAVING count(*) >= 4), u AS (SELECT user_id, t, t[1] AS root, unnest(t) AS tok, unnest(range(4)) AS at1 FROM l),
m AS (SELECT root, at1, tok FROM (SELECT root, at1, tok, row_number() OVER (PARTITION BY root, at1 ORDER BY count(*) DESC, tok) AS k FROM u GROUP BY 1, 2, 3) WHERE k = 1), o AS (SELECT user_id, count(*) FILTER (WHERE u.tok <> m.tok) AS off FROM u JOIN m USING (root, at1) GROUP BY 1)
SELECT user_id, t[1] AS root, CASE WHEN off <= 1 THEN t[1]::VARCHAR ELSE t[1] || '|' || array_to_string(t, '.') END AS family FROM l JOIN o USING (user_id)""",
    "passage_credits": """WITH sp AS (SELECT l_orderkey AS b, l_suppkey AS a, (l_partkey % 80)::DOUBLE AS s, (l_partkey % 80 + l_linenumber + 4)::DOUBLE AS e, l_quantity AS bits FROM lineitem),
x AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY b, a ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 0 ELSE 1 END AS new FROM sp), y AS (SELECT *, sum(new) OVER (PARTITION BY b, a ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM x),
seg AS (SELECT b, a, i, min(s) AS s, max(e) AS e, sum(bits) AS bits FROM y GROUP BY 1, 2, 3), z AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY b ORDER BY s, e, a, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM seg),
q AS (SELECT *, sum(new) OVER (PARTITION BY b ORDER BY s, e, a, i ROWS UNBOUNDED PRECEDING) AS passage FROM z), w AS (SELECT b, passage, min(s) AS ps, max(e) AS pe FROM q GROUP BY 1, 2),
p AS (SELECT b, passage, a, ps, pe, sum(e - s) >= 0.5 * (pe - ps) AS able, sum(bits) AS bits FROM q JOIN w USING (b, passage) GROUP BY 1, 2, 3, 4, 5), f AS (SELECT *, bool_or(able) OVER (PARTITION BY b, passage) AS any_able FROM p),
g AS (SELECT *, max(bits) OVER (PARTITION BY b, passage) AS best FROM f WHERE able OR NOT any_able)
SELECT b, passage::BIGINT AS passage, ps AS start, pe AS "end", min(a) AS credited, round(max(best), 6) AS bits FROM g WHERE best >= 12 AND bits >= 0.9::DOUBLE * best GROUP BY 1, 2, 3, 4""",
    "top_families": """WITH c AS (SELECT s_nationkey AS a, p_size AS b, p_brand AS family, sum(l_quantity) AS score, count(*) AS close FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT a, b, family, score, close FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, close DESC, family) AS k FROM c) WHERE k = 1""",
    "unique_labels": "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN p_name ELSE p_name || ' [' || p_brand || '/' || p_partkey || ']' END AS label FROM part",
    "hub_sizes": f"WITH {_MEMBERS}, n AS (SELECT c_custkey, count(tree.b) AS children FROM customer LEFT JOIN tree ON a = c_custkey GROUP BY 1) SELECT children, count(*) AS n FROM n GROUP BY 1",
    "rule_variants": f"WITH {_MEMBERS} " + " UNION ALL ".join(_VARIANT.format(n=n, s=s) for n, s in (("best", 1.0), ("near", 0.8), ("half", 0.5), ("any", 0.0))),
    "edge_weights": "SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'promo') THEN 1.0::DOUBLE WHEN starts_with(lower(p_type), 'standard') THEN 0.6 WHEN starts_with(lower(p_type), 's') THEN 0.4 ELSE 0.2 END AS weight FROM part",
    "excerpt_spans": """WITH o AS (SELECT *, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS day FROM orders), d AS (SELECT o_custkey, day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM o WHERE o_totalprice > 450000) WHERE k = 1),
u AS (SELECT o_custkey, day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS k FROM o WHERE o_orderpriority = '1-URGENT') WHERE k = 1)
SELECT c_custkey AS node, coalesce(d.day, u.day, 0)::INT AS start, coalesce(d.day + 8, u.day + 8, 16)::INT AS "end", CASE WHEN d.day IS NOT NULL THEN 'edge' WHEN u.day IS NOT NULL THEN 'loop' ELSE 'first' END AS kind FROM customer LEFT JOIN d ON d.o_custkey = c_custkey LEFT JOIN u ON u.o_custkey = c_custkey""",
    "followed_links": """WITH h AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 8 = 0 THEN 3 WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS hops FROM part) SELECT node, node // (1 << hops) AS target, hops::INT AS hops FROM h""",
    "class_ancestry": """WITH RECURSIVE up AS (SELECT c_custkey AS node, c_custkey AS at1, 0 AS d FROM customer UNION ALL SELECT node, (at1 + 1) // 3, d + 1 FROM up WHERE at1 > 1 AND d < 5)
SELECT node, at1 AS goal, min(d)::INT AS distance FROM up WHERE at1 <= 10 GROUP BY 1, 2""",
    "edge_families": f"""WITH {_MEMBERS} SELECT tree.a, tree.b, x.family FROM tree JOIN customer ON c_custkey = tree.b JOIN m x ON x.item = tree.a JOIN m y ON y.item = tree.b AND y.family = x.family WHERE split_part(x.family, '|', 2) = c_mktsegment""",
    "known_pairs": f"""WITH {texts._PAIRS}, k AS (SELECT DISTINCT doc_id AS a, item_id AS b FROM benchmark p JOIN documents d ON contains(d.text, p.text) WHERE length(p.text) >= 3), r AS (SELECT a, b, z, row_number() OVER (PARTITION BY a ORDER BY z DESC, b) AS rank FROM pairs)
SELECT a, b, z, coalesce(z > 5, false) AS found, rank::INT AS rank FROM k LEFT JOIN r USING (a, b)""",
    "operating_curve": f"""WITH {texts._GUESS}, c(cut) AS (VALUES (0.9::DOUBLE), (0.95), (0.98), (0.99)) SELECT cut, count(*) FILTER (WHERE score > cut) AS n, count(*) FILTER (WHERE score > cut AND quality = 1) AS n_true, round(count(*) FILTER (WHERE score > cut AND quality = 1) / count(*) FILTER (WHERE quality = 1)::DOUBLE, 6) AS share FROM g, c GROUP BY 1""",
    "tuned_rules": f"""WITH {texts._GUESS}, c(cut) AS (VALUES (0.9::DOUBLE), (0.95), (0.97), (0.98), (0.99)), a AS (SELECT 'over ' || cut AS rule, round(avg(((score > cut)::INT = quality)::INT) FILTER (WHERE doc_id % 5 <> 0), 6) AS train, round(avg(((score > cut)::INT = quality)::INT) FILTER (WHERE doc_id % 5 = 0), 6) AS held_out FROM g, c GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY train DESC, rule) = 1 AS chosen FROM a""",
    "ranking_report": """WITH c AS (SELECT label, list(v ORDER BY i) AS centroid FROM (SELECT label, i, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT vec_id, e.label AS truth, c.label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS cosine FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank FROM j)
SELECT truth, count(*) AS n, round(avg((rank <= 1)::INT), 3) AS top1, round(avg((rank <= 2)::INT), 3) AS top2, round(avg(rank), 2) AS mean_rank FROM r WHERE label = truth GROUP BY 1""",
    "ratio_buckets": """WITH d AS (SELECT abs(ln(l_extendedprice / l_quantity / p_retailprice)) AS d FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CASE WHEN d <= 0.04 THEN '<=4%' WHEN d <= 0.09 THEN '4-9%' WHEN d <= 0.15 THEN '9-15%' WHEN d <= 0.35 THEN '15-35%' ELSE '>35%' END AS bucket, count(*) AS n, round(avg((d <= 0.04)::INT), 6) AS agree FROM d GROUP BY 1""",
}
QUERIES = [tolerant_families, passage_credits, top_families, unique_labels, hub_sizes, rule_variants, edge_weights, excerpt_spans, followed_links, class_ancestry, edge_families, known_pairs, operating_curve, tuned_rules, ranking_report, ratio_buckets]
