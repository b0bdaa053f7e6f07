"""Documents, benchmark passages, pages and conversations: rare shared material, linkage, extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.durable import settle
from tessera.operators import evidence, fusion, intervals, linkage, schedule, sequences, stats
from tessera.sources import markup
from tessera.sources.tables import table

N = 5
#: Fixed value: pairs in the null sample.
NULL_SAMPLE = 30_000


def words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\r\n]+"), 0)


def _grams(n: int) -> Column:
    """Distinct word n-grams as text, so that equality is what counts."""
    return F.array_distinct(sequences.let(words("text"), lambda w: F.transform(sequences.ngrams(w, n), lambda g: F.array_join(g, " "))))


def _keys(rows: DataFrame, key: str, name: str, n: int = N) -> DataFrame:
    return rows.select(F.col(key).alias(name), F.explode(_grams(n)).alias("key"))


def _pairs(spark: SparkSession, sf: str, n: int = N) -> DataFrame:
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    # filtered once it is settled: else the n-grams are made for the filter and again for the result
    sizes = settle(d.select(F.col("doc_id").alias("a"), F.size(_grams(n)).cast("long").alias("size"))).filter("size > 0")
    return evidence.pair_evidence(_keys(d, "doc_id", "a", n), sizes, _keys(b, "item_id", "b", n).distinct(), d.count() + b.count())


def rare_ngram_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: for each document, the benchmark passage with which it shares the most surprising rare material."""
    return evidence.best_window(_pairs(spark, sf), ["a"], [F.desc("z"), F.col("b")])


_GRAM = "SELECT DISTINCT {k} AS {n}, array_to_string(w[i:i + {m}], ' ') AS key FROM (SELECT {k}, w, unnest(range(1, len(w) - {m} + 1)) AS i FROM (SELECT {k}, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS w FROM {t}) WHERE len(w) > {m})"
def _pairs_sql(n: int) -> str:
    ta, tb = _GRAM.format(k="doc_id", n="a", t="documents", m=n - 1), _GRAM.format(k="item_id", n="b", t="benchmark", m=n - 1)
    return f"""ta AS ({ta}), tb AS ({tb}),
nn AS (SELECT ((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark))::DOUBLE AS n),
df AS (SELECT key, count(*) AS df FROM (SELECT key FROM ta UNION ALL SELECT key FROM tb) GROUP BY 1 HAVING count(*) <= 8),
t AS (SELECT b, key, df, greatest(df - 1, 0) + 2 AS d1, greatest(df - 2, 0) + 2 AS d2, n FROM tb JOIN df USING (key), nn),
u AS (SELECT *, CASE WHEN d1 > 8 THEN 0 ELSE log2((n + 1) / (d1 + 0.5::DOUBLE)) END AS w1, CASE WHEN d2 > 8 THEN 0 ELSE log2((n + 1) / (d2 + 0.5::DOUBLE)) END AS w2,
  least(greatest((d1 - 2) / (n - 2), 0), 1) AS p1, least(greatest((d2 - 2) / (n - 2), 0), 1) AS p2 FROM t),
base AS (SELECT b, sum(w1 * p1) AS mu0, sum(w1 * w1 * p1 * (1 - p1)) AS var0 FROM u GROUP BY 1),
sz AS (SELECT a, count(*) AS size FROM ta GROUP BY 1), mean AS (SELECT avg(size) AS mean FROM sz),
pr AS (SELECT a, b, count(*) AS shared, sum(w2) AS s, sum(w2 * p2 - w1 * p1) AS dm, sum(w2 * w2 * p2 * (1 - p2) - w1 * w1 * p1 * (1 - p1)) AS dv FROM ta JOIN u USING (key) GROUP BY 1, 2),
ev AS (SELECT a, b, shared, s, size / mean * (mu0 + dm) AS mu, size / mean * (var0 + dv) AS v FROM pr JOIN base USING (b) JOIN sz USING (a), mean),
pairs AS (SELECT a, b, shared, round(s, 6) AS s, round(mu, 6) AS mu, round(sqrt(greatest(v, 0)), 6) AS sigma, round((s - mu) / sqrt(v + 4), 6) AS z FROM ev)"""


_PAIRS = _pairs_sql(N)


def stouffer_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Word and line evidence fused; a channel that a pair lacks counts as absent."""
    p = _pairs(spark, sf).select("a", "b", F.col("z").alias("zw"))
    long_ = _pairs(spark, sf, 12).select("a", "b", F.col("z").alias("zl"))
    return p.join(long_, ["a", "b"], "full").select("a", "b", "zw", "zl", evidence.stouffer([(F.col("zw"), 1.0), (F.col("zl"), 0.7)]).alias("z"))


def hub_z(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.hubness(_pairs(spark, sf).select("a", "b", "z"), "a", "b", "z")


def tail_prob(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).select("a", "b", "z")
    return evidence.tail_probability(p, fusion.hash_sample(p, ["a", "b"], NULL_SAMPLE), "z")


def null_threshold(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").select("value")
    return stats.exponential_tail(v, "value", 0.01).withColumn("fpr", F.lit(0.01)).unionByName(stats.exponential_tail(v, "value", 0.0001).withColumn("fpr", F.lit(0.0001)))


def pair_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Relation of a document to its best passage by share of the passage, strength and order."""
    size = table(spark, sf, "benchmark").select(F.col("item_id").alias("b"), F.size(_grams(N)).cast("long").alias("n")).filter("n > 0")
    p = rare_ngram_evidence(spark, sf).join(size, "b").withColumn("share", F.round(F.col("shared") / F.col("n"), 6))
    return p.select("a", "b", "share", F.when(F.col("share") >= 0.6, "version").when(F.col("z") > 20, "influence").when(F.col("z") > 5, "weak").otherwise("none").alias("relation"))


def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.document_frequency(_keys(table(spark, sf, "documents"), "doc_id", "doc", 2)).filter("df > 1")


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that share a rare word with a document of their language: Jaccard and containment of word sets."""
    w = lambda name, key: table(spark, sf, name).select(key, F.array_distinct(words("text")).alias(f"w_{key}"))
    p = _pairs(spark, sf).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"))
    j = p.join(w("documents", "doc_id"), "doc_id").join(w("benchmark", "item_id"), "item_id")
    return j.select("doc_id", "item_id", sequences.jaccard(F.col("w_doc_id"), F.col("w_item_id")).alias("jaccard"), sequences.containment(F.col("w_item_id"), F.col("w_doc_id")).alias("contained"))


def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", linkage.fold(F.col("text")).alias("folded"))


def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", linkage.title_key(F.concat(F.lit("The "), F.col("p_name"), F.lit(" (" ), F.col("p_brand"), F.lit(") - Live 1999"))).alias("key"))


def key_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the type that all parts of their name and brand have, where there is exactly one."""
    p = table(spark, sf, "part")
    left = p.select("p_partkey", F.concat_ws("|", linkage.title_key(F.col("p_name")), "p_brand").alias("key"))
    return linkage.unique_match(left, p.select(F.concat_ws("|", linkage.title_key(F.col("p_name")), "p_brand").alias("key"), "p_type"), "key", "p_type")


def cascade_resolve(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("k1", F.concat_ws("|", "p_name", "p_brand", "p_size")).withColumn("k2", F.concat_ws("|", "p_name", "p_brand"))
    right = p.filter("p_partkey % 3 = 0")
    out = linkage.cascade(p.select("p_partkey", "k1", "k2"), "p_partkey", [("exact", right, "k1", 1.0), ("name", right, "k2", 0.75)], "p_type")
    return out.select("p_partkey", "p_type", F.coalesce("method", F.lit("hash")).alias("method"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def substring_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a passage, all of it."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"))
    return linkage.contained(b, table(spark, sf, "documents").select("doc_id", "text"), "needle", "text").select("item_id", "doc_id")


def token_sort_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of distinct names: the measure ignores the order of words, so no beginning blocks it."""
    s = table(spark, sf, "part").select("p_name").distinct()
    j = s.select(F.col("p_name").alias("x")).crossJoin(s.select(F.col("p_name").alias("y"))).filter("x < y")
    return j.select("x", "y", linkage.ratio_column("x", "y").alias("ratio"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", markup.html_title(F.col("html")).alias("title"), markup.html_text(F.col("html")).alias("text"))


def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return markup.links(table(spark, sf, "pages"), "page_id", "html")


def url_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in markup.url_parts(F.col("url")).items()])


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "struct<k:int>").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("high"))


def theme_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 8 lines scored on three themes; the mean of the best 5 chunks a theme, with a derived other, normalised."""
    lines = F.split("text", "\n", -1)
    cut = lambda x: F.transform(intervals.chunk_starts(F.size(x), 8, 4), lambda s: F.array_join(F.slice(x, s + 1, F.lit(8)), "\n"))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(sequences.let(lines, cut)).alias("chunk", "t"))
    size = F.greatest(F.char_length("t"), F.lit(1))
    count = lambda ch: (F.char_length("t") - F.char_length(F.replace("t", F.lit(ch), F.lit("")))) / size
    c = d.select("doc_id", "chunk", F.explode(F.array(*[F.struct(F.lit(n).alias("theme"), F.round(F.least(count(ch) * k, F.lit(1.0)), 6).alias("score")) for n, ch, k in (("vowels", "e", 6.0), ("pauses", ",", 40.0), ("breaks", ".", 20.0))])).alias("s")).select("doc_id", "chunk", "s.*")
    top = fusion.top_k(c, ["doc_id", "theme"], [F.desc("score"), F.col("chunk")], 5).groupBy("doc_id", "theme").agg(F.avg("score").alias("score"))
    other = top.groupBy("doc_id").agg(F.max("score").alias("m")).select("doc_id", F.lit("other").alias("theme"), (F.greatest(F.lit(0.8) - F.col("m"), F.lit(0.0)) / 0.8).alias("score"))
    s = top.unionByName(other).withColumn("score", F.greatest("score", F.lit(1e-6)))
    return s.select("doc_id", "theme", F.round(F.col("score") / F.sum("score").over(Window.partitionBy("doc_id")), 6).alias("share"))


def _guess(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    mark = lambda ch: F.char_length("text") - F.char_length(F.replace("text", F.lit(ch), F.lit("")))
    odd = (mark("!") + mark("|") + mark("%") + mark("*") + mark("$") + mark("&") + mark("#")) / F.greatest(F.char_length("text"), F.lit(1))
    return d.select("doc_id", "quality", F.round(1 - odd, 6).alias("score"))


def auc_tpr(spark: SparkSession, sf: str) -> DataFrame:
    g = _guess(spark, sf)
    pos = F.col("quality") == 1
    return stats.tpr_at_fpr(g, pos, "score", [0.01, 0.1, 0.3]).crossJoin(stats.auc(g, pos, "score"))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confusion(_guess(spark, sf).withColumn("guess", (F.col("score") > 0.98).cast("int")), "quality", "guess")


def in_order_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Turn lengths of each conversation's users and assistants matched one to one, in order, within 400."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.char_length("text").cast("double").alias("n"))))), lambda s: s["n"]).alias("u"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.char_length("text").cast("double").alias("n"))))), lambda s: s["n"]).alias("a"),
    )

    @F.pandas_udf("int")
    def matched(u: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([len(schedule.match_in_order(sorted(x), sorted(y), 400.0)) for x, y in zip(u, a, strict=True)], dtype="int32")

    return c.select("conv_id", matched("u", "a").alias("n_matched"))


_HTML = r"regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
_TEXT = f"regexp_replace({_HTML}, '<[^>]*>', ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_e}', '{_c}')"
_FOLD = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({t})), '\s*[&+]\s*', ' and ', 'g'), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_ODD = " + ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "!|%*$&#")
_GUESS = f"g AS (SELECT doc_id, quality, round(1 - ({_ODD}) / greatest(length(text), 1)::DOUBLE, 6) AS score FROM documents JOIN labels USING (doc_id))"
_THEMES = ", ".join(f"('{n}', '{ch}', {k}::DOUBLE)" for n, ch, k in (("vowels", "e", 6.0), ("pauses", ",", 40.0), ("breaks", ".", 20.0)))
SQL = {
    "rare_ngram_evidence": f"WITH {_PAIRS} SELECT a, b, shared, s, mu, sigma, z FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY z DESC, b) AS k FROM pairs) WHERE k = 1",
    "stouffer_fuse": f"""WITH p AS (WITH {_PAIRS} SELECT a, b, z AS zw FROM pairs), l AS (WITH {_pairs_sql(12)} SELECT a, b, z AS zl FROM pairs)
SELECT a, b, zw, zl, round((coalesce(zw, 0) + 0.7::DOUBLE * coalesce(zl, 0)) / sqrt((zw IS NOT NULL)::INT + 0.49::DOUBLE * (zl IS NOT NULL)::INT), 6) AS z FROM p FULL JOIN l USING (a, b)""",
    "hub_z": f"""WITH {_PAIRS}, sa AS (SELECT a, avg(z) AS m, stddev_pop(z) AS sd FROM pairs GROUP BY 1), sb AS (SELECT b, avg(z) AS m, stddev_pop(z) AS sd FROM pairs GROUP BY 1)
SELECT a, b, z, CASE WHEN sa.sd > 1e-9 THEN round((z - sa.m) / sa.sd, 6) END AS hub_a, CASE WHEN sb.sd > 1e-9 THEN round((z - sb.m) / sb.sd, 6) END AS hub_b FROM pairs JOIN sa USING (a) JOIN sb USING (b)""",
    "tail_prob": f"""WITH {_PAIRS}, smp AS (SELECT a, b, z FROM pairs ORDER BY md5(a || '|' || b), a, b LIMIT {NULL_SAMPLE})
SELECT a, b, z, round((SELECT count(*) FROM smp WHERE smp.z >= p.z) / greatest((SELECT count(*) FROM smp), 1)::DOUBLE, 6) AS q FROM pairs p""",
    "null_threshold": """WITH s AS (SELECT count(*) AS n, quantile_cont(value, 0.99) AS u FROM events), e AS (SELECT avg(value - u) AS x FROM events, s WHERE value > u), r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS k FROM events),
f(fpr) AS (VALUES (0.01::DOUBLE), (0.0001::DOUBLE))
SELECT n, round(CASE WHEN floor(fpr * n) >= 10 THEN (SELECT value FROM r WHERE k = floor(fpr * n) + 1) ELSE u + ln(0.01::DOUBLE / fpr) * coalesce(x, 0) END, 6) AS threshold, fpr FROM f, s, e""",
    "pair_classify": f"""WITH {_PAIRS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY z DESC, b) AS k FROM pairs) WHERE k = 1), n AS (SELECT b, count(*) AS n FROM tb GROUP BY 1), x AS (SELECT a, b, z, round(shared / n::DOUBLE, 6) AS share FROM best JOIN n USING (b))
SELECT a, b, share, CASE WHEN share >= 0.6 THEN 'version' WHEN z > 20 THEN 'influence' WHEN z > 5 THEN 'weak' ELSE 'none' END AS relation FROM x""",
    "doc_frequency": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM documents), k AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2))
SELECT key, count(*) AS df FROM k GROUP BY 1 HAVING count(*) > 1""",
    "jaccard_pairs": f"""WITH {_PAIRS}, x AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS u FROM documents), y AS (SELECT item_id, list_distinct(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS v FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(u, v)) / len(v)::DOUBLE, 6) AS contained FROM pairs JOIN x ON a = doc_id JOIN y ON b = item_id""",
    "fold_text": f"SELECT item_id, {_FOLD.format(t='text')} AS folded FROM benchmark",
    "title_keys": "SELECT p_partkey, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '') AS key FROM part",
    "key_linkage": """WITH k AS (SELECT p_partkey, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '') || '|' || p_brand AS key, p_type FROM part), o AS (SELECT key, min(p_type) AS p_type FROM k GROUP BY 1 HAVING count(DISTINCT p_type) = 1)
SELECT p_partkey, key, o.p_type FROM k LEFT JOIN o USING (key)""",
    "cascade_resolve": """WITH p AS (SELECT p_partkey, p_type, p_name || '|' || p_brand || '|' || p_size AS k1, p_name || '|' || p_brand AS k2 FROM part), r AS (SELECT * FROM p WHERE p_partkey % 3 = 0),
a AS (SELECT k1, min(p_type) AS t FROM r GROUP BY 1 HAVING count(DISTINCT p_type) = 1), b AS (SELECT k2, min(p_type) AS t FROM r GROUP BY 1 HAVING count(DISTINCT p_type) = 1)
SELECT p_partkey, coalesce(a.t, b.t) AS p_type, CASE WHEN a.t IS NOT NULL THEN 'exact' WHEN b.t IS NOT NULL THEN 'name' ELSE 'hash' END AS method, CASE WHEN a.t IS NOT NULL THEN 1.0::DOUBLE WHEN b.t IS NOT NULL THEN 0.75 ELSE 0.5 END AS confidence FROM p LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""",
    "substring_match": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 3",
    "html_text": f"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, trim(regexp_replace({_TEXT}, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages",
    "link_extract": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(1, len(h) + 1))::INT AS n, unnest(h) AS href FROM l""",
    "url_slug": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)/?$', 1) AS slug FROM pages",
    "json_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS high FROM (SELECT event_type, (props->>'k')::INT AS k FROM events) GROUP BY 1",
    "theme_distribution": f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, list_sort(list_distinct(list_append(range(0, greatest(len(l) - 8, 0) + 1, 4), greatest(len(l) - 8, 0)::BIGINT))) AS st FROM d),
c AS (SELECT doc_id, chunk, array_to_string(l[start + 1:least(start + 8, len(l))], chr(10)) AS t FROM (SELECT doc_id, l, unnest(st) AS start, unnest(range(len(st))) AS chunk FROM s)),
th(theme, ch, k) AS (VALUES {_THEMES}),
x AS (SELECT doc_id, theme, chunk, round(least((length(t) - length(replace(t, ch, ''))) / greatest(length(t), 1)::DOUBLE * k, 1.0), 6) AS score FROM c, th),
top AS (SELECT doc_id, theme, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, theme ORDER BY score DESC, chunk) AS n FROM x) WHERE n <= 5 GROUP BY 1, 2),
al AS (SELECT * FROM top UNION ALL SELECT doc_id, 'other', greatest(0.8::DOUBLE - max(score), 0) / 0.8::DOUBLE FROM top GROUP BY 1)
SELECT doc_id, theme, round(greatest(score, 1e-6) / sum(greatest(score, 1e-6)) OVER (PARTITION BY doc_id), 6) AS share FROM al""",
    "auc_tpr": f"""WITH {_GUESS}, r(fpr) AS (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)), neg AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM g WHERE quality = 0),
cut AS (SELECT fpr, score AS threshold FROM r, neg WHERE k = floor(fpr * n) + 1), a AS (SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg FROM g),
u AS (SELECT sum(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS u FROM g p, g q WHERE p.quality = 1 AND q.quality = 0)
SELECT fpr, threshold, (SELECT round(avg((score > threshold)::INT), 9) FROM g WHERE quality = 1) AS tpr, n_pos, n_neg, round(u / (n_pos * n_neg), 9) AS auc FROM cut, a, u""",
    "confusion": f"WITH {_GUESS} SELECT quality, (score > 0.98)::INT AS guess, count(*) AS n FROM g GROUP BY 1, 2",
}
QUERIES = [rare_ngram_evidence, stouffer_fuse, hub_z, tail_prob, null_threshold, pair_classify, doc_frequency, jaccard_pairs, fold_text, title_keys, key_linkage, cascade_resolve, substring_match, token_sort_ratio, html_text, link_extract, url_slug, json_props, theme_distribution, auc_tpr, confusion, in_order_matches]
