"""Text and number functions over parts, orders, lines of orders and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers, packed, text
from tessera.operators.linkage import fold
from tessera.sources.tables import table

_FOLD = r"trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"


def squashed_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = fold(F.concat("p_name", F.lit(" Ringing "), "p_type"))
    return table(spark, sf, "part").select("p_partkey", text.drop_g(t).alias("dropped"), text.squash(t).alias("squashed"), text.squash_loose(t).alias("loose"))


def same_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Two spellings of a name, alike where the size is even."""
    a = F.concat(F.lit("Seven Gonna "), "p_name")
    b = F.concat(F.when(F.col("p_size") % 2 == 0, "7 Goin' to ").otherwise("8 goin to "), "p_name")
    return table(spark, sf, "part").select("p_partkey", text.same_title(a, b).alias("same"))


def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    f = fold(F.concat("p_name", F.lit(" and "), "p_type"))
    return table(spark, sf, "part").select("p_partkey", text.acronym(f).alias("acronym"), text.names_by_acronym(f, text.acronym(f)).alias("named"))


def title_words(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("the "), "p_name", F.lit(" Of The "), F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", text.title_case(t).alias("title"), text.slug(t).alias("slug"), text.display_name(F.replace(t, F.lit(" "), F.lit("_"))).alias("shown"))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    page = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" song)"))).otherwise(F.col("p_name"))
    cell = F.concat(F.lit('"'), "p_name", F.when(F.col("p_size") % 3 == 0, '" / "').otherwise(" "), "p_type", F.lit('"'))
    base, note = text.disambiguator(page)
    s = text.sides(cell)
    return p.select("p_partkey", base.alias("page"), note.alias("note"), F.size(s).alias("n_sides"), text.unquote(F.get(s, F.lit(0))).alias("first_side"))


def spoken_length(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"), text.fits(F.col("text"), 2.5, 12.0).alias("fits"))


def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("fnv1a"), F.sha1("p_name").alias("sha1"), F.md5("p_name").alias("md5"))


def credited_acts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " feat. ").otherwise(" & "), "p_brand", F.lit(", "), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.acts(c), "|").alias("acts"))


def licence_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents that name a licence, by class."""
    d = table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.col("line").rlike("(?i)licen[sc]e|CC0|CC BY|public domain"))
    return d.groupBy(text.licence_class(F.col("line")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def roundings(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("l_quantity") - 25) / 2
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.half_up(x).alias("up"), numbers.half_even(x).alias("even"), numbers.half_away(x).alias("away"), numbers.duration_class(F.col("l_quantity") / 3).alias("length_class"))


def folded_tempos(spark: SparkSession, sf: str) -> DataFrame:
    heard = F.col("o_totalprice") / 1000
    return table(spark, sf, "orders").select("o_orderkey", F.round(numbers.octave_fold(heard, F.lit(110.0)), 8).alias("tempo"), F.round(numbers.share(heard, F.lit(110.0)), 6).alias("share"))


def glides(spark: SparkSession, sf: str) -> DataFrame:
    t, start, seconds = F.col("l_quantity"), 0.8 + F.col("l_tax"), F.lit(30.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.smoothstep(t / 40 - 0.1), 6).alias("smooth"), F.round(numbers.glide(t, start, seconds), 6).alias("consumed"))


def snapped_spans(spark: SparkSession, sf: str) -> DataFrame:
    start, size = F.col("l_quantity") + F.col("l_discount"), F.col("l_extendedprice") / 400
    a, b = numbers.to_bars(start, start + size, F.lit(4.0), F.lit(1.0), F.lit(200.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("start"), b.alias("end"), numbers.to_twelfths(start, F.lit(1.0)).alias("onset"))


def key_relations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a, am, b, bm = F.col("o_orderkey") % 12, F.col("o_custkey") % 2 == 1, F.col("o_custkey") % 12, F.col("o_orderkey") % 3 == 0
    only = F.array_except(numbers.collection(a, am), numbers.collection(b, bm))
    return o.groupBy(numbers.key_relation(a, am, b, bm).alias("relation"), F.size(only).alias("n_only")).agg(F.count(F.lit(1)).alias("n"))


def earlier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against ship dates of their lines, at mixed precision."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lambda d, to_month, to_day: {"year": F.year(d), "month": F.when(to_month, F.month(d)), "day": F.when(to_month & to_day, F.day(d)), "time": F.lit(None).cast("double")}
    a = parts("o_orderdate", F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3 > 1)
    b = parts("l_shipdate", F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 4 > 1)
    return j.select("l_orderkey", "l_linenumber", numbers.earlier(a, b).alias("earlier"), numbers.covers(F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate")), F.year("l_shipdate") - 1, F.year("l_shipdate")).alias("covers"))


def channel_bits(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "view", "purchase")])
    return per.select("user_id", numbers.available((F.col("click"), 8), (F.col("view"), 8), (F.col("purchase"), 3)).alias("bits"))


def dotted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(".", "p_size", F.col("p_partkey") % 7, "p_size").alias("d"))
    t = packed.dotted(F.col("d"))
    back = packed.segments(F.to_json(F.array(F.struct(F.lit(0.5).alias("start"), F.col("p_partkey").cast("double").alias("end"), F.col("d").alias("label")))))
    return p.select("p_partkey", F.aggregate(t, F.lit(0), lambda s, x: s + x).alias("total"), (packed.to_dotted(t) == F.col("d")).alias("same"), F.get(back, F.lit(0))["end"].alias("end"), numbers.varied(t, 2, (1,)).alias("varied"), F.size(packed.parallel(t, F.array(F.lit(1), F.lit(2)))).alias("n_parallel"))


def byte_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.base64(F.encode("p_name", "UTF-8")).alias("m"))
    rows = packed.byte_rows(F.col("m"), 3)
    return p.select("p_partkey", F.size(rows).alias("n_rows"), F.aggregate(F.flatten(rows), F.lit(0), lambda s, x: s + x).alias("total"))




def _variants(x: str) -> str:
    for a, b in (*text.VARIANTS, *((w, str(i)) for i, w in enumerate(text.NUMBERS))):
        x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'g')"
    return x


def _squash(x: str) -> str:
    return f"replace(regexp_replace({x}, 'ing\\b', 'in', 'g'), ' ', '')"


_T = _FOLD.format(t="p_name || ' Ringing ' || p_type")
_SA, _SB = (_FOLD.format(t=t) for t in ("'Seven Gonna ' || p_name", "replace(CASE WHEN p_size % 2 = 0 THEN '7 Goin'' to ' ELSE '8 goin to ' END || p_name, '''', '')"))
_ACR = "array_to_string(list_transform(list_filter(string_split({f}, ' '), lambda w: w <> 'and' AND w <> ''), lambda w: w[1]), '')"
_AF = _FOLD.format(t="p_name || ' and ' || p_type")
_TC = "'the ' || p_name || ' Of The ' || lower(p_type)"
_SMALL = ", ".join(f"'{w}'" for w in text.SMALL)
_LICENCE = " ".join(f"WHEN regexp_matches(line, '{p.replace('(?i)', '')}', 'i') THEN '{c}'" for c, p in text.LICENCES)
_MAJOR = lambda t, m: f"(({t}) + CASE WHEN {m} THEN 3 ELSE 0 END) % 12"
_COLL = lambda t, m: f"list_transform([0, 2, 4, 5, 7, 9, 11], lambda x: ({_MAJOR(t, m)} + x) % 12)"
SQL = {
    "squashed_titles": f"SELECT p_partkey, regexp_replace({_T}, 'ing\\b', 'in', 'g') AS dropped, {_squash(_T)} AS squashed, replace({_squash(_T)}, 'ing', 'in') AS loose FROM part",
    "same_titles": f"SELECT p_partkey, list_has_any([{_squash(_SA)}, {_squash(_variants(_SA))}], [{_squash(_SB)}, {_squash(_variants(_SB))}]) AS same FROM part",
    "acronyms": f"SELECT p_partkey, acronym, length(acronym) >= 3 AS named FROM (SELECT p_partkey, {_ACR.format(f=_AF)} AS acronym FROM part)",
    "title_words": f"""WITH w AS (SELECT p_partkey, {_TC} AS t, string_split({_TC}, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND i < len(w) AND lower(w[i]) IN ({_SMALL}) THEN lower(w[i]) ELSE upper(w[i][1]) || w[i][2:] END), ' ') AS title,
replace({_FOLD.format(t='t')}, ' ', '-') AS slug, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS shown FROM w""",
    "page_titles": """SELECT p_partkey, p_name AS page, CASE WHEN p_size % 2 = 0 THEN p_brand || ' song' ELSE '' END AS note, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END::INT AS n_sides, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS first_side FROM part""",
    "spoken_length": r"""WITH s AS (SELECT item_id, text, regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(31), 'g') AS x FROM benchmark)
SELECT item_id, len(list_filter(string_split(x, chr(31)), lambda s: trim(s, E' \t\r\n') <> ''))::INT AS n_sentences, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) / 2.5::DOUBLE <= 12 AS fits FROM s""",
    "text_hashes": """SELECT p_partkey, lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ord(p_name[i])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS fnv1a, sha1(p_name) AS sha1, md5(p_name) AS md5 FROM part""",
    "credited_acts": "SELECT p_partkey, p_name || '|' || p_brand AS acts FROM part",
    "licence_classes": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT CASE {_LICENCE} ELSE 'other' END AS class, count(*) AS n FROM l WHERE regexp_matches(line, 'licen[sc]e|CC0|CC BY|public domain', 'i') GROUP BY 1""",
    "roundings": """WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 2 AS x, l_quantity / 3 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, floor(x + 0.5)::BIGINT AS up, round_even(x, 0)::BIGINT AS even, (sign(x) * floor(abs(x) + 0.5))::BIGINT AS away,
(CASE WHEN b <= 0 THEN 0 ELSE least(4, greatest(-1, floor(log2(b) + 0.5))) + 1 END)::INT AS length_class FROM x""",
    "folded_tempos": """WITH h AS (SELECT o_orderkey, o_totalprice / 1000 AS p FROM orders), c AS (SELECT o_orderkey, p, unnest([1.0::DOUBLE, 0.5, 2.0, 0.25, 4.0]) AS k, unnest(range(5)) AS i FROM h),
b AS (SELECT o_orderkey, arg_min(p * k, abs(log2(p * k / 110)) * 1e6 + i * 1e-3) AS x FROM c GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN abs(log2(p / 110)) > 0.5 THEN x ELSE p END, 8) AS tempo, round(least(p, 110) / greatest(p, 110), 6) AS share FROM h JOIN b USING (o_orderkey)""",
    "glides": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS t, 0.8::DOUBLE + l_tax AS r, greatest(0, least(1, l_quantity / 40 - 0.1::DOUBLE)) AS u, greatest(0, l_quantity / 30) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(u * u * (3 - 2 * u), 6) AS smooth, round(CASE WHEN t >= 30 THEN 30 * (1 + r) / 2 + (t - 30) ELSE r * t + (1 - r) * 30 * (power(v, 3) - power(v, 4) / 2) END, 6) AS consumed FROM x""",
    "snapped_spans": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS s, l_quantity + l_discount + l_extendedprice / 400 AS e FROM lineitem),
y AS (SELECT *, 1 + ceil((greatest(200, e, 5) - 1) / 4 - 1e-9::DOUBLE) * 4 AS last, greatest(1 + floor((s - 1) / 4 + 1e-9::DOUBLE) * 4, 1) AS a FROM x),
z AS (SELECT *, least(1 + ceil((e - 1) / 4 - 1e-9::DOUBLE) * 4, last) AS e1 FROM y), p AS (SELECT *, CASE WHEN e1 <= a THEN least(last, a + 4) ELSE e1 END AS e2 FROM z),
q AS (SELECT *, CASE WHEN e2 - a < 32 THEN least(last, a + 32) ELSE e2 END AS e3 FROM p), r AS (SELECT *, CASE WHEN e3 - a < 32 THEN greatest(1, e3 - 32) ELSE a END AS lo FROM q)
SELECT l_orderkey, l_linenumber, round(lo, 6)::DOUBLE AS start, round(CASE WHEN e3 - lo > 96 THEN lo + 96 ELSE e3 END, 6)::DOUBLE AS "end", round(1 + floor((s - 1) * 12 + 0.5) / 12, 6) AS onset FROM r""",
    "key_relations": f"""WITH x AS (SELECT o_orderkey % 12 AS a, o_custkey % 2 = 1 AS am, o_custkey % 12 AS b, o_orderkey % 3 = 0 AS bm FROM orders), y AS (SELECT *, ({_MAJOR('a', 'am')} - {_MAJOR('b', 'bm')} + 12) % 12 AS apart, (a - b + 12) % 12 AS t,
len(list_filter({_COLL('a', 'am')}, lambda p: NOT list_contains({_COLL('b', 'bm')}, p)))::INT AS n_only FROM x)
SELECT CASE WHEN t = 0 AND am = bm THEN 'same' WHEN t = 0 THEN 'parallel' WHEN apart = 0 THEN 'relative' WHEN t IN (5, 7) THEN 'fifth' WHEN apart IN (5, 7) THEN 'adjacent' ELSE 'none' END AS relation, n_only, count(*) AS n FROM y GROUP BY 1, 2""",
    "earlier_pairs": """WITH x AS (SELECT l_orderkey, l_linenumber, o_orderdate AS a, l_shipdate AS b, o_orderkey % 3 AS p, l_partkey % 4 AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN year(a) <> year(b) THEN year(a) < year(b) WHEN p > 1 AND q > 1 THEN datediff('day', a::DATE, b::DATE) > 28 WHEN p > 0 AND q > 0 THEN month(a) < month(b) ELSE false END AS earlier,
coalesce(CASE WHEN l_orderkey % 2 = 0 THEN year(a) END <= year(b) + 1, true) AND year(b) - 1 >= year(b) AS covers FROM x""",
    "channel_bits": """SELECT user_id, ((count(*) FILTER (WHERE event_type = 'click') >= 8)::INT + 2 * (count(*) FILTER (WHERE event_type = 'view') >= 8)::INT + 4 * (count(*) FILTER (WHERE event_type = 'purchase') >= 3)::INT)::INT AS bits FROM events GROUP BY 1""",
    "dotted_tokens": """SELECT p_partkey, (2 * p_size + p_partkey % 7)::INT AS total, true AS same, p_partkey::DOUBLE AS "end", p_partkey % 7 <> p_size AS varied, 2 AS n_parallel FROM part""",
    "byte_matrix": """SELECT p_partkey, (length(p_name) // 3)::INT AS n_rows, list_sum(list_transform(range(1, length(p_name) // 3 * 3 + 1), lambda i: ord(p_name[i])))::INT AS total FROM part""",
}
QUERIES = [squashed_titles, same_titles, acronyms, title_words, page_titles, spoken_length, text_hashes, credited_acts, licence_classes, roundings, folded_tempos, glides, snapped_spans, key_relations, earlier_pairs, channel_bits, dotted_tokens, byte_matrix]
