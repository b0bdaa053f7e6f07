"""Statistics, intervals and sequences over events: each user is a line of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import align, intervals, schedule, sequences, stats
from tessera.sources.tables import table

CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
_CODE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
#: A note: beat (hours since 2024), pitch (value in 40 steps), length (from the value), token.
_NOTES = f"""notes AS (SELECT event_id, user_id, event_type, value, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE, 4) AS beat,
floor(value / 12.5)::INT AS pitch, round(0.5 + (event_id % 7) * 4.0::DOUBLE, 2) AS len, ({_CODE})::INT AS token FROM events)"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    code = F.create_map(*[F.lit(x) for p in CODES.items() for x in p])
    return e.select("event_id", "user_id", "event_type", "value", F.round(us / 3.6e9, 4).alias("beat"), F.floor(F.col("value") / 12.5).cast("int").alias("pitch"), F.round(0.5 + F.pmod("event_id", F.lit(7)) * 4.0, 2).alias("len"), F.coalesce(F.try_element_at(code, "event_type"), F.lit(4)).alias("token"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("user_id", "event_id", "token", "pitch", F.col("beat").alias("s"), F.round(F.col("beat") + F.col("len"), 4).alias("e"))


_SPANS = _NOTES + ", spans AS (SELECT user_id, event_id, token, pitch, beat AS s, round(beat + len, 4) AS e FROM notes)"


def weighted_mode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.weighted_mode(notes(spark, sf), "user_id", "pitch", "len")


def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    return stats.weighted_median(notes(spark, sf), "user_id", "pitch", "len")


def weighted_hist(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(notes(spark, sf), "user_id", F.pmod("pitch", F.lit(12)), "len")


def entropy_steps(spark: SparkSession, sf: str) -> DataFrame:
    return stats.entropy(stats.steps(notes(spark, sf), "user_id", ["beat", "event_id"], "pitch", 12), "user_id", "step")


#: The Krumhansl-Kessler key profiles, C major and C minor.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def profile_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.profile_match(weighted_hist(spark, sf), "user_id", [("major", MAJOR), ("minor", MINOR)])


def vote_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's key by weighted votes of three voters: the mode, the median and the first pitch; a fifth away counts half."""
    n = notes(spark, sf)
    first = n.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("beat", "event_id"))).filter("k = 1")
    votes = (
        weighted_mode(spark, sf).select("user_id", F.pmod("pitch", F.lit(12)).alias("key"), F.lit(0.45).alias("w"))
        .unionByName(weighted_median(spark, sf).select("user_id", F.pmod("median", F.lit(12)).alias("key"), F.lit(0.35).alias("w")))
        .unionByName(first.select("user_id", F.pmod("pitch", F.lit(12)).alias("key"), F.lit(0.2).alias("w")))
    )
    c = votes.select("user_id", F.col("key").alias("cand")).distinct().join(votes, "user_id")
    apart = F.pmod(F.col("key") - F.col("cand"), F.lit(12))
    like = F.when(apart == 0, 1.0).when(apart.isin(5, 7), 0.5).otherwise(0.0)
    s = c.groupBy("user_id", "cand").agg(F.round(F.sum(F.col("w") * like), 6).alias("score"), F.count_if(apart == 0).alias("votes"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("votes"), "cand")
    return s.withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", F.col("cand").alias("key"), "score", "votes")


def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union_length(_spans(spark, sf), "user_id", "s", "e")


def merge_gap(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.islands(_spans(spark, sf), "user_id", "s", "e", gap=4.0)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.runs(notes(spark, sf), "user_id", ["beat", "event_id"], "token", "beat")


def skyline(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.skyline(notes(spark, sf).withColumn("beat", F.floor("beat").cast("double")), "user_id", "beat", "pitch")


def asof_region(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    regions = n.filter("event_type = 'signup'").groupBy("user_id", "beat").agg(F.max("pitch").alias("region"))
    return intervals.as_of(n.select("user_id", "event_id", "beat"), regions, "user_id", "beat", "beat", "region")


def overlap_clip(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf)
    a = s.filter("token = 2").select("user_id", F.col("event_id").alias("a"), "s", "e")
    b = s.filter("token = 0").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    j = intervals.overlaps(a, b, "user_id", "s", "e", "s2", "e2", 24.0)
    return j.select("user_id", "a", "b", "from", "to", F.round(F.col("to") - F.col("from"), 4).alias("shared"))


def point_in_window(spark: SparkSession, sf: str) -> DataFrame:
    w = intervals.in_windows(notes(spark, sf), "beat", 64.0, 16.0)
    return w.groupBy("user_id", F.col("window").cast("long").alias("window")).agg(F.count(F.lit(1)).alias("n"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))


def hopping_windows(spark: SparkSession, sf: str) -> DataFrame:
    lengths = notes(spark, sf).groupBy("user_id").agg(F.max("beat").alias("length"))
    return intervals.hops(lengths, "user_id", "length", 64.0, 16.0, 16.0).select("user_id", F.col("k").cast("long").alias("k"), "start", "end")


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return intervals.line_chunks(d, "doc_id", "n_lines", 8, 4)


def half_bar_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = intervals.grid_cells(_spans(spark, sf), "user_id", "s", "e", "token", 8.0)
    return g.select("user_id", F.col("cell").cast("long").alias("cell"), "token", "covered")


def _token_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    return n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("beat", "event_id", "token"))), lambda s: s["token"]).alias("tokens"))


_TOKENS = _NOTES + ", toks AS (SELECT user_id, list(token ORDER BY beat, event_id) AS tokens FROM notes GROUP BY 1)"


def canonical_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users per transposition-free 4-gram of pitches."""
    n = notes(spark, sf)
    p = n.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("beat", "event_id", "pitch"))), lambda s: s["pitch"]).alias("p"))
    g = p.select("user_id", F.explode(sequences.ngrams(F.col("p"), 4)).alias("g")).select("user_id", F.array_join(F.transform(sequences.relative(F.col("g"), 12), lambda x: x.cast("string")), ".").alias("key"))
    return g.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("df"))


def booth_cycle(spark: SparkSession, sf: str) -> DataFrame:
    t = _token_rows(spark, sf).select("user_id", F.explode(sequences.ngrams(F.col("tokens"), 6)).alias("g"))
    return t.groupBy(F.array_join(F.transform(sequences.least_rotation(F.col("g")), lambda x: x.cast("string")), ".").alias("cycle"), sequences.period(F.col("g")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def collapsed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = sequences.collapse(F.col("tokens"))
    return _token_rows(spark, sf).select("user_id", F.size("tokens").alias("n"), F.size(c).alias("n_collapsed"), F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias("collapsed"))


def duration_classes(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).groupBy(sequences.duration_class(F.col("len")).alias("class"), sequences.key_shift(F.pmod(F.col("pitch"), F.lit(12)), F.lit(0)).cast("int").alias("shift")).agg(F.count(F.lit(1)).alias("n"))


def ev_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def ev_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.sliding(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", "6 hours", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def ev_session(spark: SparkSession, sf: str) -> DataFrame:
    s = streaming.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "8 hours", ["user_id"])
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def smith_waterman(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement and identity of each user's tokens, all of them, with the next user's."""
    t = _token_rows(spark, sf)
    j = t.alias("x").join(t.alias("y"), F.col("y.user_id") == F.col("x.user_id") + 1).select(F.col("x.user_id").alias("a"), F.col("y.user_id").alias("b"), F.col("x.tokens").alias("ta"), F.col("y.tokens").alias("tb"))
    return j.select("a", "b", align.agreement_column("ta", "tb").alias("agreement"), align.identity_column("ta", "tb").alias("identity"), F.size(align.hits_column("ta", "tb")).alias("n_hits"))


def interval_schedule(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).select("user_id", "event_id", "s", "e", (F.col("pitch") - 3).cast("double").alias("w"))
    return schedule.schedule(s, "user_id", "s", "e", "w")


def absorbed_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = intervals.islands(_spans(spark, sf), "user_id", "s", "e").select("user_id", "start", "end", (F.col("island") % 3).cast("int").alias("value"))
    return schedule.absorb(r, "user_id", "start", "end", "value", 2.0)


_MODE = "mode AS (SELECT user_id, pitch, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, pitch) AS k FROM (SELECT user_id, pitch, round(sum(len), 6) AS weight FROM notes GROUP BY 1, 2)) WHERE k = 1)"
_MEDIAN = """md AS (SELECT user_id, min(pitch) AS median FROM (SELECT user_id, pitch, round(sum(w) OVER (PARTITION BY user_id ORDER BY pitch ROWS UNBOUNDED PRECEDING), 6) AS run, round(sum(w) OVER (PARTITION BY user_id) / 2, 6) AS half FROM (SELECT user_id, pitch, sum(len) AS w FROM notes GROUP BY 1, 2)) WHERE run >= half GROUP BY 1)"""
_ISLANDS = """r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
isl AS (SELECT user_id, island::BIGINT AS island, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY 1, 2)"""
_HIST = "hist AS (SELECT user_id, pitch % 12 AS bin, round(sum(len), 6) AS weight FROM notes GROUP BY 1, 2)"


def _profile_values() -> str:
    return ", ".join(f"({p}, '{n}', {s}, [{', '.join(f'{v[(i - s) % 12]}::DOUBLE' for i in range(12))}])" for p, (n, v) in enumerate((("major", MAJOR), ("minor", MINOR))) for s in range(12))


SQL = {
    "weighted_mode": f"WITH {_NOTES}, {_MODE} SELECT * FROM mode",
    "weighted_median": f"WITH {_NOTES}, {_MEDIAN} SELECT * FROM md",
    "weighted_hist": f"WITH {_NOTES}, {_HIST} SELECT * FROM hist",
    "entropy_steps": f"""WITH {_NOTES}, d AS (SELECT user_id, pitch - lag(pitch) OVER (PARTITION BY user_id ORDER BY beat, event_id) AS x FROM notes),
c AS (SELECT user_id, least(greatest(x, -12), 12) AS step, count(*) AS n FROM d WHERE x IS NOT NULL GROUP BY 1, 2),
p AS (SELECT user_id, n, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy, sum(n)::BIGINT AS n FROM p GROUP BY 1""",
    "profile_correlation": f"""WITH {_NOTES}, {_HIST}, prof(place, profile, shift, y) AS (VALUES {_profile_values()}),
x AS (SELECT user_id, list(coalesce(weight, 0.0) ORDER BY bin) AS x FROM (SELECT DISTINCT user_id FROM hist) CROSS JOIN (SELECT unnest(range(12))::INT AS bin) LEFT JOIN hist USING (user_id, bin) GROUP BY 1),
c AS (SELECT user_id, place, profile, shift, list_transform(x, lambda v: v - list_sum(x) / 12) AS xc, list_transform(y, lambda v: v - list_sum(y) / 12) AS yc FROM x CROSS JOIN prof),
r AS (SELECT *, CASE WHEN list_dot_product(xc, xc) > 0 THEN round(list_dot_product(xc, yc) / sqrt(list_dot_product(xc, xc) * list_dot_product(yc, yc)), 6) END AS r FROM c)
SELECT user_id, profile, shift, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC NULLS LAST, shift, place) AS k FROM r) WHERE k = 1""",
    "vote_ensemble": f"""WITH {_NOTES}, {_MODE}, {_MEDIAN},
v AS (SELECT user_id, pitch % 12 AS key, 0.45::DOUBLE AS w FROM mode UNION ALL SELECT user_id, median % 12, 0.35 FROM md UNION ALL SELECT user_id, pitch % 12, 0.2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY beat, event_id) AS k FROM notes) WHERE k = 1),
s AS (SELECT user_id, cand, round(sum(w * CASE WHEN (key - cand + 12) % 12 = 0 THEN 1.0::DOUBLE WHEN (key - cand + 12) % 12 IN (5, 7) THEN 0.5 ELSE 0 END), 6) AS score, count(*) FILTER (WHERE key = cand) AS votes FROM (SELECT DISTINCT user_id, key AS cand FROM v) JOIN v USING (user_id) GROUP BY 1, 2)
SELECT user_id, cand AS key, score, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, votes DESC, cand) AS k FROM s) WHERE k = 1""",
    "interval_union": f"WITH {_SPANS}, {_ISLANDS.format(gap=0)} SELECT user_id, round(sum(\"end\" - start), 6) AS covered, count(*) AS islands FROM isl GROUP BY 1",
    "merge_gap": f"WITH {_SPANS}, {_ISLANDS.format(gap=4)} SELECT * FROM isl",
    "runs": f"""WITH {_NOTES}, c AS (SELECT *, CASE WHEN lag(token) OVER w IS NOT DISTINCT FROM token AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM notes WINDOW w AS (PARTITION BY user_id ORDER BY beat, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY beat, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, run::BIGINT AS run, min(token) AS token, min(beat) AS first, max(beat) AS last, count(*) AS n FROM r GROUP BY 1, 2""",
    "skyline": f"""WITH {_NOTES}, t AS (SELECT user_id, floor(beat)::DOUBLE AS beat, max(pitch) AS pitch FROM notes GROUP BY 1, 2)
SELECT *, round(lead(beat) OVER (PARTITION BY user_id ORDER BY beat) - beat, 6) AS length FROM t""",
    "asof_region": f"""WITH {_NOTES}, g AS (SELECT user_id, beat, max(pitch) AS region FROM notes WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT user_id, event_id, beat, coalesce((SELECT arg_max(region, g.beat) FROM g WHERE g.user_id = n.user_id AND g.beat <= n.beat + 1e-6), (SELECT arg_min(region, g.beat) FROM g WHERE g.user_id = n.user_id)) AS region FROM notes n""",
    "overlap_clip": f"""WITH {_SPANS} SELECT x.user_id, x.event_id AS a, y.event_id AS b, greatest(x.s, y.s) AS "from", least(x.e, y.e) AS "to", round(least(x.e, y.e) - greatest(x.s, y.s), 4) AS shared
FROM spans x JOIN spans y ON x.user_id = y.user_id AND x.token = 2 AND y.token = 0 AND x.s < y.e AND y.s < x.e""",
    "point_in_window": f"""WITH {_NOTES}, w AS (SELECT *, unnest(range(greatest(floor((beat - 64) / 16) + 1, 0)::BIGINT, floor(beat / 16)::BIGINT + 1)) AS "window" FROM notes)
SELECT user_id, "window", count(*) AS n, min(pitch) AS low, max(pitch) AS high FROM w GROUP BY 1, 2""",
    "hopping_windows": f"""WITH {_NOTES}, l AS (SELECT user_id, max(beat) AS length FROM notes GROUP BY 1), k AS (SELECT *, unnest(range(greatest(ceil((length - 16) / 16), 1)::BIGINT)) AS k FROM l)
SELECT user_id, k, k * 16.0::DOUBLE AS start, least(k * 16.0::DOUBLE + 64, length) AS "end" FROM k""",
    "chunk_windows": """WITH d AS (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n FROM documents),
s AS (SELECT doc_id, n, list_sort(list_distinct(list_append(range(0, greatest(n - 8, 0) + 1, 4), greatest(n - 8, 0)::BIGINT))) AS st FROM d),
u AS (SELECT doc_id, n, unnest(st) AS start, unnest(range(len(st))) AS chunk FROM s)
SELECT doc_id, chunk::INT AS chunk, start::INT AS start, least(start + 8, n)::INT AS "end" FROM u""",
    "half_bar_grid": f"""WITH {_SPANS}, c AS (SELECT *, unnest(range(floor(s / 8)::BIGINT, greatest(ceil(e / 8)::BIGINT - 1, floor(s / 8)::BIGINT) + 1)) AS cell FROM spans WHERE e > s),
p AS (SELECT user_id, cell, token, round(sum(least(e, (cell + 1) * 8.0::DOUBLE) - greatest(s, cell * 8.0::DOUBLE)), 6) AS covered FROM c GROUP BY 1, 2, 3)
SELECT user_id, cell, token, covered FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cell ORDER BY covered DESC, token) AS k FROM p) WHERE k = 1 AND covered >= 2""",
    "canonical_ngrams": f"""WITH {_NOTES}, p AS (SELECT user_id, list(pitch ORDER BY beat, event_id) AS p FROM notes GROUP BY 1), g AS (SELECT user_id, p, unnest(range(1, len(p) - 2)) AS i FROM p WHERE len(p) >= 4),
k AS (SELECT DISTINCT user_id, array_to_string(list_transform(p[i:i + 3], lambda x: ((x - p[i]) % 12 + 12) % 12), '.') AS key FROM g) SELECT key, count(*) AS df FROM k GROUP BY 1""",
    "booth_cycle": f"""WITH {_TOKENS}, g AS (SELECT tokens, unnest(range(1, len(tokens) - 4)) AS i FROM toks WHERE len(tokens) >= 6), q AS (SELECT tokens[i:i + 5] AS g FROM g),
z AS (SELECT list_min(list_transform(range(0, 6), lambda k: list_concat(g[k + 1:6], g[1:k]))) AS c, CASE WHEN list_concat(g[2:6], g[1:1]) = g THEN 1 WHEN list_concat(g[3:6], g[1:2]) = g THEN 2 WHEN list_concat(g[4:6], g[1:3]) = g THEN 3 ELSE 6 END AS period FROM q)
SELECT array_to_string(c, '.') AS cycle, period, count(*) AS n FROM z GROUP BY 1, 2""",
    "collapsed_tokens": f"""WITH {_NOTES}, c AS (SELECT user_id, token, beat, event_id, lag(token) OVER (PARTITION BY user_id ORDER BY beat, event_id) AS p FROM notes)
SELECT user_id, count(*)::INT AS n, (count(*) FILTER (WHERE p IS DISTINCT FROM token))::INT AS n_collapsed, string_agg(token::VARCHAR, '' ORDER BY beat, event_id) FILTER (WHERE p IS DISTINCT FROM token) AS collapsed FROM c GROUP BY 1""",
    "duration_classes": f"""WITH {_NOTES} SELECT (least(greatest(floor(log2(len) + 0.5), -1), 4) + 1)::INT AS class, ((pitch % 12 + 5) % 12 - 5)::INT AS shift, count(*) AS n FROM notes GROUP BY 1, 2""",
    "ev_tumbling": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ev_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2",
    "ev_session": """WITH c AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
QUERIES = [weighted_mode, weighted_median, weighted_hist, entropy_steps, profile_correlation, vote_ensemble, interval_union, merge_gap, runs, skyline, asof_region, overlap_clip, point_in_window, hopping_windows, chunk_windows, half_bar_grid, canonical_ngrams, booth_cycle, collapsed_tokens, duration_classes, ev_tumbling, ev_sliding, ev_session, smith_waterman, interval_schedule, absorbed_runs]
