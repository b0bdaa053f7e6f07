"""Lines of events against themselves and each other: clocks, loops, windows, seeds, sequences of chords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import decision, lags, matching, seeding, timemaps
from tessera.sources.tables import table

from .timelines import _NOTES, notes

_SEQ = f"{_NOTES}, seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY beat, event_id) AS i FROM notes)"


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("beat", "event_id")))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    n = _numbered(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("x"))
    return n.select("user_id", F.transform("x", lambda s: s["token"]).alias("tokens"))


def clock_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Beats of a user's days: places between, before and after the events' own times."""
    n = _numbered(spark, sf)
    first = n.groupBy("user_id", "beat").agg(F.min("i").alias("i"))
    grid = first.withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("beat")) - 1).cast("double"))
    many = grid.groupBy("user_id").agg(F.min("beat").alias("low"), F.max("beat").alias("high"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    points = many.select("user_id", F.explode(F.array(F.col("low") - 5, (F.col("low") + F.col("high")) / 2, F.col("high") + 5)).alias("at"))
    return timemaps.mapped(points, grid.join(many.select("user_id"), "user_id", "left_semi"), "user_id", "at", "beat", "k", "place", 4).select("user_id", F.round("at", 6).alias("at"), "place")


def tempo_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Each event changes the tempo and the meter until the next."""
    n = notes(spark, sf).groupBy("user_id", "beat").agg(F.max("token").alias("token"))
    ends = n.groupBy("user_id").agg((F.max("beat") + 8).alias("end"))
    c = n.select("user_id", "beat", (0.4 + F.col("token") * 0.1).alias("per"), (F.col("token") + 2).alias("num"), F.when(F.col("token") == 1, 8).otherwise(4).alias("den"))
    s = timemaps.tempo_seconds(c.select("user_id", "beat", "per"), ends, "user_id", "beat", "per")
    b = timemaps.bar_count(c.select("user_id", "beat", "num", "den"), ends, "user_id", "beat", "num", "den")
    return s.join(b, "user_id").select("user_id", F.round("seconds", 2).alias("seconds"), F.round("bars", 2).alias("bars"))


def loop_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("user_id", lags.loop_period(F.col("tokens")).alias("period"))


def diagonal_best(spark: SparkSession, sf: str) -> DataFrame:
    return lags.diagonal_best(_numbered(spark, sf), "user_id", "i", "token", (1, 2, 3, 4), 4)


def median_values(spark: SparkSession, sf: str) -> DataFrame:
    return lags.median_filter(notes(spark, sf), "user_id", ["beat", "event_id"], "value", 2).select("event_id", "smooth")


def change_phases(spark: SparkSession, sf: str) -> DataFrame:
    return lags.change_phase(_numbered(spark, sf), "user_id", "i", "token", 4)


def range_weights(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    spans = n.filter("token = 3").select("user_id", "event_id", F.col("beat").alias("start"), (F.col("beat") + 48).alias("end"))
    return lags.range_sums(spans, n, "user_id", "beat", "len").select("event_id", "total")


def _chords(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    return n.select("user_id", "event_id", (F.col("token") - F.when(F.col("pitch") % 5 == 0, 9).otherwise(0)).alias("token"), F.col("beat").alias("start"), F.round(F.col("beat") + F.col("len") / 4, 4).alias("end"))


_CHORDS = f"{_NOTES}, ch AS (SELECT user_id, event_id, token - CASE WHEN pitch % 5 = 0 THEN 9 ELSE 0 END AS token, beat AS s, round(beat + len / 4, 4) AS e FROM notes)"
_CHANGES = f"""{_CHORDS}, c0 AS (SELECT *, CASE WHEN lag(token) OVER w = token THEN 0 ELSE 1 END AS new FROM ch WHERE token >= 0 AND e > s WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
c1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS n FROM c0), chg AS (SELECT user_id, n::BIGINT AS n, min(token)::INT AS token, min(s) AS start, max(e) AS "end" FROM c1 GROUP BY 1, 2)"""


def chord_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = lags.chord_changes(_chords(spark, sf), "user_id", ["event_id"])
    return c.select("user_id", "n", F.col("token").cast("int").alias("token"), "start", "end", numbers.duration_class(F.round(F.col("end") - F.col("start"), 4)).alias("length"))


def key_free_steps(spark: SparkSession, sf: str) -> DataFrame:
    return lags.key_free(lags.chord_changes(_chords(spark, sf), "user_id", ["event_id"]), "user_id").select("user_id", "n", F.col("step").cast("int").alias("step"))


def beat_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return lags.per_beat(_chords(spark, sf), "user_id", ["event_id"]).select("user_id", "beat", F.col("token").cast("int").alias("token"))


def slot_winners(spark: SparkSession, sf: str) -> DataFrame:
    n = lags.without_graces(notes(spark, sf).groupBy("user_id", "beat").agg(F.max("pitch").alias("pitch"), F.max("len").alias("len")), "user_id", "beat", "pitch", "len", 5.0, 6)
    return lags.slot_winners(n, "user_id", "beat", "pitch", grid=2)


def lyric_f1(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    return matching.tolerance_f1(n.filter("token = 0"), n.filter("token = 4"), "user_id", "beat", 12.0)


def seed_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets at which two users' lines share runs of six events, each once."""
    return seeding.line_seeds(_lines(spark, sf), "user_id", "tokens", 6, 2)


def best_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily profiles of event types against each other at all shifts of the hours."""
    e = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    m = e.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    p = m.select("event_type", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0)).cast("double")).alias("v"))
    return matching.best_shift(p, p.withColumnRenamed("event_type", "other"), "event_type", "other", "v", 24)


def channel_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Users against days: the best z a channel over a user's days."""
    return decision.channel_max(_windows(spark, sf), ["user_id"], "event_type", "z")


def channel_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return decision.channel_thresholds(_windows(spark, sf), "event_type", "z", 0.99, 3.0)


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.round(F.sum("value") / 50, 6).alias("z"))


_WIN = "win AS (SELECT user_id, ts::DATE AS day, event_type, round(sum(value) / 50, 6) AS z FROM events GROUP BY 1, 2, 3)"


def rescued_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A user's best day over 2 that clicks do not carry alone."""
    w = _windows(spark, sf).groupBy("user_id", "day").agg(F.round(F.sum("z"), 6).alias("fused"), F.max(F.when(F.col("event_type") == "click", F.col("z"))).alias("click"), F.max(F.when(F.col("event_type") != "click", F.col("z"))).alias("rest"))
    alone = F.coalesce(F.col("click") >= 1, F.lit(False)) & ~F.coalesce(F.col("rest") >= 1, F.lit(False))
    b = decision.best_window(w, ["user_id"], "fused", F.lit(2.0), alone, ["day"])
    return b.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "fused", "rescued")


def consensus_means(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' mean discount over the pairs of part and supplier they are in."""
    p = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), "l_discount")
    return matching.consensus(p, "a", "b", "l_discount")


def combined_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return matching.combined(table(spark, sf, "events").filter("value > 60"), "user_id", "event_type", ("error", "click"))


def pruned_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Per month and return flag the best line a part, and of these the three best."""
    x = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag", "l_partkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return matching.pruned(x, ["month", "l_returnflag"], "l_partkey", "l_extendedprice", "line", 3)


def first_with_notes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return matching.first_of(o, ["o_custkey"], [F.asc("o_orderkey")], "o_orderstatus")


SQL = {
    "clock_maps": f"""WITH {_NOTES}, g AS (SELECT user_id, beat, (row_number() OVER (PARTITION BY user_id ORDER BY beat) - 1)::DOUBLE AS k FROM (SELECT DISTINCT user_id, beat FROM notes)),
m AS (SELECT user_id, min(beat) AS low, max(beat) AS high FROM g GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT user_id, unnest([low - 5, (low + high) / 2, high + 5]) AS q FROM m),
s0 AS (SELECT *, (lead(k) OVER w - k) / (lead(beat) OVER w - beat) AS sl FROM g WINDOW w AS (PARTITION BY user_id ORDER BY beat)), s AS (SELECT user_id, beat, k, coalesce(sl, lag(sl) OVER (PARTITION BY user_id ORDER BY beat)) AS sl FROM s0),
f AS (SELECT p.user_id, q, max(s.beat) FILTER (WHERE s.beat <= q) AS x, min(s.beat) AS x0 FROM p JOIN s USING (user_id) GROUP BY 1, 2)
SELECT f.user_id, round(q, 6) AS "at", round(k + (q - beat) * sl, 4) AS place FROM f JOIN s ON f.user_id = s.user_id AND s.beat = coalesce(x, x0)""",
    "tempo_clock": f"""WITH {_NOTES}, n AS (SELECT user_id, beat, max(token) AS t FROM notes GROUP BY 1, 2), x AS (SELECT *, coalesce(lead(beat) OVER (PARTITION BY user_id ORDER BY beat), max(beat) OVER (PARTITION BY user_id) + 8) - beat AS d FROM n)
SELECT user_id, round(sum(d * (0.4::DOUBLE + t * 0.1::DOUBLE)), 2) AS seconds, round(sum(d / ((t + 2) * 4.0::DOUBLE / CASE WHEN t = 1 THEN 8 ELSE 4 END)), 2) AS bars FROM x GROUP BY 1""",
    "loop_periods": f"""WITH {_SEQ}, c(lag) AS (VALUES (2), (4), (6), (8), (12), (16)), n AS (SELECT user_id, count(*) AS n FROM seq GROUP BY 1),
x AS (SELECT a.user_id, lag, round(avg((a.token = b.token)::INT) + CASE WHEN lag % 4 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN lag % 8 = 0 THEN 0.08::DOUBLE ELSE 0 END + 0.002::DOUBLE * lag, 9) AS score FROM seq a, c, seq b WHERE a.user_id = b.user_id AND b.i = a.i + lag GROUP BY 1, 2),
t AS (SELECT user_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, lag) AS k FROM x) WHERE k = 1)
SELECT user_id, coalesce(lag, greatest(n, 1))::INT AS period FROM n LEFT JOIN t USING (user_id)""",
    "diagonal_best": f"""WITH {_SEQ}, o(off) AS (VALUES (1), (2), (3), (4)), s AS (SELECT a.user_id, a.i, off, (a.token = b.token)::INT AS same FROM seq a, o, seq b WHERE a.user_id = b.user_id AND b.i = a.i + off),
m AS (SELECT x.user_id, x.i, x.off, round(avg(y.same), 6) AS ag FROM s x JOIN s y ON x.user_id = y.user_id AND x.off = y.off AND y.i BETWEEN x.i AND x.i + 3 GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT user_id, i::INT AS i, off AS "offset", ag AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY ag DESC, off) AS k FROM m) WHERE k = 1""",
    "median_values": f"""WITH {_SEQ} SELECT a.event_id, round(quantile_cont(b.value, 0.5), 6) AS smooth FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY 1""",
    "change_phases": f"""WITH {_SEQ}, c AS (SELECT a.user_id, a.i % 4 AS phase, count(*) AS n FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.i = a.i - 1 AND a.token <> b.token GROUP BY 1, 2)
SELECT user_id, phase::INT AS phase, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, phase) AS k FROM c) WHERE k = 1""",
    "range_weights": f"""WITH {_NOTES} SELECT a.event_id, round(coalesce(sum(b.len), 0), 6) AS total FROM notes a LEFT JOIN notes b ON a.user_id = b.user_id AND b.beat >= a.beat AND b.beat < a.beat + 48 WHERE a.token = 3 GROUP BY 1""",
    "chord_changes": f"""WITH {_CHANGES} SELECT user_id, n, token, start, "end", (CASE WHEN d <= 0 THEN 0 ELSE least(4, greatest(-1, floor(log2(d) + 0.5))) + 1 END)::INT AS length FROM (SELECT *, round("end" - start, 4) AS d FROM chg)""",
    "key_free_steps": f"""WITH {_CHANGES} SELECT user_id, n, ((step % 12 + 12) % 12)::INT AS step FROM (SELECT user_id, n, lead(token) OVER (PARTITION BY user_id ORDER BY n) - token AS step FROM chg) WHERE step IS NOT NULL""",
    "beat_tokens": f"""WITH {_CHORDS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS place FROM ch WHERE e > s), b AS (SELECT *, unnest(range(floor(s)::BIGINT, ceil(e)::BIGINT)) AS beat FROM p),
w AS (SELECT user_id, beat, token, round(sum(least(e, beat + 1) - greatest(s, beat)), 6) AS w, min(place) AS f FROM b GROUP BY 1, 2, 3)
SELECT user_id, beat, token::INT AS token FROM (SELECT *, row_number() OVER (PARTITION BY user_id, beat ORDER BY w DESC, f) AS k FROM w) WHERE k = 1""",
    "slot_winners": f"""WITH {_NOTES}, g AS (SELECT user_id, beat, max(pitch) AS pitch, max(len) AS len FROM notes GROUP BY 1, 2), x AS (SELECT *, lead(beat) OVER w - beat AS d, abs(lead(pitch) OVER w - pitch) AS step FROM g WINDOW w AS (PARTITION BY user_id ORDER BY beat, pitch)),
t AS (SELECT user_id, floor(beat * 2 + 0.5)::BIGINT AS slot, max(pitch) AS pitch FROM x WHERE NOT coalesce(len < 5 AND d <= 5 AND step <= 6, false) GROUP BY 1, 2)
SELECT user_id, slot, pitch, lead(slot) OVER (PARTITION BY user_id ORDER BY slot) - slot AS length FROM t""",
    "lyric_f1": f"""WITH {_NOTES}, l AS (SELECT DISTINCT user_id, beat FROM notes WHERE token = 0), r AS (SELECT DISTINCT user_id, beat FROM notes WHERE token = 4),
p AS (SELECT user_id, avg((EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND abs(r.beat - l.beat) <= 12))::INT) AS p FROM l GROUP BY 1), q AS (SELECT user_id, avg((EXISTS (SELECT 1 FROM l WHERE r.user_id = l.user_id AND abs(r.beat - l.beat) <= 12))::INT) AS r FROM r GROUP BY 1),
b AS (SELECT user_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r FROM p FULL JOIN q USING (user_id)) SELECT user_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM b""",
    "seed_alignments": f"""WITH {_SEQ}, l AS (SELECT user_id, list(token ORDER BY i) AS t FROM seq GROUP BY 1), g AS (SELECT user_id, p, t[p + 1:p + 6] AS key FROM (SELECT user_id, t, unnest(range(len(t) - 5)) AS p FROM l WHERE len(t) >= 6)),
s AS (SELECT x.user_id AS a, y.user_id AS b, y.p - x.p AS off, count(*) AS n, min(x.p) AS first FROM g x JOIN g y USING (key) WHERE x.user_id < y.user_id GROUP BY 1, 2, 3)
SELECT a, b, off::INT AS "offset", n, first::INT AS first FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, off) AS k FROM s) WHERE k <= 2""",
    "best_shifts": """WITH e AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT unnest(range(24)) AS shift), t AS (SELECT DISTINCT event_type FROM events),
x AS (SELECT a.event_type, b.event_type AS other, shift, coalesce(sum(ea.n * eb.n), 0)::DOUBLE AS ag FROM t a, t b, s LEFT JOIN e ea ON true LEFT JOIN e eb ON true WHERE ea.event_type = a.event_type AND eb.event_type = b.event_type AND eb.h = (ea.h + shift) % 24 GROUP BY 1, 2, 3)
SELECT event_type, other, shift::INT AS shift, round(ag, 6) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY event_type, other ORDER BY ag DESC, shift) AS k FROM x) WHERE k = 1""",
    "channel_windows": f"WITH {_WIN} SELECT user_id, event_type, max(z) AS z FROM win GROUP BY 1, 2",
    "channel_cuts": f"WITH {_WIN} SELECT event_type, round(greatest(quantile_cont(z, 0.99), 3.0::DOUBLE), 6) AS threshold FROM win GROUP BY 1",
    "rescued_windows": f"""WITH {_WIN}, d AS (SELECT user_id, day, round(sum(z), 6) AS fused, max(z) FILTER (WHERE event_type = 'click') AS c, max(z) FILTER (WHERE event_type <> 'click') AS r FROM win GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fused DESC, day) AS place FROM d WHERE fused > 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS n FROM o WHERE NOT (coalesce(c >= 1, false) AND NOT coalesce(r >= 1, false)))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, fused, place > 1 AS rescued FROM k WHERE n = 1""",
    "consensus_means": "SELECT item, round(avg(d), 6) AS mean, count(*) AS n FROM (SELECT l_partkey * 2 AS item, l_discount AS d FROM lineitem UNION ALL SELECT l_suppkey * 2 + 1, l_discount FROM lineitem) GROUP BY 1",
    "combined_kinds": """WITH k AS (SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type NOT IN ('error', 'click')) AS n, min(event_type) FILTER (WHERE event_type NOT IN ('error', 'click')) AS one FROM events WHERE value > 60 GROUP BY 1)
SELECT user_id, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN one ELSE 'mixed' END AS event_type FROM k""",
    "pruned_spans": """WITH x AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, l_partkey, l_extendedprice, l_orderkey * 10 + l_linenumber AS line FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY month, l_returnflag, l_partkey ORDER BY l_extendedprice DESC, line) AS n FROM x)
SELECT month, l_returnflag, l_partkey, l_extendedprice, line, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY month, l_returnflag ORDER BY l_extendedprice DESC, line) AS place FROM b WHERE n = 1) WHERE place <= 3""",
    "first_with_notes": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1",
}
QUERIES = [clock_maps, tempo_clock, loop_periods, diagonal_best, median_values, change_phases, range_weights, chord_changes, key_free_steps, beat_tokens, slot_winners, lyric_f1, seed_alignments, best_shifts, channel_windows, channel_cuts, rescued_windows, consensus_means, combined_kinds, pruned_spans, first_with_notes]
