"""Operators against plain Python restatements and edge cases."""

import random

from pyspark.sql import functions as F

from tessera.operators import align, dates, evidence, forest, fusion, intervals, linkage, schedule, sequences, stats
from tessera.sources import markup, sinks, tables
from tessera import streaming


def test_fusion_ties_and_pseudo_rank(spark):
    e = spark.createDataFrame([("a", 1, 1, 1.0), ("b", 7, 1, 1.0), ("a", 2, 2, None), ("a", 3, None, 1.0)], "list_id string, rank int, work_id long, weight_factor double")
    lists = spark.createDataFrame([("a", 2.0, None), ("b", 1.0, 40)], "list_id string, weight double, pseudo_rank int")
    got = {r.work_id: (round(r.score, 9), r.n_lists, r["rank"]) for r in fusion.fuse(e, lists).collect()}
    assert got == {1: (round(2 / 61 + 1 / 100, 9), 2, 1), 2: (round(2 / 62, 9), 1, 2)}


def test_final_set_equals_the_loop(spark):
    rng = random.Random(3)
    for _ in range(4):
        works = [(i, rng.choice([None, i]), rng.choice([None, 1950, 1951, 1952, 1953])) for i in range(1, 40)]
        target, floor = rng.randint(3, 30), rng.randint(1, 5)
        order = sorted(works, key=lambda w: (w[1] is None, w[1] or 0, w[0]))
        chosen, protected, seen = order[:target], set(), {}
        for w in order:
            if w[2] is not None and 1950 <= w[2] <= 1952:
                seen[w[2]] = seen.get(w[2], 0) + 1
                if seen[w[2]] <= floor:
                    protected.add(w[0])
                    if w not in chosen:
                        chosen.append(w)
        for w in reversed(order):
            if len(chosen) <= target:
                break
            if w in chosen and w[0] not in protected:
                chosen.remove(w)
        df = spark.createDataFrame(works, "work_id int, rank int, year int")
        assert {r.work_id for r in fusion.final_set(df, target, floor, 1950, 1952).collect()} == {w[0] for w in chosen}


def test_evidence_equals_the_direct_formula(spark, monkeypatch):
    rng = random.Random(5)
    a = {i: {rng.randint(0, 30) for _ in range(12)} for i in range(8)}
    b = {i: {rng.randint(0, 30) for _ in range(6)} for i in range(4)}
    n = 12
    from math import log2, sqrt

    df = {k: sum(k in s for s in [*a.values(), *b.values()]) for k in range(31)}
    mean = sum(map(len, a.values())) / len(a)
    want = {}
    for i, x in a.items():
        for j, y in b.items():
            s = mu = var = 0.0
            for k in y:
                d = max(df[k] - (k in x) - 1, 0) + 2
                w = 0 if d > 8 else log2((n + 1) / (d + 0.5))
                p = min(max((d - 2) / (n - 2), 0), 1)
                s, mu, var = s + w * (k in x), mu + w * p, var + w * w * p * (1 - p)
            r = len(x) / mean
            want[i, j] = round((s - r * mu) / sqrt(r * var + 4), 5)
    t = spark.createDataFrame([(i, str(k)) for i, x in a.items() for k in x], "a int, key string")
    u = spark.createDataFrame([(i, str(k)) for i, x in b.items() for k in x], "b int, key string")
    sizes = t.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    got = evidence.pair_evidence(t, sizes, u, n).collect()
    by_shuffle = sorted(map(tuple, got))
    monkeypatch.setattr(evidence, "FEW", 1)
    assert sorted(map(tuple, evidence.pair_evidence(t, sizes, u, n).collect())) == by_shuffle
    assert got and all(abs(round(r.z, 5) - want[r.a, r.b]) <= 2e-5 for r in got)


def test_intervals(spark):
    s = spark.createDataFrame([("x", 0.0, 2.0), ("x", 1.0, 3.0), ("x", 3.0, 4.0), ("x", 9.0, 10.0)], "k string, s double, e double")
    assert intervals.union_length(s, "k", "s", "e").first().covered == 5.0
    assert intervals.islands(s, "k", "s", "e", touch=False).count() == 3
    p = spark.createDataFrame([("x", 0.5), ("x", 5.0)], "k string, t double")
    r = spark.createDataFrame([("x", 1.0, 7), ("x", 5.0, 8)], "k string, start double, v int")
    assert sorted((q.t, q.v) for q in intervals.as_of(p, r, "k", "t", "start", "v").collect()) == [(0.5, 7), (5.0, 8)]
    assert intervals.in_windows(p, "t", 4.0, 2.0).count() == 3


def test_sequences(spark):
    df = spark.createDataFrame([([2, 1, 2, 1],), ([],), ([3],)], "t array<int>")
    got = df.select(sequences.least_rotation(F.col("t")), sequences.period(F.col("t")), F.size(sequences.ngrams(F.col("t"), 2)), F.size(sequences.collapse(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [([1, 2, 1, 2], 2, 3, 4), ([], 0, 0, 0), ([3], 1, 0, 1)]


def test_alignment():
    assert align.local_score([1, 2, 3, 4], [1, 2, 3, 4]) == 8.0
    assert align.agreement([1, 2, 3], [1, 2, 3]) == 1.0
    assert align.agreement([], [1]) is None
    assert align.global_identity([1, 2, 3, 4], [1, 2, 3, 4]) == 1.0
    hits = align.local_hits([1, 2, 3, 9, 4, 5, 6], [4, 5, 6, 1, 2, 3])
    assert [(h["a"], h["b"], h["n"]) for h in hits] == [(0, 3, 3), (4, 0, 3)]

    def slow(a, b):  # affine gaps, cell by cell
        best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                gap = max([h[i - k][j] - 3 - 0.3 * (k - 1) for k in range(1, i + 1)] + [h[i][j - k] - 3 - 0.3 * (k - 1) for k in range(1, j + 1)])
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), gap)
                best = max(best, h[i][j])
        return best

    rng = random.Random(1)
    for _ in range(30):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 14))] for _ in range(2))
        assert abs(align.local_score(a, b) - slow(a, b)) < 1e-9


def test_schedule_is_best():
    rng = random.Random(2)
    for _ in range(30):
        spans = [(s := rng.randint(0, 12), s + rng.randint(1, 5), rng.randint(-2, 9)) for _ in range(9)]
        picked = schedule.best_schedule([s for s, _, _ in spans], [e for _, e, _ in spans], [float(w) for _, _, w in spans])
        best = 0
        for m in range(1 << 9):
            own = sorted(spans[i] for i in range(9) if m >> i & 1)
            if all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False)):
                best = max(best, sum(w for _, _, w in own))
        assert sum(spans[i][2] for i in picked) == best
    assert schedule.match_in_order([1.0, 2.0, 5.0], [1.4, 2.1], 0.5) == [(0, 0), (1, 1)]
    assert schedule.absorb_short([(0, 1, 5), (1, 1.2, 6), (1.2, 3, 5), (4, 4.1, 9)], 0.5) == [(0, 3, 5)]
    assert schedule.viterbi([[1, 0], [0, 0.2], [1, 0]], 0.5) == [0, 0, 0]


def test_forest(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    tree = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "a long, b long")
    spark.sparkContext.setCheckpointDir("/tmp/tessera-test-checkpoint")
    assert sorted((r.node, r.root, r.depth) for r in forest.ancestry(nodes, tree).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 1), (5, 5, 0)]
    assert {r.node: r.descendants for r in forest.descendants(nodes, tree, 3).collect()}[0] == 4
    assert {r.node: r.katz for r in forest.katz(nodes, tree, 0.2, 5).collect()}[0] == round(1 + 0.2 * (1 + 0.2) + 1, 6)


def test_dates(spark):
    rows = [(1, "orders", 1990, 11, True, False), (1, "claim", 1980, 9, False, False), (2, "claim", 1700, 9, False, False), (3, "orders", 1995, 11, True, False), (3, "ships", 1996, 11, False, True)]
    got = {r.work_id: (r.year, r.confidence) for r in dates.decide(spark.createDataFrame(rows, "work_id int, family string, year int, precision int, authoritative boolean, bound boolean")).collect()}
    assert got == {1: (1990, "medium"), 2: (None, "none"), 3: (1995, "high")}
    p = spark.createDataFrame([("1999",), ("1999-03",), ("1999-03-04",), ("x",), (None,)], "t string").select(dates.partial(F.col("t")).alias("d")).collect()
    assert [r.d and r.d.precision for r in p] == [9, 10, 11, None, None]


def test_linkage(spark):
    df = spark.createDataFrame([("The Été & Co. (Live) - Remastered 2009",), ("Don't  Stop feat. X",)], "t string")
    assert [r[0] for r in df.select(linkage.title_key(F.col("t"))).collect()] == ["eteandco", "dontstop"]
    assert linkage.token_sort_ratio("b a", "a b") == 100.0
    hay = spark.createDataFrame([(1, "hello world"), (2, "held")], "id int, text string")
    assert [tuple(r) for r in linkage.contained(spark.createDataFrame([("llo w",)], "needle string"), hay, "needle", "text").select("id").collect()] == [(1,)]


def test_wikitext_grid():
    text = '{| class="wikitable"\n! A !! B\n|-\n| rowspan="2" | x || [[Page|label]]\n|-\n| \'\'y\'\'<ref>n</ref>\n|-\n| colspan="2" | z\n|}'
    assert markup.wiki_tables(text) == [[["A", "B"], ["x", "label"], ["x", "y"], ["z", "z"]]]
    assert markup.wiki_tables(None) == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿Position,Song Title\n1,One\n2,Two\n", encoding="utf-8")
    got = tables.ranked_list(spark, str(tmp_path / "l.csv"), {"rank": ("rank", "position"), "title": ("song title",), "artist": ("artist",)})
    assert [tuple(r) for r in got.collect()] == [("1", "One", None), ("2", "Two", None)]
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.replace_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 5
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert sinks.content_hash(a, ["k"]).first() == sinks.content_hash(a.orderBy(F.desc("k")), ["k"]).first()
    assert sorted(map(tuple, sinks.replace_keys(a, spark.createDataFrame([(2, "n")], "k int, v string"), ["k"]).collect())) == [(1, "x"), (2, "n")]


def test_auc_and_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    r = stats.auc(df, F.col("y") == 1, "s").first()
    assert (r.n_pos, r.n_neg, r.auc) == (2, 2, 0.875)


def test_streams_equal_batch(spark, sf, tmp_path):
    e = tables.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = streaming.drain(spark, streaming.tumbling(live, "ts", "6 hours", ["event_type"]), "t_tumbling")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streaming.tumbling(e, "ts", "6 hours", ["event_type"]).collect()))
