"""Queries do the whole job: no prefix, no sample, no pair left out."""

import random

import numpy as np
import pandas as pd

from tessera import registry
from tessera.operators import align, linkage, passages


def plain_agreement(a, b, match=2.0, mismatch=-1.0, open_=3.0, extend=0.3):
    low, best = float("-inf"), 0.0
    h, e = [0.0] * (len(b) + 1), [low] * (len(b) + 1)
    for x in a:
        new, f = [0.0], low
        for j, y in enumerate(b, 1):
            e[j] = max(h[j] - open_, e[j] - extend)
            f = max(new[j - 1] - open_, f - extend)
            new.append(max(0.0, h[j - 1] + (match if x == y else mismatch), e[j], f))
        h, best = new, max(best, *new)
    return best / (match * (len(a) * len(b)) ** 0.5)


def test_smith_waterman_aligns_whole_sequences(spark, sf):
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    code = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
    tokens = {u: [code.get(t, 4) for t in g.event_type] for u, g in e.groupby("user_id")}
    got = {(r.a, r.b): r for r in registry.queries()["smith_waterman"](spark, sf).collect()}
    assert set(got) == {(u, u + 1) for u in tokens if u + 1 in tokens}
    long_ = [p for p in got if min(len(tokens[p[0]]), len(tokens[p[1]])) > 60]
    assert long_
    for p in long_:
        x, y = tokens[p[0]], tokens[p[1]]
        assert abs(got[p].agreement - plain_agreement(x, y)) < 1e-5
        assert got[p].identity == align.global_identity(x, y) and got[p].n_hits == len(align.local_hits(x, y))


def test_token_sort_ratio_scores_all_pairs(spark, tmp_path):
    names = ["cold widget", "old widget", "bolt small", "small bolt", "plate"]
    pd.DataFrame({"p_name": names + names[:2]}).to_parquet(tmp_path / "part.parquet")
    got = {(r.x, r.y): r.ratio for r in registry.queries()["token_sort_ratio"](spark, str(tmp_path)).collect()}
    assert got == {(x, y): linkage.token_sort_ratio(x, y) for x in names for y in names if x < y}
    assert got["bolt small", "small bolt"] == 100 and got["cold widget", "old widget"] > 95


def test_substring_match_compares_whole_passages(spark, tmp_path):
    text = "a passage that is a good deal longer than forty characters, to its end"
    pd.DataFrame({"item_id": [1], "text": [text]}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": [1, 2], "text": [f"x {text} y", f"x {text[:50]} and then something else"]}).to_parquet(tmp_path / "documents.parquet")
    assert [r.doc_id for r in registry.queries()["substring_match"](spark, str(tmp_path)).collect()] == [1]


def test_contained_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    letters = ["ab", "abé", "aéÿ☃𝄞 \n", "abcdefghijklmnopqrstuvwxyz "]
    text = lambda n: "".join(rng.choices(rng.choice(letters), k=n))
    hay = [(i, text(rng.choice([0, 2, 5, 40, 300]))) for i in range(150)] + [(150, None), (151, "")]
    cut = lambda t, n: t[(a := rng.randrange(max(1, len(t) - n + 1))) : a + n]
    needles = [(i, cut(rng.choice(hay[:150])[1], rng.choice([1, 2, 3, 4, 7, 8, 9, 23, 24, 25, 60, 200])) + rng.choice(["", "", "b"])) for i in range(200)]
    needles += [(200, None), (201, ""), needles[0], needles[1], (202, hay[0][1] * 3)]
    hay += hay[:20]  # rows that repeat are rows
    want = sorted((n, h) for n, x in needles for h, y in hay if x and y and len(x) >= 3 and x in y)
    n, h = spark.createDataFrame(needles, "n int, needle string"), spark.createDataFrame(hay, "h int, text string").repartition(3)
    for few in (50_000, 60):
        monkeypatch.setattr(passages, "FEW", few)
        assert sorted((r.n, r.h) for r in linkage.contained(n, h, "needle", "text").collect()) == want
    assert len(want) > 300 and linkage.contained(n.filter("n = 202"), h, "needle", "text").count() == 0
    assert linkage.contained(n.limit(0), h, "needle", "text").count() == linkage.contained(n, h.limit(0), "needle", "text").count() == 0


def test_contained_moves_no_text(spark):
    h = spark.createDataFrame([(1, "a text that holds a passage of some length"), (2, "another")], "h int, text string")
    got = linkage.contained(spark.createDataFrame([(1, "holds a passage of some")], "n int, needle string"), h, "needle", "text").select("n", "h")
    assert [tuple(r) for r in got.collect()] == [(1, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # a row a run of characters, each with the whole text, is what filled the disk


def test_runs_are_found_across_parts(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    for width in passages.WIDTHS:
        all_ = passages.codes(data, width)
        w = passages.Wanted(width, np.unique(all_[::7]))
        for part in (1 << 20, 64, 1):
            monkeypatch.setattr(passages, "_PART", part)
            got = [(a, k) for at, ks in w.found(data) for a, k in zip(at.tolist(), ks.tolist(), strict=True)]
            assert got == [(a, int(np.searchsorted(w.codes, c))) for a, c in enumerate(all_) if c in w.codes]


def test_known_pairs_reads_the_documents_once_more_than_it_settles(spark, sf):
    plan = registry.queries()["known_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1  # the look for passages; n-grams are made and settled before
