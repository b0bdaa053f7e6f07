"""Functions and stores that no query covers whole, against plain restatements and edge cases."""

import hashlib
import random
import re
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, packed, text
from tessera.operators import decision, lags, lineage, linkage, matching, search, store, timemaps


def one(spark, schema, rows, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_fold_is_the_decomposition(spark):
    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        s = re.sub("['’`]", "", s.replace("&", " and ").replace("+", " and "))
        return re.sub(r"\s+", " ", re.sub("[^0-9a-zA-Z]+", " ", s)).strip().lower()

    texts = ["Beyoncé & JAY-Z", "Don't  Stop!", "Ångström ﬁne ½ Ｆｕｌｌ", "Straße+Œuvre", "éa", "日本 №5", "Ǆ x²", "", " a&b "]
    assert [r[0] for r in one(spark, "t string", [(t,) for t in texts], f=linkage.fold(F.col("t")))] == [plain(t) for t in texts]


def test_titles(spark):
    t = F.col("t")
    cases = [('"The Cover of "Rolling Stone""', 'The Cover of "Rolling Stone"'), ('"Ain’t Misbehavin’" (piano solo)', "Ain’t Misbehavin’"), ("“Hello”", "Hello"), ("plain", "plain"), ('""', "")]
    assert one(spark, "t string", [(a,) for a, _ in cases], u=text.unquote(t)) == [(b,) for _, b in cases]
    page, note = text.disambiguator(t)
    assert one(spark, "t string", [("Hello (Adele song)",), ("Hello",), ("(I) x (y)",)], p=page, n=note) == [("Hello", "Adele song"), ("Hello", ""), ("(I) x", "y")]
    assert one(spark, "t string", [('"A" / "B"',), ('"A/B"',)], s=text.sides(t)) == [(['"A', 'B"'],), (['"A/B"'],)]
    assert one(spark, "a string, b string", [("Girls Just Wanna Have Fun", "Girls just want to have fun"), ("Rock 'n' Roll", "Rock and Roll"), ("Seven", "7"), ("One", "Two")], s=text.same_title(F.col("a"), F.col("b"))) == [(True,), (True,), (True,), (False,)]
    assert one(spark, "a string, b string", [("ccr", "creedence clearwater revival"), ("a b", "ab"), ("elo", "electric light orchestra")], s=text.names_by_acronym(F.col("a"), F.col("b"))) == [(True,), (False,), (True,)]
    assert one(spark, "t string", [("i do it for you",), ("for",)], c=text.title_case(t)) == [("I Do It for You",), ("For",)]


def test_fnv1a(spark):
    def slow(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = ["", "a", "foobar", "Ünï", "x" * 100]
    assert one(spark, "t string", [(t,) for t in texts], h=text.fnv1a(F.col("t"))) == [(slow(t),) for t in texts]


def test_licence_and_credit(spark):
    rows = [("CC BY-NC 4.0",), ("CC BY-SA 3.0",), ("CC BY 4.0",), ("CC0",), ("All rights reserved",)]
    assert [r[0] for r in one(spark, "t string", rows, c=text.licence_class(F.col("t")))] == ["noncommercial", "share alike", "attribution", "public domain", "other"]
    assert one(spark, "a string, l string, s string", [("Ann", "CC BY", None), (None, " ", "web")], t=text.attribution(F.col("a"), F.col("l"), F.col("s"))) == [("Ann, CC BY",), ("unknown author, web",)]


def test_numbers(spark):
    x = F.col("x")
    assert one(spark, "x double", [(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,)], u=numbers.half_up(x), e=numbers.half_even(x), a=numbers.half_away(x)) == [(1, 0, 1), (2, 2, 2), (3, 2, 3), (0, 0, -1), (-1, -2, -2)]
    assert [r[0] for r in one(spark, "x double", [(v,) for v in (0.0, 0.3, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 99.0)], d=numbers.duration_class(x))] == [0, 0, 0, 1, 2, 3, 4, 5, 5]
    assert one(spark, "x double", [(240.0,), (130.0,), (30.0,), (0.0,)], f=numbers.octave_fold(x, F.lit(120.0))) == [(120.0,), (130.0,), (120.0,), (120.0,)]
    tone = lambda k: (F.lit(k[0]), F.lit(k[1]))
    for a, b, want in (((0, False), (0, False), "same"), ((0, False), (0, True), "parallel"), ((0, False), (9, True), "relative"), ((0, False), (7, False), "fifth"), ((0, False), (4, True), "adjacent"), ((0, False), (2, False), "none")):
        assert one(spark, "x double", [(0.0,)], r=numbers.key_relation(*tone(a), *tone(b))) == [(want,)]
    t = F.col("t")
    assert [r[0] for r in one(spark, "t array<int>", [([1, 2, 3, 4],), ([1, 2, 1, 2],), ([1, 2, 3, 1, 2, 3],)], v=numbers.varied(t))] == [True, False, False]


def test_a_glide_is_the_integral_of_its_ratio(spark):
    got = [r[0] for r in one(spark, "t double", [(k / 10,) for k in range(81)], g=numbers.glide(F.col("t"), F.lit(0.7), F.lit(6.0)))]
    total, step = 0.0, 1e-3
    for k in range(8000):
        u = min((k + 0.5) * step / 6, 1)
        total += (0.7 + 0.3 * u * u * (3 - 2 * u)) * step
    assert abs(got[80] - total) < 1e-4 and got[0] == 0 and got == sorted(got)


def test_jpeg_sizes(spark):
    frame = lambda kind, h, w: b"\xff" + bytes([kind]) + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 10
    other = b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF"
    rows = [(b"\xff\xd8" + other + frame(0xC0, 40, 30),), (b"\xff\xd8\xff\xff" + frame(0xC2, 1, 2)[1:],), (b"\x89PNG",), (None,), (b"\xff\xd8" + other,), (b"\xff\xd8" + b"\xff\xc4\x00\x03\0" + frame(0xC1, 7, 9),)]
    df = spark.createDataFrame(rows, "c binary").select(packed.jpeg_size(F.col("c")).alias("s"))
    assert [(r.s.width, r.s.height) for r in df.collect()] == [(30, 40), (2, 1), (None, None), (None, None), (None, None), (9, 7)]


def test_maps_go_on_beyond_their_ends(spark):
    grid = spark.createDataFrame([("g", 0.0, 0.0), ("g", 1.0, 2.0), ("g", 3.0, 3.0)], "g string, x double, y double")
    points = spark.createDataFrame([("g", v) for v in (-1.0, 0.5, 1.0, 2.0, 5.0)], "g string, p double")
    got = {r.p: r.v for r in timemaps.mapped(points, grid, "g", "p", "x", "y", "v").collect()}
    assert got == {-1.0: -2.0, 0.5: 1.0, 1.0: 2.0, 2.0: 2.5, 5.0: 4.0}


def test_passages_are_credited(spark):
    rows = [(1, 9, 0.0, 10.0, 20.0), (2, 9, 2.0, 9.0, 19.0), (3, 9, 1.0, 2.0, 50.0), (1, 8, 0.0, 4.0, 5.0), (4, 7, 0.0, 4.0, 6.0), (4, 7, 20.0, 24.0, 7.0), (5, 7, 100.0, 104.0, 30.0)]
    got = lineage.passage_credit(spark.createDataFrame(rows, "a int, b int, start double, end double, bits double"))
    # of 9: source 3 covers too little, 1 and 2 are within a tenth; 8 has too few bits; 7: two passages
    assert sorted(map(tuple, got.collect())) == [(7, 1, 0.0, 24.0, 4, 13.0), (7, 2, 100.0, 104.0, 5, 30.0), (9, 1, 0.0, 10.0, 1, 20.0)]


def test_store(spark, tmp_path):
    assert store.fingerprint({"a": 1, "b": 2}) == store.fingerprint({"b": 2, "a": 1}) != store.fingerprint({"a": 2, "b": 2})
    inputs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, t string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = spark.createDataFrame([(1, sha("x"), "v1"), (2, sha("old"), "v1"), (9, sha("q"), "v1"), (3, sha("z"), "v0")], "k int, sha string, version string")
    todo = store.missing(inputs, kept, F.col("t"), "v1", "k")
    assert sorted(r.k for r in todo.collect()) == [2, 3]
    fresh = todo.select("k", "sha", F.lit("v1").alias("version"))
    assert sorted((r.k, r.version) for r in store.with_kept(fresh, kept, inputs, "k").collect()) == [(1, "v1"), (2, "v1"), (3, "v1")]
    path = str(tmp_path / "t")
    store.publish(inputs, path, [inputs.filter("k > 5")])
    with pytest.raises(ValueError):
        store.publish(inputs.limit(1), path, [inputs.filter("k = 1")])
    assert spark.read.parquet(path).count() == 3


def test_windows_that_one_channel_carries(spark):
    rows = [(1, 1, 9.0, True), (1, 2, 8.0, False), (1, 3, 8.0, False), (2, 1, 9.0, True), (3, 1, 1.0, False), (4, 1, 5.0, False)]
    w = spark.createDataFrame(rows, "p int, w int, z double, alone boolean")
    got = decision.best_window(w, ["p"], "z", F.lit(2.0), F.col("alone"), ["w"]).collect()
    assert sorted((r.p, r.w, r.rescued) for r in got) == [(1, 2, True), (4, 1, False)]


def test_runs_equal_all_runs(spark):
    rng = random.Random(4)
    hits = [(g, i, int(rng.random() < 0.6)) for g in range(4) for i in range(15)]
    got = {r.g: (r.first, r.last, r.weight) for r in search.best_runs(spark.createDataFrame(hits, "g int, i int, hit int"), ["g"], "i", "hit", 1.0, 0.2, 6.0).collect()}
    for g in range(4):
        own = [h for x, _, h in hits if x == g]
        runs = [(-round((sum(own[a : b + 1]) - (b + 1 - a - sum(own[a : b + 1]))) * (1 + 0.2 * (sum(own[a : b + 1]) - 1)) - 6, 6), a, b) for a in range(15) for b in range(a, 15) if own[a] and own[b]]
        assert got[g] == (min(runs)[1], min(runs)[2], -min(runs)[0])


def test_walks(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "from int, to int")
    start = spark.createDataFrame([(1,), (4,), (9,)], "n int")
    assert sorted(map(tuple, matching.follow(start, links, "n", 3).select("n", "target", "hops").collect())) == [(1, 4, 3), (4, 5, 1), (9, 9, 0)]
    up = links.select(F.col("from").alias("node"), F.col("to").alias("parent"))
    goals = spark.createDataFrame([(3,), (5,)], "goal int")
    assert sorted(map(tuple, matching.reaches(start.select(F.col("n").alias("node")), up, goals, 2).collect())) == [(1, 3, 2), (4, 5, 1)]


def test_loop_periods(spark):
    lines = [[0, 1, 2, 3] * 5, [0, 1] * 4, [1], [], [0, 1, 2]]
    assert [r[0] for r in one(spark, "t array<int>", [(x,) for x in lines], p=lags.loop_period(F.col("t")))][:4] == [16, 4, 1, 1]
