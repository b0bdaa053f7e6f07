"""Families by majority, passages and who is credited for them, labels, hubs and rule variants of a credit forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import forest, intervals


def majority(rows: DataFrame, by: str, tokens: str) -> DataFrame:
    """by, majority: at each place of a group's sequences the token that most have (ties: the lower token)."""
    per = rows.select(by, F.posexplode(tokens).alias("at", "token")).groupBy(by, "at", "token").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy(by, "at").agg(F.max_by("token", F.struct("n", -F.col("token"))).alias("token"))
    return best.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("majority"))


def tolerant_keys(rows: DataFrame, key: str, member: str, tokens: str, cover: str, least: int = 4, most_off: int = 1) -> DataFrame:
    """rows with family: the key alone for sequences of `least` tokens or more that differ from the key's majority in at
    most `most_off` places, else the key with the exact tokens. A member counts once for the majority, with its best-covering row.

    All sequences of a key have one length.
    """
    first = Window.partitionBy(key, member).orderBy(F.desc(cover), tokens)
    one = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    j = rows.join(majority(one, key, tokens), key)
    off = F.size(F.filter(F.zip_with(tokens, "majority", lambda x, y: x == y), lambda same: ~same))
    exact = F.concat_ws("|", F.col(key).cast("string"), F.array_join(F.transform(tokens, lambda t: t.cast("string")), "."))
    return j.withColumn("family", F.when((F.size(tokens) >= least) & (off <= most_off), F.col(key).cast("string")).otherwise(exact)).drop("majority")


def top_family(contributions: DataFrame) -> DataFrame:
    """The family that adds most to each pair (ties: the closer, then the smaller family). contributions: a, b, family, score, close."""
    w = Window.partitionBy("a", "b").orderBy(F.desc("score"), F.desc("close"), "family")
    return contributions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def passage_credit(spans: DataFrame, gap: float = 32.0, cover: float = 0.5, tie: float = 0.1, least_bits: float = 12.0) -> DataFrame:
    """b, passage (from 1), start, end, credited, bits: whom each passage of b is credited to. spans: a, b, start, end, bits.

    A source's spans at most gap apart are one segment; a passage is a run of overlapping segments. Of the sources that
    cover at least `cover` of it (all, if none does) the best must have least_bits; the smallest a within `tie` of it is credited.
    """
    seg = intervals.islands(spans.withColumn("_g", F.struct("b", "a")), "_g", "start", "end", gap=gap)
    w = Window.partitionBy("b", "a").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bits = s.groupBy("b", "a", "island").agg(F.sum("bits").alias("bits"))
    seg = seg.select("_g.b", "_g.a", "island", "start", "end").join(bits, ["b", "a", "island"])
    run = Window.partitionBy("b").orderBy("start", "end", "a", "island")
    before = F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1))
    seg = seg.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("passage", F.sum("_new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    whole = seg.groupBy("b", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # a source's segments are apart from each other, so their lengths add up to what they cover
    per = seg.groupBy("b", "passage", "a").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum("bits").alias("bits")).join(whole, ["b", "passage"])
    of = Window.partitionBy("b", "passage")
    able = F.col("covered") >= cover * (F.col("end") - F.col("start"))
    per = per.withColumn("_able", able).withColumn("_any", F.max("_able").over(of)).filter("_able or not _any")
    per = per.withColumn("_best", F.max("bits").over(of)).filter((F.col("_best") >= least_bits) & (F.col("bits") >= (1 - tie) * F.col("_best")))
    return per.groupBy("b", "passage", "start", "end").agg(F.min("a").alias("credited"), F.round(F.max("_best"), 6).alias("bits"))


def unique_labels(rows: DataFrame, key: str, label: str, hint: str) -> DataFrame:
    """rows with labels that are unique as long as hints are: all but a label's first key get the hint in brackets."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return rows.withColumn("_n", n).withColumn(label, F.when(F.col("_n") == 1, F.col(label)).otherwise(F.concat(label, F.lit(" ["), hint, F.lit("]")))).drop("_n")


def hub_sizes(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """children, n: how many nodes have so many children."""
    per = nodes.select("node").join(tree.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("children")), "node", "left")
    return per.groupBy(F.coalesce("children", F.lit(0)).alias("children")).agg(F.count(F.lit(1)).alias("n"))


def rule_variants(pairs: DataFrame, variants: dict[str, float]) -> DataFrame:
    """variant, n_edges, n_parents, total: the forests that other shares of the best score allow."""
    out = None
    for name, share in variants.items():
        t = forest.parents(pairs, share)
        one = t.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("a").alias("n_parents"), F.round(F.sum("score"), 4).alias("total")).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def edge_weight(label: Column, rules: list[tuple[str, float]], otherwise: float) -> Column:
    """The weight of the first prefix that a label has."""
    out = F.lit(otherwise)
    for prefix, weight in reversed(rules):
        out = F.when(label.startswith(prefix), weight).otherwise(out)
    return out


def excerpts(nodes: DataFrame, options: list[tuple[DataFrame, str]], key: str = "node") -> DataFrame:
    """key, start, end and kind of the first option that has a span for a node. options: (key, start, end), kind."""
    found = None
    for i, (rows, kind) in enumerate(options):
        one = rows.select(key, "start", "end", F.lit(i).alias("place"), F.lit(kind).alias("kind"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(key).agg(F.min(F.struct("place", "start", "end", "kind")).alias("x"))
    return nodes.select(key).join(best, key, "left").select(key, "x.start", "x.end", "x.kind")
