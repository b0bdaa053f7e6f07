"""Partial dates, and deciding among conflicting date evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Precisions of a partial date, and the first year that evidence may name.
YEAR, MONTH, DAY, FIRST_YEAR = 9, 10, 11, 1890


def partial(value: Column) -> Column:
    """struct(year, month, day, precision) of YYYY, YYYY-MM or YYYY-MM-DD; null if it is none of them."""
    y, m, d = (F.nullif(F.regexp_extract(value, r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$", i), F.lit("")) for i in (1, 2, 3))
    s = F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"), F.when(d.isNotNull(), DAY).when(m.isNotNull(), MONTH).otherwise(YEAR).alias("precision"))
    return F.when(y.isNotNull(), s)


def time_value(year: Column, month: Column, day: Column) -> Column:
    """Year with a fraction: the middle of the day, month or year, short of the next year."""
    doy = F.dayofyear(F.make_date(year, month, day))
    frac = F.when(day.isNotNull(), (doy - 0.5) / 365.25).when(month.isNotNull(), (month - 0.5) / 12).otherwise(0.5)
    return F.round(F.least(year + frac, year + 0.99999), 6)


def decide(evidence: DataFrame, key: str = "work_id", slack: int = 2) -> DataFrame:
    """One row a work: year, confidence, n_accepted, n_rejected. evidence: key, family, year, precision, authoritative, bound (booleans).

    In order, each on what the rule before left: (1) reject evidence without year, below year precision or before
    FIRST_YEAR; (2) reject a bound that lies more than slack years before every accepted row of other families and has
    none of another family within a year; (3) the smallest accepted bound rejects authoritative years after it; (4) the
    smallest accepted authoritative year rejects other families' earlier years that no other family has within a year.
    The year is the smallest accepted; confidence is high if two families lie within a year of it, else medium, and
    review if another family's accepted year is more than slack years later and it stands alone.
    """
    of = Window.partitionBy(key)

    def rows_of(ok: Column) -> Column:
        return F.collect_list(F.when(ok, F.struct("family", "year"))).over(of)

    def backed(held: Column) -> Column:
        return F.exists(held, lambda o: (o["family"] != F.col("family")) & (F.abs(o["year"] - F.col("year")) <= 1))

    e = evidence.withColumn("ok", F.coalesce((F.col("precision") >= YEAR) & (F.col("year") >= FIRST_YEAR), F.lit(False)))
    e = e.withColumn("held", rows_of(F.col("ok")))
    others = F.filter("held", lambda o: o["family"] != F.col("family"))
    early = F.col("bound") & (F.size(others) > 0) & F.forall(others, lambda o: F.col("year") < o["year"] - slack) & ~backed(F.col("held"))
    e = e.withColumn("ok", F.col("ok") & ~early)
    e = e.withColumn("upper", F.min(F.when(F.col("ok") & F.col("bound"), F.col("year"))).over(of))
    e = e.withColumn("ok", F.col("ok") & ~F.coalesce(F.col("authoritative") & (F.col("year") > F.col("upper")), F.lit(False)))
    e = e.withColumn("floor", F.min(F.when(F.col("ok") & F.col("authoritative"), F.col("year"))).over(of)).withColumn("held", rows_of(F.col("ok")))
    low = ~F.col("authoritative") & ~F.col("bound") & F.coalesce(F.col("year") < F.col("floor"), F.lit(False)) & ~backed(F.col("held"))
    e = e.withColumn("ok", F.col("ok") & ~low)
    w = e.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("year"))).alias("year"), F.count_if(F.col("ok")).alias("n_accepted"), F.count_if(~F.col("ok")).alias("n_rejected"), F.collect_list(F.when(F.col("ok"), F.struct("family", "year"))).alias("held"))
    close = F.size(F.array_distinct(F.transform(F.filter("held", lambda o: o["year"] - F.col("year") <= 1), lambda o: o["family"])))
    late = F.exists("held", lambda o: o["year"] > F.col("year") + slack)
    return w.select(key, "year", F.when(F.col("year").isNull(), "none").when(close >= 2, "high").when(late, "review").otherwise("medium").alias("confidence"), "n_accepted", "n_rejected")


def earlier(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether date a (year, month, day) is certainly before b: by year, else by month or day where both have them."""
    same = a["year"] == b["year"]
    return F.coalesce((a["year"] < b["year"]) | (same & (a["month"] < b["month"])) | (same & (a["month"] == b["month"]) & (a["day"] < b["day"])), F.lit(False))
