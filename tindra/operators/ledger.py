"""Ledger analytics: filters, rollups, rankings and flows over award rows.

An award row has year, family, format, company and amount. All functions take a frame with those columns. In the sums `by` and `totals`
a row may stand for several awards, n_awards, and have their amount (spine.merged_ledger).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .numbering import medians


def money_sum(x) -> Column:
    """An exact sum: decimals don't depend on the order of addition. Null over no rows."""
    return F.sum(X.c(x).cast("decimal(18,2)")).cast("double")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def having(family: str = "", year: int = 0, company: str = "") -> Column:
    """The composable predicate of the funding tools: empty values don't filter; a company matches anywhere, in any case."""
    out = [F.col("amount").isNotNull()]
    if family:
        out.append(F.col("family") == family)
    if year:
        out.append(F.col("year") == year)
    if company:
        out.append(F.col("company").ilike(f"%{company}%"))
    return all_of(*out)


def weight(df: DataFrame) -> list[str]:
    """The column that says how many awards a row stands for, if there is one."""
    return ["n_awards"] if "n_awards" in df.columns else []


def awards(df: DataFrame) -> Column:
    """The number of awards."""
    return (F.coalesce(F.sum("n_awards"), F.lit(0)) if weight(df) else F.count(F.lit(1))).alias("awards")


def total(df: DataFrame) -> Column:
    """Their exact sum: amounts of merged rows have more digits."""
    return F.sum(F.col("amount").cast("decimal(28,2)" if weight(df) else "decimal(18,2)")).alias("total")


def by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(awards(df), total(df).cast("double").alias("total"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(awards(df), total(df).cast("double").alias("total"))


def funding_stats(df: DataFrame, family: str = "", year: int = 0, company: str = "") -> dict[str, DataFrame]:
    """Totals and two breakdowns under one predicate."""
    part = df.filter(having(family, year, company))
    return {"totals": totals(part), "by_family": by(part, "family"), "by_year": by(part, "year")}


def top(df: DataFrame, n: int, key: str = "company") -> DataFrame:
    """The n largest by total, ties by name."""
    return by(df, key).orderBy(F.desc("total"), key).limit(n)


def largest(df: DataFrame, n: int, *unique: str) -> DataFrame:
    return df.orderBy(F.desc("amount"), *unique).limit(n)


def spread(df: DataFrame, key: str = "family") -> DataFrame:
    """Count, mean, median and maximum; halves go to the even number."""
    some = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bround(money_sum("amount") / F.count("amount"), 0).alias("mean"), F.max("amount").alias("max"))
    return some.join(medians(df, key, "amount"), key, "left").select(key, "n", "mean", F.bround("median", 0).alias("median"), "max")


def companies(df: DataFrame) -> DataFrame:
    """By normalised name: awards, total, and the distinct years in order."""
    rows = df.withColumn("norm", X.company_norm("company")).filter("norm != ''")
    years = F.array_join(F.transform(F.sort_array(F.collect_set("year")), lambda y: y.cast("string")), ",")  # as many as there are years
    return rows.groupBy("norm").agg(F.count(F.lit(1)).alias("awards"), money_sum("amount").alias("total"), years.alias("years"))


def flows(df: DataFrame, keep: int = 8, other: str = "other") -> DataFrame:
    """Edges family -> format -> company; companies after the largest ones are one bucket."""
    best = broadcast_small(by(df, "company").orderBy(F.desc("total"), "company").limit(keep).select("company", F.lit(True).alias("big")))
    named = df.join(best, "company", "left").withColumn("target", F.when(F.col("big"), F.col("company")).otherwise(other))
    one = by(df, "family", "format").select(F.col("family").alias("source"), F.col("format").alias("target"), "total")
    two = by(named, "format", "target").select(F.col("format").alias("source"), "target", "total")
    return one.unionByName(two)


def broadcast_small(df: DataFrame) -> DataFrame:
    """For frames of a fixed row count (a limit)."""
    return F.broadcast(df)


def trends(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "format").agg(F.count(F.lit(1)).alias("n"))


def approvals(df: DataFrame, person: str = "company") -> DataFrame:
    """Per person: awards, distinct projects, sum, first and last year, projects a year over the years spanned."""
    span = F.max("year") - F.min("year") + 1
    return df.groupBy(person).agg(F.count(F.lit(1)).alias("awards"), F.countDistinct("project").alias("projects"), money_sum("amount").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.bround(F.countDistinct("project") / span, 2).alias("per_year"))


def first_source(df: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """One row a key: that of the first source, ties by the rest of the order."""
    w = Window.partitionBy(*keys).orderBy(*priority)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rank_order(x, order: list[str]) -> Column:
    """The place of a value in a custom order; unknown ones last."""
    return F.coalesce(F.create_map(*[F.lit(v) for i, k in enumerate(order) for v in (k, i)])[X.c(x)], F.lit(len(order)))


def summary(df: DataFrame) -> DataFrame:
    """Total, average and median with zeros over no rows."""
    return df.agg(F.coalesce(money_sum("amount"), F.lit(0.0)).alias("total"), F.coalesce(F.bround(F.avg("amount"), 2), F.lit(0.0)).alias("average"), F.coalesce(F.median("amount"), F.lit(0.0)).alias("median"))


def allocation_summary(df: DataFrame, companies: int = 5) -> dict[str, DataFrame]:
    """Total, average and median; totals by family; and the companies of the largest totals. Rows without a family or a
    company count in the first only."""
    return {"totals": summary(df), "by_category": by(df.filter("family is not null"), "family").drop("awards"), "top_companies": top(df.filter("company is not null"), companies).drop("awards")}


def readiness(requirements: DataFrame, done: DataFrame) -> DataFrame:
    """Weighted share of finished requirements per project, and what is missing. requirements(project, item, weight)."""
    ok = F.coalesce(F.lower("status").isin("done", "complete", "completed"), F.lit(False))
    rows = requirements.join(done, ["project", "item"], "left").withColumn("ok", ok)
    score = F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return rows.groupBy("project").agg(F.coalesce(F.bround(100 * score, 1), F.lit(0.0)).alias("score"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("item")))), ",").alias("missing"))
