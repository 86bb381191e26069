"""Places in a global order: ids, running sums and medians over one range sort that is written once.

A range exchange samples its bounds, and adaptive execution may join its partitions, so two executions of one plan can cut
the same rows differently. Counts of one execution then don't belong to the places of the other. Here the sorted rows are
written with their part and their place in it, and everything else is counted from what was written. No task sees more than
its part; the parts' sizes are one row a part (and key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep


def ranged(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df in global order, written, with _p (part) and _r (place in its part, from 0). Rows of equal order keys meet in one
    part, so callers give keys that tell rows apart where a key may be hot."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    sorted_ = dealt.sortWithinPartitions(*order)
    return keep(df.sparkSession, sorted_.withColumn("_p", F.spark_partition_id()).withColumn("_r", place.bitwiseAND((1 << 33) - 1)), "ranged")


def numbered(df: DataFrame, *order: Column | str, name: str = "id", parts: int | None = None) -> DataFrame:
    """df with ids 1, 2, ... in the given order, unique and without gaps whatever the size."""
    rows = ranged(df, list(order), parts)
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")  # one row a part
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_r") + 1).drop("_p", "_r", "_b")


def running(df: DataFrame, group: str, value: str, *order: Column | str, name: str = "upto", parts: int | None = None) -> DataFrame:
    """df with the sum of value over the rows of the same group before each row, in the given order. A group of any size is
    summed part by part."""
    rows = ranged(df, [group, *order], parts)
    inside = F.sum(value).over(Window.partitionBy("_p", group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("_p", group).agg(F.sum(value).alias("_n"))  # a group spans consecutive parts
    mine = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", group, F.coalesce(F.sum("_n").over(mine), F.lit(0)).alias("_b"))
    at = rows.withColumn("_i", F.coalesce(inside, F.lit(0)))
    g = before.select(F.col("_p").alias("_bp"), F.col(group).alias("_bg"), "_b")
    joined = at.join(g, (F.col("_p") == F.col("_bp")) & F.col(group).eqNullSafe(F.col("_bg")))
    return joined.withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_r", "_i", "_b", "_bp", "_bg")


def medians(df: DataFrame, key: str, value: str, parts: int | None = None) -> DataFrame:
    """(key, median) over the values that aren't null, exact, without gathering a group: the one or two values in the middle
    are found by their place. Keys may be null."""
    rows = ranged(df.filter(F.col(value).isNotNull()).select(key, value), [key, value], parts)
    # a part is sorted, so a key's rows in it are a run of places
    sizes = rows.groupBy("_p", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_first"))
    mine = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cut = sizes.select("_p", F.col(key).alias("_k"), "_first", F.coalesce(F.sum("_n").over(mine), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy(key)).alias("_t"))
    at = F.col("_b") + F.col("_r") - F.col("_first") + 1
    mid = rows.withColumnRenamed("_p", "_q").join(cut, (F.col("_q") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    mid = mid.filter((at == F.floor((F.col("_t") + 1) / 2)) | (at == F.ceil((F.col("_t") + 1) / 2)))
    return mid.groupBy(key).agg(F.avg(value).alias("median"))
