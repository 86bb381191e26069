"""Pairs within groups, a large group cut into blocks that meet as a triangle; and random pairs of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: Rows of a block: no cell of a join holds more than about MOST x MOST pairs, however large the group.
MOST = 2048


def within(df: DataFrame, key: str, item: str, most: int = MOST) -> DataFrame:
    """(key, a, b), a < b: every pair of different items under one key, once. Rows without a key or an item make no pairs.

    A group of n items over `most` is dealt into c = ceil(n / most) blocks by hash. Block s goes to the c cells (s, t) and (t, s)
    of the upper triangle, so a row is sent c times and any two items meet in one cell. Which groups are large is counted first;
    that list joins the rows, it isn't collected.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(item).alias("_x")).dropna().distinct()
    large = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_k", F.ceil(F.col("_n") / most).cast("int").alias("_c"))
    dealt = rows.join(large, "_k", "left").withColumn("_c", F.coalesce("_c", F.lit(1))).withColumn("_s", F.pmod(F.xxhash64("_x"), F.col("_c")).cast("int"))
    one = dealt.select("_k", F.col("_s").alias("_lo"), F.explode(F.sequence("_s", F.col("_c") - 1)).alias("_hi"), F.col("_x").alias("_a"))
    two = dealt.select("_k", F.explode(F.sequence(F.lit(0), "_s")).alias("_lo"), F.col("_s").alias("_hi"), F.col("_x").alias("_b"))
    met = one.join(two, ["_k", "_lo", "_hi"]).filter((F.col("_lo") < F.col("_hi")) | (F.col("_a") < F.col("_b")))
    return met.select(F.col("_k").alias(key), F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def sampled(df: DataFrame, item: str, most: int = 1_000_000, seed: int = 1) -> DataFrame:
    """(a, b), a < b: `most` of all pairs of different items, or all where there are no more.

    The n (n - 1) / 2 pairs have ranks; their range is cut into as many equal strides as pairs are asked for, and one rank of each is
    drawn by a hash. A rank r is the pair (r - j (j - 1) / 2, j) of places, j the largest with j (j - 1) / 2 <= r. So the pairs come
    from two equi-joins on places. Every pair is expected equally often, up to the rounding of doubles (two strides may draw the
    rank in which they meet twice), and reruns draw the same ones.
    """
    rows = numbered(df.select(item).dropna().distinct(), item, name="_n")
    n = rows.count()
    every = n * (n - 1) // 2
    take = min(every, most)
    spark = df.sparkSession
    if not take:
        return rows.select(F.col(item).alias("a"), F.col(item).alias("b")).limit(0)
    hit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rank = F.least(F.floor((F.col("id") + hit) * (float(every) / take)), F.lit(every - 1))
    k = spark.range(take).select(rank.cast("long").alias("r"))
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("r").cast("double"))) / 2).cast("long")
    k = k.withColumn("j", j)
    # the root may be off by one at large ranks
    k = k.withColumn("j", F.when(F.expr("j * (j - 1) div 2 > r"), F.col("j") - 1).when(F.expr("j * (j + 1) div 2 <= r"), F.col("j") + 1).otherwise(F.col("j")))
    k = k.select(F.expr("r - j * (j - 1) div 2 + 1").alias("_i"), (F.col("j") + 1).alias("_j"))
    a, b = rows.select(F.col(item).alias("a"), F.col("_n").alias("_i")), rows.select(F.col(item).alias("b"), F.col("_n").alias("_j"))
    return k.join(a, "_i").join(b, "_j").select("a", "b")
