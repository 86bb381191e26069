"""Connected components of edges between ids of any ordered type, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(src, dst) -> (id, component): every id on an edge, with the smallest id it is connected to.

    Every round is written, so lineage stays short. A node's smallest neighbour is a partial aggregate and joins on a node with
    very many edges may be split, so no neighbourhood meets in one task. Edges with a null end are ignored.
    """
    spark = edges.sparkSession
    cur = keep(spark, edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).dropna().distinct(), "edges")
    nodes = cur.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    cur, seen = cur.filter("u != v"), None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        cur = keep(spark, small.filter("u != v").distinct(), "stars")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == seen:
            return nodes.join(cur.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
