"""Connected components of an undirected graph of long ids, fully distributed.

Each partition first contracts its own edges with union-find (one pass, a forest of at most as many edges as it has
nodes). Alternating large-star and small-star rounds then finish across partitions. Every round is written to the shared
folder, so lineage stays short. The minimum per node is a partial aggregate, so a node with very many edges does not
gather in one task; joins on such a node are split by adaptive execution.

Nulls: edges with a null end are ignored. Self loops keep their node as a component of its own. Empty input: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize


def union_find(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest connected node, by vectorised hooking and pointer jumping."""
    nodes, inv = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = inv[: len(src)], inv[len(src) :]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        lo, hi = np.minimum(pa_, pb), np.maximum(pa_, pb)
        if not (live := lo != hi).any():
            break
        np.minimum.at(parent, hi[live], lo[live])
        while (up := parent[parent]).tolist() != parent.tolist() if len(parent) < 64 else not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = a[live], b[live]
    return nodes, nodes[parent]


def _contract(batches):
    src, dst = [], []
    for b in batches:
        src.append(b.column(0).to_numpy(zero_copy_only=False))
        dst.append(b.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, src)) > 4_000_000:  # memory bound: fold what has come so far
            n, r = union_find(np.concatenate(src), np.concatenate(dst))
            src, dst = [n], [r]
    if src:
        n, r = union_find(np.concatenate(src), np.concatenate(dst))
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(r, pa.int64())], ["u", "v"])


def connected_components(spark: SparkSession, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges(src, dst) -> (id, component): every node on an edge, with the smallest id of its component."""
    pairs = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v")).dropna()
    cur = materialize(spark, pairs.mapInArrow(_contract, "u long, v long"), "cc")
    first, seen = cur, None
    for _ in range(rounds):
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        live = cur.filter("u != v")
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        new = materialize(spark, small, "cc")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if cur is not first:
            drop(spark, cur)
        cur = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = first.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return nodes.join(cur.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
