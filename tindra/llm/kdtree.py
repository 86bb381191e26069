"""Centroid clustering by kd-tree filtering, in exact integers.

Each input partition's vectors become kd-trees of at most TREE points: nodes hold the count, the integer sums, the sum of
squares and the bounding box of their points. Trees are built once, written to the shared folder and read by every round. In a
round a tree is walked level by level with the set of centroids that each node still has: the centroid nearest to the middle
of the box stays, and another goes if it is strictly farther than that one from every point of the box, which holds if it is
from the corner that favours it most. A node with one centroid left is assigned whole, by its count and sums; leaves compare
their points with what is left. A tree gives one row a cluster, so a round moves trees x K small rows to their sums.

All arithmetic is in 64-bit integers, so the order of addition doesn't matter and reruns agree. Ties go to the smaller number:
only centroids that are strictly farther everywhere are pruned, so a tie is always seen by its points.

Defined results: vectors that are null, have another length than DIM, or hold null or non-finite components are left out. A
row with a null vec_id is a vector like others, but can't be a first centroid. Repeated rows count each; repeated ids with
the smallest hashes are several first centroids, in order of their components. With fewer rows with ids than K there are
fewer centroids, and without any id no rows; an empty table gives no rows. Components whose floor lies outside +-2**27 are held there: squared
distances beyond that don't fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, small_batches

# Components, centroids, rounds, and the scale of the integers.
DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Points in a tree and in a leaf, and the largest component.
TREE, LEAF, MOST = 8192, 16, 1 << 27


def whole(df: DataFrame, dim: int = DIM, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the usable vectors as integers floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    ok = (F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = lambda e: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(float(scale)) * e))).cast("int")
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def build(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree: the order of the points, and of each node start, end and children (-1: a leaf), parents before children. Points
    are halved in the middle of the widest side; equal points are one leaf, however many."""
    order = np.arange(len(points))
    start, end, left, todo = [], [], [], [(0, len(points), -1)]
    while todo:
        a, b, at = todo.pop()
        if at >= 0:
            left[at].append(len(start))
        me = len(start)
        start.append(a)
        end.append(b)
        left.append([])
        if b - a <= leaf:
            continue
        x = points[order[a:b]]
        wide = x.max(axis=0) - x.min(axis=0)
        side = int(wide.argmax())
        if not wide[side]:
            continue
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(x[:, side], mid)]
        todo += [(a + mid, b, me), (a, a + mid, me)]
    kids = np.full((len(start), 2), -1, np.int32)
    for i, k in enumerate(left):
        kids[i, : len(k)] = k
    return {"order": order, "start": np.array(start, np.int32), "end": np.array(end, np.int32), "kids": kids}


def summaries(points: np.ndarray, start: np.ndarray, end: np.ndarray, kids: np.ndarray) -> dict[str, np.ndarray]:
    """Sums, sums of squares and boxes of the nodes, leaves from their points and the rest from their children."""
    n, d = len(start), points.shape[1]
    total, low, high, square = np.zeros((n, d), np.int64), np.zeros((n, d), np.int64), np.zeros((n, d), np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):  # children stand after their parents
        if kids[i, 0] < 0:
            x = points[start[i] : end[i]].astype(np.int64)
            total[i], low[i], high[i], square[i] = x.sum(axis=0), x.min(axis=0), x.max(axis=0), (x * x).sum()
        else:
            a, b = kids[i]
            total[i], square[i] = total[a] + total[b], square[a] + square[b]
            low[i], high[i] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
    return {"total": total, "low": low, "high": high, "square": square}


def trees(df: DataFrame, dim: int = DIM) -> DataFrame:
    """One row a tree over (vec_id, v): points in leaf order and the nodes' arrays, as bytes."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            v = rows.column("v").combine_chunks()
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(v), dim)
            t = build(x)
            x = x[t["order"]]
            s = summaries(x, t["start"], t["end"], t["kids"])
            ids = rows.column("vec_id").combine_chunks().take(pa.array(t["order"]))
            cols = [pa.array([y.tobytes()], pa.binary()) for y in (x, t["start"], t["end"], t["kids"], s["total"], s["low"].astype(np.int32), s["high"].astype(np.int32), s["square"])]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *cols], ["ids", *NAMES])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TREE:
                rows = pa.Table.from_batches(held)
                for a in range(0, rows.num_rows - TREE + 1, TREE):
                    yield made(rows.slice(a, TREE))
                held = rows.slice(rows.num_rows - rows.num_rows % TREE).combine_chunks().to_batches()
        if sum(x.num_rows for x in held):
            yield made(pa.Table.from_batches(held))

    return df.mapInArrow(run, "ids array<bigint>, " + ", ".join(f"{c} binary" for c in NAMES))


NAMES = ("points", "start", "end", "kids", "total", "low", "high", "square")


def _read(b: pa.RecordBatch, i: int, dim: int) -> dict[str, np.ndarray]:
    kinds = {"points": np.int32, "start": np.int32, "end": np.int32, "kids": np.int32, "total": np.int64, "low": np.int32, "high": np.int32, "square": np.int64}
    t = {c: np.frombuffer(b.column(c)[i].as_py(), kind) for c, kind in kinds.items()}
    return {c: v.reshape(-1, 2) if c == "kids" else v.reshape(-1, dim) if c in ("points", "total", "low", "high") else v for c, v in t.items()}


def dominated(low: np.ndarray, high: np.ndarray, centres: np.ndarray, left: np.ndarray) -> np.ndarray:
    """left (nodes x centroids, what each box still has) without the centroids that are strictly farther than the one nearest
    to the box's middle from every point of the box."""
    mid = low + high
    d = ((mid[:, None, :] - 2 * centres[None]) ** 2).sum(axis=2)
    best = np.where(left, d, np.iinfo(np.int64).max).argmin(axis=1)
    star = centres[best]
    # the corner of the box that lies farthest towards z, seen from the best one: if z loses there it loses everywhere
    gap = centres[None] - star[:, None]
    corner = np.where(gap > 0, high[:, None, :], low[:, None, :])
    more = (gap * (centres[None] + star[:, None] - 2 * corner)).sum(axis=2)  # |z - corner|^2 - |star - corner|^2
    return left & (more <= 0)


def filtered(t: dict[str, np.ndarray], centres: np.ndarray, trace: list[int] | None = None):
    """Where the tree's points go: whole nodes as (node, cluster) pairs, and (positions, clusters) of the leaves' points. trace
    gets how many points were compared one by one."""
    nodes, left = np.zeros(1, np.int64), np.ones((1, len(centres)), bool)
    whole_nodes, owners, spots, to = [], [], [], []
    while len(nodes):
        kept = np.concatenate([dominated(t["low"][nodes[i : i + 256]].astype(np.int64), t["high"][nodes[i : i + 256]].astype(np.int64), centres, left[i : i + 256]) for i in range(0, len(nodes), 256)])
        one = kept.sum(axis=1) == 1
        whole_nodes.append(nodes[one])
        owners.append(kept[one].argmax(axis=1))
        nodes, kept = nodes[~one], kept[~one]
        ends = t["kids"][nodes, 0] < 0
        for i, has in zip(nodes[ends], kept[ends], strict=True):
            at = np.arange(t["start"][i], t["end"][i])
            who = np.flatnonzero(has)
            for a in range(0, len(at), 4096):  # a leaf of equal points may be long
                x = t["points"][at[a : a + 4096]].astype(np.int64)
                to.append(who[((x[:, None, :] - centres[who][None]) ** 2).sum(axis=2).argmin(axis=1)])
            spots.append(at)
        if trace is not None:
            trace.append(int((t["end"][nodes[ends]] - t["start"][nodes[ends]]).sum()))
        inner = ~ends
        nodes, left = t["kids"][nodes[inner]].ravel().astype(np.int64), np.repeat(kept[inner], 2, axis=0)
    flat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return flat(whole_nodes), flat(owners), flat(spots), flat(to)


def sums(trees_: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, n, total, inertia) under the given centroids, one row a cluster."""
    k, dim = centres.shape

    def run(batches):
        n, total, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                t = _read(b, i, dim)
                nodes, owner, spots, to = filtered(t, centres)
                size = (t["end"] - t["start"]).astype(np.int64)[nodes]
                x = t["points"][spots].astype(np.int64)
                np.add.at(n, owner, size)
                np.add.at(n, to, 1)
                np.add.at(total, owner, t["total"][nodes])
                np.add.at(total, to, x)
                # sum of |x - c|^2 over a whole node, from its sums
                np.add.at(inertia, owner, t["square"][nodes] - 2 * (t["total"][nodes] * centres[owner]).sum(axis=1) + size * (centres[owner] ** 2).sum(axis=1))
                np.add.at(inertia, to, ((x - centres[to]) ** 2).sum(axis=1))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64())), pa.array(inertia[some])], ["cluster", "n", "total", "inertia"])

    part = small_batches(trees_).mapInArrow(run, "cluster int, n bigint, total array<bigint>, inertia bigint")
    add = F.array(*[F.sum(F.col("total")[i]) for i in range(dim)])  # partial sums a component
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), add.alias("total"), F.sum("inertia").alias("inertia"))


def assigned(trees_: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = _read(b, i, centres.shape[1])
                nodes, owner, spots, to = filtered(t, centres)
                out = np.empty(len(t["points"]), np.int32)
                for node, c in zip(nodes, owner, strict=True):
                    out[t["start"][node] : t["end"][node]] = c
                out[spots] = to
                d = ((t["points"].astype(np.int64) - centres[out]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(out), pa.array(d)], ["vec_id", "cluster", "distance"])

    return small_batches(trees_).mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def seeds(points: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256, in that order: a top-k, so a bounded set."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.filter("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(spark: SparkSession, df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector of df(vec_id, embedding)."""
    points = whole(df, dim)
    centres = seeds(points, k, seed)
    made = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], made)
    held = materialize(spark, trees(points, dim), "kdtrees")
    for _ in range(rounds):
        for r in sums(held, centres).collect():  # a row a centroid
            centres[r.cluster] = np.array(r.total, np.int64) // r.n  # floors towards minus infinity
    last = {r.cluster: r.inertia for r in sums(held, centres).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]
    rows = materialize(spark, assigned(held, centres), "clusters")
    drop(spark, held)
    return rows.select("vec_id", "cluster", "distance", of([last.get(i, 0) for i in range(len(centres))], "bigint").alias("cluster_inertia"), F.lit(sum(last.values())).cast("bigint").alias("inertia"), of(sha, "string").alias("centroid_sha256"))


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = 1) -> str:
    """The same by comparing every vector with every centroid, as DuckDB SQL."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, j, sum(x)::BIGINT AS t, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dim + 1})) AS j FROM a{i} JOIN p USING (r)) GROUP BY c, j),
c{i + 1} AS (SELECT c, coalesce(list((t - ((t % n) + n) % n) // n ORDER BY j) FILTER (WHERE j IS NOT NULL), any_value(m)) AS m FROM c{i} LEFT JOIN s{i} USING (c) GROUP BY c)""")
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS m FROM p WHERE vec_id IS NOT NULL QUALIFY c < {k}),
{', '.join(steps)},
h AS (SELECT c, sha256(array_to_string(m, ',')) AS sha FROM c{rounds})
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha AS centroid_sha256 FROM a{rounds} JOIN p USING (r) JOIN h USING (c)"""
