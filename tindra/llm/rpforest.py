"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact rerank.

Fit: TREES trees over a bounded sample (SAMPLE vectors at most); a node splits at the median of the projection on the
difference of two random points. The trees have some thousands of nodes and go to all workers. Index: every vector falls to
one leaf in each tree. Search: a query walks down all trees; every turning not taken waits in one shared queue by its
distance from the splitting plane; the nearest waiting turning is taken next, until the leaves reached hold `budget` rows. That
order is a sort by the farthest plane on a leaf's path, done for blocks of queries.
Leaves and the queries that reach them meet by leaf; a leaf over PART rows is split by hash, and queries go to all its parts.
There all candidates are multiplied, and what is above the query's floor in that group of leaves, which rises from leaf to leaf, is
scored in double precision; the best few of each group are merged at the end.

The budget is measured, not guessed, unless it is given: for AUDIT queries the exact neighbours are found by brute force over
all rows, and the budget is what brings RECALL of those of every other such query into the leaves reached. The other queries are
held out: where the result finds less than GOAL of their neighbours, the budget is doubled and the search repeated. Vectors
without structure need many leaves; clustered ones few. The recall at the queries held out is a column (audit_recall, null
where there are none; where there is one query only, it is the recall at that).

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; each length of vectors has
a search of its own;
equal scores go to the smaller vec_id; a repeated vec_id is one candidate with its best score; fewer candidates than k: all
of them; empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialize
from .vectors import cosine, lengths, matrix, of_length, sample, unit, usable

TREES, SAMPLE, LEAF, PART, AUDIT, RECALL, GROUP, BLOCK, HELD = 4, 16_384, 50, 4096, 128, 0.93, 16_384, 64, 2_000_000
# Fixed value: the recall at queries that the fit has not seen below which all queries look at more.
GOAL = 0.9


class Forest:
    """Nodes of all trees in flat arrays; a leaf has left == -1 and its number, from 0 over the whole forest, in right."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.normal, self.offset, self.child, self.roots, self.leaves = [], [], [], [], 0
        points = np.unique(points, axis=0)
        for _ in range(trees):
            self.roots.append(len(self.child))
            todo = [(np.arange(len(points)), self._node(points))]
            while todo:
                rows, me = todo.pop()
                if len(rows) > leaf:
                    a, b = rng.choice(rows, 2, replace=False)
                    n = points[a] - points[b]
                    n = n / np.sqrt((n * n).sum())
                    p = points[rows] @ n
                    o = np.median(p)
                    right = p > o
                    if right.any() and not right.all():
                        self.normal[me], self.offset[me] = n, o
                        self.child[me] = [self._node(points), self._node(points)]
                        todo += [(rows[~right], self.child[me][0]), (rows[right], self.child[me][1])]
                        continue
                self.child[me] = [-1, self.leaves]
                self.leaves += 1
        self.normal, self.offset, self.child = np.array(self.normal), np.array(self.offset), np.array(self.child)

    def _node(self, points: np.ndarray) -> int:
        self.normal.append(np.zeros(points.shape[1]))
        self.offset.append(0.0)
        self.child.append([-1, -1])
        return len(self.child) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := self.child[node, 0] >= 0).any():
                at = node[inner]
                node[inner] = self.child[at, ((x[inner] * self.normal[at]).sum(axis=1) > self.offset[at]).astype(int)]
            out[:, t] = self.child[node, 1]
        return out

    def order(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaves in the order of the shared queue. What waits there never comes nearer on its way down, so leaves leave the
        queue by the farthest plane that their path crosses (at equal distance by number), and one sort is the whole queue, for a
        block of rows at once."""
        margin = x @ self.normal.T - self.offset
        away = np.zeros_like(margin)
        at = np.array(self.roots)
        while len(at := at[self.child[at, 0] >= 0]):
            left, right = self.child[at].T
            away[:, left] = np.maximum(away[:, at], margin[:, at])
            away[:, right] = np.maximum(away[:, at], -margin[:, at])
            at = np.concatenate([left, right])
        ends = np.flatnonzero(self.child[:, 0] < 0)
        return np.argsort(away[:, ends[np.argsort(self.child[ends, 1])]], axis=1, kind="stable")


def _best(q_ids, q_raw, q_unit, v_ids, v_raw, v_unit, k):
    """(query row, vector row) of each query's k best ids and all that tie with them, within a block of vectors."""
    rows, cols = [], []
    k = k + int(np.unique(v_ids, return_counts=True)[1].max(initial=1) - 1) * k  # repeats of an id don't crowd others out
    for i in range(0, len(q_ids), 256):
        s = q_unit[i : i + 256] @ v_unit.T
        s[q_ids[i : i + 256, None] == v_ids[None, :]] = -np.inf
        floor = np.partition(s, len(v_ids) - k, axis=1)[:, len(v_ids) - k] if len(v_ids) > k else np.full(len(s), -2.0)
        r, c = np.nonzero(s >= np.maximum(floor[:, None] - 1e-9, -2.0))
        rows.append(r + i)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _top(q, v, s, k):
    """The k best of each query: larger score first, then smaller id; of a repeated pair its best score counts."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    if len(q):
        new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]
        q, v, s = q[new], v[new], s[new]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[place < k], v[place < k], s[place < k]


def _score(qs: pa.Table, vs: pa.Table, k: int) -> pa.Table:
    """(q, v, s): the k best of each query of qs(q, us, x) among the rows of vs(u, v, x) in the leaves us that it reaches. A query's
    floor goes from leaf to leaf, and exact scores are for what is above the last one only."""
    none = np.zeros(0, np.int64)
    best = [none, none, np.zeros(0)]
    if qs.num_rows and vs.num_rows:
        q, qx, v, vx, u = qs.column("q").to_numpy(), matrix(qs.column("x")), vs.column("v").to_numpy(), matrix(vs.column("x")), vs.column("u").to_numpy()
        qu, vu = unit(qx), unit(vx)
        us = qs.column("us").combine_chunks()
        owner = np.repeat(np.arange(len(q)), np.diff(us.offsets.to_numpy()))
        visited = us.flatten().to_numpy()
        by_q, by_v = np.argsort(visited, kind="stable"), np.argsort(u, kind="stable")
        most = k * int(np.unique(v, return_counts=True)[1].max())  # an id stands once a tree and repeat: so many hold k ids
        if len(q) > 1 and len(q) * most > HELD:  # an id with very many repeats: fewer queries at once
            return pa.concat_tables([_score(qs.slice(0, len(q) // 2), vs, k), _score(qs.slice(len(q) // 2), vs, k)])
        top, found = np.full((len(q), most), -np.inf), [(none, none, np.zeros(0))]
        held = 0
        for one in np.unique(visited):
            rows = owner[by_q[slice(*np.searchsorted(visited[by_q], [one, one + 1]))]]
            cols = by_v[slice(*np.searchsorted(u[by_v], [one, one + 1]))]
            for i in range(0, len(rows) if len(cols) else 0, 256):
                some = rows[i : i + 256]
                s = qu[some] @ vu[cols].T
                s[q[some, None] == v[None, cols]] = -np.inf
                both = np.concatenate([top[some], s], axis=1)
                top[some] = np.partition(both, len(cols), axis=1)[:, len(cols) :]
                r, c = np.nonzero(s >= np.maximum(top[some].min(axis=1, keepdims=True) - 1e-9, -2.0))
                found.append((some[r], cols[c], s[r, c]))
                held += len(r)
                if held > HELD:
                    found = [_above(found, top)]
                    held = len(found[0][0])
        r, c, _ = _above(found, top)
        best = list(_top(q[r], v[c], cosine(qx[r], vx[c]), k))
    return pa.table([pa.array(best[0]), pa.array(best[1]), pa.array(best[2])], ["q", "v", "s"])


def _above(found, top):
    """Of (query row, vector row, score), those that are still above their query's floor."""
    r, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = s >= top.min(axis=1)[r] - 1e-9
    return r[kept], c[kept], s[kept]


def search(spark: SparkSession, df: DataFrame, every: int = 50, k: int = 5, budget: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, audit_recall for each row whose vec_id is divisible by `every`."""
    vecs = usable(df)
    asked = lengths(vecs.filter(F.col("vec_id") % every == 0))
    if not asked:
        return vecs.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("audit_recall"))
    return reduce(DataFrame.unionByName, [_search(spark, of_length(vecs, n), every, k, budget) for n in asked])


def _search(spark: SparkSession, vecs: DataFrame, every: int, k: int, budget: float | None) -> DataFrame:
    """The same over usable vectors of one length."""
    total = vecs.count()
    ids, points = sample(vecs, SAMPLE)
    forest = Forest(unit(points), TREES, max(8, LEAF * len(ids) // max(total, 1)))
    names = ["leaf", "n"]

    def leaves(batches):
        seen = np.zeros(forest.leaves, np.int64)
        for b in batches:
            seen += np.bincount(forest.leaf_of(unit(matrix(b.column(0)))).ravel(), minlength=forest.leaves)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names)

    sizes = np.zeros(forest.leaves, np.int64)
    for r in vecs.select("embedding").mapInArrow(leaves, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r.leaf] = r.n  # one row a leaf

    # the budget, by brute force for a few queries over all rows
    queries = vecs.filter(F.col("vec_id") % every == 0)
    a_ids, a_raw = sample(queries, AUDIT)

    def exact(batches):
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        a_unit = unit(a_raw)
        where: dict[int, list[int]] = {}
        for b in batches:
            v, x = b.column(0).to_numpy(), matrix(b.column(1))
            r, c = _best(a_ids, a_raw, a_unit, v, x, unit(x), k)
            best = list(_top(*(np.concatenate(p) for p in zip(best, (a_ids[r], v[c], cosine(a_raw[r], x[c])), strict=True)), k))
            new = np.isin(v, best[1])
            where |= dict(zip(v[new].tolist(), forest.leaf_of(unit(x[new])).tolist(), strict=True))
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array([where[i] for i in best[1].tolist()], pa.list_(pa.int32()))], ["q", "v", "s", "leaves"])

    given, budget, near, fit = budget, budget or 0.0, [], a_ids[:0]
    if len(a_ids):
        near = vecs.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(exact, "q long, v long, s double, leaves array<int>")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= k).collect()  # AUDIT * k rows
        need = []
        fit = a_ids[::2]  # the others are held out, for the recall that is reported
        for i, order in zip(fit.tolist(), forest.order(unit(a_raw[::2])), strict=True):
            before = np.empty(forest.leaves)
            before[order] = np.cumsum(sizes[order])
            need += [before[r.leaves].min() for r in near if r.q == i]
        if given is None and need:
            budget = float(np.quantile(need, RECALL, method="higher")) + 1

    # the index: each vector once a tree, dealt by leaf and part
    parts = np.maximum(1, -(-sizes // PART))
    first = np.concatenate([[0], np.cumsum(parts)])
    groups = max(1, -(-total * TREES // GROUP))
    kind = vecs.schema["embedding"].dataType.simpleString()

    def index(batches):
        for b in batches:
            leaf = forest.leaf_of(unit(matrix(b.column(1))))
            u = first[leaf] + b.column(2).to_numpy()[:, None] % parts[leaf]
            for t in range(u.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(u[:, t] % groups), pa.array(u[:, t]), b.column(0), b.column(1)], ["g", "u", "v", "x"])

    def probe(batches):
        for b in (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK)):
            for n, order in enumerate(forest.order(unit(matrix(b.column(1))))):
                at = order[: int(np.searchsorted(np.cumsum(sizes[order]), budget)) + 1]
                u = np.repeat(first[at] - np.cumsum(parts[at]) + parts[at], parts[at]) + np.arange(parts[at].sum())
                u = u[np.argsort(u % groups, kind="stable")]
                gs, start = np.unique(u % groups, return_index=True)
                row, us = b.slice(n, 1), pa.ListArray.from_arrays(pa.array(np.append(start, len(u)), pa.int32()), pa.array(u))
                yield pa.RecordBatch.from_arrays([pa.array(gs), us, row.column(0).take(pa.array([0] * len(gs))), row.column(1).take(pa.array([0] * len(gs)))], ["g", "us", "q", "x"])

    salted = vecs.select(F.col("vec_id").cast("long"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1)).alias("h"))
    right = salted.mapInArrow(index, f"g long, u long, v long, x {kind}")

    def score(qs: pa.Table, vs: pa.Table) -> pa.Table:
        return _score(qs, vs, k)

    true = {(r.q, r.v) for r in near if r.q not in set(fit.tolist())} or {(r.q, r.v) for r in near}
    while True:
        left = queries.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(probe, f"g long, us array<long>, q long, x {kind}")
        got = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(score, "q long, v long, s double")
        got = got.groupBy("q", "v").agg(F.max("s").alias("s"))
        ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))).filter(F.col("rank") <= k)
        out = materialize(spark, ranked.select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), F.col("s").alias("score")), "near")
        hits = {(r.query_id, r.vec_id) for r in out.filter(F.col("query_id").isin(a_ids.tolist())).collect()} if true else set()  # AUDIT * k rows
        recall = len(true & hits) / len(true) if true else None
        if given is not None or recall is None or recall >= GOAL or budget >= sizes.sum():
            return out.withColumn("audit_recall", F.lit(recall).cast("double"))
        drop(spark, out)
        budget *= 2  # queries that the fit hasn't seen find too little: all look at more
