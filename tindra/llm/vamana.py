"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors are one node with a weight. Centres are fitted on a bounded sample; every node goes to its `overlap` nearest
centres, so shards overlap. There is a shard for SHARD nodes each: over MOST_SHARDS of them, each shard gets centres of its own,
fitted on a bounded sample of it, and its nodes go to the two nearest of those, so shards don't grow with the data. In each shard every node's nearest candidates and some far ones are robust-pruned (a candidate
goes when a kept one is ALPHA times closer to it than the node is), reverse edges are added, and the adjacency lists of a
node's shards are united. Then every node is a query in each of its shards: a greedy beam search from the shard's medoid,
and from the hits and the node itself a range expansion that goes on while similarity stays over the threshold less SLACK.
Hits are verified by exact cosine in double precision. A pair is counted in the first shard that both ends share, so
no pair leaves its task: what comes out is a count and a forest of links a node. Shards over CAP nodes are split by hash
into blocks that every query of the shard visits, so a third of all rows in one group stays in bounded tasks.

Recall is audited by brute force over all rows: the mean, over sampled nodes that have links, of the share of a node's links
that were found. The sample grows from AUDIT nodes to MOST until LINKED of them have links; if none has, recall isn't measured
(null). Below GOAL the overlap grows and the search runs again.

Defined results: equal similarities need no order, since every hit at or over the threshold is a link; vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of one length are searched together, and the least recall of all lengths is told; a repeated vec_id counts as several vectors (and comes back as often); an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialize
from .components import connected_components, union_find
from .vectors import cosine, lengths, matrix, of_length, sample, unit, usable

SAMPLE, SHARD, MOST_SHARDS, CAP, INNER = 8192, 1500, 1024, 8192, 2
DEGREE, POOL, FAR, ALPHA, BEAM, SLACK = 20, 40, 6, 1.2, 12, 0.06
AUDIT, LINKED, MOST, GOAL = 128, 16, 8192, 0.98


def centres(points: np.ndarray, k: int, seed: int = 11, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        at = (points @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, points)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, pool: np.ndarray, sim: np.ndarray, degree: int) -> list[np.ndarray]:
    """Neighbours kept of each row's pool (indices, -1 for none), nearest first; all rows together."""
    dist = np.where(pool >= 0, 2 - 2 * sim, np.inf)
    kept = np.full((len(pool), degree), -1, np.int64)
    rows = np.arange(len(pool))
    for d in range(degree):
        at = dist.argmin(axis=1)
        live = np.isfinite(dist[rows, at])
        if not live.any():
            break
        best = np.where(live, pool[rows, at], -1)
        kept[:, d] = best
        near = 2 - 2 * np.einsum("ij,ikj->ik", x[np.maximum(best, 0)], x[np.maximum(pool, 0)])
        dist[live[:, None] & (ALPHA**2 * near <= dist)] = np.inf
        dist[rows[live], at[live]] = np.inf
    return kept


def build(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Adjacency of the shard's flat graph over unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    kept = []
    for i in range(0, n, 256):
        s = x[i : i + 256] @ x.T
        own = np.arange(i, min(i + 256, n))
        s[np.arange(len(own)), own] = -9
        k = min(POOL, n - 1)
        if k < 1:
            return [np.zeros(0, np.int64)] * n
        pool = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = robust_prune(x, pool, np.take_along_axis(s, pool, axis=1), DEGREE)
        far = rng.integers(0, n, (len(own), 2 * FAR))
        far[far == own[:, None]] = -1
        kept.append(np.hstack([near, robust_prune(x, far, np.take_along_axis(s, np.maximum(far, 0), axis=1), FAR)]))
    a = np.vstack(kept)
    src, dst = np.repeat(np.arange(n), a.shape[1])[a.ravel() >= 0], a.ravel()[a.ravel() >= 0]
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1, np.int64)
    for i, a in enumerate(lists):
        out[i, : len(a)] = a
    return out


def shard_lists(column, none: int) -> np.ndarray:
    """Each row's shards, filled up with `none`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), max(1, size.max(initial=0))), none, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy()
    return out


def range_search(q: np.ndarray, own: np.ndarray, x: np.ndarray, adj: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, similarity) of all nodes found over `least`; own: the query's own node, or -1."""
    n, m = len(x), len(q)
    mean = x.sum(axis=0)
    medoid = int((x @ mean).argmax())
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    beam = np.full((m, BEAM), -1, np.int64)
    sims = np.full((m, BEAM), -np.inf)
    beam[:, 0], sims[:, 0] = medoid, q @ x[medoid]
    seen[:, medoid] = True
    spent = np.zeros((m, BEAM), bool)
    for _ in range(4 * BEAM):
        score = np.where(spent | (beam < 0), -np.inf, sims)
        at = score.argmax(axis=1)
        live = np.flatnonzero(np.isfinite(score[rows, at]))
        if not len(live):
            break
        spent[live, at[live]] = True
        nb = adj[beam[live, at[live]]]
        nb = np.where((nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)], nb, -1)
        r, c = np.nonzero(nb >= 0)
        seen[live[r], nb[r, c]] = True
        s = np.full(nb.shape, -np.inf)
        s[r, c] = np.einsum("ij,ij->i", q[live[r]], x[nb[r, c]])
        b, t, p = np.hstack([beam[live], nb]), np.hstack([sims[live], s]), np.hstack([spent[live], np.zeros(nb.shape, bool)])
        top = np.argpartition(-t, BEAM - 1, axis=1)[:, :BEAM]
        beam[live], sims[live], spent[live] = (np.take_along_axis(z, top, axis=1) for z in (b, t, p))
    r, c = np.nonzero((beam >= 0) & (sims >= least))
    found = [(r, beam[r, c], sims[r, c])]
    reach = np.zeros((m, n), bool)
    reach[r, beam[r, c]] = True
    mine = np.flatnonzero(own >= 0)
    mine = mine[~reach[mine, own[mine]]]
    reach[mine, own[mine]] = True
    found.append((mine, own[mine], np.ones(len(mine))))
    front = [(np.concatenate([r, mine]), np.concatenate([beam[r, c], own[mine]]))]
    while front:
        fq, fn = front.pop()
        for i in range(0, len(fq), 20_000):
            a, nb = fq[i : i + 20_000], adj[fn[i : i + 20_000]]
            k, c = np.nonzero(nb >= 0)
            key = np.unique(a[k] * n + nb[k, c])
            a, b = key // n, key % n
            fresh = ~reach[a, b]
            a, b = a[fresh], b[fresh]
            reach[a, b] = True
            s = np.einsum("ij,ij->i", q[a], x[b])
            ok = s >= least
            if ok.any():
                found.append((a[ok], b[ok], s[ok]))
                front.append((a[ok], b[ok]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _refined(spark, rows: DataFrame, kind: str, parts: int) -> DataFrame:
    """rows(rep, weight, embedding, shard) dealt anew: each shard's nodes to the INNER nearest of `parts` centres of its own. Nodes
    meet a shard's centres in chunks of CAP rows, so no task holds a whole shard."""
    w = Window.partitionBy("shard").orderBy(F.xxhash64("rep", "shard"))
    some = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 4 * parts).select("shard", "embedding")

    def fit(t: pa.Table) -> pa.Table:
        c = centres(unit(matrix(t.column("embedding"))), parts)
        return pa.table([pa.array([t.column("shard")[0].as_py()], pa.int64()), pa.array([c.ravel()], pa.list_(pa.float64())), pa.array([len(c)], pa.int32())], ["shard", "centres", "n"])

    fitted = materialize(spark, some.groupBy("shard").applyInArrow(fit, "shard long, centres array<double>, n int"), "centres")
    chunks = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / CAP).cast("int").alias("chunks"))
    dealt = rows.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("shard", "rep"), F.col("chunks")).cast("int")).select("shard", "chunk", "rep", "embedding")
    sent = fitted.join(chunks, "shard").select("shard", "centres", "n", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def deal(ns: pa.Table, cs: pa.Table) -> pa.Table:
        if not ns.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "shard": pa.array([], pa.int64())})
        c = np.array(cs.column("centres")[0].as_py()).reshape(cs.column("n")[0].as_py(), -1)
        s = unit(matrix(ns.column("embedding"))) @ c.T
        k = min(INNER, len(c))
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pa.table([pa.array(np.repeat(ns.column("rep").to_numpy(), k)), pa.array((ns.column("shard").to_numpy()[:, None] * parts + top).ravel())], ["rep", "shard"])

    to = dealt.groupBy("shard", "chunk").cogroup(sent.groupBy("shard", "chunk")).applyInArrow(deal, "rep long, shard long")
    lists = to.groupBy("rep").agg(F.collect_set("shard").alias("shards"))  # overlap * INNER of them at most
    nodes = rows.select("rep", "weight", "embedding").dropDuplicates(["rep"])
    return materialize(spark, nodes.join(lists, "rep").select("*", F.explode("shards").alias("shard")), "shards")


def _search(spark, reps: DataFrame, kind: str, centre: np.ndarray, overlap: int, threshold: float, parts: int = 1) -> DataFrame:
    """(rep, linked, root): weight of the vectors linked to each node, and local links as a forest; some rows a node."""

    def place(batches):
        for b in batches:
            s = unit(matrix(b.column(2))) @ centre.T
            k = min(overlap, len(centre))
            top = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(top), pa.list_(pa.int64()))], ["rep", "weight", "embedding", "shards"])

    placed = reps.select("rep", "weight", "embedding").mapInArrow(place, f"rep long, weight long, embedding {kind}, shards array<long>")
    rows = materialize(spark, placed.select("*", F.explode("shards").alias("shard")), "shards")
    if parts > 1:
        rows = _refined(spark, rows, kind, parts)
    sizes = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / CAP).cast("int").alias("blocks"))  # one row a shard
    nodes = rows.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("rep", "shard"), F.col("blocks")).cast("int"))  # other blocks in each shard

    def graph(t: pa.Table) -> pa.Table:
        ids = t.column("rep").to_numpy()
        lists = build(unit(matrix(t.column("embedding"))))
        return pa.table([t.column("rep"), pa.array([ids[a] for a in lists], pa.list_(pa.int64()))], ["rep", "near"])

    lists = nodes.groupBy("shard", "block").applyInArrow(graph, "rep long, near array<long>")
    # a node has one list a shard, each of bounded length
    united = materialize(spark, lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    full = nodes.join(united, "rep").select("shard", "block", "rep", "weight", "embedding", "shards", "near")
    asking = nodes.select(F.col("shard").alias("in_shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in_block"), F.col("rep").alias("q"), F.col("embedding").alias("qx"), F.col("shards").alias("qs"))

    def find(key, qs: pa.Table, vs: pa.Table) -> pa.Table:
        out = ([], [], [])
        if qs.num_rows and vs.num_rows:
            order = np.argsort(vs.column("rep").to_numpy())
            ids, weight = vs.column("rep").to_numpy()[order], vs.column("weight").to_numpy()[order]
            raw = matrix(vs.column("embedding"))[order]
            near = vs.column("near").combine_chunks()
            ends, flat = near.offsets.to_numpy(), near.values.to_numpy()
            at = np.searchsorted(ids, flat)
            at = np.where(ids[np.minimum(at, len(ids) - 1)] == flat, np.minimum(at, len(ids) - 1), -1)
            adj = padded([(a := at[ends[i] : ends[i + 1]])[a >= 0] for i in order])
            x, shard = unit(raw), key[0].as_py()
            v_sh = shard_lists(vs.column("shards"), -1)[order]
            q_ids, q_raw, q_sh = qs.column("q").to_numpy(), matrix(qs.column("qx")), shard_lists(qs.column("qs"), -2)
            q_x = unit(q_raw)
            own = np.searchsorted(ids, q_ids)
            own = np.where(ids[np.minimum(own, len(ids) - 1)] == q_ids, np.minimum(own, len(ids) - 1), -1)
            links = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            linked = np.zeros(len(q_ids), np.int64)
            for i in range(0, len(q_ids), 512):
                q, v, s = range_search(q_x[i : i + 512], own[i : i + 512], x, adj, threshold - SLACK)
                q = q + i
                ok = s >= threshold + 1e-9
                edge = np.flatnonzero(~ok & (s >= threshold - 1e-9))
                ok[edge] = cosine(q_raw[q[edge]], raw[v[edge]]) >= threshold
                ok &= q_ids[q] != ids[v]
                q, v = q[ok], v[ok]
                n, r = union_find(q_ids[q], ids[v])
                links[0].append(n)
                links[1].append(r)
                common = np.full(len(q), 2**62)
                for a in range(q_sh.shape[1]):  # the first shard that both ends share counts the pair
                    common = np.where((v_sh[v] == q_sh[q, a][:, None]).any(axis=1), np.minimum(common, q_sh[q, a]), common)
                here = common == shard
                linked += np.bincount(q[here], weight[v[here]], len(q_ids)).astype(np.int64)
            n, r = union_find(*map(np.concatenate, links))
            out = (np.concatenate([q_ids, n]), np.concatenate([linked, np.zeros(len(n), np.int64)]), np.concatenate([q_ids, r]))
        return pa.table([pa.array(o, pa.int64()) for o in out], ["rep", "linked", "root"])

    got = asking.groupBy("in_shard", "in_block").cogroup(full.groupBy("shard", "block")).applyInArrow(find, "rep long, linked long, root long")
    return materialize(spark, got, "links")


def truth(reps: DataFrame, threshold: float) -> dict[int, int]:
    """Links, by brute force over all rows, of the sampled nodes that have any: MOST nodes at most."""
    most = AUDIT
    while True:
        ids, raw = sample(reps.withColumnRenamed("rep", "vec_id"), most)
        x = unit(raw) if len(ids) else raw

        def exact(batches, ids=ids, x=x):
            seen = np.zeros(len(ids), np.int64)
            for b in batches:
                v, w, y = b.column(0).to_numpy(), b.column(1).to_numpy(), unit(matrix(b.column(2))).T
                for i in range(0, len(ids), 128):
                    hit = (x[i : i + 128] @ y >= threshold) & (ids[i : i + 128, None] != v[None, :])
                    seen[i : i + 128] += (hit * w[None, :]).sum(axis=1)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(seen[at])], ["rep", "n"])

        true = reps.select("rep", "weight", "embedding").mapInArrow(exact, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
        found = {r.rep: r.n for r in true.collect()} if len(ids) else {}
        if len(found) >= LINKED or len(ids) < most or most >= MOST:
            return found
        most *= 8


def audit(links: DataFrame, true: dict[int, int]) -> float | None:
    """Mean share of a node's true links that the search has found too; None if there are none to look for."""
    if not true:
        return None
    got = {r.rep: r.n for r in links.filter(F.col("rep").isin(*true)).groupBy("rep").agg(F.sum("linked").alias("n")).collect()}
    return sum(min(n, got.get(i, 0)) / n for i, n in true.items()) / len(true)


def _links(spark: SparkSession, reps: DataFrame, kind: str, threshold: float, overlap: int) -> tuple[DataFrame, float | None]:
    """Links of nodes of one length, and the audited recall."""
    _, points = sample(reps.withColumnRenamed("rep", "vec_id"), SAMPLE)
    shards = -(-reps.count() // SHARD)
    centre, parts = centres(unit(points), min(MOST_SHARDS, shards)), -(-shards // MOST_SHARDS)
    true = truth(reps, threshold)
    while True:
        links = _search(spark, reps, kind, centre, overlap, threshold, parts)
        recall = audit(links, true)
        if recall is None or recall >= GOAL or overlap >= len(centre):
            return links, recall
        drop(spark, links)
        overlap *= 2


def near_duplicates(spark: SparkSession, df: DataFrame, threshold: float = 0.95, overlap: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall, one row a vector."""
    kind = df.schema["embedding"].dataType.simpleString()
    vecs = usable(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    reps = materialize(spark, vecs.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "reps")
    parts = [_links(spark, of_length(reps, n), kind, threshold, overlap) for n in lengths(reps)]
    links = reduce(DataFrame.unionByName, [x for x, _ in parts]) if parts else spark.createDataFrame([], "rep long, linked long, root long")
    recall = min((r for _, r in parts if r is not None), default=None)
    counts = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    comps = connected_components(spark, links.filter("rep != root").select("rep", "root"))
    by_rep = counts.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "linked", F.coalesce("component", "rep").alias("component_id"))
    known = reps.select("embedding", "rep", "weight").join(by_rep, "rep")
    rows = df.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding")).join(known, "embedding", "left")
    n = F.coalesce(F.col("linked") + F.col("weight") - 1, F.lit(0)).cast("long")
    comp = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", n.alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
