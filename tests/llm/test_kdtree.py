"""Centroid clustering against plain loops over all vectors and centroids."""

import hashlib
import math

import numpy as np

from tindra.llm import kdtree


def plain(rows, k=kdtree.K, rounds=kdtree.ROUNDS, dim=kdtree.DIM):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    if not centres:
        return []
    last = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in last if c == j) for _, j, _ in last}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in last), key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(parts)
    return sorted(map(tuple, kdtree.cluster(spark, df).collect()), key=str)


def odd():
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(5, 64))
    rows = [(i, (groups[i % 5] + rng.normal(size=64) * (0.05 if i % 3 else 1.5)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 64) for i in range(300)]  # a hot group of copies
    rows += [(i, rows[i][1]) for i in range(5)]  # repeated rows
    rows += [(2000, None), (2001, [1.0] * 3), (2002, [float("nan")] * 64), (2003, [float("inf")] + [0.0] * 63), (2004, [None] + [0.0] * 63), (2005, []), (None, [0.25] * 64), (2006, [-0.001] * 64), (2007, [0.0] * 64)]
    return rows


def test_plain(spark):
    rows = odd()
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 708


def test_trees_of_any_size_agree(spark, monkeypatch):
    rows = odd()
    monkeypatch.setattr(kdtree, "TREE", 50)
    assert run(spark, rows, 1) == run(spark, rows, 7)


def test_few_and_none(spark):
    three = [(i, [float(i)] * 64) for i in range(3)]
    assert run(spark, three) == plain(three) and len({r[1] for r in run(spark, three)}) == 3
    assert run(spark, []) == [] and run(spark, [(None, [1.0] * 64)]) == []
    ties = [(i, [float(i % 2)] * 64) for i in range(40)]  # equal first centroids: the smaller number has all
    assert run(spark, ties) == plain(ties)
    huge = run(spark, [(1, [1e30] * 64), (2, [-1e30] * 64)])
    assert [r[2] for r in huge] == [0, 0]


def test_most_points_need_no_comparison():
    """On clustered vectors whole nodes are assigned; pruning never takes the nearest centroid away."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 16, 4000)[:, None] * 40 + rng.integers(0, 6, (4000, 64))).astype(np.int32)
    t = kdtree.build(x)
    x = x[t["order"]]
    t |= {"points": x, **kdtree.summaries(x, t["start"], t["end"], t["kids"])}
    centres = np.repeat(np.arange(16)[:, None] * 40 + 3, 64, axis=1).astype(np.int64)
    seen = []
    nodes, owner, spots, to = kdtree.filtered(t, centres, seen)
    out = np.full(4000, -1)
    for n, c in zip(nodes, owner, strict=True):
        out[t["start"][n] : t["end"][n]] = c
    out[spots] = to
    assert (out == ((x[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(seen) < 400
