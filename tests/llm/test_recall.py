"""Recall of the vector operators where it could fall: 50,000 vectors with planted near copies and clusters."""

import numpy as np
import pytest

from tindra.llm import rpforest, vamana

N, DIM = 50_000, 16


@pytest.fixture(scope="module")
def vectors(spark):
    """Strangers, clusters of 50 loose members, and 2,000 pairs of near copies (cosine over 0.97)."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, DIM))
    middles = rng.normal(size=(200, DIM))
    x[20_000:30_000] = middles[np.arange(10_000) // 50] + 0.35 * rng.normal(size=(10_000, DIM))
    x[40_000:42_000] = x[:2000] + 0.04 * rng.normal(size=(2000, DIM)) * np.linalg.norm(x[:2000], axis=1, keepdims=True) / np.sqrt(DIM)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(6).persist()
    y = x.astype(np.float64)
    return df, y / np.linalg.norm(y, axis=1, keepdims=True)


def test_near_copies_are_found(spark, vectors):
    df, y = vectors
    want = {}
    for a in range(0, N, 5000):
        s = y[a : a + 5000] @ y.T
        for i, j in zip(*np.nonzero(s >= 0.95), strict=True):
            if i + a != j:
                want.setdefault(int(i + a), set()).add(int(j))
    got = {r.vec_id: r.n_links for r in vamana.near_duplicates(spark, df).collect()}
    assert len(got) == N and sum(map(len, want.values())) >= 4000
    assert all(got[i] <= len(want.get(i, ())) for i in got)  # none below the threshold
    assert sum(got[i] for i in want) >= 0.97 * sum(map(len, want.values()))
    assert sum(got[i] == len(v) for i, v in want.items()) >= 0.95 * len(want)


def test_neighbours_are_found(spark, vectors):
    df, y = vectors
    rows = rpforest.search(spark, df, every=500).collect()
    found, true = {}, 0
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, N, 500):
        s = y @ y[q]
        s[q] = -2
        true += len(found.get(q, set()) & set(np.argsort(-s)[:5].tolist()))
    assert true >= 0.9 * 5 * N / 500 and rows[0].audit_recall >= 0.9
