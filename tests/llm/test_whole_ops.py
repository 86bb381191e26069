"""What the operators must not lose: rare links in the audit, lengths of vectors, texts of repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tindra.llm import rpforest, sigtree, vamana

from .test_graph_ops import near_copies, plain_join, roots, vector_frame, vectors


def test_audit_sees_rare_links(spark):
    """A hot node whose links are all found doesn't hide one whose link is lost; without links nothing is measured."""
    links = spark.createDataFrame([(1, 1000, 1), (2, 0, 2)], "rep long, linked long, root long")
    assert vamana.audit(links, {1: 1000, 2: 1}) == 0.5 and vamana.audit(links, {}) is None


def test_audit_samples_on_to_linked_nodes(spark, monkeypatch):
    monkeypatch.setattr(vamana, "AUDIT", 2)
    x = np.random.default_rng(5).normal(size=(400, 16)).astype(np.float32)
    x[7] = x[8] * 1.001 + 0.001
    reps = vector_frame(spark, x, []).select(F.col("vec_id").cast("long").alias("rep"), F.lit(1).cast("long").alias("weight"), "embedding")
    assert vamana.truth(reps, 0.95) == {7: 1, 8: 1}
    alone = vamana.near_duplicates(spark, vector_frame(spark, x[:5], [])).collect()
    assert len(alone) == 5 and all(r.audit_recall is None for r in alone)


def test_every_length_is_searched(spark):
    """Most vectors have 16 components; those of 8 have copies and neighbours too."""
    x, y = vectors(6, 320), np.random.default_rng(7).normal(size=(60, 8)).astype(np.float32)
    y[1], y[3] = y[0], 3 * y[2]
    extra = [(1000 + i, v) for i, v in enumerate(y.tolist())]
    df = vector_frame(spark, x, extra)
    got = {r.vec_id: r for r in vamana.near_duplicates(spark, df).collect()}
    u = y.astype(float) / np.linalg.norm(y.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    comp = roots(zip(*(a.tolist() for a in np.nonzero(link)), strict=True), range(len(y)))
    assert len(got) == len(x) + len(y) and link[0, 1] and link[2, 3]
    assert all((got[1000 + i].n_links, got[1000 + i].component_id) == (link[i].sum(), 1000 + comp[i]) for i in range(len(y)))
    near = rpforest.search(spark, df).collect()
    assert {r.query_id for r in near} == {*range(0, len(x), 50), 1000, 1050}
    assert all((r.query_id >= 1000) == (r.vec_id >= 1000) for r in near)
    for q in (0, 50):
        s = u @ u[q]
        s[q] = -9
        own = [r.vec_id - 1000 for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == 1000 + q]
        assert own == np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()


@pytest.mark.parametrize("cap", [2048, 2])
def test_repeated_ids_with_two_texts(spark, frame, monkeypatch, cap):
    """Links that meet in hot blocks only, of both texts of one doc_id; and the classes of its texts are one component."""
    import random

    monkeypatch.setattr(sigtree, "CAP", cap)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {t}" for _ in range(8) for t in near_copies(rng, 4, 100, 4)]
    rows = [(i // 2 if i % 8 == 1 else 100 + i, t) for i, t in enumerate(texts)]
    rows += [(rows[1][0], texts[9] + " more"), (rows[9][0], texts[20]), (1, "a b c d e f"), (90, "a b c d e f"), (90, "x y z u v w"), (91, "x y z u v w")]
    got = sigtree.join(spark, frame(rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == plain_join(rows)


def test_pipeline_keeps_each_text_of_a_repeated_id(spark, sf_dir):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "one two three four five six"), (2, "other words that stand here alone")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted({*rows})
