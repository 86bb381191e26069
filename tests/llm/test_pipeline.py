"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tindra.llm import pii, quality
from tindra.llm.common import materialize, table

from .test_graph_ops import plain_join


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    stage = dict(corpus_pipeline.STAGES)
    good = materialize(spark, stage["quality"](spark, docs, sf_dir), "t")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.collect()
    want = {r.doc_id for r, s in zip(rows, trees.score(quality.matrix([r.text for r in rows])), strict=True) if s >= quality.THRESHOLD}
    assert {r.doc_id for r in good.collect()} == want and good.columns == columns
    kept = materialize(spark, stage["near_duplicates"](spark, good, sf_dir), "t")
    joined = plain_join([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in joined if i == c} and kept.columns == columns
    clean = materialize(spark, stage["personal_data"](spark, kept, sf_dir), "t")
    out = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and len(out) == kept.count()
    for r in kept.collect():
        new = out[r.doc_id]
        assert new.n_chars == len(new.text) and not re.search(r"@mail\d|password=\w{8}", new.text)
        if not pii.candidates(r.text):
            assert new.text == r.text
    packed = stage["packing"](spark, clean, sf_dir).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(re.findall(r"[^ \t\n\x0b\f\r]{1,8}", r.text)) for r in out.values())
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)


def test_odd_rows(spark, odd, sf_dir):
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumn("component_id", F.lit(3)).withColumn("_id", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        if name != "packing":
            assert out.columns == docs.columns == empty.columns
    ids = sorted((r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir).collect()), key=str)
    assert ids == sorted({i for i, _ in odd}, key=str)
