"""The stored index: the same answers as the unstored search, from a part of the postings; string ids; many questions."""

import random

import numpy as np
from pyspark.sql import functions as F

from tindra.functions import python as fp
from tindra.operators import blockmax
from tindra.operators import retrieval as R

from .test_operators import rows


def corpus(spark, n=600, seed=1, kind="string"):
    rng = random.Random(seed)
    words = [f"orð{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(f"c{i:04d}" if kind == "string" else i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for q in range(25)] + [(90, "hvergi finnst"), (91, ""), (92, None)]
    return spark.createDataFrame(docs, f"id {kind}, text string"), spark.createDataFrame(asked, "q int, text string")


def stored(df, tmp_path, **more):
    R.store(df, f"{tmp_path}/ix", **more)
    return R.load(df.sparkSession, f"{tmp_path}/ix")


def test_same_as_unstored(spark, tmp_path):
    for kind in ("string", "long"):
        docs, asked = corpus(spark, kind=kind)
        ix = stored(docs, tmp_path / kind, shard=100, buckets=8)
        assert ix["postings"].select("shard").distinct().count() == 6
        assert rows(R.hybrid_stored(ix, asked)) == rows(R.hybrid(docs, asked))
        want = rows(R.ranked(R.bm25(R.index(docs), asked), 7), "q", "id", "rank")
        assert rows(R.ranked(R.sparse_stored(ix, asked, 7), 7), "q", "id", "rank") == want


def test_many_questions(spark, tmp_path, monkeypatch):
    docs, asked = corpus(spark)
    want = rows(R.hybrid(docs, asked))
    ix = stored(docs, tmp_path)
    monkeypatch.setattr(fp, "ASKED", 7)
    assert rows(R.hybrid_stored(ix, asked)) == want and rows(R.hybrid(docs, asked)) == want
    few = R.sparse_stored(ix, asked, 7, block=4)
    assert rows(R.ranked(few, 7), "q", "id", "rank") == rows(R.ranked(R.bm25(R.index(docs), asked), 7), "q", "id", "rank")


def test_only_a_part_is_read(spark, tmp_path):
    """One question touches the folders of its terms, and of their postings those of blocks that can matter."""
    docs, _ = corpus(spark, 4000)
    ix = stored(docs, tmp_path, shard=2000)
    q = spark.createDataFrame([(0, "orð299 orð250 orð0")], "q int, text string")
    part = R.pruned(ix, R.asked_of(ix, R.asked_terms(q)))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(part) <= 3 < 0.1 * files(ix["postings"])
    seen = R.sparse_stored(ix, q, 10, trace=True).first()
    assert seen.opened < 0.5 * seen.postings


def shuffled(spark, run):
    """Records that an action shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for s, n in stages().items() if s not in before)


def test_unstored_shuffles_no_postings(spark):
    """Neither postings, nor questions x texts, nor texts: the texts' ids and each task's best."""
    words = [f"w{i}" for i in range(120)]
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(4000)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 60))) for q in range(3)], "q int, text string")
    assert shuffled(spark, lambda: R.hybrid(docs, asked).collect()) < 30_000


def test_store_shuffles_lists(spark, tmp_path):
    """Building an index shuffles ids, finished posting lists and counts of terms, neither single postings nor entries of vectors."""
    docs, _ = corpus(spark, 2000)
    assert shuffled(spark, lambda: R.store(docs, f"{tmp_path}/ix")) < 6000


def test_stored_odd_ids(spark, tmp_path, monkeypatch):
    """Rows that share an id are one text in postings and vectors; shards end at a number of words, too."""
    docs, asked = corpus(spark, 300, kind="long")
    docs = docs.unionByName(spark.createDataFrame([(5000, "orð0 orð1 orð299"), (5000, "orð2 orð0 orð3"), (999, None)], "id long, text string"))
    monkeypatch.setattr(fp, "WORDS", 50)
    ix = stored(docs, tmp_path)
    assert ix["postings"].select("shard").distinct().count() > 20
    assert rows(R.ranked(R.sparse_stored(ix, asked, 7), 7), "q", "id", "rank") == rows(R.ranked(R.bm25(R.index(docs), asked), 7), "q", "id", "rank")
    want = {(r.id, r.bucket): round(r.weight, 9) for r in R.hashed(docs).collect()}
    got = ix["vectors"].select("id", F.explode(F.arrays_zip("bucket", "weight")).alias("x")).select("id", "x.*").collect()
    assert {(r.id, r.bucket): round(r.weight, 9) for r in got} == want and len(got) == len(want)


def test_bm25_in_tasks(spark, monkeypatch):
    """The same scores as by joins, also of ids that rows share or lack, by pieces, and of terms that one or all questions have."""
    docs, asked = corpus(spark, 300, kind="long")
    odd = spark.createDataFrame([(5, "orð0 orð1 orð299"), (5, "orð0"), (None, "orð0 orð7"), (None, None), (999, None)], "id long, text string")
    asked = asked.unionByName(spark.createDataFrame([(100 + q, "orð0 orð1") for q in range(9)], "q int, text string"))
    for d in (docs, docs.unionByName(odd)):
        want = rows(R.ranked(R.bm25(R.index(d), asked), 20), "q", "id", "rank")
        assert rows(R.ranked(R.sparse_best(d, asked, 20), 20), "q", "id", "rank") == want
    monkeypatch.setattr(fp, "HITS", 3)
    monkeypatch.setattr(fp, "SLICE", 7)
    assert rows(R.ranked(R.sparse_best(d, asked, 20), 20), "q", "id", "rank") == want
    assert R.sparse_best(d, asked.limit(0), 20).count() == 0 and R.sparse_best(d.limit(0), asked, 20).count() == 0


def test_search(spark, tmp_path):
    docs, _ = corpus(spark, 50)
    ix = stored(docs, tmp_path)
    assert {r["mode"] for r in R.search(ix, "orð0 orð5", 3).collect()} == {"hybrid"} and R.search(ix, "orð0 orð5", 3).count() == 3
    assert {r["mode"] for r in R.search(ix, "zzz", 3).collect()} <= {"dense"}
    none = stored(docs.limit(0), tmp_path / "none")
    assert R.search(none, "orð0").count() == 0


def test_best_with_floats():
    rng = np.random.default_rng(2)
    lists = []
    for df in (900, 300, 20):
        p = np.sort(rng.choice(1000, df, replace=False))
        c = rng.random(df) * rng.random()
        e = np.minimum(np.arange(64, 64 * (-(-df // 64)) + 1, 64), df)
        lists.append((p, c, e, np.maximum.reduceat(c, np.concatenate([[0], e[:-1]]))))
    every = np.zeros(1000)
    for p, c, _, _ in lists:
        every[p] += c
    places, scores = blockmax.best(lists, 10)
    want = np.lexsort((np.arange(1000), -every))[:10]
    assert places.tolist() == want.tolist() and np.allclose(scores, every[want])
