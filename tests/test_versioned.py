"""Merges rewrite touched buckets only, failed and rival writers leave the old version; streams give the batch answer."""

import random

import pytest
from pyspark.sql import functions as F

from tindra.sources import versioned as V
from tindra.streaming import states as S

from .test_operators import rows


@pytest.fixture()
def people(spark, tmp_path):
    folder = str(tmp_path / "people")
    df = spark.createDataFrame([(i, f"n{i}", "nm1" if i == 3 else None, 1) for i in range(200)] + [(None, "nobody", None, 1)], "id long, name string, nconst string, credits long")
    V.create(df, folder, "id", 16)
    return folder


CLAIM = {"nconst": V.keep_first, "credits": V.add}


def test_merge(spark, people):
    new = spark.createDataFrame([(3, "other", "nm9", 5), (4, None, "nm4", 2), (900, "new", "nm7", 7), (None, None, "nm0", 1)], "id long, name string, nconst string, credits long")
    made = V.merge(spark, people, new, CLAIM)
    got = V.read(spark, people)
    assert rows(got.filter("id in (3, 4, 5, 900) or id is null")) == sorted([(3, "n3", "nm1", 6), (4, "n4", "nm4", 3), (5, "n5", None, 1), (900, "new", "nm7", 7), (None, "nobody", "nm0", 2)], key=str)
    assert got.count() == 202 and V.versions(spark, people) == [0, 1]
    old = V.manifest(spark, people, 0)["paths"]
    assert 1 <= len(made["rewritten"]) <= 4 and {b for b in old if old[b] != made["paths"][b]} == set(made["rewritten"])
    assert rows(V.read(spark, people, 0).filter("id = 3")) == [(3, "n3", "nm1", 1)]
    assert V.merge(spark, people, new.limit(0), CLAIM)["rewritten"] == [] and V.read(spark, people).count() == 202
    V.merge(spark, people, spark.createDataFrame([(901, "x")], "id long, name string"), {}, insert=False)
    assert V.read(spark, people).count() == 202


def test_a_failed_write_leaves_the_old_version(spark, people):
    bad = spark.createDataFrame([(3, "x", "y", 1)], "id long, name string, nconst string, credits long")
    before = rows(V.read(spark, people))
    with pytest.raises(Exception, match="no good"):
        V.merge(spark, people, bad, {"nconst": lambda old, new: F.raise_error(F.lit("no good"))})
    assert rows(V.read(spark, people)) == before and V.versions(spark, people) == [0]


def test_the_slower_of_two_writers_fails(spark, people, monkeypatch):
    new = spark.createDataFrame([(3, "x", "y", 1)], "id long, name string, nconst string, credits long")
    write = V._write

    def late(*args):
        monkeypatch.setattr(V, "_write", write)
        V.merge(spark, people, new, {"credits": V.add})
        return write(*args)

    monkeypatch.setattr(V, "_write", late)
    with pytest.raises(V.Conflict):
        V.merge(spark, people, new, {"credits": V.overwrite})
    assert rows(V.read(spark, people).filter("id = 3")) == [(3, "n3", "nm1", 2)]
    with pytest.raises(V.Conflict):
        V.create(new, people, "id")
    with pytest.raises(FileNotFoundError):
        V.read(spark, people, 77)


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("cuts", [[], [13], [4, 9, 20, 21]])
def test_streams_give_the_batch_answer(spark, tmp_path, rocks, cuts):
    """Any split of the input into files and runs; each run starts anew from the checkpoint."""
    rng = random.Random(2)
    decisions = [(i, *rng.sample(range(4), 2), rng.choice(["merged", "rejected"])) for i in range(30)]
    snaps = [(i, rng.choice("abc"), rng.choice([0.0, 10.0, 10.5, 11.0, 8.0])) for i in range(30)]
    ends = [*cuts, 30]
    for name, data, schema, make, mode in (("d", decisions, S.DECISIONS, S.decision_stream, "update"), ("m", snaps, S.SNAPSHOTS, S.metric_stream, "append")):
        at = 0
        for end in ends:
            spark.createDataFrame(data[at:end], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            at = end
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
            S.drain(make(stream), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/checkpoint", mode)
    assert rows(S.last_of(spark, f"{tmp_path}/d/out")) == rows(S.latest_decisions(spark.createDataFrame(decisions, S.DECISIONS)))
    assert rows(spark.read.parquet(f"{tmp_path}/m/out").drop("batch")) == rows(S.moved_metrics(spark.createDataFrame(snaps, S.SNAPSHOTS)))
