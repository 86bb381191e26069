"""Ids, running sums and medians over many range partitions, at a size where sampled bounds differ from run to run."""

import statistics
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tindra.operators import numbering
from tindra.operators.spine import with_ids

LINES = "/root/testdata/sf0.1/lineitem.parquet"


def test_ids_at_size(spark):
    """600,000 rows in 64 partitions: unique, gapless, and in the order asked for."""
    df = spark.read.parquet(LINES).select("l_orderkey", "l_linenumber", F.repeat(F.lit("x"), 40).alias("pad"))
    got = numbering.numbered(df, "l_orderkey", "l_linenumber", parts=64)
    n, distinct, low, high = got.agg(F.count("id"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    assert (n, distinct, low, high) == (600_000, 600_000, 1, 600_000)
    t = got.select("id", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("k")).toArrow()
    ids, keys = t.column("id").to_numpy(), t.column("k").to_numpy()
    assert (np.sort(keys)[ids - 1] == keys).all()


def test_ids_of_a_plan_with_changing_columns(spark):
    """The consumer that joins two columns and the one that counts see the same cut."""
    ids = with_ids(spark.read.parquet(LINES).select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey", "l_linenumber")
    assert ids.select("id").distinct().count() == 600_000
    assert ids.filter("id <= 3").orderBy("id").select("l_orderkey", "l_linenumber").collect() == ids.orderBy("l_orderkey", "l_linenumber").limit(3).select("l_orderkey", "l_linenumber").collect()


def test_running_sums(spark):
    rows = [(g, k, (k * 7) % 5) for g in ("a", "b", None) for k in range(200)] + [("hot", k, 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(5)
    got = {(r.g, r.k): r.upto for r in numbering.running(df, "g", "v", "k", parts=13).collect()}
    total, want = defaultdict(int), {}
    for g, k, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[g, k] = total[g]
        total[g] += v
    assert got == want


def test_medians_with_null_keys(spark):
    values = {"a": [5.0, 1.0, 3.0], None: [2.0, 8.0, 8.0, 9.0], "c": [7.0] * 500 + [1.0] * 499, "d": [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(5)
    got = {r.k: r["median"] for r in numbering.medians(df, "k", "v", parts=9).collect()}
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert numbering.numbered(none, "k").count() == 0 and numbering.medians(none, "k", "v").count() == 0 and numbering.running(none, "k", "v", "v").count() == 0
