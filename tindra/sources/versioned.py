"""Tables with versions: rows in buckets of their key, and a manifest a version that says which folder has which bucket.

A merge rewrites the buckets that its updates touch and names the folders of all others again. The manifest is written last, under
the next number, and only if no one has written that number before: until then readers see the old version, and of two
writers at once the slower one fails and leaves it as it is. Nothing that a version names is ever changed or deleted here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Conflict(Exception):
    """Another writer made this version first."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    p, fs = _fs(spark, f"{folder}/manifests")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """key, buckets, schema, and paths: bucket -> folder. The latest version, or the one asked for."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{folder} has no version {'' if version is None else version}".strip())
    text = spark.read.option("wholetext", True).text(f"{folder}/manifests/{known[-1] if version is None else version:08d}.json").first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, folder: str, version: int, body: dict) -> None:
    p, fs = _fs(spark, f"{folder}/manifests/{version:08d}.json")
    draft, _ = _fs(spark, f"{folder}/manifests/.{version:08d}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
    out.close()
    # a rename onto an existing file fails on shared file systems; where it would replace it, the check before it does
    done = not fs.exists(p) and fs.rename(draft, p)
    if not done:
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {folder} is there already")


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(spark: SparkSession, df: DataFrame, folder: str, key: list[str], buckets: int) -> dict[str, str]:
    """Writes rows by bucket into a folder of its own; bucket -> path of those that have rows."""
    run = f"data/{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", *key).write.partitionBy("_bucket").parquet(f"{folder}/{run}")
    p, fs = _fs(spark, f"{folder}/{run}")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {n.removeprefix("_bucket="): f"{run}/{n}" for n in names if n.startswith("_bucket=")}


def create(df: DataFrame, folder: str, key: list[str] | str, buckets: int = BUCKETS) -> dict:
    """Version 0 of a table. Rows of one key go to one bucket; null keys are keys like others."""
    key = [key] if isinstance(key, str) else key
    spark = df.sparkSession
    if versions(spark, folder):
        raise Conflict(f"{folder} is a table already")
    body = {"version": 0, "key": key, "buckets": buckets, "schema": df.schema.json(), "paths": _write(spark, df, folder, key, buckets), "rewritten": []}
    _publish(spark, folder, 0, body)
    return body


def read(spark: SparkSession, folder: str, version: int | None = None, only: list[str] | None = None) -> DataFrame:
    """A version's rows; only: those of some buckets."""
    body = manifest(spark, folder, version)
    schema = T.StructType.fromJson(json.loads(body["schema"]))
    paths = [f"{folder}/{p}" for b, p in sorted(body["paths"].items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(spark: SparkSession, folder: str, updates: DataFrame, change: dict[str, Callable[[Column, Column], Column]], insert: bool = True) -> dict:
    """The next version: rows whose key is among the updates' get change[column](old, new); columns without a rule keep the old
    value. Updates of unknown keys are inserted, or dropped. updates must have one row a key. Returns the manifest, whose
    `rewritten` lists the buckets that were written anew.

    Only the touched buckets are read, joined and written; which they are is a set of at most `buckets` numbers.
    """
    body = manifest(spark, folder)
    key, n = body["key"], body["buckets"]
    schema = T.StructType.fromJson(json.loads(body["schema"]))
    touched = sorted(str(r[0]) for r in updates.select(_bucket(key, n)).distinct().collect())
    old = read(spark, folder, body["version"], touched).withColumn("_old", F.lit(True)).alias("o")
    new = updates.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    both = old.join(new, on, "full" if insert else "left")

    def value(f: T.StructField) -> Column:
        c = f.name
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}") if c in updates.columns else F.lit(None)
        known = change[c](was, now) if c in change and c not in key else was
        return F.when(F.col("o._old").isNull(), now).when(F.col("n._new").isNull(), was).otherwise(known).cast(f.dataType).alias(c)

    rows = both.select(*[value(f) for f in schema.fields])
    written = _write(spark, rows, folder, key, n) if touched else {}
    paths = {b: p for b, p in body["paths"].items() if b not in touched} | written
    made = body | {"version": body["version"] + 1, "paths": paths, "rewritten": touched}
    _publish(spark, folder, made["version"], made)
    return made


def keep_first(old: Column, new: Column) -> Column:
    """A claim: what is there stays, what is missing is filled."""
    return F.coalesce(old, new)


def overwrite(old: Column, new: Column) -> Column:
    return new


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
