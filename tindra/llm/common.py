"""Helpers shared by the training-data operators: table access, scratch tables and batch mapping."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tindra-")
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    except Exception:  # the JVM may have gone first; the folder is scratch
        pass


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read, not a recomputation.
    """
    path = f"{shared_dir(spark)}/tindra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tindra_path = path
    return out


BITS = 1 << 23


def maybe_among(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean column: false where df's key surely isn't among ids(key), true where it may be.

    A bitmap of hashes of fixed size (1 MB, so broadcast): with many more ids than bits all rows are true, and callers, who
    join the true rows on the key in any case, are right at every size.
    """
    pos = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bucket, bits, at = f"{flag}_bucket", f"{flag}_bits", f"{flag}_at"
    bitmap = ids.select(pos.alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    rows = df.withColumn(at, pos).withColumn(bucket, F.bitmap_bucket_number(at)).withColumn(at, F.bitmap_bit_position(at).cast("int"))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.col(at) % 8) == 1
    return rows.join(F.broadcast(bitmap), bucket, "left").withColumn(flag, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop(bucket, bits, at)


def mark() -> int:
    """A point in time for sweep."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables materialized since a mark but those to keep, which must not read the others."""
    kept = [df._tindra_path for df in keep]
    for path in _MADE[since:]:
        if path not in kept:
            _remove(spark, path)
    _MADE[since:] = kept


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete materialized tables that no result reads any more."""
    for df in frames:
        _remove(spark, df._tindra_path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python in batches of at most 8 MB: buffers on both sides stay small whatever the texts' length.
    Spark has this as a setting of the session only, so it stays set; it bounds batches, results don't depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 4_000_000):
    """Zero-copy slices of a batch whose texts have about `limit` bytes at most, so that Python memory stays bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
