"""Tables that a plan writes once and reads again, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tindra-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tindra/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # the JVM may have gone first; the folder is scratch
        pass


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends here, what was chosen once (a range partition's bounds, say) stays
    so, and a lost executor costs a re-read. The table goes when the application ends."""
    path = new_path(spark, name)
    df.write.parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)
