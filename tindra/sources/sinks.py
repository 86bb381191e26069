"""Writers: full rebuilds, JSON and Markdown packs, append-only logs, metric snapshots."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def rebuild(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table anew as Parquet, which other engines read directly; one writer a table, no driver copies."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def append_log(spark: SparkSession, folder: str, action: str, **fields) -> None:
    """Append one record; logging never breaks the work it describes."""
    try:
        row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit(action).alias("action"), *[F.lit(v).alias(k) for k, v in fields.items()])
        row.coalesce(1).write.mode("append").json(folder)
    except Exception:
        LOG.exception("the activity log couldn't be written")


def snapshot(metrics: DataFrame, folder: str, run: str) -> None:
    """(metric, value) of one run, in a partition of its own that a repeated run overwrites."""
    metrics.select("metric", F.col("value").cast("double")).write.mode("overwrite").parquet(f"{folder}/run={run}")


def previous(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """The metrics of the latest run before this one; no rows without one."""
    from .tables import exists

    if not exists(spark, f"{folder}/run=*"):
        return spark.createDataFrame([], "metric string, value double")
    df = spark.read.schema("metric string,value double,run string").parquet(folder).filter(F.col("run") < run)
    last = df.agg(F.max("run")).first()[0]
    return df.filter(F.col("run") == last).select("metric", "value")


def markdown(lines: DataFrame, path: str) -> None:
    """Ordered lines (ord, line) as one Markdown file."""
    lines.repartition(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(path)


def capped_csv(df: DataFrame, most: int = 100) -> str:
    """The first rows as CSV text, for a reader with little room; the cap is the feature."""
    return df.limit(most).toPandas().to_csv(index=False)
