"""Streaming over append-only logs and events: additive to the batch queries, with the same results on closed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import FLAGS

EVENTS = "event_id bigint,ts timestamp,user_id bigint,event_type string,value double,props string"


def event_stream(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Events with a watermark, which is set here once: all operators behind it share it."""
    return spark.readStream.schema(EVENTS).parquet(folder).withWatermark("ts", late)


def flag_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(FLAGS).json(folder)


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums per type and event-time window; on a stream a window's state goes once the watermark has passed."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def once_each(events: DataFrame) -> DataFrame:
    """Each event id once, with bounded state on a stream."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def write(df: DataFrame, folder: str, checkpoint: str):
    """Process what is there and stop; a later call goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
