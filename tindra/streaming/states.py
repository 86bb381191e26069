"""Streams with state of their own: review decisions as they stand, and metric snapshots against the ones before.

Both keep what the batch answer needs and no more: a decision stream the latest decision of each pair, a metric stream the latest
value of each metric. The answer after any split of the input into micro-batches, restarts from the checkpoint included, is the
batch answer over the same rows: decisions may come in any order, snapshots of a metric come in theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "seq bigint, x bigint, y bigint, decision string"
SNAPSHOTS = "seq bigint, metric string, value double"
# Fixed value: the share of the value before from which a move counts.
MOVED = 0.10


def latest_decisions(rows: DataFrame) -> DataFrame:
    """The batch answer: (a, b, decision, n) of each pair, whichever way round it was noted: the decision of the largest seq, and
    how many were noted."""
    r = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "seq", "decision")
    return r.groupBy("a", "b").agg(F.max_by("decision", "seq").alias("decision"), F.count(F.lit(1)).alias("n"))


def moved_metrics(rows: DataFrame) -> DataFrame:
    """The batch answer: (seq, metric, before, value, status) of each snapshot: new, WARN for a fall and OK for a rise of a tenth
    or more, stable otherwise."""
    w = Window.partitionBy("metric").orderBy("seq")
    before = F.lag("value").over(w)
    first = F.row_number().over(w) == 1
    part = F.abs(F.col("value") - F.col("before")) / F.greatest(F.lit(1.0), F.col("before"))
    out = rows.withColumn("before", before).withColumn("first", first)
    far = (F.col("before") != 0) & (part >= MOVED)
    return out.select("seq", "metric", "before", "value", F.when(F.col("first"), "new").when(far & (F.col("value") < F.col("before")), "WARN").when(far, "OK").otherwise("stable").alias("status"))


class Decisions(StatefulProcessor):
    """The decision of the largest seq of a pair, in whatever order they come, and how many came; emits the pair's row whenever
    rows of it came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "seq bigint, decision string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        seq, decision, n = self.state.get() if self.state.exists() else (None, None, 0)
        for part in rows:
            n += len(part)
            top = part.loc[part["seq"].idxmax()]
            if seq is None or top["seq"] > seq:
                seq, decision = int(top["seq"]), top["decision"]
        self.state.update((seq, decision, n))
        yield pd.DataFrame({"a": [key[0]], "b": [key[1]], "decision": [decision], "n": [n]})

    def close(self) -> None:
        pass


class Snapshots(StatefulProcessor):
    """The latest value of a metric; emits every snapshot with the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        before = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            far = before is not None and before != 0 and abs(r.value - before) / max(1.0, before) >= MOVED
            status = "new" if before is None else ("WARN" if r.value < before else "OK") if far else "stable"
            out.append((r.seq, key[0], before, r.value, status))
            before = r.value
        self.state.update((float(before),))
        yield pd.DataFrame(out, columns=["seq", "metric", "before", "value", "status"])

    def close(self) -> None:
        pass


def decision_stream(rows: DataFrame) -> DataFrame:
    """A stream of decisions to a stream of (a, b, decision, n), in update mode: the last row of a pair holds."""
    r = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "seq", "decision")
    return r.groupBy("a", "b").transformWithStateInPandas(Decisions(), "a bigint, b bigint, decision string, n bigint", "Update", "None")


def metric_stream(rows: DataFrame) -> DataFrame:
    """A stream of snapshots, whose rows of a metric come in the order of seq, to a stream of their moves."""
    return rows.groupBy("metric").transformWithStateInPandas(Snapshots(), "seq bigint, metric string, before double, value double, status string", "Append", "None")


def drain(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, micro-batch by micro-batch, and stop; a later call goes on from the checkpoint. Each micro-batch is
    a folder of its own that a repeated one overwrites, so a restart doubles nothing."""

    def put(part: DataFrame, n: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def last_of(spark, folder: str) -> DataFrame:
    """The latest row of each pair that a drained decision stream has written."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("a", "b").agg(F.max_by(F.struct("decision", "n"), "batch").alias("r")).select("a", "b", "r.*")
