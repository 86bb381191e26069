"""From raw documents to packed sequences: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents, so their order could be changed. Rows with a null doc_id are kept by the near-duplicate stage, which can't tell
them apart; rows that repeat a doc_id are one document there, and where it stays each of its texts stays once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.llm import packing, pii, quality, sigtree
from tindra.llm.common import mark, materialize, maybe_among, sweep, table

#: No SQL: boosted trees, similarity components and best fit are beyond it. tests/llm holds it against plain versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored like others; repeated rows have one
    score; scores at the threshold stay; very long texts are scored whole; an empty table stays empty."""
    return quality.with_score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group that the Jaccard join links. Null and empty texts link with nothing and
    stay; very long texts are compared whole; an empty table stays empty."""
    joined = sigtree.join(spark, docs)
    id_, head, flag = (f"{'_' * max(map(len, docs.columns))}_{x}" for x in ("id", "head", "flag"))  # longer than any column's name
    # ids that need care: those that go, and those that several rows share
    care = joined.filter("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias(flag), F.max(F.col("doc_id") == F.col("component_id")).alias(head))
    care = materialize(spark, care.filter((F.col(flag) > 1) | ~F.col(head)).drop(flag), "care")
    # most rows need none, which a bitmap of fixed size tells; only the rest is shuffled to be joined by id
    marked = maybe_among(docs.withColumn(id_, F.col("doc_id").cast("long")), care, id_, flag)
    sure = marked.filter(~F.col(flag)).select(*docs.columns)
    asked = marked.filter(flag).join(care, id_, "left")
    out = sure.unionByName(asked.filter(F.col(head).isNull()).select(*docs.columns))
    if not care.filter(head).isEmpty():
        out = out.unionByName(asked.filter(head).dropDuplicates([id_, "text"]).select(*docs.columns))
    return out


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal spans replaced by their kind; n_chars follows the new text where there is such a column. A null text
    stays null; repeated rows are redacted alike; very long texts are scanned whole; an empty table stays empty."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequence, its capacity, and the place in it. Null and empty texts have a row in no
    sequence; repeated rows are packed each; very long texts are several pieces; an empty table gives no rows."""
    return packing.pack(spark, docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
        sweep(spark, start, docs)  # what the stage and its input needed
    return STAGES[-1][1](spark, docs, sf_dir)
