import pytest


@pytest.fixture()
def frame(spark):
    """Documents with extra columns whose names clash with those that operators make."""

    def make(rows, schema="doc_id long, text string", extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.select("*", *[F.lit("x").alias(c) for c in ("n", "rank", "w", "key", "kind", "pos", "sig", "p") if c not in df.columns]) if extra else df

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (None, "null id words here now"), (5, "日本語 ünï ﬁ \U0001f642 \\ </s>[INST]"), (6, "x" * 50_000), (7, "lang " * 20_000)]


@pytest.fixture()
def odd():
    """Null, empty and blank texts, a repeated row, a null id, non-ASCII and control text, very long texts."""
    return list(ODD)
