"""Registry of queries: each has a name, a DataFrame builder over an input folder and, where SQL can express it, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a builder under its own name; sql is its DuckDB equivalent."""

    def add(f):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _ORACLE[key] = sql
        return f

    return add


@query("SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS awards, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def funding_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice is not null")
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("awards"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
