"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, kdtree, licenses, mixing, packing, pii, quality, rpforest, sigtree, urls, vamana, wand
from .common import table

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), bpe.read_vocabulary(public_tokenizers.path(tokenizer)), public_tokenizers.PATTERN)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.probe(table(spark, sf_dir, "conversations"))))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.search(spark, table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.join(spark, table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spark, table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark, table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.cluster(spark, table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.rank(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = [op1_license_scan, op2_embedding_near_dedup, op3_byte_bpe, op4_chat_format, op5_nearest_neighbours, op6_jaccard_join, op7_quality, op8_url_filter, op9_pii, op10_best_fit_packing, op11_source_mixing, op12_centroid_clustering, op13_ranked_search]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op4_chat_format": chat.oracle(), "op6_jaccard_join": sigtree.oracle(), "op8_url_filter": urls.oracle(), "op11_source_mixing": mixing.oracle(), "op12_centroid_clustering": kdtree.oracle(), "op13_ranked_search": wand.oracle()}
