"""The registered queries of this package and their SQL; one query ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, embedding_dedup, hard_negatives, language, minhash, mixing, preference, quality, sharding, topk, toxicity, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mix": lambda spark, d: mixing.query(spark, table(spark, d, "documents")),
    "op2_toxic_spans": lambda spark, d: toxicity.query(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_quality_rules": lambda spark, d: quality.query(spark, table(spark, d, "documents")),
    "op4_byte_bpe": lambda spark, d: bpe.query(spark, table(spark, d, "documents")),
    "op5_minhash_dedup": lambda spark, d: minhash.query(spark, table(spark, d, "documents")),
    "op6_language_id": lambda spark, d: language.query(spark, table(spark, d, "documents")),
    "op7_shuffle_shards": lambda spark, d: sharding.query(spark, table(spark, d, "documents")),
    "op8_topk_search": lambda spark, d: topk.query(spark, table(spark, d, "embeddings")),
    "op8_topk_rows": lambda spark, d: topk.query_rows(spark, table(spark, d, "embeddings")),
    "op9_preference_format": lambda spark, d: preference.query(spark, table(spark, d, "conversations")),
    "op9_preference_replaced": lambda spark, d: preference.query_replaced(spark, table(spark, d, "conversations")),
    "op10_url_filter": lambda spark, d: urls.query(spark, table(spark, d, "pages")),
    "op11_hard_negatives": lambda spark, d: hard_negatives.query(spark, table(spark, d, "embeddings")),
    "op12_token_alignment": lambda spark, d: alignment.query(spark, table(spark, d, "documents")),
    "op13_embedding_dedup": lambda spark, d: embedding_dedup.query(spark, table(spark, d, "embeddings")),
}
ORACLES: dict[str, str] = {
    "op1_poisson_mix": mixing.SQL,
    "op3_quality_rules": quality.SQL,
    "op8_topk_search": topk.SQL,
    "op8_topk_rows": topk.SQL_ROWS,
    "op9_preference_format": preference.SQL,
    "op9_preference_replaced": preference.SQL_REPLACED,
    "op11_hard_negatives": hard_negatives.SQL,
}
