"""Corpus pipeline: documents → encoded training corpus.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; a stage's
result is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signals.llm import bpe, language, minhash, mixing, toxicity
from signals.llm.common import table, written

LEAST_LANGUAGE_SCORE = language.LEAST_FITTING  # below it, no learned language fits: such texts have score 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the model predicts to be toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or that no learned language fits, go. If there is nothing to learn
    from, no document is judged, and all that hold a letter stay."""
    model = language.fit(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    judged = language.identify(docs, model)
    keep = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(keep).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near copies the document with the smallest id stays."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are repeated or left out so that sources reach their target weights, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the columns of documents, token_ids, and whether decoding them gives the text's bytes."""
    return bpe.round_trips(docs, *bpe.default_vocabulary()).select(*docs.columns, "token_ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("near_dedup", drop_near_copies),
          ("mix_sources", mix_sources), ("byte_bpe", encode)]
ORACLE_SQL = None  # fitted models and MinHash: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
