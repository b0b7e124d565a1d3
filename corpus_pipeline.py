"""A pipeline over documents: quality rules, near duplicates, shared passages, mixing, token ids.

Each stage reads what the one before it has written. All but the last keep the columns of documents, and any others that
there are, whatever they are called.

Defined results, for all stages: an empty table gives no rows. Repeated rows are judged alike. Texts are read whole.
Equal keys with unlike texts are judged each on its own text, but for near duplicates, where rows that share a key with
a dropped row go with it, and mixing, where rows of one key are kept or dropped together.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm import byte_bpe, jaccard_join, mixing, quality_rules, substring_dedup
from weftcorpus.llm.shared import fresh, written
from weftcorpus.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail the base rule and go."""
    verdict = fresh(docs, "__quality")
    return docs.withColumn(verdict, quality_rules.quality(F.col("text"))).where(f"{verdict}.kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Texts without words and rows without a
    key are in no group, and stay."""
    return jaccard_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat a passage of an earlier one; texts that lose none stay as they are, null
    ones too, and n_chars follows the text. Rows without a key lose nothing."""
    cut = substring_dedup.deduplicated(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that raking gives their cells; null sources and languages are categories."""
    return mixing.mixed(docs).where("kept").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text; null and empty texts have no tokens."""
    made = byte_bpe.digests(spark, F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", made.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def shipped(stage):
    """A stage that first sees to it that the executors have the package."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("token_ids", token_ids)]
STAGES = [(name, shipped(stage)) for name, stage in STAGES]

#: Token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
