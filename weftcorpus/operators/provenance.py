"""Provenance: where a document comes from, and the accounts of manual, downloaded and synthetic words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcorpus.functions.text import ratio

# Ways of collection, the least share of manual words, and what a cap aims at.
COLLECTION_TYPES = ("manual_ocr", "manual_scrape", "manual_transcribed", "downloaded_dataset", "machine_translated")
MANUAL_FLOOR, CAP_TARGET = 0.20, 0.22


def is_manual(collection_type: Column) -> Column:
    return F.startswith(collection_type, F.lit("manual_"))


def bucket(collection_type: Column) -> Column:
    """Three buckets: synthetic before manual before downloaded."""
    return F.when(collection_type == "machine_translated", "synthetic").when(is_manual(collection_type), "manual").otherwise("downloaded")


def with_provenance(df: DataFrame, source: str = "source") -> DataFrame:
    """Collection type by the number at the end of the source: below 5 manual, from 17 on machine translated."""
    index = F.try_to_number(F.regexp_extract(source, "([0-9]+)$", 1), F.lit("999999999")).cast("int")
    kind = F.when(index < 5, "manual_scrape").when(index >= 17, "machine_translated").otherwise("downloaded_dataset")
    return df.withColumn("collection_type", kind).withColumn("is_manual", is_manual(F.col("collection_type"))).withColumn("bucket", bucket(F.col("collection_type")))


def path_provenance(path: Column) -> Column:
    """struct<source, is_manual> of a shard's path: its folder (that above, if it is a shard's), and 'manual' anywhere."""
    parts = F.split(path, "/")
    parent, above = F.element_at(parts, -2), F.element_at(parts, -3)
    return F.struct(F.when(F.startswith(parent, F.lit("shard")), above).otherwise(parent).alias("source"), F.array_contains(parts, "manual").alias("is_manual"))


def accounting(df: DataFrame, words: str = "n_words", chars: str = "n_chars") -> DataFrame:
    """Documents, words and characters overall and by source, in one pass; the overall row has scope 'total'."""
    def of(name: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bucket") == kind, F.col(words))), F.lit(0)).cast("long").alias(name)

    sums = df.groupingSets([[], ["source"]], "source").agg(
        F.grouping("source").alias("g"), F.count("*").alias("documents"), F.sum(words).cast("long").alias("words"), F.sum(chars).cast("long").alias("chars"),
        of("manual_words", "manual"), of("downloaded_words", "downloaded"), of("synthetic_words", "synthetic"),
    )
    return sums.withColumn("scope", F.when(F.col("g") == 1, "total").otherwise("source")).withColumn("manual_share", F.round(ratio(F.col("manual_words"), F.col("words")), 6)).drop("g")


def headroom(manual: Column, total: Column, floor: float = MANUAL_FLOOR) -> Column:
    """Words that may still be added without the manual share falling below the floor."""
    return (F.floor(manual / F.lit(floor)) - total).cast("long")
