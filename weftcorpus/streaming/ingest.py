"""Incremental ingestion: what is seen is state, progress is the checkpoint, rejected documents keep their reason."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftcorpus.functions.text import exact_hash, n_words
from weftcorpus.session import shared_dir


def stream(spark: SparkSession, path: str, schema: StructType, files: int = 8) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream. A pattern is given, as a plain path would have to be a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into a table of the shared folder, and reads that."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/table")


def exact_dedup(df: DataFrame, text: str = "text") -> DataFrame:
    """One document for each canonical hash. The state has no limit in time: a copy can come at any later time."""
    return df.withColumn("hash", exact_hash(F.col(text))).dropDuplicates(["hash"])


def gated(df: DataFrame, text: str = "text", least: int = 40) -> DataFrame:
    """Documents with a reason, null if accepted."""
    return df.withColumn("n_words", n_words(F.col(text))).withColumn("reason", F.when(F.col("n_words") < least, "too_short"))


def windowed(df: DataFrame, at: str, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by window of event time; what comes later than the delay is dropped."""
    return df.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), "event_type").agg(F.count("*").alias("n"))
