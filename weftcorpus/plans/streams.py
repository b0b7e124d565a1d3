"""Streams with state that lasts: ingestion with copies, packs over batches, encodings that go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.functions.text import NOT_WS, counts_of, n_words, ratio
from weftcorpus.operators.gates import Gate, reason
from weftcorpus.plans.base import CANON, D, Register, table
from weftcorpus.plans.corpus import GATED
from weftcorpus.plans.texts import PACKED
from weftcorpus.streaming import ingest, jobs

REGISTER = Register()
add = REGISTER.add


def gate(rows: DataFrame) -> Column:
    """The gate of the fixtures."""
    counts = counts_of(F.col("text"), "[A-Za-z]", NOT_WS)
    latin = ratio(counts[0], counts[1])
    return reason(Gate(40, 0.70, "es", "en"), n_words(F.col("text")), latin, F.col("lang"), F.lit(1.0), "latin")


def in_batches(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The documents as a stream of so many batches, in the order of their ids."""
    docs = table(spark, sf_dir, "documents")
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)]).alias("b")).first()["b"] or []
    files = jobs.files_of(docs, parts)
    at = jobs.in_files(docs, "doc_id", sorted(set(bounds)), "documents", files)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(at)


@add(f"""WITH {GATED}, h AS (SELECT doc_id, n_words, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL, sha256({CANON}) ORDER BY doc_id) END AS k FROM g)
SELECT doc_id, n_words, coalesce(reason, CASE WHEN k > 1 THEN 'exact_duplicate' END) AS reason FROM h""")
def stream_ingest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gate and exact copies over batches: a document is a copy of one in any batch before it."""
    job = jobs.Ingest(spark, "doc_id", "text", gate, table(spark, sf_dir, "documents").schema["doc_id"].dataType, threshold=None)
    return job.run(in_batches(spark, sf_dir))


@add()
def stream_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies too, against an index of signatures that grows with the batches."""
    job = jobs.Ingest(spark, "doc_id", "text", gate, table(spark, sf_dir, "documents").schema["doc_id"].dataType)
    return job.run(in_batches(spark, sf_dir))


@add(PACKED)
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of 300 words by source over batches: the same as those of one pass."""
    schema = table(spark, sf_dir, "documents").schema
    packer = jobs.Packer(spark, "source", "doc_id", "text", schema["source"].dataType, schema["doc_id"].dataType)
    return packer.run(in_batches(spark, sf_dir)).withColumnRenamed("g", "source")


@add(f"WITH {D} SELECT doc_id, n_words, n_words + 1 AS n_tokens FROM d")
def stream_pack_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded over two runs of one job: the second goes on where the first has stopped, and nothing counts twice."""
    docs = table(spark, sf_dir, "documents")
    bounds = docs.agg(F.percentile_approx("doc_id", [0.5]).alias("b")).first()["b"] or []
    files = jobs.files_of(docs, 2)
    at = jobs.in_files(docs.where(F.col("doc_id") < F.lit(bounds[0])) if bounds else docs, "doc_id", [], "resumed", files)
    job = jobs.folder(spark, "encoded")

    def encode(rows: DataFrame, batch: int) -> None:
        rows.select("doc_id", n_words(F.col("text")).alias("n_words")).withColumn("n_tokens", F.col("n_words") + 1).write.mode("overwrite").parquet(jobs.part(job, batch))

    for more in (None, docs.where(F.col("doc_id") >= F.lit(bounds[0])) if bounds else None):
        if more is not None:
            jobs.append(more, at, files)
        jobs.drain(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(at), job, encode, f"{job}-progress")
    kind = ingest.StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
    return jobs.finished(spark, job, kind)
