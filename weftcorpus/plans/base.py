"""The register of queries, and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.functions.text import words
from weftcorpus.operators.provenance import with_provenance

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Queries by name, with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


#: From so many bytes on, a table whose files give fewer tasks than there are cores is dealt out among them.
WORTH_DEALING = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is a single row group, which a scan can't split, is dealt out to all cores before the work on it."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    told = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    small = WORTH_DEALING <= told.getLength() < 32 * WORTH_DEALING * cores
    return df.repartition(cores) if small and told.getFileCount() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with w (words), n_words, and the provenance that the fixtures lack."""
    docs = table(spark, sf_dir, "documents").withColumn("w", words(F.col("text")))
    return with_provenance(docs.withColumn("n_words", F.size("w").cast("long")))


W = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
CANON = "regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[0-9]+', '0', 'g')"
#: The documents with provenance, as documents() makes them.
D = f"""d AS (
  SELECT *, len(w)::BIGINT AS n_words, coalesce(i < 5, false) AS is_manual, CASE WHEN i < 5 THEN 'manual_scrape' WHEN i >= 17 THEN 'machine_translated' ELSE 'downloaded_dataset' END AS collection_type,
    CASE WHEN i < 5 THEN 'manual' WHEN i >= 17 THEN 'synthetic' ELSE 'downloaded' END AS bucket
  FROM (SELECT *, {W} AS w, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS i FROM documents))"""
