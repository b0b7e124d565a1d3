"""Statistics of lengths, histograms, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.functions.text import DEVANAGARI, NOT_WS, count_of, lines, n_words


def lengths(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Least, median, mean, most and the values at place floor(n * q) of what is above 0."""
    some = df.where(F.col(value) > 0)
    place = Window.partitionBy(*keys).orderBy(value)
    some = some.withColumn("k", F.row_number().over(place)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))

    def at(q: float, name: str):
        return F.max(F.when(F.col("k") == F.floor(F.col("n") * q) + 1, F.col(value))).alias(name)

    return some.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.round(F.avg(value), 6).alias("mean"), at(0.5, "upper_median"), at(0.9, "p90"), at(0.95, "p95"), F.max(value).alias("most"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, and their share; the window runs over the counts, not over rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("documents"))
    return counts.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6))


def top(df: DataFrame, column: str, k: int, keys: list[str] | None = None) -> DataFrame:
    """The k most frequent values (for each of keys), with their ranks; ties in order of the value."""
    keys = keys or []
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    if not keys:
        counts = counts.orderBy(F.desc("n"), column).limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), column))).where(F.col("rank") <= k)


def audit(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines, characters, characters shown, words, Devanagari and Latin letters of all texts."""
    c = F.col(text)
    return df.agg(
        F.sum(F.size(lines(c))).alias("lines"), F.sum(F.length(c)).alias("chars"), F.sum(count_of(c, NOT_WS)).alias("shown"), F.sum(n_words(c)).alias("words"),
        F.sum(count_of(c, DEVANAGARI)).alias("devanagari"), F.sum(count_of(c, "[A-Za-z]")).alias("latin"),
    )
