"""Health of jobs from their state tables; probes and their extrapolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.operators.accounts import median_of

# Seconds, shares and gigabytes beyond which a job is in trouble.
STALE_SECONDS, ERROR_SHARE, LOW_DISK_GB, RATE_LIMIT_SHARE, DUPLICATE_SHARE = 900, 0.10, 5.0, 0.05, 0.50


def status(finished: Column, started: Column, age: Column, delta: Column, collected: Column, errors: Column, rate_limits: Column, duplicates: Column, headroom: Column, free_gb: Column) -> Column:
    """FINISHED, NOT STARTED, STALLED, WARNING or HEALTHY. delta: documents since the last check, null at the first."""
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), collected), F.lit(0.0))
    stalled = (age > STALE_SECONDS) | (F.coalesce(delta == 0, F.lit(False)) & (age < STALE_SECONDS)) | (share(errors) > ERROR_SHARE) | (free_gb < LOW_DISK_GB)
    warned = (share(rate_limits) > RATE_LIMIT_SHARE) | F.coalesce(duplicates > DUPLICATE_SHARE, F.lit(False)) | (headroom < 0)
    return F.when(finished, "FINISHED").when(~started, "NOT STARTED").when(stalled, "STALLED").when(warned, "WARNING").otherwise("HEALTHY")


def deltas(snapshots: DataFrame, job: str, at: str, documents: str) -> DataFrame:
    """snapshots with delta and per_minute since the one before; the rate only over more than a minute."""
    order = Window.partitionBy(job).orderBy(at)
    seconds = F.unix_seconds(at) - F.unix_seconds(F.lag(at).over(order))
    delta = F.col(documents) - F.lag(documents).over(order)
    return snapshots.withColumn("delta", delta).withColumn("per_minute", F.when(seconds > 60, delta / (seconds / 60)))


def text_layer(http: Column, parsed: Column, files: Column) -> Column:
    """What a metadata record says about a text layer. files: array of struct of name and format, may be null."""
    has = F.exists(files, lambda f: F.coalesce((f["format"] == "DjVuTXT") | F.endswith(f["name"], F.lit("_djvu.txt")), F.lit(False)))
    return F.when(http.isNull(), "request_failed").when(http != 200, F.concat(F.lit("http_"), http.cast("string"))).when(~parsed, "json_parse_failed").when(F.coalesce(F.size(files), F.lit(0)) <= 0, "no_files_listed").when(has, "HAS_TEXT_LAYER").otherwise("genuinely_no_text_layer")


def extrapolated(probes: DataFrame, population: int, words: str = "n_words", accepted: str = "accepted") -> DataFrame:
    """Share accepted, mean and upper median of accepted words, and what they make over a population."""
    ok = probes.where(F.col(accepted))
    middle = median_of(ok.groupBy(words).agg(F.count("*").alias("n")), words).select(F.col("median").alias("median_words"))
    sums = probes.agg(F.count("*").alias("probes"), F.count_if(accepted).alias("accepted"), F.avg(F.when(F.col(accepted), F.col(words))).alias("mean"))
    share = F.col("accepted") / F.col("probes")
    both = sums.join(F.broadcast(middle))
    return both.select("probes", "accepted", F.round(share, 4).alias("accept_share"), F.floor("mean").cast("long").alias("mean_words"), "median_words", F.floor(population * share * F.col("mean")).cast("long").alias("words_by_mean"), F.floor(population * share * F.col("median_words")).cast("long").alias("words_by_median"))
