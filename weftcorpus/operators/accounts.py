"""Accounts over manifests, jobs, runs and analyses: histograms, plans, deltas, checks of sets, extrapolations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.functions.text import count_of, ratio
from weftcorpus.operators.provenance import MANUAL_FLOOR


# ----------------------------------------------------------------------------------------------------- manifests
def manifest_profile(df: DataFrame, sample: int | None = None, order: str | None = None) -> DataFrame:
    """kind (script or language), value, n, mean_score: an empty label gives way to the language, missing values are
    unknown. sample takes the first rows of an order, as a look at a large manifest does."""
    rows = df.orderBy(order).limit(sample) if sample and order else df
    script = F.coalesce("script", F.lit("unknown"))
    language = F.coalesce(F.nullif("langid_label", F.lit("")), "language", F.lit("unknown"))
    each = rows.select(F.explode(F.array(F.struct(F.lit("script").alias("kind"), script.alias("value")), F.struct(F.lit("language").alias("kind"), language.alias("value")))).alias("x"), "langid_score")
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.avg("langid_score").alias("mean_score"))


def list_or_one(json: Column) -> Column:
    """array<string> of a JSON value that is a list or a single value; empty for null."""
    listed = F.from_json(json, "array<string>")
    one = F.regexp_replace(json, '^"(.*)"$', "$1")
    return F.when(json.isNull() | (json == "null"), F.array().cast("array<string>")).when(F.startswith(F.ltrim(json), F.lit("[")), listed).otherwise(F.array(one))


def top_values(df: DataFrame, values: Column, k: int = 40) -> DataFrame:
    """value, n of the k most common values of arrays; ties by value."""
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def top_by_group(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """group, value, n, rank: the k most common values of each group; counted before they are ranked."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def jobs_with_manifests(checkpoints: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each checkpoint (job_name, ...) with the rows and words of the manifest of its name; none is 0."""
    sums = manifests.groupBy(F.col("source_name").alias("job_name")).agg(F.count("*").alias("manifest_rows"), F.sum("words").alias("manifest_words"))
    joined = checkpoints.join(sums, "job_name", "left")
    return joined.withColumn("manifest_rows", F.coalesce("manifest_rows", F.lit(0))).withColumn("manifest_words", F.coalesce("manifest_words", F.lit(0)))


def baseline(df: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """df with what the baseline (key, value) has, the ratio to it and the lift over it; null without one."""
    joined = df.join(base.select(key, F.col(value).alias("baseline")), key, "left")
    return joined.withColumn("ratio", F.try_divide(F.col(value), F.col("baseline"))).withColumn("lift", F.col(value) - F.col("baseline"))


def deltas(df: DataFrame, key: list[str], run: str, value: str, after: str, before: str) -> DataFrame:
    """key, after, before, delta of two runs; a key that one lacks has no delta."""
    of = lambda name: F.max(F.when(F.col(run) == name, F.col(value)))
    both = df.groupBy(*key).agg(of(after).alias("after"), of(before).alias("before"))
    return both.withColumn("delta", F.col("after") - F.col("before"))


# --------------------------------------------------------------------------------------------------------- plans
def collection_plan(sums: DataFrame, manual_target: int, total_target: int) -> DataFrame:
    """What is left to collect, from one row: manual_tokens, downloaded_tokens, manual_fertility, downloaded_fertility.

    Downloaded tokens are admitted up to their own target, and up to what keeps the manual share at its floor.
    """
    manual, downloaded = F.col("manual_tokens"), F.col("downloaded_tokens")
    gap = F.greatest(manual_target - manual, F.lit(0))
    target = F.greatest(total_target - F.greatest(manual, F.lit(manual_target)), F.lit(0))
    missing = F.greatest(target - downloaded, F.lit(0))
    most = manual / F.lit(MANUAL_FLOOR) - manual
    admissible = F.least(missing, F.greatest(most - downloaded, F.lit(0)))
    whole = lambda c: F.floor(c).cast("long")
    return sums.select(
        whole(gap).alias("manual_gap_tokens"), whole(F.try_divide(gap, F.col("manual_fertility"))).alias("manual_gap_words"), whole(target).alias("downloaded_target_tokens"), whole(missing).alias("downloaded_gap_tokens"),
        whole(F.try_divide(missing, F.col("downloaded_fertility"))).alias("downloaded_gap_words"), whole(most).alias("downloaded_most_tokens"), whole(admissible).alias("admissible_tokens"),
        whole(F.try_divide(admissible, F.col("downloaded_fertility"))).alias("admissible_words"), whole(manual + downloaded + admissible).alias("projected_tokens"),
    )


def recheck_estimate(verdicts: DataFrame, population: int, words_each: float) -> DataFrame:
    """checked, recoverable, share, items and words that a population would give, from a verdict for each item checked."""
    sums = verdicts.agg(F.count("*").alias("checked"), F.count_if(F.col("verdict") == "HAS_TEXT_LAYER").alias("recoverable"))
    share = ratio(F.col("recoverable"), F.col("checked"))
    return sums.select("checked", "recoverable", F.round(share, 6).alias("share"), F.floor(share * population).cast("long").alias("items"), F.floor(share * population * F.lit(words_each)).cast("long").alias("words"))


# --------------------------------------------------------------------------------------------- checks of item sets
def language_check(items: DataFrame, expected: str) -> DataFrame:
    """items (id, label, score) in a row: how many have each label, the mean score, and how many another language."""
    wrong = ~F.col("label").isin(expected, "undecided")
    return items.agg(
        F.lit(expected).alias("expected"), F.count_if(F.col("label") == expected).alias("as_expected"), F.count_if(F.col("label") == "undecided").alias("undecided"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.count_if(wrong).alias("misassigned"), F.slice(F.array_sort(F.collect_list(F.when(wrong, F.col("id")))), 1, 5).alias("misassigned_examples"),
    )


def median_of(counts: DataFrame, value: str) -> DataFrame:
    """The upper median (of n values in order that at n // 2) from a table of values and their counts n.

    Values are as many as there are unlike lengths, so their running sum is small work whatever the corpus.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("__s", F.sum("n").over(order)).withColumn("__t", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return running.where(F.col("__s") > F.floor(F.col("__t") / 2)).agg(F.min(value).alias("median"))


def token_check(rows: DataFrame) -> DataFrame:
    """rows (n_tokens, n_bytes): least, median, most and mean tokens, and the share that fell back to bytes."""
    middle = median_of(rows.groupBy("n_tokens").agg(F.count("*").alias("n")), "n_tokens")
    sums = rows.agg(F.min("n_tokens").alias("tokens_min"), F.max("n_tokens").alias("tokens_max"), F.avg("n_tokens").alias("mean"), F.sum("n_bytes").alias("fallback"), F.sum("n_tokens").alias("total"))
    both = sums.join(F.broadcast(middle))  # one row each
    return both.select("tokens_min", F.col("median").alias("tokens_median"), "tokens_max", F.round("mean", 2).alias("tokens_mean"), F.col("fallback").alias("byte_fallback_tokens"), F.round(F.col("fallback") / F.greatest("total", F.lit(1)), 8).alias("byte_fallback_rate"))


def _tail(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if z is None else 0.5 * math.erfc(z / math.sqrt(2)) for z in batch.to_pylist()], pa.float64())


def one_tailed(z: Column) -> Column:
    """The chance of a value this high or higher; the engine has no erfc."""
    return arrow_udf(_tail, "double")(z)


def majority_floor(rows: DataFrame) -> DataFrame:
    """family, n, uniform, majority: hits that guessing alike, and always giving the most common gold, would make."""
    golds = rows.groupBy("family", "gold").agg(F.count("*").alias("c")).groupBy("family").agg(F.max("c").alias("majority"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.sum(1 / (F.col("n_entities") + 1)).alias("uniform")).join(golds, "family")


def zipped(items: DataFrame, generations: DataFrame, key: str) -> DataFrame:
    """items beside their generations by key; a key that either side lacks, or has twice, is an error."""
    both = items.join(generations, key, "full")
    odd = items.groupBy(key).agg(F.count("*").alias("a")).join(generations.groupBy(key).agg(F.count("*").alias("b")), key, "full").where("a is null or b is null or a > 1 or b > 1")
    if not odd.isEmpty():
        raise ValueError("items and generations are not one to one")
    return both


# -------------------------------------------------------------------------------------------------- small formats
def human_duration(seconds: Column) -> Column:
    """42s, 3m 7s, 5h 12m; a negative one is 0s."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def human_time(at: Column) -> Column:
    return F.when(at.isNull() | (F.unix_seconds(at) == 0), "never").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def page_url(title: Column, host: str) -> Column:
    """The address of a page by its title, spaces as underscores."""
    return F.concat(F.lit(f"https://{host}/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def script_percentages(c: Column) -> Column:
    """struct of percents of all characters by script, as older reports have them (white space counts)."""
    n = F.length(c)
    share = lambda pattern: F.round(100 * ratio(count_of(c, pattern), n), 4)
    return F.struct(share("[ऀ-ॿ]").alias("devanagari"), share("[A-Za-z]").alias("latin"), share("[ಀ-೿]").alias("kannada"))
