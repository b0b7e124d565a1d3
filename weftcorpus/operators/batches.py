"""Batches for training and evaluation: random windows, length buckets, epochs, token budgets; schedules and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.operators.dedup import seeded

# The seed of windows, and of a run its batch, context, accumulation and tokens.
WINDOW_SEED, BATCH, CONTEXT, ACCUMULATION, TOKENS = 20260827, 32, 512, 8, 500_000_000


def uniform(key: Column, seed: int) -> Column:
    """A whole number of 48 bits made of a key, the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 12), 16, 10).cast("long")


def random_windows(spark: SparkSession, tokens: int, batches: int, skip: int = 0, batch: int = BATCH, context: int = CONTEXT, seed: int = WINDOW_SEED) -> DataFrame:
    """step, place, start: windows drawn with replacement; a run that goes on skips the steps it has done.

    Too few tokens for one window are an error.
    """
    if tokens < context + 1:
        raise ValueError("there are too few tokens for a window")
    n = F.col("id")
    drawn = spark.range(skip * batch, (skip + batches) * batch)
    return drawn.select(F.floor(n / batch).cast("long").alias("step"), (n % batch).cast("int").alias("place"), (uniform(n, seed) % max(1, tokens - context - 1)).alias("start"))


def length_batches(df: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """key, length, batch: prompts of one length together, in order of the key, at most so many in a batch."""
    order = Window.partitionBy(length).orderBy(key)
    return df.select(key, length, F.floor((F.row_number().over(order) - 1) / size).cast("int").alias("batch"))


def epoch_batches(df: DataFrame, key: str, epoch: int, size: int, seed: int, done: int = 0) -> DataFrame:
    """key, batch, place of an epoch in its own seeded order; batches before ``done`` are left out.

    The order goes by hashes. A range of hash values holds about as many rows as another, so rows are numbered range by
    range, from counts of the ranges, and no task sorts them all.
    """
    ranked = df.select(key, seeded(F.col(key), seed + epoch).alias("__o")).withColumn("__range", F.substring("__o", 1, 2))
    counts = ranked.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__base"))  # 256 rows
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__o", key)) - 1
    numbered = ranked.join(F.broadcast(base), "__range").withColumn("__n", F.col("__base") + inside)
    return numbered.select(key, F.floor(F.col("__n") / size).cast("long").alias("batch"), (F.col("__n") % size).cast("int").alias("place")).where(F.col("batch") >= done)


def run_size(batch: int = BATCH, context: int = CONTEXT, accumulation: int = ACCUMULATION, tokens: int = TOKENS) -> dict[str, int]:
    """Tokens of an optimizer step, and the whole steps that a budget of tokens makes."""
    step = batch * context * accumulation
    return {"tokens_per_step": step, "steps": tokens // step}


def within_tokens(df: DataFrame, offset: str, size: str, budget: int) -> DataFrame:
    """Documents until the stream has the budget: the one that reaches it is the last. df has its offsets."""
    return df.where(F.col(offset) < budget)


def answer_position(position: Column, piece: Column, n: Column, names: Column, values: Column, attribute: Column) -> Column:
    """What stands at a position of a prompt: the first rule that holds names it."""
    shown = piece != ""
    name = F.exists(names, lambda x: F.contains(x, piece))
    return (
        F.when(position == 0, "first_token").when(shown & name, "entity_names").when(shown & F.exists(values, lambda v: F.contains(v, piece)), "numeric_values")
        .when(shown & F.contains(attribute, piece), "attribute_word").when(position >= F.floor(n * F.lit(0.8)), "question_tail").otherwise("other")
    )


def position_shares(df: DataFrame, kind: str, weight: str, prompts: int) -> DataFrame:
    """kind, share: percent of the attention of so many prompts (each of which sums to 1)."""
    return df.groupBy(kind).agg(F.round(100.0 * F.sum(weight) / prompts, 2).alias("share"))


def band_probability(similarity: Column, bands: int, rows: int) -> Column:
    """The chance that two signatures of a similarity share a band."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(bands))


def continuations(ids: Column, starts: Column, prompt: int = 64, reference: int = 128) -> Column:
    """array<struct<start, prompt, reference>>: what is given, and what follows it, at each start that leaves room."""
    room = F.filter(starts, lambda s: s + prompt + reference <= F.size(ids))
    return F.transform(room, lambda s: F.struct(s.alias("start"), F.slice(ids, s + 1, F.lit(prompt)).alias("prompt"), F.slice(ids, s + prompt + 1, F.lit(reference)).alias("reference")))


def grid(results: DataFrame, row: list[str], column: str, value: str, columns: list[str]) -> DataFrame:
    """Results of many runs side by side: a row for each setting, a column for each of the given values."""
    return results.groupBy(*row).pivot(column, columns).agg(F.first(value))
