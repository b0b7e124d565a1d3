"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters records: a seeded hash of the key gives the shard (rendezvous: the shard whose hash with the key is
largest, so one more shard takes rows only into itself), and a second hash spreads a shard over as many buckets
as keep each near ``bucket_bytes``. The scattered records are written to the shared folder. Pass 2 reads a bucket
into memory, brings it into a defined order and shuffles it by Fisher and Yates: Spark's shuffle() of an array is
that algorithm. A slot is the number of records in the buckets before, plus the place in the bucket.

Defined results: the law is ``key``. A null key is a key like any other; a null text has no bytes. Rows with equal
keys, repeated ones included, share a shard, and are spread over its buckets by their position in the input, so that
a key with a third of the rows fills no bucket beyond the others. Input columns called like results are replaced, all
others are kept, whatever they are called. An empty table gives no rows. The same session, input layout and seed give
the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.llm.shared import drop, fresh, partitions, written

OVERHEAD = 8
RESULTS = ("size", "shard", "slot", "grown_shard")
#: What the tasks of pass 2 read at most, about.
TASK_BYTES = 64 << 20


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is largest; ties go to the larger number."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed + i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)])["i"]


def scattered(df: DataFrame, key: str, text: str, shards: int, seed: int, bucket_bytes: int) -> tuple[DataFrame, list[str], int]:
    """Pass 1: df with size, shard, grown_shard and columns for bucket and place, written; the names of the last two,
    and the bytes of all records."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, round(total / shards / bucket_bytes))
    bucket, at = fresh(df, "__bucket"), fresh(df, "__at")
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in RESULTS], size.alias("size"), F.monotonically_increasing_id().alias(at))
    base = base.withColumn("shard", rendezvous(F.col(key), shards, seed)).withColumn("grown_shard", rendezvous(F.col(key), shards + 1, seed))
    base = base.withColumn(bucket, F.pmod(F.xxhash64(F.lit(~seed), F.col(key), at), F.lit(buckets)).cast("int"))
    return written(base), [bucket, at], total


def sharded(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 7, bucket_bytes: int = 4 << 20) -> DataFrame:
    """df with size, shard, slot (gapless from 0 in each shard) and grown_shard."""
    table, (bucket, at), total = scattered(df, key, text, shards, seed, bucket_bytes)
    keep = [c for c in table.columns if c not in ("shard", bucket, at)]
    rows, place, offset = (fresh(table, name) for name in ("__rows", "__place", "__offset"))
    counts = table.groupBy("shard", bucket).count()
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    # the place comes first, and is unique: comparing records ends there
    record = F.struct(F.col(at).alias("at"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    ordered = F.array_sort(F.collect_list(record), lambda a, b: F.sign(a["at"] - b["at"]).cast("int"))
    # a task holds the buckets of one partition at most
    parts = partitions(df.sparkSession, total, TASK_BYTES)
    filled = table.repartition(parts, "shard", bucket).groupBy("shard", bucket).agg(ordered.alias(rows))
    # buckets in a defined order within a partition: the state of the random numbers goes from one to the next
    mixed = filled.sortWithinPartitions("shard", bucket).select("shard", bucket, F.shuffle(rows, F.lit(seed)).alias(rows))
    placed = mixed.select("shard", bucket, F.posexplode(rows).alias(place, rows))
    joined = placed.join(offsets, ["shard", bucket])
    slot = (F.col(offset) + F.col(place)).cast("long").alias("slot")
    return joined.select(*[F.col(rows)["row"][c].alias(c) for c in keep], "shard", slot)


def write_shards(df: DataFrame, path: str, file_bytes: int = 128 << 20, **parameters) -> None:
    """Writes shards as folders shard=N, each of files of about file_bytes that hold consecutive slots in their order."""
    placed = written(sharded(df, **parameters))
    total = placed.agg(F.sum("size")).first()[0] or 0
    files = partitions(df.sparkSession, total, file_bytes)
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop(placed)
