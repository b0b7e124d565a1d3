"""Jobs over streams: gates, exact and near copies, packs that go on over batches; each batch can be run again.

What a job has done is a table in the shared folder, a part for each batch. A batch that is run again, after a lost
driver, writes its own part anew and looks only at the parts before it, so the result is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcorpus.functions.text import exact_hash, n_words, words
from weftcorpus.operators import near, segment
from weftcorpus.session import cut, shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/job-{name}-{uuid.uuid4().hex}"


def part(at: str, batch: int) -> str:
    return f"{at}/batch={batch:08d}"


def earlier(spark: SparkSession, at: str, schema: T.StructType, batch: int) -> DataFrame:
    """The rows of the parts before a batch; none if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [p for i in range(batch) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p := part(at, i)))]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def finished(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    """All parts of a job's table."""
    return spark.read.schema(schema).parquet(f"{at}/batch=*")


def drain(df: DataFrame, at: str, step: Callable[[DataFrame, int], None], progress: str) -> None:
    """Runs step on every batch that is there, and remembers in progress which are done."""
    def run(rows: DataFrame, batch: int) -> None:
        step(rows, batch)

    df.writeStream.foreachBatch(run).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


class Ingest:
    """Documents of a stream to decisions (key, reason, n_words) and, of what is accepted, a manifest.

    reason is the gate's, or exact_duplicate or near_duplicate of an accepted document before it: in an earlier batch,
    or in this one by the order of the key. threshold None leaves near copies alone.
    """

    def __init__(self, spark: SparkSession, key: str, text: str, gate: Callable[[DataFrame], Column], key_type: T.DataType, threshold: float | None = near.THRESHOLD, at: str | None = None):
        self.spark, self.key, self.text, self.gate, self.threshold = spark, key, text, gate, threshold
        self.at = at or folder(spark, "ingest")
        self.decisions = T.StructType([T.StructField(key, key_type), T.StructField("reason", T.StringType()), T.StructField("n_words", T.LongType())])
        self.index = T.StructType([T.StructField("id", key_type), T.StructField("hash", T.StringType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])

    def step(self, rows: DataFrame, batch: int) -> None:
        spark, key = self.spark, self.key
        docs = rows.withColumn("__why", self.gate(rows)).select(F.col(key).alias("id"), F.col(self.text).alias("text"), "__why", n_words(F.col(self.text)).alias("n_words"), exact_hash(F.col(self.text)).alias("hash"))
        docs = cut(docs)
        known = earlier(spark, f"{self.at}/index", self.index, batch)
        open_ = docs.where("__why is null").join(known.select("hash"), "hash", "left_anti")
        first = cut(open_.groupBy("hash").agg(F.min("id").alias("id")))
        fresh = open_.join(first, ["hash", "id"], "left_semi").dropDuplicates(["hash", "id"])
        if self.threshold is None:
            signed = cut(fresh.select("id", "hash", F.lit(None).cast("array<int>").alias("signature")))
            near_copies = signed.limit(0).select("id")
        else:
            signed = cut(fresh.select("id", "hash", near.minhash(F.col("text")).alias("signature")))
            before = near.matches(signed.select("id", "signature"), known.select("id", "signature"), self.threshold).select("id").distinct()
            rest = signed.join(before, "id", "left_anti")
            among = near.greedy(rest.select("id", F.col("id").alias("ord"), "signature"), self.threshold).where("keeper is not null").select("id")
            near_copies = cut(before.unionByName(among))
        kept = signed.join(near_copies, "id", "left_anti")
        kept.write.mode("overwrite").parquet(part(f"{self.at}/index", batch))
        flags = signed.select("id", F.lit(True).alias("__first")).join(near_copies.withColumn("__near", F.lit(True)), "id", "left")
        reason = F.coalesce("__why", F.when(F.col("__first").isNull(), "exact_duplicate").when(F.col("__near"), "near_duplicate"))
        decided = docs.join(flags, "id", "left").select(F.col("id").alias(key), reason.alias("reason"), "n_words")
        decided.write.mode("overwrite").parquet(part(f"{self.at}/decisions", batch))

    def run(self, stream: DataFrame) -> DataFrame:
        """Goes on from where the job stands, and gives the decisions on all documents so far."""
        drain(stream, self.at, self.step, f"{self.at}/progress")
        return finished(self.spark, f"{self.at}/decisions", self.decisions)


class Packer:
    """Units of a stream to packs of at least target words by group; a pack that a batch leaves open goes on in the next.

    The units of open packs are kept as they are, so that a pack is the same wherever batches end. finish() gives the
    closed packs and those that are still open at the end.
    """

    def __init__(self, spark: SparkSession, group: str, order: str, text: str, group_type: T.DataType, order_type: T.DataType, target: int = segment.PACK_WORDS, at: str | None = None):
        self.spark, self.group, self.order, self.text, self.target = spark, group, order, text, target
        self.at = at or folder(spark, "packs")
        self.units = T.StructType([T.StructField("g", group_type), T.StructField("o", order_type), T.StructField("t", T.StringType()), T.StructField("done", T.LongType())])
        self.packs = T.StructType([T.StructField("g", group_type), T.StructField("pack", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("units", T.LongType())])

    def step(self, rows: DataFrame, batch: int) -> None:
        spark = self.spark
        open_ = spark.read.schema(self.units).parquet(part(f"{self.at}/open", batch - 1)) if batch else spark.createDataFrame([], self.units)
        new = rows.select(F.col(self.group).alias("g"), F.col(self.order).alias("o"), F.col(self.text).alias("t")).where(F.size(words(F.col("t"))) > 0)
        done = open_.groupBy("g").agg(F.max("done").alias("done"))
        units = cut(open_.where("t is not null").select("g", "o", "t").unionByName(new))
        made = cut(segment.packed(units, "g", "o", "t", self.target))
        closed = made.join(done, "g", "left").withColumn("pack", F.col("pack") + F.coalesce("done", F.lit(0))).where(F.col("n_words") >= self.target)
        closed.select("g", "pack", "text", "n_words", "units").write.mode("overwrite").parquet(part(f"{self.at}/closed", batch))
        # of each group the units after its last closed pack, and how many packs it has closed so far
        used = made.where(F.col("n_words") >= self.target).groupBy("g").agg(F.sum("units").alias("used"), F.count("*").alias("packs"))
        place = F.row_number().over(segment.Window.partitionBy("g").orderBy("o"))
        rest = units.withColumn("k", place).join(used, "g", "left").where(F.col("k") > F.coalesce("used", F.lit(0)))
        total = used.select("g", "packs").join(done, "g", "full").select("g", (F.coalesce("packs", F.lit(0)) + F.coalesce("done", F.lit(0))).alias("done"))
        left = rest.select("g", "o", "t").join(total, "g", "full").select("g", "o", "t", F.coalesce("done", F.lit(0)).cast("long").alias("done"))
        left.write.mode("overwrite").parquet(part(f"{self.at}/open", batch))
        self.last = batch

    def run(self, stream: DataFrame) -> DataFrame:
        drain(stream, self.at, self.step, f"{self.at}/progress")
        return self.finish()

    def finish(self) -> DataFrame:
        """g, pack, text, n_words, units of all packs, also those that never got the target."""
        open_ = self.spark.read.schema(self.units).parquet(part(f"{self.at}/open", self.last))
        tail = segment.packed(open_.where("t is not null"), "g", "o", "t", self.target)
        done = open_.groupBy("g").agg(F.max("done").alias("done"))
        tail = tail.join(done, "g").select("g", F.col("done").alias("pack"), "text", "n_words", "units")
        return finished(self.spark, f"{self.at}/closed", self.packs).unionByName(tail)


#: Bytes of input for each file of a batch, which a task reads as a whole.
FILE = 16 << 20


def files_of(df: DataFrame, batches: int) -> int:
    """How many files each of so many batches of df has, by the size of its input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-size // (batches * FILE)))


def in_file_list(spark: SparkSession, at: str) -> set[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(path) if f.getPath().getName().startswith("part-")} if files.exists(path) else set()


def append(df: DataFrame, at: str, files: int) -> None:
    """Writes df to a folder in exactly so many files, empty ones if need be: a stream of so many files a batch takes them
    as one batch, and the files of the next call as another."""
    spark = df.sparkSession
    aim = len(in_file_list(spark, at)) + files
    (df.repartition(files) if files > 1 else df.coalesce(1)).write.mode("append").parquet(at)
    for _ in range(aim - len(in_file_list(spark, at))):
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(at)


def in_files(df: DataFrame, order: str, bounds: list, name: str, files: int = 1) -> str:
    """A folder with df in batches of so many files that are written one after the other, cut at the bounds of an order."""
    at = folder(df.sparkSession, name)
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:], strict=False):
        some = df.where((F.lit(True) if low is None else F.col(order) >= F.lit(low)) & (F.lit(True) if high is None else F.col(order) < F.lit(high)))
        append(some, at, files)
    return at
