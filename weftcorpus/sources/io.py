"""Scans and sinks: shards of text, manifests, logs, vocabularies, packed tokens, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcorpus.functions.text import NORMALIZATION_STEPS, content_hash, n_words, trim_ws
from weftcorpus.operators.provenance import path_provenance
from weftcorpus.operators.segment import MARKER, segments

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "source_name", "source_url", "collection_method", "collection_type", "access_date", "language", "script", "langid_label", "content_hash", "notes")]
    + [T.StructField(n, T.LongType()) for n in ("raw_chars", "clean_chars", "words", "tokens")]
    + [T.StructField("is_manual", T.BooleanType()), T.StructField("langid_score", T.DoubleType()), T.StructField("devanagari_ratio", T.DoubleType()), T.StructField("preprocessing_applied", T.ArrayType(T.StringType()))]
)
TRAINING_LOG = "step long, tokens long, train_loss double, val_loss double, val_ppl double, lr double, grad_norm double, seconds double, tokens_per_sec long"
CHECKPOINT = "job_name string, cursor string, page long, collected long, skipped long, errors long, rate_limit_hits long, started_at double, updated_at double, finished boolean, extra map<string,string>"


@dataclass(frozen=True)
class Source:
    """A registered source: where it is, which column holds its text, and how it was collected."""

    name: str
    path: str
    column: str = "text"
    collection_type: str = "downloaded_dataset"
    format: str = "parquet"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


#: Registered sources by name.
REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    """Puts a source into the registry; a name that is taken is an error."""
    if source.name in REGISTRY:
        raise ValueError(f"source {source.name!r} is registered already")
    REGISTRY[source.name] = source
    return source


def registered(spark: SparkSession) -> DataFrame:
    """name, path, column, format, collection_type of all registered sources: a table to join accounts with."""
    rows = [(x.name, x.path, x.column, x.format, x.collection_type) for _, x in sorted(REGISTRY.items())]
    return spark.createDataFrame(rows, "name string, path string, column string, format string, collection_type string")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    matches = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return matches is not None and len(matches) > 0


def first_existing(spark: SparkSession, choices: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The first group of paths that all exist; none is an error."""
    for paths in choices:
        if all(exists(spark, p) for p in paths):
            return paths
    raise FileNotFoundError(f"none of {choices} is there")


def files(spark: SparkSession, root: str, pattern: str = "*", containing: str = "") -> DataFrame:
    """path, length of the files below a folder whose name fits and whose path contains a tag; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return found.where(F.contains("path", F.lit(containing)))


def shards(spark: SparkSession, root: str, pattern: str = "shard_*.txt", skip_unreadable: bool = False) -> DataFrame:
    """path, pos, text, source, is_manual: a document for each line that is not blank, with its place in its file.

    pos orders the lines of a file, and has gaps: a file is split among tasks at line ends, and a line's place is that of
    its split and its number there. Files that can't be read are errors after Spark's own attempts, or left out on demand.
    """
    options = {"ignoreCorruptFiles": True, "ignoreMissingFiles": True} if skip_unreadable else {}
    rows = spark.read.options(**options).text(root, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), trim_ws(F.col("value")).alias("text"))
    # a split begins with its own first row: numbers inside a task grow with the lines
    rows = rows.withColumn("pos", F.struct("start", "row")).where("text <> ''")
    return rows.withColumn("p", path_provenance(F.col("path"))).select("path", "pos", "text", "p.source", "p.is_manual")


def first_documents(df: DataFrame, n: int) -> DataFrame:
    """The first n in the order of files and lines."""
    return df.orderBy("path", "pos").limit(n)


def tokenizer_corpus(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """text of shards for a tokenizer, at most so many lines in their order; a corpus below a thousand lines is an error."""
    found = shards(spark, root)
    found = first_documents(found, most) if most else found
    if len(found.limit(1000).take(1000)) < 1000:
        raise ValueError("there are fewer than a thousand lines")
    return found.select("text")


def json_or_none(spark: SparkSession, path: str, schema: str) -> dict | None:
    """A small JSON document by its schema, or None where it is missing or broken."""
    if not exists(spark, path):
        return None
    row = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True).first()
    return None if row is None or row["_corrupt"] is not None else {k: v for k, v in row.asDict(recursive=True).items() if k != "_corrupt"}


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header, by a schema; empty cells are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", enforceSchema=False)


def inspected(df: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """A look at the first n rows without side effects: rows, blank ones, characters, words, the longest."""
    some = df.orderBy(order).limit(n).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    return some.agg(F.count("*").alias("rows"), F.count_if(trim_ws(F.col("t")) == "").alias("blank"), F.sum(F.length("t")).alias("chars"), F.sum(n_words(F.col("t"))).alias("words"), F.max(F.length("t")).alias("longest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines; blank, malformed and cut ones are left out; the source defaults to the file's name."""
    schema = T.StructType(MANIFEST.fields + [T.StructField("_corrupt", T.StringType())])
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("__f", F.col("_metadata.file_name"))
    good = read.where("_corrupt is null").drop("_corrupt")
    return good.withColumn("source_name", F.coalesce("source_name", F.regexp_replace("__f", r"\.jsonl$", ""))).drop("__f")


def records(df: DataFrame, text: Column, raw: Column, source: Column, collection_type: Column, access_date: str) -> DataFrame:
    """Manifest rows of documents; tokens stay null until a tokenizer counts them."""
    values = {
        "source_name": source, "collection_method": collection_type, "collection_type": collection_type, "access_date": F.lit(access_date), "raw_chars": F.length(raw).cast("long"), "clean_chars": F.length(text).cast("long"),
        "words": n_words(text), "tokens": F.lit(None).cast("long"), "is_manual": F.startswith(collection_type, F.lit("manual_")), "content_hash": content_hash(text), "preprocessing_applied": F.array(*[F.lit(s) for s in NORMALIZATION_STEPS]),
    }
    return df.select(*[values[f.name].alias(f.name) if f.name in values else (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in MANIFEST.fields])


def training_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Train and evaluation rows of a log that interleaves them."""
    log = spark.read.csv(path, header=True, schema=TRAINING_LOG, nullValue="", enforceSchema=False)
    return log.where("train_loss is not null"), log.where("val_loss is not null")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, piece, score of a vocabulary file, whose lines are numbered from 0."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n")).alias("id", "line")).where("line <> ''")
    return rows.select("id", F.split("line", "\t")[0].alias("piece"), F.split("line", "\t")[1].cast("double").alias("score"))


def positional(texts: DataFrame, metadata: DataFrame, strict: bool = True) -> DataFrame:
    """texts and metadata (both with pos) side by side; unlike lengths are an error unless strict is off."""
    if strict and texts.count() != metadata.count():
        raise ValueError("texts and metadata have unlike numbers of rows")
    return texts.join(metadata, "pos", "inner" if strict else "left")


def read(spark: SparkSession, source: Source) -> DataFrame:
    """text and source_file of a registered source; files by prefix of their names."""
    df = spark.read.format(source.format).load(source.path).select(F.col(source.column).alias("text"), F.col("_metadata.file_name").alias("source_file"))
    if source.format == "text":  # books: paragraphs joined up to the most words of a segment
        whole = spark.read.text(source.path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("source_file"))
        df = whole.select(F.explode(segments(F.split("value", r"\n\s*\n"))).alias("text"), "source_file")
    if source.include:
        df = df.where(F.greatest(*[F.startswith("source_file", F.lit(p)) for p in source.include], F.lit(False)))
    for p in source.exclude:
        df = df.where(~F.startswith("source_file", F.lit(p)))
    return df


def write_shards(df: DataFrame, path: str, per_file: int = 2000) -> None:
    """A line for each document, its line ends as spaces, at most per_file lines to a file."""
    df.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Refuses to write over what is there: a second run would count twice."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    """A small report as JSON: written beside its place, then moved there, so that no reader sees half of it."""
    jvm = spark.sparkContext._jvm
    at, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    files_ = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files_.create(beside, True)
    out.write(bytearray(json.dumps(data, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    out.close()
    files_.delete(at, False)
    if not files_.rename(beside, at):
        raise OSError(f"{path} could not be written")


def write_jsonl(df: DataFrame, path: str, split: str) -> None:
    """Items as JSON lines, those of a split; the folder must not be there yet."""
    df.where(F.col("split") == split).write.mode("errorifexists").json(path)


def write_sample(df: DataFrame, path: str, order: str, most: int = 500_000) -> None:
    """The first rows that are neither blank nor markers, a line each, for a tokenizer to learn from."""
    text = trim_ws(F.coalesce("text", F.lit("")))
    some = df.withColumn("__t", text).where((F.col("__t") != "") & ~F.startswith("__t", F.lit(MARKER))).orderBy(order).limit(most)
    some.select(F.regexp_replace("__t", r"[\r\n]+", " ").alias("value")).write.mode("errorifexists").text(path)


def write_packed(stream: DataFrame, path: str, vocabulary: int, eos: int) -> dict:
    """Packed tokens (ids, offset) as files of 16-bit numbers in a table (offset, n, raw), with a sidecar of their totals.

    A number that doesn't fit, or a sum that doesn't agree, is an error.
    """
    if vocabulary > 1 << 16:
        raise ValueError("ids don't fit in 16 bits")
    kind = stream.schema["offset"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(x, "<u2").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["offset", "n", "raw"])

    sums = stream.agg(F.sum(F.size("ids")).alias("tokens"), F.max(F.array_max("ids")).alias("greatest"), F.count("*").alias("documents")).first()
    if sums["greatest"] is not None and sums["greatest"] >= vocabulary:
        raise ValueError("an id is beyond the vocabulary")
    stream.select("offset", "ids").mapInArrow(pack, f"offset {kind}, n long, raw binary").write.mode("errorifexists").parquet(f"{path}/tokens")
    told = {"tokens": sums["tokens"] or 0, "documents": sums["documents"], "vocabulary": vocabulary, "eos": eos}
    write_json(stream.sparkSession, f"{path}/meta.json", told)
    return told


def packed(spark: SparkSession, path: str) -> DataFrame:
    """offset, ids of packed tokens; their number must be that of the sidecar, and none may be beyond the vocabulary."""
    told = json_or_none(spark, f"{path}/meta.json", "tokens long, documents long, vocabulary long, eos long")
    if told is None:
        raise ValueError("the sidecar is missing or broken")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["offset", "ids"])

    raw = spark.read.parquet(f"{path}/tokens")
    out = raw.select("offset", "raw").mapInArrow(unpack, f"offset {raw.schema['offset'].dataType.simpleString()}, ids array<int>")
    sums = out.agg(F.sum(F.size("ids")).alias("n"), F.max(F.array_max("ids")).alias("greatest")).first()
    if (sums["n"] or 0) != told["tokens"] or (sums["greatest"] or 0) >= told["vocabulary"]:
        raise ValueError("the tokens don't agree with their sidecar")
    return out


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a table; at most ``most`` rows, which is what a report can hold."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
