"""Reassembly, segmentation and packing of ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.functions.text import n_words, words

# The most words of a segment, and what a pack aims at.
SEGMENT_WORDS, PACK_WORDS = 1200, 300
MARKER = "--- SOURCE:"


def reassembled(df: DataFrame, file: str, pos: str, text: str, marker: str = MARKER) -> DataFrame:
    """file, part, title, text, rows: what stands between marker rows, lines in order; 'unknown' before the first.

    Blank rows are left out, and a marker without rows gives nothing. Rows are ordered within their file.
    """
    trimmed = F.trim(text)
    is_marker = F.startswith(trimmed, F.lit(marker))
    order = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum(is_marker.cast("int")).over(order)
    title = F.last(F.when(is_marker, F.trim(F.substring(trimmed, F.lit(len(marker) + 1), F.length(trimmed)))), ignorenulls=True).over(order)
    rows = df.withColumn("part", part).withColumn("title", F.coalesce(title, F.lit("unknown"))).withColumn("__m", is_marker).where(~F.col("__m") & (trimmed != ""))
    found = rows.groupBy(file, "part", "title").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("x"))
    return found.select(file, "part", "title", F.array_join(F.col("x.t"), "\n").alias("text"), F.size("x").alias("rows"))


def units(df: DataFrame, file: str, pos: str, text: str) -> DataFrame:
    """file, part, text: runs of lines that are not blank, joined by a space."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    part = F.sum(blank.cast("int")).over(Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("part", part).where(~blank).groupBy(file, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.trim(text).alias("t")))).alias("x"))
    return rows.select(file, "part", F.array_join(F.col("x.t"), " ").alias("text"))


def segments(paragraphs: Column, most: int = SEGMENT_WORDS) -> Column:
    """array<string> of paragraphs joined up to ``most`` words: closed before it would be exceeded; a longer one stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, p: Column) -> Column:
        size = n_words(p)
        full = (s["n"] > 0) & (s["n"] + size > most)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(s["open"], F.array(p))).alias("open"),
            F.when(full, size).otherwise(s["n"] + size).alias("n"),
        )

    return F.aggregate(F.filter(paragraphs, lambda p: F.trim(p) != ""), empty, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"]))


def packed(df: DataFrame, group: str, order: str, text: str, target: int = PACK_WORDS) -> DataFrame:
    """group, pack, text, n_words, units: units of a group in order, each pack closed once it has the target; the rest stays.

    Where a pack closes depends on all before it, so a group is streamed through one task, which holds one pack.
    """
    rows = df.select(group, order, F.col(text).alias("__t"), F.size(words(F.col(text))).cast("long").alias("__n")).where("__n > 0").repartition(group).sortWithinPartitions(group, order)
    kind = df.schema[group].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, parts, n = None, 0, [], 0
        for batch in batches:
            out = []
            for g, t, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if g != at:
                    if parts:
                        out.append((at, number, " ".join(parts), n, len(parts)))
                    at, number, parts, n = g, 0, [], 0
                parts.append(t)
                n += w
                if n >= target:
                    out.append((at, number, " ".join(parts), n, len(parts)))
                    number, parts, n = number + 1, [], 0
            yield as_batch(out, batch.column(0).type)
            last = batch.column(0).type
        if parts:
            yield as_batch([(at, number, " ".join(parts), n, len(parts))], last)

    def as_batch(out: list[tuple], first: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [first, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["g", "pack", "text", "n_words", "units"])

    return rows.mapInArrow(pack, f"g {kind}, pack long, text string, n_words long, units long").withColumnRenamed("g", group)
