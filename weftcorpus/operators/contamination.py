"""Which items of a set of queries stand in documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 20_000
#: Words of a window of whole items, and the share of an item's windows in one document that makes a hit.
WINDOW_WORDS, HIT_SHARE = 8, 0.5


def word_windows(df: DataFrame, key: str, canon: str, n: int = WINDOW_WORDS) -> DataFrame:
    """key, window: the distinct n-word windows of a text, hashed to 64 bits; a shorter text is one window."""
    parts = df.select(key, F.filter(F.split(F.coalesce(canon, F.lit("")), " "), lambda x: x != "").alias("w")).where("size(w) > 0")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, n)))
    return parts.select(key, F.explode(F.array_distinct(grams)).alias("window"))


def items_in(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, share: float = HIT_SHARE) -> DataFrame:
    """item_id, windows, found, documents, first_id of items (item_id, canon): how many of all their windows stand in any
    document of docs (doc_id, canon), and which documents hold at least a share of them.

    Whole items and whole documents are compared. Windows meet by a join on their hashes; of the documents only those
    that an item has travel on, so where items are few enough to be broadcast the documents' windows never move.
    """
    wanted = word_windows(items, "item_id", "canon", n)
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("windows"))
    hits = word_windows(docs, "doc_id", "canon", n).join(wanted, "window")
    found = hits.groupBy("item_id", "window").agg(F.count("*").alias("c")).groupBy("item_id").agg(F.count("*").alias("found"))
    by_document = hits.groupBy("item_id", "doc_id").agg(F.count("*").alias("c")).join(sizes, "item_id").where(F.col("c") >= F.col("windows") * F.lit(share))
    documents = by_document.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.select("item_id").join(sizes, "item_id", "left").join(found, "item_id", "left").join(documents, "item_id", "left").select("item_id", zero("windows"), zero("found"), zero("documents"), "first_id")


def heads_in(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id: items (item_id, head) whose head is part of a document's canon (doc_id, canon).

    Items go to the workers in blocks of at most BLOCK heads, so what a block sends has a bound; documents are read
    whole, once for each block. Heads of one length are looked up among a document's windows of that length.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id"))]
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    spark = docs.sparkSession
    found, block = [], {}

    def search(heads: dict[str, list]) -> DataFrame:
        shared = spark.sparkContext.broadcast(heads)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths = sorted({len(h) for h in shared.value})
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = text or ""
                    hits = set()
                    for n in lengths:
                        hits |= {text[i : i + n] for i in range(len(text) - n + 1)} & shared.value.keys()
                    out += [(item, doc) for h in hits for item in shared.value[h]]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], item_kind), pa.array([x for _, x in out], batch.column(0).type)], ["item_id", "doc_id"])

        return docs.select("doc_id", "canon").mapInArrow(look, f"item_id {kinds[0]}, doc_id {kinds[1]}")

    for row in items.where("head is not null").toLocalIterator():
        block.setdefault(row["head"], []).append(row["item_id"])
        if len(block) >= BLOCK:
            found.append(search(block))
            block = {}
    found.append(search(block))
    return reduce(DataFrame.unionByName, found)
