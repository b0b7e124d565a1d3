"""Connected components of a table of links, without gathering links or components on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcorpus.llm.shared import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: greater ones; else: smaller ones, and itself) to the least of them and it."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(least, "a")
    out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links lead to) of every node that stands in a link.

    links: a, b of one orderable type without nulls, in any order, repeated or not. Large and small stars alternate
    until nothing changes; each round is written, so lost executors cost a round at most.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        following = written(_star(_star(edges, True), False))
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        drop(edges)
        edges = following
        if mark == before or mark[0] == 0:
            break
        before = mark
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
