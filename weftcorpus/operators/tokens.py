"""Token statistics, budgets, packing, windows, masks; encoding by a vocabulary of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Special ids, the ranks that coverage is told for, the manual floor.
SPECIAL = ["<unk>", "<s>", "</s>", "<pad>"]
RANKS = (100, 1000, 5000, 10000)


def frequencies(df: DataFrame, tokens: str) -> DataFrame:
    """token, n: counts with a combiner on each task."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def coverage(counts: DataFrame, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """rank, coverage: the share of all tokens that the most frequent ones are, for ranks that exist.

    Only the head of the ranking is sorted: a bounded top-k, with the totals from a plain aggregate.
    """
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    head = counts.orderBy(F.desc("n"), "token").limit(max(ranks))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")
    running = head.withColumn("rank", F.row_number().over(order)).withColumn("s", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return running.where(F.col("rank").isin(*ranks)).join(F.broadcast(total)).select("rank", F.round(F.col("s") / F.col("total"), 6).alias("coverage"))


def hapax(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"), F.count_if(F.col("n") == 1).alias("hapax"), F.max("n").alias("most"))


def smallest_within(df: DataFrame, size: str, value: str, tolerance: float = 1.02) -> DataFrame:
    """The row of least size whose value is within the tolerance of the best."""
    best = df.agg(F.min(value).alias("__best"))
    return df.join(F.broadcast(best)).where(F.col(value) <= F.col("__best") * F.lit(tolerance)).orderBy(size).limit(1).drop("__best")


def offsets(df: DataFrame, order: str, ids: str, parts: int = 64) -> DataFrame:
    """df with offset: how many tokens stand before a row in the order of ``order``.

    Two steps, so that no task sees all rows: sums of ranges of the order, then running sums inside each range.
    """
    keyed = df.withColumn("__n", F.size(ids).cast("long"))
    bounds = keyed.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("b"))
    cut = keyed.join(F.broadcast(bounds)).withColumn("__part", F.size(F.filter(F.coalesce("b", F.array().cast("array<long>")), lambda x: x < F.col(order)))).drop("b")
    sums = cut.groupBy("__part").agg(F.sum("__n").alias("s"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(base), "__part")  # one row for each of parts
    return joined.withColumn("offset", F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).drop("__base", "__part", "__n")


def packed(df: DataFrame, order: str, ids: str, eos: int) -> DataFrame:
    """order, ids with the end mark, offset in the stream of all rows."""
    marked = df.select(order, F.concat(F.col(ids), F.array(F.lit(eos).cast("int"))).alias("ids"))
    return offsets(marked, order, "ids")


def verify(stream: DataFrame, vocabulary: int, eos: int) -> DataFrame:
    """Tokens, documents, greatest id, end marks, and whether they agree."""
    ends = F.size(F.filter("ids", lambda x: x == eos))
    sums = stream.agg(F.sum(F.size("ids")).alias("tokens"), F.count("*").alias("documents"), F.max(F.array_max("ids")).alias("greatest"), F.sum(ends).alias("ends"))
    return sums.withColumn("valid", (F.col("greatest") < vocabulary) & (F.col("ends") == F.col("documents")))


def fixed_windows(length: Column, n: int, size: int) -> Column:
    """n starts spread evenly from 0 to length - size - 1, cut to whole numbers."""
    high = F.greatest(length - size - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * high / F.lit(max(1, n - 1))).cast("int"))


def masked(prompt: Column, completion: Column, eos: int, most: int) -> Column:
    """ids of prompt, completion and end, with a mask of the targets that count; null if they are too many."""
    ids = F.concat(prompt, completion, F.array(F.lit(eos).cast("int")))
    mask = F.transform(F.slice(ids, 2, F.size(ids)), lambda x, i: (i >= F.size(prompt) - 1).cast("int"))
    return F.when(F.size(ids) <= most, F.struct(ids.alias("ids"), mask.alias("mask")))


def cosine_rate(step: Column, total: int, rate: float, warmup: float = 0.02, floor: float = 0.1) -> Column:
    """Linear up to the rate, then half a cosine down to a share of it."""
    first = max(1, int(total * warmup))
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - first) / F.lit(max(1, total - first))))
    down = F.lit(rate * floor) + F.lit(rate - rate * floor) * 0.5 * (1 + F.cos(F.pi() * progress))
    return F.when(step < first, F.lit(rate) * (step + 1) / first).otherwise(down)


def parameters(d: int, layers: int, ff: int, vocabulary: int, context: int, tied: bool = True) -> dict[str, int]:
    """Parameters of a decoder by component."""
    block = 4 * d * d + 4 * d + 2 * d * ff + ff + d + 4 * d
    head = vocabulary if tied else vocabulary * d + vocabulary
    parts = {"blocks": layers * block, "token_embedding": vocabulary * d, "positional_embedding": context * d, "final_norm": 2 * d, "output_head": head}
    return parts | {"total": sum(parts.values())}


def encode(words: Column, pieces: dict[str, int], scores: dict[str, float]) -> Column:
    """array<int> of the pieces of words: the adjacent pair whose join scores best is merged until none does.

    What has no piece falls back to its bytes ``<0xNN>``, and without these to ``<unk>``. The vocabulary is a fixed
    list, sent with the function.
    """

    def split(word: str) -> list[int]:
        parts = list("▁" + word)
        while len(parts) > 1:
            best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out = []
        for p in parts:
            out += [pieces[p]] if p in pieces else [pieces.get(f"<0x{b:02X}>", 0) for b in p.encode("utf-8", "replace")]
        return out

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids: list[int] = []
                for w in row or []:
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = split(w)
                    ids += known[w]
                rows.append(ids)
            yield pa.array(rows, pa.list_(pa.int32()))

    return arrow_udf(run, "array<int>")(words)
