"""Mixing sources to target weights by iterative proportional fitting.

The tokens (words) of a corpus are counted by cell of source, language and topic. Starting from these counts, the
cells' weights are raked: scaled to the targets of each margin in turn, until every margin meets its targets within a
tolerance. A budget of tokens is then dealt out by the fitted weights; a cell that has fewer tokens than its part is
taken whole, and the rest is dealt out among the others. A document is kept if a uniform number made of its key is
below its cell's probability.

Topics are learned from all documents with words: k-means over hashed word vectors. A vector has the logarithms of the
counts of a text's words by BUCKETS hash values, weighed by how few texts have them, at length 1; what all texts of a
language have in common is taken off, so that topics cut across languages. Each document's vector is made once and
written; document frequencies, languages' means and every round of k-means are sums over all of these tables, of which
a task hands on a few kilobytes. Coordinates are whole numbers (SCALE is 1), so the sums and what is nearest don't
depend on how rows are dealt out. Every document goes to the nearest centre. A corpus that has a topic column names it
instead.

Targets: for each margin the square root of its share of tokens, which lifts small sources, languages and topics.
Raking runs on the table of cells, a row for each source, language and topic that occurs, inside the plan: nothing
of it is gathered on the driver, and the cells are joined to the documents by their key. What error the margins are left
with after most sweeps stands in the result: where cells are missing, targets may contradict each other.

Defined results: null sources, languages and topics are categories of their own; texts without words have topic -1 where
topics are learned, no tokens and, as their cell takes part with one token for each document, a probability like any
other. Rows with equal keys are kept or dropped together. Columns of the input called like results are replaced, all
others are kept, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.llm.shared import WordHashes, drop, fresh, mixed as spread, small_batches, text_bytes, written

TOPICS, BUDGET, POWER, SALT = 8, 0.7, 0.5, "mix"
#: Coordinates of a vector; what a length of 1, and a logarithm of 1, are as whole numbers.
BUCKETS, SCALE, LOG = 256, 1 << 14, 1 << 11
#: Candidates for starts are drawn so many times, for each topic so many. Rounds end when one takes off less than this share
#: of the summed squares, and at most. Means of more languages than FEW are joined by shuffle.
DRAWS, DRAWN, ROUNDS, GAIN, FEW = 4, 4, 25, 1e-4, 10_000
#: What Python workers get at once, and vectors that are compared at once: those of ten thousand texts take 20 MB for each step.
BATCH, PART = "1m", 2_000
#: Raking ends at this relative error of the worst margin; sweeps between two looks at it, and sweeps at most.
TOLERANCE, SWEEPS, MOST_SWEEPS = 0.005, 6, 60
MARGINS = ("source", "lang", "topic")


# -------------------------------------------------------------------------------------------------------- topics
def word_vector(raw: bytes, hashes: WordHashes, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """1 + logarithm of the counts of a text's words by hash value, and the number of words."""
    words = raw.lower().split()
    counts = np.bincount((hashes.array(words) >> np.uint64(17)).astype(np.int64) % buckets, minlength=buckets)
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0), len(words)


@dataclass
class TopicModel:
    """Weights of coordinates, the mean vector of each language, and the centres of topics."""

    weights: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS))
    means: dict[str | None, np.ndarray] = field(default_factory=dict)
    centres: np.ndarray = field(default_factory=lambda: np.zeros((1, BUCKETS)))


def stacked(column: pa.Array, kind: str) -> np.ndarray:
    """The vectors of a column of bytes, as rows; null ones as zeros."""
    nothing = bytes(BUCKETS * np.dtype(kind).itemsize)
    return np.frombuffer(b"".join(nothing if x is None else x for x in column.to_pylist()), kind).reshape(-1, BUCKETS).astype(np.float64)


def of_length_one(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighed vectors at length SCALE, in whole numbers."""
    weighed = vectors * weights
    return np.rint(SCALE * weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12))


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each centre; exact, as all are whole numbers far below 2**53."""
    return (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T


def k_means(points: np.ndarray, sizes: np.ndarray, k: int, rounds: int = ROUNDS, starts: int = 10, seed: int = 5) -> np.ndarray:
    """The best of some Lloyd's runs over points that count sizes times each; fewer centres if there are fewer unlike points."""
    rng, best, least = np.random.default_rng(seed), points[:1], float("inf")
    for _ in range(starts):
        centres = points[rng.choice(len(points), p=sizes / sizes.sum())][None, :]
        while len(centres) < k and (near := distances(points, centres).min(axis=1) * sizes).sum() > 0:
            centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
        for _ in range(rounds):
            own = distances(points, centres).argmin(axis=1)
            moved = np.array([np.average(points[own == i], axis=0, weights=sizes[own == i]) if (own == i).any() else centres[i] for i in range(len(centres))])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = (distances(points, centres).min(axis=1) * sizes).sum()
        if cost < least:
            best, least = centres, cost
    return np.rint(best)


def frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors (column v) there are, and how many have each coordinate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += (stacked(batch.column(0), "<u2") > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])

    found = rows.select("v").mapInArrow(count, "n long, sums binary").collect()  # a row for each task
    return sum(r["n"] for r in found), sum((np.frombuffer(r["sums"], np.int64) for r in found), np.zeros(BUCKETS, np.int64))


def language_means(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """lang, mean: of the vectors (columns v, lang), in whole numbers, a row for each language."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, list] = {}

        def handed_on() -> pa.RecordBatch:
            columns = [list(sums), [n for n, _ in sums.values()], [s.tobytes() for _, s in sums.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "n", "sums"])

        for batch in batches:
            units, langs = of_length_one(stacked(batch.column(0), "<u2"), weights), batch.column(1).dictionary_encode(null_encoding="encode")
            codes = langs.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            heads = np.flatnonzero(np.append(True, codes[order][1:] != codes[order][:-1])[: len(codes)])
            names = langs.dictionary.to_pylist()
            for at, part in zip(heads.tolist(), np.split(order, heads[1:]), strict=False):
                n, s = sums.get(names[codes[order[at]]], (0, 0))
                sums[names[codes[order[at]]]] = n + len(part), s + units[part].sum(axis=0).astype(np.int64)
            if len(sums) > FEW:
                yield handed_on()
                sums.clear()
        yield handed_on()

    def mean(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, lang = 0, np.zeros(BUCKETS, np.int64), None
        for batch in groups:
            lang = batch.column(0)[0].as_py()
            n += sum(batch.column(1).to_pylist())
            for s in batch.column(2).to_pylist():
                sums += np.frombuffer(s, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([np.rint(sums / n).astype("<i2").tobytes()], pa.binary())], ["lang", "mean"])

    parts = rows.select("v", "lang").mapInArrow(add, "lang string, n long, sums binary")
    return parts.groupBy("lang").applyInArrow(mean, "lang string, mean binary")


def with_means(rows: DataFrame, means: DataFrame | None, lang: str, name: str) -> DataFrame:
    """rows with the mean of the language in a column, as a column of that name; means: written."""
    if means is None:
        return rows.withColumn(name, F.lit(None).cast("binary"))
    of = fresh(rows, "__lang_of_mean")
    means = means.select(F.col("lang").alias(of), F.col("mean").alias(name))
    means = F.broadcast(means) if means.count() <= FEW else means  # half a kilobyte each
    return rows.join(means, F.col(lang).eqNullSafe(F.col(of)), "left").drop(of)


def placed(rows: DataFrame, weights: np.ndarray, means: DataFrame) -> DataFrame:
    """h, p: the place of each vector (columns h, v, lang), without the mean of its language."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = of_length_one(stacked(batch.column(1), "<u2"), weights) - stacked(batch.column(2), "<i2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in at.astype("<i2")], pa.binary())], ["h", "p"])

    return with_means(rows, means, "lang", "mean").select("h", "v", "mean").mapInArrow(place, "h long, p binary")


def drawn(points: DataFrame, centres: np.ndarray, turn: int, many: int) -> np.ndarray:
    """centres and many more points (columns h, p), drawn from all by their squared distances from the nearest centre.

    Each point runs a race against time of the rate of its distance; the first ones to end are those drawn. Of equal
    points the first counts alone, so that copies don't take the places of others.
    """

    def unlike(runs: Iterator[tuple[float, bytes]]) -> list[tuple[float, bytes]]:
        first: dict[bytes, float] = {}
        for t, p in runs:
            first.setdefault(p, t)
            if len(first) == many:
                break
        return [(t, p) for p, t in first.items()]

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[float, bytes]] = []
        for batch in batches:
            at = stacked(batch.column(1), "<i2")
            rate = distances(at, centres).min(axis=1) if len(centres) else np.ones(len(at))
            chance = (spread(batch.column(0).to_numpy().view(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) + 0.5
            time = -np.log(chance / float(1 << 53))
            time = np.divide(time, rate, out=np.full(len(at), np.inf), where=rate > 0)
            order = np.argsort(time, kind="stable")[: int((time < np.inf).sum())]
            kept = unlike(merge(kept, ((float(time[i]), batch.column(1)[i].as_py()) for i in order)))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.float64()), pa.array([p for _, p in kept], pa.binary())], ["t", "p"])

    found = unlike(sorted((r["t"], bytes(r["p"])) for r in points.mapInArrow(race, "t double, p binary").collect()))  # many rows for each task
    return np.vstack([centres, *(np.frombuffer(p, "<i2").astype(np.float64)[None, :] for _, p in found)])


def gathered(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the points (column p) nearest to each centre the number and the sum, and the summed squares of all distances."""
    k = len(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums, cost = np.zeros(k, np.int64), np.zeros((k, BUCKETS), np.int64), 0
        for batch in batches:
            at = stacked(batch.column(0), "<i2")
            far = distances(at, centres)
            own = far.argmin(axis=1)
            sizes += np.bincount(own, minlength=k)
            sums += ((own[:, None] == np.arange(k)).T.astype(np.float64) @ at).astype(np.int64)
            cost += int(far.min(axis=1).sum())
        # squares are handed on in two halves, as those of many texts take more than 64 bits
        halves = [pa.array([x], pa.int64()) for x in (cost >> 32, cost & 0xFFFFFFFF)]
        yield pa.RecordBatch.from_arrays([pa.array([sizes.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), *halves], ["sizes", "sums", "high", "low"])

    found = points.select("p").mapInArrow(add, "sizes binary, sums binary, high long, low long").collect()  # a row for each task
    sizes, sums = np.zeros(k, np.int64), np.zeros((k, BUCKETS), np.int64)
    for r in found:
        sizes += np.frombuffer(r["sizes"], np.int64)
        sums += np.frombuffer(r["sums"], np.int64).reshape(k, BUCKETS)
    return sizes, sums, sum((r["high"] << 32) + r["low"] for r in found)


def learned(rows: DataFrame, topics: int) -> tuple[np.ndarray, DataFrame | None, np.ndarray]:
    """Weights, means of languages (written) and centres, from all rows: h (a hash that chance is made of), v, lang."""
    n, having = frequencies(rows)
    if not n:
        return np.ones(BUCKETS), None, np.zeros((1, BUCKETS))
    weights = np.log((1 + n) / (1 + having)) + 0.1
    means = written(language_means(rows, weights))
    points = written(placed(rows, weights, means))
    tried = drawn(points, np.zeros((0, BUCKETS)), 0, 1)
    for turn in range(1, DRAWS + 1):
        tried = drawn(points, tried, turn, DRAWN * topics)
    tried = np.unique(tried, axis=0)
    centres, before = k_means(tried, gathered(points, tried)[0], topics), None
    for _ in range(ROUNDS):
        sizes, sums, cost = gathered(points, centres)
        if before is not None and before - cost <= GAIN * before:
            break
        before = cost
        centres = np.where(sizes[:, None] > 0, np.rint(sums / np.maximum(sizes, 1)[:, None]), centres)
    drop(points)
    return weights, means, centres


def fit_topics(df: DataFrame, key: str, text: str, lang: str, topics: int = TOPICS) -> TopicModel:
    """The model of all documents with words; the means of all languages come to the driver."""
    rows = written(df.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), vector_and_tokens(F.col(text)).alias("r")).select("k", "lang", "r.*"))
    weights, means, centres = learned(learnable(rows, "k", "v", "lang", "n_tokens"), topics)
    found = {} if means is None else {r["lang"]: np.frombuffer(r["mean"], "<i2") / SCALE for r in means.collect()}
    for table in (rows, *([means] if means is not None else [])):
        drop(table)
    return TopicModel(weights, found, centres / SCALE)


def learnable(rows: DataFrame, key: str, vector: str, lang: str, n_tokens: str) -> DataFrame:
    """h, v, lang of the rows with words."""
    chance = F.xxhash64(F.lit(29), F.col(key).cast("string"), vector)
    return rows.where(F.col(n_tokens) > 0).select(chance.alias("h"), F.col(vector).alias("v"), F.col(lang).alias("lang"))


def vector_and_tokens(text: Column, vectors: bool = True) -> Column:
    """struct<v,n_tokens> of each text: its word vector in LOGths, none if they aren't wanted, and its words."""

    @arrow_udf("struct<v:binary,n_tokens:bigint>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes(3)
        for texts in batches:
            if vectors:
                found = [(np.rint(LOG * v).astype("<u2").tobytes(), n) for v, n in (word_vector(text_bytes(t.as_py()), hashes) for t in texts)]
            else:
                found = [(None, len(text_bytes(t.as_py()).split())) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["v", "n_tokens"])

    return describe(F.coalesce(text, F.lit("")))


def nearest(weights: np.ndarray, centres: np.ndarray, vector: Column, n_tokens: Column, mean: Column) -> Column:
    """The centre nearest to each vector, the first of equally near ones; -1 for a text without words."""

    @arrow_udf("int")
    def topic(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, sizes, means in batches:
            own = [np.zeros(0, np.int64)]
            for i in range(0, len(vectors), PART):
                at = of_length_one(stacked(vectors[i : i + PART], "<u2"), weights) - stacked(means[i : i + PART], "<i2")
                own.append(distances(at, centres).argmin(axis=1))
            yield pa.array(np.where(sizes.to_numpy() > 0, np.concatenate(own), -1).astype(np.int32))

    return topic(vector, n_tokens, mean)


def uniform(key: Column, salt: str = SALT) -> Column:
    """A number from 0 to below 1 made of the key."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


# -------------------------------------------------------------------------------------------------------- raking
def counted(rows: DataFrame) -> DataFrame:
    """source, lang, topic, tokens of each cell of rows (with n_tokens); a text counts for one token at least."""
    return rows.groupBy(*MARGINS).agg(F.sum(F.greatest("n_tokens", F.lit(1))).alias("tokens"))


def targets(cells: DataFrame, power: float = POWER) -> DataFrame:
    """cells with the share of all weight that each margin's value is to have: of its tokens to the given power."""
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
        total = sums.agg(F.sum("p").alias("all"))
        shares = sums.join(F.broadcast(total)).select(F.col(margin).alias("m"), (F.col("p") / F.col("all")).alias(f"target_{margin}"))  # one row
        cells = cells.join(shares, F.col(margin).eqNullSafe(F.col("m"))).drop("m")
    return cells


def fitted(cells: DataFrame, tolerance: float = TOLERANCE, sweeps: int = SWEEPS, most: int = MOST_SWEEPS) -> tuple[DataFrame, float]:
    """Cells (with tokens and target_ columns) with their raked weight, which sum to 1, and the relative error left."""
    columns = [*MARGINS, "tokens", *(f"target_{m}" for m in MARGINS)]
    table = written(cells.select(*columns, F.col("tokens").cast("double").alias("weight")))
    done, error = 0, float("inf")
    while error > tolerance and done < most:
        weighed = table
        for _ in range(sweeps):
            for margin in MARGINS:
                weighed = weighed.withColumn("weight", F.col("weight") * F.col(f"target_{margin}") / F.sum("weight").over(Window.partitionBy(margin)))
        following = written(weighed)
        drop(table)
        table, done = following, done + sweeps
        error = residual(table)
    return table, error


def residual(cells: DataFrame) -> float:
    """The largest relative error of any value of any margin."""
    worst = 0.0
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.sum("weight").alias("w"), F.first(f"target_{margin}").alias("t"))
        worst = max(worst, sums.agg(F.max(F.abs(F.col("w") / F.col("t") - 1))).first()[0] or 0.0)
    return worst


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with probability: the budget (a share of all tokens) dealt out by weight, no cell above what it has.

    In the order of tokens per weight the cells that are taken whole come first. With s tokens for a weight of 1,
    s is what the cells before one leave, over the weights from there on, for the first cell that this doesn't fill.
    """
    ratio = F.col("tokens") / F.col("weight")
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", *MARGINS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(budget) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    tried = cells.withColumn("ratio", ratio).withColumn("s", left / F.sum("weight").over(onward))
    scale = tried.where("s <= ratio").agg(F.min_by("s", F.struct("ratio", *MARGINS)).alias("scale"))
    share = F.coalesce(F.least(F.lit(1.0), F.col("scale") * F.col("weight") / F.col("tokens")), F.lit(1.0))
    return cells.join(F.broadcast(scale)).select(*MARGINS, "tokens", "weight", share.alias("probability"))  # one row


def mixed(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, budget: float = BUDGET, power: float = POWER,
    topics: int = TOPICS, salt: str = SALT, tolerance: float = TOLERANCE, most_sweeps: int = MOST_SWEEPS, broadcast_cells: int = 100_000,
) -> DataFrame:
    """df with topic, n_tokens, probability, residual (the largest relative error that raking leaves a margin with) and kept.

    The table of cells is broadcast only if it has at most broadcast_cells rows, which is counted; else it is joined
    by shuffle, where adaptive execution splits a hot cell.
    """
    results = ("topic", "n_tokens", "probability", "residual", "kept")
    names = [c for c in df.columns if c.lower() not in results]
    found, own, other = fresh(df, "__found"), {m: fresh(df, f"__{m}") for m in MARGINS}, {m: fresh(df, f"__{m}_of_cell") for m in MARGINS}
    vector, mean = fresh(df, "__vector"), fresh(df, "__mean")
    cell = {"source": F.col(source).cast("string"), "lang": F.col(lang).cast("string")} | ({"topic": F.col(topic).cast("string")} if topic else {})
    known = df.withColumn(found, vector_and_tokens(F.col(text), not topic))
    known = known.select(*[F.col(f"`{c}`") for c in names], *[cell[m].alias(own[m]) for m in cell], F.col(f"{found}.n_tokens").alias("n_tokens"), F.col(f"{found}.v").alias(vector))
    with small_batches(df.sparkSession, BATCH):
        known = written(known)
        if not topic:
            weights, means, centres = learned(learnable(known, key, vector, own["lang"], "n_tokens"), topics)
    if not topic:
        known = with_means(known, means, own["lang"], mean)
        known = known.withColumn(own["topic"], nearest(weights, centres, F.col(vector), F.col("n_tokens"), F.col(mean)))

    cells = written(counted(known.select(*[F.col(own[m]).alias(m) for m in MARGINS], "n_tokens")))
    weighed, error = fitted(targets(cells, power), tolerance, most=most_sweeps)
    drop(cells)
    shares = written(calibrated(weighed, budget))
    drop(weighed)
    renamed = shares.select(*[F.col(m).alias(other[m]) for m in MARGINS], "probability")
    if shares.count() <= broadcast_cells:
        renamed = F.broadcast(renamed)
    same = [F.col(own[m]).eqNullSafe(F.col(other[m])) for m in MARGINS]
    joined = known.join(renamed, same, "left")
    kept = (uniform(F.col(key), salt) < F.col("probability")).alias("kept")
    return joined.select(*[F.col(f"`{c}`") for c in names], F.col(own["topic"]).alias("topic"), "n_tokens", "probability", F.lit(error).alias("residual"), kept)
