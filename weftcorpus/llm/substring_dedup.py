"""Substring dedup by recompression: long passages that stand in several documents go, but for their first document.

A window is ``window`` consecutive words. A word goes if a window over it also starts in a document with a smaller
id. Windows are judged on the input.

Recompression names words, then in rounds runs of one symbol and pairs of a left and a right symbol; which side a
symbol is on in a round is a bit of its hash. A name is a hash of what it stands for, so all tasks give equal
runs and pairs equal names without a table of names. With each symbol goes the range of words that decides it: if the
same words stand elsewhere, so does the symbol. Those whose range lies inside a window are its interior symbols, the
same for equal windows. The one with the least hash is the window's anchor; where none is whole, windows go
by their set of words.

1. Consecutive windows with one anchor make a row, those that begin well before it and the others apart. A row has
   a hash of all the words that its windows cover, and one of the words around the anchor that each of them holds.
2. Rows whose first hash is equal are equal passages: all but those of the least id are repeats, without a look at
   windows.
3. Of the rest, those whose second hash no other document has are nowhere else. The windows of the others are
   hashed one by one (two hashes of 64 bits), and those with a smaller id elsewhere are repeats.

A document whose text equals that of a smaller id goes as a whole, if it has a window at all.

Defined results: null and empty texts have no words; a null id is neither smaller nor greater than others, so its
words stay. Rows with equal ids are judged each on its own text (told apart by 64-bit hashes), and not against each
other. Every other column of the input is kept, whatever it is called; one that is called like a result is replaced.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.llm.shared import BASE, Rolling, WordHashes, drop, fresh, mixed, text_bytes, written

WINDOW, ROUNDS, RUN_ROUNDS = 50, 4, (0, 3)
#: Words that are parsed at a time, whole documents only.
BATCH = 400_000
FAR = 1 << 40
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SEPARATOR = np.uint64(0)
#: A row's windows are packed into a number: 43 bits of place, one that tells that the same words stand elsewhere in the
#: text too, 19 of count.
SHIFT, TWIN, MOST = 20, 1 << 19, (1 << 19) - 1


# ---------------------------------------------------------------------------------------------- recompression
class Parse:
    """Symbols over words: names, the words they stand for (start to end) and those that decide them (low to high)."""

    def __init__(self, words: np.ndarray):
        at = np.arange(len(words), dtype=np.int64)
        self.name, self.start, self.end, self.low, self.high = words.copy(), at, at + 1, at.copy(), at + 1
        gap = words == SEPARATOR
        self.low[gap], self.high[gap] = -FAR, FAR

    def keep(self, heads: np.ndarray, low: np.ndarray, high: np.ndarray, name: np.ndarray) -> None:
        """A symbol for each head, standing for all up to the next one."""
        self.start = self.start[heads]
        self.end = self.end[np.append(heads[1:], len(self.name)) - 1]
        self.name, self.low, self.high = name, low, high

    def runs(self) -> None:
        """Names each run of one symbol; that it ends where it does, the one symbol next to it on each side decides."""
        name = self.name
        if len(name) < 2:
            return
        heads = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (name[1:] == SEPARATOR)))
        lengths = np.diff(np.append(heads, len(name)))
        low, high = np.minimum.reduceat(self.low, heads), np.maximum.reduceat(self.high, heads)
        one = name[heads]
        made = np.where(lengths > 1, mixed(one ^ mixed(lengths.astype(np.uint64) + np.uint64(0x5BF03635))), one)
        # only the element next to a run decides where it ends, however far that element's own run goes on
        before, after = heads[1:] - 1, heads[1:]
        wide_low, wide_high = low.copy(), high.copy()
        wide_low[1:] = np.minimum(low[1:], self.low[before])
        wide_high[1:] = np.maximum(high[1:], self.high[before])
        wide_low[:-1] = np.minimum(wide_low[:-1], self.low[after])
        wide_high[:-1] = np.maximum(wide_high[:-1], self.high[after])
        self.keep(heads, wide_low, wide_high, made)

    def pairs(self, seed: int) -> None:
        """Names each left symbol with the right one after it; that another stays alone, its possible partner decides."""
        name = self.name
        if len(name) < 2:
            return
        side = mixed(name + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63)
        gap = name == SEPARATOR
        left, right = (side == 0) & ~gap, (side == 1) & ~gap
        first = np.append(left[:-1] & right[1:], False)
        second = np.append(False, first[:-1])
        low, high = self.low.copy(), self.high.copy()
        alone_left = left & ~first
        alone_right = right & ~second
        # a lone left symbol is decided by the one after it, a lone right one by the one before it
        at = np.flatnonzero(alone_left[:-1])
        low[at], high[at] = np.minimum(low[at], self.low[at + 1]), np.maximum(high[at], self.high[at + 1])
        at = np.flatnonzero(alone_right[1:]) + 1
        low[at], high[at] = np.minimum(low[at], self.low[at - 1]), np.maximum(high[at], self.high[at - 1])
        at = np.flatnonzero(first)
        low[at], high[at] = np.minimum(self.low[at], self.low[at + 1]), np.maximum(self.high[at], self.high[at + 1])
        made = name.copy()
        made[at] = mixed(name[at] * BASE ^ mixed(name[at + 1] + np.uint64(seed + 1)))
        heads = np.flatnonzero(~second)
        self.keep(heads, low[heads], high[heads], made[heads])


def recompressed(words: np.ndarray, rounds: int = ROUNDS) -> Parse:
    """The symbols of the last round; the words begin and end with separators."""
    parse = Parse(words)
    for i in range(rounds):
        if i in RUN_ROUNDS:
            parse.runs()
        parse.pairs(i)
    return parse


def least_of_ranges(first: np.ndarray, last: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """For each place, the least value of the ranges first..last that hold it, or NONE."""
    length = last - first + 1
    level = np.floor(np.log2(np.maximum(length, 1))).astype(np.int64)
    top = int(level.max()) if len(level) else 0
    below = None
    for k in range(top, -1, -1):
        here = np.full(size, NONE)
        own = np.flatnonzero(level == k)
        np.minimum.at(here, first[own], value[own])
        np.minimum.at(here, last[own] - (1 << k) + 1, value[own])
        if below is not None:
            half = 1 << k
            here = np.minimum(here, below)
            here[half:] = np.minimum(here[half:], below[:-half])
        below = here
    return below if below is not None else np.full(size, NONE)


def anchored(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of the words of several documents (with separators between): document, hash of the words around the anchor,
    hash of all words, place and number of windows of each row. begins, ends: where each document's words are."""
    size = len(words)
    bits = np.uint64(max(1, int(size).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    lengths = ends - begins
    counts = np.where(lengths >= window, lengths - window + 1, 0)
    doc = np.repeat(np.arange(len(begins)), counts)
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)

    parse = recompressed(words)
    index = np.flatnonzero((parse.low >= 0) & (parse.high - parse.low <= window) & (parse.name != SEPARATOR))
    value = (mixed(parse.name[index]) & ~mask) | index.astype(np.uint64)
    least = least_of_ranges(np.maximum(parse.high[index] - window, 0), parse.low[index], value, size)
    chosen = least[place]
    found = chosen != NONE
    at = (chosen & mask).astype(np.int64)
    start, end = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    start[found], end[found] = parse.start[at[found]], parse.end[at[found]]
    # no whole symbol, as in long runs and short periods: the window goes by its set of words
    lack = np.flatnonzero(~found)
    kind = np.zeros(len(place), np.uint64)
    for i in lack.tolist():
        kind[i] = mixed(np.unique(words[place[i] : place[i] + window])).sum(dtype=np.uint64)
    # an anchor has half a window before it in those windows that begin early enough, and half a window from it on in the rest
    half = window // 2 - 2
    early = found & (place <= start - half)
    heads = np.flatnonzero(np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (doc[1:] != doc[:-1]) | (early[1:] != early[:-1]) | (kind[1:] != kind[:-1])))
    many = np.diff(np.append(heads, len(doc)))
    if many.max() > MOST:  # more than a row can count
        heads = np.unique(np.concatenate([heads, *(np.arange(h, h + m, MOST) for h, m in zip(heads[many > MOST], many[many > MOST], strict=True))]))
        many = np.diff(np.append(heads, len(doc)))
    first, begin, early = place[heads], start[heads], early[heads]
    rolling = Rolling(words)
    around = rolling.ranges(np.where(early, begin - half, begin), np.where(early, end[heads], np.minimum(begin + half, np.maximum(begin, first + window))))
    around = np.where(found[heads], around, mixed(kind[heads]))
    return doc[heads], around, rolling.ranges(first, first + many - 1 + window), first - begins[doc[heads]], many


def joined_words(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several documents with separators around each, and where each begins and ends."""
    parts, begins, ends, at = [np.array([SEPARATOR])], [], [], 1
    for raw in texts:
        found = hashes.array(raw.split())
        found[found == SEPARATOR] = np.uint64(1)
        parts += [found, np.array([SEPARATOR])]
        begins.append(at)
        ends.append(at + len(found))
        at += len(found) + 1
    return np.concatenate(parts), np.array(begins, np.int64), np.array(ends, np.int64)


def portions(texts: list[bytes], limit: int) -> Iterator[slice]:
    """Slices of about limit words (six bytes each), whole documents only."""
    start = total = 0
    for i, raw in enumerate(texts):
        total += len(raw) // 6 + 1
        if total >= limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


# -------------------------------------------------------------------------------------------------------- steps
def passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """__id, __text_hash, n_words, and arrays around, passage, run, of docs (__id, __text_hash, __text).

    A task gives the arrays of a text only once, for the least id that it has seen with it so far; the others are copies.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for batch in batches:
            ids, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [text_bytes(t.as_py()) for t in batch.column(2)]
            sizes = [0] * len(ids)
            arrays: list[list] = [[None] * len(ids) for _ in range(3)]
            use = []
            for i in sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: ids[i]):
                if prints[i] not in seen or ids[i] < seen[prints[i]]:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen[prints[i]] = ids[i]
                    use.append(i)
            some = [texts[i] for i in use]
            for part in portions(some, BATCH):
                words, begins, ends = joined_words(some[part], hashes)
                doc, around, passage, place, many = anchored(words, begins, ends, window)
                order = np.lexsort((place, passage, doc))
                same = np.append(False, (doc[order][1:] == doc[order][:-1]) & (passage[order][1:] == passage[order][:-1]))
                twin = same | np.append(same[1:], False)
                many = many.copy()
                many[order[twin]] |= TWIN
                first = np.sort(order[~same])  # of equal rows of a document the first one stands for all
                doc, around, passage, place, many = (x[first] for x in (doc, around, passage, place, many))
                edges = np.searchsorted(doc, np.arange(len(begins) + 1))
                run = place << SHIFT | many
                for k in range(len(begins)):
                    i, cut = use[part.start + k], slice(edges[k], edges[k + 1])
                    sizes[i] = int(ends[k] - begins[k])
                    arrays[0][i], arrays[1][i], arrays[2][i] = around[cut].view(np.int64), passage[cut].view(np.int64), run[cut]
            for i in set(range(len(ids))) - set(use):
                sizes[i] = len(texts[i].split())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(a, kind) for a in arrays)],
                ["__id", "__text_hash", "n_words", "around", "passage", "run"],
            )

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "__text_hash", "__text").mapInArrow(describe, f"__id {kind}, __text_hash long, n_words long, around array<long>, passage array<long>, run array<long>")


def unpacked(runs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and numbers of windows of runs, and whether their words have twins in the text."""
    packed = np.array(runs, np.int64)
    return packed >> SHIFT, packed & MOST, packed & TWIN > 0


def window_hashes(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, g, __id, __text_hash, run of each window of the runs asked for, once for a document. texts: __id, __text_hash,
    __text, asked (array of runs)."""
    second = np.uint64(0xC2B2AE3D27D4EB4F)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            h, g, run, rows = [], [], [], []
            for row, (text, asked) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                start, many, twin = unpacked(asked.as_py())
                places = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                words = hashes.array(text_bytes(text.as_py()).split())
                words[words == SEPARATOR] = np.uint64(1)
                found = Rolling(words).ranges(places, places + window)
                found, index, times = np.unique(found, return_index=True, return_counts=True)
                places, twin = places[index], np.repeat(twin, many)[index] | (times > 1)
                h.append(found.view(np.int64))
                g.append(Rolling(mixed(words + second)).ranges(places, places + window).view(np.int64))
                run.append(places << SHIFT | np.where(twin, TWIN, 0) | 1)
                rows.append(np.full(len(places), row))
            h, g, run, rows = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (h, g, run, rows))
            own = [batch.column(i).take(pa.array(rows)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), *own, pa.array(run)], ["h", "g", "__id", "__text_hash", "run"])

    kind = texts.schema["__id"].dataType.simpleString()
    return texts.select("__id", "__text_hash", "__text", "asked").mapInArrow(describe, f"h long, g long, __id {kind}, __text_hash long, run long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """__id, __text_hash and repeats: the runs of windows of a text that repeat those of smaller ids."""
    docs = df.select(F.col(key).alias("__id"), text_hash(F.col(text)).alias("__text_hash"), F.col(text).alias("__text"))
    own = ["__id", "__text_hash"]

    rows = written(passages(docs, window))
    # what is shared is a table of its own, so that joins with it can be split where a text or a passage is hot
    firsts = written(rows.where("__id is not null").groupBy("__text_hash").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last"))
    copies = rows.join(firsts, "__text_hash").where((F.col("__id") > F.col("__first")) & (F.col("n_words") >= window))
    last = F.col("n_words") - window
    runs = F.transform(F.sequence(F.lit(0).cast("long"), last, F.lit(MOST).cast("long")), lambda i: F.shiftleft(i, SHIFT).bitwiseOR(F.least(F.lit(MOST).cast("long"), last + 1 - i)))
    copies = written(copies.select(*own, runs.alias("repeats")))
    drop(firsts)

    each = rows.where("around is not null").select(*own, F.explode(F.arrays_zip("around", "passage", "run")).alias("r")).select(*own, "r.*")
    least = written(each.groupBy("passage").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last").drop("__last"))
    judged = written(each.join(least, "passage", "left").select(*own, "run", F.when(F.coalesce(F.col("__first") == F.col("__id"), F.lit(True)), F.col("around")).alias("around")))
    drop(rows)
    drop(least)
    known = written(judged.where("around is null").groupBy(*own).agg(F.collect_list("run").alias("repeats")))

    open_ = judged.where("around is not null")
    shared = written(open_.groupBy("around").agg(F.min("__id").alias("x"), F.max("__id").alias("y")).where("x < y").select("around"))
    asked = written(open_.join(shared, "around").groupBy(*own).agg(F.collect_list("run").alias("asked")))
    drop(judged)
    drop(shared)
    windows = written(window_hashes(docs.join(asked.hint("shuffle_hash"), own), window))
    drop(asked)
    first = written(windows.groupBy("h", "g").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last").drop("__last"))
    single = windows.join(first, ["h", "g"]).where("__first < __id").groupBy(*own).agg(F.collect_list("run").alias("repeats"))

    found = copies.unionByName(known).unionByName(single)
    out = written(found.groupBy(*own).agg(F.flatten(F.collect_list("repeats")).alias("repeats")))
    for table in (copies, known, windows, first):
        drop(table)
    return out


def kept_words(raw: bytes, runs: list[int] | None, window: int, hashes: WordHashes) -> tuple[list[bytes], int]:
    words = raw.split()
    if not runs:
        return words, 0
    start, many, twin = unpacked(runs)
    if twin.any():  # also where else the same words stand
        values = hashes.array(words)
        values[values == SEPARATOR] = np.uint64(1)
        rolling, more, added = Rolling(values), [], []
        for size in np.unique(many[twin]).tolist():
            every = np.arange(len(words) - (size + window - 1) + 1)
            asked = start[twin & (many == size)]
            span = size + window - 1
            more.append(every[np.isin(rolling.ranges(every, every + span), rolling.ranges(asked, asked + span))])
            added.append(np.full(len(more[-1]), size))
        many = np.concatenate([many, *added])
        start = np.concatenate([start, *more])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + many - 1 + window, len(words)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def _cutter(window: int):
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts, runs in batches:
            sizes, removed, kept = [], [], []
            for t, r in zip(texts, runs, strict=True):
                words, gone = kept_words(text_bytes(t.as_py()), r.as_py(), window, hashes)
                sizes.append(len(words) + gone)
                removed.append(gone)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    return arrow_udf(cut, "struct<n_words:bigint,n_removed:bigint,kept:string>")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with n_words, n_removed and kept_text, the words that stay joined by one space."""
    results = ("n_words", "n_removed", "kept_text")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in results])
    result, runs, print_ = (fresh(df, name) for name in ("__result", "__repeats", "__text_hash"))
    found = repeats(df, key, text, window).toDF(key, print_, runs)
    hashed = df.withColumn(print_, text_hash(F.col(text)))
    joined = hashed.join(found.hint("shuffle_hash"), [key, print_], "left").withColumn(result, _cutter(window)(F.coalesce(F.col(text), F.lit("")), F.col(runs)))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], f"{result}.n_words", f"{result}.n_removed", F.col(f"{result}.kept").alias("kept_text"))
