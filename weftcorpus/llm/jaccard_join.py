"""N-gram Jaccard join with count-vector R-trees, exact, down to connected components.

A text's set is its distinct shingles of words. Texts with equal sets are one class, and all work is on classes.
The shingles are hashed into groups, and a class's counts by group are its point: two classes share no more
shingles than the sum, over the groups, of the smaller counts, so a box of points is ruled out by the sum of the
minima of its upper bounds.

1. Two sets that are similar enough share a shingle among the first few of both in any common order (the fewer, the
   higher the threshold). The order puts shingles that a count sketch of the whole corpus shows to be very frequent
   last, so that common passages don't make keys. Classes with a common key form a block; of blocks with equal
   members one is kept.
2. Each class is verified against the class that leads most of its blocks, in a few turns with other leads. Copies of
   one text meet there, so a group of any size costs a few comparisons a class.
3. In blocks that hold several components still, tiles of the block are indexed by R-trees and joined:
   boxes by size and by bound, then points, then by finer counts; only pairs across components are verified.

Every pair of similar classes shares a block, and within a block a pair is left out only if a bound rules it out or
its classes are linked already. So the components are those of all similar pairs. Shingles are compared by 64-bit
hashes. Nothing about single documents is gathered on the driver; the sketch has a fixed size.

Defined results: texts without words, or null, have an empty set and link with nothing: their component is
their own id. Texts with fewer words than a shingle have one shingle, the whole sequence. Repeated rows share a
component with themselves. Input columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcorpus.llm.components import components
from weftcorpus.llm.shared import Rolling, WordHashes, drop, mixed, partitions, small_batches, text_bytes, written

SHINGLE, GROUPS, FINE, ROUNDS = 5, 128, 2048, 3
#: Similar sets: DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
SLOTS, HEAVY, LEAST = 1 << 22, 2.5, 48
TILE, LEAF, PORTION, UNITE = 256, 16, 512, 8
#: Bits of a packed key: those of the shingle, and of each of two codes of sizes.
KEY, CODE = 43, 10


def shingle_hashes(texts: list[bytes], hashes: WordHashes, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of each text's shingles, in order, repeated ones included; A-Z count as lower case."""
    for start, end in portions(texts):
        split = [t.lower().split() for t in texts[start:end]]
        sizes = [len(w) for w in split]
        rolling = Rolling(hashes.array([w for s in split for w in s]))
        full = rolling.windows(n)
        at = 0
        for size in sizes:
            if size >= n:
                yield full[at : at + size - n + 1]
            elif size:
                yield rolling.ranges(np.array([at]), np.array([at + size]))
            else:
                yield full[:0]
            at += size


def portions(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [text_bytes(t.as_py()) for t in column]


def prefix_length(size: int) -> int:
    """How many first shingles are enough: size - ceil(size * threshold) + 1."""
    return size - -(-size * NUM // DEN) + 1


def similar(common: int, a: int, b: int) -> bool:
    return DEN * common >= NUM * (a + b - common)


# ------------------------------------------------------------------------------------------- frequent shingles
def heavy_levels(docs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of a count sketch of all shingles: 0, or how far it lies above HEAVY times the mean (LEAST at least);
    and for each such level the number of portions that its blocks are dealt out in.

    A task counts in a table of fixed size and hands on only slots far above its own mean, of which there can be but
    a fixed share. The result orders shingles and cuts blocks, and decides nothing else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, total = WordHashes(), np.zeros(slots, np.int32), 0
        for batch in batches:
            for found in shingle_hashes(raw_texts(batch.column(0)), hashes):
                total += len(found)
                np.add.at(table, (found & np.uint64(slots - 1)).astype(np.int64), 1)
        at = np.flatnonzero(table > 1.5 * total / slots + 2)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], ["slot", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], ["slot", "n"])

    found = written(docs.select("__text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    total = found.where("slot = -1").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, HEAVY * total / slots)
    level = F.least(F.lit(255), 1 + F.floor(4 * F.log2(F.col("n") / F.lit(float(least))))).cast("int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [batch.column(0).to_numpy().astype("<u4").tobytes(), batch.column(1).to_numpy().astype(np.uint8).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], ["slots", "levels"])

    levels = np.zeros(slots, np.uint8)
    # bounded: at most slots / HEAVY slots can have HEAVY times the mean, of five bytes each
    for r in found.where((F.col("slot") >= 0) & (F.col("n") >= least)).select("slot", level.alias("level")).mapInArrow(encode, "slots binary, levels binary").collect():
        levels[np.frombuffer(r["slots"], "<u4")] = np.frombuffer(r["levels"], np.uint8)
    drop(found)
    return levels, portions_by_level(least)


def portions_by_level(least: float) -> np.ndarray:
    """How many portions of about PORTION rows a block of each level makes."""
    rows = np.append(0, least * 2.0 ** (np.arange(1, 256) / 4))
    return np.clip(np.ceil(rows / PORTION), 1, 1 << 2 * CODE).astype(np.int64)


# ------------------------------------------------------------------------------------------------- the classes
def counts(found: np.ndarray, groups: int) -> np.ndarray:
    """How many hashes fall into each group, by their first bits."""
    return np.bincount((found >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fine_counts(found: np.ndarray) -> np.ndarray:
    """Counts by about one group for two hashes, from GROUPS to FINE, as bytes; a power of two, so that they can be folded."""
    groups = min(FINE, max(GROUPS, 1 << (len(found) // 2).bit_length()))
    while (made := counts(found, groups)).max() > 255:
        groups *= 2
    return made.astype(np.uint8)


def folded(fine: np.ndarray, groups: int) -> np.ndarray:
    return fine.reshape(groups, -1).sum(axis=1, dtype=np.int64)


def fine_of(raw: bytes) -> np.ndarray:
    """The fine counts of a class as described() packs them: mostly 0, 1 and 2, they take a fraction of their bytes."""
    return np.frombuffer(zlib.decompress(raw), np.uint8)


def fine_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The summed minima of two vectors of fine counts, the longer one folded to the length of the other."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def size_code(x: np.ndarray) -> np.ndarray:
    """A size on a scale of 34 steps for each doubling, in CODE bits; greater sizes never have smaller codes."""
    return np.minimum(np.log2(np.maximum(x, 1)) * 34, (1 << CODE) - 1).astype(np.int64)


def packed_keys(found: np.ndarray, level: np.ndarray, own: int, salts: np.ndarray) -> np.ndarray:
    """The keys of a set, a long for each of its first shingles: KEY bits of the shingle and the rest.

    The rest is the code of the set's size and that of the largest partner that this place leaves: if a pair's first
    common shingle stands at place i of n, they share n - i at most. A shingle that the sketch shows to be very
    frequent has no such codes; its rest, marked by a bit, deals the block out in portions.
    """
    n = len(found)
    if level.any():
        order = np.argsort(level, kind="stable")
        found, level = found[order], level[order]
    m = prefix_length(n)
    found, portions_of = found[:m], salts[level[:m]]
    partner = ((NUM + DEN) * (n - np.arange(m)) - NUM * n) / NUM
    light = size_code(np.array([n])) << CODE | size_code(np.ceil(partner))
    heavy = (own & 0x7FFFFFFF) % portions_of & (1 << 2 * CODE) - 1 | 1 << 2 * CODE
    base = (found >> np.uint64(64 - KEY) << np.uint64(64 - KEY)).view(np.int64)
    return base | np.where(portions_of > 1, heavy, light)


def described(docs: DataFrame, levels: np.ndarray, salts: np.ndarray) -> DataFrame:
    """__id, n, class, n_keys, fine, keys; the last three of a class stand in the first row that a task has of it."""
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, seen = WordHashes(), np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            sizes, classes, fine, keys = [], [], [], []
            known = batch.column(0).is_valid().to_pylist()
            for i, found in enumerate(map(np.unique, shingle_hashes(raw_texts(batch.column(1)), hashes))):
                sizes.append(len(found))
                own = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) and known[i] else None
                classes.append(own)
                if own is None or own in seen:
                    fine.append(None)
                    keys.append(None)
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(own)
                fine.append(zlib.compress(fine_counts(found).tobytes(), 1))
                level = order[(found & np.uint64(len(order) - 1)).astype(np.int64)]
                keys.append(packed_keys(found, level, own, salts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array([0 if k is None else len(k) for k in keys], pa.int64()), pa.array(fine, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["__id", "n", "class", "n_keys", "fine", "keys"],
            )

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "__text").mapInArrow(describe, f"__id {kind}, n long, class long, n_keys long, fine binary, keys array<long>")


def partnered(group: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows have another one in their group (rows stand in the order of groups) whose size each leaves room for.

    Groups of more than PORTION rows are taken as they are.
    """
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lengths = np.diff(np.append(heads, len(group)))
    many = np.repeat(lengths, lengths)
    good = many > PORTION
    at = np.flatnonzero((many > 1) & ~good)
    left = np.repeat(heads + lengths, lengths)[at] - at  # rows from here to the end of the group
    step = 1
    while len(at := at[left > step]):
        left = left[left > step]
        fits = (size[at] <= most[at + step]) & (size[at + step] <= most[at])
        good[at[fits]] = good[at[fits] + step] = True
        step += 1
    return good


def blocks(rows: DataFrame) -> DataFrame:
    """key, class: blocks of two classes or more that may be alike, one of those with equal members.

    Rows are dealt out by key (a very frequent one by key and portion) and stream through in order; what a task gives
    of a block is a part of it, and the parts' marks add up to those of the block. A class stands in a part once, and twice
    in a block only where it stands at the border of two parts.
    """
    each = rows.where("keys is not null").select(F.explode("keys").alias("packed"), "class")
    total = rows.agg(F.sum("n_keys")).first()[0] or 0
    rest = (1 << 64 - KEY) - 1
    frequent = F.col("packed").bitwiseAND(1 << 2 * CODE) != 0
    dealt = each.select("packed", "class").repartition(partitions(rows.sparkSession, total, 4_000_000), F.when(frequent, F.col("packed")).otherwise(F.col("packed").bitwiseAND(~rest)))

    def part(columns: list[np.ndarray]) -> pa.RecordBatch:
        packed, own = columns
        new = np.append(True, (packed[1:] != packed[:-1]) | (own[1:] != own[:-1]))[: len(packed)]
        packed, own = packed[new], own[new]
        heavy = packed & 1 << 2 * CODE != 0
        group = np.where(heavy, packed, packed & ~rest)
        keep = heavy | partnered(group, packed >> CODE & (1 << CODE) - 1, packed & (1 << CODE) - 1)
        group, own = group[keep], own[keep]
        order = np.lexsort((own, group))
        group, own = group[order], own[order]
        new = np.append(True, (group[1:] != group[:-1]) | (own[1:] != own[:-1]))[: len(group)]  # a class with two such keys stands once
        group, own = group[new], own[new]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        marks = [np.full(len(group), None, object) for _ in range(5)]
        if len(heads):
            digest = mixed(own.view(np.uint64))
            sums = [np.add.reduceat(x.astype(np.int64), heads) for x in (digest & np.uint64(0xFFFFFFFF), digest >> np.uint64(32), np.ones(len(own)))]
            for column, values in zip(marks, [np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads), *sums], strict=True):
                column[heads] = values
        return pa.RecordBatch.from_arrays([pa.array(group & ~rest), pa.array(own), *(pa.array(x, pa.int64()) for x in marks)], ["key", "class", "lead", "last", "s1", "s2", "m"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(2)]
            if not len(columns[0]):
                continue
            held.append(columns)
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            group = whole[0] & ~rest
            cut = np.searchsorted(group, group[-1])
            if cut or len(group) > PORTION * 64:  # beyond that a block goes on in parts
                cut = cut or len(group)
                yield part([x[:cut] for x in whole])
                whole = [x[cut:] for x in whole]
            held = [whole] if len(whole[0]) else []
        if held:
            yield part([np.concatenate(x) for x in zip(*held, strict=True)])

    kind = "key long, class long, lead long, last long, s1 long, s2 long, m long"
    swept = written(dealt.sortWithinPartitions("packed", "class").mapInArrow(sweep, kind))
    marks = swept.where("m is not null").groupBy("key").agg(F.min("lead").alias("lead"), F.max("last").alias("last"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("m").alias("m")).where("lead < last")
    marks, found = written(marks), swept.select("key", "class")
    united = united_blocks(found, marks)
    apart = marks.join(united.select("lead").distinct(), "lead", "left_anti").unionByName(marks.where(F.col("m") < UNITE).join(united.select("lead").distinct(), "lead", "left_semi"))
    kept = apart.groupBy("lead", "last", "s1", "s2", "m").agg(F.min("key").alias("key")).select("key")
    out = written(found.join(kept, "key", "left_semi").unionByName(united.select(F.col("lead").bitwiseOR(1).alias("key"), "class")))
    for table in (swept, marks, united):
        drop(table)
    return out


def united_blocks(found: DataFrame, marks: DataFrame) -> DataFrame:
    """lead, class: blocks of UNITE rows or more that have their least class in common, as one block, where that has at
    most twice the rows of the largest of them: a passage or a group of copies makes many blocks that are nearly equal."""
    large = marks.where(F.col("m") >= UNITE).select("key", "lead", "m")
    rows = written(found.join(large, "key").select("lead", "class").distinct())
    most = large.groupBy("lead").agg(F.max("m").alias("m"))
    good = rows.groupBy("lead").agg(F.count("*").alias("n")).join(most, "lead").where("n <= 2 * m").select("lead")
    out = written(rows.join(good, "lead"))
    drop(rows)
    return out


# -------------------------------------------------------------------------------------------------- verification
def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, n, shingles for the wanted classes; wanted: class, __id of a document that has it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            found = list(map(np.unique, shingle_hashes(raw_texts(batch.column(1)), hashes)))
            own = [xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in found]
            # an id that occurs with several texts gives several sets; only that of the class counts, and once
            use = [i for i, (c, o) in enumerate(zip(batch.column(0).to_pylist(), own, strict=True)) if c == o and o not in seen]
            use = list({own[i]: i for i in use}.values())
            seen |= {own[i] for i in use} if len(seen) < 200_000 else set()
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in use], pa.int64()), pa.array([found[i].tobytes() for i in use], pa.binary())], ["class", "shingles"])

    texts = docs.join(wanted, "__id").select("class", "__text")
    return texts.mapInArrow(sets, "class long, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs a, b of similar classes, of those that fine counts leave.

    A lead b with many partners is dealt out in tiles, its set to each of them.
    """
    pairs = written(refined(pairs, known))
    used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    used = written(known.select("class", "__id").join(used, "class"))
    sets = written(shingle_sets(docs, used))
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tiles = written(pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int").alias("tile")))
    leads = tiles.select(F.col("b").alias("class"), "b", "tile", F.lit(0).alias("kind")).distinct()
    members = tiles.select(F.col("a").alias("class"), "b", "tile", F.lit(1).alias("kind"))
    dealt = leads.unionByName(members).join(sets, "class")
    parts = partitions(docs.sparkSession, tiles.count(), 20_000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for own, b, tile, kind, raw in zip(*(batch.column(i) for i in range(5)), strict=True):
                values = np.frombuffer(raw.as_py(), np.uint64)
                if kind.as_py() == 0:
                    at, lead = (b.as_py(), tile.as_py()), values
                elif at == (b.as_py(), tile.as_py()):
                    low, high = sorted((len(values), len(lead)))
                    if DEN * low >= NUM * high and similar(len(np.intersect1d(values, lead, assume_unique=True)), low, high):
                        out_a.append(own.as_py())
                        out_b.append(at[0])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = dealt.select("class", "b", "tile", "kind", "shingles").repartition(parts, "b", "tile").sortWithinPartitions("b", "tile", "kind")
    out = written(dealt.mapInArrow(compare, "a long, b long").distinct())
    for table in (pairs, used, sets, tiles):
        drop(table)
    return out


# ------------------------------------------------------------------------------------------------------- R-trees
class Node:
    """A box of points: the least and greatest sizes and the upper bound of each coordinate."""

    __slots__ = ("index", "below", "low", "high", "upper")

    def __init__(self, index: np.ndarray, n: np.ndarray, points: np.ndarray):
        self.low, self.high, self.upper = n[index].min(), n[index].max(), points[index].max(axis=0)
        self.index, self.below = index, []
        if len(index) > LEAF:
            spread = np.append(points[index].max(axis=0) - points[index].min(axis=0), self.high - self.low)
            axis = int(spread.argmax())
            values = n[index] if axis == points.shape[1] else points[index, axis]
            ranked = index[np.argsort(values, kind="stable")]
            half = len(index) // 2
            self.below = [Node(ranked[:half], n, points), Node(ranked[half:], n, points)]


def may_link(a: Node, b: Node) -> bool:
    """Whether sizes and the summed minima of the upper bounds leave room for a similar pair."""
    if NUM * a.low > DEN * b.high or NUM * b.low > DEN * a.high:
        return False
    return (NUM + DEN) * int(np.minimum(a.upper, b.upper).sum()) >= NUM * int(a.low + b.low)


def tree_join(n: np.ndarray, points: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places, one of left and one of right, that no bound rules out and that are of unlike groups."""
    same = left is right
    roots = Node(left, n, points), (Node(right, n, points) if not same else None)
    todo, out = [(roots[0], roots[0] if same else roots[1])], []
    while todo:
        a, b = todo.pop()
        if not may_link(a, b):
            continue
        if a.below or b.below:
            if a is b:
                todo += [(a.below[0], a.below[0]), (a.below[0], a.below[1]), (a.below[1], a.below[1])]
            elif a.below and (not b.below or len(a.index) >= len(b.index)):
                todo += [(x, b) for x in a.below]
            else:
                todo += [(a, x) for x in b.below]
            continue
        i, j = a.index[:, None], b.index[None, :]
        bound = np.minimum(points[i], points[j]).sum(axis=2)
        good = (group[i] != group[j]) & ((NUM + DEN) * bound >= NUM * (n[i] + n[j])) & (NUM * n[i] <= DEN * n[j]) & (NUM * n[j] <= DEN * n[i])
        if a is b:
            good &= i < j
        x, y = np.nonzero(good)
        out += zip(a.index[x].tolist(), b.index[y].tolist(), strict=True)
    return out


def small_join(n: np.ndarray, points: np.ndarray, group: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """What tree_join gives for each of many blocks (rows in their order) of no more than a leaf's rows."""
    out: list[tuple[int, int]] = []
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    lengths = np.diff(np.append(heads, len(block)))
    at, left = np.arange(len(block)), np.repeat(heads + lengths, lengths) - np.arange(len(block))
    step = 1
    while len(at := at[left > step]):
        left = left[left > step]
        to = at + step
        fits = (group[at] != group[to]) & (NUM * n[at] <= DEN * n[to]) & (NUM * n[to] <= DEN * n[at])
        i, j = at[fits], to[fits]
        bound = np.minimum(points[i], points[j]).sum(axis=1, dtype=np.int64)
        good = (NUM + DEN) * bound >= NUM * (n[i] + n[j])
        out += zip(i[good].tolist(), j[good].tolist(), strict=True)
        step += 1
    return out


def point_bytes(fine: np.ndarray) -> bytes:
    """GROUPS counts as bytes, or as wider numbers where one doesn't fit."""
    point = folded(fine, GROUPS)
    return point.astype(np.uint8 if point.max() < 256 else np.uint32).tobytes()


def point_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == GROUPS else np.uint32).astype(np.int32)


def nearest(found: list[tuple[int, int]], n: np.ndarray, points: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of places the one of each place whose summed minima are the largest share of both sizes."""
    if not found:
        return found
    i, j = np.array(found).T
    share = np.concatenate([np.minimum(points[i[at : at + 4096]], points[j[at : at + 4096]]).sum(axis=1) for at in range(0, len(i), 4096)]) / (n[i] + n[j])
    i, j, share = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
    order = np.lexsort((j, -share, i))
    first = order[np.append(True, i[order][1:] != i[order][:-1])]
    return list(zip(i[first].tolist(), j[first].tolist(), strict=True))


def surviving(tiles: DataFrame, parts: int, best: bool = False) -> DataFrame:
    """Distinct pairs a > b of classes of one tile, or of two tiles of one block, that the R-trees leave; with best only
    the nearest one of each class in each tile.

    tiles: key, t1, t2, side, class, component, n, point; a pair of tiles (t1 < t2) has rows of side 0 and of side 1.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(7)]
            columns.append(np.array([point_of(x) for x in batch.column(7).to_pylist()], np.int32).reshape(-1, GROUPS))
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            key, t1, t2 = columns[:3]
            if not len(key):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])) + 1
            last = cuts[-1] if len(cuts) else 0
            yield pairs(columns, np.append(0, cuts))
            rest = [c[last:] for c in columns]
        if rest is not None:
            yield pairs(rest, np.array([0, len(rest[0])]))

    def pairs(columns: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        side, own, comp, n, points = columns[3:]
        lengths = np.diff(edges)
        paired = np.add.reduceat(side, edges[:-1])[: len(lengths)] > 0 if len(lengths) else np.zeros(0, bool)
        small = (lengths <= LEAF) & ~paired
        block = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(np.repeat(small, lengths))
        found = [(at[i], at[j]) for i, j in small_join(n[at], points[at], comp[at], block[at])]
        for start, end in zip(edges[:-1][~small].tolist(), edges[1:][~small].tolist(), strict=True):
            here = np.arange(start, end)
            left, right = here[side[start:end] == 0], here[side[start:end] == 1]
            if len(left):
                some = tree_join(n, points, comp, left, right if len(right) else left)
                found += nearest(some, n, points) if best else some
        out = {(max(int(own[i]), int(own[j])), min(int(own[i]), int(own[j]))) for i, j in found}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    dealt = tiles.select("key", "t1", "t2", "side", "class", "component", "n", "point").repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    return dealt.mapInArrow(join, "a long, b long").distinct()


def tiled(members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """members (key, class, component, n) of blocks with several components, as pairs of tiles of about TILE rows; and
    the tables that this reads.

    A block of no more than TILE rows is one tile. A larger one is cut by size and then by chance; tiles whose sizes
    are too unlike are not paired, nor those that hold only classes of the block's largest component.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    facts = counts.groupBy("key").agg(F.sum("c").alias("rows"), F.count("*").alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("main")).where("kinds > 1")
    some = members.join(facts, "key")
    step = F.floor(F.log2("n") * 4).cast("long") * 2 + (F.col("component") == F.col("main")).cast("long")
    large = F.col("rows") > TILE
    some = written(some.select("key", "class", "component", "n", F.when(large, step).otherwise(-1).alias("step"), F.when(large, F.col("component") == F.col("main")).otherwise(False).alias("is_main")))
    sizes = some.where("step >= 0").groupBy("key", "step").agg(F.ceil(F.count("*") / TILE).alias("cuts"))
    spread = F.col("step") * (1 << 32) + F.pmod(F.xxhash64("class"), F.col("cuts"))
    numbered = some.join(sizes, ["key", "step"], "left").withColumn("t", F.when(F.col("step") < 0, F.lit(-1).cast("long")).otherwise(spread))
    numbered = written(numbered.select("key", "class", "component", "n", "is_main", "t"))
    bounds = numbered.groupBy("key", "t").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.bool_and("is_main").alias("is_main"))
    first, second = bounds.alias("x"), bounds.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.t") <= F.col("y.t")) & (NUM * F.col("y.low") <= DEN * F.col("x.high")) & (NUM * F.col("x.low") <= DEN * F.col("y.high"))
    both = written(first.join(second, near & ~(F.col("x.is_main") & F.col("y.is_main"))).select("x.key", F.col("x.t").alias("t1"), F.col("y.t").alias("t2")))
    rows = numbered.drop("is_main")
    one = both.join(rows.withColumnRenamed("t", "t1"), ["key", "t1"]).withColumn("side", F.lit(0))
    two = both.where("t1 < t2").join(rows.withColumnRenamed("t", "t2"), ["key", "t2"]).withColumn("side", F.lit(1))
    return one.unionByName(two), [some, numbered, both]


# ------------------------------------------------------------------------------------------------------ the join
def near_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the least key that links lead to), one row for each row of df."""
    with small_batches(df.sparkSession):
        rows, named = classes_named(df, key, text)
    out = rows.join(named, "class", "left")
    return out.select(F.col("__id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "__id").alias("component_id"))


def classes_named(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """__id, n, class of each row; and component_id of each class."""
    docs = df.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    full = written(described(docs, *heavy_levels(docs)))
    shared = blocks(full)
    classes = full.where("class is not null").groupBy("class").agg(F.min("__id").alias("__id"))
    wanted = shared.select("class").distinct()
    vectors = full.where("fine is not null").select("class", "n", "fine").join(wanted, "class").groupBy("class").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    known = written(classes.join(vectors, "class"))
    rows = written(full.select("__id", "n", "class"))
    drop(full)
    members = written(shared.join(known.select("class", "n"), "class"))
    drop(shared)

    links = verified(stars(members), docs, known)
    for best in (True, False):
        links = written(links.unionByName(searched(members, links, docs, known, best)))
    found = written(components(links))
    for table in (members, known, links):
        drop(table)
    classes = rows.where("class is not null").groupBy("class").agg(F.min("__id").alias("__id"))
    labels = labelled(classes, found)
    roots = labels.groupBy("component").agg(F.min("__id").alias("component_id"))
    return rows, labels.join(roots, "component").select("class", "component_id")


def searched(members: DataFrame, links: DataFrame, docs: DataFrame, known: DataFrame, best: bool) -> DataFrame:
    """The links that R-trees over the blocks find between what links leave apart."""
    near = around(links)
    labels = labelled(known.select("class"), near)
    tiles, tables = tiled(members.join(labels, "class"))
    parts = partitions(docs.sparkSession, members.count(), 50_000)
    pairs = written(surviving(tiles.join(pointed(known), "class"), parts, best))
    for table in (near, *tables):
        drop(table)
    out = verified(pairs, docs, known)
    drop(pairs)
    return out


def around(links: DataFrame) -> DataFrame:
    """node, component of each node of a link, written: the least node within two links, and of what has the same one, the
    least within two links between such groups.

    Nodes with one label are connected, though not all that are connected have one: enough to leave pairs out by, and for
    groups around one centre, or around centres that lie near each other, the same as the whole components, for a few
    shuffles.
    """
    first = written(least_near(links))
    ends = [first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    apart = written(links.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    second = least_near(apart).select(F.col("node").alias("component"), F.col("component").alias("least"))
    out = written(first.join(second, "component", "left").select("node", F.coalesce("least", "component").alias("component")))
    drop(first)
    drop(apart)
    return out


def least_near(links: DataFrame, hops: int = 2) -> DataFrame:
    """node, component: the least node within so many links of each node of a link."""
    there = links.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x in "ab" for y in "ab"])).alias("e")).select("e.node", "e.other")
    found = there.groupBy("node").agg(F.min("other").alias("component"))
    for _ in range(hops - 1):
        found = there.join(found.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("component"))
    return found


def pointed(known: DataFrame) -> DataFrame:
    """class, point."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [point_bytes(fine_of(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.binary())], ["class", "point"])

    return known.select("class", "fine").mapInArrow(fold, "class long, point binary")


def labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes with component; a class without links is its own."""
    return classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def stars(members: DataFrame, turns: int = ROUNDS) -> DataFrame:
    """a, b: each class with the class that leads most of its blocks, in each turn, where sizes allow it.

    In the first turn a block is led by the class that meets most others for its size, as the text that copies were
    made from does, in the second by the one that meets most others, then by those with the least hashes.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    ranked = members.join(sizes, "key").groupBy("class").agg(F.sum("m").alias("degree"), F.first("n").alias("n"))
    ranked = written(ranked)
    placed = members.select("key", "class").join(ranked, "class")
    ranks = [F.col("degree") / F.col("n"), F.col("degree").cast("double")] + [F.xxhash64(F.lit(i), "class").cast("double") for i in range(2, turns)]
    first = [F.max(F.struct(rank.alias("r"), "class", "n")).alias(f"l{i}") for i, rank in enumerate(ranks)]
    leads = placed.groupBy("key").agg(*first)
    leads = written(leads)
    leads = leads.select("key", F.array(*[F.struct(F.lit(i).alias("turn"), F.col(f"l{i}.class").alias("lead"), F.col(f"l{i}.n").alias("size")) for i in range(turns)]).alias("leads"))
    led = members.join(leads, "key").select("class", "n", F.explode("leads").alias("x")).where((F.col("class") != F.col("x.lead")) & (NUM * F.col("n") <= DEN * F.col("x.size")) & (NUM * F.col("x.size") <= DEN * F.col("n")))
    counts = led.groupBy("class", "x.turn", "x.lead").agg(F.count("*").alias("c")).groupBy("class", "turn").agg(F.max(F.struct("c", "lead")).alias("best"))
    return counts.select(F.col("class").alias("a"), F.col("best.lead").alias("b")).distinct()


def refined(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs a, b that the summed minima of fine counts leave."""

    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for na, fa, nb, fb in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                bound = fine_bound(fine_of(fa.as_py()), fine_of(fb.as_py()))
                good.append((NUM + DEN) * bound >= NUM * (na.as_py() + nb.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = known.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    two = known.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "fa", "nb", "fb")
    return both.mapInArrow(room, "a long, b long")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that have a smaller key in their component; all its columns."""
    found = near_components(df, key, text).where(F.col(key) > F.col("component_id")).select(key).distinct()
    return df.join(found, key, "left_anti").select(df.columns)

