"""Pieces: learning a vocabulary by byte pair merges, decoding, round trips, reports on a vocabulary.

Only the table of words with their counts is needed for learning; Spark counts it. Each round joins the most frequent
adjacent pair. A small table is learned from on the driver; a large one stays on the executors in blocks, and the driver
only holds the counts of pairs, which the vocabulary bounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.operators.tokens import SPECIAL
from weftcorpus.session import cut

# The mark of a word's beginning, characters of the longest piece, share of characters that get a piece.
SPACE, LONGEST, CHARACTERS = "▁", 16, 0.9995
BYTES = [f"<0x{i:02X}>" for i in range(256)]


def word_table(df: DataFrame, words: str, most: int = 2_000_000) -> list[tuple[str, int]]:
    """The words with their counts, most frequent first (ties by word); more than ``most`` distinct ones are an error."""
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rows = counts.orderBy(F.desc("n"), "word").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"there are more than {most} distinct words")
    return [(r["word"], r["n"]) for r in rows]


def alphabet(table: list[tuple[str, int]], share: float = CHARACTERS) -> list[str]:
    """The characters that make up the given share of all, most frequent first."""
    counts: dict[str, int] = defaultdict(int)
    for word, n in table:
        for c in SPACE + word:
            counts[c] += n
    total, running, out = sum(counts.values()), 0, []
    for c, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if running >= share * total:
            break
        out.append(c)
        running += n
    return out


def learned(table: list[tuple[str, int]], vocabulary: int, share: float = CHARACTERS) -> list[str]:
    """The pieces by id: special ones, bytes, then joins in the order they were learned, then characters.

    Of equally frequent pairs the first in order is joined; a pair that occurs once only, or whose piece would be
    too long, isn't. Fewer pieces come out where there are no more pairs.
    """
    characters = alphabet(table, share)
    known = set(characters)
    room = vocabulary - len(SPECIAL) - len(BYTES) - len(characters)
    if room < 0:
        raise ValueError("the vocabulary has no room for the characters")
    words = [([c for c in SPACE + w], n) for w, n in table]
    counts: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)

    def add(i: int, sign: int) -> None:
        parts, n = words[i]
        for pair in zip(parts, parts[1:], strict=False):
            counts[pair] += sign * n
            if sign > 0:
                where[pair].add(i)

    for i in range(len(words)):
        add(i, 1)
    joins: list[str] = []
    made: set[str] = set()
    usable = lambda p: p[0] in known and p[1] in known and len(p[0]) + len(p[1]) <= LONGEST
    while len(joins) < room:
        best = max((p for p, n in counts.items() if n > 1 and usable(p)), key=lambda p: (counts[p], [-ord(c) for c in p[0] + "\x00" + p[1]]), default=None)
        if best is None:
            break
        piece = best[0] + best[1]
        if piece not in made and piece not in known:
            joins.append(piece)
            made.add(piece)
        known.add(piece)
        for i in where.pop(best):
            parts, n = words[i]
            if not any(pair == best for pair in zip(parts, parts[1:], strict=False)):
                continue
            add(i, -1)
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == best:
                    out.append(piece)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            words[i] = (out, n)
            add(i, 1)
        counts.pop(best, None)
    return [*SPECIAL, *BYTES, *joins, *characters]


# Words learned from on the driver; more are learned from in blocks on the executors.
LOCAL_WORDS = 200_000
#: Symbols of a block that are none: a character without a piece, the end of a word.
DEAD, END = 65_535, 65_534
#: Words of a block, and rounds after which blocks are written anew, so that no more joins have to be done again.
BLOCK_WORDS, ROUNDS = 100_000, 12


def word_counts(df: DataFrame, words: str) -> DataFrame:
    """word, n: the distinct words of all rows with their counts, however many there are, written once."""
    return cut(df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")))


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words, each with its mark before it and a 0 after it, and how many each word has with both."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"{SPACE}{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, lengths


def _characters(counts: DataFrame, share: float) -> list[str]:
    """alphabet() of a table of words in Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, lengths = _symbols(batch.column(0).to_pylist())
            weights = np.repeat(np.asarray(batch.column(1)), lengths)
            weights[np.cumsum(lengths) - 1] = 0
            found, place = np.unique(points, return_inverse=True)
            sums = np.bincount(place, weights, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[sums > 0].astype(np.int64)), pa.array(sums[sums > 0])], ["c", "n"])

    sums = counts.mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    total, running, out = sum(r["n"] for r in sums), 0, []
    for r in sorted(sums, key=lambda r: (-r["n"], r["c"])):
        if running >= share * total:
            break
        out.append(chr(r["c"]))
        running += r["n"]
    return out


def _joined(symbols: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    """symbols with each a, b joined to c, from left to right."""
    at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
    if a == b and len(at):
        first = np.append(True, at[1:] != at[:-1] + 1)
        rank = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        at = at[rank % 2 == 0]
    if not len(at):
        return symbols
    symbols, stay = symbols.copy(), np.ones(len(symbols), bool)
    symbols[at], stay[at + 1] = c, False
    return symbols[stay]


def _pairs(symbols: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """How often each pair of symbols stands, at first * most + second; float64 holds counts below 2**53 exactly."""
    ends = np.flatnonzero(symbols == END)
    weights = np.repeat(n, np.diff(ends, prepend=-1))[:-1]
    real = (symbols[:-1] < most) & (symbols[1:] < most)
    return np.bincount(symbols[:-1][real].astype(np.int64) * most + symbols[1:][real], weights[real], most * most)


def _blocks(counts: DataFrame, characters: list[str]) -> DataFrame:
    """s, n: the symbols of blocks of words (16 bits each, a word's end after it), and their counts."""
    ids = {ord(c): i for i, c in enumerate(characters)}

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(words: list[str], n: list[np.ndarray]) -> pa.RecordBatch:
            points, lengths = _symbols(words)
            found, place = np.unique(points, return_inverse=True)
            symbols = np.array([ids.get(int(p), DEAD) for p in found], np.uint16)[place]
            symbols[np.cumsum(lengths) - 1] = END
            return pa.RecordBatch.from_arrays([pa.array([symbols.tobytes()], pa.binary()), pa.array([np.concatenate(n).tobytes()], pa.binary())], ["s", "n"])

        words, n = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            n.append(np.asarray(batch.column(1)).astype(np.int64))
            if len(words) >= BLOCK_WORDS:
                yield made(words, n)
                words, n = [], []
        if words:
            yield made(words, n)

    return cut(counts.select("word", "n").mapInArrow(block, "s binary, n binary"))


def _replayed(blocks: DataFrame, joins: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, n in zip(batch.column(0), batch.column(1), strict=True):
                symbols = np.frombuffer(s.as_py(), np.uint16)
                for join in joins:
                    symbols = _joined(symbols, *join)
                yield pa.RecordBatch.from_arrays([pa.array([symbols.tobytes()], pa.binary()), pa.array([n.as_py()], pa.binary())], ["s", "n"])

    return cut(blocks.mapInArrow(run, "s binary, n binary"))


def _changes(blocks: DataFrame, before: list[tuple[int, int, int]], joins: list[tuple[int, int, int]], most: int) -> np.ndarray:
    """What joins change in the counts of pairs, after those before; without any, the counts themselves. A task gives
    the pairs that change in its blocks, of which there are at most most * most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most * most)
        for batch in batches:
            for s, n in zip(batch.column(0), batch.column(1), strict=True):
                symbols, weights = np.frombuffer(s.as_py(), np.uint16), np.frombuffer(n.as_py(), np.int64)
                for join in before:
                    symbols = _joined(symbols, *join)
                if joins:
                    total -= _pairs(symbols, weights, most)
                    for join in joins:
                        symbols = _joined(symbols, *join)
                total += _pairs(symbols, weights, most)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], ["at", "n"])

    out = np.zeros(most * most)
    for r in blocks.mapInArrow(run, "at binary, n binary").collect():
        out[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.float64)
    return out


def learned_in_blocks(counts: DataFrame, vocabulary: int, share: float = CHARACTERS) -> list[str]:
    """learned() of a table of words in Spark: words stay there, in blocks, and the driver holds the counts of pairs.

    A round does the best join, and those after it that it can't change: a join a, b takes from pairs x, a and b, y only,
    and what it makes is at most as frequent as these. So joins go on while the next pair is none of these and more
    frequent than all of them. A join that makes a known piece anew ends its round.
    """
    characters = _characters(counts, share)
    room = vocabulary - len(SPECIAL) - len(BYTES) - len(characters)
    if room < 0:
        raise ValueError("the vocabulary has no room for the characters")
    names, most = list(characters), len(characters) + room
    ids = {c: i for i, c in enumerate(names)}
    blocks = _blocks(counts, characters)
    pairs, done, rounds = _changes(blocks, [], [], most), [], 0
    while len(names) < most:
        sizes = np.zeros(most, np.int64)
        sizes[: len(names)] = [len(x) for x in names]
        usable = np.where(sizes[:, None] + sizes[None, :] <= LONGEST, pairs.reshape(most, most), 0)
        lead, trail = usable.max(axis=1), usable.max(axis=0)  # of the pairs that a symbol is first or second of
        flat = usable.ravel()
        least = max(2, np.partition(flat, -min(64, flat.size))[-min(64, flat.size)])  # with all pairs as frequent as the last of these
        best = [(flat[i], [-ord(c) for c in names[i // most] + "\x00" + names[i % most]], i // most, i % most) for i in np.flatnonzero(flat >= least).tolist()]
        best.sort(reverse=True)
        joins, bound = [], 0
        for n, _, a, b in best:
            if joins and (n <= bound or any(b == j[0] or a == j[1] for j in joins)):
                break
            piece = names[a] + names[b]
            fresh = piece not in ids
            if fresh:
                ids[piece] = len(names)
                names.append(piece)
            joins.append((a, b, ids[piece]))
            bound = max(bound, trail[a], lead[b])
            if not fresh or len(names) >= most:
                break
        if not joins or len(names) >= most:
            break
        pairs += _changes(blocks, done, joins, most)
        done, rounds = done + joins, rounds + 1
        if rounds % ROUNDS == 0:
            blocks, done = _replayed(blocks, done), []
    return [*SPECIAL, *BYTES, *names[len(characters) :], *characters]


def collected(counts: DataFrame) -> list[tuple[str, int]] | None:
    """The table of words on the driver, in the order of word_table(), if it is small."""
    rows = counts.orderBy(F.desc("n"), "word").limit(LOCAL_WORDS + 1).collect()
    return [(r["word"], r["n"]) for r in rows] if len(rows) <= LOCAL_WORDS else None


def learned_from(counts: DataFrame, vocabulary: int, share: float = CHARACTERS) -> list[str]:
    """The pieces learned from word_counts(), of any size."""
    table = collected(counts)
    return learned_in_blocks(counts, vocabulary, share) if table is None else learned(table, vocabulary, share)


def sweep_from(counts: DataFrame, sizes: list[int], share: float = CHARACTERS) -> dict[int, list[str]]:
    """sweep() of word_counts(), of any size."""
    table = collected(counts)
    if table is not None:
        return sweep(table, sizes, share)
    return _sweep(len(_characters(counts, share)), sizes, lambda n: learned_in_blocks(counts, n, share))


def sweep(table: list[tuple[str, int]], sizes: list[int], share: float = CHARACTERS) -> dict[int, list[str]]:
    """Vocabularies of several sizes from one learning: a smaller one has the first joins of a larger one.

    Sizes without room for the characters, or beyond the joins that there are, are left out; none left is an error.
    """
    return _sweep(len(alphabet(table, share)), sizes, lambda n: learned(table, n, share))


def _sweep(characters: int, sizes: list[int], learn: Callable[[int], list[str]]) -> dict[int, list[str]]:
    fixed = len(SPECIAL) + len(BYTES) + characters
    feasible = [n for n in sizes if n >= fixed]
    if not feasible:
        raise ValueError("no vocabulary of these sizes can be learned")
    most = learn(max(feasible))
    joins = most[len(SPECIAL) + len(BYTES) : len(most) - characters]
    return {n: [*SPECIAL, *BYTES, *joins[: n - fixed], *most[len(most) - characters :]] for n in feasible if n - fixed <= len(joins)}


def scores(pieces: list[str]) -> dict[str, float]:
    """Pieces that joins make, with scores that fall in the order they were learned."""
    return {p: -float(i) for i, p in enumerate(pieces) if i >= len(SPECIAL) + len(BYTES) and len(p) > 1}


def as_table(spark, pieces: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, p, -float(i)) for i, p in enumerate(pieces)], "id int, piece string, score double")


def checked(pieces: list[str], most: int = 65_536) -> list[str]:
    """The pieces, if ids fit in 16 bits, the end mark is there, and there are 256 bytes; else an error."""
    if len(pieces) > most:
        raise ValueError("ids don't fit in 16 bits")
    if "</s>" not in pieces or sum(p.startswith("<0x") for p in pieces) != 256 or len(set(pieces)) != len(pieces):
        raise ValueError("the vocabulary lacks its end mark or bytes, or names a piece twice")
    return pieces


def decoded(ids: Column, pieces: list[str]) -> Column:
    """The text that ids stand for: special pieces stand for nothing, bytes are joined, word marks become spaces."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = [b"" if i < len(SPECIAL) else bytes([int(p[3:5], 16)]) if i < len(SPECIAL) + 256 else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for batch in batches:
            texts = [None if row is None else b"".join(raw[i] for i in row).decode("utf-8", "replace") for row in batch.to_pylist()]
            yield pa.array([None if t is None else t[1:] if t.startswith(" ") else t for t in texts], pa.string())

    return arrow_udf(run, "string")(ids)


def example(df: DataFrame, key: str, text: str, ids: str, words: str, pieces: list[str]) -> DataFrame:
    """key, n_tokens, n_words, tokens_per_word, unk, whole_words, roundtrip_ok: worked examples of an encoding.

    The round trip is that of the text's words with single spaces, which is what is encoded.
    """
    size, n = F.size(ids), F.size(words)
    unknown = F.size(F.filter(ids, lambda x: x == SPECIAL.index("<unk>")))
    plain = F.array_join(words, " ")
    return df.select(key, size.cast("long").alias("n_tokens"), n.cast("long").alias("n_words"), (size / F.greatest(n, F.lit(1))).alias("tokens_per_word"), unknown.cast("long").alias("unk"), (decoded(F.col(ids), pieces) == plain).alias("roundtrip_ok"))


def report(examples: DataFrame, df: DataFrame, chars: str) -> DataFrame:
    """documents, words, tokens, unknown, tokens per word, characters per token, round trips that hold."""
    sums = examples.agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"), F.sum("unk").alias("unk"), F.count_if("roundtrip_ok").alias("roundtrips"))
    total = df.agg(F.sum(chars).alias("c"))
    both = sums.join(F.broadcast(total))  # one row each
    return both.select("documents", "words", "tokens", "unk", F.round(F.col("tokens") / F.col("words"), 6).alias("fertility"), F.round(F.col("c") / F.col("tokens"), 6).alias("chars_per_token"), F.round(F.col("unk") / F.col("tokens"), 8).alias("unk_rate"), "roundtrips")
