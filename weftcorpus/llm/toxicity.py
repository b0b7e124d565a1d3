"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

The lexicon is learned: words, and stems of words with an ending, that stand in toxic texts of a bounded labelled
sample far more often than chance allows; of near copies in the sample one is learned from. For each length of word a Levenshtein automaton accepts what is within its number of edits; all automata run
together over a trie of the lexicon, made deterministic as texts need it: a state of the product is the set of
(trie node, edits so far) that are still alive, and a token that leaves all of them is dropped at that character.
Every hit is weighed by its word, less for each edit, and by its window of tokens: quotation marks around it and
words of report or mention speak for quotation, second persons, further hits and exclamation for abuse. A logistic
function of sums of these and of their density gives the score.

Defined results: null and empty texts get the score of a text without hits. Texts are read whole, with work in
proportion to their length. Without labelled rows of both kinds (so also with empty tables) there is nothing to learn:
the lexicon is empty and all scores are the prior. Repeated rows get equal scores. Labels, languages, sources and keys
never enter a score, and other columns are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.llm.shared import written

#: At most so many labelled rows of each kind are learned from.
MAX_ROWS = 4_000
WINDOW = 8
#: A stem is marked by this at its end: at least one more character follows it.
TAIL = "*"
#: Letters of the shortest stem.
LEAST_STEM = 4
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»‹›!?]|\n\s*\n")
OPENING, CLOSING, PLAIN = set("“„«‹"), set("”»›"), '"'
#: Words that report or mention, and second persons, in English, French, German and Spanish.
REPORT = set("said says wrote writes called calls quote quoted quotes word term phrase reported allegedly dit disait écrit mot terme cite sagte sagt schrieb wort begriff zitat dijo dice escribió palabra término cita".split())
SECOND = set("you your yours yourself u ur tu te toi ton vous votre du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split())


def edits_for(word: str) -> int:
    """How many edits a misspelling of a word of the lexicon may have; a stem is taken as it is."""
    return 0 if len(word) < 4 or word.endswith(TAIL) else 1 if len(word) < 8 else 2


class LexiconAutomaton:
    """The intersection of the trie of a lexicon with the Levenshtein automata of its words, determinised lazily.

    A state maps each live trie node to the least number of edits it is reached with. Reading a character: it may be
    extra (stay), replace or match the character of an edge (go down), after any number of missing ones (go down
    without reading). A node is alive as long as a word below it allows its edits.
    """

    def __init__(self, words: list[str], limit: int = 200_000):
        self.limit = limit  # live nodes of all states that are kept; beyond that the states are made anew
        self.edges: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.allowed = [0]
        for w in sorted(set(words)):
            k = edits_for(w)
            node = 0
            self.allowed[0] = max(self.allowed[0], k)
            for ch in w:
                if ch not in self.edges[node]:
                    self.edges[node][ch] = len(self.edges)
                    self.edges.append({})
                    self.word.append(None)
                    self.allowed.append(0)
                node = self.edges[node][ch]
                self.allowed[node] = max(self.allowed[node], k)
            self.word[node] = w
        self.tails = {i for i, w in enumerate(self.word) if w and w.endswith(TAIL)}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.size = 0
        self.start = self.state(self.closed({0: 0}))

    def closed(self, live: dict[int, int]) -> dict[int, int]:
        """Also what is reached by characters that the token lacks."""
        todo = list(live)
        while todo:
            node = todo.pop()
            cost = live[node] + 1
            for below in self.edges[node].values():
                if cost <= self.allowed[below] and cost < live.get(below, 99):
                    live[below] = cost
                    todo.append(below)
        return live

    def state(self, live: dict[int, int]) -> int:
        key = tuple(sorted(live.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(live)
            self.size += len(live)
            self.moves.append({})
            ends = [(cost, self.word[n]) for n, cost in live.items() if self.word[n] and cost <= edits_for(self.word[n])]
            self.ends.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def step(self, at: int, ch: str) -> int:
        """The next state; -1 if no word can be reached."""
        live: dict[int, int] = {}
        for node, cost in self.sets[at].items():
            if cost + 1 <= self.allowed[node]:
                live[node] = min(cost + 1, live.get(node, 99))
            if node in self.tails:
                live[node] = min(cost, live.get(node, 99))
            for edge, below in self.edges[node].items():
                now = cost + (edge != ch and edge != TAIL)
                if now <= self.allowed[below] and now < live.get(below, 99):
                    live[below] = now
        to = self.state(self.closed(live)) if live else -1
        self.moves[at][ch] = to
        return to

    def match(self, token: str) -> tuple[str, int] | None:
        """The word of the lexicon within reach that takes the fewest edits (of these the first in order), and how many."""
        if self.size > self.limit:
            self.reset()
        at, moves = self.start, self.moves
        for ch in token:
            to = moves[at].get(ch)
            at = self.step(at, ch) if to is None else to
            if at < 0:
                return None
        return self.ends[at]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * 6)


class Scorer:
    def __init__(self, model: Model, memory: int = 200_000):
        self.model, self.memory = model, memory
        self.automaton = LexiconAutomaton(list(model.lexicon))
        self.seen: dict[str, tuple[str, int] | None] = {}

    def find(self, token: str) -> tuple[str, int] | None:
        hit = self.seen.get(token, 0)
        if hit == 0:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            hit = self.seen[token] = self.automaton.match(token) if self.model.lexicon else None
        return hit

    def features(self, text: str | None) -> tuple[list[float], int, int]:
        """[sum of abuse, largest hit, density, quoted, inexact], hits, inexact hits."""
        tokens = TOKEN.findall((text or "").lower())
        find = self.find
        hits = [(i, h) for i, t in enumerate(tokens) if (h := find(t))]
        if not hits:
            return [0.0] * 5, 0, 0
        places = np.array([i for i, _ in hits])
        beside = np.searchsorted(places, places + WINDOW, "right") - np.searchsorted(places, places - WINDOW) - 1
        quoted_at = self.quoted(tokens)
        abuse = largest = quoted = inexact = 0.0
        for (i, (word, edits)), near in zip(hits, beside.tolist(), strict=True):
            around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
            for_quote = 1.5 * quoted_at[i] + 0.75 * sum(t in REPORT for t in around)
            for_abuse = 0.5 + 0.5 * sum(t in SECOND for t in around) + 0.5 * near + 0.25 * sum(t == "!" for t in around)
            weight = self.model.lexicon[word] * (1.0 if not edits else 0.35**edits)
            share = 1 / (1 + math.exp(for_quote - for_abuse))
            abuse += weight * share
            largest = max(largest, weight * share)
            quoted += weight * (1 - share)
            inexact += weight * (edits > 0)
        density = 100 * abuse / (len(tokens) + 30)
        return [math.log1p(abuse), largest, math.log1p(density), math.log1p(quoted), math.log1p(inexact)], len(hits), sum(e > 0 for _, (_, e) in hits)

    @staticmethod
    def quoted(tokens: list[str]) -> list[bool]:
        """Which tokens stand between quotation marks, however far apart; a mark that is never closed encloses nothing.

        Of the plain mark, which opens and closes, one that is still open at the end of its paragraph is dropped.
        """
        out = [False] * len(tokens)
        opened = None
        for i, t in enumerate(tokens):
            if t in OPENING or t == PLAIN and opened is None:
                opened = i
            elif (t in CLOSING or t == PLAIN) and opened is not None:
                out[opened:i] = [True] * (i - opened)
                opened = None
            elif t[0] == "\n" and opened is not None and tokens[opened] == PLAIN:
                opened = None
        return out

    def score(self, features: list[float]) -> float:
        z = self.model.weights[0] + sum(w * x for w, x in zip(self.model.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled rows of each kind, those with the least hashes, with their whole texts."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("__y"))
    order = [F.xxhash64(F.lit(11), F.col(key)), F.col(key)]
    some = usable.where("__y = 1").orderBy(*order).limit(max_rows).union(usable.where("__y = 0").orderBy(*order).limit(max_rows))
    # bounded: two times max_rows keys
    return documents.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(some), key).dropDuplicates([key])


def distinct_texts(rows: DataFrame, key: str) -> DataFrame:
    """rows without texts that share one of three minima of shingle hashes with a row before them: near copies."""
    words = F.split(F.coalesce("__text", F.lit("")), r"\s+")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("__w", i, 5), " "))
    signed = rows.withColumn("__w", words).withColumn("__s", spans)
    for i in range(3):
        signed = signed.withColumn(f"__m{i}", F.array_min(F.transform("__s", lambda x, i=i: F.xxhash64(F.lit(i), x))))
    signed = signed.drop("__w", "__s")
    for i in range(3):
        signed = signed.withColumn(f"__r{i}", F.row_number().over(Window.partitionBy("__y", f"__m{i}").orderBy(key)))
    return signed.where("__r0 = 1 and __r1 = 1 and __r2 = 1").select(*rows.columns)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems by log-odds, where a likelihood ratio test, corrected for their number, rules out chance.

    A word counts in the texts that have it, a stem in those that have it with two endings or more. Every word that
    passes is taken, so that its misspellings are found; a stem is left out where a stronger one begins with it, or it
    with that.
    """
    counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("__text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    each = rows.withColumn("__d", F.xxhash64("__text")).select("__y", "__d", F.explode(tokens).alias("w"))
    words = each.select("__y", "w")
    stems = each.where(F.length("w") > LEAST_STEM).select("__y", "__d", "w", F.explode(F.sequence(F.lit(LEAST_STEM), F.length("w") - 1)).alias("n"))
    stems = stems.groupBy("__y", "__d", F.concat(F.substring("w", F.lit(1), F.col("n")), F.lit(TAIL)).alias("w")).count().where("count >= 2").select("__y", "w")
    found = words.unionByName(stems).groupBy("w").agg(F.sum("__y").cast("double").alias("a"), F.sum(1 - F.col("__y")).cast("double").alias("b"))
    found = found.where("a >= 3")
    p = (F.col("a") + F.col("b")) / (bad + good)

    def part(x: Column, n: Column) -> Column:
        return F.when(x > 0, x * F.log(x / n)).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), p * bad) + part(F.col("b"), p * good) + part(bad - F.col("a"), (1 - p) * bad) + part(good - F.col("b"), (1 - p) * good))
    odds = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (good + 1))
    found = found.withColumn("odds", odds).withColumn("ratio", ratio)
    total = found.count()
    strong = found.where((F.col("odds") > 1.5) & (F.col("ratio") > 2 * math.log(max(total, 2) / 0.05)))
    # bounded: words of the sample that pass the test
    best = strong.orderBy(F.desc("ratio"), F.desc(F.length("w")), "w").collect()
    lexicon: dict[str, float] = {}
    taken: list[str] = []
    for r in best:
        bare = r["w"].rstrip(TAIL)
        if r["w"].endswith(TAIL):
            if any(t.startswith(bare) or bare.startswith(t) for t in taken):
                continue
            taken.append(bare)
        lexicon[r["w"]] = float(r["odds"])
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.001, rounds: int = 40) -> np.ndarray:
    """Weights by Newton's method; every row weighs alike, so that clean texts, which are many, are left alone."""
    x = np.hstack([np.ones((len(x), 1)), x])
    each = np.full(len(y), 1 / len(y))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + penalty * w
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model of a sample of the labelled rows that are not held out: at most max_rows of each kind."""
    rows = written(distinct_texts(written(sample(documents, labels, key, text, label, max_rows)), key))
    model = Model(learn_lexicon(rows))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in parts:
            found = [scorer.features(t)[0] for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__y").cast(pa.float64()), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

    # bounded: two times max_rows rows of five numbers
    seen = rows.select("__y", "__text").mapInArrow(batches, "y double, x array<double>").collect()
    y = np.array([r["y"] for r in seen])
    if not len(y) or y.min() == y.max():
        return model
    model.weights = [float(v) for v in logistic(np.array([r["x"] for r in seen]), y)]
    return model


def scored(text: Column, model: Model) -> Column:
    """struct<score, predicted, hits, inexact> for each text."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            scores, hits, inexact = [], [], []
            for t in batch:
                x, n, m = scorer.features(t.as_py())
                scores.append(scorer.score(x))
                hits.append(n)
                inexact.append(m)
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, pa.int32()), pa.array(inexact, pa.int32())],
                ["score", "predicted", "hits", "inexact"],
            )

    return arrow_udf(score, "struct<score:double,predicted:int,hits:int,inexact:int>")(F.coalesce(text, F.lit("")))
