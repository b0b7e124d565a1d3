"""Gates: one column of reasons, null where a document is accepted. The order of the rules is their priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcorpus.functions.text import NOT_WS, counts_of, ratio


@dataclass(frozen=True)
class Gate:
    """Fixed values of one source of documents. accept: only this label; otherwise all but reject are kept."""

    min_words: int
    min_ratio: float
    reject: str | None = None
    accept: str | None = None
    min_score: float | None = None
    keep_undecided: bool = True


GATES = {
    "news_mr": Gate(120, 0.60, "kok", "mr", 0.30, False),
    "news_kok": Gate(60, 0.60, "mr", "kok", 0.30, False),
    "resolutions": Gate(60, 0.55, None, "mr", 0.30, False),
    "web_mr": Gate(40, 0.70, "kok"),
    "books": Gate(40, 0.80, "mr", None, 0.20),
    "archive_books": Gate(60, 0.70, "mr"),
    "hub": Gate(25, 0.70, "mr"),
    "web_kok": Gate(25, 0.70, "mr"),
    "wiki": Gate(50, 0.80, "mr"),
}


def reason(gate: Gate, n_words: Column, share: Column, label: Column, score: Column, script: str = "devanagari") -> Column:
    """Why a document is rejected; null if it is not."""
    c = F.when(n_words < gate.min_words, "too_short").when(F.coalesce(share, F.lit(0.0)) < gate.min_ratio, f"not_enough_{script}")
    if gate.reject:
        c = c.when(label == gate.reject, f"langid_{gate.reject}_rejected")
    if gate.accept:
        c = c.when(label != gate.accept, F.concat(F.lit("langid_"), label))
    if gate.min_score is not None:
        weak = F.abs(score) < gate.min_score
        c = c.when(weak if not gate.keep_undecided else weak & (label != "undecided"), "langid_low_confidence")
    return c


def fixture_gate(docs: DataFrame) -> DataFrame:
    """The fixtures' documents with a reason: 40 words, 70 % Latin letters, no Spanish, English only."""
    counts = counts_of(F.col("text"), "[A-Za-z]", NOT_WS)
    latin = ratio(counts[0], counts[1])
    gate = Gate(40, 0.70, "es", "en")
    return docs.withColumn("reason", reason(gate, F.col("n_words"), latin, F.col("lang"), F.lit(1.0), "latin"))


def histogram(gated: DataFrame) -> DataFrame:
    """Documents and words by reason; accepted ones count too."""
    return gated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


def date_ok(lastmod: Column, since: str) -> Column:
    """Not before since; a date that is missing or can't be read passes."""
    return F.coalesce(F.try_to_timestamp(lastmod) >= F.to_timestamp(F.lit(since)), F.lit(True))


def first_prefix(c: Column, prefixes: dict[str, str]) -> Column:
    """The reason of the first prefix that c starts with, else null."""
    out = F.lit(None).cast("string")
    for prefix, why in reversed(prefixes.items()):
        out = F.when(F.startswith(c, F.lit(prefix)), why).otherwise(out)
    return out
