"""Ingest plans: units to documents, gates, exact and near copies in their order, manifest rows and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcorpus.functions.text import n_words
from weftcorpus.operators import near
from weftcorpus.operators.gates import Gate
from weftcorpus.session import cut


def document_reason(gate: Gate, words: Column, share: Column, label: Column) -> Column:
    """Reasons of packed documents: too short, too little of the script, the rejected language."""
    c = F.when(words < gate.min_words, "doc_too_short").when(F.coalesce(share, F.lit(0.0)) < gate.min_ratio, "doc_not_devanagari")
    return c.when(label == gate.reject, F.lit(f"doc_langid_{'marathi' if gate.reject == 'mr' else gate.reject}")) if gate.reject else c


def wiki_page_reason(gate: Gate, words: Column, profile: Column, label: Column, all_scripts: bool = False) -> Column:
    """Reasons of wiki pages. Other scripts stay out unless all are asked for; the language is only judged in Devanagari.

    profile: struct of script_profile().
    """
    little = profile["devanagari_ratio"] < gate.min_ratio
    other = F.when(little & ~profile["script"].isin("Latin", "Kannada", "Mixed"), "script_not_recognised") if all_scripts else F.when(little, "not_devanagari_excluded")
    rejected = F.when((profile["script"] == "Devanagari") & (label == gate.reject), f"langid_{gate.reject}_rejected")
    return F.coalesce(F.when(words < gate.min_words, "too_short"), other, rejected)


def decided(df: DataFrame, key: str, text: str, why: Column, order: list, prefix: str = "", threshold: float = near.THRESHOLD) -> DataFrame:
    """df with reason: the gate's, else exact_duplicate or near_duplicate of a document before it that is kept; else null.

    Documents that the gate rejects are no one's original. Among the rest the first of equal canonical forms goes on
    to the near stage, where a document is dropped if it is like an earlier kept one.
    """
    gated = df.withColumn("__reason", why).withColumn("__ord", F.struct(*order))
    open_ = gated.where("__reason is null").where(F.col(text).isNotNull())
    # each open text is signed once, where it is read; what follows has no texts
    signed = cut(open_.select(F.col(key).alias("id"), F.col("__ord").alias("ord"), near.hashed_minhash(F.col(text)).alias("x")).select("id", "ord", "x.hash", "x.signature"))
    firsts = signed.groupBy("hash").agg(F.min("ord").alias("first"))
    ranked = signed.join(firsts, "hash").withColumn("copy", F.col("ord") != F.col("first"))
    near_copies = near.greedy(ranked.where("not copy").select("id", "ord", "signature"), threshold).where("keeper is not null").select(F.col("id").alias(key), F.lit(f"{prefix}near_duplicate").alias("__near"))
    copies = ranked.where("copy").select(F.col("id").alias(key), F.lit(f"{prefix}exact_duplicate").alias("__copy"))
    joined = gated.join(copies, key, "left").join(near_copies, key, "left")
    return joined.withColumn("reason", F.coalesce("__reason", "__copy", "__near")).drop("__reason", "__ord", "__copy", "__near")


def totals(df: DataFrame, dataset: str, text: str) -> DataFrame:
    """dataset, documents, words of accepted documents (reason null), and the total of all datasets (dataset null)."""
    accepted = df.where("reason is null").select(dataset, n_words(F.col(text)).alias("w"))
    return accepted.rollup(dataset).agg(F.count("*").alias("documents"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"))
