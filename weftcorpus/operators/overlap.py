"""Overlap of two collections by titles, whole paragraphs and near copies; exact Jaccard; where texts come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.functions.text import canonical_form, lines, n_words, norm_title, trim_ws
from weftcorpus.operators import near, segment
from weftcorpus.session import cut

# Words of a paragraph, paragraphs that a verdict needs, shares that make it, likeness of near copies.
PARAGRAPH_WORDS, POWER, NEAR_HIGH, EXACT_HIGH, NEAR_PARTIAL, NEAR_AT = 12, 400, 0.25, 0.10, 0.05, 0.80


def paragraphs(df: DataFrame, key: str, text: str, least: int = PARAGRAPH_WORDS) -> DataFrame:
    """key, pos, paragraph, hash: the lines of at least so many words, and the hash of their canonical form."""
    each = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("paragraph", trim_ws(F.col("line")))
    return each.where(n_words(F.col("paragraph")) >= least).select(key, "pos", "paragraph", F.sha2(canonical_form(F.col("paragraph")), 256).alias("hash"))


def first_of_each(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each key, in an order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__k") <= most).drop("__k")


def titles(df: DataFrame, title: Column, identifier: str) -> DataFrame:
    """title, identifier: normalised titles that aren't empty, with the first identifier that has each."""
    rows = df.select(norm_title(title).alias("title"), F.col(identifier).alias("identifier")).where("title <> ''")
    return rows.groupBy("title").agg(F.min("identifier").alias("identifier"))


def marker_titles(df: DataFrame, text: str, marker: str = segment.MARKER) -> DataFrame:
    """title: the distinct normalised titles of marker lines."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{marker}[ \t]*(.*?)[ \t-]*$"), F.lit(1))
    return df.select(F.explode(found).alias("t")).select(norm_title(F.col("t")).alias("title")).where("title <> ''").distinct()


def membership(rows: DataFrame, index: DataFrame, key: str = "hash") -> DataFrame:
    """rows, found: how many rows there are, and how many of them, repeated ones too, have a key that index has."""
    marked = rows.join(index.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("rows"), F.count_if(F.col("__in")).alias("found"))


def verdict(archive: Column, corpus: Column, exact_rate: Column, near_rate: Column, power: int = POWER) -> Column:
    """INCONCLUSIVE below so many paragraphs on either side; else HIGH, PARTIAL or LOW."""
    few = (archive < power) | (corpus < power)
    return F.when(few, "INCONCLUSIVE").when((near_rate >= NEAR_HIGH) | (exact_rate >= EXACT_HIGH), "HIGH").when(near_rate >= NEAR_PARTIAL, "PARTIAL").otherwise("LOW")


def near_hits(archive: DataFrame, corpus: DataFrame, threshold: float = NEAR_AT, bands: int = 32, rows: int = 4) -> DataFrame:
    """id, other, score: paragraphs of archive (id, canon) with the one of corpus that is most like them, from threshold on.

    Canonical forms are compared, and all candidates are looked at.
    """
    sign = lambda df: cut(df.select("id", near.minhash(F.col("canon")).alias("signature")))
    found = near.matches(sign(archive), sign(corpus), threshold, bands, rows)
    return found.groupBy("id").agg(F.max_by("other", F.struct("score", F.col("other"))).alias("other"), F.max("score").alias("score"))


def best_pairs(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k pairs of the highest scores; ties by id."""
    return pairs.orderBy(F.desc("score"), "id", "other").limit(k)


def shingles(canon: Column, k: int = 5) -> Column:
    """array<string> of the distinct k-grams of characters; of the whole text where it is shorter; none if empty."""
    several = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(canon) - (k - 1), F.lit(1))), lambda i: F.substring(canon, i, k)))
    return F.when(F.length(canon) == 0, F.array().cast("array<string>")).otherwise(several)


def jaccard_pairs(df: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """id, other (id < other), common, jaccard of rows whose sets (array without repeats) are similar enough, exactly.

    Similar sets share one of the first n - ceil(n * threshold) + 1 items of both in any common order. In the order of
    how many rows have an item, those are the rare ones, so rows meet by rare items only; the rest is verified.
    """
    sets = df.select(F.col(key).alias("id"), F.col(items).alias("s"), F.size(items).alias("n")).where("n > 0")
    each = sets.select("id", "n", F.explode("s").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    # items of one row come first in the order, and meet nothing
    ranked = each.join(shared, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "item"))).alias("r"))
    room = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1 - (F.col("n") - F.size("r"))
    first = ranked.select("id", "n", F.explode(F.slice("r", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("x")).select("id", "n", "x.item")
    two = first.select(F.col("id").alias("other"), F.col("n").alias("m"), "item")
    met = first.join(two, "item").where((F.col("id") < F.col("other")) & (F.col("n") >= F.lit(threshold) * F.col("m")) & (F.col("m") >= F.lit(threshold) * F.col("n"))).select("id", "other").distinct()
    both = met.join(sets.select("id", "s", "n"), "id").join(sets.select(F.col("id").alias("other"), F.col("s").alias("t"), F.col("n").alias("m")), "other")
    counted = both.withColumn("common", F.size(F.array_intersect("s", "t")).cast("long"))
    share = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    return counted.withColumn("jaccard", share).where(F.col("jaccard") >= threshold).select("id", "other", "common", "jaccard")


def unit_reason(repeated: Column, words: Column, label: Column, reject: str | None, least: int = 3) -> Column:
    """Why a unit stays out of packs: a copy of one before it, too short, another language; else null."""
    c = F.when(repeated, "unit_exact_duplicate").when(words < least, "unit_too_short")
    return c.when(label == reject, f"unit_langid_{reject}") if reject else c


def deduplicated_units(units: DataFrame, order: list[str], text: str, label: str | None = None, reject: str | None = None) -> DataFrame:
    """units with reason: of units with one canonical form the first in the order goes on.

    Packs of the same units begin elsewhere and are never equal, so copies go before packing. The first is found by
    an aggregate, which combines on each task.
    """
    hashed = units.withColumn("__h", F.sha2(canonical_form(F.col(text)), 256))
    firsts = hashed.groupBy("__h").agg(F.min(F.struct(*order)).alias("__first"))
    joined = hashed.join(firsts, "__h")
    why = unit_reason(F.struct(*order) != F.col("__first"), n_words(F.col(text)), F.col(label) if label else F.lit(None).cast("string"), reject)
    return joined.withColumn("reason", why).drop("__h", "__first")


def disjoint(rows: DataFrame, key: str, split: str, order: list[str]) -> DataFrame:
    """rows without those whose key an earlier split has: none of train in val, none of both in test."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    firsts = rows.groupBy(key).agg(F.min(rank).alias("__rank"))
    return rows.join(firsts, key).where(rank == F.col("__rank")).drop("__rank")


def attributed(rows: DataFrame, manifest: DataFrame, key: str = "hash", folder: str | None = None) -> DataFrame:
    """rows with attributed_source and how it was found: by its folder, else by its hash in the manifest (key, source)."""
    known = manifest.groupBy(key).agg(F.min("source").alias("__by_hash"))
    joined = rows.join(known, key, "left")
    by_folder = F.col(folder) if folder else F.lit(None).cast("string")
    how = F.when(by_folder.isNotNull(), "folder").when(F.col("__by_hash").isNotNull(), "hash").otherwise("unmatched")
    return joined.withColumn("attributed_source", F.coalesce(by_folder, F.col("__by_hash"))).withColumn("how", how).drop("__by_hash")
