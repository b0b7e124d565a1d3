"""Duplicates, overlaps, splits and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.functions.text import canonical_form, content_hash, exact_hash, word_jaccard, words
from weftcorpus.operators import contamination, dedup, near
from weftcorpus.operators.provenance import with_provenance
from weftcorpus.plans.base import CANON, D, W, Register, documents, table
from weftcorpus.session import cut

REGISTER = Register()
add = REGISTER.add
HASHED = f"{D}, h AS (SELECT *, sha256({CANON}) AS hash FROM d)"


@add(f"SELECT doc_id, sha256({CANON}) AS hash, length({CANON})::BIGINT AS canon_chars FROM documents")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", exact_hash(F.col("text")).alias("hash"), F.length(canonical_form(F.col("text"))).cast("long").alias("canon_chars"))


@add("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("hash", exact_hash(F.col("text")))


ORDER = "ORDER BY is_manual DESC, source, doc_id"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(hashed(spark, sf_dir), "hash", [F.desc("is_manual"), "source", "doc_id"])


@add(f"WITH {HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY hash {ORDER}) AS k FROM h) SELECT doc_id, source, hash FROM r WHERE k = 1")
def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By an aggregate of narrow rows, which combines on each task."""
    first = F.min(F.struct((~F.col("is_manual")).alias("downloaded"), "source", "doc_id")).alias("x")
    return hashed(spark, sf_dir).groupBy("hash").agg(first).select("x.doc_id", "x.source", "hash")


@add(f"WITH {HASHED} SELECT hash, count(*)::BIGINT AS documents, min(doc_id) AS first_id, count(DISTINCT source)::BIGINT AS sources FROM h GROUP BY hash HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("sources")).where("documents > 1")


@add(f"WITH {HASHED}, r AS (SELECT row_number() OVER (PARTITION BY hash {ORDER}) AS k FROM h) SELECT count(*)::BIGINT AS seen, count(*) FILTER (WHERE k > 1)::BIGINT AS exact_duplicates, count(*) FILTER (WHERE k = 1)::BIGINT AS kept, round(count(*) FILTER (WHERE k > 1) / count(*), 6) AS duplicate_rate FROM r")
def dedup_stats_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).agg(F.count("*").alias("seen"), F.count_if(F.col("rank") > 1).alias("exact_duplicates"), F.count_if(F.col("rank") == 1).alias("kept"), F.round(F.count_if(F.col("rank") > 1) / F.count("*"), 6).alias("duplicate_rate"))


@add(f"WITH {HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY hash {ORDER}) AS k FROM h) SELECT source, count(*)::BIGINT AS before, count(*) FILTER (WHERE k > 1)::BIGINT AS removed FROM r GROUP BY source")
def removed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).groupBy("source").agg(F.count("*").alias("before"), F.count_if(F.col("rank") > 1).alias("removed"))


@add(f"WITH {HASHED}, x AS (SELECT hash FROM h WHERE is_manual INTERSECT SELECT hash FROM h WHERE NOT is_manual) SELECT hash FROM x")
def corpus_overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed(spark, sf_dir)
    return dedup.overlap(docs.where("is_manual"), docs.where("not is_manual"), "hash")


@add(f"WITH {HASHED}, s AS (SELECT DISTINCT source, hash FROM h) SELECT a.source AS source_a, b.source AS source_b, count(*)::BIGINT AS shared FROM s a JOIN s b ON a.hash = b.hash AND a.source < b.source GROUP BY 1, 2")
def overlap_by_source_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = hashed(spark, sf_dir).groupBy("hash").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.transform(F.slice("s", i + 1, F.size("s")), lambda b: F.struct(F.element_at("s", i).alias("source_a"), b.alias("source_b")))))
    return sources.select(F.explode(pairs).alias("p")).groupBy("p.source_a", "p.source_b").agg(F.count("*").alias("shared"))


@add(f"WITH {HASHED} SELECT doc_id FROM h WHERE NOT is_manual AND hash NOT IN (SELECT hash FROM h WHERE is_manual)")
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed(spark, sf_dir)
    return docs.where("not is_manual").join(docs.where("is_manual").select("hash"), "hash", "left_anti").select("doc_id")


# ------------------------------------------------------------------------------------------------------- splits
def unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("rank = 1")


SPLIT = f"""{HASHED}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash {ORDER}) AS k FROM h) WHERE k = 1),
o AS (SELECT *, count(*) OVER (PARTITION BY source, is_manual) AS n, row_number() OVER (PARTITION BY source, is_manual ORDER BY sha256('{dedup.SPLIT_SEED}:' || doc_id::VARCHAR), doc_id) AS r FROM u),
s AS (SELECT *, CASE WHEN n < 10 THEN 'train' WHEN r <= greatest(1, floor(n * 0.01)) THEN 'val' WHEN r <= 2 * greatest(1, floor(n * 0.01)) THEN 'test' ELSE 'train' END AS split FROM o)"""


@add(f"WITH {SPLIT} SELECT doc_id, source, split FROM s")
def stratified_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.split(unique_documents(spark, sf_dir), ["source", "is_manual"], "doc_id").select("doc_id", "source", "split")


@add(f"WITH {SPLIT} SELECT CASE WHEN grouping(source) = 1 THEN 'split' ELSE 'source' END AS scope, split, source, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words, coalesce(sum(n_words) FILTER (WHERE is_manual), 0)::BIGINT AS manual_words FROM s GROUP BY GROUPING SETS ((split), (split, source))")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dedup.split(unique_documents(spark, sf_dir), ["source", "is_manual"], "doc_id")
    sums = s.groupingSets([["split"], ["split", "source"]], "split", "source").agg(F.grouping("source").alias("g"), F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.coalesce(F.sum(F.when(F.col("is_manual"), F.col("n_words"))), F.lit(0)).alias("manual_words"))
    return sums.withColumn("scope", F.when(F.col("g") == 1, "split").otherwise("source")).drop("g")


@add(f"WITH {SPLIT}, m AS (SELECT split, coalesce(sum(n_words) FILTER (WHERE is_manual), 0) / sum(n_words) AS share FROM s GROUP BY split) SELECT split, round(share, 6) AS manual_share, share >= 0.2 AS meets_floor FROM m")
def split_manual_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dedup.split(unique_documents(spark, sf_dir), ["source", "is_manual"], "doc_id")
    share = F.coalesce(F.sum(F.when(F.col("is_manual"), F.col("n_words"))), F.lit(0)) / F.sum("n_words")
    return s.groupBy("split").agg(share.alias("x")).select("split", F.round("x", 6).alias("manual_share"), (F.col("x") >= 0.2).alias("meets_floor"))


@add(f"WITH {HASHED}, o AS (SELECT *, count(*) OVER (PARTITION BY source, is_manual) AS n, row_number() OVER (PARTITION BY source, is_manual ORDER BY sha256('{dedup.SPLIT_SEED}:' || doc_id::VARCHAR), doc_id) AS r FROM h), s AS (SELECT *, CASE WHEN n < 10 THEN 'train' WHEN r <= greatest(1, floor(n * 0.01)) THEN 'val' WHEN r <= 2 * greatest(1, floor(n * 0.01)) THEN 'test' ELSE 'train' END AS split FROM o) SELECT hash, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits FROM s GROUP BY hash HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of splits made without removing duplicates: what removal prevents."""
    s = dedup.split(hashed(spark, sf_dir), ["source", "is_manual"], "doc_id")
    return dedup.leaks(s, "hash").select("hash", F.array_join("splits", ",").alias("splits"))


CAP = 0.5


@add(f"WITH {D}, r AS (SELECT source, doc_id, sum(n_words) OVER (PARTITION BY source ORDER BY sha256('{dedup.SPLIT_SEED}:' || doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) AS running, sum(n_words) OVER (PARTITION BY source) AS total FROM d WHERE NOT is_manual) SELECT source, doc_id, running <= floor(total * {CAP}) AS kept FROM r")
def ratio_cap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.prefix_fit(documents(spark, sf_dir).where("not is_manual"), "source", "doc_id", "n_words", CAP)


@add(f"""WITH RECURSIVE {D}, o AS (SELECT source, doc_id, n_words, row_number() OVER (PARTITION BY source ORDER BY sha256('{dedup.SPLIT_SEED}:' || doc_id::VARCHAR), doc_id) AS r, floor(sum(n_words) OVER (PARTITION BY source) * {CAP}) AS budget FROM d WHERE NOT is_manual),
f AS (SELECT source, doc_id, r, budget, CASE WHEN n_words <= budget THEN n_words ELSE 0 END AS used, n_words <= budget AS kept FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.doc_id, o.r, o.budget, f.used + CASE WHEN f.used + o.n_words <= o.budget THEN o.n_words ELSE 0 END, f.used + o.n_words <= o.budget FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1)
SELECT source, doc_id, kept FROM f""")
def ratio_cap_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_fit(documents(spark, sf_dir).where("not is_manual"), "source", "doc_id", "n_words", CAP)


@add(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('{dedup.SPLIT_SEED}:' || doc_id::VARCHAR), doc_id) AS k, (SELECT count(*) FROM documents) AS n FROM documents) SELECT doc_id, k <= least(5000, n // 10) AS held_out FROM r")
def heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least seeded keys, up to a tenth of all or 5000; the threshold is one row, found by a bounded sort."""
    docs = table(spark, sf_dir, "documents").select("doc_id", dedup.seeded(F.col("doc_id")).alias("o"))
    n = min(5000, docs.count() // 10)
    last = docs.orderBy("o", "doc_id").limit(n).agg(F.max(F.struct("o", "doc_id")).alias("last"))
    return docs.join(F.broadcast(last)).select("doc_id", F.coalesce(F.struct("o", "doc_id") <= F.col("last"), F.lit(False)).alias("held_out"))


@add(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('20260816:' || doc_id::VARCHAR), doc_id) AS k FROM documents) SELECT doc_id, source, k::INT AS place FROM r WHERE k <= 10")
def reservoir_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(dedup.seeded(F.col("doc_id"), 20260816), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", place.alias("place")).where("place <= 10")


@add(f"WITH {D}, r AS (SELECT source, doc_id, n_words, coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT source, doc_id, n_words, before::BIGINT AS before FROM r WHERE before < 5000")
def word_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.until_budget(documents(spark, sf_dir).select("source", "doc_id", "n_words"), ["doc_id"], "n_words", 5000, "source")


@add(f"WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source, lang FROM r WHERE k = 1")
def first_by_source_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf_dir, "documents").select("doc_id", "source", "lang").withColumn("k", F.concat_ws("\x01", "source", "lang")), "k", ["doc_id"]).where("rank = 1").select("doc_id", "source", "lang")


@add(f"SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4 AS family FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1, F.lit(4)).cast("long").alias("family"))


# -------------------------------------------------------------------------------------------------- near copies
def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that exact removal keeps, with their signatures and order.

    All are signed where they are read, each once, so that no text is shuffled; of equal hashes the first row goes on.
    """
    docs = with_provenance(table(spark, sf_dir, "documents"))
    order = F.struct((~F.col("is_manual")).alias("downloaded"), "source", "doc_id")
    made = docs.select(F.col("doc_id").alias("id"), order.alias("ord"), F.col("text").isNull().alias("null"), near.hashed_minhash(F.col("text")).alias("x"))
    firsts = made.groupBy("null", "x.hash").agg(F.min(F.struct("ord", "id", "x.signature")).alias("x"))
    return cut(firsts.select("x.id", "x.ord", "x.signature"))


@add()
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", near.minhash(F.col("text")).alias("signature"))


@add()
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of bands: how many have so many documents."""
    sizes = near.bands(signed(spark, sf_dir), ["id"]).groupBy("band", "part").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("bands"))


@add()
def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.greedy(signed(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("keeper").isNull().alias("kept"))


@add()
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near copy with the earliest kept document that it is like."""
    return near.greedy(signed(spark, sf_dir)).where("keeper is not null").select(F.col("id").alias("doc_id"), "keeper")


@add()
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen, exact and near duplicates, kept."""
    ranks = ranked(spark, sf_dir).agg(F.count("*").alias("seen"), F.count_if(F.col("rank") > 1).alias("exact_duplicates"))
    found = near.greedy(signed(spark, sf_dir)).agg(F.count_if(F.col("keeper").isNotNull()).alias("near_duplicates"), F.count_if(F.col("keeper").isNull()).alias("kept"))
    return ranks.join(F.broadcast(found)).withColumn("duplicate_rate", F.round((F.col("exact_duplicates") + F.col("near_duplicates")) / F.col("seen"), 6))


@add()
def near_anti_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaded documents that are like no manual one."""
    s = signed(spark, sf_dir)
    downloaded, manual = s.where("ord.downloaded"), s.where("not ord.downloaded")
    found = near.matches(downloaded, manual, near.THRESHOLD)
    return downloaded.join(found.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("doc_id"))


@add()
def near_removed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each downloaded source, the documents before, and those that are like a manual one."""
    s = signed(spark, sf_dir)
    downloaded = s.where("ord.downloaded")
    found = near.matches(downloaded, s.where("not ord.downloaded"), near.THRESHOLD).select("id").distinct().withColumn("near", F.lit(True))
    marked = downloaded.select("id", F.col("ord.source").alias("source")).join(found, "id", "left")
    return marked.groupBy("source").agg(F.count("*").alias("before"), F.count_if("near").alias("removed"))


@add()
def cross_corpus_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one half of the sources that are like one of the other half, with their best score."""
    s = signed(spark, sf_dir).withColumn("half", F.crc32("ord.source") % 2)
    found = near.matches(s.where("half = 0"), s.where("half = 1"), 0.80, 32, 4)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.round(F.max("score"), 6).alias("score"))


@add(f"""WITH w AS (SELECT doc_id, lang, list_distinct({W}) AS s FROM documents), p AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY lang ORDER BY doc_id) AS t, lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM w)
SELECT doc_id, other, CASE WHEN len(s) = 0 OR len(t) = 0 THEN 0 ELSE round(len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))), 6) END AS jaccard FROM p WHERE other IS NOT NULL""")
def word_jaccard_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stands before whom is found among narrow rows; the sets then come to each pair by the row."""
    order = Window.partitionBy("lang").orderBy("doc_id")
    w = cut(table(spark, sf_dir, "documents").select("doc_id", "lang", F.array_distinct(words(F.col("text"))).alias("s"), F.monotonically_increasing_id().alias("row")))
    p = w.select("row", "doc_id", "lang").withColumn("before", F.lag("row").over(order)).withColumn("other", F.lag("doc_id").over(order)).where("other is not null")
    sets = w.select("row", "s")  # the same shuffle serves both joins
    p = p.join(sets, "row").alias("p").join(sets.alias("o"), F.col("p.before") == F.col("o.row")).select("doc_id", "other", F.col("p.s").alias("s"), F.col("o.s").alias("t"))
    return p.select("doc_id", "other", F.round(word_jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@add(f"""WITH b AS (SELECT item_id, left({CANON}, 60) AS head FROM benchmark), c AS (SELECT doc_id, {CANON} AS canon FROM documents)
SELECT item_id, count(doc_id)::BIGINT AS documents, min(doc_id) AS first_id FROM b LEFT JOIN c ON contains(canon, head) GROUP BY item_id""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose first 60 canonical characters stand in documents, in blocks of items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring(canonical_form(F.col("text")), 1, 60).alias("head"))
    docs = table(spark, sf_dir, "documents").select("doc_id", canonical_form(F.col("text")).alias("canon"))
    hits = contamination.heads_in(docs, items)
    found = hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_id")


WINDOWS = "list_distinct(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i+7], ' ')))"


@add(f"""WITH b AS (SELECT item_id, list_filter(string_split({CANON}, ' '), lambda x: x <> '') AS w FROM benchmark), c AS (SELECT doc_id, list_filter(string_split({CANON}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, unnest({WINDOWS}) AS g FROM b WHERE len(w) > 0), n AS (SELECT item_id, count(*) AS windows FROM i GROUP BY item_id), d AS (SELECT doc_id, unnest({WINDOWS}) AS g FROM c WHERE len(w) > 0), h AS (SELECT item_id, doc_id, g FROM d JOIN i USING (g)),
f AS (SELECT item_id, count(DISTINCT g) AS found FROM h GROUP BY item_id), k AS (SELECT item_id, doc_id, count(*) AS c FROM h GROUP BY ALL), t AS (SELECT item_id, count(*) AS documents, min(doc_id) AS first_id FROM k JOIN n USING (item_id) WHERE c >= windows * 0.5 GROUP BY item_id)
SELECT item_id, coalesce(windows, 0)::BIGINT AS windows, coalesce(found, 0)::BIGINT AS found, coalesce(documents, 0)::BIGINT AS documents, first_id FROM benchmark LEFT JOIN n USING (item_id) LEFT JOIN f USING (item_id) LEFT JOIN t USING (item_id)""")
def benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items: how many of their eight-word windows the corpus has, and the documents with half of them."""
    canon = lambda name, key: table(spark, sf_dir, name).select(key, canonical_form(F.col("text")).alias("canon"))
    return contamination.items_in(canon("documents", "doc_id"), canon("benchmark", "item_id"))
