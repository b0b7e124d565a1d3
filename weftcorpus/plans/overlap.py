"""Overlap of collections, units before packing, prompts across splits, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.functions.text import canonical_form, exact_hash, lines, ratio
from weftcorpus.operators import near, overlap
from weftcorpus.plans.base import CANON, D, W, Register, documents, table
from weftcorpus.session import cut

REGISTER = Register()
add = REGISTER.add
LINE_CANON = CANON.replace("text", "line")
PARAGRAPHS = f"""{D}, ls AS (SELECT doc_id, is_manual, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
p AS (SELECT doc_id, is_manual, sha256({LINE_CANON}) AS hash FROM ls WHERE len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) >= {overlap.PARAGRAPH_WORDS})"""


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of manual documents (the archive) and of all others (the corpus)."""
    docs = documents(spark, sf_dir)
    return tuple(overlap.paragraphs(docs.where(side), "doc_id", "text") for side in ("is_manual", "not is_manual"))


@add(f"""WITH {PARAGRAPHS}, c AS (SELECT count(*) FILTER (WHERE is_manual) AS archive, count(*) FILTER (WHERE NOT is_manual) AS corpus, count(*) FILTER (WHERE is_manual AND hash IN (SELECT hash FROM p WHERE NOT is_manual)) AS exact FROM p)
SELECT archive::BIGINT AS archive, corpus::BIGINT AS corpus, exact::BIGINT AS exact, coalesce(round(exact / nullif(archive, 0), 4), 0) AS exact_rate,
  CASE WHEN archive < 400 OR corpus < 400 THEN 'INCONCLUSIVE' WHEN exact / archive >= 0.10 THEN 'HIGH' ELSE 'LOW' END AS verdict FROM c""")
def source_overlap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paragraphs of the archive that the corpus has too, and what follows from that alone."""
    archive, corpus = both_sides(spark, sf_dir)
    counts = overlap.membership(archive, corpus).select(F.col("rows").alias("archive"), F.col("found").alias("exact"))
    all_ = counts.join(F.broadcast(corpus.agg(F.count("*").alias("corpus"))))  # one row each
    rate = ratio(F.col("exact"), F.col("archive"))
    return all_.select("archive", "corpus", "exact", F.round(rate, 4).alias("exact_rate"), overlap.verdict(F.col("archive"), F.col("corpus"), rate, F.lit(0.0)).alias("verdict"))


@add()
def source_overlap_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies too: of distinct paragraphs of the archive, how many are like one of the corpus; the whole verdict."""
    archive, corpus = both_sides(spark, sf_dir)
    one = lambda df: df.groupBy("hash").agg(F.min("paragraph").alias("t")).select(F.col("hash").alias("id"), canonical_form(F.col("t")).alias("canon"))
    left, right = one(archive), one(corpus)
    hits = overlap.near_hits(left, right).agg(F.count("*").alias("near"))
    counts = overlap.membership(archive, corpus).select(F.col("rows").alias("archive"), F.col("found").alias("exact"))
    sums = counts.join(F.broadcast(corpus.agg(F.count("*").alias("corpus")))).join(F.broadcast(left.agg(F.count("*").alias("distinct_archive")))).join(F.broadcast(hits))
    exact, near_rate = ratio(F.col("exact"), F.col("archive")), ratio(F.col("near"), F.col("distinct_archive"))
    return sums.select("archive", "corpus", "exact", "near", F.round(exact, 4).alias("exact_rate"), F.round(near_rate, 4).alias("near_rate"), overlap.verdict(F.col("archive"), F.col("corpus"), exact, near_rate).alias("verdict"))


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9_\\s]', ' ', 'g'), '\\b(vol|volume|part|bhag|khand|no|ed|edition)\\b', ' ', 'g'), '[0-9]+|\\s+', ' ', 'g'))"


@add(f"""WITH x AS (SELECT p_partkey, p_size <= 20 AS archive, p_name || ' (Vol. ' || p_size || ')' AS t FROM part), n AS (SELECT p_partkey, archive, regexp_replace({NORM}, '\\s+', ' ', 'g') AS title FROM x),
a AS (SELECT title, min(p_partkey) AS identifier FROM n WHERE archive AND title <> '' GROUP BY title) SELECT title, identifier, title IN (SELECT title FROM n WHERE NOT archive) AS in_corpus FROM a""")
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of small parts, each with its first part, and whether a large part has the title too."""
    named = F.concat("p_name", F.lit(" (Vol. "), "p_size", F.lit(")"))
    parts = table(spark, sf_dir, "part")
    archive, corpus = (overlap.titles(parts.where(side), named, "p_partkey") for side in ("p_size <= 20", "p_size > 20"))
    found = archive.join(corpus.select("title", F.lit(True).alias("x")), "title", "left")
    return found.select("title", "identifier", F.coalesce("x", F.lit(False)).alias("in_corpus"))


@add("SELECT DISTINCT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS title FROM part")
def corpus_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of marker lines in a text, without volume numbers."""
    text = F.concat(F.lit("before\n--- SOURCE: "), "p_name", F.lit(", Vol. "), F.col("p_size"), F.lit(" ---\nsome text"))
    return overlap.marker_titles(table(spark, sf_dir, "part").select(text.alias("t")), "t")


GRAMS = "CASE WHEN length(canon) = 0 THEN [] WHEN length(canon) < 5 THEN [canon] ELSE list_distinct(list_transform(range(1, length(canon) - 3), lambda i: substr(canon, i, 5))) END"


@add(f"""WITH c AS (SELECT item_id AS id, {CANON} AS canon FROM benchmark), s AS (SELECT id, {GRAMS} AS s FROM c), x AS (SELECT id, len(s) AS n, unnest(s) AS item FROM s),
p AS (SELECT a.id, b.id AS other, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.item = b.item AND a.id < b.id GROUP BY a.id, b.id)
SELECT id, other, common::BIGINT AS common, round(common / (n + m - common), 6) AS jaccard FROM p WHERE common / (n + m - common) >= 0.05""")
def exact_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose sets of five characters are alike to a twentieth or more."""
    canon = table(spark, sf_dir, "benchmark").select("item_id", canonical_form(F.col("text")).alias("canon"))
    items = canon.select("item_id", overlap.shingles(F.col("canon")).alias("s"))
    return overlap.jaccard_pairs(items, "item_id", "s", 0.05).withColumn("jaccard", F.round("jaccard", 6))


@add(f"""WITH ls AS (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
h AS (SELECT *, sha256({LINE_CANON}) AS hash, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS n FROM ls), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, pos) AS k FROM h)
SELECT source, CASE WHEN k > 1 THEN 'unit_exact_duplicate' WHEN n < 3 THEN 'unit_too_short' WHEN lang = 'es' THEN 'unit_langid_es' ELSE 'accepted' END AS reason, count(*)::BIGINT AS units FROM r GROUP BY ALL""")
def unit_dedup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as units: copies go first, then short ones, then those of a language."""
    each = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    found = overlap.deduplicated_units(each, ["doc_id", "pos"], "line", "lang", "es")
    return found.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("units"))


@add("""WITH p AS (SELECT conv_id, turn, text AS prompt, (conv_id % 3)::INT AS r FROM conversations), f AS (SELECT *, min(r) OVER (PARTITION BY prompt) AS first FROM p)
SELECT conv_id, turn, CASE r WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM f WHERE r = first""")
def disjoint_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns dealt out to splits by conversation, without prompts that an earlier split has."""
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("conv_id") % 3 + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), split.alias("split"))
    return overlap.disjoint(turns, "prompt", "split", ["train", "val", "test"]).select("conv_id", "turn", "split")


@add(f"""WITH {D}, h AS (SELECT doc_id, source, sha256({CANON}) AS hash, CASE WHEN doc_id % 3 = 0 THEN source END AS folder FROM d), m AS (SELECT hash, min(source) AS s FROM h WHERE doc_id % 2 = 0 GROUP BY hash),
a AS (SELECT h.*, coalesce(folder, s) AS attributed, CASE WHEN folder IS NOT NULL THEN 'folder' WHEN s IS NOT NULL THEN 'hash' ELSE 'unmatched' END AS how FROM h LEFT JOIN m USING (hash))
SELECT how, attributed AS attributed_source, count(*)::BIGINT AS documents FROM a GROUP BY ALL""")
def hash_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents are known by folder, half by their hash in the manifest."""
    rows = documents(spark, sf_dir).select("doc_id", "source", exact_hash(F.col("text")).alias("hash"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("folder"))
    found = overlap.attributed(rows, rows.where("doc_id % 2 = 0").select("hash", "source"), folder="folder")
    return found.groupBy("how", "attributed_source").agg(F.count("*").alias("documents"))


@add()
def cross_corpus_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar pairs of a manual and another document, by signature."""
    signed = cut(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "is_manual", near.minhash(F.col("text")).alias("signature")))
    return overlap.best_pairs(near.matches(signed.where("is_manual"), signed.where("not is_manual"), overlap.NEAR_AT, 32, 4))


@add(f"""WITH {D}, ls AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
p AS (SELECT *, doc_id * 100000 + pos AS o FROM ls WHERE len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) >= 12), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o) AS k FROM p)
SELECT source, doc_id, (pos - 1)::INT AS pos FROM r WHERE k <= 5""")
def paragraph_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five long lines of each source."""
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    found = overlap.paragraphs(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id").withColumn("o", F.col("doc_id") * 100000 + F.col("pos"))
    return overlap.first_of_each(found, "source", "o", 5).select("source", "doc_id", "pos")


@add(f"SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::INT - (CASE WHEN ends_with(coalesce(text, ''), chr(10)) OR coalesce(text, '') = '' THEN 1 ELSE 0 END) AS n_lines, len({W})::INT AS n_words FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(lines(F.col("text"))).alias("n_lines"), F.size("w").alias("n_words"))
