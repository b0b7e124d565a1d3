"""Vocabularies, encodings, batches, continuations, grids and figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.operators import batches, bpe, metrics, tokens
from weftcorpus.plans.base import D, W, Register, documents, table

REGISTER = Register()
add = REGISTER.add
VOCABULARY = 700
LITERAL = [("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)]


@add("SELECT * FROM (VALUES (260, 'es'), (261, 'est'), (262, 'lo'), (263, 'low'), (264, '▁low')) t(id, piece)")
def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five joins of a corpus of four words, which can be followed by hand."""
    rows = spark.createDataFrame([([w] * n,) for w, n in LITERAL], "w array<string>")
    learned = bpe.learned(bpe.word_table(rows, "w"), len(tokens.SPECIAL) + 256 + 5 + 11, share=1.0)
    return bpe.as_table(spark, learned).where("id between 260 and 264").select("id", "piece")


def vocabulary(spark: SparkSession, sf_dir: str) -> list[str]:
    """Learned from all words of the documents."""
    return bpe.checked(bpe.learned_from(bpe.word_counts(documents(spark, sf_dir), "w"), VOCABULARY))


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The documents with ids by that vocabulary."""
    learned = vocabulary(spark, sf_dir)
    ids = {p: i for i, p in enumerate(learned)}
    return documents(spark, sf_dir).withColumn("ids", tokens.encode(F.col("w"), ids, bpe.scores(learned))), learned


@add()
def bpe_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.as_table(spark, vocabulary(spark, sf_dir))


@add(f"SELECT doc_id, len({W})::BIGINT AS n_words, 0::BIGINT AS unk, true AS roundtrip_ok FROM documents")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: nothing unknown, nothing lost."""
    docs, learned = encoded(spark, sf_dir)
    return bpe.example(docs, "doc_id", "text", "ids", "w", learned).select("doc_id", "n_words", "unk", "roundtrip_ok")


@add()
def tokenizer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility, unknown pieces and round trips of the learned vocabulary, with its size and bytes."""
    docs, learned = encoded(spark, sf_dir)
    found = bpe.report(bpe.example(docs, "doc_id", "text", "ids", "w", learned), docs, "n_chars")
    return found.withColumn("vocabulary", F.lit(len(learned))).withColumn("byte_pieces", F.lit(sum(p.startswith("<0x") for p in learned)))


@add()
def vocabulary_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility of vocabularies of several sizes over all words, and which is the smallest within a fiftieth of the best.

    A word counts as often as it occurs, and is encoded once.
    """
    counts = bpe.word_counts(documents(spark, sf_dir), "w")
    words = counts.select(F.array("word").alias("w"), "n")
    rows = []
    for size, pieces in sorted(bpe.sweep_from(counts, [200, 450, 550, 650, 750]).items()):
        ids = {p: i for i, p in enumerate(pieces)}
        found = words.select((F.size(tokens.encode(F.col("w"), ids, bpe.scores(pieces))) * F.col("n")).alias("k"), "n").agg(F.sum("k"), F.sum("n")).first()
        rows.append((size, found[0] / found[1]))
    sizes = spark.createDataFrame(rows, "vocabulary int, fertility double")
    chosen = tokens.smallest_within(sizes, "vocabulary", "fertility").select("vocabulary", F.lit(True).alias("chosen"))
    return sizes.join(chosen, "vocabulary", "left").select("vocabulary", "fertility", F.coalesce("chosen", F.lit(False)).alias("chosen"))


# ------------------------------------------------------------------------------------------------------- batches
TAKEN = "(('0x' || substr(sha256('{seed}:' || {key}::VARCHAR), 1, 12))::BIGINT)"


@add(f"SELECT (n // 32)::BIGINT AS step, (n % 32)::INT AS place, {TAKEN.format(seed=batches.WINDOW_SEED, key='n')} % 999487 AS start FROM (SELECT unnest(range(96, 416)) AS n)")
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten batches of windows over a million tokens, after three that are done."""
    return batches.random_windows(spark, 1_000_000, 10, skip=3)


@add(f"WITH x AS (SELECT doc_id, len({W})::INT AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id) AS k FROM x) SELECT doc_id, n, ((k - 1) // 4)::INT AS batch FROM r")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("n_words").cast("int").alias("n"))
    return batches.length_batches(docs, "doc_id", "n", 4)


@add("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('12:' || doc_id::VARCHAR), doc_id) - 1 AS k FROM documents) SELECT doc_id, (k // 16)::BIGINT AS batch, (k % 16)::INT AS place FROM o WHERE k // 16 >= 5")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second epoch of a run of seed 11, from its sixth batch on."""
    return batches.epoch_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1, 16, 11, done=5)


@add("SELECT * FROM (VALUES ('tokens_per_step', 131072::BIGINT), ('steps', 3814)) t(name, value)")
def run_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(batches.run_size().items()), "name string, value long")


@add(f"""WITH x AS (SELECT doc_id, len({W})::BIGINT + 1 AS n FROM documents), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x), k AS (SELECT * FROM o WHERE before < 50000)
SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens, sum(n) >= 50000 AS complete FROM k""")
def token_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents until the stream has 50,000 tokens, the one that reaches them included."""
    ids = documents(spark, sf_dir).select("doc_id", F.transform("w", lambda x: F.least(F.length(x) + 3, F.lit(255))).alias("ids"))
    kept = batches.within_tokens(tokens.packed(ids, "doc_id", "ids", 2), "offset", "ids", 50_000)
    return kept.agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens")).withColumn("complete", F.col("tokens") >= 50_000)


@add(f"""WITH x AS (SELECT doc_id, {W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(3)) AS i FROM x), t AS (SELECT doc_id, w, floor(i * greatest(len(w) - 25, 0) / 2)::INT AS start FROM s), u AS (SELECT DISTINCT doc_id, w, start FROM t WHERE start + 24 <= len(w))
SELECT doc_id, start, array_to_string(w[start+1:start+8], ' ') AS prompt, array_to_string(w[start+9:start+24], ' ') AS reference FROM u""")
def continuation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of eight words and what follows them, at three evenly spread places of each document."""
    starts = F.array_distinct(tokens.fixed_windows(F.col("n_words"), 3, 24))
    found = documents(spark, sf_dir).select("doc_id", F.explode(batches.continuations(F.col("w"), starts, 8, 16)).alias("c"))
    return found.select("doc_id", "c.start", F.array_join("c.prompt", " ").alias("prompt"), F.array_join("c.reference", " ").alias("reference"))


@add("SELECT event_type AS setting, round(avg(value) FILTER (WHERE user_id % 3 = 0), 6) AS marathi, round(avg(value) FILTER (WHERE user_id % 3 = 1), 6) AS konkani FROM events WHERE user_id % 3 < 2 GROUP BY event_type")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs by setting, a column for each language."""
    runs = table(spark, sf_dir, "events").where("user_id % 3 < 2").groupBy(F.col("event_type").alias("setting"), F.when(F.col("user_id") % 3 == 0, "marathi").otherwise("konkani").alias("language")).agg(F.round(F.avg("value"), 6).alias("v"))
    return batches.grid(runs, ["setting"], "language", "v", ["marathi", "konkani"])


@add(f"WITH {D} SELECT source, coalesce(sum(n_words) FILTER (WHERE bucket = 'manual'), 0)::BIGINT AS manual, coalesce(sum(n_words) FILTER (WHERE bucket = 'downloaded'), 0)::BIGINT AS downloaded, coalesce(sum(n_words) FILTER (WHERE bucket = 'synthetic'), 0)::BIGINT AS synthetic FROM d GROUP BY source")
def figure_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a figure: words by source and bucket."""
    sums = documents(spark, sf_dir).groupBy("source", "bucket").agg(F.sum("n_words").alias("w"))
    return batches.grid(sums, ["source"], "bucket", "w", ["manual", "downloaded", "synthetic"]).fillna(0)


LEXICON = ["the", "und", "pour", "los", "with"]


@add(f"""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n, {W} AS w FROM documents), c AS (SELECT floor(k * 4 / n)::INT AS chunk, unnest(w) AS word FROM x)
SELECT chunk, word, count(*)::BIGINT AS n FROM c WHERE word IN ({', '.join(repr(w) for w in LEXICON)}) GROUP BY ALL""")
def lexicon_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words of a lexicon stand in each of four evenly spaced chunks of the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    # chunks by rank: ranks come from narrow rows
    n = docs.count()
    ranked = docs.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("doc_id")) - 1).select("doc_id", F.floor(F.col("k") * 4 / F.lit(max(1, n))).cast("int").alias("chunk"))
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.filter("w", lambda x: x.isin(LEXICON))).alias("word"))
    return words.join(ranked, "doc_id").groupBy("chunk", "word").agg(F.count("*").alias("n"))


@add("SELECT 'total' AS component, 24892356::BIGINT AS parameters, true AS agrees FROM nation LIMIT 1")
def model_size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a model's parameters add up to the figure that is known."""
    parts = tokens.parameters(512, 7, 2048, 2_500, 512, tied=False)
    return spark.createDataFrame([("total", parts["total"], sum(v for k, v in parts.items() if k != "total") == parts["total"])], "component string, parameters long, agrees boolean")


@add(f"WITH x AS (SELECT lang, list_slice({W}, 1, 40) AS w FROM documents) SELECT lang, sum(len(w))::BIGINT AS words, round(sum(len(list_filter(w, lambda x: length(x) <= 4))) / sum(len(w)), 6) AS whole_word_rate FROM x GROUP BY lang")
def whole_word_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first forty words of each document, how many are one piece, with pieces of four characters."""
    head = documents(spark, sf_dir).select("lang", F.slice("w", 1, 40).alias("w"))
    whole = F.size(F.filter("w", lambda x: F.length(x) <= 4))
    return head.groupBy("lang").agg(F.sum(F.size("w")).alias("words"), F.round(F.sum(whole) / F.sum(F.size("w")), 6).alias("whole_word_rate"))


SETTINGS = (0, 1, 2)


def setting_sql(k: int) -> str:
    gram = lambda n: f"SELECT {n} AS n, sum(least(a.c, b.c)) AS m, (SELECT sum(greatest(16 - {k} - {n} + 1, 0)) FROM u) AS t FROM (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len(h) - {n} + 2), lambda i: array_to_string(h[i:i+{n - 1}], ' '))) AS g FROM u) GROUP BY ALL) a JOIN (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len(r) - {n} + 2), lambda i: array_to_string(r[i:i+{n - 1}], ' '))) AS g FROM u) GROUP BY ALL) b USING (id, g)"
    return f"""SELECT {k} AS setting, round(100 * exp(1 - 16 / (16 - {k})) * exp(avg(ln(m / t))), 6) AS bleu FROM (WITH x AS (SELECT doc_id AS id, {W} AS w FROM documents), u AS (SELECT id, w[9+{k}:24] AS h, w[9:24] AS r FROM x WHERE len(w) >= 24) {' UNION ALL '.join(gram(n) for n in range(1, 5))})"""


@add(" UNION ALL ".join(setting_sql(k) for k in SETTINGS))
def continuation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of continuations by decoding setting; a setting here leaves out so many of the first words."""
    found = documents(spark, sf_dir).where("n_words >= 24").select(F.explode(batches.continuations(F.col("w"), F.array(F.lit(0)), 8, 16)).alias("c"))
    each = [metrics.bleu(found.select(F.slice("c.reference", k + 1, 16).alias("h"), F.col("c.reference").alias("r")), "h", "r").select(F.lit(k).alias("setting"), F.round("bleu", 6).alias("bleu")) for k in SETTINGS]
    return reduce(DataFrame.unionByName, each)
