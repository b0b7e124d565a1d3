"""Tokens, packing, metrics, schedules, logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.functions.text import words
from weftcorpus.operators import metrics, statistics, tokens
from weftcorpus.plans.base import D, W, Register, documents, table

REGISTER = Register()
add = REGISTER.add
FREQ = f"f AS (SELECT token, count(*) AS n FROM (SELECT unnest({W}) AS token FROM documents) GROUP BY token)"


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.frequencies(documents(spark, sf_dir), "w")


@add(f"WITH {FREQ} SELECT token, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, token)::INT AS rank FROM f ORDER BY n DESC, token LIMIT 25")
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = frequencies(spark, sf_dir).orderBy(F.desc("n"), "token").limit(25)
    return head.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")))


@add(f"WITH {FREQ}, r AS (SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, sum(n) OVER (ORDER BY n DESC, token ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS c FROM f) SELECT rank::INT AS rank, round(c, 6) AS coverage FROM r WHERE rank IN (100, 1000, 5000, 10000)")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.coverage(frequencies(spark, sf_dir))


@add(f"WITH {FREQ} SELECT sum(n)::BIGINT AS tokens, count(*)::BIGINT AS distinct_tokens, count(*) FILTER (WHERE n = 1)::BIGINT AS hapax, max(n)::BIGINT AS most FROM f")
def hapax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.hapax(frequencies(spark, sf_dir))


#: A stand-in tokenizer that SQL can follow: pieces of four characters.
PIECES = "list_sum(list_transform(w, lambda x: ((length(x) + 3) // 4)::BIGINT))"


def pieces(df: DataFrame) -> DataFrame:
    return df.withColumn("n_tokens", F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.floor((F.length(x) + 3) / 4).cast("long")))


@add(f"WITH {D}, t AS (SELECT source, n_words, n_chars, coalesce({PIECES}, 0) AS k FROM d) SELECT source, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words, sum(k)::BIGINT AS tokens, round(sum(k) / sum(n_words), 6) AS fertility, round(sum(n_chars) / sum(k), 6) AS chars_per_token FROM t GROUP BY source")
def fertility_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = pieces(documents(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"), F.sum("n_chars").alias("c"))
    return sums.select("source", "documents", "words", "tokens", F.round(F.col("tokens") / F.col("words"), 6).alias("fertility"), F.round(F.col("c") / F.col("tokens"), 6).alias("chars_per_token"))


@add(f"""WITH {D}, t AS (SELECT source, any_value(is_manual) AS manual, sum(n_words) AS words, CASE WHEN source <> 'src7' THEN sum(coalesce({PIECES}, 0)) / sum(n_words) END AS f FROM d GROUP BY source),
m AS (SELECT *, coalesce(f, avg(f) OVER ()) AS g FROM t), s AS (SELECT sum(words * g) FILTER (WHERE manual) AS mt, sum(words * g) FILTER (WHERE NOT manual) AS dt, sum(words * g) FILTER (WHERE manual) / sum(words) FILTER (WHERE manual) AS mf, sum(words * g) FILTER (WHERE NOT manual) / sum(words) FILTER (WHERE NOT manual) AS df, sum(words) FILTER (WHERE f IS NULL) / sum(words) AS un FROM m)
SELECT round(mt, 3) AS manual_tokens, round(dt, 3) AS downloaded_tokens, greatest(1000000 - mt, 0)::BIGINT AS manual_gap_tokens, floor(greatest(1000000 - mt, 0) / mf)::BIGINT AS manual_gap_words,
  greatest(mt / 0.2 - mt - dt, 0)::BIGINT AS admissible_tokens, round(un, 6) AS unmeasured_share, un >= 0.01 AS warn FROM s""")
def token_budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source from its fertility; a source that was not measured takes the mean of the others."""
    sums = pieces(documents(spark, sf_dir)).groupBy("source").agg(F.first("is_manual").alias("manual"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("k"))
    f = F.when(F.col("source") != "src7", F.col("k") / F.col("words"))
    m = sums.withColumn("f", f).withColumn("g", F.coalesce("f", F.avg("f").over(Window.partitionBy())))
    tokens_, words_ = F.col("words") * F.col("g"), F.col("words")
    of = lambda c, manual: F.sum(F.when(F.col("manual") if manual else ~F.col("manual"), c))
    s = m.agg(of(tokens_, True).alias("mt"), of(tokens_, False).alias("dt"), (of(tokens_, True) / of(words_, True)).alias("mf"), (F.sum(F.when(F.col("f").isNull(), words_)) / F.sum(words_)).alias("un"))
    gap = F.greatest(1_000_000 - F.col("mt"), F.lit(0))
    return s.select(
        F.round("mt", 3).alias("manual_tokens"), F.round("dt", 3).alias("downloaded_tokens"), F.round(gap).cast("long").alias("manual_gap_tokens"), F.floor(gap / F.col("mf")).cast("long").alias("manual_gap_words"),
        F.round(F.greatest(F.col("mt") / F.lit(0.2) - F.col("mt") - F.col("dt"), F.lit(0))).cast("long").alias("admissible_tokens"), F.round("un", 6).alias("unmeasured_share"), (F.col("un") >= 0.01).alias("warn"),
    )


def parts_of(size: int):
    return lambda s, x: s + F.ceil(x / size)


@add(f"""WITH {D}, v AS (SELECT unnest([2, 3, 4, 5, 6]) AS piece), t AS (SELECT piece, sum(list_sum(list_transform(w, lambda x: ceil(length(x) / piece)))) / sum(n_words) AS f FROM d, v GROUP BY piece)
SELECT (piece * 1000)::INT AS vocabulary, round(f, 6) AS fertility FROM t WHERE f <= (SELECT min(f) FROM t) * 1.05 ORDER BY piece LIMIT 1""")
def vocab_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("n_words", F.transform("w", lambda x: F.length(x)).alias("l"))
    sums = docs.agg(F.sum("n_words").alias("words"), *[F.sum(F.aggregate("l", F.lit(0).cast("long"), parts_of(k))).alias(str(k * 1000)) for k in (2, 3, 4, 5, 6)])
    table_ = sums.unpivot("words", [str(k * 1000) for k in (2, 3, 4, 5, 6)], "v", "k").select(F.col("v").cast("int").alias("vocabulary"), (F.col("k") / F.col("words")).alias("f"))
    return tokens.smallest_within(table_, "vocabulary", "f", 1.05).select("vocabulary", F.round("f", 6).alias("fertility"))


@add(f"SELECT doc_id, len(w)::BIGINT + 1 AS n, (coalesce(sum(len(w) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM (SELECT doc_id, {W} AS w FROM documents)")
def pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths as ids, each document closed by the end mark 2, with its place in the stream."""
    ids = documents(spark, sf_dir).select("doc_id", F.transform("w", lambda x: F.least(F.length(x) + 3, F.lit(255))).alias("ids"))
    return tokens.packed(ids, "doc_id", "ids", 2).select("doc_id", F.size("ids").cast("long").alias("n"), "offset")


@add(f"WITH x AS (SELECT {W} AS w FROM documents) SELECT sum(len(w) + 1)::BIGINT AS tokens, count(*)::BIGINT AS documents, max(greatest(2, coalesce(list_max(list_transform(w, lambda x: least(length(x) + 3, 255))), 2)))::INT AS greatest, count(*)::BIGINT AS ends, true AS valid FROM x")
def packed_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = documents(spark, sf_dir).select("doc_id", F.transform("w", lambda x: F.least(F.length(x) + 3, F.lit(255))).alias("ids"))
    return tokens.verify(tokens.packed(ids, "doc_id", "ids", 2), 256, 2)


@add(f"WITH x AS (SELECT doc_id, {W} AS w FROM documents), y AS (SELECT doc_id, w, greatest(len(w) - 17, 0) AS high FROM x WHERE len(w) >= 40), z AS (SELECT doc_id, w, i, floor(i * high / 3)::INT AS start FROM y, (SELECT unnest(range(4)) AS i)) SELECT doc_id, i::INT AS i, start, array_to_string(w[start+1:start+16], ' ') AS x, array_to_string(w[start+2:start+17], ' ') AS y FROM z")
def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows of 16 tokens for each document, and the same shifted by one."""
    docs = documents(spark, sf_dir).where("n_words >= 40").select("doc_id", "w", F.posexplode(tokens.fixed_windows(F.col("n_words"), 4, 16)).alias("i", "start"))
    part = lambda s: F.array_join(F.slice("w", F.col("start") + s, F.lit(16)), " ")
    return docs.select("doc_id", "i", "start", part(1).alias("x"), part(2).alias("y"))


@add(f"""WITH t AS (SELECT conv_id, turn, role, {W} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM t)
SELECT conv_id, turn, (len(prompt) + len(w) + 1)::BIGINT AS n, (len(w) + 1)::BIGINT AS counted FROM p WHERE prompt IS NOT NULL AND len(prompt) > 0 AND len(prompt) + len(w) + 1 <= 256""")
def prompt_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn after the one before it as a prompt: targets of the prompt don't count."""
    ids = F.transform(words(F.col("text")), lambda x: F.length(x))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("c"))
    pairs = turns.withColumn("p", F.lag("c").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p is not null and size(p) > 0")
    m = pairs.select("conv_id", "turn", tokens.masked(F.col("p"), F.col("c"), 2, 256).alias("m")).where("m is not null")
    return m.select("conv_id", "turn", F.size("m.ids").cast("long").alias("n"), F.aggregate("m.mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("counted"))


VOCABULARY = [*tokens.SPECIAL, *[f"<0x{i:02X}>" for i in range(256)], *"▁ abcdefghijklmnopqrstuvwxyz", *"th he an in er on re ed nd ou ▁th ▁the ▁an ▁and ing ion ti".split()]


@add()
def piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents by a small literal vocabulary."""
    ids = {p: i for i, p in enumerate(VOCABULARY)}
    scores = {p: -float(i) for i, p in enumerate(VOCABULARY) if i >= 260}
    return documents(spark, sf_dir).select("doc_id", F.size(tokens.encode(F.col("w"), ids, scores)).cast("long").alias("n_tokens"))


@add("SELECT 256::BIGINT AS byte_pieces, 4::BIGINT AS special, (SELECT count(*) FROM nation)::BIGINT * 0 AS other")
def byte_piece_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(i, p) for i, p in enumerate(VOCABULARY)], "id int, piece string")
    return v.agg(F.count_if(F.startswith("piece", F.lit("<0x"))).alias("byte_pieces"), F.count_if(F.col("piece").isin(tokens.SPECIAL)).alias("special"), F.lit(0).cast("long").alias("other"))


# ------------------------------------------------------------------------------------------------------ metrics
PAIR = f"x AS (SELECT doc_id, {W} AS w FROM documents), p AS (SELECT doc_id, w[1:greatest(len(w) - 5, 0)] AS h, w[6:] AS r FROM x)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole texts: all words but the last five as if generated, all but the first five as their reference."""
    n = F.greatest(F.size("w") - 5, F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.slice("w", F.lit(1), n).alias("h"), F.slice("w", F.lit(6), n).alias("r"))


def gram_sql(n: int) -> str:
    return f"""SELECT {n} AS n, sum(least(a.c, coalesce(b.c, 0))) AS m, sum(a.c) AS t FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(h) - {n} + 2), lambda i: array_to_string(h[i:i+{n - 1}], ' '))) AS g FROM p) GROUP BY ALL) a
LEFT JOIN (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(r) - {n} + 2), lambda i: array_to_string(r[i:i+{n - 1}], ' '))) AS g FROM p) GROUP BY ALL) b USING (doc_id, g)"""


@add(f"WITH {PAIR}, g AS ({' UNION ALL '.join(gram_sql(n) for n in range(1, 5))}) SELECT round(100 * CASE WHEN min(m) > 0 THEN exp(avg(ln(m / t))) ELSE 0 END, 6) AS bleu, 1.0::DOUBLE AS brevity_penalty, (SELECT sum(len(h)) FROM p)::BIGINT AS hyp_len, (SELECT sum(len(r)) FROM p)::BIGINT AS ref_len FROM g")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bleu(pairs(spark, sf_dir), "h", "r").withColumn("bleu", F.round("bleu", 6))


@add()
def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pairs(spark, sf_dir).select(F.array_join("h", " ").alias("h"), F.array_join("r", " ").alias("r"))
    return metrics.chrf(texts, "h", "r").select(F.round("chrf", 6).alias("chrf"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@add()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rouge_l(pairs(spark, sf_dir), "h", "r")


@add(f"""WITH x AS (SELECT {W} AS w FROM documents), u AS (SELECT g, count(*) AS c FROM (SELECT unnest(w) AS g FROM x) GROUP BY g), b AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) AS g FROM x) GROUP BY g),
f AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM x) GROUP BY g)
SELECT (SELECT sum(c) FROM u)::BIGINT AS tokens, round((SELECT count(*) / sum(c) FROM u), 6) AS distinct_1, round((SELECT count(*) / sum(c) FROM b), 6) AS distinct_2, round((SELECT sum(c - 1) / sum(c) FROM f), 6) AS repetition_4, (SELECT count(*) FROM u)::BIGINT AS unigrams, (SELECT count(*) FROM b)::BIGINT AS bigrams""")
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.diversity(documents(spark, sf_dir).select("w"), "w")
    return found.select("tokens", *[F.round(c, 6).alias(c) for c in ("distinct_1", "distinct_2", "repetition_4")], "unigrams", "bigrams")


@add("SELECT lang, round(sum(n_chars * 1.5) / ln(2) / sum(strlen(text)), 6) AS bits_per_byte, round(exp(sum(n_chars * 1.5) / sum(n_chars)), 6) AS perplexity FROM documents GROUP BY lang")
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of 1.5 nats a character, summed before they are divided."""
    sums = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.col("n_chars") * 1.5).alias("nats"), F.sum(F.octet_length("text")).alias("b"), F.sum("n_chars").alias("n"))
    return sums.select("lang", F.round(metrics.bits_per_byte(F.col("nats"), F.col("b")), 6).alias("bits_per_byte"), F.round(metrics.perplexity(F.col("nats"), F.col("n")), 6).alias("perplexity"))


# --------------------------------------------------------------------------------------------- schedules and logs
TOTAL, RATE = 3814, 3e-4
FIRST = max(1, int(TOTAL * 0.02))


@add(f"SELECT step::BIGINT AS step, round(CASE WHEN step < {FIRST} THEN {RATE} * (step + 1) / {FIRST} ELSE {RATE * 0.1} + {RATE - RATE * 0.1} * 0.5 * (1 + cos({math.pi} * (step - {FIRST}) / {TOTAL - FIRST})) END, 12) AS rate FROM (SELECT unnest(range({TOTAL})) AS step)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(TOTAL).withColumnRenamed("id", "step")
    return steps.select("step", F.round(tokens.cosine_rate(F.col("step"), TOTAL, RATE), 12).alias("rate"))


@add("SELECT * FROM (VALUES ('blocks', 22066688::BIGINT), ('token_embedding', 1280000), ('positional_embedding', 262144), ('final_norm', 1024), ('output_head', 1282500), ('total', 24892356)) t(component, parameters)")
def param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(tokens.parameters(512, 7, 2048, 2_500, 512, tied=False).items()), "component string, parameters long")


@add("SELECT event_id AS step, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def log_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(-19, 0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.round(F.avg("value").over(last), 6).alias("smooth"))


@add("SELECT event_type AS run, count(*)::BIGINT AS rows, arg_max(value, event_id) AS last, min(value) AS least, round(exp(least(min(value) / 100, 20)), 6) AS perplexity FROM events GROUP BY event_type")
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("rows"), F.max_by("value", "event_id").alias("last"), F.min("value").alias("least"), F.round(F.exp(F.least(F.min("value") / 100, F.lit(20.0))), 6).alias("perplexity"))


@add("""WITH a AS (SELECT user_id % 4 AS layer, user_id % 3 AS head, user_id AS query, event_id AS k, abs(value) + 1 AS v FROM events), p AS (SELECT layer, head, query, k, v / sum(v) OVER (PARTITION BY query) AS p, row_number() OVER (PARTITION BY query ORDER BY k DESC) - 1 AS back FROM a),
q AS (SELECT layer, head, query, -sum(p * log2(p)) AS entropy, sum(p * back) AS distance, count(*) AS n FROM p GROUP BY ALL) SELECT layer::BIGINT AS layer, head::BIGINT AS head, round(avg(entropy), 5) AS entropy, round(avg(entropy / log2(n)), 5) AS normalised, round(avg(distance), 4) AS distance FROM q WHERE n > 1 GROUP BY ALL""")
def attention_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of queries over earlier keys: entropy, its share of the most there can be, mean distance."""
    a = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("layer"), (F.col("user_id") % 3).alias("head"), F.col("user_id").alias("query"), F.col("event_id").alias("k"), (F.abs("value") + 1).alias("v"))
    q = Window.partitionBy("query")
    p = a.withColumn("p", F.col("v") / F.sum("v").over(q)).withColumn("back", F.row_number().over(q.orderBy(F.desc("k"))) - 1)
    sums = p.groupBy("layer", "head", "query").agg((-F.sum(F.col("p") * F.log2("p"))).alias("e"), F.sum(F.col("p") * F.col("back")).alias("d"), F.count("*").alias("n")).where("n > 1")
    return sums.groupBy("layer", "head").agg(F.round(F.avg("e"), 5).alias("entropy"), F.round(F.avg(F.col("e") / F.log2("n")), 5).alias("normalised"), F.round(F.avg("d"), 4).alias("distance"))


@add("WITH h AS (SELECT user_id % 4 AS layer, user_id % 3 AS head, avg(value) AS m FROM events GROUP BY ALL) SELECT layer::BIGINT AS layer, round(avg(m), 5) AS mean, arg_min(head, m)::BIGINT AS least_head, arg_max(head, m)::BIGINT AS most_head FROM h GROUP BY layer")
def attention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("layer"), (F.col("user_id") % 3).alias("head")).agg(F.avg("value").alias("m"))
    return h.groupBy("layer").agg(F.round(F.avg("m"), 5).alias("mean"), F.min_by("head", "m").alias("least_head"), F.max_by("head", "m").alias("most_head"))


@add("WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM c) SELECT event_type, user_id, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 5")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top(table(spark, sf_dir, "events"), "user_id", 5, ["event_type"])
