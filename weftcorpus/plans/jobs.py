"""Reasoning sets, health of jobs, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.operators import health, reasoning
from weftcorpus.plans.base import CANON, D, Register, documents, table
from weftcorpus.streaming import ingest

REGISTER = Register()
add = REGISTER.add


def sets(spark: SparkSession) -> DataFrame:
    parts = []
    for language in reasoning.NAMES:
        train, test = reasoning.split_names(language)
        for split, names, patterns, n in (("train", train, ["p_value", "p_more"], 300), ("test", test, ["p_value", "p_more", "p_less"], 100)):
            parts.append(reasoning.items(spark, language, n, names, patterns, 20260912 + len(split)).withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, parts)


@add()
def reasoning_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark).withColumn("text_plain", reasoning.full_text(False)).withColumn("text_rationale", reasoning.full_text(True))


@add("SELECT * FROM (VALUES ('marathi', 0::BIGINT, 0::BIGINT), ('konkani', 0, 0)) t(language, shared_entities, shared_prompts)")
def reasoning_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and prompts that both splits have: none."""
    found = sets(spark)
    names = found.select("language", "split", F.explode("entities").alias("x")).groupBy("language", "x").agg(F.countDistinct("split").alias("k"))
    prompts = found.groupBy("language", "prompt").agg(F.countDistinct("split").alias("k"))
    return names.groupBy("language").agg(F.count_if(F.col("k") > 1).alias("shared_entities")).join(prompts.groupBy("language").agg(F.count_if(F.col("k") > 1).alias("shared_prompts")), "language")


@add()
def reasoning_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["split", "family", "pattern", "attribute"]
    return sets(spark).groupingSets([["language", k] for k in keys], "language", *keys).agg(F.count("*").alias("items"), F.countDistinct("answer").alias("answers"))


#: Events as if they were answers: a user is the gold, another the prediction.
ANSWERS = """a AS (SELECT event_id, event_type AS family, CASE WHEN event_id % 2 = 0 THEN 'p_more' ELSE 'p_less' END AS pattern, CASE WHEN event_id % 3 = 0 THEN 'age' ELSE 'height' END AS attribute, (event_id % 3 + 2)::INT AS n_entities,
  'u' || (user_id % 12)::VARCHAR AS gold, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'u' || ((user_id + CASE WHEN event_id % 5 < 2 THEN 0 ELSE event_id % 7 END) % 15)::VARCHAR END AS predicted, event_id % 11 <> 0 AS emitted FROM events)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    guess = F.concat(F.lit("u"), ((F.col("user_id") + F.when(e % 5 < 2, 0).otherwise(e % 7)) % 15).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("family"), F.when(e % 2 == 0, "p_more").otherwise("p_less").alias("pattern"), F.when(e % 3 == 0, "age").otherwise("height").alias("attribute"), (e % 3 + 2).cast("int").alias("n_entities"),
        F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string")).alias("gold"), F.when(e % 11 == 0, "").otherwise(guess).alias("predicted"), (e % 11 != 0).alias("emitted"),
    )


@add(f"WITH {ANSWERS} SELECT family, pattern, attribute, n_entities, count(*)::BIGINT AS n, round(avg((predicted = gold)::INT), 6) AS accuracy, round(avg(emitted::INT), 6) AS compliance, round(avg(1 / (n_entities + 1)), 6) AS chance FROM a GROUP BY GROUPING SETS ((), (family), (pattern), (attribute), (n_entities))")
def reasoning_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoning.scored(answers(spark, sf_dir))


def pool(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


BUCKETS = f"""{ANSWERS}, b AS (SELECT *, CASE WHEN predicted IN ('u0', 'u1', 'u2', 'u3') THEN 'test_pool_name' WHEN predicted IN ('u4', 'u5', 'u6') THEN 'train_pool_name' WHEN predicted = 'u7' THEN 'equality_word'
  WHEN starts_with(predicted, 'u1') THEN 'malformed_variant' ELSE 'other_string' END AS bucket FROM a WHERE emitted AND predicted <> '')"""


@add(f"WITH {BUCKETS} SELECT bucket, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM b GROUP BY bucket")
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reasoning.classified(answers(spark, sf_dir), pool(spark, ["u4", "u5", "u6"]), pool(spark, ["u0", "u1", "u2", "u3"]), pool(spark, ["u7"]))
    sums = found.groupBy("bucket").agg(F.count("*").alias("n"))
    return sums.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


LENIENT = f"""{ANSWERS}, c AS (SELECT DISTINCT gold AS name FROM a), m AS (SELECT predicted, list_sort(list(name)) AS near FROM (SELECT DISTINCT predicted FROM a WHERE predicted <> '') p JOIN c ON starts_with(name, predicted) OR starts_with(predicted, name) GROUP BY predicted),
l AS (SELECT a.*, predicted <> '' AND (predicted = gold OR coalesce(near = [gold], false)) AS lenient FROM a LEFT JOIN m USING (predicted))"""


@add(f"WITH {LENIENT} SELECT family, count(*)::BIGINT AS n, count(*) FILTER (WHERE predicted = gold)::BIGINT AS exact, count(*) FILTER (WHERE lenient)::BIGINT AS lenient FROM l GROUP BY family")
def lenient_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    found = reasoning.lenient(rows, rows.select(F.col("gold").alias("name")).distinct())
    return found.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("gold")).alias("exact"), F.count_if("lenient").alias("lenient"))


@add(f"""WITH {ANSWERS}, g AS (SELECT family, max(c) AS majority FROM (SELECT family, gold, count(*) AS c FROM a GROUP BY ALL) GROUP BY family), t AS (SELECT family, predicted AS top_prediction, c FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY c DESC, predicted) AS r FROM (SELECT family, predicted, count(*) AS c FROM a GROUP BY ALL)) WHERE r = 1)
SELECT a.family, count(*)::BIGINT AS n, count(DISTINCT predicted)::BIGINT AS predictions, count(DISTINCT gold)::BIGINT AS golds, round(count(*) FILTER (WHERE predicted = gold) / count(*), 6) AS accuracy, round(any_value(majority) / count(*), 6) AS majority_accuracy, any_value(top_prediction) AS top_prediction, round(any_value(c) / count(*), 6) AS top_share
FROM a JOIN g USING (family) JOIN t USING (family) GROUP BY a.family""")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoning.collapse(answers(spark, sf_dir))


@add(f"WITH {ANSWERS} SELECT family, count(*)::BIGINT AS n, round((count(*) FILTER (WHERE predicted = gold) - sum(1 / (n_entities + 1))) / sqrt(sum(1 / (n_entities + 1) * (1 - 1 / (n_entities + 1)))), 5) AS z FROM a GROUP BY family")
def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = 1 / (F.col("n_entities") + 1)
    sums = answers(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("gold")).alias("k"), F.sum(p).alias("m"), F.sum(p * (1 - p)).alias("v"))
    return sums.select("family", "n", F.round(reasoning.z_score(F.col("k"), F.col("m"), F.col("v")), 5).alias("z"))


# -------------------------------------------------------------------------------------------------------- health
@add("""WITH j AS (SELECT event_type AS job, max(ts) AS last, count(*) AS collected, count(*) FILTER (WHERE value < 1) AS errors, count(*) FILTER (WHERE value > 400) AS limits, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00') AS delta FROM events GROUP BY event_type),
n AS (SELECT max(ts) AS now FROM events) SELECT job, collected::BIGINT AS collected, errors::BIGINT AS errors, CASE WHEN job = 'purchase' THEN 'FINISHED' WHEN epoch(now) - epoch(last) > 900 OR delta = 0 OR errors / collected > 0.1 THEN 'STALLED' WHEN limits / collected > 0.05 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM j, n""")
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as jobs; the last event of all is now."""
    events = table(spark, sf_dir, "events")
    jobs = events.groupBy(F.col("event_type").alias("job")).agg(F.max("ts").alias("last"), F.count("*").alias("collected"), F.count_if(F.col("value") < 1).alias("errors"), F.count_if(F.col("value") > 400).alias("limits"), F.count_if(F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp")).alias("delta"))
    now = events.agg(F.max("ts").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) / 1e6 - F.unix_micros(F.col("last").cast("timestamp")) / 1e6
    state = health.status(F.col("job") == "purchase", F.lit(True), age, F.col("delta"), F.col("collected"), F.col("errors"), F.col("limits"), F.lit(None).cast("double"), F.lit(0), F.lit(100.0))
    return jobs.join(F.broadcast(now)).select("job", "collected", "errors", state.alias("status"))


@add("""WITH s AS (SELECT event_type AS job, date_trunc('hour', ts) AS t, count(*) AS documents FROM events GROUP BY ALL), l AS (SELECT *, lag(documents) OVER w AS p, lag(t) OVER w AS q FROM s WINDOW w AS (PARTITION BY job ORDER BY t))
SELECT job, strftime(t, '%Y-%m-%d %H') AS hour, documents::BIGINT AS documents, (documents - p)::BIGINT AS delta, round((documents - p) / ((epoch(t) - epoch(q)) / 60), 6) AS per_minute FROM l""")
def docs_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job"), F.date_trunc("hour", "ts").cast("timestamp").alias("at")).agg(F.count("*").alias("documents"))
    return health.deltas(s, "job", "at", "documents").select("job", F.date_format("at", "yyyy-MM-dd HH").alias("hour"), "documents", "delta", F.round("per_minute", 6).alias("per_minute"))


@add("""SELECT CASE WHEN event_id % 13 = 0 THEN 'request_failed' WHEN event_id % 7 = 0 THEN 'http_404' WHEN event_id % 5 = 0 THEN 'json_parse_failed' WHEN event_id % 3 = 0 THEN 'no_files_listed' WHEN event_id % 2 = 0 THEN 'HAS_TEXT_LAYER' ELSE 'genuinely_no_text_layer' END AS verdict, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def recheck_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    file = F.struct(F.when(e % 4 == 0, "a_djvu.txt").otherwise("a.pdf").alias("name"), F.when((e % 2 == 0) & (e % 4 != 0), "DjVuTXT").otherwise("PDF").alias("format"))
    rows = table(spark, sf_dir, "events").select(F.when(e % 13 == 0, F.lit(None)).when(e % 7 == 0, 404).otherwise(200).cast("int").alias("http"), (e % 5 != 0).alias("parsed"), F.when(e % 3 == 0, F.slice(F.array(file), 1, 0)).otherwise(F.array(file)).alias("files"))
    return rows.groupBy(health.text_layer(F.col("http"), F.col("parsed"), F.col("files")).alias("verdict")).agg(F.count("*").alias("n"))


@add(f"""WITH {D}, p AS (SELECT n_words, lang = 'en' AS accepted FROM d), o AS (SELECT n_words, row_number() OVER (ORDER BY n_words) AS k, count(*) OVER () AS c FROM p WHERE accepted), s AS (SELECT count(*) AS probes, count(*) FILTER (WHERE accepted) AS ok, avg(n_words) FILTER (WHERE accepted) AS mean FROM p), m AS (SELECT max(n_words) AS med FROM o WHERE k = floor(c / 2) + 1)
SELECT probes::BIGINT AS probes, ok::BIGINT AS accepted, round(ok / probes, 4) AS accept_share, floor(mean)::BIGINT AS mean_words, med::BIGINT AS median_words, floor(50000 * (ok / probes) * mean)::BIGINT AS words_by_mean, floor(50000 * (ok / probes) * med)::BIGINT AS words_by_median FROM s, m""")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.extrapolated(documents(spark, sf_dir).select("n_words", (F.col("lang") == "en").alias("accepted")), 50_000)


# -------------------------------------------------------------------------------------------------------- streams
@add(f"SELECT sha256({CANON}) AS hash, count(*)::BIGINT * 0 + 1 AS n FROM documents GROUP BY 1")
def stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ingest.drained(ingest.exact_dedup(ingest.stream(spark, f"{sf_dir}/documents.parquet", docs.schema)).select("hash"), "dedup")
    return found.groupBy("hash").agg(F.count("*").alias("n"))


@add(f"WITH {D} SELECT doc_id, n_words, CASE WHEN n_words < 40 THEN 'too_short' END AS reason FROM d")
def stream_ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ingest.drained(ingest.gated(ingest.stream(spark, f"{sf_dir}/documents.parquet", docs.schema)).select("doc_id", "n_words", "reason"), "gate")


@add("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    live = ingest.stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.drained(ingest.windowed(live, "ts").select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n"), "windows")
