"""Accounts of a corpus: provenance, statistics, funnels, status, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.functions.language import script_profile
from weftcorpus.functions.text import NORMALIZATION_STEPS, normalize_whitespace, ratio
from weftcorpus.operators import gates, provenance, statistics
from weftcorpus.plans.base import D, Register, documents, table

REGISTER = Register()
add = REGISTER.add

ACCOUNT = """count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words, sum(n_chars)::BIGINT AS chars,
    coalesce(sum(n_words) FILTER (WHERE bucket = 'manual'), 0)::BIGINT AS manual_words, coalesce(sum(n_words) FILTER (WHERE bucket = 'downloaded'), 0)::BIGINT AS downloaded_words,
    coalesce(sum(n_words) FILTER (WHERE bucket = 'synthetic'), 0)::BIGINT AS synthetic_words,
    coalesce(round(coalesce(sum(n_words) FILTER (WHERE bucket = 'manual'), 0) / nullif(sum(n_words), 0), 6), 0) AS manual_share"""


@add(f"""WITH {D} SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE 'source' END AS scope, source, {ACCOUNT} FROM d GROUP BY GROUPING SETS ((), (source))""")
def provenance_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.accounting(documents(spark, sf_dir))


@add(f"""WITH {D}, t AS (SELECT sum(n_words) AS total, coalesce(sum(n_words) FILTER (WHERE is_manual), 0) AS manual FROM d)
SELECT total::BIGINT AS total_words, manual::BIGINT AS manual_words, (floor(manual / 0.2) - total)::BIGINT AS headroom_words, greatest(0, ceil(0.2 * total - manual))::BIGINT AS manual_shortfall,
  greatest(0, total - floor(manual / 0.2))::BIGINT AS words_to_drop, manual / total >= 0.2 AS meets_floor FROM t""")
def source_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = documents(spark, sf_dir).agg(F.sum("n_words").alias("t"), F.coalesce(F.sum(F.when(F.col("is_manual"), F.col("n_words"))), F.lit(0)).alias("m"))
    t, m = F.col("t"), F.col("m")
    room = provenance.headroom(m, t)
    return sums.select(
        t.alias("total_words"), m.alias("manual_words"), room.alias("headroom_words"), F.greatest(F.lit(0), F.ceil(t * F.lit(0.2) - m)).cast("long").alias("manual_shortfall"),
        F.greatest(F.lit(0).cast("long"), -room).alias("words_to_drop"), (m / t >= 0.2).alias("meets_floor"),
    )


@add(f"""WITH {D} SELECT source, any_value(is_manual) AS is_manual, any_value(collection_type) AS collection_type, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words,
  round(sum(n_words) / sum(sum(n_words)) OVER (), 6) AS share, row_number() OVER (ORDER BY sum(n_words) DESC, source)::INT AS rank FROM d GROUP BY source""")
def status_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = documents(spark, sf_dir).groupBy("source").agg(F.first("is_manual").alias("is_manual"), F.first("collection_type").alias("collection_type"), F.count("*").alias("documents"), F.sum("n_words").alias("words"))
    everything = Window.partitionBy()  # over sums by source, not over documents
    return sums.withColumn("share", F.round(F.col("words") / F.sum("words").over(everything), 6)).withColumn("rank", F.row_number().over(everything.orderBy(F.desc("words"), "source")))


@add(f"""WITH {D} SELECT bucket, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words, sum(n_chars)::BIGINT AS chars, count(DISTINCT source)::BIGINT AS sources,
  round(sum(n_words) / sum(sum(n_words)) OVER (), 6) AS word_share FROM d GROUP BY bucket""")
def corpus_stats_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = documents(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))
    return sums.withColumn("word_share", F.round(F.col("words") / F.sum("words").over(Window.partitionBy()), 6))


@add(f"""WITH {D}, r AS (SELECT bucket, n_words, row_number() OVER (PARTITION BY bucket ORDER BY n_words) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM d WHERE n_words > 0)
SELECT bucket, any_value(n)::BIGINT AS n, min(n_words)::BIGINT AS least, median(n_words) AS median, round(avg(n_words), 6) AS mean,
  max(n_words) FILTER (WHERE k = floor(n * 0.5) + 1)::BIGINT AS upper_median, max(n_words) FILTER (WHERE k = floor(n * 0.9) + 1)::BIGINT AS p90, max(n_words) FILTER (WHERE k = floor(n * 0.95) + 1)::BIGINT AS p95, max(n_words)::BIGINT AS most FROM r GROUP BY bucket""")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.lengths(documents(spark, sf_dir), "n_words", ["bucket"])


@add(f"""WITH {D}, c AS (SELECT bucket, length(text) AS raw, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) AS clean FROM d)
SELECT bucket, sum(raw)::BIGINT AS raw_chars, sum(clean)::BIGINT AS clean_chars, sum(raw - clean)::BIGINT AS removed, round(sum(raw - clean) / sum(raw), 8) AS loss_rate FROM c GROUP BY bucket""")
def cleaning_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("bucket", F.length("text").alias("raw"), F.length(normalize_whitespace(F.col("text"))).alias("clean"))
    sums = docs.groupBy("bucket").agg(F.sum("raw").alias("raw_chars"), F.sum("clean").alias("clean_chars"), F.sum(F.col("raw") - F.col("clean")).alias("removed"))
    return sums.withColumn("loss_rate", F.round(ratio(F.col("removed"), F.col("raw_chars")), 8))


@add(f"""WITH {D}, s AS (SELECT unnest(CASE bucket WHEN 'manual' THEN {NORMALIZATION_STEPS} || ['ocr_cleanup'] WHEN 'synthetic' THEN {NORMALIZATION_STEPS} || ['machine_translation'] ELSE {NORMALIZATION_STEPS} END) AS step, n_words FROM d)
SELECT step, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words FROM s GROUP BY step""")
def step_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [F.lit(s) for s in NORMALIZATION_STEPS]
    applied = F.when(F.col("bucket") == "manual", F.array(*steps, F.lit("ocr_cleanup"))).when(F.col("bucket") == "synthetic", F.array(*steps, F.lit("machine_translation"))).otherwise(F.array(*steps))
    return documents(spark, sf_dir).select("n_words", F.explode(applied).alias("step")).groupBy("step").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"))


SHOWN = "length(regexp_replace(text, '\\s+', '', 'g'))"
LATIN = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@add(f"""WITH p AS (SELECT {SHOWN} AS shown, {LATIN} AS latin FROM documents),
l AS (SELECT CASE WHEN shown = 0 THEN 'empty' WHEN latin / shown >= 0.7 THEN 'Latin' ELSE 'Mixed' END AS script FROM p)
SELECT script, count(*)::BIGINT AS documents, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY script""")
def script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(script_profile(F.col("text"))["script"].alias("script"))
    return statistics.histogram(found, "script")


@add(f"""SELECT doc_id, length(text)::BIGINT AS chars, {SHOWN}::BIGINT AS shown, {LATIN}::BIGINT AS latin, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS digits, 0::BIGINT AS devanagari, round({LATIN} / {SHOWN}, 5) AS latin_ratio FROM documents""")
def script_profile_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", script_profile(F.col("text")).alias("p"))
    return p.select("doc_id", "p.chars", "p.shown", "p.latin", "p.digits", "p.devanagari", F.round(ratio(F.col("p.latin"), F.col("p.shown")), 5).alias("latin_ratio"))


@add(f"""SELECT doc_id, source, round({LATIN} / {SHOWN}, 5) AS latin_ratio FROM documents WHERE {SHOWN} > 0 AND {LATIN} / {SHOWN} < 0.7""")
def mixed_script_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", "source", script_profile(F.col("text")).alias("p")).where("p.script = 'Mixed'")
    return p.select("doc_id", "source", F.round(ratio(F.col("p.latin"), F.col("p.shown")), 5).alias("latin_ratio"))


@add("""WITH l AS (SELECT text, length(text) AS n, len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM documents)
SELECT sum(lines)::BIGINT AS lines, sum(n)::BIGINT AS chars, sum(length(regexp_replace(text, '\\s+', '', 'g')))::BIGINT AS shown, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words,
  0::BIGINT AS devanagari, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g')))::BIGINT AS latin FROM l""")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.audit(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------------------------------------- funnels
GATED = f"""{D}, g AS (SELECT *, CASE WHEN n_words < 40 THEN 'too_short' WHEN {LATIN} / nullif({SHOWN}, 0) < 0.70 THEN 'not_enough_latin' WHEN lang = 'es' THEN 'langid_es_rejected' WHEN lang <> 'en' THEN 'langid_' || lang END AS reason FROM d)"""


@add(f"""WITH {GATED} SELECT coalesce(reason, 'accepted') AS reason, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words FROM g GROUP BY 1""")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.histogram(gates.fixture_gate(documents(spark, sf_dir)))


@add(f"""WITH {GATED}, h AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL, sha256(text) ORDER BY doc_id) END AS k FROM g)
SELECT bucket, count(*)::BIGINT AS fetched, count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS rejected, count(*) FILTER (WHERE reason IS NULL AND k > 1)::BIGINT AS duplicates, count(*) FILTER (WHERE k = 1)::BIGINT AS kept,
  coalesce(sum(n_words) FILTER (WHERE k = 1), 0)::BIGINT AS kept_words FROM h GROUP BY bucket""")
def funnel_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gates.fixture_gate(documents(spark, sf_dir)).withColumn("ok", F.col("reason").isNull())
    k = F.row_number().over(Window.partitionBy("ok", F.sha2("text", 256)).orderBy("doc_id"))
    gated = gated.withColumn("k", F.when(F.col("ok"), k))
    return gated.groupBy("bucket").agg(
        F.count("*").alias("fetched"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if(F.col("k") > 1).alias("duplicates"), F.count_if(F.col("k") == 1).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n_words"))), F.lit(0)).alias("kept_words"),
    )


@add("""WITH m AS (SELECT event_type AS job, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL)
SELECT k AS reason, sum(n)::BIGINT AS n, count(DISTINCT job)::BIGINT AS jobs FROM m GROUP BY k""")
def reasons_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.from_json("props", "map<string,string>")["k"].alias("k"))
    maps = events.groupBy("job", "k").count().groupBy("job").agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("reasons"))
    return maps.select("job", F.explode("reasons").alias("reason", "c")).groupBy("reason").agg(F.sum("c").alias("n"), F.countDistinct("job").alias("jobs"))


@add(f"""WITH {GATED}, m AS (SELECT lang, 'documents' AS metric, count(*)::BIGINT AS v FROM g GROUP BY lang UNION ALL SELECT lang, 'accepted', count(*) FILTER (WHERE reason IS NULL)::BIGINT FROM g GROUP BY lang UNION ALL SELECT lang, 'words', sum(n_words)::BIGINT FROM g GROUP BY lang)
SELECT metric, max(v) FILTER (WHERE lang = 'en') AS en, max(v) FILTER (WHERE lang = 'fr') AS fr, max(v) FILTER (WHERE lang = 'de') AS de, max(v) FILTER (WHERE lang = 'es') AS es FROM m GROUP BY metric""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = gates.fixture_gate(documents(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.sum("n_words").alias("words"))
    return sums.unpivot("lang", ["documents", "accepted", "words"], "metric", "v").groupBy("metric").pivot("lang", ["en", "fr", "de", "es"]).agg(F.max("v"))


@add(f"""WITH {GATED} SELECT source, count(*)::BIGINT AS documents, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS accepted, round(count(*) FILTER (WHERE reason IS NULL) / count(*), 6) AS yield FROM g GROUP BY source""")
def gate_yield_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gates.fixture_gate(documents(spark, sf_dir))
    sums = gated.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("reason").isNull()).alias("accepted"))
    return sums.withColumn("yield", F.round(F.col("accepted") / F.col("documents"), 6))


@add(f"""WITH {GATED} SELECT doc_id, reason FROM g""")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.fixture_gate(documents(spark, sf_dir)).select("doc_id", "reason")


@add(f"""WITH {GATED} SELECT l.quality, l.toxic, count(*)::BIGINT AS documents, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS accepted FROM g JOIN labels l USING (doc_id) GROUP BY l.quality, l.toxic""")
def gate_yield_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gates.fixture_gate(documents(spark, sf_dir)).join(table(spark, sf_dir, "labels"), "doc_id")
    return gated.groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.count_if(F.col("reason").isNull()).alias("accepted"))


@add(f"""WITH {D} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE n_words >= 50 AND length(text) >= 100)::BIGINT AS kept, round(count(*) FILTER (WHERE n_words >= 50 AND length(text) >= 100) / count(*), 6) AS retention FROM d""")
def length_filter_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.count_if((F.col("n_words") >= 50) & (F.length("text") >= 100))
    return documents(spark, sf_dir).agg(F.count("*").alias("total"), kept.alias("kept"), F.round(kept / F.count("*"), 6).alias("retention"))


@add(f"""WITH {D}, s AS (SELECT sum(n_words) FILTER (WHERE is_manual) AS m, sum(n_words) FILTER (WHERE NOT is_manual) AS l FROM d)
SELECT m::BIGINT AS manual_words, l::BIGINT AS downloaded_words, greatest(0, floor(m / 0.2 - m - l))::BIGINT AS may_add FROM s""")
def admission_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = documents(spark, sf_dir).agg(F.sum(F.when(F.col("is_manual"), F.col("n_words"))).alias("m"), F.sum(F.when(~F.col("is_manual"), F.col("n_words"))).alias("l"))
    return sums.select(F.col("m").alias("manual_words"), F.col("l").alias("downloaded_words"), F.greatest(F.lit(0), F.floor(F.col("m") / F.lit(0.2) - F.col("m") - F.col("l"))).cast("long").alias("may_add"))


@add(f"""WITH {D}, r AS (SELECT doc_id, n_words, source, row_number() OVER (PARTITION BY source ORDER BY n_words DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_words, doc_id) AS b FROM d)
SELECT source, doc_id, n_words, 'largest' AS side, a::INT AS rank FROM r WHERE a <= 3 UNION ALL SELECT source, doc_id, n_words, 'smallest', b::INT FROM r WHERE b <= 3""")
def extremes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "doc_id", "n_words")
    def ranked(side: str, *order) -> DataFrame:
        return docs.withColumn("side", F.lit(side)).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where("rank <= 3")
    return ranked("largest", F.desc("n_words"), "doc_id").unionByName(ranked("smallest", "n_words", "doc_id"))


@add(f"""WITH {D} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS value, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1""")
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.countDistinct("user_id").alias("users"))
