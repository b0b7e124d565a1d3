"""Accounts of manifests, jobs, budgets, item sets and funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.functions import language, text
from weftcorpus.functions.text import ratio
from weftcorpus.operators import accounts, batches, dedup, gates, ingest, reasoning
from weftcorpus.plans import dedup as dedup_plans
from weftcorpus.plans import jobs, texts
from weftcorpus.plans.base import D, W, Register, documents, table
from weftcorpus.plans.corpus import GATED, LATIN, SHOWN
from weftcorpus.plans.dedup import CAP, SPLIT, unique_documents
from weftcorpus.plans.tokens import PIECES, pieces

REGISTER = Register()
add = REGISTER.add


# ----------------------------------------------------------------------------------------------------- manifests
@add("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'Latin' ELSE 'Mixed' END AS script, CASE WHEN doc_id % 3 = 0 THEN lang WHEN lang = 'es' THEN 'unknown' ELSE 'label_' || lang END AS language, CASE WHEN doc_id % 4 > 0 THEN n_chars / 1000 END AS score FROM documents),
x AS (SELECT 'script' AS kind, script AS value, score FROM m UNION ALL SELECT 'language', language, score FROM m) SELECT kind, value, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score FROM x GROUP BY ALL""")
def manifest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, languages and mean scores of manifest rows, labels and languages missing here and there."""
    i, lang = F.col("doc_id"), F.col("lang")
    rows = table(spark, sf_dir, "documents").select(
        F.when(i % 5 == 0, F.lit(None)).when(i % 2 == 0, "Latin").otherwise("Mixed").alias("script"), F.when(i % 3 == 0, "").when(lang == "es", F.lit(None)).otherwise(F.concat(F.lit("label_"), lang)).alias("langid_label"),
        F.when((lang != "es") | (i % 3 == 0), lang).alias("language"), F.when(i % 4 > 0, F.col("n_chars") / 1000).alias("langid_score"),
    )
    return accounts.manifest_profile(rows).withColumn("mean_score", F.round("mean_score", 6))


@add("""WITH v AS (SELECT unnest(CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 4 = 1 THEN [event_type] ELSE [event_type, 'user ' || (user_id % 10)] END) AS value FROM events) SELECT value, count(*)::BIGINT AS n FROM v GROUP BY value ORDER BY n DESC, value LIMIT 12""")
def collection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most common values of a field that is a list, a single value or nothing."""
    e, kind = F.col("event_id"), F.col("event_type")
    listed = F.to_json(F.array(kind, F.concat(F.lit("user "), F.col("user_id") % 10)))
    json = F.when(e % 4 == 0, F.lit(None)).when(e % 4 == 1, F.concat(F.lit('"'), kind, F.lit('"'))).otherwise(listed)
    return accounts.top_values(table(spark, sf_dir, "events").select(json.alias("j")), accounts.list_or_one(F.col("j")), 12)


@add(f"""WITH {D}, m AS (SELECT 'job_' || source AS job_name, count(*) AS rows_, sum(n_words) AS words_ FROM d WHERE NOT is_manual GROUP BY 1) SELECT DISTINCT 'job_' || source AS job_name, coalesce(rows_, 0)::BIGINT AS manifest_rows, coalesce(words_, 0)::BIGINT AS manifest_words FROM d LEFT JOIN m ON m.job_name = 'job_' || d.source""")
def jobs_with_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each source; manual ones have written no manifest."""
    docs = documents(spark, sf_dir)
    name = F.concat(F.lit("job_"), "source")
    manifests = docs.where("not is_manual").select(name.alias("source_name"), F.col("n_words").alias("words"))
    return accounts.jobs_with_manifests(docs.select(name.alias("job_name")).distinct(), manifests)


@add(f"""WITH {D}, v AS (SELECT lang, avg(n_words) FILTER (WHERE NOT is_manual) AS v, avg(n_words) FILTER (WHERE is_manual AND lang <> 'es') AS b FROM d GROUP BY lang) SELECT lang, round(v, 6) AS words, round(b, 6) AS baseline, round(v / b, 6) AS ratio, round(v - b, 6) AS lift FROM v""")
def baseline_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean words by language against those of manual documents, which one language lacks."""
    docs = documents(spark, sf_dir)
    of = lambda df: df.groupBy("lang").agg(F.avg("n_words").alias("words"))
    found = accounts.baseline(docs.select("lang").distinct().join(of(docs.where("not is_manual")), "lang", "left"), of(docs.where("is_manual and lang <> 'es'")), "lang", "words")
    return found.select("lang", *[F.round(c, 6).alias(c) for c in ("words", "baseline", "ratio", "lift")])


# --------------------------------------------------------------------------------------------------------- plans
@add(f"""WITH {D}, t AS (SELECT is_manual, n_words, coalesce({PIECES}, 0) AS k FROM d), s AS (SELECT sum(k) FILTER (WHERE is_manual) AS mt, sum(k) FILTER (WHERE NOT is_manual) AS dt, sum(k) FILTER (WHERE is_manual) / sum(n_words) FILTER (WHERE is_manual) AS mf, sum(k) FILTER (WHERE NOT is_manual) / sum(n_words) FILTER (WHERE NOT is_manual) AS df FROM t),
g AS (SELECT *, greatest(2000000 - mt, 0) AS gap, greatest(9000000 - greatest(mt, 2000000), 0) AS target FROM s), h AS (SELECT *, greatest(target - dt, 0) AS missing, mt / 0.2 - mt AS most FROM g), a AS (SELECT *, least(missing, greatest(most - dt, 0)) AS adm FROM h)
SELECT floor(gap)::BIGINT AS manual_gap_tokens, floor(gap / mf)::BIGINT AS manual_gap_words, floor(target)::BIGINT AS downloaded_target_tokens, floor(missing)::BIGINT AS downloaded_gap_tokens, floor(missing / df)::BIGINT AS downloaded_gap_words, floor(most)::BIGINT AS downloaded_most_tokens,
  floor(adm)::BIGINT AS admissible_tokens, floor(adm / df)::BIGINT AS admissible_words, floor(mt + dt + adm)::BIGINT AS projected_tokens FROM a""")
def collection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in tokens and words on both sides, what the ratio still admits, and where that leads."""
    of = lambda c, manual: F.sum(F.when(F.col("is_manual") == F.lit(manual), F.col(c)))
    sums = pieces(documents(spark, sf_dir)).agg(
        of("n_tokens", True).alias("manual_tokens"), of("n_tokens", False).alias("downloaded_tokens"), (of("n_tokens", True) / of("n_words", True)).alias("manual_fertility"), (of("n_tokens", False) / of("n_words", False)).alias("downloaded_fertility")
    )
    return accounts.collection_plan(sums, 2_000_000, 9_000_000)


@add("""WITH v AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'HAS_TEXT_LAYER' ELSE 'genuinely_no_text_layer' END AS verdict FROM events), s AS (SELECT count(*) AS c, count(*) FILTER (WHERE verdict = 'HAS_TEXT_LAYER') AS r FROM v)
SELECT c::BIGINT AS checked, r::BIGINT AS recoverable, round(r / c, 6) AS share, floor(r / c * 8000)::BIGINT AS items, floor(r / c * 8000 * 1250.5)::BIGINT AS words FROM s""")
def recheck_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "HAS_TEXT_LAYER").otherwise("genuinely_no_text_layer").alias("verdict"))
    return accounts.recheck_estimate(verdicts, 8000, 1250.5)


# --------------------------------------------------------------------------------------------- checks of item sets
@add(f"""WITH {texts.LANGID}, w AS (SELECT doc_id FROM g WHERE label NOT IN ('en', 'undecided') ORDER BY doc_id LIMIT 5) SELECT 'en' AS expected, count(*) FILTER (WHERE label = 'en')::BIGINT AS as_expected, count(*) FILTER (WHERE label = 'undecided')::BIGINT AS undecided, round(avg(score), 5) AS mean_score,
  count(*) FILTER (WHERE label NOT IN ('en', 'undecided'))::BIGINT AS misassigned, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM w) AS misassigned_examples FROM g""")
def language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items that should be English."""
    items = texts.labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), "label", "score")
    found = accounts.language_check(items, "en")
    return found.withColumn("mean_score", F.round("mean_score", 5)).withColumn("misassigned_examples", F.array_join("misassigned_examples", ","))


@add("SELECT * FROM (VALUES ('marathi', 'mr', 0::BIGINT), ('konkani', 'kok', 0)) t(language, expected, misassigned)")
def reasoning_language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated items by language identification: none is taken for the other language."""
    items = jobs.sets(spark).select("language", "id", language.two_way(reasoning.full_text(True)).alias("r")).select("language", "id", "r.label", "r.score")
    each = [accounts.language_check(items.where(F.col("language") == name), label).select(F.lit(name).alias("language"), "expected", "misassigned") for name, label in (("marathi", "mr"), ("konkani", "kok"))]
    return reduce(DataFrame.unionByName, each)


@add(f"""WITH t AS (SELECT len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x7F]'))) AS b FROM (SELECT {W} AS w FROM documents)), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM t)
SELECT min(n)::INT AS tokens_min, (SELECT max(n) FROM o WHERE k = c // 2)::INT AS tokens_median, max(n)::INT AS tokens_max, round(avg(n), 2) AS tokens_mean, sum(b)::BIGINT AS byte_fallback_tokens, round(sum(b) / sum(n), 8) AS byte_fallback_rate FROM t""")
def token_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as tokens, those beyond ASCII as fallen back to bytes."""
    rows = documents(spark, sf_dir).select(F.size("w").alias("n_tokens"), F.size(F.filter("w", lambda x: F.rlike(x, F.lit(r"[^\x00-\x7F]")))).alias("n_bytes"))
    return accounts.token_check(rows)


@add(f"WITH {jobs.BUCKETS}, c AS (SELECT bucket, predicted, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, predicted) AS rank FROM c) SELECT bucket, predicted, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 6")
def error_top_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most common predictions of each class."""
    found = reasoning.classified(jobs.answers(spark, sf_dir), jobs.pool(spark, ["u4", "u5", "u6"]), jobs.pool(spark, ["u0", "u1", "u2", "u3"]), jobs.pool(spark, ["u7"]))
    return accounts.top_by_group(found, ["bucket"], "predicted", 6)


@add(f"WITH {jobs.ANSWERS}, g AS (SELECT family, max(c) AS majority FROM (SELECT family, gold, count(*) AS c FROM a GROUP BY ALL) GROUP BY family) SELECT a.family, count(*)::BIGINT AS n, round(sum(1 / (n_entities + 1)), 6) AS uniform, any_value(majority)::BIGINT AS majority FROM a JOIN g USING (family) GROUP BY a.family")
def majority_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.majority_floor(jobs.answers(spark, sf_dir)).withColumn("uniform", F.round("uniform", 6))


@add()
def one_tailed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By family and over all: hits against chance, z, and the chance of as many."""
    p = 1 / (F.col("n_entities") + 1)
    sums = jobs.answers(spark, sf_dir).rollup("family").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("gold")).alias("hits"), F.sum(p).alias("m"), F.sum(p * (1 - p)).alias("v"))
    return sums.withColumn("z", reasoning.z_score(F.col("hits"), F.col("m"), F.col("v"))).select("family", "n", "hits", F.round("z", 5).alias("z"), accounts.one_tailed(F.col("z")).alias("p"))


@add(f"WITH {jobs.ANSWERS}, s AS (SELECT family, avg((predicted = gold)::INT) FILTER (WHERE event_id % 2 = 0) AS b, avg((predicted = gold)::INT) FILTER (WHERE event_id % 2 = 1) AS a FROM a GROUP BY family) SELECT family, round(a, 6) AS after, round(b, 6) AS before, round(a - b, 6) AS delta FROM s")
def score_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of one run less that of another, by family."""
    run = F.when(F.col("event_id") % 2 == 0, "pretrained").otherwise("finetuned")
    each = jobs.answers(spark, sf_dir).withColumn("run", run).groupBy("family", "run").agg(F.avg((F.col("predicted") == F.col("gold")).cast("int")).alias("accuracy"))
    return accounts.deltas(each, ["family"], "run", "accuracy", "finetuned", "pretrained").select("family", *[F.round(c, 6).alias(c) for c in ("after", "before", "delta")])


@add("SELECT event_id, event_type || event_id AS prompt, 'g' || (event_id % 9) AS generated FROM events")
def generations_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items beside what was generated for them."""
    events = table(spark, sf_dir, "events")
    return accounts.zipped(events.select("event_id", F.concat("event_type", "event_id").alias("prompt")), events.select("event_id", F.concat(F.lit("g"), F.col("event_id") % 9).alias("generated")), "event_id")


@add("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations) SELECT conv_id, turn, role FROM r WHERE k <= 7")
def items_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven turns of each role, in file order."""
    order = Window.partitionBy("role").orderBy("conv_id", "turn")
    return table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(order)).where("k <= 7").select("conv_id", "turn", "role")


# ------------------------------------------------------------------------------------------------------- corpora
MARKED_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents), m AS (SELECT *, pos % 5 = 1 AND pos > 1 AS is_marker FROM l)"


@add(f"""WITH {MARKED_LINES}, u AS (SELECT line, is_marker, trim(line) = '' AS blank FROM m), x AS (SELECT *, NOT is_marker AND NOT blank AS usable FROM u)
SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE blank AND NOT is_marker)::BIGINT AS empty, count(*) FILTER (WHERE is_marker)::BIGINT AS markers, count(*) FILTER (WHERE usable)::BIGINT AS usable, sum(length(line)) FILTER (WHERE usable)::BIGINT AS chars,
  sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))) FILTER (WHERE usable)::BIGINT AS words, round(avg(length(line)) FILTER (WHERE usable), 4) AS mean_chars, round(100 * sum(length(regexp_replace(line, '[^A-Za-z]', '', 'g'))) FILTER (WHERE usable) / sum(length(line)) FILTER (WHERE usable), 4) AS latin_percent FROM x""")
def books_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, each fifth a marker: what is usable. The percent is of all characters, as the report has it."""
    rows = table(spark, sf_dir, "documents").select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    marker, blank = (F.col("pos") % 5 == 0) & (F.col("pos") > 0), text.trim_ws(F.col("line")) == ""
    x = rows.select("line", marker.alias("marker"), blank.alias("blank")).withColumn("usable", ~F.col("marker") & ~F.col("blank"))
    of = lambda c: F.when(F.col("usable"), c)
    return x.agg(
        F.count("*").alias("rows"), F.count_if(F.col("blank") & ~F.col("marker")).alias("empty"), F.count_if("marker").alias("markers"), F.count_if("usable").alias("usable"), F.sum(of(F.length("line"))).alias("chars"), F.sum(of(text.n_words(F.col("line")))).alias("words"),
        F.round(F.avg(of(F.length("line"))), 4).alias("mean_chars"), F.round(100 * F.sum(of(text.count_of(F.col("line"), "[A-Za-z]"))) / F.sum(of(F.length("line"))), 4).alias("latin_percent"),
    )


@add(f"WITH {D} SELECT lang, count(*)::BIGINT AS pages, sum(n_words)::BIGINT AS words, sum(n_chars)::BIGINT AS chars, round(avg(n_words), 4) AS mean_words, round(avg(n_chars), 4) AS mean_chars, round(100.0 * count(*) / (SELECT count(*) FROM d), 4) AS percent FROM d GROUP BY lang")
def metadata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("pages"), F.sum("n_words").alias("words"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_words"), 4).alias("mean_words"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return sums.withColumn("percent", F.round(100.0 * F.col("pages") / F.sum("pages").over(Window.partitionBy()), 4))


@add(f"WITH {D}, t AS (SELECT n_words, n_chars, coalesce({PIECES}, 0) AS k FROM d), s AS (SELECT sum(k) AS k, sum(n_words) AS w, sum(n_chars) AS c FROM t) SELECT round(k / w, 6) AS tokens_per_word, round(c / k, 6) AS chars_per_token, floor(k / w * 500000000)::BIGINT AS tokens_of_target, floor(500000000 / (k / w))::BIGINT AS words_for_target FROM s")
def tokenizer_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of a tokenizer, and what they make over half a billion words or tokens."""
    s = pieces(documents(spark, sf_dir)).agg(F.sum("n_tokens").alias("k"), F.sum("n_words").alias("w"), F.sum("n_chars").alias("c"))
    fertility = F.col("k") / F.col("w")
    return s.select(F.round(fertility, 6).alias("tokens_per_word"), F.round(F.col("c") / F.col("k"), 6).alias("chars_per_token"), F.floor(fertility * 500_000_000).cast("long").alias("tokens_of_target"), F.floor(500_000_000 / fertility).cast("long").alias("words_for_target"))


@add(f"""WITH {D}, g AS (SELECT source, lang, {LATIN} / nullif({SHOWN}, 0) AS latin, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Z}} .,;:!?()\\[\\]{{}}"''`\\-–—/\\\\|%&*+=<>@#$^~\\n\\t।॥…‘’“”]', '', 'g')) / length(text) AS junk FROM d WHERE length(text) > 0)
SELECT source, round(min(latin), 5) AS min_latin, round(avg(latin), 5) AS mean_latin, round(avg(junk), 8) AS mean_junk, round(max(junk), 8) AS max_junk, round(count(*) FILTER (WHERE lang = 'en') / count(*), 6) AS english_share FROM g GROUP BY source""")
def audit_script_and_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: least and mean share of the script, junk characters, share of a label."""
    counts = text.counts_of(F.col("text"), "[A-Za-z]", text.NOT_WS)
    latin = ratio(counts[0], counts[1])
    g = table(spark, sf_dir, "documents").where("length(text) > 0").select("source", "lang", latin.alias("latin"), text.junk_chars(F.col("text")).alias("junk"))
    return g.groupBy("source").agg(F.round(F.min("latin"), 5).alias("min_latin"), F.round(F.avg("latin"), 5).alias("mean_latin"), F.round(F.avg("junk"), 8).alias("mean_junk"), F.round(F.max("junk"), 8).alias("max_junk"), F.round(F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("english_share"))


@add(f"WITH m AS ({texts.MARKED}), l AS (SELECT doc_id, unnest({texts.LOWER}) AS w FROM documents), c AS (SELECT doc_id, marker_lang, w, count(*) AS n FROM l JOIN m USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, marker_lang ORDER BY n DESC, w) AS rank FROM c) SELECT doc_id, marker_lang, w, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 8")
def marker_breakdown_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most common marker words of each language in each document."""
    markers = spark.createDataFrame([(k, w) for k, ws in language.FIXTURE_MARKERS.items() for w in ws], "marker_lang string, w string")
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.lower("text"))).alias("w")).join(F.broadcast(markers), "w")  # a fixed list of words
    return accounts.top_by_group(found, ["doc_id", "marker_lang"], "w", 8)


@add(f"""WITH {SPLIT}, t AS (SELECT split, n_words, coalesce({PIECES}, 0) AS k FROM s) SELECT split, count(*)::BIGINT AS documents, sum(n_words)::BIGINT AS words, sum(k)::BIGINT AS tokens FROM t GROUP BY split""")
def tokens_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pieces(dedup.split(unique_documents(spark, sf_dir), ["source", "is_manual"], "doc_id"))
    return s.groupBy("split").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"))


@add(f"""WITH {SPLIT}, o2 AS (SELECT n_words, sum(n_words) OVER (PARTITION BY source ORDER BY sha256('{dedup.SPLIT_SEED}:' || doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) <= floor(sum(n_words) OVER (PARTITION BY source) * {CAP}) AS kept FROM u WHERE NOT is_manual),
k AS (SELECT split, n_words, is_manual, coalesce({PIECES}, 0) AS t FROM s)
SELECT 3 AS stage, 'exact_duplicates' AS metric, ((SELECT count(*) FROM h) - (SELECT count(*) FROM u))::BIGINT AS value UNION ALL SELECT 4, 'ratio_cap_documents', (SELECT count(*) FROM o2 WHERE NOT kept)::BIGINT UNION ALL SELECT 4, 'ratio_cap_words', (SELECT sum(n_words) FROM o2 WHERE NOT kept)::BIGINT
UNION ALL SELECT 5, split || '_documents', count(*)::BIGINT FROM k GROUP BY split UNION ALL SELECT 5, split || '_words', sum(n_words)::BIGINT FROM k GROUP BY split UNION ALL SELECT 5, split || '_manual_words', coalesce(sum(n_words) FILTER (WHERE is_manual), 0)::BIGINT FROM k GROUP BY split
UNION ALL SELECT 5, 'leaked_documents', 0::BIGINT UNION ALL SELECT 6, split || '_tokens', sum(t)::BIGINT FROM k GROUP BY split""")
def funnel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages 3 to 6 as one long table: copies removed, what the cap drops, splits and their leaks, tokens."""
    ranked = dedup_plans.ranked(spark, sf_dir)
    unique = ranked.where("rank = 1").drop("rank")
    split = pieces(dedup.split(unique, ["source", "is_manual"], "doc_id"))
    metric = lambda stage, name, value: F.struct(F.lit(stage).alias("stage"), name.alias("metric"), value.cast("long").alias("value"))
    one = ranked.agg(metric(3, F.lit("exact_duplicates"), F.count_if(F.col("rank") > 1)).alias("m"))
    capped = dedup.prefix_fit(unique.where("not is_manual"), "source", "doc_id", "n_words", CAP).where("not kept").join(unique.select("doc_id", "n_words"), "doc_id")
    two = capped.agg(F.count("*").alias("d"), F.sum("n_words").alias("w")).select(F.explode(F.array(metric(4, F.lit("ratio_cap_documents"), F.col("d")), metric(4, F.lit("ratio_cap_words"), F.col("w")))).alias("m"))
    sums = split.groupBy("split").agg(F.count("*").alias("d"), F.sum("n_words").alias("w"), F.coalesce(F.sum(F.when(F.col("is_manual"), F.col("n_words"))), F.lit(0)).alias("mw"), F.sum("n_tokens").alias("t"))
    named = lambda suffix: F.concat("split", F.lit(suffix))
    three = sums.select(F.explode(F.array(metric(5, named("_documents"), F.col("d")), metric(5, named("_words"), F.col("w")), metric(5, named("_manual_words"), F.col("mw")), metric(6, named("_tokens"), F.col("t")))).alias("m"))
    leaked = dedup.leaks(split, "hash").agg(metric(5, F.lit("leaked_documents"), F.count("*")).alias("m"))
    return reduce(DataFrame.unionByName, [one, two, three, leaked]).select("m.*")


# --------------------------------------------------------------------------------------------------------- gates
@add(f"WITH {D}, g AS (SELECT CASE WHEN n_words < 25 THEN 'doc_too_short' WHEN {LATIN} / nullif({SHOWN}, 0) < 0.7 THEN 'doc_not_devanagari' WHEN lang = 'es' THEN 'doc_langid_es' ELSE 'accepted' END AS reason FROM d) SELECT reason, count(*)::BIGINT AS documents FROM g GROUP BY reason")
def document_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of packed documents, with Latin as the script."""
    counts = text.counts_of(F.col("text"), "[A-Za-z]", text.NOT_WS)
    latin = ratio(counts[0], counts[1])
    why = ingest.document_reason(gates.Gate(25, 0.70, "es"), F.col("n_words"), latin, F.col("lang"))
    return documents(spark, sf_dir).groupBy(F.coalesce(why, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("documents"))


@add(f"""WITH {D}, g AS (SELECT CASE WHEN n_words < 50 THEN 'too_short' ELSE 'not_devanagari_excluded' END AS strict, CASE WHEN n_words < 50 THEN 'too_short' WHEN {SHOWN} = 0 THEN 'script_not_recognised' ELSE 'accepted' END AS every FROM d) SELECT strict, every AS all_scripts, count(*)::BIGINT AS pages FROM g GROUP BY ALL""")
def wiki_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of wiki pages with one script and with all of them."""
    docs = documents(spark, sf_dir).select("n_words", language.script_profile(F.col("text")).alias("p"), "lang")
    why = lambda every: F.coalesce(ingest.wiki_page_reason(gates.GATES["wiki"], F.col("n_words"), F.col("p"), F.col("lang"), every), F.lit("accepted"))
    return docs.select(why(False).alias("strict"), why(True).alias("all_scripts")).groupBy("strict", "all_scripts").agg(F.count("*").alias("pages"))


@add(f"WITH {GATED} SELECT source, count(*)::BIGINT AS documents, coalesce(sum(n_words), 0)::BIGINT AS words FROM g WHERE reason IS NULL GROUP BY ROLLUP(source)")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents and words of each dataset, and of all."""
    return ingest.totals(gates.fixture_gate(documents(spark, sf_dir)), "source", "text")


@add()
def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision on each document: gate, exact copies, near copies, in the order of ids."""
    docs = gates.fixture_gate(documents(spark, sf_dir)).withColumnRenamed("reason", "gate")
    return ingest.decided(docs, "doc_id", "text", F.col("gate"), ["doc_id"]).select("doc_id", "reason")


# ------------------------------------------------------------------------------------------------- small formats
@add("SELECT event_id, CASE WHEN event_id * 7 - 50 < 0 THEN '0s' WHEN event_id * 7 - 50 < 60 THEN (event_id * 7 - 50) || 's' WHEN event_id * 7 - 50 < 3600 THEN ((event_id * 7 - 50) // 60) || 'm ' || ((event_id * 7 - 50) % 60) || 's' ELSE ((event_id * 7 - 50) // 3600) || 'h ' || ((event_id * 7 - 50) % 3600 // 60) || 'm' END AS duration FROM events")
def human_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", accounts.human_duration(F.col("event_id") * 7 - 50).alias("duration"))


@add("SELECT doc_id, 0.0::DOUBLE AS devanagari, coalesce(round(100 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(text), 0), 4), 0) AS latin FROM documents WHERE text IS NOT NULL")
def script_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", accounts.script_percentages(F.col("text")).alias("p"))
    return found.select("doc_id", "p.devanagari", "p.latin")


@add("SELECT k::BIGINT AS k, round(1 - pow(1 - pow(k / 100, 8), 16), 9) AS wide, round(1 - pow(1 - pow(k / 100, 4), 32), 9) AS narrow FROM (SELECT unnest(range(101)) AS k)")
def lsh_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that signatures of each similarity become candidates, with either set of bands."""
    s = F.col("id") / 100
    return spark.range(101).select(F.col("id").alias("k"), F.round(batches.band_probability(s, 16, 8), 9).alias("wide"), F.round(batches.band_probability(s, 32, 4), 9).alias("narrow"))


@add("""WITH p AS (SELECT event_id % 20 AS pos, user_id, abs(value) + 1 AS w, 'u' || (user_id % 10) AS piece FROM events), n AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS p FROM p),
k AS (SELECT p, CASE WHEN pos = 0 THEN 'first_token' WHEN piece IN ('u1', 'u2') THEN 'entity_names' WHEN piece IN ('u3') THEN 'numeric_values' WHEN piece = 'u4' THEN 'attribute_word' WHEN pos >= 16 THEN 'question_tail' ELSE 'other' END AS kind FROM n)
SELECT kind, round(100.0 * sum(p) / (SELECT count(DISTINCT user_id) FROM events), 2) AS share FROM k GROUP BY kind""")
def answer_position_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention by what stands at a position, over users as prompts."""
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("pos"), "user_id", (F.abs("value") + 1).alias("w"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("piece"))
    p = events.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("user_id")))
    kind = batches.answer_position(F.col("pos"), F.col("piece"), F.lit(20), F.array(F.lit("u1"), F.lit("u2")), F.array(F.lit("u3")), F.lit("u4"))
    prompts = events.select("user_id").distinct().count()
    return batches.position_shares(p.withColumn("kind", kind), "kind", "p", max(1, prompts))
