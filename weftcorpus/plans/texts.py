"""Texts: normalisation, extraction, language, audits, segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.functions import language, text
from weftcorpus.operators import gates, segment, statistics
from weftcorpus.plans.base import W, D, Register, documents, table

REGISTER = Register()
add = REGISTER.add


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


@add("""SELECT doc_id, nfc_normalize(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) AS clean FROM documents""")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_unicode(F.col("text")).alias("clean"))


@add("""SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS clean FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text"), keep_paragraphs=False).alias("clean"))


SAMPLES = [(1, "राम आला  ।गीता\nआली।"), (2, "a b​ c"), (3, "नमस्ते॥ जग"), (4, "12 किलो"), (5, "x\n\n\n\ny   z")]


@add("SELECT * FROM (VALUES (1, E'राम आला। गीता\\nआली।'), (2, 'a b c'), (3, 'नमस्ते॥ जग'), (4, '12 किलो'), (5, E'x\\n\\ny z')) t(id, clean)")
def danda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SAMPLES, "id int, t string").select("id", text.normalize(F.col("t")).alias("clean"))


@add("SELECT event_id, translate(CAST(event_id AS VARCHAR), '0123456789', '०१२३४५६७८९') AS numeral FROM events")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.number(F.col("event_id"), True).alias("numeral"))


BYLINES = [(1, "By Some One, City | The story begins"), (2, "Updated: March 3, 2024 IST The story"), (3, "2024-03-01T10:20:30+05:30 - The story"), (4, "| The  story"), (5, "The story")]


@add("SELECT * FROM (VALUES (1, 'The story begins'), (2, ''), (3, 'The story'), (4, 'The story'), (5, 'The story')) t(id, clean)")
def strip_byline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, BYLINES, "id int, t string").select("id", text.strip_byline(F.col("t")).alias("clean"))


WIKI = [(1, "{{a {{b}} c}} '''Bold''' [[Link|shown]] [[plain]]"), (2, "== Head ==\ntext <ref name=x>note</ref> more"), (3, "[[File:a.svg|right|[[x]] y]] end"), (4, "| row\nkept\n! head")]


@add("SELECT * FROM (VALUES (1, '{{a c}} Bold shown plain', 'Bold shown plain'), (2, 'Head text more', '== Head == text more'), (3, 'y]] end', 'File:a.svg|right|x y end'), (4, '| row kept ! head', 'kept')) t(id, once, residual)")
def wikitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, WIKI, "id int, t string").select("id", text.clean_wikitext(F.col("t")).alias("once"), text.clean_residual_wikitext(F.col("t")).alias("residual"))


@add()
def page_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of pages in Latin script, with their words."""
    article = text.article_text(F.col("html"), "[A-Za-z]")
    return table(spark, sf_dir, "pages").select("page_id", article.alias("article")).withColumn("n_words", text.n_words(F.col("article")))


@add("""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', ' ', 'gsi'), '<style\\b[^>]*>.*?</style>', ' ', 'gsi'), '<nav\\b[^>]*>.*?</nav>', ' ', 'gsi'), '<footer\\b[^>]*>.*?</footer>', ' ', 'gsi') AS h FROM pages)
SELECT page_id, len(regexp_extract_all(h, '<p\\b[^>]*>(.*?)</p>', 1, 'si'))::BIGINT AS paragraphs FROM c""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b[^>]*>.*?</\1>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all(cleaned, F.lit(text.PARAGRAPH), F.lit(1))).cast("long").alias("paragraphs"))


@add("""SELECT page_id, coalesce(regexp_matches(lower(url), '/(ampstories|web-story|webstory|photo|photos|gallery|video|videos|astro|astrology|horoscope|rashi|panchang|rashifal|live-blog|liveblog|podcast|shorts|quiz|poll|cartoon|epaper)(/|$|-)'), false) AS excluded FROM pages""")
def page_urls_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.rlike("url", F.lit(text.EXCLUDED_PATHS)), F.lit(False)).alias("excluded"))


@add("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[^?#]*'), '^https?://[^/]*', '') AS path FROM pages""")
def page_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_extract("url", "^[^?#]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_replace(bare, "^https?://[^/]*", "").alias("path"))


@add("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN true ELSE ts >= TIMESTAMP '2024-01-10 00:00:00' END AS passes FROM events")
def date_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text, some of them unreadable: those pass."""
    stamped = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", gates.date_ok(stamped, "2024-01-10 00:00:00").alias("passes"))


@add("SELECT page_id, CASE WHEN starts_with(url, 'http://m.') THEN 'mobile' WHEN starts_with(url, 'http://') THEN 'plain http' END AS reason FROM pages")
def prefix_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", gates.first_prefix(F.col("url"), {"http://m.": "mobile", "http://": "plain http"}).alias("reason"))


SITEMAP = [(1, "<sitemapindex><sitemap><loc>https://a/1.xml</loc><lastmod>2024-01-02</lastmod></sitemap><sitemap><loc>https://a/2.xml</loc></sitemap></sitemapindex>"), (2, "<urlset><url><loc>https://a/p</loc><lastmod>2025-02-03</lastmod></url></urlset>")]


@add("SELECT * FROM (VALUES (1, 'sitemap', 'https://a/1.xml', '2024-01-02'), (1, 'sitemap', 'https://a/2.xml', NULL), (2, 'url', 'https://a/p', '2025-02-03')) t(id, kind, loc, lastmod)")
def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.regexp_extract_all("x", F.lit(r"(?s)<(?:sitemap|url)>.*?</(?:sitemap|url)>"), F.lit(0))
    found = rows(spark, SITEMAP, "id int, x string").select("id", F.explode(entries).alias("e"))
    part = lambda tag: F.nullif(F.regexp_extract("e", f"(?s)<{tag}>\\s*(.*?)\\s*</{tag}>", 1), F.lit(""))
    return found.select("id", F.regexp_extract("e", "^<(\\w+)>", 1).alias("kind"), part("loc").alias("loc"), part("lastmod").alias("lastmod"))


# ---------------------------------------------------------------------------------------------------- languages
LOWER = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
HITS = ", ".join(f"len(list_filter(lw, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS {k}_h" for k, ws in sorted(language.FIXTURE_MARKERS.items()))
RANK = "list_reverse_sort([struct_pack(hits := de_h, lang := 'de'), struct_pack(hits := en_h, lang := 'en'), struct_pack(hits := es_h, lang := 'es'), struct_pack(hits := fr_h, lang := 'fr')])"
LANGID = f"""l AS (SELECT *, {LOWER} AS lw FROM documents), c AS (SELECT *, {HITS} FROM l), r AS (SELECT *, {RANK} AS k FROM c),
t AS (SELECT *, k[1].hits + k[2].hits AS total FROM r), s AS (SELECT *, CASE WHEN total >= 5 THEN (k[1].hits - k[2].hits) / total ELSE 0 END AS score FROM t),
g AS (SELECT doc_id, source, lang, CASE WHEN total >= 5 AND score >= 0.3 THEN k[1].lang ELSE 'undecided' END AS label, score, k[1].hits AS best_hits, k[2].hits AS second_hits FROM s)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", language.by_markers(text.words(F.lower("text"))).alias("r")).select("doc_id", "source", "lang", "r.*")


@add(f"WITH {LANGID} SELECT doc_id, label, round(score, 5) AS score, best_hits::INT AS best_hits, second_hits::INT AS second_hits FROM g")
def langid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", "label", F.round("score", 5).alias("score"), "best_hits", "second_hits")


@add(f"WITH {LANGID} SELECT lang, count(*)::BIGINT AS documents, count(*) FILTER (WHERE label = lang)::BIGINT AS own, count(*) FILTER (WHERE label <> lang AND label <> 'undecided')::BIGINT AS other, count(*) FILTER (WHERE label = 'undecided')::BIGINT AS undecided, round(count(*) FILTER (WHERE label <> lang AND label <> 'undecided') / count(*), 6) AS contamination FROM g GROUP BY lang")
def langid_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.count_if((F.col("label") != F.col("lang")) & (F.col("label") != "undecided"))
    return labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("label") == F.col("lang")).alias("own"), other.alias("other"), F.count_if(F.col("label") == "undecided").alias("undecided"), F.round(other / F.count("*"), 6).alias("contamination"))


@add(f"WITH {LANGID}, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM g) SELECT lang, round(avg(score), 6) AS mean, round(max(score) FILTER (WHERE k = n // 2 + 1), 6) AS middle, round(min(score), 6) AS least FROM o GROUP BY lang")
def langid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Window.partitionBy("lang")
    o = labelled(spark, sf_dir).withColumn("k", F.row_number().over(part.orderBy("score", "doc_id"))).withColumn("n", F.count("*").over(part))
    return o.groupBy("lang").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("score"))), 6).alias("middle"), F.round(F.min("score"), 6).alias("least"))


MARKED = " UNION ALL ".join(f"SELECT '{k}' AS marker_lang, unnest({ws}) AS w" for k, ws in sorted(language.FIXTURE_MARKERS.items()))


@add(f"WITH m AS ({MARKED}), l AS (SELECT lang, unnest({LOWER}) AS w FROM documents), c AS (SELECT lang, marker_lang, w, count(*) AS n FROM l JOIN m USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, marker_lang ORDER BY n DESC, w) AS rank FROM c) SELECT lang, marker_lang, w, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 8")
def marker_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = rows(spark, [(k, w) for k, ws in language.FIXTURE_MARKERS.items() for w in ws], "marker_lang string, w string")
    found = table(spark, sf_dir, "documents").select("lang", F.explode(text.words(F.lower("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("k"))
    counts = found.join(F.broadcast(markers), "w").groupBy("lang", "marker_lang", "w").agg(F.sum("k").alias("n"))  # a fixed list of words
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "marker_lang").orderBy(F.desc("n"), "w"))).where("rank <= 8")


MR_KOK = [(1, "राम आहे आणि गीता होती पण मी आणि तू नाही"), (2, "राम आसा आनी गीता ना पूण हांव आनी तूं ना"), (3, "एक"), (4, "no words here"), (5, "आहे आणि होती आसा आनी ना")]


@add("SELECT * FROM (VALUES (1, 'mr', 1.0::DOUBLE, 8, 0), (2, 'kok', -1.0::DOUBLE, 0, 8), (3, 'undecided', 0.0::DOUBLE, 0, 0), (4, 'undecided', 0.0::DOUBLE, 0, 0), (5, 'undecided', 0.0::DOUBLE, 3, 3)) t(id, label, score, positive_hits, negative_hits)")
def langid_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, MR_KOK, "id int, t string").select("id", language.two_way(F.col("t")).alias("r")).select("id", "r.label", "r.score", "r.positive_hits", "r.negative_hits")


@add()
def gates_by_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate on literal texts: name, id, reason."""
    docs = rows(spark, [(i, t * k) for i, t in MR_KOK[:2] for k in (1, 20)], "id int, t string")
    docs = docs.select("id", F.size(text.words(F.col("t"))).alias("n"), language.script_profile(F.col("t")).alias("p"), language.two_way(F.col("t")).alias("l"))
    each = [docs.select(F.lit(k).alias("gate"), "id", "n", gates.reason(g, F.col("n"), F.col("p.devanagari_ratio"), F.col("l.label"), F.col("l.score")).alias("reason")) for k, g in gates.GATES.items()]
    return reduce(DataFrame.unionByName, each)


# ------------------------------------------------------------------------------------------------------- audits
GRAMS5 = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
NOISE = "CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: length(x) <= 2 AND NOT regexp_matches(x, '^[0-9]+$'))) / len(w) END"
REPEAT = f"CASE WHEN len(w) < 20 THEN 0 ELSE 1 - len(list_distinct({GRAMS5})) / len({GRAMS5}) END"


@add(f"SELECT doc_id, round({NOISE}, 6) AS noise FROM (SELECT doc_id, {W} AS w FROM documents)")
def ocr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.ocr_noise(text.words(F.col("text"))), 6).alias("noise"))


@add("""SELECT doc_id, round(length(regexp_replace(text, '[\\p{L}\\p{N}\\p{M}\\p{Z} .,;:!?()\\[\\]{}"''`\\-–—/\\\\|%&*+=<>@#$^~\\n\\t।॥…‘’“”]', '', 'g')) / length(text), 8) AS junk FROM documents WHERE length(text) > 0""")
def junk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.round(text.junk_chars(F.col("text")), 8).alias("junk"))


@add(f"SELECT doc_id, round({REPEAT}, 6) AS repetition FROM (SELECT doc_id, {W} AS w FROM documents)")
def internal_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "w").select("doc_id", F.round(text.internal_repetition(F.col("w")), 6).alias("repetition"))


@add(f"WITH x AS (SELECT source, {W} AS w FROM documents), m AS (SELECT source, {NOISE} AS noise, {REPEAT} AS repetition FROM x) SELECT source, count(*)::BIGINT AS documents, round(avg(noise), 6) AS mean_noise, round(max(noise), 6) AS max_noise, round(avg(repetition), 6) AS mean_repetition, round(max(repetition), 6) AS max_repetition, avg(noise) > 0.25 AS noise_flag, avg(repetition) > 0.30 AS repetition_flag FROM m GROUP BY source")
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.words(F.col("text"))
    m = table(spark, sf_dir, "documents").select("source", w.alias("w")).select("source", text.ocr_noise(F.col("w")).alias("noise"), text.internal_repetition(F.col("w")).alias("repetition"))
    return m.groupBy("source").agg(
        F.count("*").alias("documents"), F.round(F.avg("noise"), 6).alias("mean_noise"), F.round(F.max("noise"), 6).alias("max_noise"), F.round(F.avg("repetition"), 6).alias("mean_repetition"),
        F.round(F.max("repetition"), 6).alias("max_repetition"), (F.avg("noise") > 0.25).alias("noise_flag"), (F.avg("repetition") > 0.30).alias("repetition_flag"),
    )


@add(f"WITH x AS (SELECT source, array_to_string(list_slice({W}, 1, 8), ' ') AS opening FROM documents), b AS (SELECT source, opening, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, opening) AS rank FROM c) SELECT source, opening, n::BIGINT AS n, rank::INT AS rank, n / total > 0.05 AS flagged FROM r WHERE rank <= 5 AND n > 1")
def repeated_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("source", F.array_join(F.slice(text.words(F.col("text")), 1, 8), " ").alias("opening"))
    counts = x.groupBy("source", "opening").agg(F.count("*").alias("n"))
    source = Window.partitionBy("source")
    ranked = counts.withColumn("total", F.sum("n").over(source)).withColumn("rank", F.row_number().over(source.orderBy(F.desc("n"), "opening")))
    return ranked.where("rank <= 5 and n > 1").select("source", "opening", "n", "rank", (F.col("n") / F.col("total") > 0.05).alias("flagged"))


# ----------------------------------------------------------------------------------------------------- segments
@add("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, pos % 5 = 1 AND pos > 1 AS is_marker FROM l), g AS (SELECT *, sum(is_marker::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM m)
SELECT doc_id, part::BIGINT AS part, count(*)::BIGINT AS rows, string_agg(line, chr(10) ORDER BY pos) AS text FROM g WHERE NOT is_marker AND trim(line) <> '' GROUP BY doc_id, part""")
def books_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, each fifth a marker, put together again."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    marked = lines.withColumn("line", F.when((F.col("pos") % 5 == 1) & (F.col("pos") > 1), F.concat(F.lit(segment.MARKER + " "), "pos")).otherwise(F.col("line")))
    return segment.reassembled(marked, "doc_id", "pos", "line").select("doc_id", "part", F.col("rows").cast("long").alias("rows"), "text")


@add("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '' ELSE line END AS line FROM l), g AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM m)
SELECT doc_id, part::BIGINT AS part, string_agg(trim(line), ' ' ORDER BY pos) AS text FROM g WHERE trim(line) <> '' GROUP BY doc_id, part""")
def unit_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    return segment.units(lines.withColumn("line", F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("line"))), "doc_id", "pos", "line")


SEGMENTED = f"""WITH RECURSIVE ls AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
o AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM ls WHERE trim(line) <> ''),
f AS (SELECT doc_id, line, n, r, 0 AS segment, n AS running FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.line, o.n, o.r, CASE WHEN f.running > 0 AND f.running + o.n > 1200 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.running > 0 AND f.running + o.n > 1200 THEN o.n ELSE f.running + o.n END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, segment::INT AS segment, string_agg(line, chr(10) ORDER BY r) AS text, sum(n)::BIGINT AS n_words FROM f GROUP BY doc_id, segment"""


@add(SEGMENTED)
def segment_1200(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.segments(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("segment", "text"))
    return found.withColumn("n_words", text.n_words(F.col("text")))


PACKED = f"""WITH RECURSIVE x AS (SELECT source, doc_id, text, len({W})::BIGINT AS n FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM x WHERE n > 0),
f AS (SELECT source, doc_id, text, n, r, 0::BIGINT AS pack, n AS running FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.doc_id, o.text, o.n, o.r, CASE WHEN f.running >= 300 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.running >= 300 THEN o.n ELSE f.running + o.n END FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1)
SELECT source, pack, string_agg(text, ' ' ORDER BY r) AS text, sum(n)::BIGINT AS n_words, count(*)::BIGINT AS units FROM f GROUP BY source, pack"""


@add(PACKED)
def pack_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.packed(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@add(f"""WITH RECURSIVE ls AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM ls) WHERE n > 0),
f AS (SELECT doc_id, n, r, 0::BIGINT AS pack, n AS running FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.n, o.r, CASE WHEN f.running >= 60 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.running >= 60 THEN o.n ELSE f.running + o.n END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, pack, sum(n)::BIGINT AS n_words, count(*)::BIGINT AS units FROM f GROUP BY doc_id, pack""")
def packs_within_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed to 60 words within their document, as within a shard: the tail of each comes out too."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return segment.packed(lines, "doc_id", "pos", "line", 60).select("doc_id", "pack", "n_words", "units")


@add(f"WITH x AS (SELECT source, doc_id, len({W})::BIGINT AS n FROM documents) SELECT source, arg_max(doc_id, struct_pack(a := n, b := -doc_id)) AS doc_id, max(n) AS n_words FROM x GROUP BY source")
def best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each source, the first of equally long ones."""
    return documents(spark, sf_dir).groupBy("source").agg(F.max_by("doc_id", F.struct("n_words", (-F.col("doc_id")).alias("i"))).alias("doc_id"), F.max("n_words").alias("n_words"))


@add("""WITH c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id) SELECT * FROM c""")
def conversation_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("x")).select("conv_id", F.array_join(F.col("x.t"), "\n").alias("text"), F.size("x").cast("long").alias("turns"))


@add("""WITH s AS (SELECT doc_id, lang, source, text, unnest(['text', 'lang', 'source']) AS col FROM documents), v AS (SELECT col, CASE col WHEN 'text' THEN text WHEN 'lang' THEN lang ELSE source END AS t FROM s),
r AS (SELECT col, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(t, '\\s', '', 'g')), 0) AS ratio FROM v) SELECT col, round(avg(ratio), 6) AS mean_ratio, avg(ratio) >= 0.9 AS kept FROM r GROUP BY col""")
def schema_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String columns by their mean share of Latin letters."""
    cells = table(spark, sf_dir, "documents").select("text", "lang", "source").unpivot([], ["text", "lang", "source"], "col", "t")
    share = F.try_divide(text.count_of(F.col("t"), "[A-Za-z]").cast("double"), F.length(F.regexp_replace("t", r"\s", "")))
    return cells.select("col", share.alias("ratio")).groupBy("col").agg(F.round(F.avg("ratio"), 6).alias("mean_ratio"), (F.avg("ratio") >= 0.9).alias("kept"))


@add("""WITH f AS (SELECT doc_id, [source, lang, text] AS a FROM documents), r AS (SELECT doc_id, unnest(a) AS field, generate_subscripts(a, 1) AS pos FROM f),
s AS (SELECT doc_id, field, pos, length(regexp_replace(field, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(field, '\\s', '', 'g')), 0) AS ratio FROM r)
SELECT doc_id, arg_max(field, struct_pack(a := coalesce(ratio, -1), b := -pos)) AS best FROM s GROUP BY doc_id""")
def best_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tab-separated fields the one with the largest share of Latin letters; the first of equals."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws("\t", "source", "lang", F.translate("text", "\t", " ")), "\t").alias("f"))
    scored = F.transform("f", lambda x, i: F.struct(F.coalesce(F.try_divide(text.count_of(x, "[A-Za-z]").cast("double"), F.length(F.regexp_replace(x, r"\s", ""))), F.lit(-1.0)).alias("r"), (-i).alias("i"), x.alias("x")))
    return line.select("doc_id", F.array_max(scored)["x"].alias("best"))
