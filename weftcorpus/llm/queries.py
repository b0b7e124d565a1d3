"""The queries that apply the operators to whole tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm import byte_bpe, gif_media, jaccard_join, mixing, quality_rules, sharding, substring_dedup, token_counts, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]
TOKEN_LIMIT = 1024
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


#: From so many bytes on, a table whose files give fewer tasks than there are cores is dealt out among them.
WORTH_DEALING = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one that is a single row group, which a scan can't split, is dealt out to all cores first."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    told = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    small = WORTH_DEALING <= told.getLength() < 32 * WORTH_DEALING * cores
    return df.repartition(cores) if small and told.getFileCount() < cores else df


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.scored(F.col("text"), model).alias("r"))
    return found.select("doc_id", "held_out", "r.score", "r.predicted", "r.hits", "r.inexact")


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = docs.select("doc_id", size.alias("n_bytes"), gif_media.media_features(F.col("text")).alias("r"))
    return found.select("doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", "r.media_bytes", "r.media_sha256", "r.feature", "r.n_frames", "r.duration_cs")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.counted(spark, F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    found = docs.select("doc_id", counted.alias("r"))
    return found.select("doc_id", "r.n_bytes", "r.n_tokens", (F.col("r.n_tokens") > TOKEN_LIMIT).alias("over_limit"), "r.splices")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark, table(spark, sf_dir, "documents"))


def bpe_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    made = byte_bpe.digests(spark, F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", made.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", quality_rules.quality(F.col("text")).alias("r")).select("doc_id", "r.*")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judged(table(spark, sf_dir, "pages"), rules)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixed(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "residual", "kept")


def queries() -> dict[str, Query]:
    found = [op1_toxicity, op2_gif_media, op3_token_counts, op4_sharding, op5_byte_bpe, op6_quality_rules, op7_url_filters, op8_substring_dedup, op9_jaccard_join, op10_mixing]
    return {f.__name__: f for f in found}


OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits AS (
  SELECT n, max(struct_pack(len := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) AS hit
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict
FROM split LEFT JOIN hits USING (n)
"""


OP8_SQL = """
WITH words AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT n, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50),
windows AS (SELECT n, doc_id, p, md5(array_to_string(w[p:p+49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT n, list_distinct(flatten(list(range(p, p + 50)))) AS g FROM windows JOIN firsts USING (h) WHERE first < doc_id GROUP BY n),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i))), lambda i: w[i]) END AS k
  FROM words LEFT JOIN gone USING (n))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, min(root)) AS component_id FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, s
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL}
