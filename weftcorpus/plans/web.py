"""Crawls from what was fetched: sitemaps, robots, listings, outcomes, pages."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.functions import text
from weftcorpus.operators import accounts, web
from weftcorpus.plans.base import Register, table

REGISTER = Register()
add = REGISTER.add
EXCLUDED = text.EXCLUDED_PATHS.removeprefix("(?i)")
#: Robots of two hosts of the fixtures; the others have none.
ROBOTS = [
    ("thther.example.org", "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/6\nDisallow: /en/\nSitemap: https://thther.example.org/map.xml\nCrawl-delay: 2\n"),
    ("blog.ththan.example.net", "User-agent: *\nDisallow:\n# all is open\n"),
    ("blog.tionsh.example.net", "User-agent: weft\nUser-agent: loom\nDisallow: /de\nUser-agent: *\nDisallow: /\n"),
]


def _packed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for xml, squeeze in batches:
        yield pa.array([gzip.compress(x.encode()) if z else x.encode() for x, z in zip(xml.to_pylist(), squeeze.to_pylist(), strict=True)], pa.binary())


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, body: an index that names maps of a thousand pages each, every other one packed, and itself."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    day = F.format_string("2024-01-%02d", F.col("page_id") % 28 + 1)
    entry = F.concat(F.lit("<url>\n <loc> "), escaped(F.col("url")), F.lit(" </loc>"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))), F.lit("</url>"))
    part = F.floor(F.col("page_id") / 1000).cast("int")
    listed = table(spark, sf_dir, "pages").groupBy(part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("x"))
    each = listed.select(F.format_string("https://maps/%d.xml", "part").alias("url"), F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>")).alias("xml"), (F.col("part") % 2 == 1).alias("z"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), "")
    index = each.agg(F.lit("https://maps/index.xml").alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>https://maps/index.xml</loc></sitemap><sitemap><loc>https://maps/gone.xml</loc></sitemap>"), names, F.lit("</sitemapindex>")).alias("xml"), F.lit(True).alias("z"))
    return index.unionByName(each).select("url", arrow_udf(_packed, "binary")("xml", "z").alias("body"))


@add(f"SELECT DISTINCT url, 1 AS depth FROM pages WHERE url IS NOT NULL AND (page_id % 7 = 0 OR page_id % 28 + 1 >= 10) AND NOT regexp_matches(lower(url), '{EXCLUDED}')")
def sitemap_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the sitemaps reachable from the index name, without old and excluded ones."""
    seeds = spark.createDataFrame([("https://maps/index.xml",)], "url string")
    return web.discovered(maps(spark, sf_dir), seeds, "2024-01-10").select("url", "depth")


@add("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages)
SELECT page_id, CASE WHEN host = 'thther.example.org' THEN starts_with(path, '/en/6') OR NOT starts_with(path, '/en/') WHEN host = 'blog.tionsh.example.net' THEN NOT starts_with(path, '/de') ELSE true END AS permitted FROM p""")
def robots_permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages the robots of their hosts let an agent fetch."""
    lines = web.robots(spark.createDataFrame(ROBOTS, "host string, text string"), "weft")
    return web.permitted(table(spark, sf_dir, "pages"), web.path_rules(lines)).select("page_id", "permitted")


@add("SELECT * FROM (VALUES ('thther.example.org', 'https://thther.example.org/map.xml', 2.0::DOUBLE), ('blog.ththan.example.net', NULL, NULL), ('blog.tionsh.example.net', NULL, NULL)) t(host, sitemap, delay)")
def robots_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sitemap and the delay that a host asks for."""
    lines = web.robots(spark.createDataFrame(ROBOTS, "host string, text string"), "weft")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    return lines.groupBy("host").agg(of("sitemap").alias("sitemap"), F.try_to_number(of("crawl-delay"), F.lit("999.999")).cast("double").alias("delay"))


@add("SELECT 'u' || user_id AS id, min(event_id // 500)::BIGINT AS step, CASE WHEN starts_with('u' || user_id, 'u13') THEN 'too new' WHEN starts_with('u' || user_id, 'u1') THEN 'held back' END AS reason FROM events GROUP BY user_id")
def cursor_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from pages of events that name the next one; each at its first page, some excluded by prefix."""
    page = F.floor(F.col("event_id") / 500).cast("long")
    pages = table(spark, sf_dir, "events").groupBy(page.alias("p")).agg(F.array_sort(F.collect_set(F.concat(F.lit("u"), "user_id"))).alias("items"))
    last = pages.agg(F.max("p").alias("last"))
    named = pages.join(F.broadcast(last)).select(F.when(F.col("p") == 0, "").otherwise(F.concat(F.lit("c"), "p")).alias("cursor"), F.when(F.col("p") < F.col("last"), F.concat(F.lit("c"), F.col("p") + 1)).alias("next"), "items")
    return web.listed(web.followed(named), {"u13": "too new", "u1": "held back"})


STATUS = "CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'transient' WHEN event_id % 5 = 0 OR event_id % 3 = 0 OR event_id % 7 = 0 THEN 'no_text_layer' ELSE 'ok' END"


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers to requests."""
    e = F.col("event_id")
    http = F.when(e % 11 == 0, F.lit(None)).when(e % 13 == 0, 429).when(e % 17 == 0, 503).when(e % 5 == 0, 404).otherwise(200).cast("int")
    return table(spark, sf_dir, "events").select("event_id", "event_type", web.outcome(http, e % 3 != 0, F.when(e % 7 == 0, " \n").otherwise("text")).alias("status"))


@add(f"SELECT event_type, {STATUS} AS status, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(spark, sf_dir).groupBy("event_type", "status").agg(F.count("*").alias("n"))


@add(f"SELECT event_id FROM events WHERE {STATUS} <> 'transient'")
def definitive_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as seen."""
    return web.definitive(fetched(spark, sf_dir)).select("event_id")


@add("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'b.txt' WHEN event_id % 3 = 0 THEN 'c_djvu.txt' END AS name FROM events")
def text_file_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file of an item holds its text: by format, else by name."""
    e = F.col("event_id")
    file = lambda name, format: F.struct(name.cast("string").alias("name"), format.cast("string").alias("format"))
    files = F.array(file(F.lit("a.pdf"), F.lit("PDF")), file(F.when(e % 3 == 0, "c_djvu.txt"), F.lit(None)), file(F.lit("b.txt"), F.when(e % 5 == 0, "DjVuTXT")), file(F.lit("z.txt"), F.when(e % 5 == 0, "DjVuTXT")))
    return table(spark, sf_dir, "events").select("event_id", web.text_file(files).alias("name"))


GIVEN = "SELECT DISTINCT user_id FROM events WHERE (event_type = 'purchase' AND user_id % 2 = 0) OR (event_type = 'error' AND user_id % 3 = 0)"


@add(f"SELECT DISTINCT 'item' || user_id AS id, user_id IN ({GIVEN}) AS contributes FROM events")
def unmark_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen items, and which of them stay seen once those that gave nothing are un-marked."""
    events = table(spark, sf_dir, "events")
    item = F.concat(F.lit("item"), "user_id")
    seen = events.select(item.alias("id")).distinct()
    manifest = events.where("(event_type = 'purchase' and user_id % 2 = 0) or (event_type = 'error' and user_id % 3 = 0)").select(
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("https://a/details/"), item)).alias("source_url"), F.when(F.col("event_type") == "error", F.concat(item, F.lit("_seg_1"))).otherwise("x").alias("doc_id")
    )
    kept = web.remaining_seen(seen, manifest).withColumn("contributes", F.lit(True))
    return kept.unionByName(web.unmarked(seen, manifest).withColumn("contributes", F.lit(False)))


@add("SELECT CASE WHEN event_id % 7 = 0 THEN 'no_revision' WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 3 = 0 THEN 'redirect' WHEN event_id % 2 = 0 THEN 'empty_after_cleaning' ELSE 'accepted' END AS reason, count(*)::BIGINT AS pages FROM events GROUP BY 1")
def wiki_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    content = F.when(e % 7 == 0, F.lit(None)).when(e % 5 == 0, " \n ").when(e % 3 == 0, " #redirect [[x]]").when(e % 2 == 0, "{{only a template}}").otherwise("'''text'''")
    pages = table(spark, sf_dir, "events").select(content.alias("c"))
    why = web.wiki_reason(F.col("c"), text.clean_wikitext(F.col("c")))
    return pages.groupBy(F.coalesce(why, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("pages"))


@add("SELECT page_id, trim(left(regexp_replace(html, '\\s+', ' ', 'g'), 120)) AS line FROM pages")
def tidy_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.tidy(F.col("html")).alias("line"))


@add("SELECT n_nationkey, 'https://kok.wiki/wiki/' || replace(n_name, ' ', '_') AS url FROM nation")
def title_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", accounts.page_url(F.col("n_name"), "kok.wiki").alias("url"))
