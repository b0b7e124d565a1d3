"""What a crawl has fetched, as tables: sitemaps, robots, cursor pages, fetch outcomes, names of text files.

Nothing here uses the network. Fetched bodies are a table; these operators find what they say.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.functions.text import EXCLUDED_PATHS, WS, trim_ws
from weftcorpus.operators.gates import date_ok, first_prefix
from weftcorpus.session import cut

# The outcomes of a fetch; only the transient one is tried again.
FETCHED, NO_TEXT, TRANSIENT = "ok", "no_text_layer", "transient"
#: Any prefix of a namespace may stand before a tag's name.
TAG = r"(?:[\w.-]+:)?"


# ----------------------------------------------------------------------------------------------------- sitemaps
def _plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for body in batch.to_pylist():
            if body is not None and body[:2] == b"\x1f\x8b":
                try:
                    body = gzip.decompress(body)
                except (OSError, EOFError, zlib.error):  # a body that breaks off holds nothing
                    body = None
            out.append(None if body is None else body.decode("utf-8", "replace"))
        yield pa.array(out, pa.string())


def body_text(body: Column) -> Column:
    """The text of a body (binary), unpacked where it is gzip; null where that breaks off."""
    return arrow_udf(_plain, "string")(body)


def unescaped_xml(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def inside(xml: Column, tag: str) -> Column:
    """array<string>: what each element of that name holds."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{TAG}{tag}(?:\s[^>]*)?>(.*?)</{TAG}{tag}\s*>"), F.lit(1))


def sitemap_entries(maps: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """url, pos, is_map, loc, lastmod ('' if missing) of each entry with a location, in the order of the map."""
    def entries(tag: str, is_map: bool) -> Column:
        first = lambda x, t: F.coalesce(trim_ws(unescaped_xml(F.get(inside(x, t), F.lit(0)))), F.lit(""))
        return F.transform(inside(F.col(xml), tag), lambda x, i: F.struct(i.alias("pos"), F.lit(is_map).alias("is_map"), first(x, "loc").alias("loc"), first(x, "lastmod").alias("lastmod")))

    rows = maps.select(F.col(url).alias("url"), F.explode(F.concat(entries("sitemap", True), entries("url", False))).alias("e"))
    return rows.select("url", "e.pos", "e.is_map", "e.loc", "e.lastmod").where("loc <> ''")


def discovered(bodies: DataFrame, seeds: DataFrame, since: str, rules: DataFrame | None = None, most_maps: int | None = None, most_urls: int | None = None) -> DataFrame:
    """url, lastmod, depth: pages that the sitemaps reachable from seeds (url) name, breadth first.

    bodies: url, body (binary). A map counts once, at its least depth; dates before since and excluded paths are left
    out, also what rules (host, path, allow) forbid. most_maps and most_urls are the crawl's own limits, in the order
    of depth and url. Each depth is cut off, so the lineage stays short.
    """
    entries = cut(sitemap_entries(bodies.select("url", body_text(F.col("body")).alias("xml"))))
    frontier = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    depth = 0
    while not frontier.isEmpty() and (most_maps is None or seen.count() < most_maps):
        depth += 1
        below = entries.where("is_map").join(frontier.select("url"), "url").select(F.col("loc").alias("url")).distinct()
        frontier = cut(below.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = cut(seen.unionByName(frontier))
    if most_maps is not None:
        seen = seen.orderBy("depth", "url").limit(most_maps)
    pages = entries.where("not is_map").join(seen, "url").where(date_ok(F.nullif(F.col("lastmod"), F.lit("")), since) & ~F.rlike("loc", F.lit(EXCLUDED_PATHS)))
    pages = pages.groupBy(F.col("loc").alias("url")).agg(F.min("depth").alias("depth"), F.min_by("lastmod", F.struct("depth", "pos")).alias("lastmod"))
    if rules is not None:
        pages = permitted(pages, rules).where("permitted").drop("permitted")
    out = pages.select("url", "lastmod", "depth")
    return out.orderBy("depth", "url").limit(most_urls) if most_urls is not None else out


# ------------------------------------------------------------------------------------------------------- robots
def robots(files: DataFrame, agent: str = "*", host: str = "host", text: str = "text") -> DataFrame:
    """host, kind (allow, disallow, sitemap, crawl-delay), value, pos: the lines that hold for an agent.

    The group of the agent itself goes before that of all agents; sitemaps hold for everyone.
    """
    lines = files.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("pos", "line"))
    bare = trim_ws(F.split("line", "#")[0])
    lines = lines.select("host", "pos", F.lower(trim_ws(F.split(bare, ":", 2)[0])).alias("kind"), trim_ws(F.get(F.split(bare, ":", 2), F.lit(1))).alias("value")).where("value is not null")
    grouped = lines.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "value"))).alias("l"))
    # agents that follow each other share the lines after them
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("body"), F.array().cast("array<struct<agents:array<string>,kind:string,value:string,pos:int>>").alias("out"))
    def step(s: Column, x: Column) -> Column:
        named = x["kind"] == "user-agent"
        agents = F.when(named, F.concat(F.when(s["body"], F.array().cast("array<string>")).otherwise(s["agents"]), F.array(F.lower(x["value"])))).otherwise(s["agents"])
        return F.struct(agents.alias("agents"), (~named).alias("body"), F.when(named, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(agents.alias("agents"), x["kind"].alias("kind"), x["value"].alias("value"), x["pos"].alias("pos"))))).alias("out"))
    told = grouped.select("host", F.explode(F.aggregate("l", start, step, lambda s: s["out"])).alias("x")).select("host", "x.*")
    mine = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a) & (a != ""))
    ranked = told.withColumn("rank", F.when(F.col("kind") == "sitemap", 3).when(mine, 2).when(F.array_contains("agents", "*"), 1).otherwise(0)).where("rank > 0")
    own = ranked.where("rank = 2").select("host").distinct().withColumn("own", F.lit(True))
    return ranked.join(own, "host", "left").where("rank >= 2 or own is null").select("host", "kind", "value", "pos")


def path_rules(lines: DataFrame) -> DataFrame:
    """host, path, allow of the lines of robots(); an empty disallow forbids nothing."""
    return lines.where("kind in ('allow', 'disallow') and value <> ''").select("host", F.col("value").alias("path"), (F.col("kind") == "allow").alias("allow"), "pos")


def permitted(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with permitted: the first rule of the host whose path the url's path begins with; without one, yes.

    Joined by host; of a host's rules one array, so that every url meets its rules once.
    """
    by_host = rules.groupBy(F.col("host").alias("__host")).agg(F.array_sort(F.collect_list(F.struct("pos", "path", "allow"))).alias("__rules"))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    named = urls.withColumn("__host", F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))).withColumn("__path", path)
    first = F.get(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"])), F.lit(0))
    return named.join(by_host, "__host", "left").withColumn("permitted", F.coalesce(first["allow"], F.lit(True))).drop("__host", "__path", "__rules")


# ------------------------------------------------------------------------------------------------------- paging
def followed(pages: DataFrame, first: str = "") -> DataFrame:
    """step, cursor, items of pages (cursor, next, items), from the first cursor on, each cursor once.

    The chain is followed by doubling: after k rounds every page knows the one 2**k further on, so a chain of any
    length takes a logarithm of rounds.
    """
    links = cut(pages.groupBy("cursor").agg(F.min("next").alias("next")))
    known = set_ = cut(links.where(F.col("cursor") == F.lit(first)).select("cursor", F.lit(0).cast("long").alias("step")))
    jump, size = links.where("next is not null").select("cursor", "next"), 1
    while not set_.isEmpty():
        reached = known.join(jump, "cursor").select(F.col("next").alias("cursor"), (F.col("step") + size).alias("step")).join(links.select("cursor"), "cursor", "left_semi")
        set_ = cut(reached.join(known, "cursor", "left_anti").groupBy("cursor").agg(F.min("step").alias("step")))
        known = cut(known.unionByName(set_))
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.cursor")).select("a.cursor", "b.next"))
        size *= 2
    items = pages.groupBy("cursor").agg(F.first("items").alias("items"))
    return known.join(items, "cursor").select("step", "cursor", "items")


def listed(steps: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """id, step, reason: each item once, at its first place; reason tells the prefix that excludes it."""
    each = steps.select("step", F.posexplode("items").alias("pos", "id"))
    first = each.groupBy("id").agg(F.min("step").alias("step"))
    return first.withColumn("reason", first_prefix(F.col("id"), excluded))


# ------------------------------------------------------------------------------------------------------ fetching
def outcome(http: Column, has_file: Column, body: Column) -> Column:
    """ok, no_text_layer (told for certain) or transient (to be tried again)."""
    lost = http.isNull() | (http == 429) | (http >= 500)
    return F.when(lost, TRANSIENT).when((http == 404) | ~F.coalesce(has_file, F.lit(False)), NO_TEXT).when(trim_ws(F.coalesce(body, F.lit(""))) == "", NO_TEXT).otherwise(FETCHED)


def definitive(rows: DataFrame, status: str = "status") -> DataFrame:
    """What counts as seen: all but transient failures."""
    return rows.where(F.col(status) != TRANSIENT)


def text_file(files: Column) -> Column:
    """The name of the first file in the text format, else of the first whose name ends as such files do, else null."""
    told = F.get(F.filter(files, lambda f: F.coalesce(f["format"] == "DjVuTXT", F.lit(False))), F.lit(0))["name"]
    named = F.get(F.filter(files, lambda f: F.coalesce(F.endswith(f["name"], F.lit("_djvu.txt")), F.lit(False))), F.lit(0))["name"]
    return F.coalesce(told, named)


def contributing(manifest: DataFrame) -> DataFrame:
    """id: what has given accepted text, by the end of its address, or by the document's name before its segment."""
    by_url = F.when(F.contains("source_url", F.lit("/details/")), F.substring_index("source_url", "/details/", -1))
    by_name = F.when(F.contains("doc_id", F.lit("_seg_")), F.regexp_extract("doc_id", r"(?s)^(.*)_seg_", 1))
    return manifest.select(F.explode(F.array(by_url, by_name)).alias("id")).where("id is not null").distinct()


def unmarked(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """The part of seen (id) that has given nothing: what a recheck looks at, and un-marking takes out."""
    return seen.join(contributing(manifest), "id", "left_anti")


def remaining_seen(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """seen without what has given nothing, so that it is tried again."""
    return seen.join(contributing(manifest), "id", "left_semi")


def wiki_reason(content: Column, cleaned: Column) -> Column:
    """Why a page is left out: no revision, nothing in it, a redirect, nothing left after cleaning; else null."""
    return (
        F.when(content.isNull(), "no_revision").when(trim_ws(content) == "", "empty").when(F.rlike(content, F.lit(rf"(?i)^{WS}*#REDIRECT\b")), "redirect")
        .when(F.coalesce(cleaned, F.lit("")) == "", "empty_after_cleaning")
    )


def tidy(c: Column, most: int = 120) -> Column:
    """A body as one short line for a log."""
    return trim_ws(F.substring(F.regexp_replace(c, f"{WS}+", " "), 1, most))
