"""Text functions as Column expressions: white space, words, canonical forms, hashes, normalisation, extraction.

White space is Unicode's, as Python's str.split() has it; Java's ``\\s`` would miss most of it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# White space, invisible characters, controls, script ranges, byline and markup patterns.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WS = WS.replace("[", "[^", 1)
INVISIBLE = "\ufeff\u200b\xad\u2060"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
SPACE_VARIANTS = r"[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
DEVANAGARI = r"[\u0900-\u097f\ua8e0-\ua8ff]"
DEVANAGARI_WORD = r"[\u0900-\u097f]+"
KANNADA = r"[\u0c80-\u0cff]"
BLOCK_TAGS = r"(?is)<(script|style|nav|header|footer|aside|form|noscript|svg|iframe)\b[^>]*>.*?</\1>"
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"
ISO_STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+\-]\d{1,2}:\d{2}"
UPDATED = r"(?i)(Updated|Published|Created)\s*:?\s*[A-Za-z]+\s+\d{1,2},?\s*\d{4}[^|\-\u0900]*(IST|GMT|UTC)?"
BYLINE = r"(?iU)^\s*(By|द्वारा|लेखक|बरोवपी)\b[^|]{0,80}\|\s*"
LEAD_DASH = r"^\s*[-–—|:]\s*"
EXCLUDED_PATHS = r"(?i)/(ampstories|web-story|webstory|photo|photos|gallery|video|videos|astro|astrology|horoscope|rashi|panchang|rashifal|live-blog|liveblog|podcast|shorts|quiz|poll|cartoon|epaper)(/|$|-)"
OCR_SHORT_WORDS = ["।", "॥", "आणि", "आनी", "तो", "ती", "ना", "व", "अ"]
JUNK = r"""[^\p{L}\p{N}\p{M}\p{Z} .,;:!?()\[\]{}"'`\-–—/\\|%&*+=<>@#$\^~\n\t।॥…‘’“”]"""
DEVANAGARI_DIGITS = "०१२३४५६७८९"
NORMALIZATION_STEPS = ["unicode_nfc", "strip_zero_width", "strip_control_chars", "normalize_danda_spacing", "normalize_whitespace"]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    """array<string> of the words of a text; empty for null and blank ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def canonical_form(c: Column) -> Column:
    """White space collapsed, trimmed, lower case, runs of digits as 0."""
    return F.regexp_replace(F.lower(F.trim(collapsed(c))), "[0-9०-९]+", "0")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space; single spaces, which are most of them, are not rewritten."""
    return F.regexp_replace(c, rf"{WS.replace(chr(92) + 'x20', chr(92) + 'x1f')}{WS}*| {WS}+", " ")


def count_of(c: Column, kind: str) -> Column:
    """How many characters of a class a text has. regexp_count() would make an array of them, an element for each."""
    return F.length(c) - F.length(F.regexp_replace(c, f"(?:{kind})++", ""))


def _counter(kind: str):
    """Counts the characters of a class: white space and ASCII classes without a look at each character."""
    if kind == NOT_WS:
        return lambda t: sum(map(len, t.split()))
    found = re.compile(kind)
    ascii_ = bytes(i for i in range(128) if found.match(chr(i)))
    rest = re.compile(f"(?:{kind})+")
    only_ascii = kind.isascii() and "\\" not in kind and "^" not in kind
    in_bytes = lambda t: len(raw := t.encode("utf-8", "replace")) - len(raw.translate(None, ascii_))
    return in_bytes if only_ascii else lambda t: in_bytes(t) if t.isascii() else len(t) - len(rest.sub("", t))


def counts_of(c: Column, *kinds: str) -> Column:
    """array<int>: how many characters of each of several classes a text has; null for null. Java's expressions would look
    at each character of the text anew for every use."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counters = [_counter(kind) for kind in kinds]
        for batch in batches:
            yield pa.array([None if (t := x.as_py()) is None else [f(t) for f in counters] for x in batch], pa.list_(pa.int32()))

    return arrow_udf(count, "array<int>")(c)


def exact_hash(c: Column) -> Column:
    """sha256 of the canonical form: what deduplication and leakage go by."""
    return F.sha2(canonical_form(c), 256)


def content_hash(c: Column) -> Column:
    """sha256 of a text as it is: what the manifest holds."""
    return F.sha2(c, 256)


# ----------------------------------------------------------------------------------------------- normalisation
def _composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in batch.to_pylist()], pa.string())


def _compatible(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in batch.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    return arrow_udf(_composed, "string")(c)


def nfkd(c: Column) -> Column:
    return arrow_udf(_compatible, "string")(c)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, INVISIBLE, ""), CONTROLS, "")


def normalize_unicode(c: Column, compose: bool = True) -> Column:
    """NFC, then no invisible characters but joiners, then no controls but tab and line feed."""
    return strip_invisible(nfc(c) if compose else c)


def normalize_whitespace(c: Column, keep_paragraphs: bool = True) -> Column:
    c = F.regexp_replace(c, SPACE_VARIANTS, " ")
    c = F.regexp_replace(c, "\r\n?", "\n")
    if not keep_paragraphs:
        return trim_ws(F.regexp_replace(c, f"{WS}+", " "))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "[ \t]+\n", "\n")
    return trim_ws(F.regexp_replace(F.regexp_replace(c, "\n[ \t]+", "\n"), "\n{3,}", "\n\n"))


def normalize_danda(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"{WS}*([।॥]){WS}*", "$1 "))


def normalize(c: Column, keep_paragraphs: bool = True, danda: bool = True, compose: bool = True) -> Column:
    c = normalize_unicode(F.coalesce(c, F.lit("")), compose)
    return normalize_whitespace(normalize_danda(c) if danda else c, keep_paragraphs)


def number(value: Column, devanagari: bool) -> Column:
    text = value.cast("string")
    return F.translate(text, "0123456789", DEVANAGARI_DIGITS) if devanagari else text


def strip_byline(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ISO_STAMP, " "), UPDATED, " "), BYLINE, "")
    return trim_ws(F.regexp_replace(trim_ws(F.regexp_replace(c, f"{WS}+", " ")), LEAD_DASH, ""))


def norm_title(c: Column) -> Column:
    c = F.regexp_replace(F.lower(nfkd(F.coalesce(c, F.lit("")))), r"(?U)[^\w\sऀ-ॿ]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\b(vol|volume|part|bhag|khand|no|ed|edition)\b", " "), r"(?U)\d+", " ")
    return trim_ws(F.regexp_replace(c, f"{WS}+", " "))


# --------------------------------------------------------------------------------------------------- extraction
def _unescaped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([t if t is None or "&" not in t else html.unescape(t) for t in batch.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    """All entities of HTML, named and numbered, decoded once."""
    return arrow_udf(_unescaped, "string")(c)


def keep_block(c: Column, script: str = DEVANAGARI_WORD[:-1], min_share: float = 0.45, min_words: int = 6) -> Column:
    """A paragraph without its byline, or null: enough words, and enough characters of the script."""
    text = strip_byline(c)
    shown = F.length(F.regexp_replace(text, f"{WS}+", ""))
    of_script = count_of(text, script)
    return F.when((F.size(words(text)) >= min_words) & (of_script > 0) & (of_script >= shown * min_share), text)


class Articles:
    """Article texts of pages, a page at a time: each paragraph is unescaped and stripped once."""

    def __init__(self, script: str, min_share: float):
        self.script, self.min_share = re.compile(script), min_share
        self.blocks, self.paragraph, self.tag, self.space = re.compile(BLOCK_TAGS), re.compile(PARAGRAPH), re.compile("<[^>]+>"), re.compile(f"{WS}+")
        self.byline = [(re.compile(p), to) for p, to in ((ISO_STAMP, " "), (UPDATED, " "), (BYLINE.replace("(?iU)", "(?i)"), ""))]
        self.dash, self.edge = re.compile(LEAD_DASH), re.compile(f"^{WS}+|{WS}+$")

    def stripped(self, t: str) -> str:
        for pattern, to in self.byline:
            t = pattern.sub(to, t)
        return self.edge.sub("", self.dash.sub("", self.edge.sub("", self.space.sub(" ", t))))

    def kept(self, t: str, min_words: int) -> str | None:
        t = self.stripped(t)
        found = len(self.script.findall(t))
        good = found and found >= len(self.space.sub("", t)) * self.min_share and len([w for w in self.space.split(t) if w]) >= min_words
        return t if good else None

    def article(self, page: str | None) -> str:
        cleaned = self.blocks.sub(" ", page or "")
        found = [self.kept(html.unescape(self.tag.sub(" ", p)), 6) for p in self.paragraph.findall(cleaned)]
        if not any(found):
            lines = html.unescape(self.tag.sub("\n", cleaned)).split("\n")
            found = [self.kept(x, 12) for x in lines if len(self.edge.sub("", x)) >= 40]
        return "\n\n".join(x for x in found if x)


def article_text(page: Column, script: str = DEVANAGARI_WORD[:-1], min_share: float = 0.45) -> Column:
    """Paragraphs of a page that read like prose; where it has none, lines between tags that do."""

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        articles = Articles(script, min_share)
        for batch in batches:
            yield pa.array([articles.article(t) for t in batch.to_pylist()], pa.string())

    return arrow_udf(extract, "string")(page)


def clean_wikitext(c: Column) -> Column:
    """One pass over comments, references, tags, templates, files, links, addresses, quotes and headings."""
    for pattern, to in (
        (r"(?s)<!--.*?-->", " "), (r"(?is)<ref[^>]*>.*?</ref>", " "), (r"<[^>]+>", " "), (r"\{\{[^{}]*\}\}", " "),
        (r"(?is)\[\[(?:File|Image):.*?\]\]", " "), (r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]]+)\]\]", "$1"),
        (rf"https?://{NOT_WS}+", " "), ("'''", ""), ("''", ""), (rf"={{2,6}}{WS}*(.*?){WS}*={{2,6}}", "$1"), (f"{WS}+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return trim_ws(c)


def clean_residual_wikitext(c: Column, passes: int = 8) -> Column:
    """What nests is taken off from the inside, up to ``passes`` deep; then links, tags, table rows and strays."""
    c = F.regexp_replace(c, r"(?is)<ref[^>]*>.*?</ref>", " ")
    for _ in range(passes):
        c = F.regexp_replace(F.regexp_replace(c, r"\{\{[^{}]*\}\}", " "), r"(?iu)\[\[\s*(File|Image|चित्र|संचिका)\s*:[^\[\]]*\]\]", " ")
    for pattern, to in (
        (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"), (r"<[^>]{1,200}>", " "), (r"(?m)^\s*[|!].*$", " "),
        (r"(\{\{|\}\}|\[\[|\]\]|\{\||\|\})", " "), ("'''", ""), ("''", ""), (f"{WS}+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return trim_ws(c)


def sentences(c: Column, least: int = 4, most: int = 60) -> Column:
    """Sentences after a danda, question or exclamation mark, of least to most words."""
    return F.filter(F.split(c, rf"(?<=[।?!]){WS}+"), lambda s: F.size(words(s)).between(least, most))


def lines(c: Column) -> Column:
    """Lines at every boundary that Python's splitlines() knows, without an empty last one."""
    found = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


# ------------------------------------------------------------------------------------------------ audit metrics
def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def ocr_noise(w: Column) -> Column:
    """Share of words of one or two characters that are neither numbers nor known."""
    stray = F.filter(w, lambda x: (F.length(x) <= 2) & ~F.rlike(x, F.lit(r"^\p{Nd}+$")) & ~x.isin(OCR_SHORT_WORDS))
    return ratio(F.size(stray), F.size(w))


def junk_chars(c: Column) -> Column:
    return ratio(count_of(c, JUNK), F.length(c))


def grams(w: Column, n: int, glue: str = " ") -> Column:
    """n-grams of an array of words; empty if it is too short."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), glue))).otherwise(F.array().cast("array<string>"))


def internal_repetition(w: Column) -> Column:
    """1 - distinct / all five-word grams; 0 below 20 words."""
    g = grams(w, 5)
    return F.when(F.size(w) < 20, 0.0).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g))


def word_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
