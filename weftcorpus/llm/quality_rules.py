"""Quality rules on repetition: which characters of a text stand inside repeated n-grams and lines.

For each length n in NGRAMS a rolling hash names every n-word window of a text; the words of windows whose hash
occurs again are covered, and the covered characters over all characters of words is the coverage for n. Lines
that equal an earlier one are measured in the same way. Hashes are of 64 bits; the windows of three words, whose
number is a result, are compared by exact word numbers instead.

Characters are code points throughout, so that scripts are judged alike.

Defined results: a null or empty text has no words and fails the base rule. All texts are measured whole, in memory in
proportion to the text. Repeated rows get equal results; an empty table gives no rows. Other columns of the input are
left alone, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.llm.shared import Rolling, mixed, text_bytes

#: Lengths, and the largest share of characters inside repeated windows of that length that is still kept.
NGRAMS = {5: 0.40, 7: 0.35, 10: 0.30}
#: The largest share of characters in lines that equal an earlier line, and of symbols to words.
MAX_LINE_COVERAGE, MAX_SYMBOLS_PER_WORD = 0.30, 0.10
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: What UTF-8 has inside characters: bytes without these are as many as code points.
INSIDE = bytes(range(0x80, 0xC0))


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words stand in a window of n words that starts at one of the marked places."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(text: str | None) -> tuple:
    raw = text_bytes(text)
    words = raw.split()
    size = len(words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    chars = 0 if not text else len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += len(line.translate(None, SPACES + INSIDE))
        elif line.strip(SPACES):
            seen.add(line)
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    ids = np.array([put(w, len(numbers)) for w in words], np.int64)
    long = np.array([len(w) for w in words] if raw.isascii() else [len(w.translate(None, INSIDE)) for w in words], np.int64)
    in_words = int(long.sum())
    repeat = 0
    if size > 3:
        pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1].astype(np.int64)
        repeat = int(covered(repeated(pair[:-1] * len(numbers) + ids[2:]), 3, size).sum())
    coverage = []
    rolling = Rolling(mixed(ids.astype(np.uint64) + np.uint64(1))) if size > min(NGRAMS) else None
    for n in NGRAMS:
        inside = 0
        if size > n:
            hits = repeated(rolling.windows(n))
            inside = int(long[covered(hits, n, size)].sum()) if hits.any() else 0
        coverage.append(inside / in_words if in_words else 0.0)
    line_share = dup_chars / in_words if in_words else 0.0
    base = size < 50 or 100 * repeat > 50 * size
    kept = not base and all(c <= most for c, most in zip(coverage, NGRAMS.values(), strict=True)) and line_share <= MAX_LINE_COVERAGE and symbols <= MAX_SYMBOLS_PER_WORD * size
    return size, chars, symbols, dup_lines, repeat, base, kept, *coverage, line_share


FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}
FIELDS |= {f"coverage_{n}": "double" for n in NGRAMS} | {"line_coverage": "double"}
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch]
        columns = list(zip(*rows, strict=True)) or [[] for _ in FIELDS]
        yield pa.StructArray.from_arrays([pa.array(list(c), ARROW[k]) for c, k in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))


def quality(text: Column) -> Column:
    """struct of FIELDS for each text."""
    return arrow_udf(measured, "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">")(F.coalesce(text, F.lit("")))
