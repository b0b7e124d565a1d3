"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut before the library sees it, at places where the pattern's matches provably end whatever
stands on the other side, so the pieces' ids joined are the text's ids; decoding joins raw bytes, which need
not be valid UTF-8 token by token. Such a place is before any white space that follows something else: the pattern
takes no white space into a match that begins otherwise, and only a run of white space looks ahead. A run of more than
RUN characters, on which the library's regex engine would run out of stack, never reaches that engine: all of it but
the last character (all of it at the end of the text) is one match by the pattern, and is merged as one piece.

Defined results: null and empty texts have no tokens, and decode to no bytes; texts of any length, also of one
repeated character, give what the library gives; an empty table gives no rows; repeated rows give repeated results;
columns of the input other than the named text column are neither read nor changed, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.llm.shared import text_bytes

#: Fixed value: what the pattern's \s stands for, Unicode's white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
RUN = 1_000
LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


def pieces(text: str, limit: int) -> Iterator[str]:
    """text in order, cut only at SAFE places, each piece ending at the first of these after limit characters."""
    start = 0
    while len(text) - start > limit:
        found = SAFE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def parts(text: str, limit: int) -> Iterator[tuple[str, bool]]:
    """text in order, as pieces for the library, and as runs of white space that are one match each (marked True)."""
    start = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        if run.start() > start:
            yield from ((p, False) for p in pieces(text[start : run.start()], limit))
        if end > run.start():
            yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield from ((p, False) for p in pieces(text[start:], limit))


_encodings: dict[tuple[int, str], tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The library's encoding for the bytes of a rank file; one for each worker process."""
    key = (hash(ranks), pattern)
    if key not in _encodings:
        table = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in ranks.splitlines() if x)}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def encode_text(enc: tiktoken.Encoding, text: str | None, limit: int) -> np.ndarray:
    """ids as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, "<u4")
    if len(text) <= RUN:
        return np.array(enc.encode_ordinary(text), "<u4")
    found = [enc._encode_single_piece(p.encode()) if run else enc.encode_ordinary(p) for p, run in parts(text, limit)]
    return np.concatenate([np.array(x, "<u4") for x in found])


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver; its size is that of a vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def encoded(spark: SparkSession, text: Column, ranks_path: str, pattern: str, limit: int = 50_000) -> Column:
    """array<long> of ids for each text."""
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @arrow_udf("array<bigint>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            rows = [encode_text(enc, t.as_py(), limit).astype(np.int64) for t in batch]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))

    return encode(text)


def decoded(spark: SparkSession, ids: Column, ranks_path: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for; null ids give null, an unknown id is an error."""
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            yield pa.array([None if not x.is_valid else enc.decode_bytes(x.as_py()) for x in batch], pa.binary())

    return decode(ids)


def digests(spark: SparkSession, text: Column, ranks_path: str, pattern: str, limit: int = 50_000) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encodes, then decodes the ids that were stored as bytes.

    Both directions run in one pass over a batch, so that ids never travel through the JVM.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            counts, stored, back = [], [], []
            for value in batch:
                raw = encode_text(enc, value.as_py(), limit).tobytes()
                ids = np.frombuffer(raw, "<u4")
                counts.append(len(ids))
                stored.append(sha(raw))
                back.append(sha(enc.decode_bytes(ids.tolist())))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(stored, pa.string()), pa.array(back, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return both(F.coalesce(text, F.lit("")))


def same_text(text: str | None, decoded_bytes: bytes) -> bool:
    return text_bytes(text) == decoded_bytes
