"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than ``chunk`` characters is encoded in overlapping chunks. Two chunks are spliced at a proven
boundary: a place in their overlap where, in both, one pre-token ends and the next begins, far enough from the
end of the first chunk that nothing beyond it can have been seen. A pre-tokeniser scans from left to right, so
from such a place on the second chunk gives what a scan of the whole text gives, and up to it the first does.
If an overlap holds no such place it is doubled, until it does; where a whole chunk holds none, as in a run of one
character, the chunk is doubled, so that the work stays in proportion to the text.

Defined results: null and empty texts have 0 tokens. Special strings inside texts count as the library counts
them by default: as one token each, also where a chunk would cut them. Ties cannot occur; repeated rows repeat; an
empty table gives no rows. Only the named text column is read, whatever the others are called.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_loaded: dict[int, object] = {}
_pieces: dict[int, Pieces] = {}


def tokenizer(spec: bytes):
    """The library's tokenizer for the bytes of its file, without truncation and padding.

    Offsets are those of whole tokens (trim_offsets off), which changes no id.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(spec)
    if key not in _loaded:
        parts = json.loads(spec)
        for name in ("pre_tokenizer", "post_processor"):
            if parts.get(name) and "trim_offsets" in parts[name]:
                parts[name]["trim_offsets"] = False
        made = Tokenizer.from_str(json.dumps(parts))
        made.no_truncation()
        made.no_padding()
        longest = max([len(t.content) for t in made.get_added_tokens_decoder().values()] or [0])
        _loaded[key] = (made, longest)
    return _loaded[key]


class Pieces(dict):
    """piece -> its number of tokens, remembered per worker process up to ``limit`` pieces of at most ``longest`` characters.

    ByteLevel's pattern lets no pre-token begin before a space and end beyond it, unless it is of white space alone; of
    such a run it leaves the last character to what follows, if that is visible. So before a space that a visible
    character follows a pre-token ends, and what stands on either side is split as it would be alone.
    """

    CUT = re.compile(r"(?= \S)")

    def __init__(self, made, spec: bytes, limit: int = 400_000, longest: int = 40):
        super().__init__()
        self.made, self.limit, self.longest = made, limit, longest
        parts = json.loads(spec)
        split, model = parts.get("pre_tokenizer") or {}, parts["model"]
        rules = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.proven = rules and not parts.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [t.content for t in made.get_added_tokens_decoder().values()]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts that hold an added token are encoded whole."""
        if not self.proven:
            return self.encoded(texts)
        cut = [[t] if any(a in t for a in self.added) else self.CUT.split(t) for t in texts]
        new = list({p for some in cut for p in some}.difference(self))
        self.update(zip(new, self.encoded(new), strict=True))
        found = [sum(map(self.__getitem__, some)) for some in cut]
        if len(self) > self.limit:
            self.clear()
        else:
            for p in new:
                if len(p) > self.longest:
                    del self[p]
        return found

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(made, spec: bytes) -> Pieces:
    """What this worker remembers for the tokenizer of a file."""
    key = hash(spec)
    if key not in _pieces:
        _pieces[key] = Pieces(made, spec)
    return _pieces[key]


def starts(enc, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from low to below high at which pre-tokens begin, and the number of tokens before each."""
    first, end = 0, len(enc)
    while first < end:
        middle = (first + end) // 2
        first, end = (middle + 1, end) if enc.token_to_chars(middle)[0] < low else (first, middle)
    at, word = [], []
    for i in range(max(first - 1, 0), len(enc)):  # from one token before, to tell if a new one begins
        offset = enc.token_to_chars(i)[0]
        if offset >= high:
            break
        at.append(offset)
        word.append(enc.token_to_word(i))
    at = np.array(at, np.int64)
    word = np.array([-1 if w is None else w for w in word], np.int64)
    # an added token has no word or one of its own; where offsets go on, a new pre-token begins
    new = np.ones(len(at), bool)
    new[1:] = ((word[1:] != word[:-1]) | (word[1:] < 0)) & (at[1:] > at[:-1])
    index = np.flatnonzero(new & (at >= low))
    return at[index], index + max(first - 1, 0)


def count_tokens(made, longest: int, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """Tokens of text, splices made, and times an overlap had to be widened."""
    encode = lambda s: made.encode(s, add_special_tokens=False)
    if len(text) <= chunk:
        return len(encode(text)), 0, 0
    total, splices, widened = 0, 0, 0
    begin, end = 0, chunk
    current = encode(text[begin:end])
    skip = 0  # tokens of the current chunk that the chunk before it has given
    while end < len(text):
        width = overlap
        while True:
            b_begin = max(begin + 1, end - width)
            b_end = min(len(text), b_begin + chunk)
            if b_end <= end:
                b_end = min(len(text), end + chunk)
            following = encode(text[b_begin:b_end])
            a_at, a_index = starts(current, b_begin - begin, end - begin)
            b_at, b_index = starts(following, 0, end - b_begin)
            common, ia, ib = np.intersect1d(a_at + begin, b_at + b_begin, return_indices=True)
            good = (common > b_begin) & (common < end - longest) & (a_index[ia] >= skip)
            if good.any():
                last = np.flatnonzero(good)[-1]
                total += int(a_index[ia[last]]) - skip
                skip = int(b_index[ib[last]])
                current, begin, end = following, b_begin, b_end
                splices += 1
                break
            widened += 1
            if b_begin == begin + 1:  # nothing in common in all of the chunk: the chunk itself must grow
                end = min(len(text), 2 * end - begin)
                current = encode(text[begin:end])
                if end == len(text):
                    break
            width *= 2
    return total + len(current) - skip, splices, widened


def counted(spark: SparkSession, text: Column, path: str, chunk: int = 16_384, overlap: int = 256) -> Column:
    """struct<n_bytes, n_tokens, splices, widened> for each text."""
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @arrow_udf("struct<n_bytes:bigint,n_tokens:bigint,splices:int,widened:int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made, longest = tokenizer(spec.value)
        known = pieces(made, spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            rows = np.zeros((len(texts), 3), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for at in range(0, len(short), 256):
                some = short[at : at + 256]
                rows[some, 0] = known.counts([texts[i] for i in some])
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    rows[i] = count_tokens(made, longest, t, chunk, overlap)
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32))],
                ["n_bytes", "n_tokens", "splices", "widened"],
            )

    return count(F.coalesce(text, F.lit("")))
