"""GIF, token counts, byte-level BPE, quality rules and toxicity: round trips, brute force, held-out accuracy, edge cases."""

import base64
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftcorpus.llm import byte_bpe, gif_media, quality_rules, token_counts, toxicity

TRICKY = [None, "", " ", "a", "é" * 70, "x " * 5000, "\n\n \t", "don't  stop  <|endoftext|> now", "漢字かな交じり", "a" * 3000, "0123 456\r\n789", "word\x85next more"]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


# ---------------------------------------------------------------------------------------------------------- GIF
@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_code_streams_come_back(data):
    assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8) == data


@pytest.mark.parametrize("size", [2, 3, 5, 8])
def test_code_streams_of_any_width_come_back_beyond_a_full_table(size):
    rng = random.Random(size)
    for data in (bytes(rng.randrange(1 << size) for _ in range(40_000)), bytes(30_000), b"\1\2" * 9000):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data, size), size) == data


def plain_decode(stream, size):
    """A decoder bit by bit, as the format's description has it."""
    clear, end, bits, at, out = 1 << size, (1 << size) + 1, size + 1, 0, bytearray()
    number, table, before = int.from_bytes(stream, "little"), {}, None
    while True:
        code = number >> at & (1 << bits) - 1
        at += bits
        if code == clear:
            table, bits, before = {i: bytes([i]) for i in range(clear)}, size + 1, None
            free = end + 1
            continue
        if code == end:
            return bytes(out)
        entry = table[code] if code in table else before + before[:1]
        out += entry
        if before is not None and free < 4096:
            table[free] = before + entry[:1]
            free += 1
            if free == 1 << bits and bits < 12:
                bits += 1
        before = entry


def test_code_streams_are_those_of_a_plain_decoder():
    rng = random.Random(2)
    for n in (0, 1, 2, 255, 256, 4000, 9000):
        data = bytes(rng.choice(b"abcde ") for _ in range(n))
        assert plain_decode(gif_media.lzw_encode(data), 8) == data


def test_disposal_and_transparency():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    def frame(left, top, cells, disposal, transparent=None, delay=7):
        return gif_media.Frame(left, top, np.array(cells, np.uint8), palette, delay, disposal, transparent)
    gif = gif_media.Gif(3, 2, 0, [frame(0, 0, [[1, 1, 1], [1, 1, 1]], 1), frame(0, 0, [[2, 3]], 3, 3), frame(1, 1, [[3, 3]], 2), frame(2, 0, [[2]], 0)])
    for shared in (None, palette):
        back = gif_media.read_gif(gif_media.write_gif(gif, shared))
        assert [f.delay_cs for f in back.frames] == [7] * 4 and [f.disposal for f in back.frames] == [1, 3, 2, 0]
        shown = [s[..., :3].tolist() for s in map(np.copy, gif_media.composite(back))]
        r, g, b, k = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
        assert shown == [[[r, r, r], [r, r, r]], [[g, r, r], [r, r, r]], [[r, r, r], [r, b, b]], [[r, r, g], [r, k, k]]]
    seen = list(map(np.copy, gif_media.composite(gif)))
    assert gif_media.histogram(seen[3]).sum() == 4


def test_interlaced_rows_find_their_place():
    rows = np.arange(11, dtype=np.uint8)[:, None].repeat(2, axis=1)
    order = gif_media.row_order(11)
    data = gif_media.write_gif(gif_media.Gif(2, 11, 0, [gif_media.Frame(0, 0, rows[order], gif_media.GREY)]), gif_media.GREY)
    at = data.index(b"\x2c", 13 + 768)
    flagged = data[: at + 9] + bytes([data[at + 9] | 0x40]) + data[at + 10 :]
    assert (gif_media.read_gif(flagged).frames[0].samples == rows).all()


def test_damaged_streams_are_errors():
    good = gif_media.store(gif_media.payload("some text"))
    for bad in (b"", b"GIF89a", good[:-30], good[:800] + b"\xff" * 20):
        with pytest.raises(ValueError):
            gif_media.read_gif(bad)


def test_media_columns(spark):
    long = "row " * 60_000
    rows = {r["doc_id"]: r for r in texts(spark, [*TRICKY, long]).select("doc_id", gif_media.media_features(F.col("text")).alias("r")).select("doc_id", "r.*").collect()}
    for i, t in enumerate([*TRICKY, long]):
        data = gif_media.payload(t)
        assert len(data) % 64 == 0 and data
        assert rows[i]["payload_bytes"] == len(data) and rows[i]["tail_crc32"] == zlib.crc32(data[-64:])
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"] and rows[12]["n_frames"] > 1
    frames = gif_media.timed_frames(gif_media.with_media(texts(spark, [long, None])), "doc_id").orderBy("key", "frame").collect()
    assert [r["start_cs"] for r in frames if r["key"] == 0] == [4 * i for i in range(rows[12]["n_frames"])]
    assert texts(spark, []).select(gif_media.media_features(F.col("text"))).count() == 0


# ------------------------------------------------------------------------------------------------------- tokens
def test_spliced_counts_are_the_library_s():
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, longest = token_counts.tokenizer(open(path, "rb").read())
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = ["word", " ", "  ", "\n", "<|endoftext|>", "é", "'s", "123", "漢", "!!", "\t \t", "a" * 50]
    for _ in range(30):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))
        want = len(plain.encode(text, add_special_tokens=False))
        for chunk, overlap in ((40, 1), (100, 7), (64, 64)):
            assert token_counts.count_tokens(made, longest, text, chunk, overlap)[0] == want


def test_counts_of_a_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = texts(spark, TRICKY).select("doc_id", token_counts.counted(spark, F.col("text"), path, 64, 8).alias("r")).orderBy("doc_id").collect()
    assert [r["r"]["n_tokens"] for r in got] == [len(plain.encode(t or "", add_special_tokens=False)) for t in TRICKY]
    assert [r["r"]["n_bytes"] for r in got] == [len((t or "").encode()) for t in TRICKY]


@given(st.lists(st.text(alphabet=st.sampled_from("ab1 '\n\t é漢!s\xa0\x85\x1c\u2003\u180e\u200b|<"), max_size=60) | st.just(" <|endoftext|> "), max_size=6))
@settings(max_examples=100, deadline=None)
def test_remembered_pieces_are_the_library_s(parts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = open(path, "rb").read()
    made, _ = token_counts.tokenizer(spec)
    known = token_counts.Pieces(made, spec, 50, 5)  # forgets all the time
    texts = [*parts, "".join(parts), " ".join(parts)]
    assert known.proven and known.counts(texts) == [len(made.encode(t, add_special_tokens=False)) for t in texts]


def test_pieces_are_cut_only_where_the_file_proves_it():
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    text = "two  words <|endoftext|> é\n x"
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}):
        raw = json.dumps(spec | change).encode()
        made, _ = token_counts.tokenizer(raw)
        known = token_counts.pieces(made, raw)
        assert not known.proven and known.counts([text]) == [len(made.encode(text, add_special_tokens=False))] and not known


def test_counts_of_a_column_take_less_than_the_library_s_time_for_whole_texts():
    """Seconds of one process: words that come again are not encoded again."""
    import time

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    made, _ = token_counts.tokenizer(spec)
    known = token_counts.Pieces(made, spec)
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulnrstdk") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(512)]

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert known.counts(texts) == [len(made.encode(t, add_special_tokens=False)) for t in texts]
    assert seconds(lambda: known.counts(texts)) < 0.6 * seconds(lambda: made.encode_batch_fast(texts, add_special_tokens=False))


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = texts(spark, TRICKY)
    got = df.select("doc_id", byte_bpe.encoded(spark, F.col("text"), path, public_tokenizers.PATTERN, 20).alias("ids"))
    got = got.select("doc_id", "ids", byte_bpe.decoded(spark, F.col("ids"), path, public_tokenizers.PATTERN).alias("raw")).orderBy("doc_id").collect()
    for r, t in zip(got, TRICKY, strict=True):
        assert r["ids"] == plain.encode_ordinary(t or "") and byte_bpe.same_text(t, bytes(r["raw"]))
    part = plain.decode_bytes(plain.encode_ordinary("漢字")[:1])
    assert isinstance(part, bytes)


@given(st.text(alphabet=st.sampled_from("ab1 '\n\t é漢!s\xa0\x85\x1c\u2003"), max_size=300), st.integers(1, 40), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_cuts_and_runs_change_no_token(text, limit, run):
    enc = byte_bpe.encoding(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    before = byte_bpe.RUN, byte_bpe.LONG_RUN
    byte_bpe.RUN, byte_bpe.LONG_RUN = 0, byte_bpe.re.compile(f"[{byte_bpe.SPACE}]{{{run},}}")
    try:
        assert byte_bpe.encode_text(enc, text, limit).tolist() == enc.encode_ordinary(text)
    finally:
        byte_bpe.RUN, byte_bpe.LONG_RUN = before


@given(st.text(alphabet=st.sampled_from("ab1 '\n\t é漢!s"), max_size=300), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_cuts_change_no_token(text, limit):
    enc = byte_bpe.encoding(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert byte_bpe.encode_text(enc, text, limit).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("kind", [" ", "\t", "\n", "a", "漢", "\u3000"])
def test_very_long_runs(kind):
    """Five million times one character, alone and between words; the plain count is that of its bytes merged as one piece."""
    enc = byte_bpe.encoding(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    n = 5_000_000
    if kind.isspace():
        whole, rest = len(enc._encode_single_piece((kind * n).encode())), enc._encode_single_piece((kind * (n - 1)).encode())
        assert len(byte_bpe.encode_text(enc, kind * n, 50_000)) == whole
        want = enc.encode_ordinary("one") + rest + enc.encode_ordinary(kind + "two three")
        assert byte_bpe.encode_text(enc, "one" + kind * n + "two three", 50_000).tolist() == want
    else:
        assert byte_bpe.encode_text(enc, kind * n + " x", 50_000).tolist() == enc._encode_single_piece((kind * n).encode()) + enc.encode_ordinary(" x")


@pytest.mark.parametrize("kind", [" ", "\t", "\n", "a", "漢", "!"])
def test_counts_of_long_runs_are_the_library_s_and_take_time_in_proportion(kind):
    import time

    path = public_tokenizers.path("byte_bpe_50k.json")
    made, longest = token_counts.tokenizer(open(path, "rb").read())
    text = "word " + kind * 400_000 + " end"
    began = time.monotonic()
    assert token_counts.count_tokens(made, longest, text, 16_384, 256)[0] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))
    assert time.monotonic() - began < 30


# ------------------------------------------------------------------------------------------------------ quality
def plain_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(6)
    values = [*TRICKY, "same line\nsame line\n\n\nsame line ", "a b c a b c", "a b", "# | <x> $5"]
    values += ["".join(rng.choice(["ab", "c", "é", " ", "\n", "# "]) for _ in range(rng.randrange(400))) for _ in range(40)]
    got = texts(spark, values).select("doc_id", quality_rules.quality(F.col("text")).alias("r")).orderBy("doc_id").collect()
    for r, t in zip(got, values, strict=True):
        assert tuple(r["r"])[:6] == plain_quality(t), t
        assert not (r["r"]["base_failed"] and r["r"]["kept"])


def test_quality_verdicts(spark):
    rng = random.Random(7)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    line = " ".join(clean.split()[:9])
    values = [clean, "\n".join([line] * 30), "# | " * 100 + clean, clean + "\n" + clean]
    got = [r["r"]["kept"] for r in texts(spark, values).select("doc_id", quality_rules.quality(F.col("text")).alias("r")).orderBy("doc_id").collect()]
    assert got == [True, False, False, False]


# ----------------------------------------------------------------------------------------------------- toxicity
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_the_automaton_accepts_what_the_distances_allow():
    rng = random.Random(8)
    lexicon = ["scum", "idiot", "worthless", "trash", "bad", "stupid", "abcdabcd", "stem*"]
    auto = toxicity.LexiconAutomaton(lexicon)
    tokens = {"".join(rng.choice("idotscumrahwelp") for _ in range(rng.randrange(1, 10))) for _ in range(300)}
    for w in lexicon:
        for _ in range(60):
            t = list(w.rstrip("*"))
            for _ in range(rng.randrange(4)):
                k = rng.randrange(3)
                at = rng.randrange(len(t) + (k == 0)) if t or k == 0 else 0
                if k == 0:
                    t.insert(at, rng.choice("abcdeit"))
                elif t:
                    t[at : at + 1] = [] if k == 1 else [rng.choice("abcdeit")]
            tokens.add("".join(t))
    for t in tokens - {""}:
        plain = [(distance(t, w), w) for w in lexicon if not w.endswith("*") and distance(t, w) <= toxicity.edits_for(w)]
        plain += [(0, "stem*")] * (t.startswith("stem") and len(t) > 4)
        want = min(plain, default=None)
        assert auto.match(t) == (want and (want[1], want[0])), t


def test_quotation_lowers_a_score():
    scorer = toxicity.Scorer(toxicity.Model({"scum": 5.0}, [-2.0, 1.0, 0.5, 0.5, -0.5, -0.5]))
    direct, quoted = (scorer.score(scorer.features(t)[0]) for t in ("you are scum", 'he said the word "scum" was reported'))
    assert direct > quoted


def test_toxicity_is_learned_and_holds_out(spark):
    rng = random.Random(9)
    bad = ["trash", "worthless", "moron"]
    docs, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "you wort7hless wortless trahs"), (None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    assert set(bad) <= set(model.lexicon)
    got = {r["doc_id"]: (r["h"], r["r"]) for r in d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.scored(F.col("text"), model).alias("r")).collect()}
    assert {i for i in range(900) if got[i][0]} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [got[i][1]["predicted"] == int(i % 6 == 0) for i in range(900) if got[i][0]]
    assert sum(right) / len(right) > 0.97
    assert got[5000][1]["score"] == got[5001][1]["score"] < 0.5 and got[5002][1]["inexact"] >= 1
    assert toxicity.fit(d, lab.limit(0)).lexicon == {} and struct.calcsize("d") == 8
