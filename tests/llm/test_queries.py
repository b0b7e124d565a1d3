"""Every registered query on a small folder of tables, against a plain version of what it is to return."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_corpus import DOCS, plain_components, plain_cut, plain_url
from test_maps import distance, plain_decode, plain_quality
from weftcorpus.llm import mixing, queries, quality_rules, toxicity

BAD = ["trash", "worthless", "moron"]


def made_rows():
    rng = random.Random(11)
    def word():
        return "".join(rng.choice("aeioulnrstdk") for _ in range(rng.randrange(1, 9)))
    passage = [word() for _ in range(64)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no key here"), (5, "a b c d"), (6, "é漢字 ß ñandú \x85 word"), (7, "say <|endoftext|> don't  stop\r\n12 345")]
    for i in range(10, 330):
        words = [word() for _ in range(rng.choice([3, 20, 60, 150]))]
        if i % 6 == 0:
            words[rng.randrange(len(words)) :] = [rng.choice(BAD), "you", rng.choice(BAD)]
        if i % 7 == 0:
            words += passage
        if i % 11 == 0:
            words = words[:9] * 12
        if i % 13 == 0 and i > 60:
            words = (rows[-20][1] or "x").split() + ["more"]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [rows[40], (8, rows[41][1]), (9000, "漢字 " * 9000), (9001, "é" * 3000), (9002, "row of words " * 7000)]
    rows.append((9003, " ".join([*(f"u{k}" for k in range(60)), *[f"s{k}" for k in range(24)] * 2])))
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a"] * 5 + ["b", "c", None]), len(t or "")) for i, t in rows]


ROWS = made_rows()
URLS = ["http://a.com/en/1", "https://EXAMPLE.com/en/7?x", "http://www.example.com/en/78", "http://net/de/", "http://x.example.net/de/8#y", "ftp://org/es/9", "http://a.org/en", "nothing", None, "http://com", "http://notcom/en/1"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(ROWS, DOCS)
    for column in ("repeats", "__at", "__bucket", "__source", "__topic", "__text_hash", "Class", "__rows"):
        docs = docs.withColumn(column, F.lit("mine"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(any(b in (t or "") for b in BAD))) for i, t, *_ in ROWS if i and i < 330], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    docs.limit(0).write.parquet(f"{path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/empty/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/empty/pages.parquet")
    return str(path)


def ran(spark, folder, name, required):
    """The rows of a query, as tuples of the required columns."""
    made = queries.queries()[name](spark, folder)
    kinds = {f.name: f.dataType.simpleString() for f in made.schema}
    assert {k: kinds.get(k) for k in required} == required
    return [tuple(r) for r in made.select(*required).collect()]


def utf8(text):
    return (text or "").encode()


def test_every_query_takes_empty_tables(spark, folder):
    for name, query in queries.queries().items():
        assert query(spark, f"{folder}/empty").count() == 0, name


def test_op1(spark, folder):
    got = ran(spark, folder, "op1_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert Counter(i for i, *_ in got) == Counter(r[0] for r in ROWS)
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(BAD) <= set(model.lexicon)
    want = Counter((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(plain_score(t, model), 9)) for i, t, *_ in ROWS)
    assert Counter((i, h, round(s, 9)) for i, h, s, _ in got) == want
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for _, _, s, p in got)


def plain_score(text, model):
    """The score with distances by the textbook, a look at all hits for each, and marks paired by hand."""
    tokens = toxicity.TOKEN.findall((text or "").lower())
    known = {}
    def hit(token):
        if token not in known:
            found = [(0, w) for w in model.lexicon if w.endswith("*") and token.startswith(w[:-1]) and len(token) >= len(w)]
            found += [(d, w) for w in model.lexicon if not w.endswith("*") and abs(len(w) - len(token)) <= 2 and (d := distance(token, w)) <= (0 if len(w) < 4 else 1 if len(w) < 8 else 2)]
            known[token] = min(found, default=None)
        return known[token]
    hits = {i: h for i, t in enumerate(tokens) if (h := hit(t))}
    abuse = largest = quoted = inexact = 0.0
    for i, (edits, word) in hits.items():
        around = [tokens[j] for j in range(i - 8, i + 9) if 0 <= j < len(tokens) and j != i]
        report = 0.75 * sum(t in toxicity.REPORT for t in around)
        near = sum(abs(i - j) <= 8 for j in hits) - 1
        against = 0.5 + 0.5 * sum(t in toxicity.SECOND for t in around) + 0.5 * near + 0.25 * around.count("!")
        weight = model.lexicon[word] * 0.35**edits
        share = 1 / (1 + math.exp(report - against))
        abuse, largest, quoted, inexact = abuse + weight * share, max(largest, weight * share), quoted + weight * (1 - share), inexact + weight * (edits > 0)
    x = [math.log1p(abuse), largest, math.log1p(100 * abuse / (len(tokens) + 30)), math.log1p(quoted), math.log1p(inexact)]
    z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x if hits else [0.0] * 5))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_long_quotations_and_paragraphs():
    quoted = toxicity.Scorer.quoted
    words = ["w"] * 200
    assert quoted(["“", *words, "”", "x"]) == [True] * 201 + [False] * 2
    assert quoted(['"', *words, '"', "x"]) == [True] * 201 + [False] * 2
    assert not any(quoted(['"', *words, "\n\n", *words])) and not any(quoted(["“", *words]))


def test_many_hits_take_time_in_proportion():
    import time

    scorer = toxicity.Scorer(toxicity.Model({"scum": 5.0}, [0.0] * 6))
    began = time.monotonic()
    assert scorer.features("scum " * 200_000)[1] == 200_000 and time.monotonic() - began < 20


def plain_gif(data):
    """Grey samples and delays of a GIF whose frames have full width, block by block."""
    assert data[:6] == b"GIF89a"
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)
    out, delays = b"", []
    def blocks(at):
        parts = b""
        while data[at]:
            parts, at = parts + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        return parts, at + 1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delays.append(struct.unpack_from("<H", data, at + 4)[0])
            _, at = blocks(at + 2)
        else:
            assert data[at] == 0x2C and not data[at + 9] & 0xC0
            codes, end = blocks(at + 11)
            out += plain_decode(codes, data[at + 10])
            at = end
    return out, delays


def test_op2(spark, folder):
    from weftcorpus.llm import gif_media

    got = ran(spark, folder, "op2_gif_media", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"})
    want = []
    for i, t, *_ in ROWS:
        raw = utf8(t)
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        media = gif_media.store(data)
        if len(raw) < 3000:
            assert plain_gif(media)[0] == data
        delays = plain_gif(media)[1] if len(raw) < 3000 else [4] * math.ceil(len(data) / 64 / gif_media.ROWS)
        counts = Counter(data)
        bits = -sum(c / len(data) * math.log2(c / len(data)) for c in counts.values())
        grey = [sum(c for b, c in counts.items() if b // 64 == k) for k in range(4)]
        feature = f"frames={len(delays)};cs={sum(delays)};grey={','.join(map(str, grey))};levels={len(counts)};bits={abs(bits) if counts == {0: len(data)} else bits:.4f}"
        want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature.replace("bits=-0.0000", "bits=0.0000")))
    assert Counter((*r[:7], r[7].replace("bits=-0.0000", "bits=0.0000")) for r in got) == Counter(want)


def test_op3(spark, folder):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = ran(spark, folder, "op3_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    assert Counter(got) == Counter((i, len(utf8(t)), n := len(plain.encode(t or "", add_special_tokens=False)), n > 1024) for i, t, *_ in ROWS)


def plain_shard(key, shards, seed=7):
    def hashed(i):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed + i), 42)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return h - (1 << 64) if h >> 63 else h
    return max(range(shards), key=lambda i: (hashed(i), i))


def test_op4(spark, folder):
    got = ran(spark, folder, "op4_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    want = Counter((i, len(utf8(t)) + 8, zlib.crc32(utf8(t)), "key", plain_shard(i, 24), plain_shard(i, 25)) for i, t, *_ in ROWS)
    assert Counter((*r[:5], r[6]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5(spark, folder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = ran(spark, folder, "op5_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    want = Counter()
    for i, t, *_ in ROWS:
        ids = plain.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(utf8(t)).hexdigest()] += 1
    assert Counter(got) == want


def plain_coverage(text):
    words = utf8(text).split()
    chars = [len(w.decode()) for w in words]
    shares = []
    for n in quality_rules.NGRAMS:
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {i + k for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for k in range(n)}
        shares.append(sum(chars[i] for i in inside) / max(1, sum(chars)))
    seen, again = set(), 0
    for line in utf8(text).split(b"\n"):
        if line.split():
            again += sum(len(w.decode()) for w in line.split()) if line in seen else 0
            seen.add(line)
    return [*shares, again / max(1, sum(chars))]


def test_op6(spark, folder):
    required = {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}
    got = ran(spark, folder, "op6_quality_rules", required | {f"coverage_{n}": "double" for n in quality_rules.NGRAMS} | {"line_coverage": "double"})
    want, small = Counter(), [r for r in ROWS if r[4] < 5000]
    for i, t, *_ in small:
        base, shares = plain_quality(t), plain_coverage(t)
        kept = not base[5] and all(s <= most for s, most in zip(shares, [0.40, 0.35, 0.30, 0.30])) and base[2] <= 0.10 * base[0]
        want[(i, *base, kept, *(round(s, 9) for s in shares))] += 1
    keys = {r[0] for r in small}
    assert Counter((*r[:8], *(round(x, 9) for x in r[8:])) for r in got if r[0] in keys) == want
    assert any(r[7] for r in got) and any(not r[7] and not r[6] for r in got)


def test_coverage_counts_code_points():
    text = "ééééé aa bb cc dd " * 2 + " ".join(f"w{i}" for i in range(60))
    assert quality_rules.measure(text)[7] == pytest.approx(plain_coverage(text)[0]) and plain_coverage(text)[0] < 0.14


def test_op7(spark, folder):
    got = ran(spark, folder, "op7_url_filters", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})
    want = []
    for i, u in enumerate(URLS):
        h, p = plain_url(u)
        fits = max(((len(a + b), a + b, v) for a, b, v in queries.URL_RULES if (h == a or h.endswith("." + a)) and p.startswith(b)), default=(0, None, "allow"))
        want.append((i, h, p, *fits[1:]))
    assert Counter(got) == Counter(want)


def test_op7_rules_of_the_contract(spark, folder):
    rules = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{verdict} {host}{path}" for host, path, verdict in queries.URL_RULES] == rules.split(", ")
    got = {r["page_id"]: r["verdict"] for r in queries.op7_url_filters(spark, folder).where("rule is not null").collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block"}


def test_op8(spark, folder):
    got = ran(spark, folder, "op8_substring_dedup", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    plain = plain_cut([r[:2] for r in ROWS])
    assert Counter(got) == Counter({(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()): c for (i, n, gone, kept), c in plain.items()})


def test_op9(spark, folder):
    got = ran(spark, folder, "op9_jaccard_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert Counter(got) == plain_components([r[:2] for r in ROWS])


def plain_mix(rows, topics, budget=0.7):
    """Probabilities by raking a dictionary of cells, and by filling cells until the budget is spent."""
    tokens = Counter()
    for (_, t, lang, source, _), topic in zip(rows, topics, strict=True):
        tokens[source, lang, topic] += max(1, len(utf8(t).split()))
    weight, aims = {c: float(n) for c, n in tokens.items()}, []
    for m in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[m]] += n
        total = sum(n**0.5 for n in sums.values())
        aims.append({k: n**0.5 / total for k, n in sums.items()})
    for _ in range(400):
        for m in range(3):
            sums = Counter()
            for c, w in weight.items():
                sums[c[m]] += w
            weight = {c: w * aims[m][c[m]] / sums[c[m]] for c, w in weight.items()}
    left, full = budget * sum(tokens.values()), set()
    while True:
        scale = left / sum(w for c, w in weight.items() if c not in full)
        more = {c for c, w in weight.items() if c not in full and scale * w >= tokens[c]}
        if not more:
            return {c: 1.0 if c in full else scale * w / tokens[c] for c, w in weight.items()}
        full |= more
        left -= sum(tokens[c] for c in more)


def test_op10(spark, folder):
    required = {"doc_id": "bigint", "source": "string", "lang": "string", "topic": "int", "n_tokens": "bigint", "probability": "double", "residual": "double", "kept": "boolean"}
    got = ran(spark, folder, "op10_mixing", required)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = mixing.fit_topics(docs, "doc_id", "text", "lang")
    hashes = mixing.WordHashes(3)
    topics = []
    for _, t, lang, *_ in ROWS:
        vector, n = mixing.word_vector(utf8(t), hashes)
        place = vector * model.weights
        place = place / max(np.linalg.norm(place), 1e-12) - model.means.get(lang, 0)
        topics.append(int(np.argmin([((place - c) ** 2).sum() for c in model.centres])) if n else -1)
    assert len(set(topics)) > 3
    assert Counter(r[:5] for r in got) == Counter((i, s, lang, k, len(utf8(t).split())) for (i, t, lang, s, _), k in zip(ROWS, topics, strict=True))
    error = got[0][6]
    assert error <= mixing.TOLERANCE  # all three margins, at production parameters
    want = plain_mix(ROWS, topics)
    for i, s, lang, k, n, p, _, kept in got:
        assert p == pytest.approx(want[s, lang, k], rel=0.05)
        uniform = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) / 16**12
        assert kept == (uniform < p)
