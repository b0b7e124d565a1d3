"""Sharding, URL filters, substring dedup, Jaccard join, mixing and the pipeline against brute force; edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftcorpus.llm import jaccard_join, mixing, shared, sharding, substring_dedup, url_filters
from weftcorpus.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# ----------------------------------------------------------------------------------------------------- sharding
def test_shards_are_whole_and_slots_gapless(spark):
    rows = [(i, "t" * (i % 50)) for i in range(2000)] + [(None, "x")] * 300 + [(7, None), (7, ""), (7, "a"), (7, "a")]
    df = table(spark, rows).withColumn("Slot", F.lit("taken"))
    got = sharding.sharded(df, shards=24, bucket_bytes=500).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert all(len(s) == 1 for s in shards.values())
    assert 0.5 / 25 < sum(r["grown_shard"] == 24 for r in got) / len(got) < 2.5 / 25 or len(shards) < 100


def test_shards_shuffle_and_repeat(spark, tmp_path):
    df = table(spark, [(i, "t") for i in range(3000)]).repartition(3, "doc_id")
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    one, two = ([(r["doc_id"], r["shard"], r["slot"]) for r in sharding.sharded(df, bucket_bytes=2000).orderBy("shard", "slot").collect()] for _ in range(2))
    assert one == two
    first = [d for d, s, _ in one if s == 0]
    assert first != sorted(first) and len(set(first)) == len(first)
    assert sharding.sharded(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), bucket_bytes=2000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000


# -------------------------------------------------------------------------------------------------- URL filters
def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", ""
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def test_rules_by_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "com", "net", "ex", ""]
    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    def path():
        return "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(5)))
    rules = [(host(), path(), rng.choice(["block", "allow"])) for _ in range(60)] + [(None, "/", "block"), ("com", None, "block")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=/a', '#x'])}" for _ in range(500)] + [None, "", "no scheme", "http://", "HTTPS://COM/A", "ftp://com?x", "a://b://c/d"] + ["http://com/ab"] * 400
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://com/", "y"), (1, urls[1], "again")], "page_id long, url string, host string")
    got = url_filters.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    def judge(u):
        h, p = plain_url(u)
        fits = [(len(rh + rp), rh + rp, v) for rh, rp, v in rules if rh is not None and rp is not None and (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fits, default=None)
        return (h, p, best and best[1], best[2] if best else "allow")
    want = Counter([(i, *judge(u)) for i, u in enumerate(urls)] + [(None, *judge("http://com/")), (1, *judge(urls[1]))])
    assert Counter(map(tuple, got)) == want
    assert url_filters.judged(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


# ----------------------------------------------------------------------------------------------- substring dedup
def plain_cut(rows, window=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[j : j + window])] = min(first.get(tuple(w[j : j + window]), 1 << 60), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_by_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = some(70), [(5, None), (6, ""), (7, "one"), (None, "the " * 90)]
    for i in range(90):
        kind = rng.randrange(5)
        if kind == 0:
            t = ["the"] * rng.randrange(200)
        elif kind == 1:
            t = some(rng.choice([2, 7, 13])) * rng.randrange(1, 25)
        elif kind == 2:
            t = some(rng.randrange(40)) + passage + some(rng.randrange(40))
        elif kind == 3 and len(rows) > 10:
            a = (rng.choice(rows)[1] or "").split()
            at = rng.randrange(len(a) + 1)
            t = some(rng.randrange(60)) + a[at : at + rng.randrange(200)] + some(rng.randrange(60))
        else:
            t = some(rng.randrange(260))
        rows.append((rng.randrange(10**6), " ".join(t)))
    rows += [rows[-1], (rows[-2][0], "another text"), (10**7, rows[-1][1])]
    df = table(spark, rows).withColumn("N_words", F.lit(1))
    got = substring_dedup.deduplicated(df).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == plain_cut(rows)
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0


def test_equal_words_get_equal_interior_symbols():
    import numpy as np

    rng = np.random.default_rng(1)
    zero = np.zeros(1, np.uint64)
    def parsed(words):
        return substring_dedup.recompressed(np.concatenate([zero, words, zero]))
    core = rng.integers(1, 1 << 60, 80, np.uint64)
    found = []
    for _ in range(5):
        left = rng.integers(1, 1 << 60, int(rng.integers(0, 30)), np.uint64)
        p = parsed(np.concatenate([left, core, rng.integers(1, 1 << 60, 9, np.uint64)]))
        at = 1 + len(left)
        inside = (p.low >= at) & (p.high <= at + len(core))
        found.append({(int(n), int(s) - at, int(e) - at) for n, s, e in zip(p.name[inside], p.start[inside], p.end[inside])})
    assert found[0] and all(f == found[0] for f in found)


def test_equal_windows_beside_runs_of_unlike_length(spark):
    import numpy as np

    rng, width = random.Random(3), 12
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(120):
        core = [rng.choice(vocabulary) for _ in range(width)]
        at = rng.randrange(3)
        if at != 1:
            core[: rng.randrange(1, 4)] = [core[0]]
        if at != 0:
            core[-rng.randrange(1, 4) :] = [core[-1]]
        core = (core + [core[-1]] * width)[:width]
        for i in range(3):
            left = [f"l{k}.{i}"] * 3 + [core[0]] * rng.choice((0, 0, 5, 30))
            rows.append((3 * k + i, " ".join(left + core + [core[-1]] * rng.choice((0, 0, 5, 30)) + [f"r{k}.{i}"] * 3)))
    words, begins, ends = substring_dedup.joined_words([t.encode() for _, t in rows], substring_dedup.WordHashes())
    doc, around, _, place, many = substring_dedup.anchored(words, begins, ends, width)
    found = defaultdict(set)
    for d, a, p, m in zip(doc, around, place, many):
        for j in range(p, p + m):
            found[tuple(words[begins[d] + j : begins[d] + j + width].tolist())].add(int(a))
    assert len(found) < int(np.sum(many)) and all(len(v) == 1 for v in found.values())
    got = substring_dedup.deduplicated(table(spark, rows), window=width).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == plain_cut(rows, width)


# -------------------------------------------------------------------------------------------------- Jaccard join
def plain_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset([tuple(w[j : j + 5]) for j in range(len(w) - 4)] or ([tuple(w)] if w else []))))
    parent = list(range(len(sets)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)].append(i)
    return Counter((i, len(s), min(least[find(k)], default=None) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120, 300]))] for _ in range(8)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A b c d"), (7, "a b c d e"), (None, "p q r s t u")]
    for i in range(100, 260):
        w = list(bases[i % 8]) if i % 3 else [rng.choice(vocabulary) for _ in range(rng.randrange(4, 90))] + common
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [rows[-1], (999, rows[-1][1])]
    df = table(spark, rows).withColumn("CLASS", F.lit(1)).withColumn("n", F.lit(1))
    assert Counter(map(tuple, jaccard_join.near_components(df).collect())) == plain_components(rows)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    roots = {c for i, n, c in plain_components(rows) if i is not None}
    assert {r["doc_id"] for r in kept.collect()} == roots | {None}
    assert jaccard_join.near_components(df.limit(0)).count() == 0


def test_bounds_never_lose_a_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(120):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 400)), np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(len(base) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 40)), np.uint64)]))]
    n = np.array([len(s) for s in sets])
    fine = [jaccard_join.fine_counts(s) for s in sets]
    points = np.stack([jaccard_join.folded(f, jaccard_join.GROUPS) for f in fine])
    every = np.arange(len(sets))
    got = {tuple(sorted(p)) for p in jaccard_join.tree_join(n, points, every, every, every)}
    half = {tuple(sorted(p)) for p in jaccard_join.tree_join(n, points, every, every[:100], every[100:])}
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert jaccard_join.fine_bound(fine[a], fine[b]) >= common
            if jaccard_join.similar(common, n[a], n[b]):
                assert (b, a) in got and ((b, a) in half or (a < 100) == (b < 100))
                keys = [set(s[: jaccard_join.prefix_length(len(s))].tolist()) for s in (sets[a], sets[b])]
                assert keys[0] & keys[1]


def test_connected_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_labels_go_across_centres_that_lie_near_each_other(spark):
    links = [(c, i) for c, low in ((100, 1), (200, 10), (300, 20)) for i in range(low, low + 11)] + [(400, 50), (400, 51)]
    got = {r["node"]: r["component"] for r in jaccard_join.around(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 50 if x >= 400 or 50 <= x <= 51 else 1 for pair in links for x in pair}
    assert jaccard_join.around(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_class_stands_once_in_a_block_and_fine_counts_are_packed(spark):
    shingle, codes = 5 << 64 - jaccard_join.KEY, (3 << jaccard_join.CODE | 900, 3 << jaccard_join.CODE | 800)
    rows = spark.createDataFrame([(own, [shingle | c for c in codes], 2) for own in (11, 12, 13)] + [(11, [shingle | codes[0]], 1)], "class long, keys array<long>, n_keys long")
    assert sorted(map(tuple, jaccard_join.blocks(rows).collect())) == [(shingle, 11), (shingle, 12), (shingle, 13)]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(900)))], "__id long, __text string")
    made = jaccard_join.described(docs, *jaccard_join.heavy_levels(docs)).first()
    counts = jaccard_join.fine_of(bytes(made["fine"]))
    assert counts.sum() == made["n"] == 896 and len(made["fine"]) < len(counts) / 2


def test_batches_for_python_are_small_and_the_setting_is_put_back(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    found = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda *a: seen.append(spark.conf.get(name)) or found(*a))
    df = spark.createDataFrame([(i, "x y z " * 9 + str(i % 3)) for i in range(20)], "doc_id long, text string")
    assert jaccard_join.near_components(df).count() == 20
    assert seen and set(seen) == {"4m"} and spark.conf.get(name) == before
    with shared.small_batches(spark, "64k"):
        sizes = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 1000)).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 30 and sum(r["n"] for r in sizes) == 4000


# ------------------------------------------------------------------------------------------------------- mixing
def test_raked_weights_meet_their_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor" * rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "fr", None]), rng.choice(["a"] * 6 + ["b", "c", None]), 1) for i in range(4000)]
    df = spark.createDataFrame(rows + [(None, None, None, None, None), (9, "", "en", "a", 0)], DOCS).withColumn("KEPT", F.lit(0)).withColumn("__source", F.lit("mine"))
    got = mixing.mixed(df, budget=0.5).collect()
    assert len(got) == 4002 and all(0 <= r["probability"] <= 1 and r["__source"] == "mine" for r in got)
    cells = mixing.targets(spark.createDataFrame([(s, la, t, rng.randrange(1, 900)) for s in ("a", "b", None) for la in ("x", "y") for t in range(3)], "source string, lang string, topic int, tokens long"))
    weighed, error = mixing.fitted(cells)
    weights = [r.asDict() for r in weighed.collect()]
    assert error <= mixing.TOLERANCE and mixing.residual(weighed) == error
    for margin in mixing.MARGINS:
        share, tokens = defaultdict(float), defaultdict(float)
        for c in weights:
            share[c[margin]] += c["weight"]
            tokens[c[margin]] += c["tokens"]
        total = sum(t**0.5 for t in tokens.values())
        for k in share:
            assert abs(share[k] / (tokens[k] ** 0.5 / total) - 1) < 0.01
    # targets that contradict each other leave an error, which is told
    apart = mixing.targets(spark.createDataFrame([("a", "x", 0, 900), ("b", "y", 0, 100), ("b", "y", 1, 100)], "source string, lang string, topic int, tokens long"))
    assert mixing.fitted(apart.withColumn("target_lang", F.lit(0.5)), most=6)[1] > 0.01
    expected = sum(r["probability"] * max(1, r["n_tokens"]) for r in got)
    assert abs(expected / sum(max(1, r["n_tokens"]) for r in got) - 0.5) < 0.01
    kept = sum(r["n_tokens"] for r in got if r["kept"])
    assert abs(kept / sum(r["n_tokens"] for r in got) - 0.5) < 0.05
    assert all(r["kept"] for r in mixing.mixed(df, budget=2.0).collect()) and mixing.mixed(df.limit(0)).count() == 0
    assert {(r["doc_id"], r["kept"]) for r in got} == {(r["doc_id"], r["kept"]) for r in mixing.mixed(df, budget=0.5, broadcast_cells=0).collect()}
    given = mixing.mixed(df.withColumn("topic", F.pmod("doc_id", F.lit(3)).cast("string")), topic="topic").select("doc_id", "topic").collect()
    assert all(r["topic"] == (None if r["doc_id"] is None else str(r["doc_id"] % 3)) for r in given)


def test_topics_cut_across_languages(spark):
    rng = random.Random(8)
    subjects = {"sea": "boat wave salt harbour sail tide".split(), "law": "court judge trial appeal statute verdict".split(), "food": "bread salt oven flour butter sugar".split()}
    rows, truth = [], {}
    for i in range(600):
        subject, lang = rng.choice(list(subjects)), rng.choice(["en", "fr"])
        common = ["the", "and", "of"] if lang == "en" else ["le", "et", "de"]
        words = [rng.choice(subjects[subject]) if rng.random() < 0.5 else rng.choice(common) for _ in range(40)]
        rows.append((i, " ".join(words), lang, "s", 1))
        truth[i] = subject
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), topics=3).collect()
    sizes = Counter((r["topic"], truth[r["doc_id"]]) for r in got)
    best = defaultdict(int)
    for (topic, _), n in sizes.items():
        best[topic] = max(best[topic], n)
    assert sum(best.values()) > 0.95 * len(rows)


def test_topics_are_learned_from_all_documents(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words[i % 5 * 80 :][:80], k=12)), rng.choice(["en", "fr", None]), "s", 1) for i in range(6000)]
    df = spark.createDataFrame(rows + [(9001, "", "en", "s", 1), (9002, None, None, "s", 1)], DOCS)
    model = mixing.fit_topics(df, "doc_id", "text", "lang")
    hashes = mixing.WordHashes(3)
    vectors = np.array([mixing.word_vector(r[1].encode(), hashes)[0] for r in rows])
    # every text counts: document frequencies, means of languages, and centres that are the means of what is nearest
    assert np.allclose(model.weights, np.log((1 + len(rows)) / (1 + (vectors > 0).sum(axis=0))) + 0.1)
    places = vectors * model.weights
    places /= np.linalg.norm(places, axis=1, keepdims=True)
    for lang in ("en", "fr", None):
        assert np.allclose(model.means[lang], places[[r[2] == lang for r in rows]].mean(axis=0), atol=1e-4)
    places -= np.array([model.means[r[2]] for r in rows])
    topics = ((places[:, None, :] - model.centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(model.centres, [places[topics == i].mean(axis=0) for i in range(8)], atol=0.02)
    # the same topics however rows are dealt out, and where languages are too many for a broadcast
    want = {r["doc_id"]: r["topic"] for r in mixing.mixed(df).collect()}
    assert [want[r[0]] for r in rows] == topics.tolist() and want[9001] == want[9002] == -1
    monkeypatch.setattr(mixing, "FEW", 1)
    assert {r["doc_id"]: r["topic"] for r in mixing.mixed(df.repartition(7)).collect()} == want


def test_starts_are_unlike_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{i % 8}x{j}" for j in range(80)], k=40)), "en", "s", 1) for i in range(48)]
    # rows of one key stand 40 times; a few texts under keys of their own outnumber all others by far
    many = [(100 + 3000 * i + j, *rows[i][1:]) for i, n in enumerate((3000, 300, 30)) for j in range(n)]
    for repeated in (rows, rows * 40, rows + many):
        model = mixing.fit_topics(spark.createDataFrame(repeated, DOCS), "doc_id", "text", "lang")
        assert len(model.centres) == len(np.unique(model.centres, axis=0)) == 8
    points = [(i % 7, np.full(mixing.BUCKETS, i % 12, "<i2").tobytes()) for i in range(2000)]
    table = spark.createDataFrame(points, "h long, p binary").repartition(3)
    nothing, first = np.zeros((0, mixing.BUCKETS)), np.zeros((1, mixing.BUCKETS))
    assert sorted(mixing.drawn(table, nothing, 0, 12)[:, 0]) == list(range(12))
    assert sorted(mixing.drawn(table, first, 1, 40)[:, 0]) == list(range(12)) and len(mixing.drawn(table, first, 1, 5)) == 6


def test_topics_in_small_batches(spark, monkeypatch):
    rows = [(i, f"a{i % 7} b{i % 11} c{i % 13}", "en", "s", 1) for i in range(4500)]
    df = spark.createDataFrame(rows, DOCS).repartition(9)
    want = {r["doc_id"]: r["topic"] for r in mixing.mixed(df).collect()}
    name, learned, seen = "spark.sql.execution.arrow.maxBytesPerBatch", mixing.learned, []
    before = spark.conf.get(name, None)
    monkeypatch.setattr(mixing, "learned", lambda *given: seen.append(spark.conf.get(name)) or learned(*given))
    assert {r["doc_id"]: r["topic"] for r in mixing.mixed(df.coalesce(1)).collect()} == want
    assert seen == [mixing.BATCH] and spark.conf.get(name, None) == before


# ----------------------------------------------------------------------------------------------------- pipeline
def test_mixture_stage_learns_from_all_documents(spark, monkeypatch):
    import corpus_pipeline

    rows = [(i, f"a{i % 7} b{i % 11} c{i % 13}", "en", "s", 1) for i in range(4500)] + [(9001, "", "en", "s", 1), (9002, None, "en", "s", 1)]
    learned, seen = mixing.learned, []
    monkeypatch.setattr(mixing, "learned", lambda rows, topics: seen.append(rows.count()) or learned(rows, topics))
    kept = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, DOCS), "")
    assert 0 < kept.count() < len(rows) and kept.columns == spark.createDataFrame([], DOCS).columns and seen == [4500]


def test_pipeline_by_brute_force(spark, tmp_path):
    import public_tokenizers

    import corpus_pipeline
    from weftcorpus.llm import byte_bpe, quality_rules

    rng = random.Random(6)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    def fresh(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, fresh(rng.randrange(30, 200)), rng.choice(["en", "fr"]), rng.choice("abc"), 1) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " extra", "en", "a", 1) for i in range(20)] + [(300 + i, fresh(60) + " " + passage + " " + fresh(60), "fr", "b", 1) for i in range(8)]
    rows += [(400, None, None, None, None), (401, "same line\n" * 60, "en", "a", 1)]
    taken = {c: F.lit("mine") for c in ("repeats", "__at", "__source", "__quality", "KEPT_text", "topic")}
    spark.createDataFrame(rows, DOCS).withColumns(taken).write.parquet(str(tmp_path / "documents.parquet"))

    good = [r for r in rows if quality_rules.measure(r[1])[6]]
    comp = {i: c for i, n, c in plain_components([(r[0], r[1]) for r in good])}
    single = [r for r in good if comp[r[0]] == r[0]]
    cut = {i: (gone, kept) for i, n, gone, kept in plain_cut([(r[0], r[1]) for r in single])}
    texts = {r[0]: cut[r[0]][1] if cut[r[0]][0] else r[1] for r in single}
    assert any(cut[r[0]][0] for r in single) and len(single) < len(good) < len(rows)
    docs = spark.createDataFrame([(r[0], texts[r[0]], *r[2:]) for r in single], DOCS)
    chosen = {r["doc_id"] for r in mixing.mixed(docs).where("kept").collect()}
    enc = byte_bpe.encoding(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    want = {i: (len(ids := byte_bpe.encode_text(enc, texts[i], 1 << 30)), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i in chosen}
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and zlib.crc32(b"") == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.where("repeats = 'mine' and __at = 'mine' and __source = 'mine'").count() == made.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mixture", "token_ids"]
