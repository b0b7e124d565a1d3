"""Signatures, ingestion, vocabularies, crawls, sinks and table functions against plain versions."""

import gzip
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcorpus.functions.text import canonical_form, exact_hash
from weftcorpus.functions import tables, text
from weftcorpus.functions.language import KONKANI_MARKERS, MARATHI_MARKERS, MARKERS
from weftcorpus.operators import accounts, batches, bpe, ingest, metrics, near, overlap, reasoning, tokens, web
from weftcorpus.sources import io
from weftcorpus.streaming import jobs


def plain_signature(t):
    """The published hasher, step by step: a linear congruential generator, and the least of (a * h + b) mod p."""
    state, drawn = 0xC0FFEE, []
    for _ in range(256):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        drawn.append(state >> 16)
    p = 2**31 - 1
    pairs = [(drawn[i] % (p - 1) + 1, drawn[i + 1] % p) for i in range(0, 256, 2)]
    canon = " ".join(t.split()).lower()
    found = {zlib.crc32(canon[i : i + 5].encode()) & 0x7FFFFFFF for i in range(max(1, len(canon) - 4))} if canon else set()
    return [min(((a * h + b) % p for h in found), default=p) for a, b in pairs]


def noisy(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = rng.choice("abcdefgh") * 4
    return " ".join(out)


def corpus(seed, n):
    rng = random.Random(seed)
    bases = [["".join(rng.choice("abcdefgh é") for _ in range(6)).strip() or "x" for _ in range(60)] for _ in range(5)]
    return [(i, noisy(rng, rng.choice(bases), rng.choice([0, 0, 1, 3, 40]))) for i in range(n)]


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / 128


def bands_meet(a, b, n, rows):
    return any(a[i * rows : (i + 1) * rows] == b[i * rows : (i + 1) * rows] for i in range(n))


def test_signatures_are_those_of_a_plain_hasher(spark):
    docs = [*corpus(1, 8), (90, ""), (91, "abc"), (92, "漢字かな交じり文です"), (93, "  A  b ")]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(docs, "id long, t string").select("id", near.minhash(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_signature(t) for i, t in docs}


def test_matches_by_brute_force(spark):
    docs = corpus(2, 40)
    signed = spark.createDataFrame(docs, "id long, t string").select("id", near.minhash(F.col("t")).alias("signature"))
    got = {(r["id"], r["other"]): r["score"] for r in near.matches(signed.where("id < 20"), signed.where("id >= 20"), 0.8, 32, 4).collect()}
    s = {i: plain_signature(t) for i, t in docs}
    want = {(a, b): likeness(s[a], s[b]) for a in range(20) for b in range(20, 40) if bands_meet(s[a], s[b], 32, 4) and likeness(s[a], s[b]) >= 0.8}
    assert got == want and want
    best = overlap.best_pairs(near.matches(signed.where("id < 20"), signed.where("id >= 20"), 0.8, 32, 4)).collect()
    assert [(r["id"], r["other"]) for r in best] == [k for k, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]]


def plain_decisions(docs, reason):
    kept, seen, out = [], set(), {}
    for i, t in docs:
        s, h = plain_signature(t), " ".join(t.split()).lower()
        if reason(i, t):
            out[i] = reason(i, t)
        elif h in seen:
            out[i] = "exact_duplicate"
        elif any(bands_meet(s, k, 16, 8) and likeness(s, k) >= 0.85 for k in kept):
            out[i] = "near_duplicate"
            seen.add(h)
        else:
            kept.append(s)
            seen.add(h)
            out[i] = None
    return out


def test_decisions_by_brute_force(spark):
    docs = corpus(3, 60)
    df = spark.createDataFrame(docs, "id long, t string")
    got = {r["id"]: r["reason"] for r in ingest.decided(df, "id", "t", F.when(F.col("id") % 9 == 0, "no"), ["id"]).collect()}
    assert got == plain_decisions(docs, lambda i, t: "no" if i % 9 == 0 else None)
    assert Counter(v or "kept" for v in got.values()).keys() >= {"no", "kept", "exact_duplicate", "near_duplicate"}


def test_streamed_decisions_and_their_resumption(spark):
    docs = corpus(4, 60)
    df = spark.createDataFrame(docs, "id long, t string")
    at = jobs.in_files(df, "id", [15, 30, 45], "t")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    job = jobs.Ingest(spark, "id", "t", lambda rows: F.when(F.col("id") % 9 == 0, "no"), T.LongType())
    found = {r["id"]: r["reason"] for r in job.run(stream()).collect()}
    # a kept document of an earlier batch is the only kind that counts as an original here too, but for exact copies of dropped ones
    want = plain_decisions(docs, lambda i, t: "no" if i % 9 == 0 else None)
    assert {i for i, r in found.items() if r is None} == {i for i, r in want.items() if r is None}
    assert {i for i, r in found.items() if r == "no"} == {i for i, r in want.items() if r == "no"}
    job.step(spark.read.schema(df.schema).parquet(at).where("id >= 45"), 3)  # the last batch once more
    again = jobs.finished(spark, f"{job.at}/decisions", job.decisions)
    assert {r["id"]: r["reason"] for r in again.collect()} == found


@pytest.mark.parametrize("bounds", [[], [7], [3, 4, 5, 20], [0, 29]])
def test_packs_are_the_same_wherever_batches_end(spark, bounds):
    rng = random.Random(6)
    rows = [(f"g{i % 3}", i, " ".join(["w"] * rng.randrange(0, 9))) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, o long, t string")
    packer = jobs.Packer(spark, "g", "o", "t", T.StringType(), T.LongType(), 12)
    at = jobs.in_files(df, "o", bounds, "p")
    got = Counter(map(tuple, packer.run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)).collect()))
    want = Counter()
    for g in ("g0", "g1", "g2"):
        number, parts = 0, []
        for _, _, t in [r for r in rows if r[0] == g and r[2]]:
            parts.append(t)
            n = sum(len(p.split()) for p in parts)
            if n >= 12:
                want[g, number, " ".join(parts), n, len(parts)] += 1
                number, parts = number + 1, []
        if parts:
            want[g, number, " ".join(parts), sum(len(p.split()) for p in parts), len(parts)] += 1
    assert got == want


# ------------------------------------------------------------------------------------------------------ vocabularies
def test_learning_and_round_trips(spark):
    rows = [(i, t, t.split()) for i, t in enumerate(["low lower lowest new newer", "漢字 unseen ಕನ್ನಡ", "", "ABC  def"])]
    df = spark.createDataFrame(rows, "id long, t string, w array<string>")
    learned = bpe.checked(bpe.learned(bpe.word_table(df.where("id = 0"), "w"), 290))
    assert "▁low" in learned and learned[:4] == tokens.SPECIAL and learned[4] == "<0x00>"
    ids = {p: i for i, p in enumerate(learned)}
    coded = df.withColumn("ids", tokens.encode(F.col("w"), ids, bpe.scores(learned)))
    assert all(r["roundtrip_ok"] and r["unk"] == 0 for r in bpe.example(coded, "id", "t", "ids", "w", learned).collect())
    with pytest.raises(ValueError):
        bpe.learned([("abc", 1)], 261)
    with pytest.raises(ValueError):
        bpe.checked(learned[4:])
    with pytest.raises(ValueError):
        bpe.word_table(df, "w", most=2)


def plain_chrf(pairs):
    p = r = 0
    for n in range(1, 7):
        m = h = f = 0
        for a, b in pairs:
            a, b = (x.replace(" ", "") for x in (a, b))
            x, y = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (a, b))
            m, h, f = m + sum((x & y).values()), h + sum(x.values()), f + sum(y.values())
        p, r = p + (m / h if h else 0) / 6, r + (m / f if f else 0) / 6
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0


def test_chrf_by_brute_force(spark):
    rng = random.Random(7)
    some = lambda: " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(30)))
    pairs = [(some(), some()) for _ in range(20)] + [("", "abc"), ("ab", "ab")]
    got = metrics.chrf(spark.createDataFrame(pairs, "h string, r string"), "h", "r").first()["chrf"]
    assert got == pytest.approx(plain_chrf(pairs))


# ------------------------------------------------------------------------------------------------------------ texts
def test_entities_and_articles(spark):
    page = "<script>x</script><p>It&rsquo;s caf&eacute; &#8217; &ndash; &amp;lt; one two three four five</p><p>short</p>"
    got = spark.createDataFrame([(page,)], "t string").select(text.article_text(F.col("t"), "[A-Za-z]"), text.unescape(F.lit("&eacute;&#65;&amp;amp;"))).first()
    assert got[0] == "It’s café ’ – &lt; one two three four five" and got[1] == "éA&amp;"


def test_markers_without_shared_words():
    assert MARATHI_MARKERS & KONKANI_MARKERS == {"तो", "ती"} and not set(MARKERS["mr"]) & set(MARKERS["kok"])
    assert len(MARKERS["mr"]) == 36 and len(MARKERS["kok"]) == 37


def test_items_are_as_many_as_asked_or_an_error(spark):
    train, _ = reasoning.split_names("marathi")
    assert reasoning.items(spark, "marathi", 700, train, ["p_value"], 3).count() == 700
    with pytest.raises(ValueError):
        reasoning.items(spark, "marathi", 3000, train[:4], ["p_more"], 3, most_draws=2)


# ------------------------------------------------------------------------------------------------------------ crawls
def test_sitemaps_of_any_kind(spark):
    xml = lambda s: f'<?xml version="1.0"?><{s}'.encode()
    bodies = [
        ("r", gzip.compress(xml("sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc> b </loc></sitemap><sitemap></sitemap></sitemapindex>"))),
        ("a", xml("s:urlset xmlns:s='x'><s:url><s:loc>http://h/1?a=1&amp;b=2</s:loc><s:lastmod>2020-01-01</s:lastmod></s:url><s:url><s:loc>http://h/2</s:loc></s:url></s:urlset>")),
        ("b", xml("urlset><url><loc>http://h/video/3</loc></url><url><loc>http://h/4</loc><lastmod>bad</lastmod></url></urlset>")),
        ("c", gzip.compress(b"<urlset>")[:8]), ("r2", None),
    ]
    maps = spark.createDataFrame(bodies, "url string, body binary")
    seeds = spark.createDataFrame([("r",), ("c",), ("r2",), ("gone",)], "url string")
    got = {(r["url"], r["depth"]) for r in web.discovered(maps, seeds, "2021-01-01").collect()}
    assert got == {("http://h/2", 1), ("http://h/4", 1)}
    assert web.discovered(maps, seeds, "2019-01-01", most_urls=1).count() == 1
    assert {r["url"] for r in web.discovered(maps, seeds, "2019-01-01", most_maps=1).collect()} == set()


def test_cursors_that_loop_or_break(spark):
    pages = [("", "b", ["1", "2"]), ("b", "c", ["2", "3"]), ("c", "b", ["4"]), ("x", None, ["9"])]
    steps = web.followed(spark.createDataFrame(pages, "cursor string, next string, items array<string>"))
    assert [(r["step"], r["cursor"]) for r in steps.orderBy("step").collect()] == [(0, ""), (1, "b"), (2, "c")]
    assert {(r["id"], r["step"], r["reason"]) for r in web.listed(steps, {"4": "no"}).collect()} == {("1", 0, None), ("2", 0, None), ("3", 1, None), ("4", 2, "no")}


# ------------------------------------------------------------------------------------------------------------- sinks
def test_sinks_and_sources(spark, tmp_path):
    at = str(tmp_path)
    stream = tokens.packed(spark.createDataFrame([(i, list(range(i % 7))) for i in range(50)], "k long, ids array<int>"), "k", "ids", 2)
    told = io.write_packed(stream, f"{at}/packed", 256, 2)
    back = io.packed(spark, f"{at}/packed").orderBy("offset").collect()
    assert [list(r["ids"]) for r in back] == [[*range(i % 7), 2] for i in range(50)] and told["tokens"] == sum(i % 7 + 1 for i in range(50))
    io.write_json(spark, f"{at}/packed/meta.json", told | {"tokens": 1})
    with pytest.raises(ValueError):
        io.packed(spark, f"{at}/packed")
    with pytest.raises(ValueError):
        io.write_packed(stream, f"{at}/small", 3, 2)
    assert io.json_or_none(spark, f"{at}/gone.json", "a int") is None
    (tmp_path / "bad.json").write_text("{broken")
    assert io.json_or_none(spark, f"{at}/bad.json", "a int") is None
    io.write_json(spark, f"{at}/good.json", {"a": 3})
    assert io.json_or_none(spark, f"{at}/good.json", "a int") == {"a": 3}
    assert io.first_existing(spark, [(f"{at}/no", f"{at}/good.json"), (f"{at}/good.json",)]) == (f"{at}/good.json",)
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, [(f"{at}/no",)])
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "mr_one.txt").write_text("one two\n\nthree four")
    (tmp_path / "books" / "xx.txt").write_text("left out")
    source = io.register(io.Source("books", f"{at}/books", "value", format="text", include=("mr_",)))
    assert [r["text"] for r in io.read(spark, source).collect()] == ["one two\nthree four"] and io.registered(spark).first()["name"] == "books"
    with pytest.raises(ValueError):
        io.register(source)
    assert {r["path"].rsplit("/", 1)[1] for r in io.files(spark, f"{at}/books", "*.txt", "mr_").collect()} == {"mr_one.txt"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", " ", "--- SOURCE: x", "c\nd", None])], "k long, text string")
    io.write_sample(docs, f"{at}/sample", "k", 5)
    assert {r["value"] for r in spark.read.text(f"{at}/sample").collect()} == {"a b", "c d"}
    assert tuple(io.inspected(docs, "text", "k", 4).first()) == (4, 1, 20, 7, 13)
    items = docs.withColumn("split", F.when(F.col("k") < 2, "train").otherwise("val"))
    io.write_jsonl(items, f"{at}/train", "train")
    assert spark.read.json(f"{at}/train").count() == 2
    io.write_splits(items, f"{at}/splits")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        io.write_splits(items, f"{at}/splits")
    (tmp_path / "meta.csv").write_text("id,title\n1,x\n2,\n")
    assert [tuple(r) for r in io.metadata(spark, f"{at}/meta.csv", "id int, title string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert io.positional(docs.withColumnRenamed("k", "pos"), docs.select(F.col("k").alias("pos"), F.col("text").alias("m"))).count() == 5
    with pytest.raises(ValueError):
        io.positional(docs.withColumnRenamed("k", "pos"), docs.limit(2).select(F.col("k").alias("pos")))
    with pytest.raises(ValueError):
        io.tokenizer_corpus(spark, f"{at}/books")


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a b\nc d e\n\nf"), (2, None)], "id int, t string").createOrReplaceTempView("weft_texts")
    got = spark.sql("SELECT id, s.segment, s.text, s.n_words FROM weft_texts, LATERAL segments(t, 3) s ORDER BY segment").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a b", 2), (1, 1, "c d e", 3), (1, 2, "f", 1)]
    assert [r["gram"] for r in spark.sql("SELECT g.gram FROM weft_texts, LATERAL grams(t, 5) g ORDER BY pos").collect()] == ["a b c d e", "b c d e f"]


def test_accounts(spark):
    z = [None, -1.5, 0.0, 2.33]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(accounts.one_tailed(F.col("z"))).collect()]
    assert got == [None if x is None else 0.5 * math.erfc(x / math.sqrt(2)) for x in z]
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    with pytest.raises(ValueError):
        accounts.zipped(one, one.limit(1).select("id", F.lit("g").alias("g")), "id")
    lengths = spark.createDataFrame([(v, Counter([1, 1, 5, 9])[v]) for v in (1, 5, 9)], "v int, n long")
    assert accounts.median_of(lengths, "v").first()[0] == 5
    with pytest.raises(ValueError):
        batches.random_windows(spark, 100, 1)
    first = batches.random_windows(spark, 5000, 4).collect()
    assert [tuple(r) for r in first][64:] == [tuple(r) for r in batches.random_windows(spark, 5000, 2, skip=2).collect()]


def test_exact_jaccard_by_brute_force(spark):
    docs = corpus(8, 30)
    df = spark.createDataFrame(docs, "id long, t string").select("id", text.canonical_form(F.col("t")).alias("c"))
    got = {(r["id"], r["other"]): r["jaccard"] for r in overlap.jaccard_pairs(df.select("id", overlap.shingles(F.col("c")).alias("s")), "id", "s", 0.4).collect()}
    sets = {i: {c[k : k + 5] for k in range(max(1, len(c) - 4))} for i, t in docs if (c := " ".join(t.split()).lower())}
    want = {(a, b): x for a in sets for b in sets if a < b and (x := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.4}
    assert got == pytest.approx(want) and want


def test_paged_source(spark, tmp_path):
    from weftcorpus.sources.paged import paged

    pages = {"": (["a", "b"], "x"), "x": (["c"], "y"), "y": ([], "z"), "z": (["d"], None)}
    spark.dataSource.register(paged("weft_listing", lambda cursor: pages[cursor], per_batch=3))
    want = [("", 0, "a"), ("", 1, "b"), ("x", 0, "c"), ("z", 0, "d")]
    assert sorted(map(tuple, spark.read.format("weft_listing").load().collect())) == want
    loop = {"": (["a"], "x"), "x": (["b"], "")}
    spark.dataSource.register(paged("weft_loop", lambda cursor: loop[cursor]))
    assert spark.read.format("weft_loop").load().count() == 2
    at = str(tmp_path)
    query = spark.readStream.format("weft_listing").load().writeStream.format("parquet").option("path", f"{at}/t").option("checkpointLocation", f"{at}/c").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{at}/t").select("cursor", "pos", "item").collect())) == want


def test_sweeps_are_the_vocabularies_of_each_size():
    rng = random.Random(9)
    table = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 7))): rng.randrange(2, 40) for _ in range(60)}.items(), key=lambda x: (-x[1], x[0]))
    found = bpe.sweep(table, [100, 270, 280, 300, 9000])
    assert set(found) == {270, 280, 300} and all(found[n] == bpe.learned(table, n) and len(found[n]) == n for n in found)
    with pytest.raises(ValueError):
        bpe.sweep(table, [100])


def test_unlike_rows_that_share_a_band_are_no_candidates(spark):
    rng = random.Random(3)
    sigs = [[rng.randrange(1 << 30) for _ in range(128)] for _ in range(300)]
    for i, s in enumerate(sigs):
        s[:8] = [7] * 8
        if i % 10 == 9:
            sigs[i] = [x if k % 5 or k > 110 else x + 1 for k, x in enumerate(sigs[i - 1])]
    sigs += [[1, 2, 3, 4], [1, 2, 3, 4]]
    signed = spark.createDataFrame(list(enumerate(sigs)), "id long, signature array<int>")
    left, right = signed.where("id % 2 = 0"), signed.where("id % 2 = 1")
    want = {(a, b): likeness(sigs[a], sigs[b]) for a in range(0, 302, 2) for b in range(1, 302, 2) if len(sigs[a]) == len(sigs[b]) and likeness(sigs[a], sigs[b]) * len(sigs[a]) / 128 >= 0.8}
    got = {(r["id"], r["other"]): r["score"] for r in near.matches(left, right, 0.8, 32, 4).collect() if r["id"] < 300}
    assert got == {k: v for k, v in want.items() if k[0] < 300} and len(got) >= 30
    one, two = (near.keys(x, 0.8, 32, 4) for x in (left, right))
    pairs = one.join(two.withColumnRenamed("id", "other"), ["band", "part"]).select("id", "other").distinct().where("id < 300").count()
    assert pairs <= 2 * len(got) < 150 * 150 / 2


def test_signatures_and_hashes_of_one_pass(spark):
    docs = [(1, "Some  TEXT 12 and\x1c 345\n"), (2, "ÀÉ  ßtraße 77\xa0x"), (3, None), (4, "  "), (5, "\x0bİstanbul ΣΑΣ 9")]
    df = spark.createDataFrame(docs, "id long, t string")
    for r in df.select("id", near.hashed_minhash(F.col("t")).alias("x"), exact_hash(F.coalesce("t", F.lit(""))).alias("h"), canonical_form(F.coalesce("t", F.lit(""))).alias("c")).collect():
        assert r["x"]["hash"] == r["h"] and r["x"]["signature"] == near.signature(r["c"], *near.coefficients()).tolist()


def test_counts_of_classes_are_those_of_java(spark):
    kinds = [text.NOT_WS, text.DEVANAGARI, "[A-Za-z]", text.KANNADA, "[0-9०-९]"]
    texts = ["", " a B9\t\x1c\x1f z", "नमस्ते १२ ॥ abc\xa0d", "ಕನ್ನಡ Kannada ५5", "𝒳 é ß Z\x85", None, "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in df.select("t", text.counts_of(F.col("t"), *kinds).alias("got"), F.array(*[F.regexp_count("t", F.lit(k)) for k in kinds]).alias("want"), text.count_of(F.col("t"), kinds[0]).alias("one")).collect():
        assert r["got"] == (None if r["t"] is None else r["want"]) and r["one"] == r["want"][0]


def test_batches_of_several_files(spark):
    df = spark.range(40).select(F.col("id"), F.col("id").cast("string").alias("t"))
    at, seen = jobs.in_files(df, "id", [3, 20], "several", files=4), []
    assert len(jobs.in_file_list(spark, at)) == 12
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(at)
    jobs.drain(stream, at, lambda rows, batch: seen.append(sorted(r["id"] for r in rows.collect())), f"{at}-progress")
    assert seen == [list(range(3)), list(range(3, 20)), list(range(20, 40))]


def test_joins_learned_in_blocks_are_those_of_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choice("aaab▁éñ漢e") for _ in range(rng.randrange(1, 24))): rng.randrange(1, 30) for _ in range(900)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    table = bpe.collected(counts)
    monkeypatch.setattr(bpe, "ROUNDS", 3)
    monkeypatch.setattr(bpe, "LOCAL_WORDS", 100)
    for size, share in ((300, 1.0), (340, 0.97)):
        assert bpe.learned_from(counts, size, share) == bpe.learned(table, size, share)
    assert bpe.sweep_from(counts, [262, 280, 310], 1.0) == bpe.sweep(table, [262, 280, 310], 1.0)
