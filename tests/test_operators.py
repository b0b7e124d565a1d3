"""Duplicates, splits, provenance, tokens, metrics, health, sources against small brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from weftcorpus.operators import dedup, health, metrics, near, provenance, reasoning, tokens
from weftcorpus.plans import dedup as dedup_plans
from weftcorpus.sources import io


def test_greedy_near_removal_equals_the_sequential_one(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(120)) for _ in range(6)]
    docs = []
    for i in range(40):
        w = base[i % 6].split()
        for _ in range(rng.choice((0, 1, 2, 40))):
            w[rng.randrange(len(w))] = "changed" + "x" * rng.randrange(9)
        docs.append((i, " ".join(w)))
    signed = spark.createDataFrame(docs, "id long, t string").select("id", F.col("id").alias("ord"), near.minhash(F.col("t")).alias("signature"))
    sig = {r["id"]: r["signature"] for r in signed.collect()}
    kept, dropped = [], set()
    for i, _ in docs:
        share = [k for k in kept if any(sig[i][b * 8 : b * 8 + 8] == sig[k][b * 8 : b * 8 + 8] for b in range(16))]
        if any(sum(x == y for x, y in zip(sig[i], sig[k])) / 128 >= 0.85 for k in share):
            dropped.add(i)
        else:
            kept.append(i)
    got = near.greedy(signed).collect()
    assert {r["id"] for r in got if r["keeper"] is not None} == dropped and len(got) == 40 and dropped


def test_one_band_of_unlike_rows_is_decided_whole(spark):
    rng = random.Random(8)
    base = [[7] * 8 + [rng.randrange(1 << 30) for _ in range(120)] for _ in range(1200)]
    for i in range(0, 1200, 7):
        base[i][8:] = base[i // 2][8:118] + base[i][118:]
    rows = spark.createDataFrame([((i % 3 == 0, f"s{i % 5}", i), i, s) for i, s in enumerate(base)], "ord struct<a boolean, b string, c long>, id long, signature array<int>")
    kept, want = [], {}
    for r in sorted(rows.collect(), key=lambda r: tuple(r["ord"])):
        like = [k for k, s in kept if sum(x == y for x, y in zip(s, r["signature"])) / 128 >= 0.85]
        want[r["id"]] = like[0] if like else None
        kept += [] if like else [(r["id"], r["signature"])]
    assert 1000 < len(kept) < 1200  # more than a thousand rounds of one leader
    for found in (near.greedy(rows), near.greedy(rows, block=500)):
        got = {r["id"]: r["keeper"] for r in found.collect()}
        assert got.keys() == want.keys() and {i for i in got if got[i] is None} == {i for i, _ in kept}
        for i, k in got.items():
            assert k is None or want[k] is None and sum(x == y for x, y in zip(base[i], base[k])) / 128 >= 0.85


def test_long_texts_keep_their_near_copies(spark):
    rng = random.Random(1)
    long = [chr(97 + rng.randrange(26)) for _ in range(6000)]
    other = long[:3000] + list("inserted here") + long[3000:]
    rows = spark.createDataFrame([("".join(long), "".join(other))], "a string, b string")
    full = rows.select(near.similarity(near.minhash(F.col("a")), near.minhash(F.col("b"))).alias("s")).first()["s"]
    stride = rows.select(near.similarity(near.minhash(F.col("a"), "stride"), near.minhash(F.col("b"), "stride")).alias("s")).first()["s"]
    assert full > 0.9 and stride < full


def test_splits_are_disjoint_and_small_strata_train(spark):
    rows = spark.createDataFrame([(i, "big" if i >= 5 else "small") for i in range(305)], "k long, s string")
    got = dedup.split(rows, ["s"], "k")
    counts = {(r["s"], r["split"]): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert counts == {("small", "train"): 5, ("big", "val"): 3, ("big", "test"): 3, ("big", "train"): 294}
    assert dedup.leaks(got, "k").count() == 0


def test_first_fit_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate((50, 60, 10, 30, 1))], "g string, k long, n long")
    got = {r["k"]: r["kept"] for r in dedup.first_fit(rows, "g", "k", "n", 0.5).collect()}
    order = [r["k"] for r in rows.orderBy(dedup.seeded(F.col("k"))).collect()]
    used, want = 0, {}
    for k in order:
        n = (50, 60, 10, 30, 1)[k]
        want[k] = used + n <= 75
        used += n * want[k]
    assert got == want


def test_first_fit_keeps_groups_whole_where_shuffles_are_dealt_anew(spark):
    rows = [(None if i % 50 == 0 else "a" if i % 10 < 8 else f"g{i % 7}", i, i * 7919 % 101) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(8)
    groups, want = {}, {}
    for g, k, n in rows:
        groups.setdefault(g, []).append((hashlib.sha256(f"{dedup.SPLIT_SEED}:{k}".encode()).hexdigest(), k, n))
    for g, found in groups.items():
        budget, used = sum(n for *_, n in found) // 2, 0
        for _, k, n in sorted(found)[: 1 if g is None else None]:
            want[g, k] = used + n <= budget
            used += n if want[g, k] else 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dedup.first_fit(df, "g", "k", "n", 0.5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["g"], r["k"]): r["kept"] for r in got} == want and len(got) == len(want)


def test_accounting_parts_sum_to_the_whole(spark):
    rows = spark.createDataFrame([("src0", 10, 50), ("src1", 5, 20), ("src9", 7, 30), ("src18", 3, 9), (None, 2, 4)], "source string, n_words long, n_chars long")
    got = provenance.accounting(provenance.with_provenance(rows)).collect()
    total = next(r for r in got if r["scope"] == "total")
    assert total["words"] == sum(r["words"] for r in got if r["scope"] == "source") == 27
    assert total["manual_words"] + total["downloaded_words"] + total["synthetic_words"] == 27


def test_metrics(spark):
    rows = spark.createDataFrame([(1, list("abcdefgh"), list("abcdefgh"))], "k int, h array<string>, r array<string>")
    assert abs(metrics.bleu(rows, "h", "r").first()["bleu"] - 100) < 1e-9
    assert metrics.rouge_l(rows, "h", "r").first()["rouge_l"] == 100
    apart = spark.createDataFrame([(1, list("abcd"), list("wxyz"))], "k int, h array<string>, r array<string>")
    assert metrics.bleu(apart, "h", "r").first()["bleu"] == 0
    lcs = spark.createDataFrame([(list("abcde"), list("ace")), ([], ["a"])], "a array<string>, b array<string>").select(metrics.lcs(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in lcs] == [3, 0]
    loop = metrics.diversity(spark.createDataFrame([(["a", "b"] * 50,)], "t array<string>"), "t").first()
    assert loop["distinct_1"] < 0.05 and loop["repetition_4"] > 0.9
    text = spark.createDataFrame([(1, "ab cd ef", "ab cd ef")], "k int, h string, r string")
    assert abs(metrics.chrf(text, "h", "r").first()["chrf"] - 100) < 1e-9


def test_rouge_l_reads_whole_texts(spark, tmp_path):
    from weftcorpus.plans import registry

    rng = random.Random(4)
    texts = [None, "", "a b c d e", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (6, 12, 39, 40, 41, 200, 700))]
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    common = total = 0
    for w in ((t or "").split() for t in texts):
        h, r = w[: max(len(w) - 5, 0)], w[5:]
        total += len(h)
        row = [0] * (len(r) + 1)
        for x in h:
            above, row = row, [0]
            for j, y in enumerate(r):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        common += row[-1]
    got = registry.queries()["rouge_l"](spark, str(tmp_path)).first()
    assert all(abs(got[c] - 100 * common / total) < 1e-9 for c in ("rouge_l", "precision", "recall"))


def test_tokens(spark):
    assert tokens.parameters(512, 7, 2048, 2500, 512, tied=False)["total"] == 24_892_356
    rows = spark.createDataFrame([(i, [5] * (i % 4)) for i in range(200)], "k long, ids array<int>")
    got = tokens.packed(rows, "k", "ids", 2).orderBy("k").collect()
    at = 0
    for r in got:
        assert r["offset"] == at
        at += len(r["ids"])
    assert tokens.verify(tokens.packed(rows, "k", "ids", 2), 10, 2).first()["valid"]
    ids = {p: i for i, p in enumerate([*tokens.SPECIAL, *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "▁a", "ab", "▁ab"])}
    scores = {"▁a": -2.0, "ab": -1.0, "▁ab": -3.0}
    got = spark.createDataFrame([(["ab", "é"],)], "w array<string>").select(tokens.encode(F.col("w"), ids, scores)).first()[0]
    assert got == [ids["▁ab"], ids["▁"], ids["<0xC3>"], ids["<0xA9>"]]


def test_reasoning(spark):
    train, test = reasoning.split_names("marathi")
    assert len(test) == 6 and len(reasoning.split_names("konkani")[1]) == 8 and not set(train) & set(test)
    rows = reasoning.items(spark, "marathi", 60, train, ["p_value", "p_more"], 3).collect()
    assert len({r["prompt"] for r in rows}) == len(rows) == 60
    for r in rows:
        if r["values"] and r["family"] != "equality":
            best = max if r["extreme"] == "max" else min
            assert r["entities"][r["values"].index(best(r["values"]))] == r["answer"]
    assert abs(reasoning.p_value(1.638) - 0.0507) < 1e-4
    parsed = spark.createDataFrame([("x उत्तर: a b उत्तर: राम आहे",), ("none",), ("उत्तर:",)], "g string").select(reasoning.parsed(F.col("g"), F.lit("उत्तर:"))).collect()
    assert [r[0] for r in parsed] == ["राम", "", ""]


def test_health(spark):
    row = spark.createDataFrame([(False, True, 10.0, 5, 100, 1, 0, None, 0, 50.0)], "f boolean, s boolean, age double, d int, c int, e int, r int, dup double, head int, disk double")
    def state(**change):
        cols = {c: F.col(c) for c in row.columns} | {k: F.lit(v) for k, v in change.items()}
        return row.select(health.status(*cols.values())).first()[0]
    assert [state(), state(f=True), state(s=False), state(age=1000.0), state(d=0), state(e=20), state(disk=1.0), state(r=6), state(dup=0.6), state(head=-1)] == ["HEALTHY", "FINISHED", "NOT STARTED", "STALLED", "STALLED", "STALLED", "STALLED", "WARNING", "WARNING", "WARNING"]


def test_sources(spark, tmp_path):
    at = tmp_path / "lang/data/manual/books"
    at.mkdir(parents=True)
    (at / "shard_00000.txt").write_text("one\n\n two \n")
    got = io.first_documents(io.shards(spark, str(tmp_path)), 5).collect()
    assert [(r["text"], r["source"], r["is_manual"]) for r in got] == [("one", "books", True), ("two", "books", True)]
    (tmp_path / "m.jsonl").write_text('{"doc_id": "a", "words": 3}\n\nbroken{\n{"doc_id": "b", "source_name": "s"}\n')
    rows = {r["doc_id"]: r["source_name"] for r in io.manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert rows == {"a": "m", "b": "s"}
    (tmp_path / "log.csv").write_text("step,tokens,train_loss,val_loss,val_ppl,lr,grad_norm,seconds,tokens_per_sec\n1,10,2.5,,,0.1,1,1,10\n2,20,,2.4,11,,,2,\n")
    train, val = io.training_log(spark, str(tmp_path / "log.csv"))
    assert (train.count(), val.count()) == (1, 1)
    (tmp_path / "v.vocab").write_text("<unk>\t0\na\t-1\n")
    assert [(r["id"], r["piece"], r["score"]) for r in io.vocabulary(spark, str(tmp_path / "v.vocab")).orderBy("id").collect()] == [(0, "<unk>", 0.0), (1, "a", -1.0)]
    docs = spark.createDataFrame([("a b",), ("c\nd",)], "text string")
    io.write_shards(docs, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a b", "c d"]
    made = io.records(docs, F.col("text"), F.col("text"), F.lit("s"), F.lit("manual_ocr"), "2024-01-01T00:00:00+00:00").first()
    assert made["words"] == 2 and made["is_manual"] and made["tokens"] is None
    assert io.markdown(docs.limit(1)).startswith("| text |")


def test_neighbours_are_found_among_narrow_rows(spark, tmp_path):
    rows = [(i, "abcd"[i % 4], f"w{i // 8} w{i % 3} x" if i % 7 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = dedup_plans.word_jaccard_of_neighbours(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(row#" in plan and "lag(s#" not in plan
    sets = {i: set((t or "").split()) for i, _, t in rows}
    want = {i: (i - 4, round(len(sets[i] & sets[i - 4]) / len(sets[i] | sets[i - 4]), 6) if sets[i] and sets[i - 4] else 0.0) for i in range(4, 60)}
    assert {r["doc_id"]: (r["other"], r["jaccard"]) for r in found.collect()} == want
