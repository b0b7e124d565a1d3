"""Golden vectors of texts, languages, segments."""

import unicodedata

from pyspark.sql import functions as F

from weftcorpus.functions import language, text
from weftcorpus.operators import gates, segment


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_unicode_white_space_is_that_of_python(spark):
    t = "a b c　d\x1ce\u0085f \t g"
    assert one(spark, t, text.words) == t.split()
    assert one(spark, "", text.words) == one(spark, None, text.words) == one(spark, " \n", text.words) == []


def test_nfc_makes_both_forms_equal_and_joiners_survive(spark):
    nukta = "क़"
    assert one(spark, unicodedata.normalize("NFD", nukta), text.normalize) == one(spark, nukta, text.normalize)
    assert one(spark, "क्‌ष x​y", text.normalize) == "क्‌ष xy"


def test_white_space_and_paragraphs(spark):
    assert one(spark, "a   b\n\n\n\nc", text.normalize) == "a b\n\nc"
    assert one(spark, "a   b\n\n\n\nc", lambda c: text.normalize(c, keep_paragraphs=False)) == "a b c"


def test_a_carriage_return_vanishes_and_a_danda_eats_line_ends(spark):
    assert one(spark, "a\rb", text.normalize) == "ab"
    assert one(spark, "राम ।\nगीता", text.normalize) == "राम। गीता"


def test_normalisation_is_idempotent(spark):
    for t in ("  राम   आला ।गीता\n\n\n\nआली॥ x ", "a­b ⁠ c", ""):
        n = one(spark, t, text.normalize)
        assert one(spark, n, text.normalize) == n


def test_canonical_form_ignores_numbers_and_case(spark):
    assert one(spark, "On 12 May  2024 X", text.exact_hash) == one(spark, "on 3 may 1999 x", text.exact_hash)
    assert one(spark, "a", text.content_hash) != one(spark, "A", text.content_hash)


def test_lines_break_where_python_breaks_them(spark):
    for t in ("a\nb", "a\r\nb\n", "a\x0bb\x1cc d", "", "x"):
        assert one(spark, t, text.lines) == t.splitlines()


def test_articles(spark):
    html = "<p>short</p><script>var x = '</p>';</script><p>" + "one two three four five six seven " * 2 + "</p>"
    assert one(spark, html, lambda c: text.article_text(c, "[A-Za-z]")) == ("one two three four five six seven " * 2).strip()
    assert one(spark, None, text.article_text) == ""


def test_languages(spark):
    mr = one(spark, "राम आहे आणि गीता होती पण मी आणि तू नाही", language.two_way)
    assert (mr["label"], mr["confident"]) == ("mr", True)
    assert one(spark, "आसा आनी ना पूण हांव", language.two_way)["label"] == "kok"
    assert one(spark, "आहे", language.two_way)["label"] == "undecided"
    assert len(set(language.MARKERS["mr"])) == 36 and len(set(language.MARKERS["kok"])) == 37
    assert not set(language.MARKERS["mr"]) & set(language.MARKERS["kok"])


def test_script_profile(spark):
    p = one(spark, "राम आला", language.script_profile)
    assert (p["script"], p["devanagari_ratio"]) == ("Devanagari", 1.0)
    assert one(spark, "", language.script_profile)["script"] == "empty"
    assert one(spark, "abc राम", language.script_profile)["script"] == "Mixed"


def test_gates_keep_their_order(spark):
    g = gates.GATES["news_mr"]
    rows = spark.createDataFrame([(10, 0.1, "kok", 1.0), (200, 0.1, "kok", 1.0), (200, 0.9, "kok", -1.0), (200, 0.9, "undecided", 0.0), (200, 0.9, "mr", 0.2), (200, 0.9, "mr", 0.9)], "n int, r double, l string, s double")
    got = [r[0] for r in rows.select(gates.reason(g, F.col("n"), F.col("r"), F.col("l"), F.col("s"))).collect()]
    assert got == ["too_short", "not_enough_devanagari", "langid_kok_rejected", "langid_undecided", "langid_low_confidence", None]


def test_segments_close_before_and_packs_after(spark):
    paragraphs = ["a " * 700, "b " * 600, "c " * 1500, "d"]
    got = spark.createDataFrame([(paragraphs,)], "p array<string>").select(segment.segments(F.col("p")).alias("s")).first()["s"]
    assert [len(s.split()) for s in got] == [700, 600, 1500, 1]
    units = spark.createDataFrame([("s", i, "w " * n) for i, n in enumerate((100, 150, 60, 10))], "g string, o int, t string")
    packs = sorted((r["pack"], r["n_words"], r["units"]) for r in segment.packed(units, "g", "o", "t").collect())
    assert packs == [(0, 310, 3), (1, 10, 1)]
    assert segment.packed(units.limit(0), "g", "o", "t").count() == 0


def test_reassembly(spark):
    rows = spark.createDataFrame([("f", 0, "x"), ("f", 1, "--- SOURCE: A"), ("f", 2, "--- SOURCE: B"), ("f", 3, "y"), ("f", 4, " "), ("f", 5, "z")], "f string, p int, t string")
    got = sorted((r["title"], r["text"]) for r in segment.reassembled(rows, "f", "p", "t").collect())
    assert got == [("B", "y\nz"), ("unknown", "x")]


def test_titles(spark):
    assert one(spark, "My Book, Vol. 3 (2nd Edition)", text.norm_title) == "my book nd"
