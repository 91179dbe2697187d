import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import metrics, text
from lexiforge.functions.similarity import combined, name_similarity, passes, sequence_ratio, variants
from lexiforge.operators.tokens import lemmas


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_words(spark):
    assert one(spark, text.words(F.col("a")), a="Moses, Moses! -- (went)") == ["Moses", "Moses", "went"]
    assert one(spark, text.words(F.col("a")), a="") == []


def test_char_ngrams(spark):
    assert sorted(one(spark, text.char_ngrams(F.col("a")), a="神说神")) == sorted(["神", "说", "神", "神说", "说神", "神说神"])
    assert one(spark, text.char_ngrams(F.col("a")), a="") == []


def test_chinese_words(spark):
    assert "神说" in one(spark, text.chinese_words(F.col("a")), a="神说，地")
    assert not [w for w in one(spark, text.chinese_words(F.col("a")), a="天在地，12") if "在" in w or "，" in w or w.isdigit()]


def test_punctuation(spark):
    assert one(spark, text.chinese_punctuation(F.col("a")), a='He said, "go."') == "Hesaid，「go。」"
    assert one(spark, text.chinese_punctuation(F.col("a")), a='a"b"c"d') == "a「b」c「d"


def test_references(spark):
    assert text.parse_range("3") == (3, 3)
    assert text.parse_range("1-5") == (1, 5)
    assert tuple(one(spark, text.parse_reference(F.col("a")), a="1_2_3")) == (1, 2, 3)


def test_names():
    for name, sound, want in [("Noah", "Nuo2 ya4", 0.661818), ("Seth", "Sai1 te4", 0.527273), ("Abraham", "Ya4 bo2 la1 han3", 0.63), ("Moses", "Mo2 xi1", 0.467273)]:
        assert name_similarity(name, sound, "English") == pytest.approx(want, abs=1e-6)
    assert variants("seth", "English") == ["seth", "set", "syith", "syit"]
    assert variants("abraham", "English") == ["abraham", "yabryahyam", "abrahan", "yabryahyan", "aboaham"]
    assert name_similarity("a", "ya4", "English") == 0


def test_similarity(spark):
    rows = [("塞特", "赛特", "Sai1 te4", "Sai4 te4", 0.75, True), ("亚伯", "亚当", "Ya4 bo2", "Ya4 dang1", 0.6, False), ("亚伯拉", "亚伯", "Ya4 bo2 la1", "Ya4 bo2", 0.477778, False)]
    df = spark.createDataFrame(rows, "t string, d string, ts string, ds string, want double, ok boolean").withColumn("s", combined(F.col("t"), F.col("d"), sequence_ratio("ts", "ds")))
    for r in df.withColumn("p", passes(F.col("t"), F.col("s"))).collect():
        assert r["s"] == pytest.approx(r["want"], abs=1e-6)
        assert r["p"] == r["ok"]
    assert one(spark, sequence_ratio("a", "b"), a="tide", b="diet") == 0.25
    assert one(spark, sequence_ratio("a", "b"), a="diet", b="tide") == 0.5


def test_subsequence_against_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics.common_subsequence(a, b) == t[-1][-1]


def test_bleu(spark):
    rows = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split()), (2, ["x"], ["y"]), (3, "a b".split(), "a b c d".split()), (4, [], ["a"])], "k int, h array<string>, r array<string>")
    got = {r["k"]: r["bleu"] for r in metrics.bleu(rows, ["k"], "h", "r").collect()}
    assert got[1] == pytest.approx(1.0)
    assert got[2] == 0 and got[4] == 0
    assert got[3] == pytest.approx(2.718281828 ** (1 - 4 / 2) * (1 * 1 * 0.1 * 0.1) ** 0.25)


def test_meteor():
    assert metrics.exact_meteor(["a", "b"], ["a", "b"]) == pytest.approx(1 - 0.5 / 8)
    assert metrics.exact_meteor(["a"], ["b"]) == 0


def test_codes(spark):
    assert one(spark, text.mbart_code(F.col("a")), a="Klingon") == "en_XX"
    assert one(spark, text.stanza_code(F.col("a")), a="Hebrew") == "hbo"


def test_lower_case_is_that_of_sql(spark):
    """Java's depends on what stands beside a character; SQL's doesn't."""
    import duckdb

    for word in ("ΣΣ", "ΛΟΓΟΣ ΑΣ", "SOΣ.", "λόγος", "İş", "ÉÑß"):
        assert one(spark, text.lowered("a"), a=word) == duckdb.execute("SELECT lower(?)", [word]).fetchone()[0]


def test_lemmas_of_capitals_end_like_other_words(spark):
    found = spark.createDataFrame([("ΣΣ",), ("ΑΣΣ",)], "term string")
    got = lemmas(found, spark.createDataFrame([("ΣΣ", "ΣΣ", "ADJ")], "surface string, lemma string, upos string"))
    assert sorted(r["term"] for r in got.collect()) == ["ασσ", "σσ"]
