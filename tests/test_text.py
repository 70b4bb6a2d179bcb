import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, ["Giá trị thặng dư!", "don't_stop 2x", None, "—"], tx.tokens) == [["giá", "trị", "thặng", "dư"], ["don", "t", "stop", "2x"], [], []]


def test_size_tokens(spark):
    assert values(spark, ["a_b, c!", "", None], tx.token_count) == [4, 0, 0]
    assert values(spark, ["a_b, c!"], tx.size_tokens) == [["a_b", ",", "c", "!"]]


def test_question_keys(spark):
    assert values(spark, ["Vật chất là gì?", "VAT CHAT LA GI", None], tx.normalized_question) == ["vat chat la gi", "vat chat la gi", ""]


def test_quality(spark):
    assert values(spark, ["x" * 500, "x" * 250, "�" * 10 + "x" * 90, ""], tx.native_quality) == [1.0, 0.5, 0.18, 0.0]
    assert values(spark, ["x" * 500, "x" * 99, "�" * 30 + "x" * 270], tx.needs_ocr) == [False, True, True]
    assert values(spark, ["e" * 600, "é" * 600, "x" * 40, "x" * 60], lambda t: tx.audit_quality(t, "é")) == [0.3, 1.0, 0.1, 0.15]


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(F.round(tx.jaccard(F.col("a"), F.col("b")), 6), F.round(tx.coverage(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [(0.333333, 0.5), (1.0, 0.0), (0.0, 0.0)]


def test_folding_and_ids(spark):
    assert values(spark, ["  Page\t 12 ", None], tx.folded) == ["page #", ""]
    a, b, c = values(spark, ["x", "x", "y"], lambda t: tx.stable_id("page", t, F.lit(3)))
    assert a == b != c and a.startswith("page_") and len(a) == 21


@pytest.mark.parametrize("text,ratio", [("abc", 0.0), ("ééaa", 0.5), (None, 0.0)])
def test_diacritics(spark, text, ratio):
    assert values(spark, [text], tx.diacritic_ratio) == [ratio]
