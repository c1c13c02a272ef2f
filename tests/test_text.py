"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("left,right", [("汤姆·索亚", "汤姆索亚"), ("Tom Sawyer", "TOM  SAWYER"), ("café", "CAFE"), ("Straße", "strasse"), ("A–B", "a-b")])
def test_keys_agree(spark, left, right):
    assert one(spark, T.entity_key, left) == one(spark, T.entity_key, right)


def test_technical_tokens(spark):
    tokens = one(spark, T.search_tokens, "API timeout v1.2.0 C++ C# .NET C:\\tmp\\foo_bar.py")
    for token in ("api", "timeout", "v1.2.0", "c++", "c#", ".net", "c:\\tmp\\foo_bar.py"):
        assert token in tokens


@pytest.mark.parametrize("text,language", [("汤姆是谁", "zh"), ("東京タワーはどこですか", "ja"), ("서울 타워", "ko"), ("Кто такой Том", "ru"), ("من هو توم", "ar"), ("Who is Tom", "en"), ("", "unknown"), (None, "unknown"), ("12345", "unknown")])
def test_language_by_script(spark, text, language):
    assert one(spark, T.language_by_script, text)["language"] == language


def test_unicode_fold(spark):
    assert one(spark, T.fold_exact_unicode, "ＡＢＣ Ⅳ ﬁn") == "abc iv fin"
    assert one(spark, T.fold_exact_unicode, None) == ""


def test_null_texts(spark):
    for f in (T.fold_exact, T.fold_lexical, T.entity_key, T.compact):
        assert one(spark, f, None) == ""
    assert one(spark, T.search_tokens, None) == []


def test_wrapped_lines(spark):
    assert one(spark, T.normalized, "an exam-\nple of a\nwrapped line.\n\n\n\nNext\tone") == "an example of a wrapped line.\n\nNext one"
    assert one(spark, T.normalized, "第一行\n第二行") == "第一行第二行"


def test_quality_and_use(spark):
    assert one(spark, T.text_quality, "plain words") == 1.0
    assert one(spark, T.text_quality, "!!!!!!!!!!") == 0.0
    assert one(spark, T.text_quality, "") == 0.0
    assert one(spark, T.is_useful, "ab") is False


def test_regions(spark):
    rows = spark.createDataFrame([(0.0,), (0.16,), (0.161,), (0.779,), (0.78,), (1.0,)], "p double").select(T.region_of(F.col("p")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["front", "front", "middle", "middle", "terminal", "terminal"]


def test_signals(spark):
    assert one(spark, T.infer_date, "on 2021-03-04 it") == "2021-03-04"
    assert one(spark, T.infer_version, "release v1.2.3 out") == "v1.2.3"
    assert one(spark, T.infer_author, "Author: Mark Twain\nnext") == "Mark Twain"
    assert one(spark, T.safe_name, "/a/b/..x.txt") == "_x.txt"
