"""Golden cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from termforest.functions import text as X


def value(spark, expr, *texts):
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]


@pytest.mark.parametrize("term, want", [("Machine Learning", "machine learning"), ("a", None), ("12345", None), ("the", None), (None, None), ("", None), ("type of service", None), ("kw", None), ("battery battery", None)])
def test_normalize_term(spark, term, want):
    assert value(spark, X.normalize_term, term) == want


def test_ngrams(spark):
    grams = value(spark, X.extract_ngrams, "the cat sits on the mat")
    assert "cat" in grams and "the" not in grams and "cat sits" in grams
    assert value(spark, X.extract_ngrams, "") == []


@pytest.mark.parametrize("text, want", [("type", None), ("  Commercial   BANK  ", "commercial bank"), (None, None)])
def test_normalize_candidate(spark, text, want):
    assert value(spark, X.normalize_candidate, text) == want


@pytest.mark.parametrize("label, want", [("kw", True), ("commercial bank", False), (None, True), ("", True), ("of", True), ("a b a b", True)])
def test_low_quality(spark, label, want):
    assert value(spark, X.is_low_quality_label, label) is want


def test_enumerations(spark):
    assert value(spark, X.split_enumeration, "bank, insurance or lending") == ["bank", "insurance", "lending"]
    assert value(spark, X.split_phrase, "bank, insurance and lending") == ["bank", "insurance", "lending"]


def test_clean(spark):
    text = "Title: X\nSource: y\nFrom Wikipedia, the free\nBody   line\n\n\n\nNext\x00word\n"
    assert value(spark, X.clean_text, text) == "Body line\n\nNext word"
    assert value(spark, X.clean_text, None) is None


@pytest.mark.parametrize("text, want", [("Бұл жүйе деректерді өңдейді", "kk"), ("Эта система обрабатывает данные", "ru"), ("Plain text", "en"), ("", "en")])
def test_language(spark, text, want):
    assert value(spark, X.detect_language, text) == want
    assert value(spark, X.normalize_lang, "en-US") == "en"


def test_phrases_stand_for_whole_term_search(spark):
    got = value(spark, lambda c: X.phrases(c, 2), "Solar grid, solar  grid; foo_bar baz!")
    assert got.count("solar grid") == 1 and "grid solar" not in got and "foo_bar baz" in got and "bar" not in got


def test_similarities(spark):
    assert value(spark, X.token_jaccard, "commercial bank", "retail bank") == pytest.approx(1 / 3)
    assert value(spark, X.token_jaccard, "", "retail bank") == 0.0
    assert value(spark, X.containment, "bank", "Retail Bank") == 1.0
    assert value(spark, X.anchor, "One two three four five") == "one two three four"
