"""Golden cases of the term operators."""

import pytest

from termforest.operators import terms as T


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", f"d{i}", 0, "en", t) for i, t in enumerate(texts)], "chunk_id string, document_id string, chunk_index int, lang string, text string")


def test_frequencies(spark):
    c = chunks(spark, "Battery storage helps the grid.", "The battery storage of a grid!", None, "")
    assert {r["token"]: r["n"] for r in T.token_frequencies(c).collect()}["battery"] == 2
    f = {r["term"]: (r["tf"], r["df"]) for r in T.term_frequencies(c, spark.createDataFrame([("battery storage",), ("solar",)], "term string")).collect()}
    assert f == {"battery storage": (2, 2), "solar": (0, 0)}


def test_tfidf_and_textrank_of_nothing(spark):
    c = chunks(spark, "battery storage grid", "battery storage grid")
    assert {r["term"] for r in T.tfidf(c).collect()} == {"battery", "storage", "grid", "battery storage", "storage grid"}
    ranks = {r["term"]: r["score"] for r in T.textrank(c, iterations=6).collect()}
    assert set(ranks) == {"battery", "storage", "grid"}
    assert T.tfidf(c.limit(0)).count() == 0 and T.textrank(c.limit(0), iterations=3).count() == 0


def test_cvalue_prefers_the_longer_term(spark):
    f = spark.createDataFrame([("battery", 2, 1), ("battery storage", 4, 1), ("grid resilience", 3, 1)], "term string, tf int, df int")
    v = {r["term"]: r["cvalue"] for r in T.cvalue(f).collect()}
    assert v["battery storage"] > v["battery"] == 0.0


def test_suppressed_singles(spark):
    s = spark.createDataFrame([("bank", 0.5), ("commercial bank", 0.9), ("retail bank", 0.8)], "term string, score double")
    f = spark.createDataFrame([("bank", 5, 2), ("commercial bank", 3, 3), ("retail bank", 2, 2)], "term string, tf int, df int")
    assert {r["term"] for r in T.suppress_subsumed(s, f).collect()} == {"commercial bank", "retail bank"}


def test_merge(spark):
    a, b = (spark.createDataFrame(x, "term string, score double") for x in ([("x", 4.0), ("y", 2.0)], [("x", 1.0), ("z", 0.5)]))
    assert {r["term"]: r["score"] for r in T.merge_scores(a, b).collect()} == {"x": 1.0, "y": 0.3, "z": 0.2}


def test_dedupe_absorbs_at_the_threshold(spark):
    assert T.indel_ratio("abcd", "abce") == 75.0 and T.indel_ratio("", "") == 100.0 and T.indel_ratio("a", "") == 0.0
    s = spark.createDataFrame([("battery storage", 0.9), ("battery storages", 0.8), ("grid", 0.7)], "term string, score double")
    got = {r["term"]: r["surface_forms"] for r in T.dedupe_terms(s).collect()}
    assert got == {"battery storage": ["battery storage", "battery storages"], "grid": ["grid"]}


def test_occurrences_take_documents_first(spark):
    c = chunks(spark, "Intro here. Battery storage is essential for modern grids! End battery storage.", "One battery storage hit.")
    got = T.occurrences(c, spark.createDataFrame([("battery storage",)], "term string"), 2).orderBy("rank").collect()
    assert [r["document_id"] for r in got] == ["d0", "d1"] and got[0]["snippet"] == "Battery storage is essential for modern grids!"
    assert all(0.35 <= r["confidence"] <= 0.96 for r in got)


def test_pipeline_runs_on_little(spark):
    text = "Battery storage supports the grid. Commercial bank lends to grid operators. "
    out = T.extract_terms(chunks(spark, text, text, text + "Solar"), 50).collect()
    assert "battery storage" in {r["term"] for r in out} and out[0]["quality"] == pytest.approx(out[0]["quality"])


def test_terms_of_any_length_and_sign_are_found(spark):
    long = "one two three four five six seven eight"
    text = f"The State-of-the-Art kit isn't {long}; state-of-the-art again, {long} nine. C3PO (x) isn't it?"
    chunks = spark.createDataFrame([("c", "d", text), ("e", "d", None), ("f", "g", "")], "chunk_id string, document_id string, text string")
    terms = [("state-of-the-art",), ("isn't",), (long,), ("kit",), ("state-of",), ("(x)",), ("--",), ("absent-minded",), (None,), (long + " nine",)]
    got = {r["term"]: r["hits"] for r in T.phrase_hits(chunks, spark.createDataFrame(terms, "term string")).collect()}
    assert got == {"state-of-the-art": 2, "isn't": 2, long: 2, "kit": 1, "state-of": 2, "(x)": 1, long + " nine": 1}
    assert T.phrase_hits(chunks, spark.createDataFrame([], "term string")).count() == 0
