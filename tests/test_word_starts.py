"""Phrases begun at the first words of terms, and reviews of labelled candidates only, against those over all rows."""

import random

from pyspark.sql import functions as F

from termforest.operators import terms as T
from termforest.plans import graph_queries as Q

WORDS = ["solar", "grid", "Plant", "été", "x1", "foo_bar", "low", "carbon", "zz"]


def test_phrases_begin_with_the_first_word_of_a_term(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice(WORDS) + dice.choice([" ", " ", " ", "  ", ", ", "\n", " - ", "-", "\t"]) for _ in range(dice.randrange(25))) for _ in range(300)]
    chunks = spark.createDataFrame([(str(i), str(i % 90), str(i % 2), t) for i, t in enumerate([*texts, None, "", " solar grid "])], "chunk_id string, document_id string, k string, text string")
    terms = [(str(i % 2), " ".join(dice.choice(WORDS[:8]).lower() for _ in range(1 + i % 4))) for i in range(120)]
    terms = spark.createDataFrame([*terms, ("0", "low-carbon"), ("1", None), ("0", ""), ("0", "solar ")], "k string, term string")
    hits = T.phrase_hits(chunks, terms, ("k",)).groupBy("document_id", "k", "term").agg(F.sum("hits").alias("n")).groupBy("k", "term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    got = T.phrase_frequencies(chunks, terms, ("k",))
    assert sorted(map(tuple, got.select("k", "term", "tf", "df").collect())) == sorted(map(tuple, hits.collect()))
    # a function with a lambda is not compiled, and was most of the time of the queries that look up labels
    plain = T.phrase_frequencies(chunks, terms.filter("term = 'solar grid'"))
    assert "lambdafunction" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_reviews_of_labelled_candidates_are_those_of_all(spark, sf):
    every = Q._reviews(spark, sf).filter("reviewed > 0").select("grp", "reviewed", "approved", "rejected", "approval_rate")
    some = Q._reviewed(spark, sf)
    assert sorted(map(tuple, some.filter("reviewed > 0").select(every.columns).collect())) == sorted(map(tuple, every.collect())) != []
