"""Measures of a graph from its linked nodes and the number of all, and counts of terms, against those over all rows."""

import random

from pyspark.sql import functions as F

from termforest.operators import evaluate as V
from termforest.operators import graph as G
from termforest.operators import terms as T


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def graphs(spark):
    dice = random.Random(5)
    nodes = [(g, f"n{i:02d}", dice.choice(["solar plant", "plant", "wind"]), dice.choice(["en", "ru"]), dice.randrange(4)) for g in "abc" for i in range(30)]
    edges = [(g, f"n{dice.randrange(12):02d}", f"n{dice.randrange(12):02d}", dice.random()) for g in "ab" for _ in range(9)] + [("a", "n01", "n01", 0.1), ("b", "n02", "none", 0.2)]
    n = V.candidate_nodes(spark.createDataFrame(nodes, "grp string, node string, canonical string, lang string, df int"))
    return G.edges_of(spark.createDataFrame(edges, "grp string, parent string, child string, score double"), "grp", "parent", "child", "score"), n


def test_measures_from_linked_nodes_and_totals(spark):
    e, n = graphs(spark)
    inner = e.filter("child <> 'none'")
    linked = G.nodes_of(e).join(n, ["grp", "node"])
    totals = n.groupBy("grp").agg(F.count("*").alias("n_rows"), F.count("*").alias("n_nodes"), F.count_if("candidate").alias("n_candidates"))
    assert rows(V.fragmentation(G.components(inner, n), e, n)) == rows(V.fragmentation(G.parts_of(inner), e, linked, totals=totals))
    assert rows(V.coverage(n, e)) == rows(V.coverage(linked, e, totals))
    alone = n.join(linked.select("grp", "node"), ["grp", "node"], "left_anti").groupBy("grp", "lang").agg(F.count("*").alias("n"))
    assert rows(V.structure(n, e, G.depths(e))) == rows(V.structure(linked, e, G.depths(e), alone))


def test_parts_of_small_and_large_graphs(spark):
    e, _ = graphs(spark)
    assert rows(G.components(e)) == rows(G.parts_of(e)) == rows(G.parts_of(e, small=9)) == rows(G.parts_of(e, small=0))


def test_phrase_frequencies_count_documents_once(spark):
    chunks = spark.createDataFrame([(str(i), d, k, t) for i, (d, k, t) in enumerate([("x", "p", "solar plant"), ("x", "p", "a solar plant, solar"), ("y", "p", "low-carbon solar"), ("z", "q", "solar plant")])], "chunk_id string, document_id string, k string, text string")
    terms = spark.createDataFrame([("p", "solar"), ("p", "solar plant"), ("p", "low-carbon"), ("q", "solar"), ("q", "wind")], "k string, term string")
    assert rows(T.phrase_frequencies(chunks, terms, ("k",)).select("k", "term", "tf", "df")) == sorted([(1, "p", "low-carbon", 1), (2, "p", "solar", 4), (1, "p", "solar plant", 2), (1, "q", "solar", 1)], key=str)


def test_sections_of_a_report_are_worked_out_one_by_one(spark):
    e, n = graphs(spark)
    joined = e.join(n.withColumnRenamed("node", "parent"), ["grp", "parent"]).select("grp", "parent", "lang")
    report = V.assemble({"one": joined, "two": joined.groupBy("grp", "lang").agg(F.count("*").alias("n"))}, n)
    assert report._jdf.queryExecution().executedPlan().toString().count("Join") == 2
    assert {r["grp"]: '"two":[]' in r["report"] for r in report.collect()} == {"a": False, "b": False, "c": True}
