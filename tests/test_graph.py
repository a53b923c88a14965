"""Hierarchies, graph operators, greedy steps and edge rules."""

import random

import pytest
from pyspark.sql import functions as F

from termforest.operators import edges as E
from termforest.operators import evaluate as V
from termforest.operators import graph as G
from termforest.operators import kernels as K
from termforest.operators import vectors as W
from termforest.operators.hierarchy import descendants, find_cycles, links_of, resolve_hierarchy


def links(spark, pairs):
    df = spark.createDataFrame([("v", p, c) for p, c in pairs], "ver string, p string, c string").withColumn("node", F.lit("clash"))
    return links_of(df, "ver", "p", "c")


def test_hierarchy_of_trees_cycles_and_nulls(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    pairs = [*chain, ("n010", "x"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "below"), ("below", "deep"), ("s", "s"), ("s", "under"), (None, "y"), ("y", None), ("a", "b")]
    h = resolve_hierarchy(links(spark, pairs))
    rows = {r["node"]: r for r in h.nodes.collect()}
    assert rows["n070"]["depth"] == 70 and rows["n070"]["root"] == "n000" and rows["n070"]["path"] == [f"n{i:03d}" for i in range(71)]
    assert rows["x"]["path"][-2:] == ["n010", "x"] and rows["n000"]["depth"] == 0
    assert {n for n, r in rows.items() if r["state"] == "endless"} == {"a", "b", "c", "below", "deep", "s", "under"}
    assert {(r["node"], r["cycle_id"]) for r in h.cycles.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("s", "s")}
    pairs = {(r["ancestor"], r["node"]): r["distance"] for r in descendants(h.nodes).collect()}
    assert pairs["n000", "n070"] == 70 and ("a", "b") not in pairs and len(pairs) == 70 * 71 // 2 + 11


def test_hierarchy_with_several_parents_and_of_nothing(spark):
    cycles = find_cycles(links(spark, [("a", "b"), ("b", "c"), ("z", "b"), ("c", "z"), ("d", "e")]))
    assert {(r["node"], r["cycle_id"]) for r in cycles.collect()} == {("b", "b"), ("c", "b"), ("z", "b")}
    none = resolve_hierarchy(links(spark, [("a", "b")]).limit(0))
    assert none.nodes.count() == 0 and none.cycles.count() == 0


def test_cycles_of_random_functions(spark):
    rnd = random.Random(1)
    up = {i: rnd.randrange(400) for i in range(300)}
    cycles = find_cycles(links(spark, [(f"{p:03d}", f"{c:03d}") for c, p in up.items()]))
    want = set()
    for i in up:
        seen, n = [], i
        while n in up and n not in seen:
            seen.append(n)
            n = up[n]
        if n == i:
            want.add((f"{i:03d}", f"{min(seen):03d}"))
    assert {(r["node"], r["cycle_id"]) for r in cycles.collect()} == want


def test_cycles_of_random_graphs(spark):
    for seed in range(2):
        rnd = random.Random(seed)
        size = (60, 90)[seed]
        pairs = {(rnd.randrange(size), rnd.randrange(size)) for _ in range(int(size * 1.05))} | {(100 + k, 101 + k) for k in range(40)} | {(140, 100), (120, 110), (105, 99), (99, 98), (98, 105)}
        out = {}
        for p, c in pairs:
            out.setdefault(c, set()).add(p)
        reach = {}
        for n in {x for pair in pairs for x in pair}:
            seen, todo = set(), list(out.get(n, ()))
            while todo:
                m = todo.pop()
                if m not in seen:
                    seen.add(m)
                    todo += out.get(m, ())
            reach[n] = seen
        want = {(f"{n:03d}", f"{min(m for m in reach[n] if n in reach[m]):03d}") for n in reach if n in reach[n]}
        got = find_cycles(links(spark, [(f"{p:03d}", f"{c:03d}") for p, c in pairs])).collect()
        assert sorted((r["node"], r["cycle_id"]) for r in got) == sorted(want) and len(want) > 40


def edges(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "grp string, parent string, child string, score double")


def test_components_and_ratio(spark):
    e = edges(spark, [("energy", "battery", 0.5)] + [(f"k{i:02d}", f"k{i + 1:02d}", 0.1) for i in range(40)])
    nodes = spark.createDataFrame([("g", "market"), ("g", None)], "grp string, node string")
    parts = {r["node"]: r["component"] for r in G.components(e, nodes).collect()}
    assert parts["energy"] == parts["battery"] == "battery" and parts["market"] == "market" and parts["k40"] == "k00"
    assert G.largest_component_ratio(G.components(e)).first()["largest"] == 41


def test_merge_collapse_and_limits(spark):
    rows = edges(spark, [("a", "b", 0.7), ("a", "b", 0.9)]).withColumn("seq", F.monotonically_increasing_id()).withColumn("evidence", F.lit("x"))
    merged = G.merge_duplicates(rows).collect()
    assert len(merged) == 1 and merged[0]["score"] == 0.9 and len(merged[0]["evidence"]) == 2
    two = edges(spark, [("a", "b", 0.62), ("b", "a", 0.71), ("c", "d", 0.1)]).withColumn("rank_score", F.col("score"))
    assert {(r["parent"], r["child"]) for r in G.collapse_bidirectional(two).collect()} == {("b", "a"), ("c", "d")}
    chain = edges(spark, [("a", "b", 0.5), ("b", "c", 0.5), ("c", "d", 0.5)])
    assert {r["child"] for r in G.limit_depth(chain, 2).collect()} == {"b", "c"}
    star = edges(spark, [("p", f"c{i}", i / 10) for i in range(8)]).withColumn("rank_score", F.col("score")).withColumn("safe", F.col("score") < 0.15)
    assert {r["child"] for r in G.limit_children(star, 5, protected="safe").collect()} == {"c0", "c1", "c7", "c6", "c5"}


def test_graph_quality(spark):
    e = edges(spark, [("animal", x, 0.9) for x in ("dog", "cat", "fox")])
    nodes = spark.createDataFrame([("g", n) for n in ("animal", "dog", "cat", "fox")], "grp string, node string")
    q = G.graph_quality(e, nodes, spark.createDataFrame([], "grp string, n_noise long")).first()
    assert (q["edge_density"], q["largest_component_ratio"], q["hubness"], q["lexical_noise_rate"]) == (0.75, 1.0, 1.0, 0.0)


NODES = {n: K.Node(n.replace("_", " "), df=3, score=0.5) for n in ("energy_system", "battery_system", "finance_platform", "loan_platform", "solar_energy_system", "lone_energy_system")}


def test_greedy_steps():
    cyc = [K.Edge("a", "b", 0.9), K.Edge("b", "c", 0.8), K.Edge("c", "a", 0.5), K.Edge("d", "d", 1.0)]
    assert [e.key for e in K.remove_cycles(cyc, {})] == [("a", "b"), ("b", "c")]
    assert len(K.spanning_forest([K.Edge("a", "b", 0, 3), K.Edge("b", "c", 0, 2), K.Edge("a", "c", 0, 1)], {})) == 2
    hub = [K.Edge("p q", f"c{i} x", 0.5, i) for i in range(3)] + [K.Edge("r s", "t u", 0.5, 9)]
    trimmed = K.trim_hubs(hub, {}, 2)
    assert len(trimmed) == 4 and sum(e.parent == "p q" for e in trimmed) == 2 and any(e.method == "hubness_rebalance_reattach" for e in trimmed)
    assert K.trim_hubs(hub, {}, 2, frozenset(e.key for e in hub)) == hub
    base = [K.Edge("energy_system", "battery_system", 0.9), K.Edge("finance_platform", "loan_platform", 0.9)]
    fix = K.repair_connectivity(base, NODES, [K.Edge("energy_system", "finance_platform", 0.7, 0.7), K.Edge("energy_system", "battery_system", 0.9)], wanted_parts=1)
    assert [e.key for e in fix] == [("energy_system", "finance_platform")]
    assert {e.child for e in K.link_orphans(base, NODES, 0.5)} == {"solar_energy_system", "lone_energy_system"}
    assert all(e.method == "component_bridge" for e in K.bridge_components(base, NODES, 0.5)) and K.bridge_components(base, NODES, 0.5)
    pool = [K.Edge("energy_system", "battery_system", 0.9, method="hearst"), K.Edge("battery_system", "energy_system", 0.8), K.Edge("energy_system", "finance_platform", 0.6), K.Edge("finance_platform", "loan_platform", 0.7)]
    assert {e.key for e in K.select_edges(pool, NODES)} == {("energy_system", "battery_system"), ("energy_system", "finance_platform"), ("finance_platform", "loan_platform")}
    turned = K.orient_edges([K.Edge("solar_energy_system", "energy_system", 0.5, method="component_bridge")], NODES)
    assert turned[0].key == ("energy_system", "solar_energy_system") and turned[0].score == 0.56
    assert all(f([], {}) == [] for f in (K.remove_cycles, K.spanning_forest, K.trim_hubs, K.link_orphans, K.bridge_components, K.consolidate_roots, K.orient_edges, K.select_edges))


def test_oversized_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_EDGES", 1)
    e = edges(spark, [("a", "b", 0.5), ("a", "c", 0.5)]).withColumn("rank", F.lit(0.0)).withColumn("method", F.lit("x"))
    with pytest.raises(ValueError, match="at most"):
        K.run(e, spark.createDataFrame([], "grp string, node string, label string, validity double, good boolean, df long, score double"), K.remove_cycles)


def reason(spark, parent, child, df, score, method, sem=0.0, sim=0.0, lex=0.0, low=0.55, recovery=False):
    ev = F.array(F.struct(F.lit(method).alias("method"), F.lit(sim).alias("similarity"), F.lit(sem).alias("semantic_similarity"), F.lit(None).cast("double").alias("cosine_similarity"), F.lit(float("nan")).alias("retrieval_evidence_score"), F.lit(0.0).alias("cooccurrence_support"), F.lit(lex).alias("lexical_similarity")))
    facts = E.label_facts(spark.createDataFrame([(parent, df), (child, df)], "label string, df int").distinct())
    row = facts.filter(F.col("label") == parent).select(F.col("facts").alias("p")).join(facts.filter(F.col("label") == child).select(F.col("facts").alias("c")))
    return row.select(E.rejection_reason(F.col("p"), F.col("c"), F.lit(score), F.lit(method), ev, F.lit(low), recovery).alias("r")).first()["r"]


@pytest.mark.parametrize("args, want", [
    (("also", "battery storage", 9, 0.9, "hearst"), "invalid_parent_label"), (("the for bank", "loan desk", 9, 0.9, "hearst"), None), (("storage", "kw", 9, 0.9, "hearst"), "low_quality_label"),
    (("storage", "battery", 9, 0.9, "hearst"), "single_to_single"), (("large battery storage unit", "solar battery", 9, 0.9, "hearst"), "parent_too_long"), (("battery storage", "solar battery", 9, 0.5, "hearst"), "score_below_threshold"),
    (("battery storage", "solar battery", 9, 0.6, "other", 0.3), "low_semantic_evidence"), (("battery storage", "solar battery", 9, 0.6, "hearst", 0.3, 0.2), None), (("battery storage", "solar battery", 9, 0.7, "component_bridge", 0.3), None),
    (("storage", "battery", 9, 0.75, "component_bridge", 0.7), None),
])
def test_rejections(spark, args, want):
    assert reason(spark, *args) == want


def test_scores(spark):
    one = spark.range(1).select(F.round(E.blend(F.lit(0.6), F.lit(0.8), F.lit(0.9)), 3).alias("b"), E.blend(F.lit(0.6), F.lit(float("nan")), F.lit(None).cast("double")).alias("c"), V.quality_score(*[F.lit(x) for x in (0.9, 0.85, 0.15, 0.1, 1.5, 0.05)]).alias("q")).first()
    assert one["b"] == 0.722 and one["c"] == 0.6 and one["q"] == pytest.approx(8.76, abs=0.01)
    assert E.bridge_budget(5, 10, 0.2, 0.4) == 10
    s = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 0.9)], "method string, score double")
    t = {r["method"]: r["threshold"] for r in E.method_thresholds(s, 0.64, 50).collect()}
    assert t == {"a": 0.64, "b": 0.64}
    c = V.cross_language(spark.createDataFrame([("A", "B", "en"), ("B", "A", "ru"), (None, "B", "en")], "parent_label string, child_label string, lang string")).first()
    assert (c["comparable"], c["consistent"], c["consistency"]) == (1, 0, 0.0)


def test_assignment_of_parents():
    options = [("a", "p", 0.9, 0.5, False), ("a", "q", 0.85, 0.5, False), ("b", "p", 0.8, 0.0, False), ("b", "q", 0.7, 0.0, False), ("c", "p", 0.55, 0.3, False), ("c", "q", 0.1, 0.0, False), ("d", "p", 0.2, 0.9, False), ("w", "p", 0.99, 0.9, True)]
    # a takes p and straight after it q, so b finds no room and falls back to its best
    assert W.assign_parents(options, 0.6, 1) == [("a", "p", 0.9, "embedding_clustering"), ("a", "q", 0.85, "embedding_clustering_secondary_parent"), ("b", "p", 0.8, "embedding_clustering"), ("c", "p", 0.55, "embedding_clustering_relaxed")]
    assert ("c", "p", 0.55, "embedding_clustering_relaxed") in W.assign_parents(options, 0.6, 2) and not any(r[0] in "dw" for r in W.assign_parents(options, 0.6, 2))
    assert W.assign_parents([], 0.6, 1) == []


def test_labels_decide_who_is_a_parent(spark):
    rows = [("1", "battery storage", 9, 0.2), ("2", "solar battery", 4, 0.2), ("3", "thing", 2, 0.9), ("4", "battery", 1, 0.5), ("5", "battery pack unit", 0, 0.1), ("6", "kw", 9, 0.9), ("7", None, None, None)]
    v = spark.createDataFrame([(i, lab, df, s, [1.0, 0.0], "c") for i, lab, df, s in rows], "id string, label string, df int, score double, vector array<double>, cluster string")
    got = {r["id"]: r for r in W.parent_quality(v).collect()}
    share = {w: sum(w in (lab or "").split() for _, lab, _, _ in rows) / 7 for w in ("battery", "storage", "solar", "thing", "kw")}
    assert got["1"]["quality"] == pytest.approx(0.2 + 0.35 + 0.35) and share["battery"] > 0.55 and (share["battery"] + share["storage"]) / 2 < 0.55
    assert got["4"]["quality"] == pytest.approx(0.5 + 0.35 + 0.06 - 0.28 - 0.20) and got["3"]["quality"] <= 0.9 + 0.35 + 0.35 - 0.28 - 0.22
    assert {i for i, r in got.items() if r["fit"]} == {"1", "2"}
    assert {r["id"] for r in W.parent_pool(W.parent_quality(v)).collect()} == {"1", "2"}
    alone = W.parent_pool(W.parent_quality(v.filter("id <> '2'")))
    assert alone.count() == 5 and W.embedding_hierarchy(v.limit(0)).count() == 0
