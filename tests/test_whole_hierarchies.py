"""Paths and descendants on and below cycles against plain walks."""

import random

from termforest.operators.hierarchy import all_descendants, links_of, resolve_hierarchy
from termforest.plans import hierarchy_queries as Q


def climbed(pairs):
    """(root, path, distances of its ancestors) of every node, by its smallest parents one step at a time."""
    up = {}
    for p, c in pairs:
        up[c] = min(p, up.get(c, p))
    out = {}
    for n in {x for pair in pairs for x in pair}:
        way = [n]
        while way[-1] in up and up[way[-1]] not in way:
            way.append(up[way[-1]])
        loop = way[way.index(up[way[-1]]):] if way[-1] in up else []
        path = way[:way.index(loop[0]) + 1] if loop else way
        out[n] = (min(loop) if loop else way[-1], path[::-1], {a: k for k, a in enumerate(way) if k})
    return out


def test_random_hierarchies_with_cycles(spark):
    for seed in range(2):
        rnd = random.Random(seed)
        pairs = {(f"{rnd.randrange(90):02d}", f"{c:02d}") for c in range(80)} | {("s", "s"), ("s", "t"), ("00", "05"), ("40", "06")} | {(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)} | {("r4", "u"), ("u", "w")}
        found = resolve_hierarchy(links_of(spark.createDataFrame([("v", *p) for p in pairs], "ver string, p string, c string"), "ver", "p", "c"))
        want = climbed(pairs)
        assert {r["node"]: (r["root"], r["path"]) for r in found.nodes.collect()} == {n: w[:2] for n, w in want.items()}
        assert all(r["depth"] == len(r["path"]) - 1 for r in found.nodes.collect())
        got = [(r["ancestor"], r["node"], r["distance"]) for r in all_descendants(found).collect()]
        assert sorted(got) == sorted((a, n, k) for n, w in want.items() for a, k in w[2].items())


def test_queries_hold_the_concepts_of_cycles(spark, tmp_path):
    rows = [("v", p, c, "accepted") for p, c in [("b", "a"), ("a", "b"), ("a", "x"), ("x", "y")]]
    spark.createDataFrame(rows, "taxonomy_version_id string, parent_concept_id string, child_concept_id string, decision string").write.parquet(f"{tmp_path}/taxonomy_edge_candidates.parquet")
    paths = {r["concept_id"]: (r["root_id"], r["depth"], r["path"]) for r in Q.p2_paths(spark, str(tmp_path)).collect()}
    assert paths == {"a": ("a", 0, "a"), "b": ("a", 0, "b"), "x": ("a", 1, "a/x"), "y": ("a", 2, "a/x/y")}
    pairs = sorted((r["ancestor_id"], r["concept_id"], r["distance"]) for r in Q.p2_descendants(spark, str(tmp_path)).collect())
    assert pairs == [("a", "b", 1), ("a", "x", 1), ("a", "y", 2), ("b", "a", 1), ("b", "x", 2), ("b", "y", 3), ("x", "y", 1)]
