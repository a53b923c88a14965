"""Depths, paths and trees of deep and cyclic graphs against plain walks."""

import random

from termforest.operators import graph as G
from termforest.plans import graph_queries as Q


def edges(spark, pairs):
    return spark.createDataFrame([("g", p, c, 0.5) for p, c in pairs], "grp string, parent string, child string, score double")


def walked(pairs):
    """Depths and root paths by a plain breadth-first walk and a plain depth-first one."""
    below = {}
    for p, c in pairs:
        below.setdefault(p, set()).add(c)
    tops = set(below) - {c for _, c in pairs}
    depth, queue = dict.fromkeys(tops, 0), list(tops)
    for n in queue:
        for c in sorted(below.get(n, set()) - set(depth)):
            depth[c] = depth[n] + 1
            queue.append(c)
    paths, stack = set(), [(r,) for r in tops]
    while stack:
        path = stack.pop()
        paths.add(path)
        stack += [(*path, c) for c in below.get(path[-1], ()) if c not in path]
    return depth, paths


def test_chains_deeper_than_any_fixed_number_of_levels(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1100)]
    assert max(r["depth"] for r in G.depths(edges(spark, chain)).collect()) == 1100
    rows = G.tree_rows(edges(spark, chain[:150])).collect()
    assert len(rows) == 151 and max(r["depth"] for r in rows) == 150


def test_depths_and_paths_of_random_cyclic_graphs(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        pairs = {(f"{rnd.randrange(22):02d}", f"{rnd.randrange(3, 25):02d}") for _ in range(27)} | {("00", "03"), ("24", "24"), ("x", "y"), ("y", "x"), ("y", "z")}
        depth, paths = walked(pairs)
        got = G.tree_rows(edges(spark, pairs)).collect()
        assert sorted(tuple(r["path"]) for r in got) == sorted(paths)
        assert all((r["root"], r["node"], r["depth"]) == (r["path"][0], r["path"][-1], len(r["path"]) - 1) for r in got)
        assert {r["node"]: r["depth"] for r in G.depths(edges(spark, pairs)).collect()} == depth


def test_depth_limit_keeps_what_no_root_reaches(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z")]
    kept = {(r["parent"], r["child"]) for r in G.limit_depth(edges(spark, pairs), 2).collect()}
    assert kept == set(pairs) - {("c", "d")}
    assert G.limit_depth(edges(spark, pairs[3:]), 2).count() == 3


def test_queries_read_links_of_either_direction(spark, tmp_path):
    pairs = {("m", "c"), ("c", "k"), ("k", "a"), ("a", "z"), ("y", "x"), ("x", "y"), ("x", "w")}
    rows = [(str(i), "v", p, c, 0.5, "accepted") for i, (p, c) in enumerate(sorted(pairs))]
    spark.createDataFrame(rows, "id string, taxonomy_version_id string, parent_concept_id string, child_concept_id string, final_score double, decision string").write.parquet(f"{tmp_path}/taxonomy_edge_candidates.parquet")
    spark.createDataFrame([("v", "k")], "id string, collection_id string").write.parquet(f"{tmp_path}/taxonomy_versions.parquet")
    spark.createDataFrame([("k", n, n, "en") for n in "mckazyxwo"], "collection_id string, id string, canonical string, lang string").write.parquet(f"{tmp_path}/concepts.parquet")
    run = {n: Q.QUERIES[n](spark, str(tmp_path)).collect() for n in ("bfs_depths", "depth_limited_edges", "tree_paths", "tree_stats", "structural_report")}
    assert {r["node"]: r["depth"] for r in run["bfs_depths"]} == {"m": 0, "c": 1, "k": 2, "a": 3, "z": 4}
    assert {(r["parent"], r["child"]) for r in run["depth_limited_edges"]} == pairs - {("a", "z")}
    assert {r["path"] for r in run["tree_paths"]} == {"m", "m/c", "m/c/k", "m/c/k/a", "m/c/k/a/z"}
    assert [(r["n_nodes"], r["max_depth"]) for r in run["tree_stats"]] == [(5, 5)]
    report = next(r for r in run["structural_report"] if r["lang"] == "all")
    assert (report["n_roots"], report["n_leaves"], report["n_orphans"], report["max_depth"]) == (1, 2, 1, 4)
