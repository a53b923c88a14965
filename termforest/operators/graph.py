"""Graph operators over edge tables: columns ``grp`` (the graph an edge belongs to), ``parent``, ``child``, ``score``.

Rows with a null group, parent or child must be dropped before; see :func:`edges_of`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforest.operators.hierarchy import chains_of
from termforest.session import cut


def edges_of(df: DataFrame, group: str, parent: str, child: str, score: str) -> DataFrame:
    """One row per (group, parent, child) with the highest score; NaN and null scores count 0."""
    value = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(F.col(group).alias("grp"), F.col(parent).alias("parent"), F.col(child).alias("child"), value.alias("score"))
    return rows.dropna(subset=["grp", "parent", "child"]).groupBy("grp", "parent", "child").agg(F.max("score").alias("score"))


def merge_duplicates(edges: DataFrame) -> DataFrame:
    """GR-05: highest score and all evidence of equal edges; evidence keeps the order of ``seq``."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])
    return edges.groupBy("grp", "parent", "child").agg(F.max("score").alias("score"), ordered.alias("evidence"))


def collapse_bidirectional(edges: DataFrame, rank: str = "rank_score") -> DataFrame:
    """GR-06: of an edge and its reverse the one that ranks higher; a tie keeps the smaller parent."""
    back = edges.select("grp", F.col("parent").alias("child"), F.col("child").alias("parent"), F.col(rank).alias("_back"))
    joined = edges.join(back, ["grp", "parent", "child"], "left")
    keep = F.col("_back").isNull() | (F.col(rank) > F.col("_back")) | ((F.col(rank) == F.col("_back")) & (F.col("parent") <= F.col("child")))
    return joined.filter(keep).drop("_back")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("grp", F.col("parent").alias("node")).union(edges.select("grp", "child")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """GR-02: (grp, node, component), the component named by its smallest node; ``nodes`` adds isolated ones.

    Every node points at a smaller one; each round takes the smallest pointer among the neighbours and then the pointer's
    pointer, so the number of rounds grows with the logarithm of the diameter rather than with it.
    """
    links = edges.select("grp", F.col("parent").alias("a"), F.col("child").alias("b"))
    links = cut(links.union(links.select("grp", F.col("b"), F.col("a"))).distinct())
    own = nodes_of(edges) if nodes is None else nodes.select("grp", "node").dropna().union(nodes_of(edges)).distinct()
    state = cut(own.select("grp", "node", F.col("node").alias("label")))
    while True:
        near = links.join(state.select("grp", F.col("node").alias("b"), "label"), ["grp", "b"]).select("grp", F.col("a").alias("node"), F.col("label").alias("m"))
        # the pointers of my old pointer's node learn of my new one too, which merges whole trees at once
        best = near.groupBy("grp", "node").agg(F.min("m").alias("m"))
        told = state.join(best, ["grp", "node"]).select("grp", F.col("label").alias("node"), "m")
        low = best.union(told).groupBy("grp", "node").agg(F.min("m").alias("m"))
        step = state.join(low, ["grp", "node"], "left").select("grp", "node", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = step.select("grp", F.col("node").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, ["grp", "new"]).select("grp", "node", F.col("far").alias("new"), "label"))
        changed = step.filter("new <> label").limit(1).count()
        state = step.select("grp", "node", F.col("new").alias("label"))
        if not changed:
            return state.select("grp", "node", F.col("label").alias("component"))


SMALL_GRAPH = 20_000


def _joined(pairs: list) -> list[tuple[str, str]]:
    """(node, smallest node of its component) of the edges of one graph."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [(n, find(n)) for n in up]


def parts_of(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """As :func:`components` of the ends of ``edges``; graphs of up to ``small`` edges are each solved in one place."""
    n = edges.groupBy("grp").agg(F.count("*").alias("_n"))
    large = cut(n.filter(F.col("_n") > small).select("grp"))
    any_large = bool(large.limit(1).count())
    near = edges.join(large, "grp", "left_anti") if any_large else edges
    solve = F.udf(_joined, "array<struct<node:string,component:string>>")
    lists = near.groupBy("grp").agg(F.collect_list(F.struct("parent", "child")).alias("pairs"))
    parts = lists.select("grp", F.explode(solve("pairs")).alias("x")).select("grp", "x.*")
    return parts.unionByName(components(edges.join(large, "grp", "left_semi"))) if any_large else parts


def largest_component_ratio(parts: DataFrame) -> DataFrame:
    """GR-04: (grp, n_nodes, n_components, largest, ratio)."""
    sizes = parts.groupBy("grp", "component").agg(F.count("*").alias("size"))
    return sizes.groupBy("grp").agg(F.sum("size").alias("n_nodes"), F.count("*").alias("n_components"), F.max("size").alias("largest")).withColumn("ratio", F.col("largest") / F.col("n_nodes"))


def degrees(edges: DataFrame) -> DataFrame:
    """GR-26: (grp, node, out_degree, in_degree)."""
    out = edges.select("grp", F.col("parent").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select("grp", F.col("child").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.union(into).groupBy("grp", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def limit_children(edges: DataFrame, cap: int, rank: str = "rank_score", protected: str | None = None) -> DataFrame:
    """GR-13: protected edges, and the best others up to the cap (2 to 5) of each parent."""
    hard = max(2, min(cap, 5))
    flag = F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False)
    order = Window.partitionBy("grp", "parent").orderBy(F.desc("_p"), F.desc(rank), "child")
    ranked = edges.withColumn("_p", flag).withColumn("_r", F.row_number().over(order))
    # with the protected edges in front, a regular one is kept as long as its place is within the cap
    return ranked.filter(F.col("_p") | (F.col("_r") <= hard)).drop("_p", "_r")


def roots(edges: DataFrame) -> DataFrame:
    """JOIN-04: parents that are nobody's child."""
    return edges.select("grp", F.col("parent").alias("node")).distinct().join(edges.select("grp", F.col("child").alias("node")), ["grp", "node"], "left_anti")


def leaf_edges(edges: DataFrame) -> DataFrame:
    """JOIN-05: edges whose child is nobody's parent."""
    return edges.join(edges.select("grp", F.col("parent").alias("child")).distinct(), ["grp", "child"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SET-03: nodes without an edge."""
    return nodes.select("grp", "node").distinct().join(nodes_of(edges), ["grp", "node"], "left_anti")


def _chains(edges: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame]:
    """(grp, node, anchor, steps; walk with ``paths``) and the links into nodes of several parents.

    The anchor of a node is the first root or node of several parents that its only parents lead up to, ``walk`` the way
    down from there; both are found by pointer doubling, so deep chains cost their logarithm. Nodes on or below a cycle of
    only parents have no anchor: no root reaches them.
    """
    ways = cut(edges.select("grp", "parent", "child").distinct())
    several = cut(ways.groupBy("grp", "child").agg(F.count("*").alias("n")).filter("n > 1").select("grp", "child"))
    single = ways.join(several, ["grp", "child"], "left_anti").select(F.col("grp").alias("scope"), "parent", "child")
    walk = [F.col("path").alias("walk")] if paths else []
    down = chains_of(single, paths).select(F.col("scope").alias("grp"), "node", F.col("root").alias("anchor"), F.col("depth").alias("steps"), *walk)
    bare = cut(roots(ways).union(several).join(down.select("grp", "node"), ["grp", "node"], "left_anti"))
    alone = bare.select("grp", "node", F.col("node").alias("anchor"), F.lit(0).alias("steps"), *([F.array("node").alias("walk")] if paths else []))
    return down.unionByName(alone), cut(ways.join(several, ["grp", "child"], "left_semi"))


def depths(edges: DataFrame) -> DataFrame:
    """Breadth-first depth of the nodes that a root reaches: (grp, node, depth), the shortest way counts."""
    far, joints = _chains(edges, False)
    best = front = cut(roots(edges).withColumn("depth", F.lit(0)))
    hops = cut(joints.join(far.withColumnRenamed("node", "parent"), ["grp", "parent"]).groupBy("grp", "anchor", F.col("child").alias("node")).agg((F.min("steps") + 1).alias("hop")))
    while front.limit(1).count() and hops.limit(1).count():  # ends when no depth gets smaller
        offer = hops.join(front.withColumnRenamed("node", "anchor"), ["grp", "anchor"]).groupBy("grp", "node").agg(F.min(F.col("depth") + F.col("hop")).alias("depth"))
        known = best.select("grp", "node", F.col("depth").alias("_old"))
        front = cut(offer.join(known, ["grp", "node"], "left").filter("_old is null or depth < _old").select("grp", "node", "depth"))
        best = cut(best.join(front, ["grp", "node"], "left_anti").unionByName(front))
    return far.join(best.withColumnRenamed("node", "anchor"), ["grp", "anchor"]).select("grp", "node", (F.col("depth") + F.col("steps")).alias("depth"))


def limit_depth(edges: DataFrame, most: int) -> DataFrame:
    """GR-09: without the edges whose child lies more than ``most`` steps below the nearest root.

    A child that no root reaches counts as depth 0, so its edges stay, and graphs without a root stay as they are.
    """
    deep = depths(edges).filter(F.col("depth") > most).select("grp", F.col("node").alias("child"))
    return edges.join(deep, ["grp", "child"], "left_anti")


def tree_rows(edges: DataFrame) -> DataFrame:
    """GR-24: one row per path from a root: (grp, root, node, depth, path); a node on its own path ends it.

    Each round follows whole chains (see :func:`_chains`) and then one link into a node of several parents. Only there can
    a path come back to itself, as the way to any other node leads through its anchor. It goes on until no path does.
    """
    chains, joints = _chains(edges, True)
    front = cut(roots(edges).select("grp", F.col("node").alias("root"), F.col("node").alias("anchor"), F.array().cast("array<string>").alias("head")))
    rows = None
    while rows is None or front.limit(1).count():
        new = front.join(chains, ["grp", "anchor"]).select("grp", "root", "node", F.concat("head", "walk").alias("path"))
        rows = new if rows is None else rows.union(new)
        if not joints.limit(1).count():
            break
        step = new.withColumnRenamed("node", "parent").join(joints, ["grp", "parent"]).filter(~F.array_contains("path", F.col("child")))
        front = cut(step.select("grp", "root", F.col("child").alias("anchor"), F.col("path").alias("head")))
    return rows.select("grp", "root", "node", (F.size("path") - 1).alias("depth"), "path")


def graph_quality(edges: DataFrame, nodes: DataFrame | None, low_quality: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """EV-01: per graph edge density, largest component ratio, hubness (largest over median out-degree), noise share.

    ``nodes`` gives the concepts of a graph, or ``counts`` (grp, n) their numbers, ``low_quality`` (grp, n_noise) the noisy
    labels among its edge ends.
    """
    n = nodes.select("grp", "node").distinct().groupBy("grp").agg(F.count("*").alias("n")) if counts is None else counts
    e = edges.groupBy("grp").agg(F.count("*").alias("n_edges"))
    hubs = edges.groupBy("grp", "parent").agg(F.count("*").alias("c")).groupBy("grp").agg((F.max("c") / F.median("c")).alias("hubness"))
    parts = largest_component_ratio(parts_of(edges)).select("grp", F.col("n_nodes").alias("linked"), "n_components", "largest")
    out = n.join(e, "grp", "left").join(hubs, "grp", "left").join(parts, "grp", "left").join(low_quality, "grp", "left")
    zero = F.lit(0.0)
    return out.select(
        "grp", "n", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.coalesce("n_edges", F.lit(0)) / F.col("n")).alias("edge_density"),
        F.coalesce(F.col("largest") / F.col("n"), zero).alias("largest_component_ratio"), F.coalesce("hubness", zero).alias("hubness"),
        F.coalesce(F.col("n_noise") / F.col("linked"), zero).alias("lexical_noise_rate"), F.coalesce("n_components", F.lit(0)).alias("n_components"),
    )


def violations(min_density: float = 0.20, min_lcr: float = 0.40, max_hubness: float = 6.0, max_noise: float = 0.05):
    """ED-25: array of the quality limits that a row of :func:`graph_quality` breaks."""
    checks = [
        F.when(F.col("edge_density") < min_density, "edge_density"), F.when(F.col("largest_component_ratio") < min_lcr, "largest_component_ratio"),
        F.when(F.col("hubness") > max_hubness, "hubness"), F.when(F.col("lexical_noise_rate") > max_noise, "lexical_noise_rate"),
    ]
    return F.array_compact(F.array(*checks))
