"""Parent-child links to full hierarchies by pointer doubling.

Every node carries a pointer to an ancestor. One round replaces the pointer by the pointer's pointer, so the distance
jumped doubles and a tree of depth d is resolved in about log2(d) joins, whatever its shape. Nodes that are still
unresolved when a round resolves nothing more lead into a cycle.

Input rules, the same for every function here:

* a row with a null scope, parent or child is ignored; an empty string is an id like any other;
* repeated links count once; other columns of the input are ignored, so their names cannot clash;
* an empty input gives an empty result;
* a node with several parents follows its smallest parent id for path, depth and root; its other links still count
  when cycles are looked for, and ``cycle_id`` then is the smallest id of all cycles that hang together;
* a self link is a cycle of one node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforest.session import cut


@dataclass(frozen=True)
class Hierarchy:
    """Result of :func:`resolve_hierarchy`; all frames have the columns ``scope`` and ``node``.

    ``loops`` are the cycles that first parents alone form: scope, node, up, cycle_id.
    """

    nodes: DataFrame
    cycles: DataFrame
    loops: DataFrame


def links_of(edges: DataFrame, scope: str | Column, parent: str, child: str) -> DataFrame:
    """Distinct (scope, parent, child) links of ``edges`` without nulls."""
    scope = F.col(scope) if isinstance(scope, str) else scope
    return (
        edges.select(scope.alias("scope"), F.col(parent).alias("parent"), F.col(child).alias("child"))
        .dropna(how="any")
        .distinct()
    )


def _primary(links: DataFrame) -> DataFrame:
    return links.groupBy("scope", F.col("child").alias("node")).agg(F.min("parent").alias("up"), F.count("*").alias("n_parents"))


def _double(state: DataFrame) -> DataFrame:
    """One round over nodes whose walk goes on: pointer of the pointer, and the smallest id met on the way."""
    far = state.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("lo").alias("lo2"))
    return state.join(far, ["scope", "up"]).select("scope", "node", F.col("up2").alias("up"), F.least("lo", "lo2").alias("lo"), (F.col("lo2") < F.col("lo")).alias("moved"))


def _walks(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes whose walk never ends, nodes on cycles with the smallest id of their cycle) of a one-parent graph."""
    state = cut(pointers.select("scope", "node", "up", F.col("node").alias("lo"), F.lit(True).alias("moved")))
    left = state.count()
    # A round without a resolved node proves that no finite walk is left: a longer one would hold shorter ones.
    while left:
        state = cut(_double(state))
        now = state.count()
        if now == left:
            break
        left = now
    endless = state.select("scope", "node")
    # Images of the doubled map are nested; once one has the size of the one before, it holds the cycles and no more.
    # Two windows side by side with one minimum overlap, so a round that moves no minimum has gone round every cycle.
    while left:
        hit = state.select("scope", F.col("up").alias("node")).distinct()
        state = cut(_double(state.join(hit, ["scope", "node"], "left_semi")))
        now, moved = state.agg(F.count("*"), F.count_if("moved")).first()
        if now == left and not moved:
            break
        left = now
    return endless, state.select("scope", "node", F.col("lo").alias("cycle_id"))


def _spread_smallest(arcs: DataFrame, start: str, end: str) -> DataFrame:
    """(scope, node, low): the smallest id of the ``arcs`` from which a node can be reached along them, itself included.

    What reaches a node's ``low`` reaches the node too, so each round also follows that pointer and doubles the way.
    """
    ways = cut(arcs.select("scope", F.col(start).alias("a"), F.col(end).alias("b")).distinct())
    state = cut(ways.select("scope", F.col("a").alias("node")).union(ways.select("scope", "b")).distinct().withColumn("low", F.col("node")))
    while True:
        near = ways.join(state.select("scope", F.col("node").alias("a"), F.col("low").alias("m")), ["scope", "a"]).groupBy("scope", F.col("b").alias("node")).agg(F.min("m").alias("m"))
        step = state.join(near, ["scope", "node"], "left").select("scope", "node", "low", F.least("low", F.coalesce("m", "low")).alias("new"))
        far = state.select("scope", F.col("node").alias("new"), F.col("low").alias("far"))
        step = cut(step.join(far, ["scope", "new"]).select("scope", "node", "low", F.least("new", "far").alias("new")))
        moved = step.filter("new < low").limit(1).count()
        state = step.select("scope", "node", F.col("new").alias("low"))
        if not moved:
            return state


def _strong_arcs(arcs: DataFrame) -> DataFrame:
    """The rows of ``arcs`` (scope, a, b and more) within a strongly connected set, with its smallest id as ``set_id``.

    All nodes reached from the smallest id that reaches them form a class; those of the class that reach that id in turn
    are its set. Sets found are taken out, with all arcs that join two classes, and the rest is asked again.
    """
    rest, found = cut(arcs), None
    while rest.limit(1).count():
        low = cut(_spread_smallest(rest, "a", "b"))
        of = lambda end: low.select("scope", F.col("node").alias(end), F.col("low").alias(f"_{end}"))
        inner = cut(rest.join(of("a"), ["scope", "a"]).join(of("b"), ["scope", "b"]).filter("_a = _b").withColumn("class", F.col("_a")).drop("_a", "_b"))
        # within its class the smallest id that a node reaches is the class's own, or the node is not in its set
        back = cut(_spread_smallest(inner.select(F.struct("scope", "class").alias("scope"), "a", "b"), "b", "a"))
        core = cut(back.filter(F.col("low") == F.col("scope.class")).select("scope.scope", "scope.class", "node"))
        side = lambda end, how: core.select("scope", "class", F.col("node").alias(end), *([F.lit(True).alias(f"_{end}")] if how else []))
        flagged = cut(inner.join(side("a", True), ["scope", "class", "a"], "left").join(side("b", True), ["scope", "class", "b"], "left"))
        hit = flagged.filter("_a and _b").drop("_a", "_b").withColumnRenamed("class", "set_id")
        found = hit if found is None else found.unionByName(hit)
        rest = flagged.filter("_a is null and _b is null").drop("_a", "_b", "class")
    return found if found is not None else rest.withColumn("set_id", F.col("a"))


def _ways_up(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts`` (scope, node, set_id) with all nodes that their pointers lead to, doubling the way each round."""
    marked, jump = cut(starts.distinct()), cut(pointers.select("scope", "node", "up"))
    while jump.limit(1).count():
        marked = cut(marked.unionByName(marked.join(jump, ["scope", "node"]).select("scope", F.col("up").alias("node"), "set_id")).distinct())
        far = jump.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = cut(jump.join(far, ["scope", "up"]).select("scope", "node", F.col("up2").alias("up")))
    return marked


def _all_cycles(links: DataFrame, pointers: DataFrame) -> DataFrame:
    """(scope, node, cycle_id): nodes on cycles, with the smallest id of their strongly connected set.

    Nodes with one parent form chains, which pointer doubling leads to their first node with several parents, to a root,
    or round a cycle of such nodes alone. Between nodes with several parents the chains count as single arcs, and only
    among these arcs strongly connected sets are looked for: the work grows with their number, not with that of pairs.
    """
    single = cut(pointers.filter("n_parents = 1").select("scope", "node", "up"))
    joints = cut(pointers.filter("n_parents > 1").select("scope", "node"))
    endless, loops = _walks(single)
    if not joints.limit(1).count():
        return loops
    chained = cut(single.join(endless, ["scope", "node"], "left_anti"))
    ends = cut(_climb(chained, joints.unionByName(_roots(links)), False).select("scope", F.col("node").alias("parent"), F.col("root").alias("b")))
    into = links.withColumnRenamed("child", "a").join(joints.withColumnRenamed("node", "a"), ["scope", "a"])
    arcs = into.join(ends, ["scope", "parent"]).join(joints.withColumnRenamed("node", "b"), ["scope", "b"], "left_semi")
    strong = cut(_strong_arcs(arcs.select("scope", "a", "b", "parent")))
    if not strong.limit(1).count():
        return loops
    sets = strong.select("scope", F.col("b").alias("root"), "set_id").distinct()
    below = ends.select("scope", F.col("parent").alias("node"), F.col("b").alias("root")).join(sets, ["scope", "root"], "left_semi")
    starts = strong.select("scope", F.col("parent").alias("node"), "set_id").unionByName(strong.select("scope", F.col("a").alias("node"), "set_id"))
    on = cut(_ways_up(chained.join(below, ["scope", "node"], "left_semi"), starts).unionByName(strong.select("scope", F.col("b").alias("node"), "set_id")).distinct())
    least = on.groupBy("scope", "set_id").agg(F.min("node").alias("cycle_id"))
    return loops.unionByName(on.join(least, ["scope", "set_id"]).select("scope", "node", "cycle_id"))


def find_cycles(links: DataFrame) -> DataFrame:
    """(scope, node, cycle_id) of the nodes on cycles."""
    return _all_cycles(links, cut(_primary(links)))


def _roots(links: DataFrame) -> DataFrame:
    return links.select("scope", F.col("parent").alias("node")).distinct().join(links.select("scope", F.col("child").alias("node")).distinct(), ["scope", "node"], "left_anti")


def _climb(pointers: DataFrame, tops: DataFrame, paths: bool = True) -> DataFrame:
    """(scope, node, root, depth, path) of nodes whose pointers all lead to ``tops``; without ``paths`` path is left out.

    A pointer twice as long only ever ends at nodes where one half as long ended, so each round keeps no more than those
    to be looked up, and a node is written again only until it is resolved.
    """
    unit = F.array("node").cast("array<string>") if paths else F.lit(1)
    going = pointers.select("scope", "node", "up", F.lit(None).cast(pointers.schema["up"].dataType).alias("top"), unit.alias("walk"))
    done = [cut(tops.select("scope", "node", F.lit(None).cast(pointers.schema["up"].dataType).alias("up"), F.col("node").alias("top"), unit.alias("walk")))]
    going, pool = cut(going), None
    while going.limit(1).count():
        pool = going.unionByName(done[0]) if pool is None else pool
        pool = cut(pool.join(going.select("scope", F.col("up").alias("node")).distinct(), ["scope", "node"], "left_semi"))
        far = pool.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("walk").alias("walk2"))
        both = F.concat("walk", "walk2") if paths else F.col("walk") + F.col("walk2")
        step = cut(going.join(far, ["scope", "up"]).select("scope", "node", F.col("up2").alias("up"), F.col("top2").alias("top"), both.alias("walk")))
        done.append(step.filter("up is null"))
        going, pool = step.filter("up is not null"), pool.filter("up is null").unionByName(step)
    state = done[0]
    for d in done[1:]:
        state = state.unionByName(d)
    length = (F.size("walk") if paths else F.col("walk")) - 1
    return state.select("scope", "node", F.col("top").alias("root"), length.alias("depth"), *([F.reverse("walk").alias("path")] if paths else []))


def chains_of(links: DataFrame, paths: bool = True) -> DataFrame:
    """(scope, node, root, depth, path) of the nodes of ``links`` that their first parents lead to a root; see :func:`_climb`."""
    pointers = cut(_primary(links))
    endless, _ = _walks(pointers)
    return _climb(pointers.select("scope", "node", "up").join(endless, ["scope", "node"], "left_anti"), _roots(links), paths)


def resolve_hierarchy(links: DataFrame) -> Hierarchy:
    """Path, depth and root of every node of ``links`` (see :func:`links_of`), and the nodes on cycles.

    ``nodes``: scope, node, root, depth (0 at a root), path (ids from the root to the node), state: ``tree``, or
    ``endless`` for nodes on or below a cycle of first parents. Their root is that cycle, named by its smallest id; path
    and depth begin at the first of its nodes that the way up meets. ``cycles``: scope, node, cycle_id.
    """
    links = cut(links)
    pointers = cut(_primary(links))
    _, loops = _walks(pointers)
    loops = cut(loops.join(pointers, ["scope", "node"]).select("scope", "node", "up", "cycle_id"))
    tops = _roots(links).unionByName(loops.select("scope", "node"))
    found = _climb(pointers.select("scope", "node", "up").join(loops, ["scope", "node"], "left_anti"), tops)
    entry = loops.select("scope", F.col("node").alias("root"), "cycle_id")
    nodes = found.join(entry, ["scope", "root"], "left").select(
        "scope", "node", F.coalesce("cycle_id", "root").alias("root"), "depth", "path", F.when(F.col("cycle_id").isNull(), "tree").otherwise("endless").alias("state")
    )
    return Hierarchy(nodes, _all_cycles(links, pointers), loops)


def _steps(nodes: DataFrame) -> DataFrame:
    steps = nodes.select("scope", "node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.filter("at < depth").select("scope", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def descendants(nodes: DataFrame) -> DataFrame:
    """All (scope, ancestor, node, distance) pairs of the tree nodes; one row per pair, never a collected list."""
    return _steps(nodes.filter("state = 'tree'"))


def all_descendants(found: Hierarchy) -> DataFrame:
    """:func:`descendants` with the nodes on and below cycles: once each, by the shortest way, no node under itself.

    Besides the nodes of its path, every other node of the cycle is above such a node.
    """
    # the place of a node: its steps below the smallest id of its cycle
    tops = found.loops.filter("node = cycle_id").select("scope", "node")
    place = _climb(found.loops.filter("node <> cycle_id").select("scope", "node", "up"), tops, False)
    place = cut(place.select("scope", F.col("root").alias("cycle_id"), F.col("node").alias("on"), F.col("depth").alias("place")))
    size = place.groupBy("scope", "cycle_id").agg(F.count("*").cast("int").alias("size"))
    ends = cut(found.nodes.filter("state = 'endless'").select("scope", F.col("root").alias("cycle_id"), "node", "depth", F.element_at("path", 1).alias("on")))
    entry = ends.join(place, ["scope", "cycle_id", "on"])
    above = cut(place.join(size, ["scope", "cycle_id"]).select("scope", "cycle_id", F.col("on").alias("ancestor"), F.col("place").alias("p"), "size"))
    around = entry.join(above, ["scope", "cycle_id"]).filter("ancestor <> on")
    return _steps(found.nodes).unionByName(around.select("scope", "ancestor", "node", (F.col("depth") + F.pmod(F.col("place") - F.col("p"), F.col("size"))).alias("distance")))
