"""Reports on hierarchies: structure, confidence, risk, review and cross-language agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforest.functions import text as X
from termforest.session import cut


def confidence_stats(edges: DataFrame, keys: list[str]) -> DataFrame:
    """EV-03 / AGG-10,11: mean, spread and fixed buckets of the scores; rows without a score do not count."""
    s = F.col("score")
    e = edges.filter(s.isNotNull() & ~F.isnan(s))
    return e.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(s), 4).alias("avg_score"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 4).alias("std_score"),
        F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.count_if(s < 0.3).alias("below_03"), F.count_if((s >= 0.3) & (s < 0.5)).alias("from_03"),
        F.count_if((s >= 0.5) & (s < 0.7)).alias("from_05"), F.count_if((s >= 0.7) & (s < 0.9)).alias("from_07"), F.count_if(s >= 0.9).alias("from_09"),
    )


def method_distribution(edges: DataFrame, keys: list[str]) -> DataFrame:
    """EV-03 / AGG-12: evidence items by method; edges without a method count as unknown."""
    items = edges.select(*keys, F.explode_outer("evidence").alias("e"))
    return items.groupBy(*keys, F.coalesce("e.method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))


def structure(nodes: DataFrame, edges: DataFrame, depths: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """EV-02: roots, leaves, orphans, depth, branching and coverage, per (grp, lang) and overall (lang null).

    ``nodes``: grp, node, lang; ``edges``: grp, parent, child; ``depths``: grp, node, depth. One pass of grouping sets.
    With ``alone`` (grp, lang, n), the numbers of nodes without an edge, ``nodes`` are those with one.
    """
    p = edges.groupBy("grp", F.col("parent").alias("node")).agg(F.count("*").alias("out"))
    c = edges.groupBy("grp", F.col("child").alias("node")).agg(F.count("*").alias("inn"))
    flags = nodes.join(p, ["grp", "node"], "left").join(c, ["grp", "node"], "left").join(depths, ["grp", "node"], "left").na.fill(0, ["out", "inn"]).withColumn("n", F.lit(1).cast("bigint"))
    if alone is not None:
        flags = flags.unionByName(alone.select("grp", "lang", "n", F.lit(0).alias("out"), F.lit(0).alias("inn")), allowMissingColumns=True)
    out, inn = F.col("out"), F.col("inn")
    aggs = [
        F.sum("n").alias("n_nodes"), F.count_if((out > 0) & (inn == 0)).alias("n_roots"), F.count_if((out == 0) & (inn > 0)).alias("n_leaves"),
        F.sum(F.when((out == 0) & (inn == 0), F.col("n")).otherwise(0)).alias("n_orphans"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.round(F.coalesce(F.avg("depth"), F.lit(0.0)), 2).alias("avg_depth"),
        F.round(F.coalesce(F.avg(F.when(out > 0, out)), F.lit(0.0)), 2).alias("avg_branching"), F.max(out).alias("max_branching"), F.round(F.count_if((out > 0) | (inn > 0)) / F.sum("n"), 4).alias("coverage"),
    ]
    sets = [[F.col("grp"), F.col("_lang")], [F.col("grp")]]
    grouped = flags.withColumn("_lang", F.coalesce("lang", F.lit("unknown"))).groupingSets(sets, F.col("grp"), F.col("_lang")).agg(*aggs)
    return grouped.withColumnRenamed("_lang", "lang")


def candidate_nodes(nodes: DataFrame, min_df: int = 2) -> DataFrame:
    """EV-10: ``nodes`` (grp, node, canonical, df and more) with ``candidate``: a good label in two documents or more."""
    return nodes.withColumn("candidate", ~X.is_low_quality_label("canonical") & (F.coalesce("df", F.lit(0)) >= min_df))


def coverage(nodes: DataFrame, edges: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """SET-04: (grp, coverage, coverage_candidates): shares of all and of the candidate nodes that have an edge.

    With ``totals`` (grp, n_rows, n_candidates), the numbers of all nodes, ``nodes`` are those with an edge.
    """
    ends = edges.select("grp", F.col("parent").alias("node")).union(edges.select("grp", "child")).distinct()
    flags = nodes.join(ends.withColumn("_linked", F.lit(1)), ["grp", "node"], "left")
    linked = F.col("_linked").isNotNull()
    if totals is not None:
        has = flags.groupBy("grp").agg(F.count_if(linked).alias("_n"), F.count_if(F.col("candidate") & linked).alias("_c"))
        of = lambda x, n: F.coalesce(F.try_divide(F.coalesce(x, F.lit(0)), n), F.lit(0.0))
        return totals.join(has, "grp", "left").select("grp", of(F.col("_n"), F.col("n_rows")).alias("coverage"), of(F.col("_c"), F.col("n_candidates")).alias("coverage_candidates"))
    share = F.coalesce(F.try_divide(F.count_if(F.col("candidate") & linked), F.count_if("candidate")), F.lit(0.0))
    return flags.groupBy("grp").agg((F.count_if(linked) / F.count("*")).alias("coverage"), share.alias("coverage_candidates"))


def risky_edges(edges: DataFrame, nodes: DataFrame, low: float = 0.62) -> DataFrame:
    """EV-05: the edges of low score whose child looks more general: its words are a part of the parent's, or it is in
    two documents more and no longer. ``nodes``: grp, node, canonical, df."""
    side = lambda x: nodes.select("grp", F.col("node").alias(x), F.col("canonical").alias(f"{x}_label"), F.coalesce("df", F.lit(0)).alias(f"{x}_df"))
    rows = edges.filter(F.col("score") <= low).join(side("parent"), ["grp", "parent"]).join(side("child"), ["grp", "child"])
    p, c = X.tokens("parent_label"), X.tokens("child_label")
    subset = (F.size(p) > F.size(c)) & (F.size(c) > 0) & (F.size(F.array_except(c, p)) == 0)
    wider = (F.col("child_df") >= F.col("parent_df") + 2) & (F.size(c) <= F.size(p))
    return rows.withColumn("lexical_subset", subset).filter(subset | wider)


def fragmentation(parts: DataFrame, edges: DataFrame, nodes: DataFrame, low: float = 0.62, totals: DataFrame | None = None) -> DataFrame:
    """EV-05: components, small and isolated ones, fragmentation index (components over nodes), weak and risky edges.

    ``parts``: grp, node, component of the nodes of a graph; ends of edges that are no nodes belong to none. With ``totals``
    (grp, n_nodes), the numbers of all nodes, those that are in no part are a component each, and ``nodes`` need hold only
    nodes with an edge.
    """
    sizes = parts.groupBy("grp", "component").agg(F.count("*").alias("size"))
    small = F.col("size") <= 2
    per = sizes.groupBy("grp").agg(F.count("*").alias("n_components"), F.count_if(small).alias("n_small"), F.count_if(F.col("size") == 1).alias("n_isolated"), F.sum("size").alias("n_nodes"), F.sum(F.when(small, F.col("size")).otherwise(0)).alias("in_small"))
    if totals is not None:
        counted = ("n_components", "n_small", "n_isolated", "in_small")
        all_nodes = totals.filter("n_nodes > 0").select("grp", F.col("n_nodes").alias("_all")).join(per, "grp", "left").na.fill(0, [*counted, "n_nodes"])
        per = all_nodes.select("grp", F.col("_all").alias("n_nodes"), *[(F.col(c) + F.col("_all") - F.col("n_nodes")).alias(c) for c in counted])
    weak = edges.groupBy("grp").agg(F.count("*").alias("n_edges"))
    known = nodes.select("grp", "node")
    inside = edges.filter(F.col("score") <= low).join(known.withColumnRenamed("node", "parent"), ["grp", "parent"], "left_semi").join(known.withColumnRenamed("node", "child"), ["grp", "child"], "left_semi")
    weak = weak.join(inside.groupBy("grp").agg(F.count("*").alias("n_weak")), "grp", "left").join(risky_edges(edges, nodes, low).groupBy("grp").agg(F.count("*").alias("n_risky")), "grp", "left")
    share = lambda x: F.round(F.coalesce(F.try_divide(F.col(x), F.col("n_edges")), F.lit(0.0)), 4)
    return per.join(weak, "grp", "left").na.fill(0, ["n_edges", "n_weak", "n_risky"]).select(
        "grp", "n_components", "n_small", "n_isolated", F.round(F.col("n_components") / F.col("n_nodes"), 4).alias("fragmentation"), F.round(F.col("in_small") / F.col("n_nodes"), 4).alias("small_share"),
        "n_weak", share("n_weak").alias("weak_share"), "n_risky", share("n_risky").alias("risky_share"),
    )


def connectivity_slices(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EV-04: (edges, nodes) with ``grp`` a struct (grp, slice): all and candidate nodes, each overall and by language.

    An edge is in a slice if both of its ends are; so one run of the graph measures gives all slices.
    """
    lang = F.coalesce("lang", F.lit("unknown"))
    both = lambda kind: F.array(F.lit(kind), F.concat(F.lit(kind + "/"), lang))
    of = nodes.withColumn("_s", F.concat(both("all"), F.when(F.col("candidate"), both("candidate")).otherwise(F.array().cast("array<string>"))))
    end = lambda x: of.select("grp", F.col("node").alias(x), F.col("_s").alias(f"_{x}"))
    cut_edges = edges.join(end("parent"), ["grp", "parent"]).join(end("child"), ["grp", "child"]).withColumn("slice", F.explode(F.array_intersect("_parent", "_child")))
    in_slice = F.struct("grp", "slice").alias("grp")
    return cut_edges.select(in_slice, "parent", "child", "score"), of.withColumn("slice", F.explode("_s")).select(in_slice, "node", "canonical")


def active_learning(candidates: DataFrame, labels: DataFrame, grp: str, n: int = 25, shown: int = 12) -> DataFrame:
    """EV-09, AGG-21: per ``grp`` the ``n`` candidates of highest risk by decision, the first ``shown``, and the number of
    labels of its collection (a report of that size). ``labels``: collection_id."""
    order = Window.partitionBy(grp).orderBy(F.desc_nulls_last("risk_score"), "id")
    top = candidates.filter(F.col(grp).isNotNull()).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    item = F.struct("_r", F.col("parent_label").alias("parent"), F.col("child_label").alias("child"), "method", F.round(F.coalesce(F.nanvl("risk_score", F.lit(0.0)), F.lit(0.0)), 4).alias("risk_score"), "decision")
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= shown, item))), lambda x: x.dropFields("_r"))
    per = top.groupBy(grp).agg(F.count("*").alias("n_top"), F.count_if(F.col("decision") == "accepted").alias("n_accepted"), F.count_if(F.col("decision") == "rejected").alias("n_rejected"), F.min("collection_id").alias("collection_id"), listed.alias("top"))
    history = labels.groupBy("collection_id").agg(F.count("*").alias("n_labels"))
    return per.join(history, "collection_id", "left").na.fill(0, ["n_labels"]).drop("collection_id")


def assemble(parts: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """EV-11, SNK-05: (grp, report): one JSON report per graph of ``keys`` with a list of rows under each name.

    The rows of a graph in a part are few: one per language, slice, method or rank. Each part is worked out on its own:
    one plan of them all takes the driver longer, and more memory, than the work itself.
    """
    out = keys.select("grp").distinct()
    for name, df in parts.items():
        rest = [c for c in df.columns if c != "grp"]
        listed = cut(df.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)))
        out = out.join(listed, "grp", "left")
    fields = [F.lit(2).alias("schema_version"), *[F.coalesce(n, F.array()).alias(n) for n in parts]]
    return out.select("grp", F.to_json(F.struct(*fields)).alias("report"))


def review_rates(edges: DataFrame, keys: list[str]) -> DataFrame:
    """EV-06: reviewed, approved and rejected edges by the nullable flag ``approved``; rates of nothing are 0."""
    a = F.col("approved")
    counts = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.count(a).alias("reviewed"), F.count_if(a).alias("approved"), F.count_if(~a).alias("rejected"))
    return counts.withColumn("approval_rate", F.round(F.coalesce(F.try_divide(F.col("approved"), F.col("reviewed")), F.lit(0.0)), 4))


def cross_language(edges: DataFrame) -> DataFrame:
    """EV-07: one row: pairs of anchors seen, either way, in two languages or more, and those never seen reversed.

    ``edges``: parent_label, child_label, lang. The pair is keyed without direction, so one aggregation does the reverse
    lookup that a self join would.
    """
    p, c = X.anchor("parent_label"), X.anchor("child_label")
    pairs = edges.select(F.least(p, c).alias("a"), F.greatest(p, c).alias("b"), (p <= c).alias("forward"), F.coalesce("lang", F.lit("")).alias("lang")).filter("a <> '' and b <> ''")
    per = pairs.groupBy("a", "b").agg(F.count_distinct("lang").alias("langs"), F.bool_or("forward").alias("f"), F.bool_or(~F.col("forward")).alias("r"))
    seen = per.filter("langs >= 2")
    return seen.agg(F.count("*").alias("comparable"), F.count_if(~(F.col("f") & F.col("r"))).alias("consistent")).withColumn("consistency", F.round(F.coalesce(F.try_divide(F.col("consistent"), F.col("comparable")), F.lit(1.0)), 4))


def quality_score(coverage: Column, lcr: Column, fragmentation: Column, weak_share: Column, hubness: Column, disagreement: Column, compat: bool = True) -> Column:
    """EV-08, out of ten. With ``compat`` a fragmentation or weak share of exactly 0 counts as 1, as it was published."""
    def share(x: Column) -> Column:
        return F.when(x == 0, 1.0).otherwise(x) if compat else x

    hub = 1 - F.least(F.lit(1.0), hubness / 8)
    return F.round(10 * (0.30 * coverage + 0.25 * lcr + 0.15 * (1 - share(fragmentation)) + 0.10 * (1 - share(weak_share)) + 0.10 * hub + 0.10 * (1 - disagreement)), 3)


def top_rejections(edges: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """AGG-17: the ``n`` most frequent rejection reasons as ``reason=count`` in one string (a report of that size)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "rejection_reason")
    top = rejection_counts(edges, keys).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_r", F.concat_ws("=", "rejection_reason", F.col("n").cast("string")).alias("t")))), lambda x: x["t"])
    return top.groupBy(*keys).agg(F.array_join(listed, ", ").alias("reasons"))


def rejection_counts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-17: rejection reasons by frequency."""
    return edges.filter("rejection_reason is not null").groupBy(*keys, "rejection_reason").agg(F.count("*").alias("n"))
