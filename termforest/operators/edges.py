"""Scores, thresholds and rejection reasons of candidate edges, as column expressions.

Evidence is an array of structs with the fields of ``EVIDENCE``; a missing array or value counts as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforest.functions import lexicon as L
from termforest.functions import text as X

EVIDENCE = ("method", "similarity", "semantic_similarity", "cosine_similarity", "retrieval_evidence_score", "cooccurrence_support", "lexical_similarity")
EVIDENCE_TYPE = "array<struct<" + ",".join(f"{n}:{'string' if n == 'method' else 'double'}" for n in EVIDENCE) + ">>"
MIN_PARENT_DF = 3


def clamp(value: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def number(value: Column) -> Column:
    """0.0 for null and NaN."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def method_of(evidence: Column) -> Column:
    """ED-01: first method named in the evidence."""
    named = F.filter(evidence, lambda e: F.length(e["method"]) > 0)
    return F.coalesce(F.get(named, F.lit(0))["method"], F.lit("unknown"))


def method_weight(method: Column) -> Column:
    low = F.lower(method)
    out = None
    for name, weight in L.METHOD_WEIGHTS.items():
        out = F.when(low == name, weight) if out is None else out.when(low == name, weight)
    return out.otherwise(L.OTHER_METHOD_WEIGHT)


def _verbish(words: Column) -> Column:
    return F.forall(words, lambda w: w.rlike(f"(?:{'|'.join(L.VERBISH_SUFFIXES)})$"))


def _phrase(norm: Column) -> Column:
    return X.any_of([norm.contains(p) for p in L.BAD_PARENT_PHRASES if " " in p])


def parent_validity(label: Column, df: Column, min_df: int = MIN_PARENT_DF) -> Column:
    """ED-03: how well a label serves as a parent, 0 to 1."""

    def judged(words: Column) -> Column:
        n, first, norm = F.size(words), F.get(words, F.lit(0)), F.array_join(words, " ")
        hits = F.size(F.filter(words, lambda w: w.isin(L.FUNCTIONAL_PARENTS)))
        single = F.when(first.isin(L.BAD_PARENT_SINGLES), 0.70).otherwise(0.0) + F.when(F.length(first) < 4, 0.30).otherwise(0.0) + F.when(F.coalesce(df, F.lit(0)) < min_df, 0.25).otherwise(0.0)
        score = F.lit(1.0) - F.when(_phrase(norm), 0.50).otherwise(0.0) - 0.45 * hits / F.greatest(n, F.lit(1))
        score = score - F.when(n == 1, single).otherwise(0.0) - F.when((n <= 2) & _verbish(words), 0.45).otherwise(0.0) - F.when(n > 5, 0.25).otherwise(0.0)
        return F.when((n == 0) | norm.isin(*L.BAD_PARENT_PHRASES), 0.0).otherwise(clamp(score))

    return F.coalesce(X.let(X.tokens(label), judged), F.lit(0.0))


def is_valid_parent(label: Column, df: Column, min_df: int = MIN_PARENT_DF) -> Column:
    """ED-04."""

    def judged(words: Column) -> Column:
        n, first, norm = F.size(words), F.get(words, F.lit(0)), F.array_join(words, " ")
        single = first.isin(L.BAD_PARENT_SINGLES) | (F.length(first) < 4) | (F.coalesce(df, F.lit(0)) < min_df)
        pair = F.exists(words, lambda w: w.isin(L.BAD_PARENT_SINGLES))
        bad = (n == 0) | norm.isin(*L.BAD_PARENT_PHRASES) | _phrase(norm) | ((n == 1) & single) | ((n == 2) & pair) | ((n <= 2) & _verbish(words))
        return ~bad

    return F.coalesce(X.let(X.tokens(label), judged), F.lit(False))


def evidence_max(evidence: Column, field: str) -> Column:
    """ED-06."""
    return F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform(evidence, lambda e: number(e[field])))), F.lit(0.0))


def semantic_score(evidence: Column) -> Column:
    """ED-05: best semantic value, alone or blended with lexical and co-occurrence support."""

    def of(e: Column) -> Column:
        sem = F.greatest(F.lit(0.0), number(e["semantic_similarity"]), number(e["cosine_similarity"]), number(e["retrieval_evidence_score"]))
        blend = 0.82 * sem + 0.12 * number(e["lexical_similarity"]) + 0.06 * number(e["cooccurrence_support"])
        return F.when(sem > 0, F.greatest(sem, blend)).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(evidence, of)), F.lit(0.0))


def label_facts(labels: DataFrame, min_df: int = MIN_PARENT_DF) -> DataFrame:
    """(label, df) with ``facts``: what the rules ask of a label, worked out once per label instead of once per edge."""
    label, df = F.col("label"), F.col("df")
    facts = F.struct(is_valid_parent(label, df, min_df).alias("valid"), parent_validity(label, df, min_df).alias("validity"), X.is_low_quality_label(label).alias("low"), F.array_distinct(X.tokens(label)).alias("words"), F.size(X.tokens(label)).alias("n"))
    return labels.select("label", "df", facts.alias("facts"))


def shared_words(parent: Column, child: Column) -> Column:
    """Token overlap of two labels by their facts."""
    x, y = parent["words"], child["words"]
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def rejection_reason(parent: Column, child: Column, score: Column, method: Column, evidence: Column, min_score: Column, recovery: bool = False) -> Column:
    """ED-07: first reason to reject an edge, or null. ``parent`` and ``child`` are the facts of the labels."""
    valid, validity = parent["valid"], parent["validity"]
    semantic, sim, lex = semantic_score(evidence), evidence_max(evidence, "similarity"), evidence_max(evidence, "lexical_similarity")
    shared = F.greatest(lex, shared_words(parent, child))
    np_, nc = parent["n"], child["n"]
    bridge, anchor = method.isin("component_bridge", "component_anchor_bridge"), method == "component_anchor_bridge"
    weak = method.isin(*L.RECOVERY_METHODS) if recovery else F.lit(False)
    lone_ok = (bridge & (score >= 0.72) & (semantic >= 0.60)) | (anchor & (sim >= 0.62) & (lex >= 0.28) & (score >= 0.60)) | (weak & (sim >= 0.60) & (lex >= 0.22) & (score >= 0.58))
    floor = F.when(weak, F.greatest(F.lit(0.42), 0.55 - 0.08 * F.greatest(F.lit(0.0), validity - 0.5) - 0.10 * F.greatest(F.lit(0.0), sim - 0.5) - 0.06 * F.greatest(F.lit(0.0), shared - 0.2))).otherwise(0.55)
    kept = (
        (bridge & (score >= 0.68)) | (anchor & (sim >= 0.58) & (lex >= 0.18)) | (method.isin("hearst", "hearst_trigger_fallback") & (sim >= 0.16) & (score >= 0.56))
        | (F.lit(recovery) & anchor & (validity >= 0.55) & (sim >= 0.50) & (shared >= 0.12) & (score >= 0.54))
        | (weak & (sim >= 0.60) & (shared >= 0.22) & (score >= 0.58))
    )
    return (
        F.when(~valid, "invalid_parent_label")
        .when(validity < 0.42, "low_parent_validity")
        .when(parent["low"] | child["low"], "low_quality_label")
        .when((np_ == 1) & (nc == 1) & ~lone_ok, "single_to_single")
        .when(np_ > nc + 1, "parent_too_long")
        .when(score < min_score, "score_below_threshold")
        .when((semantic > 0) & (semantic < floor) & ~kept, "low_semantic_evidence")
    )


def connectivity_min_score(method: Column, base: Column) -> Column:
    """ED-08: threshold of the connectivity methods while connectivity is recovered."""
    return F.when(method.isin(*L.RECOVERY_METHODS), F.greatest(F.lit(0.48), base - 0.05)).otherwise(base)


def method_thresholds(edges: DataFrame, base: float, percent: float) -> DataFrame:
    """AGG-08: (method, threshold, n) from the interpolated percentile of each method's scores."""
    p = F.expr(f"percentile(score, {percent / 100.0}D)")
    agg = edges.groupBy("method").agg(F.count("*").alias("n"), p.alias("p"))
    return agg.select("method", F.when(F.col("n") < 4, base).otherwise(F.greatest(F.lit(0.45), F.least(F.lit(base), F.round("p", 4)))).alias("threshold"), "n")


def min_score(method: Column, threshold: Column, default: float) -> Column:
    """ED-09: the method's own threshold, else the smaller of the default and the connectivity table."""
    table = None
    for name, value in L.CONNECTIVITY_MIN_SCORES.items():
        table = F.when(method == name, min(default, value)) if table is None else table.when(method == name, min(default, value))
    return F.coalesce(threshold, table.otherwise(default))


def with_profile_threshold(edges: DataFrame, profile: DataFrame, fallback: float) -> DataFrame:
    """ED-10: ``threshold`` by (lang, method), else by method, else global, else the fallback.

    ``profile`` has lang, method, threshold; null keys stand for all. It is a table of settings of a few hundred rows.
    """
    one = profile.filter("lang is not null and method is not null").select(F.col("lang").alias("_l"), F.col("method").alias("_m"), F.col("threshold").alias("_t1"))
    two = profile.filter("lang is null and method is not null").select(F.col("method").alias("_m2"), F.col("threshold").alias("_t2"))
    three = profile.filter("lang is null and method is null").agg(F.max("threshold")).scalar()
    code = F.substring(F.lower(F.coalesce("lang", F.lit(""))), 1, 2)
    joined = edges.join(one, (code == F.col("_l")) & (F.col("method") == F.col("_m")), "left").join(two, F.col("method") == F.col("_m2"), "left")
    return joined.withColumn("threshold", F.coalesce("_t1", "_t2", three, F.lit(fallback))).drop("_l", "_m", "_t1", "_m2", "_t2")


def blend(base: Column, ranker: Column, evidence: Column, ranker_alpha: float = 0.45, evidence_alpha: float = 0.15) -> Column:
    """ED-11: base score mixed with the ranker's and the evidence's, where there are such."""
    a, b = min(max(ranker_alpha, 0.0), 1.0), min(max(evidence_alpha, 0.0), 0.4)
    r, e = F.nanvl(ranker, F.lit(None).cast("double")), F.nanvl(evidence, F.lit(None).cast("double"))
    first = F.when(r.isNull(), base).otherwise((1 - a) * base + a * r)
    return clamp(F.when(e.isNull(), first).otherwise((1 - b) * first + b * e))


def bridge_budget(base: int, concepts: int, lcr: float, target: float) -> int:
    """ED-12."""
    return max(base, min(max(8, concepts), int(concepts * (0.8 + 1.8 * max(0.0, target - lcr)))))


def risk(score: Column, validity: Column, lexical: Column, df_gap: Column, rejected: Column) -> Column:
    """ED-15: how much an edge deserves a look."""
    return clamp(0.35 * (1 - F.abs(2 * score - 1)) + 0.25 * F.greatest(F.lit(0.0), 0.55 - validity) + 0.20 * (1 - lexical) + F.when(df_gap < -1, 0.20).otherwise(0.0) + F.when(rejected, 0.10).otherwise(0.0))


def rank_score(parent: Column, child: Column, score: Column, df_parent: Column, df_child: Column) -> Column:
    """GR-07."""
    dp, dc = F.coalesce(df_parent, F.lit(0)), F.coalesce(df_child, F.lit(0))
    shape = F.when(F.size(X.tokens(parent)) <= F.size(X.tokens(child)), 0.05).otherwise(-0.03)
    return score + 0.10 * parent_validity(parent, dp) + shape + 0.02 * F.least(F.lit(5), dp) - 0.01 * F.greatest(F.lit(0), dc - dp)


def edge_features(edges: DataFrame) -> DataFrame:
    """ED-13: the twelve features, from method, score, evidence, df_parent, df_child, parent_facts, child_facts, cooccurrence, parent_degree."""
    p, c = F.col("parent_facts"), F.col("child_facts")
    values = {
        "base_score": F.col("score"), "method_weight": method_weight(F.col("method")), "semantic_similarity": semantic_score(F.col("evidence")),
        "lexical_similarity": F.greatest(shared_words(p, c), evidence_max(F.col("evidence"), "lexical_similarity")), "cooccurrence_support": F.col("cooccurrence"),
        "parent_validity": p["validity"], "df_parent": F.col("df_parent").cast("double"), "df_child": F.col("df_child").cast("double"),
        "df_gap": (F.col("df_parent") - F.col("df_child")).cast("double"), "parent_tokens": p["n"].cast("double"), "child_tokens": c["n"].cast("double"), "parent_degree": F.col("parent_degree").cast("double"),
    }
    return edges.withColumn("features", F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))
