"""Vectors: ``id``, ``vector`` (array of float), ``cluster``. Vectors are taken to have length 1, so a dot product is a cosine."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforest.functions import lexicon as L
from termforest.functions.text import is_low_quality_label, let, token_jaccard, tokens
from termforest.operators.edges import MIN_PARENT_DF
from termforest.operators.joins import spread_join
from termforest.session import cut

MOST_OPTIONS = 5_000_000


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: str | Column) -> Column:
    col = F.col(v) if isinstance(v, str) else v
    # worked out once, not for every place
    return let(F.sqrt(dot(col, col)), lambda size: F.transform(col, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size)))


def centroids(vectors: DataFrame) -> DataFrame:
    """VEC-04: (cluster, centroid) of length 1; sums per dimension are formed before the shuffle."""
    cells = vectors.select("cluster", F.posexplode("vector").alias("d", "x")).groupBy("cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = cells.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    return rows.select("cluster", normalize("c").alias("centroid"))


def label_penalty(words: Column, common: Column) -> Column:
    """VEC-05: what a label loses as a parent, by its words and their mean share of the cluster's labels."""
    one, generic_parent, generic = F.size(words) == 1, F.exists(words, lambda w: w.isin(L.GENERIC_PARENTS)), F.exists(words, lambda w: w.isin(L.GENERIC_LABELS))
    value = F.when(one, 0.28).otherwise(0.0) + F.when(generic_parent, 0.22).otherwise(0.0) + F.when(generic, 0.25).otherwise(0.0) + F.when(common > 0.55, 0.20).otherwise(0.0)
    return F.when(F.size(words) == 0, 1.0).otherwise(value)


def _word_shares(vectors: DataFrame) -> DataFrame:
    """(cluster, label, common): mean share of the cluster's members whose label has a word, over the words of a label."""
    members = vectors.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    sizes = members.groupBy("cluster").agg(F.sum("k").alias("n"))
    words = members.select("cluster", "label", "k", F.explode(tokens("label")).alias("w"))
    share = words.distinct().groupBy("cluster", "w").agg(F.sum("k").alias("c"))
    return words.join(share, ["cluster", "w"]).join(sizes, "cluster").groupBy("cluster", "label").agg(F.avg(F.col("c") / F.col("n")).alias("common"))


def parent_quality(vectors: DataFrame, min_df: int = MIN_PARENT_DF) -> DataFrame:
    """VEC-05: ``vectors`` with ``quality`` as a parent and whether it is ``fit``.

    Score, closeness to the centroid, and, where ``vectors`` have ``label`` and ``df``, the bonus for documents and the
    penalties of the label; without labels every vector is as fit as another.
    """
    joined = vectors.join(centroids(vectors), "cluster")
    quality, fit = F.coalesce("score", F.lit(0.0)) + 0.35 * dot("vector", "centroid"), F.lit(False)
    if {"label", "df"} <= set(vectors.columns):
        joined = joined.join(_word_shares(vectors), ["cluster", "label"], "left")
        df = F.coalesce("df", F.lit(0))
        quality = quality + F.least(F.lit(0.35), 0.06 * df) - label_penalty(tokens("label"), F.col("common"))
        fit = (df >= min_df) & ~is_low_quality_label("label")
    return joined.withColumn("quality", F.round(quality, 6)).withColumn("fit", fit).drop("centroid", "common")


def parent_pool(judged: DataFrame, pool: int = 5) -> DataFrame:
    """VEC-06: the best ``max(pool, min(12, max(2, n // 3)))`` of each cluster, never all of it; of the fit ones alone
    where there are two.

    No more than the largest pool there is goes into a ranking, so a huge cluster is not sorted as a whole.
    """
    sizes = judged.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit"))
    best = Window.partitionBy("cluster", "fit").orderBy(F.desc("quality"), "id")
    front = judged.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= max(pool, 12)).drop("_r").join(sizes, "cluster")
    usable = front.filter(F.col("fit") | (F.col("n_fit") < 2))
    most = F.least(F.greatest(F.lit(pool), F.least(F.lit(12), F.greatest(F.lit(2), F.floor(F.col("n") / 3)))), F.greatest(F.lit(1), F.col("n") - 1))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("quality"), "id"))
    return usable.withColumn("rank", rank).filter(F.col("rank") <= most).drop("n", "n_fit")


def _with_pool(judged: DataFrame, pool: int, columns: list[str]) -> DataFrame:
    """(cluster, child, parent, c_ and p_ ``columns``): the other members of each cluster with every member of its pool."""
    pools = cut(parent_pool(judged, pool).select("cluster", "id", *columns))
    children = judged.join(pools.select("cluster", "id"), ["cluster", "id"], "left_anti")
    c = children.select("cluster", F.col("id").alias("child"), *[F.col(x).alias(f"c_{x}") for x in columns])
    p = pools.select("cluster", F.col("id").alias("parent"), *[F.col(x).alias(f"p_{x}") for x in columns])
    return spread_join(c, p, ["cluster"], ["child"])


def best_parents(vectors: DataFrame, similarity: float = 0.58, percent: float = 45, pool: int = 5) -> DataFrame:
    """VEC-07: (cluster, child, parent, sim, threshold, accepted); the pool of a cluster is at most 12, so pairs stay linear.

    A cluster's threshold is the given percentile of its best similarities, at least ``similarity``.
    """
    judged = cut(parent_quality(vectors).select("cluster", "id", "vector", "quality", "fit"))
    pairs = _with_pool(judged, pool, ["vector"]).select("cluster", "child", "parent", F.round(dot("c_vector", "p_vector"), 6).alias("sim"))
    best = pairs.groupBy("cluster", "child").agg(F.min_by(F.struct("parent", "sim"), F.struct(-F.col("sim"), "parent")).alias("b")).select("cluster", "child", "b.*")
    limit = best.groupBy("cluster").agg(F.greatest(F.lit(similarity), F.expr(f"percentile(sim, {percent / 100}D)")).alias("threshold"))
    return best.join(limit, "cluster").withColumn("accepted", F.col("sim") >= F.col("threshold"))


def option_pairs(vectors: DataFrame, pool: int = 5) -> DataFrame:
    """(cluster, child, parent, sim, jaccard, weak) of every child with its cluster's parent pool; ``vectors`` have labels and df.

    A child of one word in fewer than three documents is weak.
    """
    judged = cut(parent_quality(vectors).select("cluster", "id", "label", "df", "vector", "quality", "fit"))
    pairs = _with_pool(judged, pool, ["label", "df", "vector"]).filter("c_label <> p_label")
    weak = (F.size(tokens("c_label")) == 1) & (F.coalesce("c_df", F.lit(0)) < 3)
    return pairs.select("cluster", "child", "parent", F.round(dot("c_vector", "p_vector"), 6).alias("sim"), token_jaccard("c_label", "p_label").alias("jaccard"), weak.alias("weak"))


def assign_parents(options: list[tuple], threshold: float, cap: int) -> list[tuple[str, str, float, str]]:
    """VEC-08..10 for one cluster: (child, parent, sim, method) from (child, parent, sim, jaccard, weak).

    Children by falling best similarity take the best parent with room, else the best, and straight after it perhaps a
    second one; those left over get a relaxed second chance. Loads decide, so the order matters; ties go to the smaller
    ids. Weak children are passed over.
    """
    by_child: dict[str, list[tuple[float, str, float]]] = {}
    weak = set()
    for child, parent, sim, jaccard, is_weak in options:
        by_child.setdefault(child, []).append((-sim, parent, jaccard))
        weak |= {child} if is_weak else set()
    for listed in by_child.values():
        listed.sort()
    order = [child for _, child in sorted((listed[0][0], child) for child, listed in by_child.items())]
    m, load, out, taken = len(order), Counter(), [], {}

    def take(child: str, parent: str, sim: float, method: str) -> None:
        load[parent] += 1
        taken.setdefault(child, set()).add(parent)
        out.append((child, parent, sim, method))

    def another(child: str, least: float, lexical: float, room: int) -> tuple[str, float] | None:
        return next(((p, -s) for s, p, j in by_child[child] if -s >= least and j >= lexical and load[p] < room and p not in taken.get(child, ())), None)

    seconds = max(1, int(0.12 * m))
    for child in order:
        if len(taken) >= max(6, int(0.9 * m)):
            break
        good = [] if child in weak else [(p, -s) for s, p, _ in by_child[child] if -s >= threshold]
        if good:
            take(child, *next((g for g in good if load[g[0]] < cap), good[0]), "embedding_clustering")
            if seconds and (more := another(child, threshold + 0.06, 0.20, cap + 1)):
                take(child, *more, "embedding_clustering_secondary_parent")
                seconds -= 1
    left = max(2, int(0.18 * m))
    for child in order:
        if left and child not in taken and child not in weak and (more := another(child, max(0.47, threshold - 0.07), 0.16, cap + 2)):
            take(child, *more, "embedding_clustering_relaxed")
            left -= 1
    return out


def embedding_hierarchy(vectors: DataFrame, similarity: float = 0.58, percent: float = 45, cap: int = 6, pool: int = 5) -> DataFrame:
    """VEC-11: (cluster, child, parent, sim, method). A task sees one cluster's children with at most 12 options each."""
    options = cut(option_pairs(vectors, pool))
    over = options.groupBy("cluster").count().filter(F.col("count") > MOST_OPTIONS).limit(1).collect()
    if over:
        raise ValueError(f"a cluster has {over[0]['count']} options; at most {MOST_OPTIONS} are taken")
    best = options.groupBy("cluster", "child").agg(F.max("sim").alias("s")).groupBy("cluster").agg(F.expr(f"percentile(s, {percent / 100}D)").alias("p"))
    rows = options.join(best, "cluster").withColumn("threshold", F.greatest(F.lit(similarity), "p"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        got = assign_parents(list(pdf[["child", "parent", "sim", "jaccard", "weak"]].itertuples(index=False, name=None)), float(pdf["threshold"].iloc[0]), cap)
        return pd.DataFrame([(pdf["cluster"].iloc[0], *r) for r in got], columns=["cluster", "child", "parent", "sim", "method"])

    return rows.groupBy("cluster").applyInPandas(step, "cluster string, child string, parent string, sim double, method string")


def kmeans(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """VEC-03: (id, cluster) by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """VEC-01 fallback: character trigrams hashed into ``size`` places, length 1; no model is needed."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))

    def counted(grams: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: (F.size(grams) - F.size(F.array_remove(grams, d))).cast("double"))

    def places(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - 2)), lambda i: F.pmod(F.xxhash64(F.substring(p, i, 3)), F.lit(size)))

    return let(let(let(padded, places), counted), normalize)
