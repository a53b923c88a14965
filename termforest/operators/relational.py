"""Read operators: latest rows, paging, summaries, exports, samples and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforest.operators.hierarchy import chains_of


def latest_by(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """REL-06: the newest row of each key; at one time the greater tie key. A single aggregation, without a sort."""
    rows = df.select(*[F.col(k) for k in keys], F.struct(*df.columns).alias("_row"))
    newest = rows.groupBy(*keys).agg(F.max_by("_row", F.struct(F.col(f"_row.{time}"), F.col(f"_row.{tie}"))).alias("_row"))
    return newest.select("_row.*")


def with_fallback(rows: DataFrame, settings: DataFrame, key: str, value: str) -> DataFrame:
    """REL-07: ``value`` of the row's key, else the one stored without a key. ``settings`` is a table of settings."""
    default = settings.filter(F.col(key).isNull()).agg(F.max(value)).scalar()
    own = settings.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return rows.join(own, rows[key] == F.col("_k"), "left").withColumn(value, F.coalesce("_v", default)).drop("_k", "_v")


def contains_text(column: str, query: str) -> Column:
    """REL-04: case-insensitive substring."""
    return F.lower(F.col(column)).contains(query.lower())


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """TOP-02: page ``number`` (from 0) of ``size`` rows; the order must be total."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """TOP-02: one row of total_elements, total_pages, number, size, first, last and empty."""
    total = F.count("*")
    pages = F.ceil(total / F.lit(size)).cast("bigint")
    return df.agg(total.alias("total_elements"), pages.alias("total_pages"), F.lit(number).alias("number"), F.lit(size).alias("size"), F.lit(number == 0).alias("first"), (F.lit(number + 1) >= pages).alias("last"), (F.lit(number * size) >= total).alias("empty"))


def with_count(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """REL-10/11: number of rows of ``other`` per key, 0 for none; aggregated before the join."""
    n = other.groupBy(F.col(other_key).alias("_k")).agg(F.count("*").alias(name))
    return df.join(n, F.col(key) == F.col("_k"), "left").drop("_k").na.fill(0, [name])


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """TOP-03: ``n`` random rows by the hash of a key, the same ones at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def training_rows(candidates: DataFrame, labels: DataFrame, positive: float = 0.82, negative: float = 0.52, weak: float = 0.45) -> DataFrame:
    """SET-01 / ED-26: (id, y, weight): labelled candidates with weight 1, and confident unlabelled ones with less.

    ``labels``: candidate_id, y. ``candidates``: id, decision, score.
    """
    manual = candidates.join(labels, candidates["id"] == labels["candidate_id"]).select("id", "y", F.lit(1.0).alias("weight"))
    rest = candidates.join(labels, candidates["id"] == labels["candidate_id"], "left_anti")
    y = F.when((F.col("decision") == "accepted") & (F.col("score") >= positive), 1).when((F.col("decision") == "rejected") & (F.col("score") <= negative), 0)
    return manual.unionByName(rest.select("id", y.alias("y"), F.lit(weak).alias("weight")).filter("y is not null"))


def recompute_thresholds(rows: DataFrame, keys: list[str], least: int = 20, each: int = 5) -> DataFrame:
    """AGG-14 / ED-27: midpoint of the median scores of both labels within .45 to .90, where there is support."""
    pos, neg = F.median(F.when(F.col("y") == 1, F.col("score"))), F.median(F.when(F.col("y") == 0, F.col("score")))
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"), pos.alias("mp"), neg.alias("mn"))
    kept = agg.filter((F.col("n") >= least) & (F.col("n_pos") >= each) & (F.col("n_neg") >= each))
    return kept.select(*keys, "n", F.round(F.greatest(F.lit(0.45), F.least(F.lit(0.90), (F.col("mp") + F.col("mn")) / 2)), 4).alias("threshold"))


def train_ranker(rows: DataFrame, features: list[str], iterations: int = 20):
    """ED-26: weighted gradient-boosted trees over (features, y, weight); returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assemble, GBTClassifier(labelCol="y", weightCol="weight", featuresCol="features", maxIter=iterations, seed=1)]).fit(rows)


def ranker_scores(model, rows: DataFrame, least: float = 0.40) -> DataFrame:
    """ED-14: probability of the positive label; null below the least confidence."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return model.transform(rows).withColumn("ranker_score", F.when(F.greatest(p[0], p[1]) >= least, p[1])).drop("features", "rawPrediction", "probability", "prediction")


def lineage(df: DataFrame, key: str, previous: str) -> DataFrame:
    """MUT-04: (k, origin, steps): the first row each row goes back to, however long ago, by pointer doubling.

    A row whose predecessor is no row of ``df`` goes back to that name; one that goes back to itself has no origin.
    """
    links = df.select(F.lit(0).alias("scope"), F.col(previous).alias("parent"), F.col(key).alias("child")).dropna().distinct()
    found = chains_of(links, False).select(F.col("node").alias("k"), F.col("root").alias("origin"), F.col("depth").alias("steps"))
    own = df.select(F.col(key).alias("k"), F.col(previous).isNull().alias("_first")).dropna(subset=["k"]).distinct()
    return own.join(found, "k", "left").select("k", F.when(F.col("_first"), F.col("k")).otherwise(F.col("origin")).alias("origin"), F.when(F.col("_first"), 0).otherwise(F.col("steps")).alias("steps"))


def first_rank(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows of rank up to ``n`` within their key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
