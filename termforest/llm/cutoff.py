"""Score cutoffs that keep a target fraction of every source.

Records are first reduced to (source, distinct score, weight): the compact frequencies. Their descending cumulative sums
are taken in two steps so that no source has to fit a task: over a bounded number of score buckets per source, and then
over the distinct scores of the one bucket in which the target falls. A bucket that is still too large is cut into
buckets again, so the work of a task stays bounded by ``buckets`` and ``fine_rows`` whatever the distribution.

Input rules: rows with a null or NaN score neither count nor are kept; a null source key groups with other nulls (give
keys their default before); infinite scores are scores like any other; equal scores are kept or dropped together;
repeated rows each count; an empty input, and a source without scored rows, give no row. Columns that are not named are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforest.operators.joins import null_safe_join
from termforest.session import cut

BUCKETS = 4096
FINE_ROWS = 200_000
FINITE = 1.7976931348623157e308


def score_frequencies(df: DataFrame, keys: dict[str, Column], score: Column, weight: Column | None = None) -> DataFrame:
    """Total weight (rows, if no weight is given) per source and distinct score: key columns, ``score``, ``w``."""
    rows = df.select(*[c.alias(k) for k, c in keys.items()], score.cast("double").alias("score"), (F.lit(1) if weight is None else weight).cast("bigint").alias("w"))
    # adding 0.0 makes one of the two zeros
    rows = rows.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("score", F.col("score") + F.lit(0.0))
    return rows.groupBy(*keys, "score").agg(F.sum("w").alias("w"))


def closest_cutoffs(frequencies: DataFrame, targets: DataFrame, keys: list[str], buckets: int = BUCKETS, fine_rows: int = FINE_ROWS) -> DataFrame:
    """For each source the cutoff whose kept share of the weight is closest to ``fraction``.

    ``targets``: the key columns and ``fraction``, one row per source. Result: keys, ``fraction``, ``total``, ``cutoff``
    (null: keep nothing), ``kept``, and ``gap`` (distance of the kept share from the fraction). Of two cutoffs equally
    close the higher one, which keeps less, is taken.
    """
    freq = cut(frequencies)
    totals = freq.groupBy(*keys).agg(F.sum("w").alias("total"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))
    # one row per source: the score range lo..hi still to search, its n distinct scores, and the weight above it
    wanted = targets.select(*keys, F.col("fraction").cast("double").alias("fraction"))
    state = cut(null_safe_join(totals, wanted, keys).select(*keys, "fraction", "total", "lo", "hi", "n", F.lit(0).cast("bigint").alias("above")))
    by = Window.partitionBy(*keys)
    goal = F.col("fraction") * F.col("total")
    inside = F.col("score").between(F.col("lo"), F.col("hi"))
    left = state.agg(F.sum("n")).first()[0]
    while state.filter(F.col("n") > fine_rows).limit(1).count():
        # infinite scores have cells of their own, so what lies between them can always be divided
        lo, hi = F.greatest("lo", F.lit(-FINITE)), F.least("hi", F.lit(FINITE))
        width = hi / buckets - lo / buckets
        inner = F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(buckets), F.floor(F.col("score") / width - lo / width)))).otherwise(F.lit(0))
        cell = F.when(F.col("score") > FINITE, buckets + 1).when(F.col("score") < -FINITE, -1).otherwise(inner)
        cells = (
            null_safe_join(freq, state, keys, extra=inside)
            .withColumn("cell", cell)
            .groupBy(*keys, "fraction", "total", "above", "cell")
            .agg(F.sum("w").alias("w"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))
            .withColumn("upto", F.col("above") + F.sum("w").over(by.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("above", F.col("upto") - F.col("w"))
        )
        # of the cells that reach the goal the highest holds the closest cutoff, or begins at it
        reached = cells.filter((F.col("upto") >= goal) | (F.col("upto") == F.col("total")))
        state = cut(
            reached.withColumn("r", F.row_number().over(by.orderBy(F.desc("cell"))))
            .filter("r = 1")
            .select(*keys, "fraction", "total", "lo", "hi", "n", "above")
        )
        now = state.agg(F.sum("n")).first()[0]
        if now >= left:
            raise ArithmeticError("a score range could not be divided")
        left = now
    gap = F.abs(F.col("kept") - goal) / F.col("total")
    run = F.sum("w").over(by.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    fine = null_safe_join(freq, state, keys, extra=inside).withColumn("kept", F.col("above") + run)
    options = fine.select(*keys, "fraction", "total", F.col("score").alias("cutoff"), "kept")
    # to keep just what lies above the searched range is an option too; its cutoff is the next higher score
    higher = null_safe_join(freq, state.select(*keys, "hi"), keys, extra=F.col("score") > F.col("hi")).groupBy(*keys).agg(F.min("score").alias("cutoff"))
    edge = null_safe_join(state, higher, keys, "left").select(*keys, "fraction", "total", "cutoff", F.col("above").alias("kept"))
    best = F.min_by(F.struct("fraction", "total", "cutoff", "kept", "gap"), F.struct("gap", "kept"))
    return options.unionByName(edge).withColumn("gap", gap).groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
