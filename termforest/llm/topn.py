"""The N highest-scoring items within every group, for groups of any size.

First every (group, item) is reduced to its best record, which spreads even one huge group over all tasks. A histogram
of the scores of each group with more than N items then gives a threshold at or above which at least N of its items
lie; items below it are dropped before the exact ranking.

Groups with more than a 1/``MOST_HOT`` part of all items, of which there are fewer than ``MOST_HOT`` by arithmetic, are
cut by their thresholds where their items lie: histogram cells are summed before they move, and the thresholds are
broadcast. The other items move to their groups, none of which is large, where threshold, cut and ranking meet.

Input rules: rows with a null group or item or a null or NaN score are ignored; of the records of an item the one with
the highest score holds, then the one with the smallest record id; ties between items go to the smaller item; groups
with fewer than N items keep all; repeated rows change nothing; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforest.session import cut

CELLS = 256
MOST_HOT = 10_000


def best_records(df: DataFrame, group: str, item: str, score: str, record: str) -> DataFrame:
    """One row per (group, item): columns ``grp``, ``item``, ``score``, ``record``."""
    rows = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.col(record).alias("record"))
    rows = rows.filter(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.groupBy("grp", "item").agg(F.min_by(F.struct("score", "record"), F.struct(-F.col("score"), "record")).alias("best")).select("grp", "item", "best.*")


def score_thresholds(ranged: DataFrame, n: int, cells: int = CELLS) -> DataFrame:
    """(grp, threshold) of the groups in ``ranged`` (grp, score, lo, hi): at least ``n`` items reach the threshold."""
    width = F.col("hi") / cells - F.col("lo") / cells
    cell = F.when(width > 0, F.floor((F.col("score") - F.col("lo")) / width)).otherwise(F.lit(0))
    histogram = ranged.groupBy("grp", F.coalesce(cell, F.lit(0)).alias("cell")).agg(F.count("*").alias("c"), F.min("score").alias("least"))
    down = Window.partitionBy("grp").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("upto", F.sum("c").over(down)).filter(F.col("upto") >= n).groupBy("grp").agg(F.max("least").alias("threshold"))


def _ranges(best: DataFrame) -> DataFrame:
    return best.groupBy("grp").agg(F.count("*").alias("size"), F.min("score").alias("lo"), F.max("score").alias("hi"))


def top_items(df: DataFrame, group: str, item: str, score: str, record: str, n: int, most_hot: int = MOST_HOT) -> DataFrame:
    """Columns ``grp``, ``item``, ``score``, ``record``, ``rank`` (1..n) of the best ``n`` items of each group."""
    best = cut(best_records(df, group, item, score, record))
    above = F.greatest(F.lit(n), F.floor(F.lit(best.count() / most_hot)))
    hot = cut(_ranges(best).filter(F.col("size") > above))
    limits = score_thresholds(best.join(F.broadcast(hot.select("grp", "lo", "hi")), "grp"), n)
    high = best.join(F.broadcast(limits), "grp").filter("score >= threshold").drop("threshold")
    rest = best.join(F.broadcast(hot.select("grp")), "grp", "left_anti")
    low = score_thresholds(rest.join(_ranges(rest).filter(F.col("size") > n).drop("size"), "grp"), n)
    kept = rest.join(low, "grp", "left").filter("threshold is null or score >= threshold").drop("threshold")
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n) for part in (high, kept)]
    return ranked[0].unionByName(ranked[1])
