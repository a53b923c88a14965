"""Join helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Equi join in which null keys match each other; the keys of ``right`` are dropped, its other names must differ.

    ``extra`` is a further condition over the columns of both sides.
    """
    renamed = right.select(*[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    joined = left.join(renamed, same if extra is None else same & extra, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__right_{k}" for k in keys])


HOT_PARTS = 32
HOT_ROWS = 100_000
MOST_HOT = 10_000


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Equi join (inner or left) of ``rows``, in which some keys may be very frequent, with ``lookup``, in which they are not.

    Keys with more than ``hot_rows`` rows and more than a 1/``MOST_HOT`` part of all are spread over ``HOT_PARTS`` tasks
    by the columns ``spread_by``; there are fewer than ``MOST_HOT`` such keys by arithmetic, so their list is broadcast.
    Their rows of ``lookup`` are there once in each part. Other column names of the two sides must differ.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    least = F.greatest(F.lit(hot_rows), F.floor(n.agg(F.sum("_n")).scalar() / MOST_HOT))
    hot = n.filter(F.col("_n") > least).select(*keys, F.lit(True).alias("_hot"))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(HOT_PARTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_hot")
    right = lookup.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_part"], how).drop("_part")
