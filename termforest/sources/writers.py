"""Sinks: partitions replaced as a whole, and exports of hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """SNK-01..03: overwrite just the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def edge_rows(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """SNK-07: parent_id, parent_label, child_id, child_label, relation, score; ends that are no concept are left out."""
    p = labels.select(F.col("id").alias("parent_id"), F.col("label").alias("parent_label"))
    c = labels.select(F.col("id").alias("child_id"), F.col("label").alias("child_label"))
    e = edges.select(F.col("parent").alias("parent_id"), F.col("child").alias("child_id"), "score")
    return e.join(p, "parent_id").join(c, "child_id").select("parent_id", "parent_label", "child_id", "child_label", F.lit("is_a").alias("relation"), "score")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_tsv(rows: DataFrame, path: str, score: str = "score") -> None:
    """SNK-08: by falling score."""
    rows.orderBy(F.desc(score)).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
