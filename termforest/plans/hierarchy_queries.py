"""Queries of the hierarchy operator over the link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforest.operators.hierarchy import all_descendants, find_cycles, links_of, resolve_hierarchy


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    edges = spark.read.parquet(f"{folder}/taxonomy_edge_candidates.parquet")
    return links_of(edges.filter("decision = 'accepted'"), "taxonomy_version_id", "parent_concept_id", "child_concept_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts on a cycle of the accepted links of a version."""
    return find_cycles(_accepted(spark, folder)).select(F.col("scope").alias("taxonomy_version_id"), "cycle_id", F.col("node").alias("concept_id"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth and root of every concept of the accepted links; on or below a cycle from its first node on."""
    nodes = resolve_hierarchy(_accepted(spark, folder)).nodes
    return nodes.select(F.col("scope").alias("taxonomy_version_id"), F.col("node").alias("concept_id"), F.col("root").alias("root_id"), "depth", F.concat_ws("/", "path").alias("path"), "state")


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every (ancestor, descendant) pair of the accepted links with its distance."""
    pairs = all_descendants(resolve_hierarchy(_accepted(spark, folder)))
    return pairs.select(F.col("scope").alias("taxonomy_version_id"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("concept_id"), "distance")


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}

_LINKS = """
links AS (
  SELECT DISTINCT taxonomy_version_id AS v, parent_concept_id AS p, child_concept_id AS c
  FROM taxonomy_edge_candidates
  WHERE decision = 'accepted' AND parent_concept_id IS NOT NULL AND child_concept_id IS NOT NULL
    AND taxonomy_version_id IS NOT NULL),
ups AS (SELECT v, c, min(p) AS p FROM links GROUP BY v, c)"""

# every way up along first parents, until it ends or would come back to itself
_UP = f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT v, c AS start, c AS cur, [c] AS path FROM ups
  UNION ALL
  SELECT w.v, w.start, u.p, list_append(w.path, u.p) FROM walk w JOIN ups u ON u.v = w.v AND u.c = w.cur WHERE NOT list_contains(w.path, u.p))
"""

ORACLE = {
    # all links: a node is on a cycle if a way leads back to it, and hangs together with what lies on such ways
    "p2_found": f"""WITH RECURSIVE {_LINKS},
reach AS (SELECT v, c AS a, p AS b FROM links UNION SELECT r.v, r.a, l.p FROM reach r JOIN links l ON l.v = r.v AND l.c = r.b)
SELECT x.v AS taxonomy_version_id, min(x.b) AS cycle_id, x.a AS concept_id FROM reach x JOIN reach y ON y.v = x.v AND y.a = x.b AND y.b = x.a GROUP BY x.v, x.a""",
    "p2_paths": _UP
    + """,
e AS (SELECT w.*, u.p AS nxt FROM walk w LEFT JOIN ups u ON u.v = w.v AND u.c = w.cur WHERE u.p IS NULL OR list_contains(w.path, u.p)),
k AS (SELECT *, coalesce(list_position(path, nxt), len(path)) AS k FROM e)
SELECT v AS taxonomy_version_id, start AS concept_id, CASE WHEN nxt IS NULL THEN cur ELSE list_min(path[k:]) END AS root_id, CAST(k - 1 AS INT) AS depth, array_to_string(list_reverse(path[1:k]), '/') AS path,
  CASE WHEN nxt IS NULL THEN 'tree' ELSE 'endless' END AS state FROM k
UNION ALL SELECT DISTINCT v, p, p, 0, p, 'tree' FROM links WHERE NOT EXISTS (SELECT 1 FROM links x WHERE x.v = links.v AND x.c = links.p)""",
    "p2_descendants": _UP + "SELECT v AS taxonomy_version_id, cur AS ancestor_id, start AS concept_id, CAST(len(path) - 1 AS INT) AS distance FROM walk WHERE len(path) > 1",
}
