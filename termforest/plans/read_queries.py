"""Queries of the read operators and of the event operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from termforest.functions import lexicon as L
from termforest.operators import relational as R
from termforest.plans import sql as S
from termforest.plans.graph_queries import accepted
from termforest.sources import readers, writers
from termforest.streaming import events as E


def _t(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def concept_search_page(spark, folder):
    """REL-04, TOP-02: second page of ten labels that hold "battery", best first."""
    c = _t(spark, folder, "concepts").filter(R.contains_text("canonical", "Battery")).select("id", "canonical", "score")
    return R.page(c, [F.desc_nulls_last("score"), F.col("id")], 1, 10)


def concept_search_info(spark, folder):
    c = _t(spark, folder, "concepts").filter(R.contains_text("canonical", "Battery"))
    return R.page_info(c, 1, 10)


def latest_version(spark, folder):
    """REL-06: newest READY version of each collection."""
    v = _t(spark, folder, "taxonomy_versions").filter("status = 'READY'")
    return R.latest_by(v, ["collection_id"], "created_at", "id").select("collection_id", "id", "algorithm")


def version_summary_counts(spark, folder):
    """REL-10: links and concepts of each version."""
    v = _t(spark, folder, "taxonomy_versions").select("id", "collection_id", "status")
    v = R.with_count(v, "id", accepted(spark, folder), "grp", "edge_count")
    return R.with_count(v, "collection_id", _t(spark, folder, "concepts"), "collection_id", "concept_count")


def collection_document_counts(spark, folder):
    """REL-11."""
    return R.with_count(_t(spark, folder, "collections").select("id", "name"), "id", _t(spark, folder, "documents"), "collection_id", "document_count")


def concept_detail(spark, folder):
    """JOIN-07: number of parents, children and surface forms of every concept, with its parents' labels."""
    c, e = _t(spark, folder, "concepts").select("id", "canonical", F.size("surface_forms").alias("forms")), accepted(spark, folder)
    labels = c.select(F.col("id").alias("parent"), F.col("canonical").alias("label"))
    up = e.join(labels, "parent").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n_parents"), F.array_join(F.sort_array(F.collect_set("label")), "|").alias("parents"))
    down = e.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return c.join(up, "id", "left").join(down, "id", "left").na.fill(0, ["n_parents", "n_children"]).na.fill("", ["parents"])


def export_edges(spark, folder):
    """SNK-07, JOIN-06."""
    return writers.edge_rows(accepted(spark, folder), _t(spark, folder, "concepts").select("id", F.col("canonical").alias("label")))


def export_nodes(spark, folder):
    """SNK-06, SET-05: ends of links and the concepts that have none."""
    e = accepted(spark, folder)
    ends = e.select(F.col("parent").alias("id")).union(e.select("child")).distinct()
    c = _t(spark, folder, "concepts").select("id", "canonical")
    return c.join(ends.withColumn("linked", F.lit(True)), "id", "left").select("id", "canonical", F.coalesce("linked", F.lit(False)).alias("linked"))


def _decisive_labels(spark, folder):
    d = _t(spark, folder, "taxonomy_edge_labels").filter("candidate_id is not null")
    low = F.lower(F.trim("label"))
    y = F.when(low.isin(*L.POSITIVE_LABELS), 1).when(low.isin(*L.NEGATIVE_LABELS), 0)
    return d.withColumn("y", y).filter("y is not null").groupBy("candidate_id").agg(F.max_by("y", F.struct("created_at", "id")).alias("y"))


def _scored(spark, folder):
    return _t(spark, folder, "taxonomy_edge_candidates").withColumn("score", F.col("final_score")).filter("score is not null and not isnan(score)")


def label_alignment(spark, folder):
    """JOIN-02, MUT-03: candidates whose decision differs from their latest decisive label."""
    c = _t(spark, folder, "taxonomy_edge_candidates").select("id", "decision").join(_decisive_labels(spark, folder), F.col("id") == F.col("candidate_id"))
    aligned = F.when(F.col("y") == 1, "accepted").otherwise("rejected")
    return c.select("id", "decision", aligned.alias("aligned")).filter("decision <> aligned")


def training_set_union(spark, folder):
    """SET-01."""
    return R.training_rows(_scored(spark, folder).select("id", "decision", "score"), _decisive_labels(spark, folder))


def threshold_recompute(spark, folder):
    """AGG-14."""
    lang = F.coalesce(F.nullif(F.lower("lang"), F.lit("")), F.lit("unknown"))
    c = _scored(spark, folder).select("id", lang.alias("lang"), "method", "score")
    return R.recompute_thresholds(c.join(_decisive_labels(spark, folder), F.col("id") == F.col("candidate_id")), ["lang", "method"])


def ranker_training(spark, folder):
    """ED-14/26: accuracy of a trained ranker over the rows it was not fitted on, by label."""
    rows = R.training_rows(_scored(spark, folder).select("id", "decision", "score"), _decisive_labels(spark, folder))
    zero = F.lit(0.0)
    f = _scored(spark, folder).select("id", *[F.coalesce(F.nanvl(c, zero), zero).alias(c) for c in ("base_score", "evidence_score", "risk_score", "score")])
    data = rows.join(f, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(5)))
    names = ["base_score", "evidence_score", "risk_score", "score"]
    model = R.train_ranker(data.filter("part > 0").select("y", "weight", *names), names, 10)
    scored = R.ranker_scores(model, data.filter("part = 0").select("id", "y", "weight", *names), 0.0)
    return scored.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("ranker_score") >= 0.5).cast("int") == F.col("y")).cast("double")), 3).alias("accuracy"))


def reverse_links(spark, folder):
    """JOIN-11: accepted links whose reverse is accepted too."""
    e = accepted(spark, folder)
    back = e.select("grp", F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("score").alias("reverse_score"))
    return e.join(back, ["grp", "parent", "child"]).filter("parent < child").withColumnRenamed("grp", "taxonomy_version_id")


def lang_source_cube(spark, folder):
    """AGG-22: documents and characters by language and source, with all totals."""
    d = _t(spark, folder, "documents").withColumn("l", F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("")))
    agg = d.cube("l", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("g"))
    return agg.select(F.when(F.col("g").bitwiseAND(2) > 0, "*").otherwise(F.col("l")).alias("lang"), F.when(F.col("g").bitwiseAND(1) > 0, "*").otherwise(F.col("source")).alias("source"), "n", "chars")


def documents_chunked(spark, folder):
    """TXT-02/03: chunks of all documents."""
    c = readers.chunk_texts(_t(spark, folder, "documents").select("doc_id", "text"), "text")
    return c.select("doc_id", "chunk_index", "char_start", "char_end", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def hourly_p95_by_type(spark, folder):
    """AGG-19."""
    return E.hourly_percentile(_t(spark, folder, "events")).withColumn("mean", F.round("mean", 6)).withColumn("total", F.round("total", 6)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


def sla_breach_hours(spark, folder):
    """AGG-20."""
    return E.breach_hours(_t(spark, folder, "events"), 60.0)


def traffic_gapfilled(spark, folder):
    """WF-10."""
    return E.filled_traffic(_t(spark, folder, "events")).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


def poison_messages(spark, folder):
    """WF-08: parsed and unparseable properties by type."""
    k = E.parse_props(F.col("props"))["k"]
    return _t(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("parsed"), F.sum(k).alias("sum_k"))


def user_sessions(spark, folder):
    return E.sessions(_t(spark, folder, "events")).withColumn("total", F.round("total", 6)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def job_state_fold(spark, folder):
    """WF-05."""
    return E.latest_state(_t(spark, folder, "events"))


def streaming_event_counts(spark, folder):
    """WF-03: hourly counts read as a stream, all that is there, into a table in memory."""
    name = f"counts_{uuid.uuid4().hex}"
    events = f"{folder}/events.parquet"
    source = spark.readStream.schema(E.EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder if os.path.isfile(events) else events)
    query = E.windowed_counts(source).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


QUERIES = {f.__name__: f for f in (
    concept_search_page, concept_search_info, latest_version, version_summary_counts, collection_document_counts, concept_detail, export_edges, export_nodes, label_alignment,
    training_set_union, threshold_recompute, ranker_training, reverse_links, lang_source_cube, documents_chunked, hourly_p95_by_type, sla_breach_hours, traffic_gapfilled,
    poison_messages, user_sessions, job_state_fold, streaming_event_counts,
)}

_NUM = "CASE WHEN final_score IS NULL OR isnan(final_score) THEN 0 ELSE final_score END"
_E = f"e AS MATERIALIZED (SELECT taxonomy_version_id AS v, parent_concept_id AS p, child_concept_id AS c, max({_NUM}) AS score FROM taxonomy_edge_candidates WHERE decision = 'accepted' AND parent_concept_id IS NOT NULL AND child_concept_id IS NOT NULL GROUP BY ALL)"
_L = f"""f AS (SELECT candidate_id, created_at, id, CASE WHEN lower(trim(label)) IN ({S.quoted(L.POSITIVE_LABELS)}) THEN 1 WHEN lower(trim(label)) IN ({S.quoted(L.NEGATIVE_LABELS)}) THEN 0 END AS y FROM taxonomy_edge_labels WHERE candidate_id IS NOT NULL),
l AS MATERIALIZED (SELECT candidate_id, y FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC) AS k FROM f WHERE y IS NOT NULL) WHERE k = 1),
s AS MATERIALIZED (SELECT id, decision, coalesce(nullif(lower(lang), ''), 'unknown') AS lang, method, final_score AS score FROM taxonomy_edge_candidates WHERE final_score IS NOT NULL AND NOT isnan(final_score))"""
_H = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, quantile_disc(value, 0.95) AS p, avg(value) AS mean, sum(value) AS total, count(*) AS n FROM events GROUP BY ALL"

ORACLE = {
    "concept_search_page": "SELECT id, canonical, score FROM concepts WHERE contains(lower(canonical), 'battery') ORDER BY score DESC NULLS LAST, id LIMIT 10 OFFSET 10",
    "concept_search_info": "SELECT count(*) AS total_elements, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages, 1 AS number, 10 AS size, FALSE AS first, 2 >= ceil(count(*) / 10.0) AS last, 10 >= count(*) AS empty FROM concepts WHERE contains(lower(canonical), 'battery')",
    "latest_version": "SELECT collection_id, id, algorithm FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, id DESC) AS k FROM taxonomy_versions WHERE status = 'READY') WHERE k = 1",
    "version_summary_counts": f"WITH {_E} SELECT id, collection_id, status, (SELECT count(*) FROM e WHERE e.v = t.id) AS edge_count, (SELECT count(*) FROM concepts c WHERE c.collection_id = t.collection_id) AS concept_count FROM taxonomy_versions t",
    "collection_document_counts": "SELECT id, name, (SELECT count(*) FROM documents d WHERE d.collection_id = c.id) AS document_count FROM collections c",
    "concept_detail": f"""WITH {_E}, u AS (SELECT e.c AS id, count(*) AS n, array_to_string(list_sort(list_distinct(list(k.canonical))), '|') AS parents FROM e JOIN concepts k ON k.id = e.p GROUP BY e.c), d AS (SELECT p AS id, count(*) AS n FROM e GROUP BY p)
SELECT c.id, canonical, CAST(len(surface_forms) AS INT) AS forms, coalesce(u.n, 0) AS n_parents, coalesce(parents, '') AS parents, coalesce(d.n, 0) AS n_children FROM concepts c LEFT JOIN u ON u.id = c.id LEFT JOIN d ON d.id = c.id""",
    "export_edges": f"WITH {_E} SELECT p AS parent_id, a.canonical AS parent_label, c AS child_id, b.canonical AS child_label, 'is_a' AS relation, e.score FROM e JOIN concepts a ON a.id = p JOIN concepts b ON b.id = c",
    "export_nodes": f"WITH {_E} SELECT id, canonical, id IN (SELECT p FROM e UNION SELECT c FROM e) AS linked FROM concepts",
    "label_alignment": f"WITH {_L} SELECT c.id, decision, CASE WHEN y = 1 THEN 'accepted' ELSE 'rejected' END AS aligned FROM taxonomy_edge_candidates c JOIN l ON l.candidate_id = c.id WHERE decision <> CASE WHEN y = 1 THEN 'accepted' ELSE 'rejected' END",
    "training_set_union": f"""WITH {_L}, w AS (SELECT id, CASE WHEN decision = 'accepted' AND score >= 0.82 THEN 1 WHEN decision = 'rejected' AND score <= 0.52::DOUBLE THEN 0 END AS y FROM s WHERE id NOT IN (SELECT candidate_id FROM l))
SELECT id, y, 1.0::DOUBLE AS weight FROM s JOIN l ON l.candidate_id = s.id UNION ALL SELECT id, y, 0.45::DOUBLE FROM w WHERE y IS NOT NULL""",
    "threshold_recompute": f"""WITH {_L} SELECT lang, method, count(*) AS n, round(greatest(0.45::DOUBLE, least(0.9::DOUBLE, (median(score) FILTER (WHERE y = 1) + median(score) FILTER (WHERE y = 0)) / 2)), 4) AS threshold
FROM s JOIN l ON l.candidate_id = s.id GROUP BY lang, method HAVING count(*) >= 20 AND count(*) FILTER (WHERE y = 1) >= 5 AND count(*) FILTER (WHERE y = 0) >= 5""",
    "reverse_links": f"WITH {_E} SELECT a.v AS taxonomy_version_id, a.p AS parent, a.c AS child, a.score, b.score AS reverse_score FROM e a JOIN e b ON b.v = a.v AND b.p = a.c AND b.c = a.p WHERE a.p < a.c",
    "lang_source_cube": """WITH d AS (SELECT coalesce(lower(substring(trim(lang), 1, 2)), '') AS l, source, n_chars FROM documents)
SELECT CASE WHEN grouping(l) = 1 THEN '*' ELSE l END AS lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM d GROUP BY CUBE (l, source)""",
    "hourly_p95_by_type": f"SELECT hour, event_type, p, round(mean, 6) AS mean, round(total, 6) AS total, n FROM ({_H})",
    "sla_breach_hours": f"SELECT event_type, count(*) AS hours, count(*) FILTER (WHERE p > 60) AS breaches FROM ({_H}) GROUP BY event_type",
    "traffic_gapfilled": """WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events), g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bucket FROM b),
t AS (SELECT DISTINCT event_type FROM events), n AS (SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(g.bucket, '%Y-%m-%d %H') AS bucket, t.event_type, coalesce(n, 0) AS n FROM g CROSS JOIN t LEFT JOIN n ON n.bucket = g.bucket AND n.event_type = t.event_type""",
    "poison_messages": "SELECT event_type, count(*) AS n, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "user_sessions": """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
    "job_state_fold": "SELECT user_id, last_type, n, top FROM (SELECT user_id, event_type AS last_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE k = 1",
    "streaming_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
