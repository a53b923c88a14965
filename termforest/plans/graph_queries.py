"""Queries of the edge, graph and evaluation operators over the candidate edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from termforest.functions import lexicon as L
from termforest.functions import text as X
from termforest.operators import edges as E
from termforest.operators import evaluate as V
from termforest.operators import graph as G
from termforest.operators import terms as T
from termforest.plans import sql as S
from termforest.plans.relation_queries import CONTAIN, keyed
from termforest.plans.term_queries import CHUNKS, _FREQ, chunks_of
from termforest.session import cut, store


def candidates(spark, folder):
    return spark.read.parquet(f"{folder}/taxonomy_edge_candidates.parquet")


def accepted(spark, folder):
    """Accepted links of each version with their best score."""
    return G.edges_of(candidates(spark, folder).filter("decision = 'accepted'"), "taxonomy_version_id", "parent_concept_id", "child_concept_id", "final_score")


def _version(df):
    return df.withColumnRenamed("grp", "taxonomy_version_id")


def _label_df(spark, folder):
    """Document frequency of every parent and child label."""
    c = candidates(spark, folder)
    labels = c.select(F.lower("parent_label").alias("term")).union(c.select(F.lower("child_label"))).dropna().distinct()
    return T.term_frequencies(chunks_of(spark, folder), labels)


def _scored(spark, folder):
    """Candidates with the evidence array, their blended score and the facts of their labels."""
    c = candidates(spark, folder)
    facts = cut(E.label_facts(_label_df(spark, folder).select(F.col("term").alias("label"), "df")))
    cooc = F.get_json_object("evidence", "$.cooccurrence_support").cast("double")
    c = c.select("id", "taxonomy_version_id", F.col("parent_label").alias("parent"), F.lower("parent_label").alias("_p"), F.lower("child_label").alias("_c"), "method", "decision", "evidence_score", E.blend(E.number(F.col("base_score")), F.col("ranker_score"), F.col("evidence_score")).alias("score"), F.try_element_at("feature_vector", F.lit("similarity")).alias("_sim"), cooc.alias("cooccurrence"))
    p = facts.select(F.col("label").alias("_p"), F.col("df").alias("df_parent"), F.col("facts").alias("parent_facts"))
    k = facts.select(F.col("label").alias("_c"), F.col("df").alias("df_child"), F.col("facts").alias("child_facts"))
    j = c.join(p, "_p").join(k, "_c")
    none = F.lit(None).cast("double")
    item = F.struct(F.col("method").alias("method"), F.col("_sim").alias("similarity"), none.alias("semantic_similarity"), none.alias("cosine_similarity"), F.col("evidence_score").alias("retrieval_evidence_score"), F.col("cooccurrence").alias("cooccurrence_support"), E.shared_words(F.col("parent_facts"), F.col("child_facts")).alias("lexical_similarity"))
    return j.withColumn("evidence", F.array(item)).drop("_p", "_c", "_sim")


def parent_validity(spark, folder):
    """ED-03/04 of every concept label with its document frequency."""
    labels = spark.read.parquet(f"{folder}/concepts.parquet").select(F.lower("canonical").alias("term")).distinct()
    f = T.term_frequencies(chunks_of(spark, folder), labels)
    return f.select("term", "df", F.round(E.parent_validity(F.col("term"), F.col("df")), 4).alias("validity"), E.is_valid_parent(F.col("term"), F.col("df")).alias("valid"))


def blended_scores(spark, folder):
    """ED-11."""
    c = candidates(spark, folder)
    return c.select("id", F.round(E.blend(E.number(F.col("base_score")), F.col("ranker_score"), F.col("evidence_score")), 9).alias("score"))


def edge_rejection_reasons(spark, folder):
    """ED-05/06/07 of every candidate."""
    s = _scored(spark, folder)
    reason = E.rejection_reason(F.col("parent_facts"), F.col("child_facts"), F.col("score"), F.col("method"), F.col("evidence"), F.lit(0.55))
    return s.select("id", F.coalesce(reason, F.lit("none")).alias("reason"))


def edge_features(spark, folder):
    """ED-13: feature vectors of every candidate."""
    s = _scored(spark, folder)
    degree = s.groupBy("taxonomy_version_id", "parent").agg(F.count("*").alias("parent_degree"))
    f = E.edge_features(s.join(degree, ["taxonomy_version_id", "parent"]))
    return f.select("id", *[F.round(F.col("features")[k], 4).alias(k) for k in ("semantic_similarity", "lexical_similarity", "parent_validity", "df_gap", "parent_degree")])


def risk_scores(spark, folder):
    """ED-15 of every candidate."""
    s = _scored(spark, folder)
    r = E.risk(F.col("score"), F.col("parent_facts")["validity"], E.shared_words(F.col("parent_facts"), F.col("child_facts")), F.col("df_parent") - F.col("df_child"), F.col("decision") == "rejected")
    return s.select("id", F.round(r, 9).alias("risk"))


def edge_min_scores(spark, folder):
    """ED-01/02, ED-08/09: method, weight and least scores of every candidate, without and with recovery."""
    none = F.lit(None).cast("double")
    c = candidates(spark, folder).withColumn("evidence", F.array(F.struct(F.lit(None).cast("string").alias("method")), F.struct("method")))
    c = c.select("id", E.method_of(F.col("evidence")).alias("method"))
    c = c.withColumn("weight", E.method_weight(F.col("method")).cast("double")).withColumn("least", E.min_score(F.col("method"), none, 0.64).cast("double"))
    return c.withColumn("least_in_recovery", F.round(E.connectivity_min_score(F.col("method"), F.col("least")), 6))


def method_thresholds(spark, folder):
    """AGG-08."""
    c = candidates(spark, folder).select("method", F.col("base_score").alias("score")).filter("score is not null and not isnan(score)")
    return E.method_thresholds(c, 0.64, 45)


def profile_thresholds(spark, folder):
    """ED-09/10: threshold of every candidate by a profile of mean accepted scores per language and method."""
    c = candidates(spark, folder).filter("final_score is not null and not isnan(final_score)")
    code = F.substring(F.lower(F.coalesce("lang", F.lit(""))), 1, 2)
    a = c.filter("decision = 'accepted'")
    both = a.groupBy(code.alias("lang"), "method").agg(F.round(F.avg("final_score"), 4).alias("threshold"), F.count("*").alias("n")).filter("n >= 20 and lang <> ''").drop("n")
    one = a.groupBy("method").agg(F.round(F.avg("final_score"), 4).alias("threshold")).select(F.lit(None).cast("string").alias("lang"), "method", "threshold")
    return E.with_profile_threshold(c.select("id", "lang", "method"), both.unionByName(one), 0.64).select("id", "threshold")


def edge_dedupe_merge(spark, folder):
    """GR-05."""
    c = candidates(spark, folder).filter("parent_concept_id is not null and child_concept_id is not null")
    rows = c.select(F.col("taxonomy_version_id").alias("grp"), F.col("parent_concept_id").alias("parent"), F.col("child_concept_id").alias("child"), E.number(F.col("final_score")).alias("score"), F.col("id").alias("seq"), F.col("method").alias("evidence"))
    return _version(G.merge_duplicates(rows)).withColumn("evidence", F.array_join("evidence", "|"))


def _ranked(spark, folder):
    return accepted(spark, folder).withColumn("rank_score", F.col("score"))


def collapse_bidirectional(spark, folder):
    """GR-06 over all scored links, whatever their decision."""
    e = G.edges_of(candidates(spark, folder), "taxonomy_version_id", "parent_concept_id", "child_concept_id", "final_score").withColumn("rank_score", F.col("score"))
    return _version(G.collapse_bidirectional(e)).drop("rank_score")


def connected_components(spark, folder):
    """GR-02."""
    return _version(G.components(accepted(spark, folder)))


def component_ratio(spark, folder):
    """GR-04."""
    return _version(G.largest_component_ratio(G.components(accepted(spark, folder)))).withColumn("ratio", F.round("ratio", 6))


def degree_counts(spark, folder):
    """GR-26."""
    return _version(G.degrees(accepted(spark, folder)))


def cap_children_per_parent(spark, folder):
    """GR-13 / WIN-01 with links above 0.9 protected."""
    e = _ranked(spark, folder).withColumn("safe", F.col("score") >= 0.9)
    return _version(G.limit_children(e, 5, protected="safe")).select("taxonomy_version_id", "parent", "child")


def hierarchy_roots(spark, folder):
    return _version(G.roots(accepted(spark, folder)))


def leaf_edges(spark, folder):
    return _version(G.leaf_edges(accepted(spark, folder))).select("taxonomy_version_id", "parent", "child")


def orphan_concepts(spark, folder):
    """SET-03: concepts of a version's collection without an accepted link in it."""
    v = spark.read.parquet(f"{folder}/taxonomy_versions.parquet").select(F.col("id").alias("grp"), "collection_id")
    c = spark.read.parquet(f"{folder}/concepts.parquet").select("collection_id", F.col("id").alias("node"))
    return _version(G.orphans(v.join(c, "collection_id"), accepted(spark, folder)))


def bfs_depths(spark, folder):
    """Breadth-first depths of the nodes that a root reaches."""
    return _version(G.depths(accepted(spark, folder)))


def depth_limited_edges(spark, folder):
    """GR-09."""
    return _version(G.limit_depth(accepted(spark, folder), 3)).select("taxonomy_version_id", "parent", "child")


def tree_paths(spark, folder):
    """GR-24."""
    return _version(G.tree_rows(accepted(spark, folder))).withColumn("path", F.array_join("path", "/"))


def tree_stats(spark, folder):
    """GR-25: nodes, counted once per path, and depth, a leaf alone being 1."""
    return _version(G.tree_rows(accepted(spark, folder)).groupBy("grp").agg(F.count("*").alias("n_nodes"), (F.max("depth") + 1).alias("max_depth")))


def _nodes(spark, folder):
    v = spark.read.parquet(f"{folder}/taxonomy_versions.parquet").select(F.col("id").alias("grp"), "collection_id")
    c = spark.read.parquet(f"{folder}/concepts.parquet").select("collection_id", F.col("id").alias("node"), "canonical", X.normalize_lang(F.coalesce("lang", F.lit(""))).alias("lang"))
    return v.join(c, "collection_id").drop("collection_id")


def graph_quality(spark, folder):
    """EV-01 and ED-25 per version."""
    e, n = cut(accepted(spark, folder)), _nodes(spark, folder)
    ends = G.nodes_of(e).join(n, ["grp", "node"])
    noise = ends.filter(X.is_low_quality_label("canonical")).groupBy("grp").agg(F.count("*").alias("n_noise"))
    q = G.graph_quality(e, n, noise).withColumn("violations", F.array_join(G.violations(), ","))
    return _version(q.select("grp", "n", "n_edges", "n_components", *[F.round(c, 6).alias(c) for c in ("edge_density", "largest_component_ratio", "hubness", "lexical_noise_rate")], "violations"))


def structural_report(spark, folder):
    """EV-02 per version and language."""
    e = cut(accepted(spark, folder))
    return _version(V.structure(_nodes(spark, folder), e, G.depths(e))).withColumn("lang", F.coalesce("lang", F.lit("all")))


def edge_confidence_stats(spark, folder):
    c = candidates(spark, folder).filter("decision = 'accepted'").withColumn("score", F.col("final_score"))
    return V.confidence_stats(c, ["taxonomy_version_id"])


def method_distribution(spark, folder):
    c = candidates(spark, folder).filter("decision = 'accepted'").withColumn("evidence", F.array(F.struct(F.col("method").alias("method"))))
    return V.method_distribution(c, ["taxonomy_version_id"])


def _judged(spark, folder):
    """(edges, linked, concepts, homes): accepted links, their ends that are concepts, every concept of a collection with
    the document frequency of its label there and whether it is a candidate, and the collection of each version.

    Versions share the concepts of their collection, so only those with a link are there once for each version.
    """
    chunks, labels = keyed(spark, folder)
    df = T.phrase_frequencies(chunks, labels, ("collection_id",)).select("collection_id", "term", "df")
    homes = spark.read.parquet(f"{folder}/taxonomy_versions.parquet").select(F.col("id").alias("grp"), F.col("collection_id").alias("home"))
    c = spark.read.parquet(f"{folder}/concepts.parquet").select("collection_id", F.col("id").alias("node"), "canonical", F.lower("canonical").alias("term"), X.normalize_lang(F.coalesce("lang", F.lit(""))).alias("lang"))
    concepts = store(V.candidate_nodes(c.join(df, ["collection_id", "term"], "left").withColumnRenamed("collection_id", "home").drop("term").na.fill(0, ["df"])))
    e = cut(accepted(spark, folder))
    return e, cut(G.nodes_of(e).join(homes, "grp").join(concepts, ["home", "node"]).drop("home")), concepts, homes


def _totals(concepts, homes):
    """(grp, n_rows, n_nodes, n_candidates) of every version."""
    per = concepts.groupBy("home").agg(F.count("*").alias("n_rows"), F.count_distinct("node").alias("n_nodes"), F.count_if("candidate").alias("n_candidates"))
    return homes.join(per, "home").groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_nodes", "n_candidates")])


def _inner(e, n):
    """Edges between nodes."""
    known = n.select("grp", "node")
    return e.join(known.withColumnRenamed("node", "parent"), ["grp", "parent"], "left_semi").join(known.withColumnRenamed("node", "child"), ["grp", "child"], "left_semi")


def fragmentation_risk(spark, folder):
    """EV-05 per version."""
    e, n, concepts, homes = _judged(spark, folder)
    return _version(V.fragmentation(G.parts_of(_inner(e, n)), e, n, totals=_totals(concepts, homes)))


def candidate_coverage(spark, folder):
    """EV-10, SET-04 per version."""
    e, n, concepts, homes = _judged(spark, folder)
    return _version(V.coverage(n, e, _totals(concepts, homes))).withColumn("coverage", F.round("coverage", 6)).withColumn("coverage_candidates", F.round("coverage_candidates", 6))


def connectivity_report(spark, folder):
    """EV-04: the graph measures of every version for all and candidate concepts, overall and by language."""
    return _connectivity(*_judged(spark, folder))


def _connectivity(e, n, concepts, homes):
    se, sn = (cut(x) for x in V.connectivity_slices(e, n))
    ends = G.nodes_of(se).join(sn, ["grp", "node"])
    noise = ends.filter(X.is_low_quality_label("canonical")).groupBy("grp").agg(F.count("*").alias("n_noise"))
    at_home = V.connectivity_slices(e, concepts.withColumnRenamed("home", "grp"))[1].groupBy("grp.grp", "grp.slice").agg(F.count_distinct("node").alias("n"))
    counts = at_home.withColumnRenamed("grp", "home").join(homes, "home").groupBy(F.struct("grp", "slice").alias("grp")).agg(F.sum("n").alias("n"))
    q = G.graph_quality(se, None, noise, counts)
    return q.select(F.col("grp.grp").alias("taxonomy_version_id"), F.col("grp.slice").alias("slice"), "n", "n_edges", "n_components", *[F.round(c, 6).alias(c) for c in ("edge_density", "largest_component_ratio", "hubness", "lexical_noise_rate")])


def _labels_last(spark, folder):
    d = spark.read.parquet(f"{folder}/taxonomy_edge_labels.parquet").filter("candidate_id is not null")
    low = F.lower(F.trim("label"))
    flag = F.when(low.isin(*L.POSITIVE_LABELS), True).when(low.isin(*L.NEGATIVE_LABELS), False)
    return d.withColumn("flag", flag).filter("flag is not null").groupBy("candidate_id").agg(F.max_by("flag", F.struct("created_at", "id")).alias("approved"))


def manual_review_rates(spark, folder):
    """EV-06: candidates with their latest decisive label."""
    c = candidates(spark, folder).select(F.col("id").alias("candidate_id"), "method")
    return V.review_rates(c.join(_labels_last(spark, folder), "candidate_id", "left"), ["method"])


def _reviews(spark, folder):
    c = candidates(spark, folder).select(F.col("id").alias("candidate_id"), F.col("taxonomy_version_id").alias("grp"))
    return V.review_rates(c.join(_labels_last(spark, folder), "candidate_id", "left").dropna(subset=["grp"]), ["grp"])


def _reviewed(spark, folder):
    """As :func:`_reviews`, but of candidates with a label only: the others are not shuffled to the labels."""
    labelled = spark.read.parquet(f"{folder}/taxonomy_edge_labels.parquet").select("candidate_id").dropna()
    may_be = T.sieve(labelled, "candidate_id")
    c = candidates(spark, folder).select(F.col("id").alias("candidate_id"), F.col("taxonomy_version_id").alias("grp")).filter(may_be(F.col("candidate_id")))
    return V.review_rates(c.join(_labels_last(spark, folder), "candidate_id").dropna(subset=["grp"]), ["grp"])


def cross_lang_consistency(spark, folder):
    return V.cross_language(candidates(spark, folder).filter("decision = 'accepted'"))


def _scores(e, n, totals, parts, reviews, risk=None):
    largest = G.largest_component_ratio(parts).select("grp", "largest")
    lcr = totals.join(largest, "grp", "left").select("grp", F.try_divide(F.coalesce("largest", F.lit(1)), F.col("n_nodes")).alias("lcr"))
    hub = _inner(e, n).groupBy("grp", "parent").agg(F.count("*").alias("c")).groupBy("grp").agg((F.max("c") / F.median("c")).alias("hub"))
    wrong = reviews.select("grp", F.coalesce(F.try_divide(F.col("rejected"), F.col("reviewed")), F.lit(0.0)).alias("disagreement"))
    risk = V.fragmentation(parts, e, n, totals=totals) if risk is None else risk
    # a graph without edges has no component of its own, so the largest one counts nothing
    j = V.coverage(n, e, totals).join(risk, "grp").join(lcr, "grp").join(hub, "grp", "left").join(wrong, "grp", "left")
    zero = F.lit(0.0)
    score = V.quality_score(F.col("coverage_candidates"), F.when(F.col("hub").isNull(), 0.0).otherwise(F.col("lcr")), F.col("fragmentation"), F.col("weak_share"), F.coalesce("hub", zero), F.coalesce("disagreement", zero))
    return j.select("grp", score.alias("quality"))


def version_quality_scores(spark, folder):
    """EV-08 per version."""
    e, n, concepts, homes = _judged(spark, folder)
    return _version(_scores(e, n, _totals(concepts, homes), cut(G.parts_of(_inner(e, n))), _reviewed(spark, folder))).withColumn("quality", F.round("quality", 2))


def active_learning_summary(spark, folder):
    """EV-09, AGG-21 per version."""
    labels = spark.read.parquet(f"{folder}/taxonomy_edge_labels.parquet")
    return V.active_learning(candidates(spark, folder), labels, "taxonomy_version_id").drop("top")


def top_rejection_reasons(spark, folder):
    """AGG-17 per version."""
    return V.top_rejections(candidates(spark, folder), ["taxonomy_version_id"])


def quality_reports(spark, folder):
    """EV-11, SNK-05: one JSON report per version."""
    e, n, concepts, homes = _judged(spark, folder)
    reviews, totals, parts = cut(_reviews(spark, folder)), cut(_totals(concepts, homes)), cut(G.parts_of(_inner(e, n)))
    risk = cut(V.fragmentation(parts, e, n, totals=totals))
    back = lambda df: df.withColumnRenamed("taxonomy_version_id", "grp")
    langs = homes.join(concepts.groupBy("home", "lang").agg(F.count("*").alias("n")), "home").select("grp", "lang", "n")
    alone = langs.unionByName(n.groupBy("grp", "lang").agg((-F.count("*")).alias("n"))).groupBy("grp", "lang").agg(F.sum("n").alias("n")).filter("n > 0")
    structure = V.structure(n.select("grp", "node", "lang"), e, G.depths(e), alone).withColumn("meets_coverage", F.col("coverage") >= 0.45)
    sections = {
        "structural": structure, "graph_connectivity": back(_connectivity(e, n, concepts, homes)), "edge_confidence": back(edge_confidence_stats(spark, folder)), "methods": back(method_distribution(spark, folder)),
        "risk": risk, "manual_review": reviews, "active_learning": back(V.active_learning(candidates(spark, folder), spark.read.parquet(f"{folder}/taxonomy_edge_labels.parquet"), "taxonomy_version_id")),
        "quality_score_10": _scores(e, n, totals, parts, reviews, risk),
    }
    return _version(V.assemble(sections, totals))


def active_learning_topk(spark, folder):
    """SNK-04 / AGG-21: the 200 candidates of highest risk (a report of that size)."""
    return candidates(spark, folder).filter("risk_score is not null and not isnan(risk_score)").orderBy(F.desc("risk_score"), "id").limit(200).select("id", "risk_score", "decision")


def rejection_reason_counts(spark, folder):
    return V.rejection_counts(candidates(spark, folder), ["taxonomy_version_id"])


QUERIES = {f.__name__: f for f in (
    edge_min_scores, parent_validity, blended_scores, edge_rejection_reasons, edge_features, risk_scores, method_thresholds, profile_thresholds, edge_dedupe_merge, collapse_bidirectional,
    connected_components, component_ratio, degree_counts, cap_children_per_parent, hierarchy_roots, leaf_edges, orphan_concepts, bfs_depths, depth_limited_edges, tree_paths,
    tree_stats, graph_quality, structural_report, edge_confidence_stats, method_distribution, fragmentation_risk, manual_review_rates, cross_lang_consistency,
    version_quality_scores, active_learning_topk, rejection_reason_counts, candidate_coverage, connectivity_report, active_learning_summary, top_rejection_reasons, quality_reports,
)}

_NUM = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END"
_EDGES = "e AS MATERIALIZED (SELECT taxonomy_version_id AS v, parent_concept_id AS p, child_concept_id AS c, max(" + _NUM.format("final_score") + ") AS score FROM taxonomy_edge_candidates WHERE {0} AND parent_concept_id IS NOT NULL AND child_concept_id IS NOT NULL GROUP BY ALL)"
_ACC = _EDGES.format("decision = 'accepted'")
_NODES = f"nodes AS MATERIALIZED (SELECT v.id AS v, c.id AS n, canonical, {S.normal_lang('coalesce(c.lang, chr(32))')} AS lang FROM taxonomy_versions v JOIN concepts c ON c.collection_id = v.collection_id)"
_UND = "l AS MATERIALIZED (SELECT v, p AS a, c AS b FROM e UNION SELECT v, c, p FROM e)"
_REACH = "reach AS (SELECT DISTINCT v, a AS n, a AS m FROM l UNION SELECT r.v, r.n, l.b FROM reach r JOIN l ON l.v = r.v AND l.a = r.m)"
_PARTS = "parts AS MATERIALIZED (SELECT v, n, min(m) AS component FROM reach GROUP BY v, n)"
_COMP = f"WITH RECURSIVE {_ACC}, {_UND}, {_REACH}, {_PARTS}"
_WALK = """walk AS (SELECT DISTINCT v, p AS root, p AS n, 0 AS depth, [p] AS path FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.v = e.v AND k.c = e.p)
  UNION ALL SELECT w.v, w.root, e.c, w.depth + 1, list_append(w.path, e.c) FROM walk w JOIN e ON e.v = w.v AND e.p = w.n WHERE NOT list_contains(w.path, e.c))"""


_LAST = f"""lab AS (SELECT candidate_id, created_at, id, CASE WHEN lower(trim(label)) IN ({S.quoted(L.POSITIVE_LABELS)}) THEN TRUE WHEN lower(trim(label)) IN ({S.quoted(L.NEGATIVE_LABELS)}) THEN FALSE END AS flag FROM taxonomy_edge_labels WHERE candidate_id IS NOT NULL),
last AS (SELECT candidate_id, flag FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC) AS k FROM lab WHERE flag IS NOT NULL) WHERE k = 1)"""
# concepts of every version with their document frequency and whether they are candidates
_JUDGED = CONTAIN.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_ACC}, {_NODES}, fq AS (SELECT collection_id, term, count(DISTINCT document_id) AS df FROM pres GROUP BY ALL),
cn AS (SELECT canonical, {S.candidate('canonical')} AS cand FROM (SELECT DISTINCT canonical FROM concepts)), lowq AS MATERIALIZED (SELECT canonical FROM cn WHERE {S.low_quality('cand')}),
j AS MATERIALIZED (SELECT nodes.v, nodes.n, nodes.canonical, nodes.lang, coalesce(df, 0) AS df, coalesce(df, 0) >= 2 AND nodes.canonical NOT IN (SELECT canonical FROM lowq) AS cand
  FROM nodes JOIN concepts k ON k.id = nodes.n LEFT JOIN fq ON fq.collection_id = k.collection_id AND fq.term = lower(k.canonical)),
ie AS MATERIALIZED (SELECT e.* FROM e JOIN j a ON a.v = e.v AND a.n = e.p JOIN j b ON b.v = e.v AND b.n = e.c)"""
_COVER = " cover AS (SELECT j.v, count(x.n)::DOUBLE / count(*) AS coverage, coalesce(count(x.n) FILTER (WHERE cand)::DOUBLE / nullif(count(*) FILTER (WHERE cand), 0), 0) AS coverage_candidates FROM j LEFT JOIN (SELECT v, p AS n FROM e UNION SELECT v, c FROM e) x ON x.v = j.v AND x.n = j.n GROUP BY j.v) "
_TOK = [S.tokens("pl"), S.tokens("cl")]
_RISK = f""", iu AS MATERIALIZED (SELECT v, p AS a, c AS b FROM ie UNION SELECT v, c, p FROM ie), reach AS (SELECT v, n, n AS m FROM j UNION SELECT r.v, r.n, iu.b FROM reach r JOIN iu ON iu.v = r.v AND iu.a = r.m),
sizes AS MATERIALIZED (SELECT v, g, count(*) AS k FROM (SELECT v, n, min(m) AS g FROM reach GROUP BY v, n) GROUP BY ALL), wk AS (SELECT v, count(*) AS n_weak FROM ie WHERE score <= 0.62::DOUBLE GROUP BY v), te AS (SELECT v, count(*) AS n FROM e GROUP BY v),
rk AS (SELECT v, count(*) AS n_risky FROM (SELECT ie.v, a.canonical AS pl, b.canonical AS cl, a.df AS pd, b.df AS cd FROM ie JOIN j a ON a.v = ie.v AND a.n = ie.p JOIN j b ON b.v = ie.v AND b.n = ie.c WHERE score <= 0.62::DOUBLE)
  WHERE (len({_TOK[0]}) > len({_TOK[1]}) AND len({_TOK[1]}) > 0 AND list_has_all({_TOK[0]}, {_TOK[1]})) OR (cd >= pd + 2 AND len({_TOK[1]}) <= len({_TOK[0]})) GROUP BY v),
risk AS MATERIALIZED (SELECT s.v, count(*) AS n_components, count(*) FILTER (WHERE k <= 2) AS n_small, count(*) FILTER (WHERE k = 1) AS n_isolated, round(count(*)::DOUBLE / sum(k), 4) AS fragmentation, round(coalesce(sum(k) FILTER (WHERE k <= 2), 0)::DOUBLE / sum(k), 4) AS small_share,
  coalesce(any_value(n_weak), 0) AS n_weak, round(coalesce(coalesce(any_value(n_weak), 0)::DOUBLE / any_value(te.n), 0), 4) AS weak_share, coalesce(any_value(n_risky), 0) AS n_risky, round(coalesce(coalesce(any_value(n_risky), 0)::DOUBLE / any_value(te.n), 0), 4) AS risky_share
  FROM sizes s LEFT JOIN wk ON wk.v = s.v LEFT JOIN rk ON rk.v = s.v LEFT JOIN te ON te.v = s.v GROUP BY s.v) """
# depths by breadth first, a node once
_NEAR = """d(v, n, depth) USING KEY (v, n) AS (SELECT DISTINCT v, p, 0 FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.v = e.v AND k.c = e.p)
  UNION SELECT DISTINCT e.v, e.c, d.depth + 1 FROM d JOIN e ON e.v = d.v AND e.p = d.n LEFT JOIN recurring.d AS old ON old.v = e.v AND old.n = e.c WHERE old.n IS NULL)"""


def _validity(t: str, df: str) -> tuple[str, str]:
    w = S.tokens(t)
    verb = f"len(list_filter({w}, lambda k: NOT regexp_matches(k, '(?:{'|'.join(L.VERBISH_SUFFIXES)})$'))) = 0"
    norm = f"array_to_string({w}, ' ')"
    phrase = " OR ".join(f"contains({norm}, '{p}')" for p in L.BAD_PARENT_PHRASES if " " in p)
    bad, func = S.quoted(L.BAD_PARENT_SINGLES), S.quoted(L.FUNCTIONAL_PARENTS)
    score = f"""CASE WHEN len({w}) = 0 OR {norm} IN ({S.quoted(L.BAD_PARENT_PHRASES)}) THEN 0 ELSE greatest(0, least(1, 1.0::DOUBLE - CASE WHEN {phrase} THEN 0.5::DOUBLE ELSE 0 END
      - 0.45::DOUBLE * len(list_filter({w}, lambda k: k IN ({func}))) / greatest(1, len({w}))
      - CASE WHEN len({w}) = 1 THEN CASE WHEN {w}[1] IN ({bad}) THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN length({w}[1]) < 4 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {df} < 3 THEN 0.25::DOUBLE ELSE 0 END ELSE 0 END
      - CASE WHEN len({w}) <= 2 AND {verb} THEN 0.45::DOUBLE ELSE 0 END - CASE WHEN len({w}) > 5 THEN 0.25::DOUBLE ELSE 0 END)) END"""
    valid = f"""NOT (len({w}) = 0 OR {norm} IN ({S.quoted(L.BAD_PARENT_PHRASES)}) OR {phrase} OR (len({w}) = 1 AND ({w}[1] IN ({bad}) OR length({w}[1]) < 4 OR {df} < 3))
      OR (len({w}) = 2 AND len(list_filter({w}, lambda k: k IN ({bad}))) > 0) OR (len({w}) <= 2 AND {verb}))"""
    return score, valid


_BASE = _NUM.format("base_score")
_RK = "(CASE WHEN ranker_score IS NULL OR isnan(ranker_score) THEN {b} ELSE 0.55::DOUBLE * ({b}) + 0.45::DOUBLE * ranker_score END)".format(b=_BASE)
_BLEND = f"greatest(0, least(1, CASE WHEN evidence_score IS NULL OR isnan(evidence_score) THEN {_RK} ELSE 0.85::DOUBLE * {_RK} + 0.15::DOUBLE * evidence_score END))"
_JAC = "coalesce(len(list_intersect(wp, wc))::DOUBLE / nullif(len(list_distinct(list_concat(wp, wc))), 0), 0)"
_V, _OK = _validity("parent", "dp")
_SCORED = f"""WITH {CHUNKS}, labels AS (SELECT DISTINCT lower(parent_label) AS term FROM taxonomy_edge_candidates WHERE parent_label IS NOT NULL UNION SELECT DISTINCT lower(child_label) FROM taxonomy_edge_candidates WHERE child_label IS NOT NULL),
{_FREQ},
q AS MATERIALIZED (SELECT term, df, {S.tokens('term')} AS w, {S.candidate('term')} AS cand FROM freq),
lq AS MATERIALIZED (SELECT term, df, w, {S.low_quality('cand')} AS low FROM q),
val AS MATERIALIZED (SELECT term, {_validity('term', 'df')[0]} AS validity, {_validity('term', 'df')[1]} AS valid FROM freq),
c AS MATERIALIZED (SELECT id, taxonomy_version_id AS v, parent_label, method, decision, {_BLEND} AS score, {_NUM.format('evidence_score')} AS ev, {_NUM.format("feature_vector['similarity']")} AS sim,
  {_NUM.format("CAST(json_extract_string(evidence, '$.cooccurrence_support') AS DOUBLE)")} AS cooc, validity, valid, p.df AS dp, k.df AS dc, list_distinct(p.w) AS wp, list_distinct(k.w) AS wc, len(p.w) AS np, len(k.w) AS nc, p.low OR k.low AS low
  FROM taxonomy_edge_candidates t JOIN lq p ON p.term = lower(parent_label) JOIN lq k ON k.term = lower(child_label) JOIN val ON val.term = p.term),
s AS MATERIALIZED (SELECT *, {_JAC} AS lex, CASE WHEN ev > 0 THEN greatest(ev, 0.82::DOUBLE * ev + 0.12::DOUBLE * {_JAC} + 0.06::DOUBLE * cooc) ELSE 0 END AS sem FROM c)"""

ORACLE = {
    "parent_validity": f"WITH {CHUNKS}, labels AS (SELECT DISTINCT lower(canonical) AS term FROM concepts), {_FREQ} SELECT term, df, round({_validity('term', 'df')[0]}, 4) AS validity, {_validity('term', 'df')[1]} AS valid FROM freq",
    "blended_scores": f"SELECT id, round({_BLEND}, 9) AS score FROM taxonomy_edge_candidates",
    "edge_rejection_reasons": _SCORED + """
SELECT id, CASE WHEN NOT valid THEN 'invalid_parent_label' WHEN validity < 0.42 THEN 'low_parent_validity' WHEN low THEN 'low_quality_label'
  WHEN np = 1 AND nc = 1 AND NOT ((method IN ('component_bridge', 'component_anchor_bridge') AND score >= 0.72 AND sem >= 0.6) OR (method = 'component_anchor_bridge' AND sim >= 0.62 AND lex >= 0.28 AND score >= 0.6)) THEN 'single_to_single'
  WHEN np > nc + 1 THEN 'parent_too_long' WHEN score < 0.55::DOUBLE THEN 'score_below_threshold'
  WHEN sem > 0 AND sem < 0.55::DOUBLE AND NOT ((method IN ('component_bridge', 'component_anchor_bridge') AND score >= 0.68) OR (method = 'component_anchor_bridge' AND sim >= 0.58 AND lex >= 0.18)
    OR (method IN ('hearst', 'hearst_trigger_fallback') AND sim >= 0.16 AND score >= 0.56)) THEN 'low_semantic_evidence' ELSE 'none' END AS reason FROM s""",
    "edge_features": _SCORED + """
SELECT id, round(sem, 4) AS semantic_similarity, round(lex, 4) AS lexical_similarity, round(validity, 4) AS parent_validity, (dp - dc)::DOUBLE AS df_gap, (count(*) OVER (PARTITION BY v, parent_label))::DOUBLE AS parent_degree FROM s""",
    "risk_scores": _SCORED + """
SELECT id, round(greatest(0, least(1, 0.35::DOUBLE * (1 - abs(2 * score - 1)) + 0.25::DOUBLE * greatest(0, 0.55::DOUBLE - validity) + 0.2::DOUBLE * (1 - lex) + CASE WHEN dp - dc < -1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN decision = 'rejected' THEN 0.1::DOUBLE ELSE 0 END)), 9) AS risk FROM s""",
    "edge_min_scores": f"""WITH m AS (SELECT id, CASE WHEN length(method) > 0 THEN method ELSE 'unknown' END AS method FROM taxonomy_edge_candidates), w AS (SELECT id, method, CASE lower(method) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.METHOD_WEIGHTS.items())} ELSE {L.OTHER_METHOD_WEIGHT} END::DOUBLE AS weight,
  CASE method {' '.join(f"WHEN '{k}' THEN {min(0.64, v)}" for k, v in L.CONNECTIVITY_MIN_SCORES.items())} ELSE 0.64 END::DOUBLE AS least FROM m)
SELECT id, method, weight, least, round(CASE WHEN method IN ({S.quoted(L.RECOVERY_METHODS)}) THEN greatest(0.48::DOUBLE, least - 0.05::DOUBLE) ELSE least END, 6) AS least_in_recovery FROM w""",
    "method_thresholds": "SELECT method, CASE WHEN count(*) < 4 THEN 0.64::DOUBLE ELSE greatest(0.45::DOUBLE, least(0.64::DOUBLE, round(quantile_cont(base_score, 0.45), 4))) END AS threshold, count(*) AS n FROM taxonomy_edge_candidates WHERE base_score IS NOT NULL AND NOT isnan(base_score) GROUP BY method",
    "profile_thresholds": """WITH c AS (SELECT id, method, decision, final_score, substring(lower(coalesce(lang, '')), 1, 2) AS lang FROM taxonomy_edge_candidates WHERE final_score IS NOT NULL AND NOT isnan(final_score)),
a AS (SELECT lang, method, round(avg(final_score), 4) AS t FROM c WHERE decision = 'accepted' AND lang <> '' GROUP BY ALL HAVING count(*) >= 20), b AS (SELECT method, round(avg(final_score), 4) AS t FROM c WHERE decision = 'accepted' GROUP BY method)
SELECT id, coalesce(a.t, b.t, 0.64::DOUBLE) AS threshold FROM c LEFT JOIN a ON a.lang = c.lang AND a.method = c.method LEFT JOIN b ON b.method = c.method""",
    "edge_dedupe_merge": f"SELECT taxonomy_version_id, parent_concept_id AS parent, child_concept_id AS child, max({_NUM.format('final_score')}) AS score, string_agg(method, '|' ORDER BY id) AS evidence FROM taxonomy_edge_candidates WHERE parent_concept_id IS NOT NULL AND child_concept_id IS NOT NULL GROUP BY ALL",
    "collapse_bidirectional": f"WITH {_EDGES.format('TRUE')} SELECT a.v AS taxonomy_version_id, a.p AS parent, a.c AS child, a.score FROM e a LEFT JOIN e b ON b.v = a.v AND b.p = a.c AND b.c = a.p WHERE b.p IS NULL OR a.score > b.score OR (a.score = b.score AND a.p <= a.c)",
    "connected_components": _COMP + "SELECT v AS taxonomy_version_id, n AS node, component FROM parts",
    "component_ratio": _COMP + ", s AS (SELECT v, component, count(*) AS k FROM parts GROUP BY ALL) SELECT v AS taxonomy_version_id, CAST(sum(k) AS BIGINT) AS n_nodes, count(*) AS n_components, max(k) AS largest, round(max(k)::DOUBLE / sum(k), 6) AS ratio FROM s GROUP BY v",
    "degree_counts": f"WITH {_ACC} SELECT v AS taxonomy_version_id, n AS node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT v, p AS n, 1 AS o, 0 AS i FROM e UNION ALL SELECT v, c, 0, 1 FROM e) GROUP BY ALL",
    "cap_children_per_parent": f"WITH {_ACC}, r AS (SELECT *, count(*) FILTER (WHERE score >= 0.9) OVER (PARTITION BY v, p) AS safe, row_number() OVER (PARTITION BY v, p, score >= 0.9 ORDER BY score DESC, c) AS k FROM e) SELECT v AS taxonomy_version_id, p AS parent, c AS child FROM r WHERE score >= 0.9 OR k <= greatest(0, 5 - safe)",
    "hierarchy_roots": f"WITH {_ACC} SELECT DISTINCT v AS taxonomy_version_id, p AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.v = e.v AND k.c = e.p)",
    "leaf_edges": f"WITH {_ACC} SELECT v AS taxonomy_version_id, p AS parent, c AS child FROM e WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.v = e.v AND k.p = e.c)",
    "orphan_concepts": f"WITH {_ACC}, {_NODES} SELECT DISTINCT v AS taxonomy_version_id, n AS node FROM nodes WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.v = nodes.v AND (e.p = nodes.n OR e.c = nodes.n))",
    "bfs_depths": f"WITH RECURSIVE {_ACC}, {_NEAR} SELECT v AS taxonomy_version_id, n AS node, CAST(depth AS INT) AS depth FROM d",
    "depth_limited_edges": f"WITH RECURSIVE {_ACC}, {_NEAR} SELECT e.v AS taxonomy_version_id, e.p AS parent, e.c AS child FROM e LEFT JOIN d ON d.v = e.v AND d.n = e.c WHERE depth IS NULL OR depth <= 3",
    "tree_paths": f"WITH RECURSIVE {_ACC}, {_WALK} SELECT v AS taxonomy_version_id, root, n AS node, depth, array_to_string(path, '/') AS path FROM walk",
    "tree_stats": f"WITH RECURSIVE {_ACC}, {_WALK} SELECT v AS taxonomy_version_id, count(*) AS n_nodes, CAST(max(depth) + 1 AS INT) AS max_depth FROM walk GROUP BY v",
    "graph_quality": _COMP + f""", {_NODES}, n AS (SELECT v, count(*) AS n FROM nodes GROUP BY v), k AS (SELECT v, count(*) AS n_edges FROM e GROUP BY v),
h AS (SELECT v, max(c)::DOUBLE / median(c) AS hub FROM (SELECT v, p, count(*) AS c FROM e GROUP BY v, p) GROUP BY v),
s AS (SELECT v, sum(c) AS linked, count(*) AS comps, max(c) AS largest FROM (SELECT v, component, count(*) AS c FROM parts GROUP BY ALL) GROUP BY v),
cand AS (SELECT canonical, {S.candidate('canonical')} AS cand FROM (SELECT DISTINCT canonical FROM concepts)), lowq AS (SELECT canonical FROM cand WHERE {S.low_quality('cand')}),
z AS (SELECT p.v, count(*) AS noise FROM parts p JOIN nodes d ON d.v = p.v AND d.n = p.n JOIN lowq ON lowq.canonical = d.canonical GROUP BY p.v),
r AS (SELECT n.v, n.n, coalesce(n_edges, 0) AS n_edges, coalesce(comps, 0) AS n_components, round(coalesce(n_edges, 0)::DOUBLE / n.n, 6) AS edge_density, round(coalesce(largest::DOUBLE / n.n, 0), 6) AS largest_component_ratio, round(coalesce(hub, 0), 6) AS hubness, round(coalesce(noise::DOUBLE / linked, 0), 6) AS lexical_noise_rate
  FROM n LEFT JOIN k ON k.v = n.v LEFT JOIN h ON h.v = n.v LEFT JOIN s ON s.v = n.v LEFT JOIN z ON z.v = n.v)
SELECT v AS taxonomy_version_id, n, n_edges, n_components, edge_density, largest_component_ratio, hubness, lexical_noise_rate, concat_ws(',', CASE WHEN edge_density < 0.2 THEN 'edge_density' END, CASE WHEN largest_component_ratio < 0.4 THEN 'largest_component_ratio' END, CASE WHEN hubness > 6 THEN 'hubness' END, CASE WHEN lexical_noise_rate > 0.05 THEN 'lexical_noise_rate' END) AS violations FROM r""",
    "structural_report": f"""WITH RECURSIVE {_ACC}, {_NODES}, {_NEAR},
f AS (SELECT nodes.v, lang, coalesce(o, 0) AS o, coalesce(i, 0) AS i, depth FROM nodes LEFT JOIN (SELECT v, p AS n, count(*) AS o FROM e GROUP BY ALL) x ON x.v = nodes.v AND x.n = nodes.n
  LEFT JOIN (SELECT v, c AS n, count(*) AS i FROM e GROUP BY ALL) y ON y.v = nodes.v AND y.n = nodes.n LEFT JOIN d ON d.v = nodes.v AND d.n = nodes.n)
SELECT v AS taxonomy_version_id, coalesce(lang, 'all') AS lang, count(*) AS n_nodes, count(*) FILTER (WHERE o > 0 AND i = 0) AS n_roots, count(*) FILTER (WHERE o = 0 AND i > 0) AS n_leaves, count(*) FILTER (WHERE o = 0 AND i = 0) AS n_orphans,
  CAST(coalesce(max(depth), 0) AS INT) AS max_depth, round(coalesce(avg(depth), 0), 2) AS avg_depth, round(coalesce(avg(CASE WHEN o > 0 THEN o END), 0), 2) AS avg_branching, max(o) AS max_branching, round(count(*) FILTER (WHERE o > 0 OR i > 0)::DOUBLE / count(*), 4) AS coverage
FROM f GROUP BY GROUPING SETS ((v, lang), (v))""",
    "edge_confidence_stats": """SELECT taxonomy_version_id, count(*) AS n, round(avg(final_score), 4) AS avg_score, round(coalesce(stddev_samp(final_score), 0), 4) AS std_score, min(final_score) AS min_score, max(final_score) AS max_score,
  count(*) FILTER (WHERE final_score < 0.3::DOUBLE) AS below_03, count(*) FILTER (WHERE final_score >= 0.3::DOUBLE AND final_score < 0.5::DOUBLE) AS from_03, count(*) FILTER (WHERE final_score >= 0.5::DOUBLE AND final_score < 0.7::DOUBLE) AS from_05,
  count(*) FILTER (WHERE final_score >= 0.7::DOUBLE AND final_score < 0.9::DOUBLE) AS from_07, count(*) FILTER (WHERE final_score >= 0.9::DOUBLE) AS from_09
FROM taxonomy_edge_candidates WHERE decision = 'accepted' AND final_score IS NOT NULL AND NOT isnan(final_score) GROUP BY 1""",
    "method_distribution": "SELECT taxonomy_version_id, coalesce(method, 'unknown') AS method, count(*) AS n FROM taxonomy_edge_candidates WHERE decision = 'accepted' GROUP BY ALL",
    "fragmentation_risk": _JUDGED + _RISK + "SELECT v AS taxonomy_version_id, n_components, n_small, n_isolated, fragmentation, small_share, n_weak, weak_share, n_risky, risky_share FROM risk",
    "candidate_coverage": _JUDGED + "," + _COVER + "SELECT v AS taxonomy_version_id, round(coverage, 6) AS coverage, round(coverage_candidates, 6) AS coverage_candidates FROM cover",
    "version_quality_scores": _JUDGED + _RISK + "," + _COVER + f""", hub AS (SELECT v, max(c)::DOUBLE / median(c) AS hub FROM (SELECT v, p, count(*) AS c FROM ie GROUP BY v, p) GROUP BY v), big AS (SELECT v, max(k)::DOUBLE / sum(k) AS lcr FROM sizes GROUP BY v),
{_LAST}, rev AS (SELECT taxonomy_version_id AS v, coalesce(count(*) FILTER (WHERE NOT flag)::DOUBLE / nullif(count(flag), 0), 0) AS dis FROM taxonomy_edge_candidates c LEFT JOIN last ON last.candidate_id = c.id GROUP BY 1)
SELECT cover.v AS taxonomy_version_id, round(round(10 * (0.3::DOUBLE * coverage_candidates + 0.25::DOUBLE * CASE WHEN hub IS NULL THEN 0 ELSE lcr END + 0.15::DOUBLE * (1 - CASE WHEN fragmentation = 0 THEN 1 ELSE fragmentation END)
  + 0.1::DOUBLE * (1 - CASE WHEN weak_share = 0 THEN 1 ELSE weak_share END) + 0.1::DOUBLE * (1 - least(1, coalesce(hub, 0) / 8)) + 0.1::DOUBLE * (1 - coalesce(dis, 0))), 3), 2) AS quality
FROM cover JOIN risk ON risk.v = cover.v JOIN big ON big.v = cover.v LEFT JOIN hub ON hub.v = cover.v LEFT JOIN rev ON rev.v = cover.v""",
    "connectivity_report": _JUDGED + f""", sl AS MATERIALIZED (SELECT v, n, canonical, unnest(CASE WHEN cand THEN ['all', 'all/' || lang, 'candidate', 'candidate/' || lang] ELSE ['all', 'all/' || lang] END) AS s FROM j),
se AS MATERIALIZED (SELECT e.v, a.s, e.p, e.c FROM e JOIN sl a ON a.v = e.v AND a.n = e.p JOIN sl b ON b.v = e.v AND b.n = e.c AND b.s = a.s),
u AS MATERIALIZED (SELECT v, s, p AS a, c AS b FROM se UNION SELECT v, s, c, p FROM se), rr AS (SELECT DISTINCT v, s, a AS n, a AS m FROM u UNION SELECT r.v, r.s, r.n, u.b FROM rr r JOIN u ON u.v = r.v AND u.s = r.s AND u.a = r.m),
pt AS MATERIALIZED (SELECT v, s, n, min(m) AS g FROM rr GROUP BY ALL), sz AS (SELECT v, s, count(*) AS comps, max(k) AS big, sum(k) AS linked FROM (SELECT v, s, g, count(*) AS k FROM pt GROUP BY ALL) GROUP BY ALL),
h AS (SELECT v, s, max(c)::DOUBLE / median(c) AS hub, sum(c) AS edges FROM (SELECT v, s, p, count(*) AS c FROM se GROUP BY ALL) GROUP BY ALL),
z AS (SELECT pt.v, pt.s, count(*) AS noise FROM pt JOIN nodes d ON d.v = pt.v AND d.n = pt.n JOIN lowq ON lowq.canonical = d.canonical GROUP BY ALL), t AS (SELECT v, s, count(*) AS n FROM sl GROUP BY ALL)
SELECT t.v AS taxonomy_version_id, t.s AS slice, t.n, CAST(coalesce(edges, 0) AS BIGINT) AS n_edges, coalesce(comps, 0) AS n_components, round(coalesce(edges, 0)::DOUBLE / t.n, 6) AS edge_density, round(coalesce(big::DOUBLE / t.n, 0), 6) AS largest_component_ratio,
  round(coalesce(hub, 0), 6) AS hubness, round(coalesce(noise::DOUBLE / linked, 0), 6) AS lexical_noise_rate FROM t LEFT JOIN sz ON sz.v = t.v AND sz.s = t.s LEFT JOIN h ON h.v = t.v AND h.s = t.s LEFT JOIN z ON z.v = t.v AND z.s = t.s""",
    "active_learning_summary": """WITH r AS (SELECT taxonomy_version_id AS v, collection_id, decision, row_number() OVER (PARTITION BY taxonomy_version_id ORDER BY CASE WHEN isnan(risk_score) THEN 2 ELSE risk_score END DESC NULLS LAST, id) AS k FROM taxonomy_edge_candidates)
SELECT v AS taxonomy_version_id, count(*) AS n_top, count(*) FILTER (WHERE decision = 'accepted') AS n_accepted, count(*) FILTER (WHERE decision = 'rejected') AS n_rejected, (SELECT count(*) FROM taxonomy_edge_labels l WHERE l.collection_id = min(r.collection_id)) AS n_labels FROM r WHERE k <= 25 GROUP BY v""",
    "top_rejection_reasons": """WITH r AS (SELECT taxonomy_version_id AS v, rejection_reason AS x, count(*) AS n FROM taxonomy_edge_candidates WHERE rejection_reason IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, x) AS k FROM r)
SELECT v AS taxonomy_version_id, string_agg(x || '=' || n, ', ' ORDER BY k) AS reasons FROM k WHERE k <= 5 GROUP BY v""",
    "manual_review_rates": f"""WITH f AS (SELECT candidate_id, created_at, id, CASE WHEN lower(trim(label)) IN ({S.quoted(L.POSITIVE_LABELS)}) THEN TRUE WHEN lower(trim(label)) IN ({S.quoted(L.NEGATIVE_LABELS)}) THEN FALSE END AS flag FROM taxonomy_edge_labels WHERE candidate_id IS NOT NULL),
l AS (SELECT candidate_id, flag FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC) AS k FROM f WHERE flag IS NOT NULL) WHERE k = 1)
SELECT method, count(*) AS n, count(flag) AS reviewed, count(*) FILTER (WHERE flag) AS approved, count(*) FILTER (WHERE NOT flag) AS rejected, round(coalesce(count(*) FILTER (WHERE flag)::DOUBLE / nullif(count(flag), 0), 0), 4) AS approval_rate
FROM taxonomy_edge_candidates c LEFT JOIN l ON l.candidate_id = c.id GROUP BY method""",
    "cross_lang_consistency": f"""WITH a AS (SELECT array_to_string({S.tokens('parent_label')}[1:4], ' ') AS p, array_to_string({S.tokens('child_label')}[1:4], ' ') AS c, coalesce(lang, '') AS lang FROM taxonomy_edge_candidates WHERE decision = 'accepted'),
s AS (SELECT least(p, c) AS x, greatest(p, c) AS y, count(DISTINCT lang) AS langs, bool_or(p <= c) AS f, bool_or(p > c) AS r FROM a WHERE p <> '' AND c <> '' GROUP BY ALL HAVING count(DISTINCT lang) >= 2)
SELECT count(*) AS comparable, count(*) FILTER (WHERE NOT (f AND r)) AS consistent, round(coalesce(count(*) FILTER (WHERE NOT (f AND r))::DOUBLE / nullif(count(*), 0), 1), 4) AS consistency FROM s""",
    "active_learning_topk": "SELECT id, risk_score, decision FROM taxonomy_edge_candidates WHERE risk_score IS NOT NULL AND NOT isnan(risk_score) ORDER BY risk_score DESC, id LIMIT 200",
    "rejection_reason_counts": "SELECT taxonomy_version_id, rejection_reason, count(*) AS n FROM taxonomy_edge_candidates WHERE rejection_reason IS NOT NULL GROUP BY ALL",
}
