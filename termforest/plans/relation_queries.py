"""Queries of pattern, co-occurrence and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from termforest.functions import text as X
from termforest.operators import relations as R
from termforest.operators import terms as T
from termforest.operators import vectors as V
from termforest.plans import sql as S
from termforest.plans.term_queries import CHUNKS, chunks_of


def _labels(spark, folder):
    return spark.read.parquet(f"{folder}/concepts.parquet").select(F.lower("canonical").alias("term")).distinct()


def keyed(spark, folder):
    """Chunks and labels with their collection."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("document_id", "collection_id")
    chunks = chunks_of(spark, folder).join(docs, "document_id")
    labels = spark.read.parquet(f"{folder}/concepts.parquet").select("collection_id", F.lower("canonical").alias("term")).distinct()
    return chunks, labels


def hearst_matches(spark, folder):
    """REX-01."""
    return R.hearst_matches(chunks_of(spark, folder)).groupBy("chunk_id", "pattern").agg(F.count("*").alias("n"), F.sum(F.length("parent_text") + F.length("child_text")).alias("chars"))


def hearst_pairs(spark, folder):
    """REX-01, TXT-20."""
    return R.hearst_pairs(chunks_of(spark, folder))


def concept_relations(spark, folder):
    """REX-02."""
    return R.concept_relations(chunks_of(spark, folder), _labels(spark, folder).withColumnRenamed("term", "label"))


def trigger_pairs(spark, folder):
    """REX-03."""
    return R.trigger_pairs(chunks_of(spark, folder), _labels(spark, folder))


def closest_labels(spark, folder):
    """TXT-24: closest concept label of every surface form."""
    c = spark.read.parquet(f"{folder}/concepts.parquet")
    forms = c.select(F.explode("surface_forms").alias("phrase")).select(F.lower("phrase").alias("phrase"))
    return R.closest_labels(forms, c.select(F.lower("canonical").alias("label"))).withColumn("overlap", F.round("overlap", 6))


def pair_cooccurrence_support(spark, folder):
    """REX-05 per collection."""
    chunks, labels = keyed(spark, folder)
    s = R.cooccurrence_support(R.label_presence(chunks, labels, ("collection_id",)), ("collection_id",))
    return s.withColumn("support", F.round("support", 6))


def concept_doc_frequency(spark, folder):
    """REX-06: documents of its collection that hold a concept's label."""
    chunks, labels = keyed(spark, folder)
    p = R.label_presence(chunks, labels, ("collection_id",)).groupBy("collection_id", "term").agg(F.count_distinct("document_id").alias("df"))
    return labels.join(p, ["collection_id", "term"], "left").na.fill(0, ["df"])


def evidence_topk_snippets(spark, folder):
    """REX-07."""
    return R.evidence_snippets(chunks_of(spark, folder), _labels(spark, folder)).withColumn("snippet", F.md5("snippet"))


def directional_evidence(spark, folder):
    """REX-08 of every accepted pair of labels."""
    c = spark.read.parquet(f"{folder}/taxonomy_edge_candidates.parquet").filter("decision = 'accepted'")
    pairs = c.select(F.lower("parent_label").alias("parent"), F.lower("child_label").alias("child")).dropna().distinct()
    return R.directional_evidence(pairs, R.evidence_snippets(chunks_of(spark, folder), _labels(spark, folder))).withColumn("evidence", F.round("evidence", 4))


def _vectors(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster"), F.lit(0.0).alias("score"))


def cluster_centroids(spark, folder):
    """VEC-04."""
    return V.centroids(_vectors(spark, folder)).select("cluster", F.posexplode("centroid").alias("d", "x")).withColumn("x", F.round("x", 5))


def parent_ranking(spark, folder):
    """VEC-05/06: quality and membership of the parent pool; these vectors have no labels."""
    r = V.parent_quality(_vectors(spark, folder))
    pool = V.parent_pool(r).select("id", F.lit(True).alias("in_pool"))
    return r.select("cluster", "id", "quality").join(pool, "id", "left").select("cluster", "id", "quality", F.coalesce("in_pool", F.lit(False)).alias("in_pool"))


def embedding_parents(spark, folder):
    """VEC-07."""
    b = V.best_parents(_vectors(spark, folder), 0.1)
    return b.select("cluster", "child", "parent", "sim", F.round("threshold", 9).alias("threshold"), "accepted")


def embedding_hierarchy_edges(spark, folder):
    """VEC-01, VEC-08..11 over the concepts of each collection and language, with hashed label vectors."""
    c = spark.read.parquet(f"{folder}/concepts.parquet")
    group = F.concat_ws("/", "collection_id", X.normalize_lang(F.coalesce("lang", F.lit(""))))
    v = c.select("collection_id", "id", F.lower("canonical").alias("term"), V.hashed_embedding(F.col("canonical")).alias("vector"), group.alias("cluster"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return V.embedding_hierarchy(v.join(concept_doc_frequency(spark, folder), ["collection_id", "term"], "left").withColumnRenamed("term", "label"))


def kmeans_clusters(spark, folder):
    """VEC-03: sizes of the clusters."""
    return V.kmeans(_vectors(spark, folder), 10).groupBy("cluster").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (hearst_matches, hearst_pairs, concept_relations, trigger_pairs, closest_labels, pair_cooccurrence_support, concept_doc_frequency, evidence_topk_snippets, directional_evidence, cluster_centroids, parent_ranking, embedding_parents, embedding_hierarchy_edges, kmeans_clusters)}


def _hearst() -> str:
    parts = []
    for k, (lang, p, first) in enumerate(R.PATTERNS):
        a, b = (1, 2) if first else (2, 1)
        parts.append(f"SELECT chunk_id, document_id, lang, {k} AS pattern, unnest(regexp_extract_all(low, '{p}', {a})) AS pt, unnest(regexp_extract_all(low, '{p}', {b})) AS ct FROM t WHERE lang = '{lang}'")
    return f"WITH {CHUNKS}, t AS MATERIALIZED (SELECT *, lower(text) AS low FROM chunks), m AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def _enum(e: str) -> str:
    return rf"string_split(regexp_replace({e}, '\s*,\s*|\s+(?:and|or|и|или|және|немесе)\s+', chr(1), 'g'), chr(1))"


CONTAIN = f"""WITH {CHUNKS}, k AS (SELECT c.*, d.collection_id FROM chunks c JOIN documents d ON d.document_id = c.document_id), labels AS (SELECT DISTINCT collection_id, lower(canonical) AS term FROM concepts),
ph AS (SELECT DISTINCT collection_id, chunk_id, document_id, term FROM (SELECT collection_id, chunk_id, document_id, unnest({S.phrases('text', 5)}) AS term FROM k)),
pres AS MATERIALIZED (SELECT ph.* FROM ph JOIN labels l ON l.collection_id = ph.collection_id AND l.term = ph.term)"""
_VEC = """WITH v AS (SELECT vec_id AS id, label AS cluster, embedding FROM embeddings), d AS (SELECT id, cluster, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM v),
m AS (SELECT cluster, d, avg(x) AS x FROM d GROUP BY ALL), c AS MATERIALIZED (SELECT cluster, d, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS x FROM m)"""
_RANKED = _VEC + """, q AS (SELECT d.cluster, d.id, round(0.35::DOUBLE * sum(d.x * c.x), 6) AS quality FROM d JOIN c ON c.cluster = d.cluster AND c.d = d.d GROUP BY ALL),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY quality DESC, id) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM q),
pool AS MATERIALIZED (SELECT * FROM r WHERE k <= least(greatest(5, least(12, greatest(2, n // 3))), greatest(1, n - 1)))"""

_TRIGGER = " OR ".join(f"(lang = '{lang}' AND contains(lower(text), '{t}'))" for lang, ts in R.TRIGGERS.items() for t in ts)

ORACLE = {
    "trigger_pairs": f"""WITH {CHUNKS}, labels AS (SELECT DISTINCT lower(canonical) AS term FROM concepts WHERE length(canonical) >= 3), fit AS (SELECT term, len({S.tokens('term')}) AS n FROM labels WHERE len({S.tokens('term')}) <= 5),
ph AS (SELECT DISTINCT lang, chunk_id, document_id, text, term FROM (SELECT lang, chunk_id, document_id, text, unnest({S.phrases('text', 5)}) AS term FROM chunks)), h AS MATERIALIZED (SELECT ph.*, n FROM ph JOIN fit USING (term)),
d AS (SELECT term, count(DISTINCT document_id) AS df FROM h GROUP BY term), t AS MATERIALIZED (SELECT lang, chunk_id, h.term, n, df, {S.tokens('h.term')} AS w FROM h JOIN d ON d.term = h.term WHERE {_TRIGGER}),
p AS (SELECT a.lang, a.term AS x, b.term AS y, a.df - b.df AS gap, a.n AS xn, b.n AS yn, count(*) AS support, any_value(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w)))) AS o
  FROM t a JOIN t b ON b.lang = a.lang AND b.chunk_id = a.chunk_id AND a.term < b.term GROUP BY ALL),
q AS (SELECT *, (contains(x, y) OR contains(y, x))::INT AS c, CASE WHEN gap >= 2 THEN TRUE WHEN gap <= -2 THEN FALSE WHEN xn <> yn THEN xn < yn ELSE gap >= 0 END AS f FROM p)
SELECT lang, CASE WHEN f THEN x ELSE y END AS parent, CASE WHEN f THEN y ELSE x END AS child, round(greatest(0.6::DOUBLE, least(0.82::DOUBLE, 0.58::DOUBLE + 0.1::DOUBLE * o + 0.05::DOUBLE * c + CASE WHEN (CASE WHEN f THEN gap ELSE -gap END) >= 1 THEN 0.03::DOUBLE ELSE 0 END)), 4) AS score, support
FROM q WHERE (o >= 0.2 OR c > 0) AND NOT (xn = 1 AND yn = 1)""",
    "hearst_matches": _hearst() + " SELECT chunk_id, CAST(pattern AS INT) AS pattern, count(*) AS n, CAST(sum(length(pt) + length(ct)) AS BIGINT) AS chars FROM m GROUP BY ALL",
    "hearst_pairs": _hearst() + f""", a AS (SELECT document_id, lang, ct, unnest({_enum('pt')}) AS x FROM m), b AS (SELECT document_id, lang, x, unnest({_enum('ct')}) AS y FROM a),
n AS (SELECT document_id, lang, {S.candidate('x')} AS parent, {S.candidate('y')} AS child FROM b) SELECT lang, parent, child, count(*) AS support, count(DISTINCT document_id) AS docs FROM n WHERE parent <> child GROUP BY ALL""",
    "closest_labels": f"""WITH p AS (SELECT DISTINCT lower(x) AS phrase FROM (SELECT unnest(surface_forms) AS x FROM concepts)), l AS (SELECT DISTINCT lower(canonical) AS label FROM concepts),
pt AS (SELECT phrase, list_distinct({S.tokens('phrase')}) AS t FROM p), lt AS (SELECT label, list_distinct({S.tokens('label')}) AS t FROM l),
s AS (SELECT phrase, label, len(list_intersect(pt.t, lt.t))::DOUBLE / len(list_distinct(list_concat(pt.t, lt.t))) AS overlap, len(list_intersect(pt.t, lt.t))::DOUBLE / len(pt.t) AS part,
  2.0::DOUBLE * least(length(phrase), length(label)) / (length(phrase) + length(label)) AS ratio FROM pt JOIN lt ON len(list_intersect(pt.t, lt.t)) > 0),
o AS (SELECT phrase, label, overlap, 0 AS stage, overlap AS value FROM s WHERE overlap >= 0.62
  UNION ALL SELECT phrase, label, overlap, 1, part + 0.35::DOUBLE * ratio FROM s WHERE overlap < 0.62 AND part >= 0.6 AND ratio >= 0.72 AND length(phrase) >= 5 AND length(label) >= 5 AND (contains(phrase, label) OR contains(label, phrase)))
SELECT phrase, label, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY stage, value DESC, label) AS k FROM o) WHERE k = 1""",
    "pair_cooccurrence_support": CONTAIN + """, n AS (SELECT collection_id, term, count(*) AS n FROM pres GROUP BY ALL),
p AS (SELECT a.collection_id, a.term AS a, b.term AS b, count(*) AS n FROM pres a JOIN pres b ON b.collection_id = a.collection_id AND b.chunk_id = a.chunk_id AND a.term < b.term GROUP BY ALL)
SELECT p.collection_id, a, b, p.n, round(least(1, p.n::DOUBLE / max(p.n) OVER (PARTITION BY p.collection_id) * (1 / (1 + 0.02::DOUBLE * greatest(x.n + y.n - 4, 0)))), 6) AS support
FROM p JOIN n x ON x.collection_id = p.collection_id AND x.term = a JOIN n y ON y.collection_id = p.collection_id AND y.term = b""",
    "concept_doc_frequency": CONTAIN + " SELECT l.collection_id, l.term, count(DISTINCT document_id) AS df FROM labels l LEFT JOIN pres p ON p.collection_id = l.collection_id AND p.term = l.term GROUP BY ALL",
    "cluster_centroids": _VEC + " SELECT cluster, CAST(d AS INT) AS d, round(x, 5) AS x FROM c",
    "parent_ranking": _RANKED + " SELECT r.cluster, r.id, r.quality, p.id IS NOT NULL AS in_pool FROM r LEFT JOIN pool p ON p.id = r.id",
    "embedding_parents": _RANKED + """, kid AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM pool)),
s AS (SELECT k.cluster, k.id AS child, p.id AS parent, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM kid k JOIN pool p ON p.cluster = k.cluster JOIN v a ON a.id = k.id JOIN v b ON b.id = p.id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY sim DESC, parent) AS z FROM s) WHERE z = 1), t AS (SELECT cluster, greatest(0.1::DOUBLE, quantile_cont(sim, 0.45)) AS threshold FROM b GROUP BY cluster)
SELECT b.cluster, child, parent, sim, round(threshold, 9) AS threshold, sim >= threshold AS accepted FROM b JOIN t ON t.cluster = b.cluster""",
}
