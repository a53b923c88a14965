"""Queries of the training-data operators, and SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforest.llm.consensus import spectral_consensus
from termforest.llm.cutoff import closest_cutoffs, score_frequencies
from termforest.llm.distinctive import term_scores
from termforest.llm.langid import fit_language_model, label_languages, language_code
from termforest.llm.leakage import leaked_items
from termforest.llm.mixing import default_vocabulary, mix_sources, shared_text_weight, text_keys, token_counter
from termforest.llm.reading import fit_reading_model, score_texts, with_levels
from termforest.llm.split import oversized, spans_of
from termforest.llm.topn import top_items
from termforest.session import cut


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LANGS = ["en", "ru", "kk", "de"]


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _table(spark, folder, "document_chunks")
    model = fit_language_model(chunks, "id", "text", "lang", LANGS)
    return label_languages(chunks.select("id", "lang", "text"), "text", model)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the chunks whose label names none of them, or that hold several."""
    labelled = _languages(spark, folder).select("id", language_code(F.col("lang")).alias("label"), F.col("language.langs").alias("langs"))
    agrees = F.coalesce(F.array_contains("langs", F.col("label")), F.lit(False))
    found = labelled.filter(~agrees | (F.size("langs") > 1)).filter("langs is not null")
    return found.select(F.col("id").alias("chunk_id"), F.explode("langs").alias("lang")).distinct()


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's one-language segments with their confidence, beside the language of the whole chunk."""
    labelled = _languages(spark, folder).select("id", "language.*")
    chunk = [F.col("id").alias("chunk_id"), F.col("lang").alias("chunk_lang"), F.round("confidence", 4).alias("chunk_confidence")]
    return labelled.select(*chunk, F.posexplode_outer("segments").alias("segment", "s")).select("chunk_id", "chunk_lang", "chunk_confidence", "segment", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.lang").alias("lang"), F.round("s.confidence", 4).alias("confidence"))


def _cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    edges = _table(spark, folder, "taxonomy_edge_candidates")
    lang = F.lower(F.trim("lang"))
    keys = {"method": F.col("method"), "lang": F.when(lang.isNull() | (lang == ""), "unknown").otherwise(lang)}
    targets = _table(spark, folder, "cutoff_targets").select("method", "lang", F.col("keep_fraction").alias("fraction"))
    return closest_cutoffs(score_frequencies(edges, keys, F.col("final_score")), targets, ["method", "lang"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources for which no cutoff comes within 0.05 of the wanted fraction."""
    return _cutoffs(spark, folder).filter(F.col("gap") > 0.05 + 1e-12).select("method", "lang")


def p3_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The closest cutoff of every source and the size it keeps."""
    return _cutoffs(spark, folder).select("method", "lang", F.col("fraction").alias("keep_fraction"), "total", F.coalesce("cutoff", F.lit(float("inf"))).alias("cutoff"), "kept")


def _oversized_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the limit of their document's collection, with the spans of their pieces."""
    chunks = _table(spark, folder, "document_chunks").select("id", "document_id", "chunk_index", "text", "char_start")
    limits = _table(spark, folder, "chunk_limits")
    least = limits.agg(F.min("max_chars")).scalar()  # spares the shuffle of texts that no limit can cut
    documents = _table(spark, folder, "documents").select("document_id", "collection_id").join(limits, "collection_id")
    over = chunks.filter(oversized(F.col("text"), least)).join(documents, "document_id").filter(oversized(F.col("text"), F.col("max_chars")))
    return over.withColumn("spans", spans_of(F.col("text"), F.col("max_chars"), F.col("overlap_chars")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are cut into pieces."""
    return _oversized_chunks(spark, folder).filter(F.size("spans") > 1).select(F.col("id").alias("chunk_id")).distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized chunks; ``chunk_index`` counts the pieces cut before in the same document."""
    over = _oversized_chunks(spark, folder)
    # a chunk logged twice moves its successors once
    extra = over.groupBy("document_id", "chunk_index").agg((F.max(F.size("spans")) - 1).alias("more"))
    before = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    shift = extra.select("document_id", "chunk_index", F.coalesce(F.sum("more").over(before), F.lit(0)).cast("int").alias("shift"))
    pieces = over.join(shift, ["document_id", "chunk_index"]).select("id", "document_id", "chunk_index", "shift", "text", "char_start", F.posexplode("spans").alias("i", "span"))
    return pieces.select(
        F.col("id").alias("chunk_id"),
        "document_id",
        (F.col("chunk_index") + F.col("shift") + F.col("i")).alias("chunk_index"),
        F.substring("text", F.col("span.start") + 1, F.col("span.stop") - F.col("span.start")).alias("text"),
        (F.col("char_start") + F.col("span.start")).alias("char_start"),
        (F.col("char_start") + F.col("span.stop")).alias("char_end"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms more frequent in a chunk than in all others (z above 0), three times or more there, in two to eight texts."""
    scores = term_scores(_table(spark, folder, "document_chunks"), "id", "text", min_count=3, min_texts=2, max_texts=8, min_z=0.0)
    return scores.select(F.col("record").alias("chunk_id"), "term")


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every term of every chunk."""
    return term_scores(_table(spark, folder, "document_chunks"), "id", "text").select(F.col("record").alias("chunk_id"), "term", F.col("y").alias("n_in_chunk"), F.col("texts").alias("n_texts"), F.round("z", 4).alias("z"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The six best children of every parent."""
    edges = _table(spark, folder, "taxonomy_edge_candidates")
    top = top_items(edges, "parent_concept_id", "child_concept_id", "final_score", "id", 6)
    return top.select(F.col("grp").alias("parent_concept_id"), F.col("item").alias("child_concept_id"), F.col("record").alias("candidate_id"))


def _consensus(spark: SparkSession, folder: str):
    return spectral_consensus(_table(spark, folder, "taxonomy_edge_labels"), "candidate_id", "reviewer_id", "label", "created_at", "id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewers hardly better than chance."""
    return _consensus(spark, folder).annotators.filter("reliability < 0.65").select(F.col("annotator").alias("reviewer_id"))


def p7_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Consensus label, confidence and agreement of every candidate with a vote."""
    return _consensus(spark, folder).items.withColumnRenamed("item", "candidate_id")


def p7_reviewers(spark: SparkSession, folder: str) -> DataFrame:
    """Skill and reliability of every reviewer."""
    return _consensus(spark, folder).annotators.withColumnRenamed("annotator", "reviewer_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat a passage of a held-out item, with the item."""
    leaks = leaked_items(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "benchmark_items"), "item_id", "text")
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    count = token_counter(default_vocabulary())
    # sizes and keys are taken where the texts lie, so no text is moved
    docs = _table(spark, folder, "documents").select(F.col("doc_id").alias("record"), "source", count(F.col("text")).alias("size"), *text_keys("text"))
    return shared_text_weight(docs), _table(spark, folder, "mix_targets")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the mix that fall short of their share although every document is used as often as it may be."""
    records, targets = _sized(spark, folder)
    return mix_sources(records, targets).sources.filter("short").select("source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in the mix."""
    records, targets = _sized(spark, folder)
    return mix_sources(records, targets).records.select(F.col("record").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached size and share of every source."""
    records, targets = _sized(spark, folder)
    return mix_sources(records, targets).sources.withColumn("target", F.round("target", 2)).withColumn("share", F.round("share", 6))


LEVELS = ["basic", "general", "specialist"]


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = fit_reading_model(docs, "doc_id", "text", _table(spark, folder, "reading_anchors"), "level", LEVELS)
    return with_levels(cut(score_texts(docs, "text", model).select("doc_id", "reading_score")), model)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the lowest reading level."""
    return _levels(spark, folder).filter("level = 'basic'").select("doc_id")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Reading score and level of every document."""
    return _levels(spark, folder).withColumn("reading_score", F.round("reading_score", 4)).withColumn("confidence", F.round("confidence", 4))


QUERIES = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p3_found": p3_found,
    "p3_cutoffs": p3_cutoffs,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_scores": p5_scores,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_consensus": p7_consensus,
    "p7_reviewers": p7_reviewers,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}

_CUTOFFS = """
WITH f AS (
  SELECT method, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'unknown' ELSE lower(trim(lang)) END AS lang, final_score AS s, count(*) AS w
  FROM taxonomy_edge_candidates WHERE final_score IS NOT NULL AND NOT isnan(final_score) GROUP BY ALL),
r AS (
  SELECT method, lang, s, sum(w) OVER (PARTITION BY method, lang ORDER BY s DESC) AS kept, sum(w) OVER (PARTITION BY method, lang) AS total FROM f
  UNION ALL SELECT DISTINCT method, lang, CAST('inf' AS DOUBLE), 0, sum(w) OVER (PARTITION BY method, lang) FROM f),
g AS (
  SELECT r.*, t.keep_fraction, abs(kept - keep_fraction * total) / total AS gap
  FROM r JOIN cutoff_targets t ON t.method = r.method AND t.lang = r.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY method, lang ORDER BY gap, kept) AS k FROM g)
"""

_TERMS = r"""
WITH t AS (SELECT DISTINCT text FROM document_chunks WHERE text IS NOT NULL),
tok AS (SELECT text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM t),
c AS (SELECT text, term, count(*) AS y FROM tok GROUP BY ALL),
l AS (SELECT text, CAST(sum(y) AS DOUBLE) AS n FROM c GROUP BY text),
v AS (SELECT term, CAST(sum(y) AS DOUBLE) AS total, count(*) AS texts FROM c GROUP BY term),
s AS (SELECT CAST(sum(total) AS DOUBLE) AS everything FROM v)
"""

ORACLE = {
    "p4_found": """
SELECT DISTINCT c.id AS chunk_id FROM document_chunks c JOIN documents d ON d.document_id = c.document_id
JOIN chunk_limits m ON m.collection_id = d.collection_id WHERE length(c.text) > m.max_chars""",
    "p5_found": _TERMS + """
SELECT DISTINCT d.id AS chunk_id, c.term FROM c JOIN v ON v.term = c.term JOIN document_chunks d ON d.text = c.text
WHERE c.y >= 3 AND v.texts BETWEEN 2 AND 8""",
    "p5_scores": _TERMS + """
SELECT DISTINCT d.id AS chunk_id, c.term, c.y AS n_in_chunk, v.texts AS n_texts, round(
  (ln((c.y + a) / greatest(l.n + 1000 - c.y - a, 1e-9)) - ln((total - c.y + a) / greatest(everything - l.n + 1000 - (total - c.y) - a, 1e-9)))
  / sqrt(1 / (c.y + a) + 1 / (total - c.y + a)), 4) AS z
FROM c JOIN (SELECT *, 1000.0::DOUBLE * total / everything AS a FROM v, s) v ON v.term = c.term JOIN l ON l.text = c.text JOIN document_chunks d ON d.text = c.text""",
    "p3_found": _CUTOFFS + "SELECT method, lang FROM b WHERE k = 1 AND gap > 0.05 + 1e-12",
    "p3_cutoffs": _CUTOFFS + "SELECT method, lang, keep_fraction, CAST(total AS BIGINT) AS total, s AS cutoff, CAST(kept AS BIGINT) AS kept FROM b WHERE k = 1",
    "p9_found": """
SELECT m.source FROM mix_targets m LEFT JOIN (SELECT source, sum(length(text)) AS s FROM documents GROUP BY source) d ON d.source = m.source
WHERE coalesce(d.s, 0) * m.max_repeats < m.target_share * (SELECT sum(length(text)) FROM documents)""",
    "p6_found": """
WITH best AS (
  SELECT parent_concept_id, child_concept_id, id, final_score,
    row_number() OVER (PARTITION BY parent_concept_id, child_concept_id ORDER BY final_score DESC, id) AS k
  FROM taxonomy_edge_candidates
  WHERE parent_concept_id IS NOT NULL AND child_concept_id IS NOT NULL AND final_score IS NOT NULL AND NOT isnan(final_score)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY parent_concept_id ORDER BY final_score DESC, child_concept_id) AS r FROM best WHERE k = 1)
SELECT parent_concept_id, child_concept_id, id AS candidate_id FROM ranked WHERE r <= 6""",
}
