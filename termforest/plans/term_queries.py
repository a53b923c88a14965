"""Queries of the text functions and the term operators over the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforest.functions import lexicon as L
from termforest.functions import text as X
from termforest.operators import terms as T
from termforest.plans import sql as S
from termforest.session import spread


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    raw = spread(spark.read.parquet(f"{folder}/document_chunks.parquet").select("id", "document_id", "chunk_index", "lang", "text"))
    return raw.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", X.normalize_lang(F.coalesce("lang", F.lit(""))).alias("lang"), "text")


def concepts_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/concepts.parquet")


def text_clean_lines(spark, folder):
    """TXT-01 over all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = X.clean_text("text")
    return docs.select("doc_id", F.length(clean).alias("n_clean"), F.md5(clean).alias("digest"))


def sentence_split(spark, folder):
    """Sentences of each document after cleaning."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.posexplode(X.sentences(X.strip("text"))).alias("i", "s"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).alias("longest"))


def lang_heuristic(spark, folder):
    """TXT-04 and TXT-05 over all chunks."""
    return chunks_of(spark, folder).select("chunk_id", "lang", X.cyrillic_language("text").alias("heuristic"))


def lang_distribution(spark, folder):
    """AGG-01: chunks by normalised language."""
    return chunks_of(spark, folder).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("docs"))


def dominant_language(spark, folder):
    """AGG-02: most frequent language of each document; the smaller code wins a tie."""
    n = chunks_of(spark, folder).groupBy("document_id", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"), F.sum("n").alias("n_chunks"))


def token_frequency(spark, folder):
    return T.token_frequencies(chunks_of(spark, folder))


def noise_token_profile(spark, folder):
    """TXT-08: share of noise among the tokens of each language."""
    t = chunks_of(spark, folder).select("lang", F.explode(X.tokens("text")).alias("t"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.is_noise_token(F.col("t"))).alias("n_noise"))


def ngram_counts(spark, folder):
    """TXT-09: n-grams used three times or more."""
    g = chunks_of(spark, folder).select("lang", F.explode(X.extract_ngrams("text")).alias("gram"))
    return g.groupBy("lang", "gram").agg(F.count("*").alias("n")).filter("n >= 3")


def normalized_terms(spark, folder):
    """TXT-12/13: normalised form of every n-gram."""
    g = chunks_of(spark, folder).select(F.explode(X.extract_ngrams("text")).alias("gram")).distinct()
    return g.select("gram", X.normalize_term("gram").alias("term")).filter("term is not null")


def functional_phrases(spark, folder):
    """TXT-14 over the concept labels."""
    c = concepts_of(spark, folder).select("canonical", X.normalize_lang(F.coalesce("lang", F.lit(""))).alias("lang")).distinct()
    return c.select("canonical", "lang", X.is_functional_phrase("canonical", "lang").alias("functional"))


def label_quality(spark, folder):
    """TXT-18/19 over the concept labels."""
    c = concepts_of(spark, folder).select("canonical").distinct()
    return c.select("canonical", X.normalize_candidate("canonical").alias("candidate"), X.is_low_quality_label("canonical").alias("low_quality"))


def enumeration_parts(spark, folder):
    """TXT-20: members of the enumerations in surface forms joined by commas."""
    c = concepts_of(spark, folder).select("id", F.explode(X.split_enumeration(F.array_join("surface_forms", ", "))).alias("part"))
    return c.groupBy("id", "part").agg(F.count("*").alias("n"))


def tfidf_top_terms(spark, folder):
    return T.tfidf(chunks_of(spark, folder), 500)


def textrank_top_tokens(spark, folder):
    return T.textrank(chunks_of(spark, folder), 200).select("lang", "term", "score")


def merged_term_scores(spark, folder):
    """TERM-03 of two TF-IDF settings, once over all terms and once over frequent ones."""
    c = chunks_of(spark, folder)
    return T.merge_scores(T.best_language(T.tfidf(c, 1000)), T.best_language(T.tfidf(c, 300, min_freq=5)))


def _labels(spark, folder):
    return concepts_of(spark, folder).select(F.lower("canonical").alias("term")).distinct()


def term_frequencies(spark, folder):
    """TERM-05/06: whole-term frequency and document frequency of every concept label."""
    return T.term_frequencies(chunks_of(spark, folder), _labels(spark, folder))


def cvalue_scores(spark, folder):
    return T.cvalue(T.term_frequencies(chunks_of(spark, folder), _labels(spark, folder)))


def pmi_scores(spark, folder):
    return T.pmi(_labels(spark, folder), T.token_frequencies(chunks_of(spark, folder)))


def _concept_scores(spark, folder):
    c = concepts_of(spark, folder).filter("score is not null")
    return c.select(F.lower("canonical").alias("term"), "score", X.normalize_lang(F.coalesce("lang", F.lit(""))).alias("lang")).groupBy("term").agg(F.max("score").alias("score"), F.min("lang").alias("lang"))


def refined_scores(spark, folder):
    """TERM-09 over the concept labels and their scores."""
    c, s = chunks_of(spark, folder), _concept_scores(spark, folder)
    r = T.refine(s, T.term_frequencies(c, s), T.token_frequencies(c))
    return r.select("term", "refined")


def subsumed_singles(spark, folder):
    """TERM-11: labels that stay."""
    c, s = chunks_of(spark, folder), _concept_scores(spark, folder)
    return T.suppress_subsumed(s.select("term", "score"), T.term_frequencies(c, s)).select("term", "score", "df")


def term_quality_filter(spark, folder):
    """TERM-10/12 over the concept labels."""
    c, s = chunks_of(spark, folder), _concept_scores(spark, folder)
    kept = T.quality_filter(s, T.term_frequencies(c, s), c.agg(F.count_distinct("document_id")).scalar(), min_quality=0.2)
    return kept.select("term", "df", F.round("quality", 4).alias("quality"))


def term_dedupe_surface_forms(spark, folder):
    """TXT-25 per collection over the concept labels."""
    c = concepts_of(spark, folder).filter("score is not null").select("collection_id", F.col("canonical").alias("term"), "score")
    return T.dedupe_terms(c, "collection_id").select(F.col("grp").alias("collection_id"), "term", "score", F.array_join("surface_forms", "|").alias("surface_forms"))


def term_occurrences(spark, folder):
    """TERM-14: located uses of the concept labels."""
    return T.occurrences(chunks_of(spark, folder), _labels(spark, folder), 20)


def terms_pipeline(spark, folder):
    """TERM-15: the whole term stage."""
    return T.extract_terms(chunks_of(spark, folder)).select("term", "lang", "score", "df", "quality", F.array_join("surface_forms", "|").alias("surface_forms"), "rank")


QUERIES = {f.__name__: f for f in (
    text_clean_lines, sentence_split, lang_heuristic, lang_distribution, dominant_language, token_frequency, noise_token_profile, ngram_counts,
    normalized_terms, functional_phrases, label_quality, enumeration_parts, tfidf_top_terms, textrank_top_tokens, merged_term_scores, term_frequencies,
    cvalue_scores, pmi_scores, refined_scores, subsumed_singles, term_quality_filter, term_dedupe_surface_forms, term_occurrences, terms_pipeline,
)}

CHUNKS = f"chunks AS (SELECT id AS chunk_id, document_id, {S.normal_lang('coalesce(lang, $$$$)')} AS lang, text FROM document_chunks)".replace("$$$$", "''")
_GRAMS = f"""{CHUNKS},
w AS (SELECT chunk_id, document_id, lang, {S.content('text')} AS t FROM chunks),
grams AS (SELECT lang, document_id, unnest(t) AS gram FROM w UNION ALL
  SELECT lang, document_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) FROM w),
norm AS MATERIALIZED (SELECT gram, {S.normal_term('gram')} AS term FROM (SELECT DISTINCT gram FROM grams))"""
_TFIDF = _GRAMS + """,
stats AS (SELECT lang, term, count(*) AS n, count(DISTINCT document_id) AS df FROM grams JOIN norm USING (gram) WHERE term IS NOT NULL GROUP BY ALL),
nd AS (SELECT lang, count(DISTINCT document_id) AS docs FROM chunks GROUP BY lang),
scored AS (SELECT s.lang, term, n, df, round(ln(1 + n::DOUBLE) * ln(1 + docs::DOUBLE / df), 4) AS score FROM stats s JOIN nd ON nd.lang = s.lang)"""
_TOP = "(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM scored WHERE n >= {f} AND df >= 2)"
_BEST = "(SELECT term, max(score) AS score FROM " + _TOP + " WHERE rank <= {k} GROUP BY term)"
_LABELS = "labels AS (SELECT DISTINCT lower(canonical) AS term FROM concepts)"
_SCORES = f"labels AS (SELECT lower(canonical) AS term, max(score) AS score, min({S.normal_lang('coalesce(lang, $$$$)')}) AS lang FROM concepts WHERE score IS NOT NULL GROUP BY 1)".replace("$$$$", "''")
_FREQ = f"""
ph AS (SELECT document_id, unnest({S.phrases('text', 5)}) AS term FROM chunks),
hit AS (SELECT term, count(*) AS tf, count(DISTINCT document_id) AS df FROM ph WHERE term IN (SELECT term FROM labels) GROUP BY term),
freq AS MATERIALIZED (SELECT l.term, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df FROM (SELECT DISTINCT term FROM labels) l LEFT JOIN hit ON hit.term = l.term)"""
_TOKENS = f"""
tok AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS token FROM chunks) WHERE length(token) > 1 AND token NOT IN ({S.quoted(L.STOPWORDS)}) GROUP BY token)"""
_CV = """
nest AS (SELECT a.term, avg(b.tf) AS m FROM freq a JOIN freq b ON length(b.term) > length(a.term) AND contains(' ' || b.term || ' ', ' ' || a.term || ' ') GROUP BY a.term),
cv AS MATERIALIZED (SELECT f.term, round(log2(1 + len(string_split(f.term, ' '))) * CASE WHEN m IS NULL THEN tf ELSE greatest(0, tf - m) END, 6) AS cvalue FROM freq f LEFT JOIN nest ON nest.term = f.term)"""
_PMI = """
tot AS (SELECT sum(n)::DOUBLE AS total FROM tok),
lw AS (SELECT term, unnest(string_split(term, ' ')) AS token FROM (SELECT DISTINCT term FROM labels)),
pm AS MATERIALIZED (SELECT term, CASE WHEN count(*) < 2 THEN 0 ELSE round(greatest(0, ln((min(coalesce(n, 0) / total) + 1e-12) / (exp(sum(ln(greatest(coalesce(n, 0) / total, 1e-12)))) + 1e-12))), 6) END AS pmi
  FROM lw LEFT JOIN tok ON tok.token = lw.token, tot GROUP BY term)"""
_SUPPRESS = f"""
st AS (SELECT l.term, l.score, l.lang, f.df, {S.tokens('l.term')} AS w FROM labels l JOIN freq f ON f.term = l.term),
cover AS (SELECT token, max(df) AS cover FROM (SELECT unnest(list_distinct(w)) AS token, df FROM st WHERE contains(term, ' ')) GROUP BY token),
kept AS MATERIALIZED (SELECT st.* FROM st LEFT JOIN cover ON cover.token = st.term WHERE NOT coalesce((SELECT count(*) > 0 FROM st WHERE contains(term, ' ')) AND len(w) = 1 AND
  (length(st.term) < 4 OR st.term IN ({S.quoted([*L.GENERIC_TERMS, *L.BAD_SINGLES])}) OR (df < 4 AND coalesce(cover, -1) >= greatest(2, df))), FALSE))"""
_CLEAN = (
    r"""trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(text, chr(0), ' '), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: NOT ("""
    + " OR ".join(f"starts_with(lower(l), '{p}')" for p in (*L.HEADER_PREFIXES, *L.BANNERS))
    + r""")), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))"""
)


def _textrank(rounds: int = 30) -> str:
    steps = [f"""
r0 AS MATERIALIZED (SELECT lang, term, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS s, count(*) OVER (PARTITION BY lang) AS n FROM v)"""]
    for k in range(rounds):
        steps.append(f"""
r{k + 1} AS MATERIALIZED (SELECT r.lang, r.term, 0.15::DOUBLE / r.n + 0.85::DOUBLE * coalesce(g, 0) AS s, r.n FROM r{k} r
  LEFT JOIN (SELECT e.lang, a, sum(p * q.s) AS g FROM e JOIN r{k} q ON q.lang = e.lang AND q.term = e.b GROUP BY ALL) g ON g.lang = r.lang AND g.a = r.term)""")
    return f"""WITH {CHUNKS},
w AS (SELECT lang, {S.content('text')} AS t FROM chunks),
v AS (SELECT DISTINCT lang, unnest(t) AS term FROM w),
o AS (SELECT lang, t, unnest(range(1, len(t) + 1)) AS i FROM w),
h AS (SELECT lang, t[i] AS a, unnest(t[i+1:i+4]) AS b FROM o),
y AS (SELECT lang, a, b, count(*) AS w FROM (SELECT * FROM h UNION ALL SELECT lang, b, a FROM h) GROUP BY ALL),
e AS MATERIALIZED (SELECT lang, a, b, w / sum(w) OVER (PARTITION BY lang, b) AS p FROM y),{','.join(steps)}
SELECT lang, term, score FROM (SELECT lang, term, round(s, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY round(s, 6) DESC, term) AS k FROM r{rounds})
WHERE k <= 200"""


ORACLE = {
    "text_clean_lines": f"SELECT doc_id, length({_CLEAN}) AS n_clean, md5({_CLEAN}) AS digest FROM documents",
    "sentence_split": r"""SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) GROUP BY doc_id""",
    "lang_heuristic": f"""WITH {CHUNKS}, h AS (SELECT chunk_id, lang, lower(text) AS low, {S.tokens('text')} AS t FROM chunks),
s AS (SELECT *, {' + '.join(f"contains(low, '{w}')::INT" for w in L.LANG_STOP_KK)} + len(list_filter(t, lambda k: k IN ({S.quoted(L.LANG_STOP_KK)}))) AS kk,
  {' + '.join(f"contains(low, '{w}')::INT" for w in L.LANG_STOP_RU)} + len(list_filter(t, lambda k: k IN ({S.quoted(L.LANG_STOP_RU)}))) AS ru FROM h)
SELECT chunk_id, lang, CASE WHEN regexp_matches(low, '[{L.KAZAKH_LETTERS}]') OR kk > ru THEN 'kk' WHEN ru > kk THEN 'ru' ELSE 'en' END AS heuristic FROM s""",
    "lang_distribution": f"WITH {CHUNKS} SELECT lang, count(*) AS n, count(DISTINCT document_id) AS docs FROM chunks GROUP BY lang",
    "dominant_language": f"""WITH {CHUNKS}, c AS (SELECT document_id, lang, count(*) AS n FROM chunks GROUP BY ALL)
SELECT document_id, lang, CAST(total AS BIGINT) AS n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY document_id) AS total FROM c) WHERE k = 1""",
    "token_frequency": f"WITH {CHUNKS}, {_TOKENS} SELECT token, n FROM tok",
    "noise_token_profile": f"WITH {CHUNKS}, t AS (SELECT lang, unnest({S.tokens('text')}) AS t FROM chunks) SELECT lang, count(*) AS n, count(*) FILTER (WHERE {S.noise_token('t')}) AS n_noise FROM t GROUP BY lang",
    "ngram_counts": f"WITH {_GRAMS} SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 3",
    "normalized_terms": f"WITH {_GRAMS} SELECT gram, term FROM norm WHERE term IS NOT NULL",
    "functional_phrases": f"SELECT canonical, lang, {S.functional_phrase('canonical', 'lang')} AS functional FROM (SELECT DISTINCT canonical, {S.normal_lang('coalesce(lang, chr(32))')} AS lang FROM concepts)",
    "label_quality": f"SELECT canonical, candidate, {S.low_quality('candidate')} AS low_quality FROM (SELECT canonical, {S.candidate('canonical')} AS candidate FROM (SELECT DISTINCT canonical FROM concepts))",
    "enumeration_parts": rf"""WITH p AS (SELECT id, unnest(string_split(regexp_replace(array_to_string(surface_forms, ', '), '\s*,\s*|\s+(?:and|or|и|или|және|немесе)\s+', chr(1), 'g'), chr(1))) AS x FROM concepts)
SELECT id, part, count(*) AS n FROM (SELECT id, {S.candidate('x')} AS part FROM p) WHERE part IS NOT NULL GROUP BY ALL""",
    "tfidf_top_terms": f"WITH {_TFIDF} SELECT lang, term, n, df, score, rank FROM {_TOP.format(f=2)} WHERE rank <= 500",
    "textrank_top_tokens": _textrank(),
    "merged_term_scores": f"""WITH {_TFIDF}, a AS {_BEST.format(f=2, k=1000)}, b AS {_BEST.format(f=5, k=300)}
SELECT coalesce(a.term, b.term) AS term, round(0.6 * coalesce(a.score / (SELECT max(score) FROM a), 0) + (1 - 0.6::DOUBLE) * coalesce(b.score / (SELECT max(score) FROM b), 0), 4) AS score FROM a FULL JOIN b ON a.term = b.term""",
    "term_frequencies": f"WITH {CHUNKS}, {_LABELS}, {_FREQ} SELECT term, tf, df FROM freq",
    "cvalue_scores": f"WITH {CHUNKS}, {_LABELS}, {_FREQ}, {_CV} SELECT term, cvalue FROM cv",
    "pmi_scores": f"WITH {CHUNKS}, {_LABELS}, {_TOKENS}, {_PMI} SELECT term, pmi FROM pm",
    "refined_scores": f"""WITH {CHUNKS}, {_SCORES}, {_FREQ}, {_TOKENS}, {_CV}, {_PMI},
j AS (SELECT l.term, l.score AS s, cvalue AS c, pmi AS p FROM labels l JOIN cv ON cv.term = l.term JOIN pm ON pm.term = l.term),
r AS (SELECT min(s) AS s0, max(s) AS s1, min(c) AS c0, max(c) AS c1, min(p) AS p0, max(p) AS p1 FROM j),
z AS (SELECT term, CASE WHEN s1 <= s0 THEN 1 ELSE (s - s0) / (s1 - s0) END AS s, CASE WHEN c1 <= c0 THEN 1 ELSE (c - c0) / (c1 - c0) END AS c, CASE WHEN p1 <= p0 THEN 1 ELSE (p - p0) / (p1 - p0) END AS p FROM j, r)
SELECT term, round(CASE WHEN contains(term, ' ') THEN 0.55::DOUBLE * s + 0.30::DOUBLE * c + 0.15::DOUBLE * p ELSE 0.80::DOUBLE * s + 0.20::DOUBLE * c END, 6) AS refined FROM z""",
    "subsumed_singles": f"WITH {CHUNKS}, {_SCORES}, {_FREQ}, {_SUPPRESS} SELECT term, score, df FROM kept",
    "term_quality_filter": f"""WITH {CHUNKS}, {_SCORES}, {_FREQ}, {_SUPPRESS},
x AS (SELECT min(score) AS lo, max(score) AS hi FROM labels), nd AS (SELECT count(DISTINCT document_id) AS docs FROM chunks),
q AS (SELECT term, lang, df, w, greatest(0, least(1, (0.55::DOUBLE * CASE WHEN hi <= lo THEN 1 ELSE (score - lo) / (hi - lo) END + 0.30::DOUBLE * least(1, (df::DOUBLE / greatest(1, docs)) / 0.6::DOUBLE) + 0.15::DOUBLE * CASE WHEN len(w) >= 2 THEN 1 ELSE 0.35::DOUBLE END)
  * (1.0::DOUBLE - 0.25::DOUBLE * regexp_matches(term, '\\p{{N}}')::INT - 0.25::DOUBLE * (len(w) = 1 AND length(term) <= 3)::INT - 0.30::DOUBLE * (len(w) > 4)::INT))) AS quality FROM kept, x, nd)
SELECT term, df, round(quality, 4) AS quality FROM q WHERE df >= 2 AND NOT (len(w) = 1 AND (length(term) < 4 OR term IN ({S.quoted(L.BAD_SINGLES)}) OR {S.noise_token('term')}))
  AND NOT {S.functional_phrase('term', 'lang')} AND quality >= 0.2 + CASE WHEN len(w) = 1 THEN 0.17 ELSE 0 END""".replace("\\\\p", "\\p"),
}
