"""Term extraction and scoring over chunks (columns ``chunk_id``, ``document_id``, ``lang``, ``text``).

Chunks with a null text give no terms. Scores are ordered by falling score, then by term, so results do not depend on
the order of the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforest.functions import lexicon as L
from termforest.functions import text as X
from termforest.session import cut


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(lang, term, n, df): uses of each normalised n-gram and the number of documents that hold it."""
    grams = chunks.select("lang", "document_id", F.explode(X.extract_ngrams("text")).alias("gram"))
    per_doc = grams.groupBy("lang", "gram", "document_id").agg(F.count("*").alias("n"))
    # a vocabulary is far smaller than its uses, so each different n-gram is normalised once and joined back
    known = per_doc.select("gram").distinct().select("gram", X.normalize_term("gram").alias("term")).filter("term is not null")
    terms = per_doc.join(known, "gram")
    return terms.groupBy("lang", "term", "document_id").agg(F.sum("n").alias("n")).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def top_per_group(df: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def tfidf(chunks: DataFrame, max_terms: int = 1000, min_freq: int = 2, min_doc_freq: int = 2) -> DataFrame:
    """(lang, term, n, df, score, rank) of the best terms of each language."""
    docs = chunks.groupBy("lang").agg(F.count_distinct("document_id").alias("docs"))
    kept = term_statistics(chunks).filter((F.col("n") >= min_freq) & (F.col("df") >= min_doc_freq)).join(F.broadcast(docs), "lang")
    score = F.round(F.log1p(F.col("n").cast("double")) * F.log1p(F.col("docs").cast("double") / F.col("df")), 4)
    return top_per_group(kept.withColumn("score", score).drop("docs"), "lang", "score", "term", max_terms)


def cooccurrence(chunks: DataFrame, window: int = 4) -> DataFrame:
    """(lang, a, b, w): symmetric counts of content tokens at most ``window`` apart; equal ones count twice."""
    words = chunks.select("lang", X.content_tokens("text").alias("t"))
    pairs = words.select("lang", F.explode(F.flatten(F.transform(F.col("t"), lambda x, i: F.transform(F.slice(F.col("t"), i + 2, window), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    one = pairs.groupBy("lang", "p.a", "p.b").agg(F.count("*").alias("w"))
    return one.unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("lang", "a", "b").agg(F.sum("w").alias("w"))


def textrank(chunks: DataFrame, max_terms: int = 1000, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """(lang, term, score, rank): power iteration over the column-normalised co-occurrence graph of each language."""
    edges = cooccurrence(chunks)
    total = Window.partitionBy("lang", "b")
    edges = cut(edges.select("lang", "a", "b", (F.col("w") / F.sum("w").over(total)).alias("p")))
    nodes = chunks.select("lang", F.explode(X.content_tokens("text")).alias("term")).distinct()
    sizes = nodes.groupBy("lang").agg(F.count("*").alias("n"))
    rank = cut(nodes.join(F.broadcast(sizes), "lang").select("lang", "term", "n", (F.lit(1.0) / F.col("n")).alias("s")))
    for k in range(iterations):
        sent = edges.join(rank.select("lang", F.col("term").alias("b"), "s"), ["lang", "b"])
        got = sent.groupBy("lang", F.col("a").alias("term")).agg(F.sum(F.col("p") * F.col("s")).alias("g"))
        rank = rank.select("lang", "term", "n").join(got, ["lang", "term"], "left").select("lang", "term", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("g", F.lit(0.0))).alias("s"))
        if k % 3 == 2:
            rank = cut(rank)
    scored = rank.select("lang", "term", F.round("s", 6).alias("score"))
    return top_per_group(scored, "lang", "score", "term", max_terms)


def best_language(scores: DataFrame) -> DataFrame:
    """(term, score, lang): highest score of a term over the languages; the smaller code wins a tie."""
    best = F.min_by(F.struct("score", "lang"), F.struct(-F.col("score"), "lang"))
    return scores.groupBy("term").agg(best.alias("b")).select("term", "b.score", "b.lang")


def merge_scores(a: DataFrame, b: DataFrame, alpha: float = 0.6) -> DataFrame:
    """(term, score): each side divided by its maximum, then weighted; a missing term counts 0 there."""
    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = df.agg(F.max("score")).scalar()
        return df.select("term", (F.col("score") / F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top)).alias(name))

    both = scaled(a, "x").join(scaled(b, "y"), "term", "full_outer")
    return both.select("term", F.round(alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0)), 4).alias("score"))


PLAIN = r"^[\p{L}\p{N}_]+( [\p{L}\p{N}_]+)*$"


SIEVE_WORDS = 1 << 18


def sieve(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that every value of ``column`` passes and few others do: one bit per value in ``SIEVE_WORDS`` longs.

    Its size is fixed (2 MB); with very many values it only lets more of the others through.
    """
    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(64 * SIEVE_WORDS))

    def word(x: Column) -> Column:
        return F.floor(place(x) / 64).cast("int")

    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place(x) % 64).cast("int"))

    bits = values.select(word(F.col(column)).alias("k"), bit(F.col(column)).alias("b"))
    zeros = values.sparkSession.range(0, SIEVE_WORDS, 1, 4).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("bigint").alias("b"))
    filled = bits.unionByName(zeros).groupBy("k").agg(F.bit_or("b").alias("b"))
    table = filled.agg(F.sort_array(F.collect_list(F.struct("k", "b"))).alias("t")).select(F.col("t.b")).scalar()
    return lambda x: F.get(table, word(x)).bitwiseAND(bit(x)) != 0


def phrase_hits(chunks: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, chunk_id, document_id, term, hits): whole-term uses of ``terms`` (column ``term``) in each chunk.

    Terms of words with single blanks are found by an equality join with the phrases of a chunk, as long as the longest
    term; phrases that no term can be are dropped by a :func:`sieve` before they are shuffled. Terms with other characters (hyphens, apostrophes) are
    joined by their first word and then searched for in the texts that hold it; a term without a word is found nowhere.
    ``keys`` must agree too (a collection, say).
    """
    wanted = terms.select(*keys, "term").distinct()
    is_plain = F.col("term").rlike(PLAIN)
    longest, n_odd = terms.agg(F.max(F.when(is_plain, F.size(F.split("term", " ")))), F.count_if(~is_plain)).first()
    plain = wanted.filter(is_plain)
    found = chunks.select(*keys, "chunk_id", "document_id", F.explode(X.phrases("text", longest or 1)).alias("term")).filter(sieve(plain, "term")(F.col("term")))
    by_phrase = found.join(plain, [*keys, "term"]).groupBy(*keys, "chunk_id", "document_id", "term").agg(F.count("*").alias("hits"))
    if not n_odd:
        return by_phrase
    odd = wanted.filter(~is_plain).withColumn("_w", F.get(X.tokens("term"), F.lit(0))).dropna(subset=["_w"])
    holds = chunks.select(*keys, "chunk_id", F.explode(F.array_distinct(X.tokens("text"))).alias("_w")).join(odd, [*keys, "_w"])
    texts = holds.drop("_w").join(chunks.select(*keys, "chunk_id", "document_id", F.lower("text").alias("_t")), [*keys, "chunk_id"])
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower("term"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    hits = F.size(F.regexp_extract_all("_t", whole, F.lit(0)))
    return by_phrase.unionByName(texts.select(*keys, "chunk_id", "document_id", "term", hits.cast("bigint").alias("hits")).filter("hits > 0"))


def _phrases_in(texts: DataFrame, plain: DataFrame, keys: tuple[str, ...], longest: int) -> DataFrame:
    """(keys, document_id, term): those of :func:`X.phrases` that begin with the first word of a term of ``plain``, and few others.

    Word by word and without functions of lambdas, which Spark does not compile.
    """
    may_begin = sieve(plain.select(F.struct(*keys, F.get(F.split("term", " "), F.lit(0)).alias("w")).alias("p")).distinct(), "p")
    runs = texts.select(*keys, "document_id", F.explode(X.word_runs("text")).alias("run")).select(*keys, "document_id", F.trim("run").alias("run"))
    starts = runs.select(*keys, "document_id", "run", F.posexplode(F.split("run", " ")).alias("i", "w")).filter(may_begin(F.struct(*keys, "w")))
    starts = starts.select(*keys, "document_id", F.split("run", " ").alias("words"), "i")
    phrase = lambda n: F.when(F.size("words") >= F.col("i") + n, F.array_join(F.slice("words", F.col("i") + 1, n), " "))
    return starts.select(*keys, "document_id", F.explode(F.array(*[phrase(n) for n in range(1, longest + 1)])).alias("term")).filter("term is not null")


def phrase_frequencies(chunks: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, term, tf, df): uses of each term of ``terms`` that is found, and the number of documents with it.

    The same counts as those of :func:`phrase_hits`. The texts of a document are brought together before they are cut
    into phrases, so that only counts of terms are shuffled; ``keys`` must be the same for all chunks of a document. Only
    phrases whose first word begins a term are put together.
    """
    wanted = terms.select(*keys, "term").distinct()
    is_plain = F.col("term").rlike(PLAIN)
    longest, n_odd = terms.agg(F.max(F.when(is_plain, F.size(F.split("term", " ")))), F.count_if(~is_plain)).first()
    plain = wanted.filter(is_plain)
    may_be = sieve(plain.select(F.struct(*keys, "term").alias("p")), "p")
    texts = chunks.select(*keys, "document_id", "text").repartition("document_id")
    found = _phrases_in(texts, plain, keys, longest or 1).filter(may_be(F.struct(*keys, "term")))
    per_doc = found.groupBy("document_id", *keys, "term").agg(F.count("*").alias("n"))
    out = per_doc.groupBy(*keys, "term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).join(plain, [*keys, "term"])
    if n_odd:
        odd = phrase_hits(chunks, terms.filter(~is_plain), keys).groupBy("document_id", *keys, "term").agg(F.sum("hits").alias("n"))
        out = out.unionByName(odd.groupBy(*keys, "term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")))
    return out


def term_frequencies(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, tf, df) of every term; 0 for terms without a hit."""
    return terms.select("term").distinct().join(phrase_frequencies(chunks, terms), "term", "left").na.fill(0, ["tf", "df"])


def token_frequencies(chunks: DataFrame) -> DataFrame:
    """(token, n) of the tokens that are longer than one letter and no stop words."""
    words = chunks.select(F.explode(X.tokens("text")).alias("token"))
    return words.filter((F.length("token") > 1) & ~F.col("token").isin(L.STOPWORDS)).groupBy("token").agg(F.count("*").alias("n"))


def min_max(value: str | Column) -> Column:
    """Value scaled to 0..1 over all rows; 1.0 if all are equal."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy()
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(hi <= lo, 1.0).otherwise((v - lo) / (hi - lo))


def _scaled(df: DataFrame, *columns: str) -> DataFrame:
    """``min_max`` of columns by two scalars each, without bringing all rows into one task."""
    out = df
    for c in columns:
        lo, hi = df.agg(F.min(c)).scalar(), df.agg(F.max(c)).scalar()
        out = out.withColumn(f"n_{c}", F.when(hi <= lo, 1.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return out


def words_in(term: str = "term") -> Column:
    return F.size(F.split(term, " "))


def cvalue(frequencies: DataFrame) -> DataFrame:
    """(term, cvalue) of (term, tf): a term inside longer ones loses their mean frequency."""
    parts = X.let(F.split("term", " "), lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: X.ngrams(w, n))))
    inside = frequencies.select(F.col("term").alias("longer"), F.col("tf").alias("f"), F.explode(F.array_distinct(parts)).alias("term")).filter("longer <> term")
    outer = inside.groupBy("term").agg(F.avg("f").alias("mean_longer"))
    base = F.when(F.col("mean_longer").isNull(), F.col("tf").cast("double")).otherwise(F.greatest(F.lit(0.0), F.col("tf") - F.col("mean_longer")))
    return frequencies.join(outer, "term", "left").select("term", F.round(F.log2(1.0 + words_in()) * base, 6).alias("cvalue"))


def pmi(terms: DataFrame, token_counts: DataFrame) -> DataFrame:
    """(term, pmi): log of the rarest word's share over the product of all shares; 0 for single words."""
    total = F.coalesce(F.nullif(token_counts.agg(F.sum("n")).scalar(), F.lit(0)), F.lit(1)).cast("double")
    words = terms.select("term", F.explode(F.split("term", " ")).alias("token"))
    shares = words.join(token_counts, "token", "left").withColumn("p", F.coalesce("n", F.lit(0)) / total)
    per = shares.groupBy("term").agg(F.min("p").alias("least"), F.sum(F.log(F.greatest("p", F.lit(1e-12)))).alias("logs"), F.count("*").alias("k"))
    value = F.log((F.col("least") + 1e-12) / (F.exp("logs") + 1e-12))
    return per.select("term", F.when(F.col("k") < 2, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), value), 6)).alias("pmi"))


def refine(scores: DataFrame, frequencies: DataFrame, token_counts: DataFrame) -> DataFrame:
    """(term, score, cvalue, pmi, refined) of (term, score)."""
    base = scores.select("term", "score")
    joined = cut(base.join(cvalue(frequencies), "term").join(pmi(base, token_counts), "term"))
    s = _scaled(joined, "score", "cvalue", "pmi")
    multi = 0.55 * F.col("n_score") + 0.30 * F.col("n_cvalue") + 0.15 * F.col("n_pmi")
    single = 0.80 * F.col("n_score") + 0.20 * F.col("n_cvalue")
    return s.select("term", "score", "cvalue", "pmi", F.round(F.when(words_in() >= 2, multi).otherwise(single), 6).alias("refined"))


def suppress_subsumed(scores: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Scores without the single words that are too weak or covered by a term of several words."""
    t = scores.join(frequencies.select("term", "df"), "term", "left").na.fill(0, ["df"])
    several = t.filter(F.size(F.split("term", " ")) >= 2)
    cover = several.select(F.explode(F.array_distinct(X.tokens("term"))).alias("term"), F.col("df").alias("d")).groupBy("term").agg(F.max("d").alias("cover"))
    single = F.size(X.tokens("term")) == 1
    weak = (F.length("term") < 4) | F.col("term").isin([*L.GENERIC_TERMS, *L.BAD_SINGLES])
    covered = (F.col("df") < 4) & (F.coalesce("cover", F.lit(-1)) >= F.greatest(F.lit(2), F.col("df")))
    any_several = several.agg(F.count("*")).scalar() > 0
    return t.join(cover, "term", "left").filter(~(any_several & single & (weak | covered))).drop("cover")


def quality(base: Column, df: Column, total_docs: Column) -> Column:
    """Quality of a term from its scaled score, document share and shape."""
    n = F.size(X.tokens("term"))
    shape = 1.0 - 0.25 * F.col("term").rlike(r"\p{N}").cast("int") - 0.25 * ((n == 1) & (F.length("term") <= 3)).cast("int") - 0.30 * (n > 4).cast("int")
    value = 0.55 * base + 0.30 * F.least(F.lit(1.0), (df / F.greatest(F.lit(1), total_docs)) / 0.6) + 0.15 * F.when(n >= 2, 1.0).otherwise(0.35)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value * shape)))


def quality_filter(scores: DataFrame, frequencies: DataFrame, total_docs: Column, min_doc_freq: int = 2, min_quality: float = 0.40) -> DataFrame:
    """(term, score, df, quality) of (term, score, lang) rows that are good enough; single words need 0.17 more."""
    scaled = _scaled(scores, "score")
    kept = suppress_subsumed(scaled, frequencies)
    single = F.size(X.tokens("term")) == 1
    bad = single & ((F.length("term") < 4) | F.col("term").isin(L.BAD_SINGLES) | X.is_noise_token(F.col("term")))
    q = kept.withColumn("quality", quality(F.col("n_score"), F.col("df"), total_docs))
    return q.filter((F.col("df") >= min_doc_freq) & ~bad & ~X.is_functional_phrase("term", "lang") & (F.col("quality") >= min_quality + F.when(single, 0.17).otherwise(0.0))).drop("n_score")


def indel_ratio(a: str, b: str) -> float:
    """100 x 2 LCS / (both lengths), the LCS by bit-parallel dynamic programming."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _hashed(features: list[list], size: int) -> np.ndarray:
    """A row of ``size`` counts per list of different features; the product of two rows is at least what they share."""
    out, place = np.zeros((len(features), size), np.float32), {}
    for row, own in zip(out, features):
        for f in own:
            row[place.setdefault(f, len(place)) % size] += 1
    return out


def _numbered(parts: list[str]) -> list[tuple[str, int]]:
    seen: dict[str, int] = {}
    return [(x, seen.setdefault(x, 0), seen.update({x: seen[x] + 1}))[:2] for x in parts]


def absorbed_by(terms: list[str], threshold: float, block: int = 256) -> list[int]:
    """For each term the place of the first kept term that is similar enough, or its own if it is kept itself.

    Of two terms of S letters together whose common subsequence has L letters, at least L letters are the same, and at
    least 3 L - S - 1 pairs of neighbouring letters; only terms that have that many are compared.
    """
    sizes = np.array([len(t) for t in terms], float)
    letters, pairs = _hashed([_numbered(list(t)) for t in terms], 256), _hashed([_numbered([t[i : i + 2] for i in range(len(t) - 1)]) for t in terms], 512)
    kept, out = np.zeros(len(terms), int), []
    n = 0

    def possible(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        ks = kept[lo:hi]
        least = threshold * (sizes[rows][:, None] + sizes[ks]) / 200 - 1e-6
        return (letters[rows] @ letters[ks].T >= least) & (np.minimum(sizes[rows][:, None], sizes[ks]) >= least)

    for start in range(0, len(terms), block):
        rows, before = np.arange(start, min(start + block, len(terms))), n
        far = possible(rows, 0, before)
        for i in rows:
            options = np.concatenate([kept[:before][far[i - start]], kept[before:n][possible(np.array([i]), before, n)[0]]])
            both = sizes[options] + sizes[i]
            options = options[pairs[options] @ pairs[i] >= 3 * (threshold * both / 200 - 1e-6) - both - 1]
            found = next((int(k) for k in options if indel_ratio(terms[i], terms[k]) >= threshold), int(i))
            out.append(found)
            if found == i:
                kept[n] = i
                n += 1
    return out


def dedupe_terms(scores: DataFrame, group: str | None = None, threshold: float = 85.0) -> DataFrame:
    """(group, term, score, surface_forms): similar terms are absorbed by the better one, in falling order of score.

    The order makes this sequential per group, so the input must be a bounded list of terms, as the extractors give it.
    """
    def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["score", "term"], ascending=[False, True])[["term", "score"]].itertuples(index=False, name=None))
        forms: dict[int, list[str]] = {}
        for k, (term, _) in zip(absorbed_by([term for term, _ in rows], threshold), rows):
            forms.setdefault(k, []).append(term)
        kept = [(*rows[k], own) for k, own in forms.items()]
        out = pd.DataFrame(kept, columns=["term", "score", "surface_forms"])
        out.insert(0, "grp", pdf["grp"].iloc[0])
        return out

    rows = scores.select((F.col(group) if group else F.lit("")).cast("string").alias("grp"), "term", "score")
    return rows.groupBy("grp").applyInPandas(absorb, "grp string, term string, score double, surface_forms array<string>")


def _hit_type() -> T.ArrayType:
    names = [("term", T.StringType()), ("start", T.IntegerType()), ("stop", T.IntegerType()), ("snippet", T.StringType())]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in names]))


def locate(text: str, term: str) -> list[tuple[int, int, str]]:
    """(start, stop, sentence) of each whole-term hit."""
    found = []
    for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", text, re.IGNORECASE):
        start = max(text.rfind(c, 0, m.start()) for c in ".?!") + 1
        stops = [p for p in (text.find(c, m.start()) for c in ".?!") if p >= 0]
        stop = max(m.end(), min(stops) + 1 if stops else len(text))
        snippet = " ".join(text[start:stop].split())
        if snippet:
            found.append((m.start(), m.end(), snippet))
    return found


def occurrences(chunks: DataFrame, terms: DataFrame, per_term: int = 80) -> DataFrame:
    """Located uses of terms, one of each document first, at most ``per_term`` of a term (a feature of the report)."""
    @F.pandas_udf(_hit_type())
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([[{"term": t, "start": a, "stop": b, "snippet": s} for t in ts for a, b, s in locate(x, t)] for x, ts in zip(texts, lists)], dtype=object)

    per_chunk = phrase_hits(chunks, terms).groupBy("chunk_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    hits = chunks.join(per_chunk, "chunk_id").select("chunk_id", "document_id", "chunk_index", F.explode(find("text", "terms")).alias("h")).select("chunk_id", "document_id", "chunk_index", "h.*")
    order = ["document_id", "chunk_index", "chunk_id", "start"]
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("term", "document_id").orderBy(*order[1:])))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.col("nth") > 1, *order))).filter(F.col("rank") <= per_term)
    words = X.tokens("term")
    letters = F.length(F.regexp_replace("term", r"[^\p{L}]", "")) / F.length("term")
    value = 0.55 + F.least(F.lit(0.18), 0.06 * F.greatest(F.lit(1), F.size(words))) + F.least(F.lit(0.08), 0.03 * F.size(F.array_distinct(words)))
    value = value - F.when(F.length("snippet") < 25, 0.07).otherwise(0.0) - F.when(letters < 0.65, 0.08).otherwise(0.0)
    return ranked.select("term", "chunk_id", "document_id", "start", "stop", "snippet", F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.96), value)), 3).alias("confidence"), "rank")


def extract_terms(chunks: DataFrame, max_terms: int = 500, min_freq: int = 2, min_doc_freq: int = 2, min_quality: float = 0.40, method: str = "both", threshold: float = 85.0) -> DataFrame:
    """The whole term stage: (term, lang, score, df, quality, surface_forms, rank)."""
    chunks = chunks.select("chunk_id", "document_id", "lang", "text")
    by_tfidf = best_language(tfidf(chunks, 2 * max_terms, min_freq, min_doc_freq)) if method != "textrank" else None
    by_rank = best_language(textrank(chunks, 2 * max_terms)) if method != "tfidf" else None
    scores = merge_scores(by_tfidf, by_rank) if method == "both" else (by_tfidf if by_rank is None else by_rank).select("term", "score")
    langs = by_tfidf if by_rank is None else by_rank if by_tfidf is None else best_language(by_tfidf.unionByName(by_rank))
    deduped = cut(dedupe_terms(scores, threshold=threshold))
    frequencies = cut(term_frequencies(chunks, deduped))
    refined = refine(deduped, frequencies, token_frequencies(chunks)).select("term", F.col("refined").alias("score"))
    refined = cut(refined.join(langs.select("term", "lang"), "term").filter(~X.is_noise_term("term") & ~X.is_functional_phrase("term", "lang")))
    docs = chunks.agg(F.count_distinct("document_id")).scalar()
    good = quality_filter(refined, frequencies, docs, min_doc_freq, min_quality).join(deduped.select("term", "surface_forms"), "term")
    return top_per_group(good.withColumn("all", F.lit(0)), "all", "score", "term", max_terms).drop("all")
