"""How distinctive a term is for a record: log-odds ratio with an informative Dirichlet prior.

For a term with count y among the n terms of a record and count y' among the n' terms of all other texts, with a prior
of a pseudo counts for it out of a0 in all, shared out as in the whole collection:

    d = log((y + a) / (n + a0 - y - a)) - log((y' + a) / (n' + a0 - y' - a))
    z = d / sqrt(1 / (y + a) + 1 / (y' + a))

A term is a maximal run of letters and digits, in lower case. Rows with the same text count as one text in the
collection, and each of them gets the scores.

Input rules: rows with a null record id or text and texts without a term give no row; repeated rows (same id, same
text) give one; an id with several texts gets the terms of each; an empty input gives an empty result; other columns
are ignored. All counts cover all rows.

One shuffle brings equal texts together; tokens are counted where their text lies, and the counts are stored once for all
that reads them. Terms found in a large part of all texts, and texts found in a large part of all rows, are spread over
several tasks where they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforest.operators.joins import spread_join
from termforest.session import store

TERM = r"[\p{L}\p{N}]+"


def _distinct_texts(df: DataFrame, text: str) -> DataFrame:
    rows = df.select(F.col(text).alias("text")).filter("text is not null")
    return rows.groupBy(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")).agg(F.first("text").alias("text"))


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """(k1, k2, n, term, y) of every distinct text: its key, its number of terms, a term and its count."""
    tokens = _distinct_texts(df, text).select("k1", "k2", F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)).alias("tokens"))
    spread = tokens.select("k1", "k2", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    return spread.groupBy("k1", "k2", "n", "term").agg(F.count("*").alias("y"))


def term_scores(df: DataFrame, record: str, text: str, min_count: int = 1, min_texts: int = 1, max_texts: int | None = None, min_z: float | None = None, prior: float = 1000.0) -> DataFrame:
    """(record, term, y, texts, z): score of each term of each record.

    ``min_count`` is the least count in the record, ``min_texts`` and ``max_texts`` bound the number of different texts
    that hold the term, ``min_z`` is a score to be exceeded; they select which scores come out and change none.
    """
    counts = store(term_counts(df, text))
    everything = counts.agg(F.sum("y")).scalar()
    stats = counts.groupBy("term").agg(F.sum("y").alias("total"), F.count("*").alias("texts")).filter(F.col("texts") >= min_texts)
    if max_texts is not None:
        stats = stats.filter(F.col("texts") <= max_texts)
    joined = spread_join(counts.filter(F.col("y") >= min_count), stats, ["term"], ["k1", "k2"])
    a0 = F.lit(float(prior))
    a = a0 * F.col("total") / everything
    y, rest, n_rest = F.col("y"), F.col("total") - F.col("y"), everything - F.col("n")
    tiny = F.lit(1e-9)
    odds = F.log((y + a) / F.greatest(F.col("n") + a0 - y - a, tiny)) - F.log((rest + a) / F.greatest(n_rest + a0 - rest - a, tiny))
    scored = joined.withColumn("z", odds / F.sqrt(1 / (y + a) + 1 / (rest + a)))
    if min_z is not None:
        scored = scored.filter(F.col("z") > min_z)
    ids = (
        df.select(F.col(record).alias("record"), F.col(text).alias("text"))
        .dropna()
        .select("record", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
        .distinct()
    )
    return spread_join(ids, scored, ["k1", "k2"], ["record"]).select("record", "term", "y", "texts", "z")
