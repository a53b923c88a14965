"""Mixing sources to target weights by Pareto order sampling.

Every record of a source is to be used e = lambda x weight times, at most ``max_repeats`` times, with lambda such that
the expected size of the source is its target. The whole part of e is used for certain. For the rest p = e - floor(e)
the records of the source are ranked by the odds of a random number over the odds of p, and the smallest ranks are
taken until the missing size is reached: Pareto sampling with unequal inclusion probabilities and a fixed size, here
fixed in size units. The random numbers are hashes of the record id and the seed, so a lost task repeats its choice.

Weights are rounded to ``CLASSES`` classes per doubling, so that lambda is solved over few classes per source; the cut
through a source's ranks is found over histograms (see the cutoff operator). No source has to fit a task.

Input rules: a record with a null source or a source without target is not used but counts in the size of everything;
a null size is 0; a null or not positive weight is 1; a null share is 0 and a null ``max_repeats`` 1; ids are taken to
be unique, repeated rows are records of their own that share one random number; an empty input gives sources of size 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforest.llm.cutoff import closest_cutoffs, score_frequencies
from termforest.operators.joins import spread_join
from termforest.session import cut

CLASSES = 8
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED_WORDS = 200_000


def token_counter(path: str):
    """Column function: number of tokens of a text by the byte-pair vocabulary file at ``path``; 0 for a null text.

    A merge never crosses the pieces into which the vocabulary's pattern cuts a text, so counts of pieces add up.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mixing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces, known = regex.compile(public_tokenizers.PATTERN).findall, {}
        for texts in batches:
            sizes = []
            for text in texts:
                size = 0
                for piece in pieces(text) if isinstance(text, str) else ():
                    n = known.get(piece)
                    if n is None:
                        n = len(encoding.encode_ordinary(piece))
                        if len(known) < CACHED_WORDS:
                            known[piece] = n
                    size += n
                sizes.append(size)
            yield pd.Series(sizes, dtype="int64")

    return count


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@dataclass(frozen=True)
class Mix:
    """``records``: record, source, size, copies (0 and more). ``sources``: source, size, target, short, used,
    most_copies, share; ``short`` where even all copies of all records of a source come to less than its target."""

    records: DataFrame
    sources: DataFrame


def allocate(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, target, most, factor) per target: size units wanted and the lambda that gives them.

    ``sizes``: source, size, class (weight class); ``targets``: source, target_share, max_repeats.
    """
    everything = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    goals = targets.select("source", (F.coalesce("target_share", F.lit(0.0)) * everything).alias("target"), F.coalesce("max_repeats", F.lit(1)).alias("most"))
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("s"))
    c = goals.join(classes, "source", "left").withColumn("s", F.coalesce("s", F.lit(0))).withColumn("w", F.pow(F.lit(2.0), F.coalesce("class", F.lit(0)) / CLASSES))
    # classes by falling weight; those before k are at their most, the others share what is left of the target
    down = Window.partitionBy("source").orderBy(F.desc("w"))
    c = c.withColumn("capped", F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("open", F.sum(F.col("s") * F.col("w")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    factor = F.try_divide(F.col("target") - F.col("capped") * F.col("most"), F.col("open"))
    fits = factor * F.col("w") <= F.col("most")
    return c.groupBy("source", "target", "most").agg(F.sum("s").alias("size"), F.max(F.when(fits, F.greatest(factor, F.lit(0.0)))).alias("factor"))


def mix_sources(records: DataFrame, targets: DataFrame, seed: int = 0) -> Mix:
    """``records``: record, source, size, weight; ``targets``: source, target_share, max_repeats."""
    rows = cut(weighted(records))
    plan = cut(allocate(rows, targets))
    e = F.when(F.col("factor").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("factor") * F.pow(F.lit(2.0), F.col("class") / CLASSES)))
    drawn = rows.join(F.broadcast(plan.select("source", "most", "factor")) if plan.count() <= 10_000 else plan.select("source", "most", "factor"), "source").withColumn("e", e)
    drawn = drawn.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.floor("e"))
    u = (F.pmod(F.xxhash64("record", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = drawn.withColumn("rank", F.when(F.col("p") > 0, F.try_divide(u, 1 - u) * (1 - F.col("p")) / F.nullif(F.col("p"), F.lit(0.0))))
    drawn = cut(drawn.select("record", "source", "size", "whole", "p", "rank"))
    part = drawn.filter("rank is not null")
    rest = part.groupBy("source").agg(F.try_divide(F.sum(F.col("p") * F.col("size")), F.sum("size")).alias("fraction")).filter("fraction is not null")
    cuts = closest_cutoffs(score_frequencies(part, {"source": F.col("source")}, -F.col("rank"), F.col("size")), rest, ["source"])
    limit = cuts.select("source", "cutoff")
    chosen = drawn.join(limit, "source", "left").withColumn("copies", (F.col("whole") + F.coalesce((-F.col("rank") >= F.col("cutoff")).cast("int"), F.lit(0))).cast("int"))
    chosen = cut(chosen.select("record", "source", "size", "copies"))
    used = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.min("copies").alias("least_copies"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("used")).scalar()
    done = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    spent = F.coalesce(F.col("least_copies") >= F.col("most"), F.lit(True))
    sources = done.select("source", "size", "target", (spent & (F.col("used") < F.col("target"))).alias("short"), "used", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.try_divide(F.col("used"), total), F.lit(0.0)).alias("share"))
    return Mix(chosen, sources)


def weighted(records: DataFrame) -> DataFrame:
    """(record, source, size, class) with defaults for missing sizes and weights."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    return records.select("record", "source", F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"), F.round(F.log2(w) * CLASSES).cast("int").alias("class"))


def text_keys(text: str) -> tuple[Column, Column]:
    """``_k1`` and ``_k2``, 128 bits in all, that stand for a text."""
    return F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")


def shared_text_weight(keyed: DataFrame) -> DataFrame:
    """``keyed`` (with :func:`text_keys`) with ``weight`` = 1 / number of rows with the same text, so that repeated texts
    are used as often as others."""
    copies = keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_n"))
    return spread_join(keyed, copies, ["_k1", "_k2"], ["record"]).withColumn("weight", 1.0 / F.col("_n")).drop("_k1", "_k2", "_n")
