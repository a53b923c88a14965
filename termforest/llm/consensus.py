"""Consensus labels and annotator reliability from the spectrum of the agreement matrix.

For two annotators r and s with n common items let a be the share of these on which they agree, and e the agreement
expected from their own label frequencies; a - e is the chance-centred agreement. If annotators err independently, that
matrix is close to rank one, and its leading eigenvector is proportional to the annotators' skill: near zero for
guessing, negative for reversed labels. Overlaps differ, so an entry counts with its n, and the row of an annotator is
divided by the number of votes that meet theirs, plus ``prior``; the eigenvalues of that matrix are real. Power
iteration runs until the vector stands still, each step a join of the sparse matrix with the vector. The vector weights
the votes; from the consensus follow the reliabilities.

Input rules: rows with a null or blank annotator, a null item or a label that is neither positive nor negative (null,
abstention, unknown spelling) are no votes; of several votes of an annotator on an item the latest holds, at one time
the one with the greater tie key, then the positive one; annotators are compared trimmed and in lower case; an empty
input gives empty results. Repeated rows change nothing.

What is large stays distributed: votes are reduced to one row per (item, annotator). Items of up to ``PAIRED`` votes are
summed up to pairs of annotators once. Items of more votes are never paired: their share of a product with the matrix is
formed by two sums, over the votes of the item and over those of the annotator, which is linear in the votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforest.operators.joins import spread_join
from termforest.session import cut

PAIRED = 50
PARTS = 32
# fixed values: spellings of the two labels
POSITIVE = ("accepted", "approve", "approved", "true")
NEGATIVE = ("rejected", "reject", "false")


@dataclass(frozen=True)
class Consensus:
    items: DataFrame
    annotators: DataFrame


def vote_of(label: Column) -> Column:
    """1 or -1 for the spellings of the two labels in any case and padding, else null."""
    plain = F.lower(F.trim(label))
    return F.when(plain.isin(*POSITIVE), 1).when(plain.isin(*NEGATIVE), -1)


def votes_of(df: DataFrame, item: str, annotator: str, label: str, time: str, tie: str) -> DataFrame:
    """(item, annotator, vote): the latest vote of each annotator on each item."""
    who = F.lower(F.trim(F.col(annotator)))
    rows = df.select(F.col(item).alias("item"), F.when(who != "", who).alias("annotator"), vote_of(F.col(label)).alias("vote"), F.col(time).alias("time"), F.col(tie).alias("tie"))
    latest = rows.dropna(subset=["item", "annotator", "vote"]).groupBy("item", "annotator").agg(F.max_by("vote", F.struct("time", "tie", "vote")).alias("vote"))
    return latest


@dataclass(frozen=True)
class Agreement:
    """``pairs`` (r, s, n, g): common items and n (a - e) of ordered pairs, from items of few votes; ``wide`` (item,
    annotator, v, m): the votes on all other items with the annotator's mean vote, or None; ``reach`` (annotator, n)."""

    pairs: DataFrame
    wide: DataFrame | None
    reach: DataFrame


def agreement_of(votes: DataFrame, paired: int = PAIRED) -> Agreement:
    mean = votes.groupBy("annotator").agg(F.avg("vote").alias("m"))
    sizes = cut(votes.groupBy("item").agg(F.count("*").alias("k")).filter(F.col("k") > paired))
    wide, narrow = None, votes
    if sizes.limit(1).count():
        narrow = votes.join(sizes, "item", "left_anti")
        wide = cut(spread_join(votes, sizes, ["item"], ["annotator"]).join(mean, "annotator").select("item", "annotator", F.col("vote").alias("v"), "m", "k"))
    both = narrow.groupBy("item").agg(F.collect_list(F.struct("annotator", "vote")).alias("x")).filter(F.size("x") > 1)
    of_item = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["annotator"].alias("r"), b["annotator"].alias("s"), (a["vote"] * b["vote"]).alias("c")))))
    half = both.select(F.explode(of_item).alias("p")).groupBy(F.least("p.r", "p.s").alias("r"), F.greatest("p.r", "p.s").alias("s")).agg(F.count("*").alias("n"), F.sum("p.c").alias("c"))
    half = half.join(mean.select(F.col("annotator").alias("r"), F.col("m").alias("mr")), "r").join(mean.select(F.col("annotator").alias("s"), F.col("m").alias("ms")), "s")
    # votes are 1 and -1, so n (a - e) = (sum of products - n x product of the means) / 2
    half = cut(half.select("r", "s", "n", ((F.col("c") - F.col("n") * F.col("mr") * F.col("ms")) / 2).alias("g")))
    pairs = half.unionByName(half.select(F.col("s").alias("r"), F.col("r").alias("s"), "n", "g"))
    met = pairs.groupBy(F.col("r").alias("annotator")).agg(F.sum("n").alias("n"), F.sum(F.abs("g")).alias("most"))
    if wide is not None:
        met = met.unionByName(wide.groupBy("annotator").agg(F.sum(F.col("k") - 1).alias("n"), F.sum(F.col("k") - 1).cast("double").alias("most")))
    return Agreement(pairs, wide, cut(met.groupBy("annotator").agg(F.sum("n").alias("n"), F.sum("most").alias("most"))))


def _product(matrix: Agreement, vector: DataFrame) -> DataFrame:
    """(annotator, y): the matrix of n (a - e) times the vector (annotator, u)."""
    out = matrix.pairs.join(vector.select(F.col("annotator").alias("s"), "u"), "s").groupBy(F.col("r").alias("annotator")).agg(F.sum(F.col("g") * F.col("u")).alias("y"))
    if matrix.wide is None:
        return out
    rows = matrix.wide.join(vector, "annotator")
    sums = rows.groupBy("item").agg(F.sum(F.col("v") * F.col("u")).alias("sv"), F.sum(F.col("m") * F.col("u")).alias("sm"))
    others = (F.col("v") * (F.col("sv") - F.col("v") * F.col("u")) - F.col("m") * (F.col("sm") - F.col("m") * F.col("u"))) / 2
    # each item has more than PAIRED rows, so its sums in every part are still fewer than these; no item is one task
    part = F.pmod(F.xxhash64("annotator"), F.lit(PARTS))
    parts = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    far = rows.withColumn("part", part.cast("int")).join(parts, ["item", "part"]).groupBy("annotator").agg(F.sum(others).alias("y"))
    return out.unionByName(far).groupBy("annotator").agg(F.sum("y").alias("y"))


def leading_vector(matrix: Agreement, annotators: DataFrame, prior: float, tolerance: float = 1e-6) -> DataFrame:
    """(annotator, u): leading eigenvector with largest absolute entry 1 and a sum that is not negative.

    Half of a bound of the eigenvalues is added on the diagonal, so the largest one leads whatever the others' signs, and
    the iteration comes to a stand; four steps (one with wide items) are planned at a time, then written and normalised.
    """
    vector = cut(annotators.select("annotator", F.lit(1.0).alias("u")))
    bound = matrix.reach.agg(F.max(F.col("most") / (F.col("n") + F.lit(prior)))).first()[0]
    change = math.inf if bound else 0.0
    while change > tolerance:
        step = vector
        for _ in range(4 if matrix.wide is None else 1):
            scaled = _product(matrix, step).join(matrix.reach, "annotator").select("annotator", (F.col("y") / (F.col("n") + F.lit(prior))).alias("y"))
            step = step.join(scaled, "annotator", "left").select("annotator", (F.coalesce("y", F.lit(0.0)) / F.lit(1.5 * bound) + F.col("u") / 3).alias("u"))
        step = cut(step)
        top, total = step.agg(F.max(F.abs("u")), F.sum("u")).first()
        step = step.withColumn("u", F.col("u") / F.lit(top if total >= 0 else -top))
        change = step.join(vector.withColumnRenamed("u", "old"), "annotator").agg(F.max(F.abs(F.col("u") - F.col("old")))).first()[0]
        vector = step
    return vector


def _skills(matrix: Agreement, vector: DataFrame, share: float) -> DataFrame:
    """(annotator, b): the vector scaled to skill, by the multiple of its products that fits the matrix best."""
    above = _product(matrix, vector).join(vector, "annotator").agg(F.sum(F.col("y") * F.col("u"))).first()[0]
    ends = matrix.pairs.join(vector.select(F.col("annotator").alias("r"), F.col("u").alias("ur")), "r").join(vector.select(F.col("annotator").alias("s"), F.col("u").alias("us")), "s")
    below = ends.agg(F.sum(F.col("n") * F.pow(F.col("ur") * F.col("us"), 2))).first()[0] or 0.0
    if matrix.wide is not None:
        u2 = F.pow("u", 2)
        per = matrix.wide.join(vector, "annotator").groupBy("item").agg((F.pow(F.sum(u2), 2) - F.sum(u2 * u2)).alias("x"))
        below += per.agg(F.sum("x")).first()[0] or 0.0
    fit = max(above or 0.0, 0.0) / below if below > 0 else 0.0
    # of a rank-one matrix an entry is 2 x share x (1 - share) x both skills
    return vector.select("annotator", (F.col("u") * F.lit((fit / (2 * share * (1 - share))) ** 0.5)).alias("b"))


def _weighted(skill: DataFrame) -> DataFrame:
    """Log-odds weight of a vote by skill b = 2 x balanced accuracy - 1."""
    b = F.least(F.greatest("b", F.lit(-0.98)), F.lit(0.98))
    return skill.select("annotator", F.log((1 + b) / (1 - b)).alias("weight"))


def _reliabilities(votes: DataFrame, weights: DataFrame, prior: float, wide: bool) -> DataFrame:
    """(annotator, n_votes, reliability): balanced accuracy against the consensus of the other annotators.

    With p the probability of the positive label given the others' votes, a vote is positive with probability
    tpr p + fpr (1 - p); so the slope of votes on p is tpr - fpr, whatever errors that consensus has itself.
    """
    weighted = votes.join(weights, "annotator").withColumn("pull", F.col("vote") * F.col("weight"))
    sums = weighted.groupBy("item").agg(F.sum("pull").alias("all"), F.count("*").alias("n"))
    joined = spread_join(weighted, sums, ["item"], ["annotator"]) if wide else weighted.join(sums, "item")
    rest = joined.withColumn("p", F.when(F.col("n") > 1, 1 / (1 + F.exp(-(F.col("all") - F.col("pull") + F.lit(prior))))))
    positive = F.when(F.col("n") > 1, (F.col("vote") > 0).cast("double"))
    slope = F.covar_pop(positive, F.col("p")) / F.nullif(F.var_pop("p"), F.lit(0.0))
    return rest.groupBy("annotator").agg(F.count("*").alias("n_votes"), slope.alias("slope")).select("annotator", "n_votes", F.when(F.col("slope").isNotNull(), (1 + F.least(F.greatest("slope", F.lit(-1.0)), F.lit(1.0))) / 2).alias("reliability"))


def spectral_consensus(df: DataFrame, item: str, annotator: str, label: str, time: str, tie: str, prior: float = 10.0, paired: int = PAIRED) -> Consensus:
    """Consensus per item and reliability per annotator of the votes in ``df``.

    ``items``: item, label (accepted or rejected; an exact tie is rejected), confidence, agreement (share of the votes
    for that label), n_votes. ``annotators``: annotator, n_votes, skill (spectral), reliability (mean of the agreement
    on positive and on negative items; null if no item was labelled by another annotator too). ``prior`` is the number
    of votes on common items at which agreement counts half.
    """
    votes = cut(votes_of(df, item, annotator, label, time, tie))
    everyone = votes.groupBy("annotator").agg(F.count("*").alias("n"))
    share = votes.agg(F.avg((F.col("vote") > 0).cast("double"))).first()[0] or 0.5
    share = min(max(share, 0.01), 0.99)
    matrix = agreement_of(votes, paired)
    skill = cut(_skills(matrix, leading_vector(matrix, everyone, prior), share))
    odds = math.log(share / (1 - share))
    weights = _weighted(skill)
    annotators = _reliabilities(votes, weights, odds, matrix.wide is not None).join(skill, "annotator").select("annotator", "n_votes", F.col("b").alias("skill"), "reliability")
    sums = votes.join(weights, "annotator").groupBy("item").agg(F.sum(F.col("vote") * F.col("weight")).alias("pull"), F.count_if(F.col("vote") > 0).alias("ups"), F.count("*").alias("n_votes"))
    score = F.col("pull") + F.lit(odds)
    items = sums.select(
        "item",
        F.when(score > 0, "accepted").otherwise("rejected").alias("label"),
        (1 / (1 + F.exp(-F.abs(score)))).alias("confidence"),
        (F.when(score > 0, F.col("ups")).otherwise(F.col("n_votes") - F.col("ups")) / F.col("n_votes")).alias("agreement"),
        "n_votes",
    )
    return Consensus(items, annotators)
