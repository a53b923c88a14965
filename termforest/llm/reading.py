"""Reading level of texts: regularised ordinal regression on graded text.

A text is described by length (sentences, words), lexical diversity, word rarity, connectives and a proxy of clause
depth. A proportional-odds model with an L2 penalty orders the levels by one score of these features and gives each
level a probability. It is fitted on graded rows, at most ``SAMPLE`` of them (those with the smallest hash of their id):
their features are worked out on the executors, so the driver sees nine numbers of each and no text; the fit ends when
the gradient is zero.
The graded rows are drawn per level; so the level probabilities are adjusted to the proportions that they themselves
imply over the whole corpus, by expectation maximisation over a histogram of scores.

Word rarity is counted over all texts: the negative log of a word's relative frequency, with a floor of ``RAREST``; at
most 1 / ``RAREST`` words can lie above that floor, which bounds the table sent to the executors at every size. A word's
everyday share, how much more often graded texts of the lowest level hold it than the others do, is the second side; it
is taken of the same bounded table of words.

Input rules: header lines (``Name: value``, before the first blank line) are left out; a null text or one without words
has a null level and score; a text of one sentence or word is scored like any other; repeated rows are scored alike;
graded rows without a text or with a level not in the list are ignored; with fewer than two levels graded, no level is
given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforest.session import store

SAMPLE = 5000
RAREST = 1e-5
CELLS = 200
WORD = r"\p{L}{2,}"

_WORD = re.compile(r"[^\W\d_]{2,}")
_HEADER = re.compile(r"\A(?:[^\W\d_]{2,20}: .*\n)+\s*")
_ENTITY = re.compile(r"&#?\w{1,10};")
_BREAK = re.compile(r"[.!?…]+(?=\s|$)|\n+")
_CLAUSE = re.compile(r"[,;:()—–]")
# fixed values: connectives of the four languages
CONNECTIVES = frozenset(
    "and but or because although while when if so then that which whereby unless before after despite provided "
    "и но или потому что хотя когда если чтобы который поэтому пока поскольку несмотря вследствие "
    "және бірақ немесе өйткені себебі егер сондықтан дегенмен ал әрі қарамастан нәтижесінде "
    "und aber oder weil obwohl während wenn dass damit sodass wodurch bis denn sofern".split()
)
FEATURES = ("sentence_length", "longest_sentence", "word_length", "long_words", "diversity", "rarity", "everyday", "connectives", "clauses")


def body_sentences(text: str) -> list[str]:
    body = _ENTITY.sub(" ", _HEADER.sub("", text))
    return [s for s in _BREAK.split(body) if _WORD.search(s)]


def features_of(text: str | None, rarity: dict[str, float], everyday: dict[str, float]) -> list[float] | None:
    """The values of ``FEATURES``, or None for a text without words."""
    sentences = body_sentences(text) if isinstance(text, str) else []
    if not sentences:
        return None
    split = [_WORD.findall(s.lower()) for s in sentences]
    words = [w for ws in split for w in ws]
    lengths = sorted(len(ws) for ws in split)
    sizes = [len(w) for w in words]
    n, floor = len(words), -math.log(RAREST)
    get, known, joins = rarity.get, everyday.get, CONNECTIVES
    return [
        math.log(n / len(split)),
        math.log(lengths[int(0.9 * (len(lengths) - 1))]),
        sum(sizes) / n,
        sum(k > 8 for k in sizes) / n,
        len(set(words)) / math.sqrt(n),
        sum(get(w, floor) for w in words) / n,
        sum(known(w, 0.0) for w in words) / n,
        sum(w in joins for w in words) / len(split),
        math.log1p(sum(len(_CLAUSE.findall(s)) for s in sentences) / len(split)),
    ]


@dataclass
class ReadingModel:
    levels: list[str]
    rarity: dict[str, float] = field(default_factory=dict)
    everyday: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None
    cuts: np.ndarray | None = None
    prior: np.ndarray | None = None
    true_prior: np.ndarray | None = None

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(feature rows of the texts that have words, mask of those)."""
        rows = [features_of(t, self.rarity, self.everyday) for t in texts]
        has = np.array([r is not None for r in rows], dtype=bool)
        return np.array([r for r in rows if r is not None], dtype=float).reshape(int(has.sum()), len(FEATURES)), has

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.beta

    def probabilities(self, score: np.ndarray, adjusted: bool = True) -> np.ndarray:
        upto = _sigmoid(self.cuts[None, :] - score[:, None])
        p = np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1), axis=1)
        p = np.maximum(p, 1e-12)
        if adjusted and self.true_prior is not None:
            p = p * (self.true_prior / self.prior)
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, tolerance: float = 1e-8) -> ReadingModel:
        """Proportional odds by damped Newton steps, until no entry of the gradient is over ``tolerance``; ``y`` are level numbers."""
        k = len(self.levels)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.mean) / self.scale
        self.prior = np.maximum(np.bincount(y, minlength=k), 0.5) / max(1, len(y))
        below = np.clip(np.cumsum(self.prior)[:-1], 0.02, 0.98)
        first = np.log(below / (1 - below))
        d = z.shape[1]

        def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
            gaps = np.exp(theta[d + 1 :])
            cuts = np.append(theta[d] + np.concatenate([[0.0], np.cumsum(gaps)]), 0.0)
            s = z @ theta[:d]
            upper = np.where(y < k - 1, _sigmoid(cuts[y] - s), 1.0)
            lower = np.where(y > 0, _sigmoid(cuts[y - 1] - s), 0.0)
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            of_cut = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) for j in range(k - 1)])
            slope = np.concatenate([z.T @ (du - dl) + penalty * theta[:d], [of_cut.sum()], [of_cut[j + 1 :].sum() * gaps[j] for j in range(k - 2)]])
            return (penalty * (theta[:d] ** 2).sum() / 2 - np.log(p).sum()) / len(y), slope / len(y)

        # cuts as a first one and logs of gaps stay in order
        theta = np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
        (now, slope), damp, h = loss(theta), 1e-3, 1e-5
        while np.abs(slope).max() > tolerance and damp < 1e12:  # past that no step lowers the loss in floating point
            bend = np.array([(loss(theta + h * e)[1] - loss(theta - h * e)[1]) / (2 * h) for e in np.eye(len(theta))])
            while damp < 1e12:
                step = theta - np.linalg.lstsq((bend + bend.T) / 2 + damp * np.eye(len(theta)), slope, rcond=None)[0]
                new, new_slope = loss(step)
                if new <= now:
                    theta, now, slope, damp = step, new, new_slope, max(damp / 10, 1e-9)
                    break
                damp *= 10
        self.beta = theta[:d]
        self.cuts = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
        return self

    def adjust(self, scores: np.ndarray, counts: np.ndarray, rounds: int = 200) -> None:
        """Level proportions of a corpus given as a histogram of scores."""
        if counts.sum() == 0:
            return
        raw, prior = self.probabilities(scores, adjusted=False), self.prior.copy()
        for _ in range(rounds):
            p = raw * (prior / self.prior)
            p /= p.sum(axis=1, keepdims=True)
            prior = np.maximum((p * counts[:, None]).sum(axis=0) / counts.sum(), 1e-6)
        self.true_prior = prior


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def everyday_words(counts: dict[str, tuple[int, int]], low: int, others: int) -> dict[str, float]:
    """Log ratio of the share of lowest-level texts that hold a word to that of the others, within -3..3.

    ``counts``: texts of either kind that hold a word; ``low`` and ``others``: their numbers.
    """
    def ratio(a: int, b: int) -> float:
        return max(-3.0, min(3.0, math.log((a + 0.5) / (low + 1)) - math.log((b + 0.5) / (others + 1))))

    return {w: ratio(a, b) for w, (a, b) in counts.items() if a + b > 1}


def word_rarity(df: DataFrame, text: str) -> dict[str, float]:
    """Negative log relative frequency, over all texts, of the words more frequent than ``RAREST``."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).scalar()
    frequent = words.withColumn("share", F.col("n") / total).filter(F.col("share") >= RAREST)
    return {r["w"]: -math.log(r["share"]) for r in frequent.select("w", "share").collect()}


def fit_reading_model(df: DataFrame, record: str, text: str, graded: DataFrame, level: str, levels: list[str], sample: int = SAMPLE) -> ReadingModel:
    """Fit on the texts of ``df`` graded in ``graded`` (record, level); ``levels`` from the easiest to the hardest.

    The words of one half of the graded texts are judged by the other half, so that no text vouches for itself.
    """
    model = ReadingModel(levels, word_rarity(df, text))
    marks = graded.select(F.col(record), F.col(level).alias("_level")).filter(F.col("_level").isin(levels)).orderBy(F.xxhash64(record), record, "_level").limit(sample)
    number = F.array_position(F.array(*map(F.lit, levels)), F.col("_level")) - 1
    rows = df.select(record, F.col(text).alias("_text")).join(F.broadcast(marks), record)
    rows = store(rows.select("_text", number.cast("int").alias("y"), F.pmod(F.xxhash64(record), F.lit(2)).cast("int").alias("half")))
    spark = df.sparkSession
    rarity = spark.sparkContext.broadcast(model.rarity)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def known_words(texts: pd.Series) -> pd.Series:
        known = rarity.value
        return pd.Series([None if not isinstance(t, str) or not (ss := body_sentences(t)) else sorted({w for s in ss for w in _WORD.findall(s.lower()) if w in known}) for t in texts], dtype=object)

    low = F.col("y") == 0
    held = rows.select("y", "half", known_words("_text").alias("words")).filter("words is not null")
    kinds = [(h, is_low) for h in (0, 1) for is_low in (True, False)]
    tally = [F.count_if((F.col("half") == h) & (low if is_low else ~low)).alias(f"n{h}{int(is_low)}") for h, is_low in kinds]
    sizes = held.agg(*tally).first()
    # no more words than the rarity table has
    words = held.select("y", "half", F.explode("words").alias("w")).groupBy("w").agg(*tally).collect()

    def everyday(halves: tuple[int, ...]) -> dict[str, float]:
        def of(row, is_low: int) -> int:
            return sum(row[f"n{h}{is_low}"] for h in halves)

        return everyday_words({r["w"]: (of(r, 1), of(r, 0)) for r in words}, of(sizes, 1), of(sizes, 0))

    others = spark.sparkContext.broadcast([everyday((1,)), everyday((0,))])
    model.everyday = everyday((0, 1))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def described(texts: pd.Series, halves: pd.Series) -> pd.Series:
        return pd.Series([features_of(t, rarity.value, others.value[h]) for t, h in zip(texts, halves)], dtype=object)

    data = rows.select("y", described("_text", "half").alias("x")).filter("x is not null").orderBy("y", "x").collect()
    y = np.array([r["y"] for r in data], dtype=int)
    return model.fit(np.array([r["x"] for r in data], dtype=float), y) if len(set(y.tolist())) > 1 else model


def score_texts(df: DataFrame, text: str, model: ReadingModel) -> DataFrame:
    """``df`` with ``reading_score`` (higher is harder), null for texts without words or without a fitted model."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            out = np.full(len(texts), np.nan)
            if m.beta is not None:
                x, has = m.features(list(texts))
                out[has] = m.score(x)
            yield pd.Series(out)

    return df.withColumn("reading_score", F.nanvl(score(F.col(text)), F.lit(None).cast("double")))


def with_levels(scored: DataFrame, model: ReadingModel) -> DataFrame:
    """``scored`` with ``level`` and ``confidence``; proportions are adjusted to those of all its rows."""
    if model.beta is None:
        return scored.withColumn("level", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    lo, hi = float(model.cuts[0] - 15), float(model.cuts[-1] + 15)
    cell = F.least(F.greatest(F.floor((F.col("reading_score") - lo) / ((hi - lo) / CELLS)), F.lit(0)), F.lit(CELLS - 1))
    histogram = scored.filter("reading_score is not null").groupBy(cell.alias("cell")).count().collect()
    at = np.array([lo + (r["cell"] + 0.5) * (hi - lo) / CELLS for r in histogram])
    model.adjust(at, np.array([r["count"] for r in histogram], dtype=float))
    # the probabilities of the levels as column expressions of the score
    s, prior = F.col("reading_score"), model.true_prior if model.true_prior is not None else model.prior
    upto = [F.lit(0.0), *[1 / (1 + F.exp(s - F.lit(float(c)))) for c in model.cuts], F.lit(1.0)]
    odds = [(upto[i + 1] - upto[i]) * float(prior[i] / model.prior[i]) for i in range(len(model.levels))]
    total = sum(odds[1:], odds[0])
    best = F.greatest(*odds)
    level = F.when(s.isNull(), None)
    for name, o in zip(model.levels, odds):
        level = level.when(o == best, name)
    return scored.withColumn("level", level).withColumn("confidence", best / total)
