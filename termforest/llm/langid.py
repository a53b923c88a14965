"""Languages of documents and of the one-language segments inside them: word-first backoff.

A model holds, per language, log frequencies of words and of character n-grams. A sentence is scored word by word: a
known word by its log frequency in each language, an unseen one by the mean log frequency of its longest n-grams that
are known, going down from ``LONGEST`` characters to one. Sentences are labelled by the sum over their words; adjacent
ones of one language form a segment, and a short or undecided sentence joins the segment beside it.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` of each language, those with the smallest
hash of their id, none over ``SAMPLE_CHARS`` characters. Some labels are wrong, so the sentences are labelled once with
the first model and the counts taken again. The sample bounds the model that is sent to the executors; nothing else is
cut off it. A word or n-gram seen once in the sample says little and is left to shorter n-grams. Labelling covers every
row and the whole text.

Input rules: a null text has no language and no segments; neither has a text without a whole sentence (``SENTENCE_WORDS``
words of two letters or more with no digit attached) and with fewer than two words or far more codes and figures; markup entities are ignored; repeated rows are
labelled alike; a language without a labelled row is never assigned; without any labelled row nothing is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 2000
SAMPLE_CHARS = 20_000
LONGEST = 5
SENTENCE_WORDS = 5
SURE = 0.9
WORD_SPREAD = 6.0

_TOKEN = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&#?\w{1,10};")
_BREAK = re.compile(r"[.!?…]+[\"»”“')\]]*(?=\s|$)|\n+")
# fixed values: Cyrillic letters that look like Latin ones, and the Latin letters
_CYRILLIC, _LATIN = "аеорсухіһԁԛԝ", "aeopcyxihdqw"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYRILLIC, _LATIN), str.maketrans(_LATIN, _CYRILLIC)
_LATIN_LETTER, _CYRILLIC_LETTER = re.compile(r"[a-z]"), re.compile(r"[Ѐ-ԯ]")

RESULT = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]))),
])


def language_code(label: Column) -> Column:
    """The language of a label such as ``EN``, `` en`` or ``en_US``; null if there is none."""
    code = F.lower(F.regexp_extract(F.trim(label), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(code != "", code)


def _ngrams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def _one_script(word: str) -> str:
    """``word`` with look-alike letters of the rarer script written in the other one."""
    latin, cyrillic = len(_LATIN_LETTER.findall(word)), len(_CYRILLIC_LETTER.findall(word))
    return word if not latin or not cyrillic else word.translate(_TO_LATIN if latin >= cyrillic else _TO_CYRILLIC)


def _log_frequencies(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
    total = Counter()
    for c in counts:
        total.update(c)
    keys = [k for k, n in sorted(total.items(), key=lambda x: (-x[1], x[0])) if n > 1]
    table = np.array([[c[k] + 0.5 for k in keys] for c in counts], dtype=np.float64).T.reshape(len(keys), len(counts))
    logs = np.log(table / (np.array([sum(c.values()) for c in counts]) + 0.5 * max(1, len(keys))))
    return {k: i for i, k in enumerate(keys)}, np.maximum(logs, logs.max(axis=1, keepdims=True) - WORD_SPREAD) if len(keys) else logs


def _sentences(text: str) -> list[tuple[int, int, list[str], int]]:
    """(start, stop, words, other tokens) of each sentence of ``text``."""
    text = _ENTITY.sub(lambda m: " " * len(m.group()), text)
    found, start = [], 0
    for stop in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        if stop > start:
            tokens = _TOKEN.findall(text[start:stop].lower())
            words = [t for t in tokens if len(t) > 1 and t.isalpha()]
            found.append((start, stop, words, len(tokens) - len(words)))
            start = stop
    return found


@dataclass
class LanguageModel:
    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    ngrams: list[dict[str, int]] = field(default_factory=list)
    ngram_logs: list[np.ndarray] = field(default_factory=list)
    _seen: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], langs: list[str]) -> LanguageModel:
        """A model of (lang, text) rows, refitted once on the labels that the first fit gives their sentences."""
        sentences = [(lang, words) for lang, text in rows for _, _, words, _ in _sentences(text) if words]
        present = [x for x in langs if any(lang == x for lang, _ in sentences)]
        model = cls(present)
        if not present:
            return model
        for again in (True, False):
            index = {x: i for i, x in enumerate(present)}
            words = [Counter() for _ in present]
            for lang, ws in sentences:
                if lang in index:
                    words[index[lang]].update(ws)
            model.words, model.word_logs = _log_frequencies(words)
            model.ngrams, model.ngram_logs = [], []
            for n in range(1, LONGEST + 1):
                grams = [Counter() for _ in present]
                for c, g in zip(words, grams):
                    for w, k in c.items():
                        for x in _ngrams(w, n):
                            g[x] += k
                keys, logs = _log_frequencies(grams)
                model.ngrams.append(keys)
                model.ngram_logs.append(logs)
            model._seen = {}
            if again:
                scores = model.scores([ws for _, ws in sentences])
                sentences = [(present[k], ws) for k, (_, ws) in zip(scores.argmax(axis=1), sentences)]
        return model

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known n-grams of ``word``."""
        known = self._seen.get(word)
        if known is None:
            plain = _one_script(word)
            if plain in self.words:
                known = self.word_logs[self.words[plain]]
            else:
                known = np.zeros(len(self.langs))
                for n in range(min(LONGEST, len(plain) + 2), 0, -1):
                    keys = self.ngrams[n - 1]
                    hits = [keys[g] for g in _ngrams(plain, n) if g in keys]
                    if hits:
                        known = self.ngram_logs[n - 1][hits].mean(axis=0)
                        break
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[word] = known
        return known

    def word_scores(self, words: list[str]) -> np.ndarray:
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out = self.word_logs[ids] if len(self.words) else np.zeros((len(words), len(self.langs)))
        for i in np.flatnonzero(ids < 0):
            out[i] = self.unseen(words[i])
        return out

    def scores(self, sentences: list[list[str]]) -> np.ndarray:
        """Sum of the word scores of each (non-empty) sentence, by language."""
        flat = self.word_scores([w for ws in sentences for w in ws])
        starts = np.cumsum([0] + [len(ws) for ws in sentences[:-1]])
        return np.add.reduceat(flat, starts, axis=0)

    def label(self, texts: list[str | None]) -> list[dict | None]:
        """Language, confidence, languages of whole sentences, and segments of each text."""
        parsed = [_sentences(t) if isinstance(t, str) else [] for t in texts]
        flat = [s[2] for p in parsed for s in p if s[2]]
        if not flat or not self.langs:
            return [None] * len(texts)
        each = self.word_scores([w for ws in flat for w in ws])
        starts = np.cumsum([0] + [len(ws) for ws in flat[:-1]])
        sums = np.add.reduceat(each, starts, axis=0)
        sizes = np.diff(np.append(starts, len(each)))
        best = sums.argmax(axis=1)
        sure = _top_share(sums)
        # share of a sentence's words that speak for its language by themselves
        own = np.add.reduceat((each[np.arange(len(each)), np.repeat(best, sizes)] >= each.max(axis=1) - 1e-9).astype(float), starts) / sizes
        whole = (sizes >= SENTENCE_WORDS) & (sure >= SURE) & (own >= 0.6)
        out, k = [], 0
        for sentences in parsed:
            n = sum(1 for s in sentences if s[2])
            span = slice(k, k + n)
            k += n
            words, others = int(sizes[span].sum()), sum(s[3] for s in sentences)
            if not whole[span].any() and (words < 2 or words * 2 < others):
                out.append(None)
                continue
            total = sums[span].sum(axis=0)
            langs = sorted({self.langs[b] for b, w in zip(best[span], whole[span]) if w})
            top = self.langs[int(total.argmax())]
            if langs and top not in langs:
                by = np.bincount(best[span][whole[span]], weights=sizes[span][whole[span]], minlength=len(self.langs))
                top = self.langs[int(by.argmax())]
            out.append({
                "lang": top,
                "confidence": float(_top_share(total[None, :])[0]) if len(langs) < 2 else float(sizes[span][best[span] == self.langs.index(top)].sum() / words),
                "langs": langs or [top],
                "segments": self._segments(sentences, best[span], sums[span], whole[span], top),
            })
        return out

    def _segments(self, sentences: list, best: np.ndarray, sums: np.ndarray, whole: np.ndarray, top: str) -> list[dict]:
        segments: list[list] = []
        i = 0
        for start, stop, words, _ in sentences:
            lang, total = None, None
            if words:
                lang, total = (int(best[i]) if whole[i] else None), sums[i]
                i += 1
            if segments and (lang is None or segments[-1][2] is None or segments[-1][2] == lang):
                last = segments[-1]
                last[1], last[2] = stop, last[2] if lang is None else lang
                if total is not None:
                    last[3] = last[3] + total
            else:
                segments.append([start, stop, lang, np.zeros(len(self.langs)) if total is None else total])
        out = []
        for start, stop, lang, total in segments:
            lang = self.langs.index(top) if lang is None else lang
            share = np.exp(total - total.max())
            out.append({"start": start, "stop": stop, "lang": self.langs[lang], "confidence": float(share[lang] / share.sum())})
        return out


def _top_share(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e.max(axis=1) / e.sum(axis=1)


def fit_language_model(df: DataFrame, record: str, text: str, label: str, langs: list[str], sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` labelled rows of each of ``langs``."""
    rows = df.select(language_code(F.col(label)).alias("lang"), F.col(text).alias("text"), F.xxhash64(record).alias("h"))
    rows = rows.filter(F.length("text").between(1, SAMPLE_CHARS) & F.col("lang").isin(langs))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen: list[tuple[str, str]] = []
    for lang, n in sorted(counts.items()):
        # hashes below this bound are about twice the sample, so no task hands on more than its share of that
        share = min(1.0, 2 * sample / n)
        below = rows.filter((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 40)) <= int(share * (1 << 40))))
        chosen += [(r["lang"], r["text"]) for r in below.orderBy(F.pmod("h", F.lit(1 << 40)), "text").limit(sample).collect()]
    return LanguageModel.fit(chosen, langs)


def label_languages(df: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """``df`` with a column ``language`` (see ``RESULT``), null where the text has none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = RESULT.names
        for texts in batches:
            found = shared.value.label(list(texts))
            yield pd.DataFrame({n: [None if r is None else r[n] for r in found] for n in names}, columns=names)

    labelled = df.withColumn("language", label(F.col(text)))
    return labelled.withColumn("language", F.when(F.col("language.lang").isNotNull(), F.col("language")))
