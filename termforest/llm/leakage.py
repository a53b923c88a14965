"""Evaluation passages inside training texts, by a distributed positional inverted index.

The postings (term, document, positions) of the training tokens are written as a table whose parts are each sorted by
term; of interest are the terms of the passages. From every stretch of ``RUN`` words of a passage the ``RAREST`` terms
by document frequency are its anchors: a document that repeats the stretch holds all of them at one offset, and one that
repeats several sentences with some words changed holds most of them near one offset. Intersecting the offset-adjusted
lists of the anchors gives candidates, which are then read word by word:

* exact phrase: at least ``RUN`` successive words of the passage;
* proximity: two whole sentences or more, with at most ``CHANGED`` of the words altered, dropped or added.

A sentence that stands beside ``SHARED`` or more different passages is an instruction and no part of a passage; so items
with equal passages keep them. Letter case, punctuation, spacing, invisible characters and look-alike letters are
levelled out before.

The passages are a stated query set: a set over ``MOST_CHARS`` characters is refused, which bounds what is sent to the
executors; a larger one is asked in several calls. The index is built once for all of them, and the anchors of ``BLOCK``
words at a time are joined with it. The training texts may be of any number and length.

Input rules: items and documents with a null id or text are ignored; a passage without a stretch of ``RUN`` words can
only be found by proximity, one with fewer than two sentences only by a phrase; repeated rows give one result row; empty
tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforest.session import cut, store

RUN = 12
RAREST = 3
SHARED = 5
CHANGED = 0.2
BAND = 16
CLOSE = 5
BLOCK = 400_000
MOST_CHARS = 40_000_000

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
# fixed values: Cyrillic and Greek letters and the Latin ones they look like
_ALIKE = str.maketrans("аеорсухіјѕһԁԛԝвнкмтёαορντκιυ", "aeopcyxijshdqwbhkmteaopvtkiu")
# fixed values: ranges of characters without a visible form
_UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
_INVISIBLE = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _UNSEEN) + "]")


class _Levelled(dict):
    """Words by their levelled form, so that each different word is worked out once; emptied when it is full."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = plain = word.translate(_ALIKE)
        return plain


_LEVELLED = _Levelled()


def words_of(text: str) -> list[str]:
    """The levelled words of a text."""
    text = _INVISIBLE.sub("", text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    found = _TOKEN.findall(text.lower())
    return found if text.isascii() else [_LEVELLED[w] for w in found]


def passages_of(items: list[tuple[int, str]], shared: int = SHARED) -> dict[int, list[list[str]]]:
    """Sentences (as words) of each item's passage, without the instructions that items share.

    The sentences that the fewest items hold are the core of an item. A sentence beside ``shared`` different cores, and no
    part of these, is an instruction.
    """
    split = {i: [w for w in map(words_of, _SENTENCE.split(t)) if w] for i, t in items}
    seen = Counter(s for sentences in split.values() for s in {tuple(w) for w in sentences})
    beside: dict[tuple[str, ...], set[frozenset]] = defaultdict(set)
    for sentences in split.values():
        least = min((seen[tuple(w)] for w in sentences), default=0)
        core = frozenset(tuple(w) for w in sentences if seen[tuple(w)] == least)
        for w in sentences:
            if tuple(w) not in core:
                beside[tuple(w)].add(core)
    return {i: [w for w in sentences if len(beside.get(tuple(w), ())) < shared] for i, sentences in split.items()}


def build_index(docs: DataFrame, record: str, text: str, terms: dict[str, int]) -> DataFrame:
    """Stored postings (term, doc, positions) of ``terms`` in all texts; each part of the table is sorted by term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("doc", docs.schema[record].dataType), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            term_parts, doc_parts, sizes, places = [], [], [], []
            for k, t in enumerate(texts):
                codes = np.fromiter((number(w, -1) for w in words_of(t)), dtype=np.int32)
                at = np.flatnonzero(codes >= 0)
                if len(at):
                    order = at[np.argsort(codes[at], kind="stable")]
                    found, counts = np.unique(codes[order], return_counts=True)
                    term_parts.append(found)
                    sizes.append(counts)
                    doc_parts.append(np.full(len(found), k))
                    places.append(order.astype(np.int32))
            if term_parts:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(term_parts)), ids.take(pa.array(np.concatenate(doc_parts))), lists], names=["term", "doc", "positions"])

    rows = docs.select(F.col(record).alias("doc"), F.col(text).alias("text")).dropna()
    return store(rows.mapInArrow(postings, schema).sortWithinPartitions("term"))


def anchors_of(passages: dict[int, list[list[str]]], terms: dict[str, int], frequency: dict[int, int]) -> list[tuple[int, int, int]]:
    """(term, item, place in the passage): the rarest terms present of every stretch of ``RUN`` words."""
    found = set()
    for item, sentences in passages.items():
        words = [w for s in sentences for w in s]
        codes = [terms[w] for w in words]
        present = [(frequency[c], k) if c in frequency else None for k, c in enumerate(codes)]
        for start in range(max(1, len(words) - RUN + 1)):
            rarest = sorted(p for p in present[start : start + RUN] if p)[:RAREST]
            found.update((codes[k], item, k) for _, k in rarest)
    return sorted(found)


def _aligned(passage: list[str], bounds: list[tuple[int, int]], words: list[str]) -> bool:
    """Whether ``words`` hold two sentences of the passage with few changes."""
    # two whole sentences with few changes need most of their words somewhere; this spares most alignments
    present = set(words)
    if sum(1 for s, e in bounds if sum(w in present for w in passage[s:e]) >= (1 - CHANGED) * 0.8 * (e - s)) < 2:
        return False
    blocks = [b for b in SequenceMatcher(None, passage, words, autojunk=False).get_matching_blocks() if b.size]
    for i in range(len(blocks)):
        matched = changed = 0
        for j in range(i, len(blocks)):
            b = blocks[j]
            if j > i:
                before = blocks[j - 1]
                changed += max(b.a - before.a - before.size, b.b - before.b - before.size)
            matched += b.size
            if changed > CHANGED * (matched + changed) + 3:
                break
            first, last = blocks[i].a, b.a + b.size
            whole = sum(1 for s, e in bounds if min(e, last) - max(s, first) >= 0.8 * (e - s))
            if whole >= 2 and changed <= CHANGED * (matched + changed) and matched >= RUN:
                return True
    return False


def _runs(grams: set[tuple[str, ...]], words: list[str]) -> bool:
    """Whether one of the runs of ``RUN`` words of a passage occurs in ``words``."""
    return any(tuple(words[k : k + RUN]) in grams for k in range(len(words) - RUN + 1))


def leaked_items(docs: DataFrame, record: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(doc, item): which items' passages each document repeats."""
    queries = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).dropna().distinct()
    total = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total > MOST_CHARS:
        raise ValueError(f"the query set has {total} characters; at most {MOST_CHARS} are taken at a time")
    passages = {i: p for i, p in passages_of([(r["item"], r["text"]) for r in queries.orderBy("item", "text").collect()]).items() if p}
    return _leaks_of(docs, record, text, passages, items.schema[item].dataType)


def _blocks(passages: dict[int, list[list[str]]]) -> list[list[int]]:
    """Items in groups of about ``BLOCK`` words."""
    blocks, size = [[]], 0
    for i, sentences in sorted(passages.items()):
        words = sum(map(len, sentences))
        if blocks[-1] and size + words > BLOCK:
            blocks.append([])
            size = 0
        blocks[-1].append(i)
        size += words
    return blocks


def _leaks_of(docs: DataFrame, record: str, text: str, passages: dict[int, list[list[str]]], item_type: T.DataType) -> DataFrame:
    spark = docs.sparkSession
    terms = {w: k for k, w in enumerate(sorted({w for p in passages.values() for s in p for w in s}))}
    index = build_index(docs, record, text, terms)
    frequency = {r["term"]: r["n"] for r in index.groupBy("term").agg(F.count("*").alias("n")).collect()}
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("item", item_type), T.StructField("place", T.IntegerType())])
    hits = None
    for block in _blocks(passages):
        anchors = spark.createDataFrame(anchors_of({i: passages[i] for i in block}, terms, frequency), schema)
        # the query block bounds the anchors, so they are sent to the postings
        found = index.join(F.broadcast(anchors), "term").select("doc", "item", "place", F.explode("positions").alias("at"))
        hits = found if hits is None else hits.unionAll(found)
    # a repeated stretch has all its anchors at one offset; a changed copy of two sentences has most of theirs close by
    lists = hits.groupBy("doc", "item", (F.col("at") - F.col("place")).alias("offset")).agg(F.count("*").alias("n"))
    band = F.floor(F.col("offset") / BAND)
    # every offset goes into two bands, so that offsets less than a band apart meet in one
    near = lists.select("doc", "item", "n", F.explode(F.array(band, band + 1)).alias("band"))
    met = near.groupBy("doc", "item", "band").agg(F.max("n").alias("at_one"), F.sum("n").alias("close"))
    candidates = met.filter((F.col("at_one") >= RAREST) | (F.col("close") >= CLOSE)).select("doc", "item", "band")
    per_doc = candidates.groupBy("doc").agg(F.collect_list(F.struct("item", "band")).alias("hits"))
    rows = docs.select(F.col(record).alias("doc"), F.col(text).alias("text")).dropna().join(cut(per_doc), "doc")
    shared = spark.sparkContext.broadcast(passages)

    @F.pandas_udf(T.ArrayType(item_type))
    def leaked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = {}
        for texts, hits in batches:
            out = []
            for t, places in zip(texts, hits):
                words, found = words_of(t), []
                bands: dict = {}
                for p in places:
                    bands.setdefault(p["item"], set()).add(p["band"])
                for i, offsets in bands.items():
                    if i not in known:
                        sentences, bounds, start = shared.value[i], [], 0
                        for s in sentences:
                            bounds.append((start, start + len(s)))
                            start += len(s)
                        joined = [w for s in sentences for w in s]
                        known[i] = joined, bounds, {tuple(joined[k : k + RUN]) for k in range(len(joined) - RUN + 1)}
                    passage, bounds, grams = known[i]
                    for stretch in _stretches(offsets, len(passage)):
                        part = words[max(0, stretch[0]) : stretch[1]]
                        if _runs(grams, part) or _aligned(passage, bounds, part):
                            found.append(i)
                            break
                out.append(found)
            yield pd.Series(out, dtype=object)

    return rows.select("doc", F.explode(leaked("text", "hits")).alias("item")).distinct()


def _stretches(bands: set[int], size: int) -> list[tuple[int, int]]:
    """Word ranges of a document that hold a passage of ``size`` words at the offsets of ``bands``, joined if near."""
    found: list[list[int]] = []
    for b in sorted(bands):
        start, stop = (b - 2) * BAND, (b + 2) * BAND + size
        if found and b - found[-1][2] <= 2:
            found[-1][1], found[-1][2] = stop, b
        else:
            found.append([start, stop, b])
    return [(s, e) for s, e, _ in found]
