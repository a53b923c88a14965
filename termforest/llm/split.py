"""Splitting oversized items at natural boundaries by agglomerative merging.

An item over its limit is cut into atoms at sentence ends, line breaks and paragraph breaks; an atom that would not fit
a piece by itself is cut at clause marks, then at blanks, then at other marks, then anywhere. All adjacent atoms wait in a heap by the
strength of the boundary between them, and the weakest boundary is merged away first as long as the merged core, with
the overlap that goes before it, fits the limit. What is left are pieces that end at the strongest boundaries.

Each piece after the first repeats the ``overlap`` characters before its core, so consecutive pieces overlap by exactly
that many characters and all pieces together cover the item without a gap.

Input rules: sizes are Unicode characters; an item with a null text or limit, or not over its limit, is not cut; a null
or negative overlap is 0; an overlap over half of the limit is taken as half of it, and a limit below 1 as 1; repeated
rows are cut alike; an empty input gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, MARK, NONE = 6, 5, 4, 3, 2, 1, 0
_STRONG = re.compile(r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>\n\s*)|(?<=[.!?…])(?P<s>[^\S\n]+)")
_CLAUSE = re.compile(r"(?<=[;:,—–])\s+")
_BLANK = re.compile(r"\s+")
_MARK = re.compile(r"(?<=[^\w\s])")


def _atoms(text: str, room: int) -> tuple[list[int], list[int]]:
    """(ends of the atoms, strength of the boundary at each end); white space stays with the atom before it."""
    ends, strength = [], []
    for m in _STRONG.finditer(text):
        if m.end() < len(text):
            ends.append(m.end())
            strength.append(PARAGRAPH if m["p"] else LINE if m["l"] else SENTENCE)
    ends.append(len(text))
    strength.append(PARAGRAPH)
    for pattern, level in ((_CLAUSE, CLAUSE), (_BLANK, WORD), (_MARK, MARK), (None, NONE)):
        new_ends, new_strength, start = [], [], 0
        for end, s in zip(ends, strength):
            if end - start > room:
                cuts = range(start + room, end, room) if pattern is None else [m.end() for m in pattern.finditer(text, start, end) if m.end() < end]
                new_ends += cuts
                new_strength += [level] * len(cuts)
            new_ends.append(end)
            new_strength.append(s)
            start = end
        ends, strength = new_ends, new_strength
    return ends, strength


def piece_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of ``text``; one span if it is within the limit."""
    limit = max(1, limit)
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = min(max(0, overlap), limit // 2)
    room = limit - overlap
    ends, strength = _atoms(text, room)
    count = len(ends)
    starts = [0, *ends[:-1]]
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    alive = [True] * count
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        # an entry is stale once one of its atoms was merged or has grown
        if not alive[i] or j >= count or after[i] != j or ends[j] - starts[i] != size:
            continue
        if size > (limit if i == 0 else room):
            continue
        ends[i], strength[i], after[i], alive[j] = ends[j], strength[j], after[j], False
        if after[j] < count:
            before[after[j]] = i
            heapq.heappush(heap, (strength[i], ends[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (strength[p], ends[i] - starts[p], p, i))
    return [(max(0, starts[i] - overlap), ends[i]) for i in range(count) if alive[i]]


@F.pandas_udf(SPANS)
def _spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, limits, overlaps in batches:
        yield pd.Series([
            [{"start": a, "stop": b} for a, b in piece_spans(t, int(m), 0 if pd.isna(o) else int(o))] if isinstance(t, str) and not pd.isna(m) else None
            for t, m, o in zip(texts, limits, overlaps)
        ], dtype=object)


def oversized(text: Column, limit: Column) -> Column:
    """True for items over their limit; false, not null, for missing texts and limits."""
    return F.coalesce(limit.isNotNull() & (F.length(text) > F.greatest(limit, F.lit(1))), F.lit(False))


def spans_of(text: Column, limit: Column, overlap: Column) -> Column:
    """Array of the (start, stop) spans of an item's pieces."""
    return _spans(text, limit.cast("int"), overlap.cast("int"))
