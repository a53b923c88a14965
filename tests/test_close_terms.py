"""Similar terms and closest labels without comparing all with all."""

import random

from pyspark.sql import functions as F

from termforest.operators import relations as R
from termforest.operators import terms as T


def test_absorbed_terms_are_those_of_a_plain_search(monkeypatch):
    rnd = random.Random(4)
    calls, ratio = [], T.indel_ratio
    monkeypatch.setattr(T, "indel_ratio", lambda a, b: calls.append(a) or ratio(a, b))
    for letters, size in (("ab ", 9), ("abcdefgh ", 14), ("aéİß", 5)):
        terms = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(size))) for _ in range(150)]
        terms += [t + "s" for t in terms[:50]]
        for threshold in (60.0, 85.0, 100.0):
            kept, want = [], []
            for i, t in enumerate(terms):
                want.append(next((k for k in kept if ratio(t, terms[k]) >= threshold), i))
                kept += [i] * (want[-1] == i)
            assert T.absorbed_by(terms, threshold, 32) == want
    calls.clear()
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(600)]
    assert T.absorbed_by(words, 85.0) == list(range(600)) and len(calls) < 1000
    assert T.absorbed_by([], 85.0) == []


def test_closest_labels_are_those_of_a_comparison_of_all(spark):
    rnd = random.Random(8)
    words = ("solar", "battery", "grid", "loan", "desk", "unit")
    phrases, labels = ({" ".join(rnd.choice(words) + rnd.choice(("", "", "s")) for _ in range(rnd.randrange(1, 7))) for _ in range(60)} for _ in "ab")
    tables = [spark.createDataFrame([(x,) for x in sorted(side)], f"{name} string") for side, name in ((phrases | {"", "- -"}, "phrase"), (labels, "label"))]
    for least, least_overlap in ((0.62, 0.6), (0.3, 0.2), (1.0, 1.0)):
        want = {}
        for p in phrases:
            a, options = set(p.split()), []
            for x in labels:
                b = set(x.split())
                k = len(a & b)
                overlap, ratio = k / len(a | b), 2 * min(len(p), len(x)) / (len(p) + len(x))
                if k and overlap >= least:
                    options.append((False, -overlap, x))
                elif k and min(len(p), len(x)) >= 5 and (p in x or x in p) and k / len(a) >= least_overlap and ratio >= 0.72:
                    options.append((True, -(k / len(a) + 0.35 * ratio), x))
            if options:
                want[p] = min(options)[2]
        got = R.closest_labels(*tables, least, least_overlap)
        assert {r["phrase"]: r["label"] for r in got.collect()} == want and len(want) > 5
    assert [r["p"] for r in spark.range(1).select(R._pairs(F.array(*map(F.lit, "cab"))).alias("p")).collect()] == [["a b", "a c", "b c"]]
