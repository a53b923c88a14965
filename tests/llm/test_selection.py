"""Cutoffs, top items, consensus and mixing, against brute force and on dirty rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforest.llm.consensus import agreement_of, leading_vector, spectral_consensus, votes_of
from termforest.llm.cutoff import closest_cutoffs, score_frequencies
from termforest.llm.mixing import mix_sources
from termforest.llm.topn import top_items

NAN = float("nan")


def cutoffs(spark, rows, targets, **sizes):
    df = spark.createDataFrame(rows, "src string, score double, w int")
    t = spark.createDataFrame(targets, "src string, fraction double")
    out = closest_cutoffs(score_frequencies(df, {"src": F.col("src")}, F.col("score")), t, ["src"], **sizes)
    return {r["src"]: r for r in out.collect()}


@pytest.mark.parametrize("sizes", [{}, {"buckets": 4, "fine_rows": 3}])
def test_cutoffs_are_the_closest(spark, sizes):
    rnd = random.Random(1)
    rows = [(s, round(rnd.random(), 2), 0) for s in "ab" for _ in range(150)] + [("c", 0.5, 0)] * 10 + [("a", None, 0), ("a", NAN, 0), (None, 0.1, 0), (None, 0.9, 0)]
    targets = [("a", 0.3), ("b", 0.77), ("c", 0.4), ("nothing", 0.5), (None, 0.5)]
    got = cutoffs(spark, rows, targets, **sizes)
    assert set(got) == {"a", "b", "c", None}
    for src, fraction in targets:
        scores = [s for k, s, _ in rows if k == src and s is not None and s == s]
        if scores:
            best = min([0, *(sum(x >= c for x in scores) for c in set(scores))], key=lambda k: (abs(k - fraction * len(scores)), k))
            assert got[src]["kept"] == best and got[src]["total"] == len(scores)
            assert best == (0 if got[src]["cutoff"] is None else sum(x >= got[src]["cutoff"] for x in scores))
    assert got["c"]["kept"] == 0 and got["c"]["cutoff"] is None


def test_cutoffs_of_nothing_and_of_infinite_scores(spark):
    assert cutoffs(spark, [], [("a", 0.5)]) == {}
    got = cutoffs(spark, [("a", float("inf"), 0), ("a", 1.0, 0), ("a", 0.0, 0), ("a", -0.0, 0)], [("a", 0.5)], buckets=2, fine_rows=1)
    assert got["a"]["kept"] == 2 and got["a"]["cutoff"] == 1.0
    scores = [float("inf"), float("-inf"), 1e308, -1e308, 5e-324, *(k / 7 for k in range(40))]
    for fraction in (0.0, 0.03, 0.5, 0.97, 1.0):
        got = cutoffs(spark, [("a", s, 0) for s in scores], [("a", fraction)], buckets=3, fine_rows=1)["a"]
        assert got["kept"] == min(range(len(scores) + 1), key=lambda k: (abs(k - fraction * len(scores)), k))


@pytest.mark.parametrize("most_hot", [2, 10_000])
def test_top_items_match_brute_force(spark, most_hot):
    rnd = random.Random(2)
    rows = [("big", f"i{rnd.randrange(400)}", rnd.choice([0.1, 0.5, 0.5, 0.9, None, NAN]), f"r{k:04d}") for k in range(3000)]
    rows += [("wide", f"w{k}", s, f"w{k}") for k, s in enumerate([float("inf"), float("-inf"), 1e308, -1e308, *map(float, range(20))])] + [("even", f"e{k}", 0.5, f"e{k}") for k in range(40)]
    rows += [("small", "x", 0.2, "s1"), ("small", "x", 0.2, "s0"), ("tiny", "y", 0.1, "t"), (None, "z", 1.0, "n"), ("big", None, 1.0, "m")]
    df = spark.createDataFrame(rows, "g string, i string, s double, r string").withColumn("grp", F.lit("clash")).withColumn("item", F.lit(1))
    got = defaultdict(list)
    for r in top_items(df.union(df), "g", "i", "s", "r", 6, most_hot=most_hot).collect():
        got[r["grp"]].append((r["rank"], r["item"], r["score"], r["record"]))
    want = defaultdict(dict)
    for g, i, s, r in rows:
        if None not in (g, i, s) and s == s:
            want[g][i] = min(want[g].get(i, (1e9, "")), (-s, r))
    for g, items in want.items():
        best = sorted((v[0], i, v[1]) for i, v in items.items())[:6]
        assert sorted(got[g]) == [(k + 1, i, -s, r) for k, (s, i, r) in enumerate(best)]
    assert set(got) == set(want)
    assert top_items(df.limit(0), "g", "i", "s", "r", 6).count() == 0


def labels(rnd, items, skill):
    rows = []
    for k in range(items):
        truth = rnd.random() < 0.5
        for who, right in skill.items():
            if rnd.random() < 0.6:
                vote = truth if rnd.random() < right else not truth
                rows.append((f"c{k}", who, rnd.choice(["Accepted", " approve", "TRUE"] if vote else ["rejected ", "false", "Reject"]), len(rows), f"l{len(rows)}"))
    return rows


def test_consensus_finds_guessers_and_liars(spark):
    rnd = random.Random(3)
    skill = {"ann": 0.9, "bob": 0.85, "cid": 0.9, "dan": 0.8, "eve": 0.5, "fay": 0.1}
    rows = labels(rnd, 600, skill)
    rows += [("c0", None, "true", 0, "x"), ("c0", "  ", "true", 0, "x"), (None, "ann", "true", 0, "x"), ("c1", "ann", "unsure", 10**6, "x"), ("c1", "ann", None, 10**6, "x")]
    df = spark.createDataFrame(rows, "cand string, who string, lab string, t int, id string").withColumn("item", F.lit("clash"))
    df = df.withColumn("who", F.when(F.col("t") % 3 == 0, F.upper(F.concat(F.lit(" "), "who"))).otherwise(F.col("who")))
    out = spectral_consensus(df.union(df), "cand", "who", "lab", "t", "id")
    rel = {r["annotator"]: r["reliability"] for r in out.annotators.collect()}
    assert set(rel) == set(skill)
    for who, right in skill.items():
        assert abs(rel[who] - right) < 0.1
    items = out.items.collect()
    assert all(0.5 <= r["confidence"] <= 1 and 0 <= r["agreement"] <= 1 for r in items)
    assert len(items) == len({r[0] for r in rows if r[0]} - {None})


def test_vector_is_the_leading_one_however_items_are_summed(spark):
    rnd = random.Random(11)
    who = {f"w{k}": 0.55 + 0.04 * k for k in range(9)}
    rows = labels(rnd, 200, who)
    df = spark.createDataFrame(rows, "cand string, who string, lab string, t int, id string")
    votes = votes_of(df, "cand", "who", "lab", "t", "id")
    names, ballots = sorted(who), defaultdict(dict)
    for r in votes.collect():
        ballots[r["item"]][r["annotator"]] = r["vote"]
    mean = {w: np.mean([b[w] for b in ballots.values() if w in b]) for w in names}
    g, n = np.zeros((9, 9)), np.zeros((9, 9))
    for i, r in enumerate(names):
        for j, s in enumerate(names):
            if i != j:
                common = [b[r] * b[s] for b in ballots.values() if r in b and s in b]
                g[i, j], n[i, j] = (sum(common) - len(common) * mean[r] * mean[s]) / 2, len(common)
    values, vectors = np.linalg.eig(g / (n.sum(axis=1) + 10.0)[:, None])
    want = vectors[:, values.real.argmax()].real
    want = want / want[np.abs(want).argmax()]
    for paired in (50, 5):
        got = {r["annotator"]: r["u"] for r in leading_vector(agreement_of(votes, paired), votes.select("annotator").distinct(), 10.0, 1e-4).collect()}
        assert np.allclose([got[w] for w in names], want, atol=1e-3)


def test_consensus_takes_the_latest_vote_and_bears_little(spark):
    schema = "cand string, who string, lab string, t int, id string"
    one = spectral_consensus(spark.createDataFrame([("a", "x", "true", 1, "1"), ("a", "x", "false", 2, "2")], schema), "cand", "who", "lab", "t", "id")
    assert [r["n_votes"] for r in one.items.collect()] == [1] and one.annotators.first()["reliability"] is None
    none = spectral_consensus(spark.createDataFrame([], schema), "cand", "who", "lab", "t", "id")
    assert none.items.count() == 0 and none.annotators.count() == 0


def test_mixing_reaches_targets_within_repeats(spark):
    rnd = random.Random(4)
    rows = [(k, s, rnd.randrange(1, 200), rnd.choice([1.0, 0.5, None])) for k, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["low"] * 20 + ["other"] * 50)]
    rows += [(-1, None, 50, 1.0), (-2, "mid", None, 1.0)]
    df = spark.createDataFrame(rows, "record long, source string, size int, weight double")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 4), ("low", 0.1, 3), ("absent", None, None)], "source string, target_share double, max_repeats int")
    mix = mix_sources(df, targets, seed=7)
    s = {r["source"]: r for r in mix.sources.collect()}
    total = sum(r[2] or 0 for r in rows)
    for name, share in (("big", 0.5), ("mid", 0.4)):
        assert not s[name]["short"] and abs(s[name]["used"] - share * total) <= 200
    assert s["low"]["short"] and s["low"]["used"] == 3 * s["low"]["size"] and s["absent"]["size"] == 0 and not s["absent"]["short"]
    most = {"big": 1, "mid": 4, "low": 3}
    got = mix.records.collect()
    assert all(0 <= r["copies"] <= most[r["source"]] for r in got) and len(got) == 3621
    again = {r["record"]: r["copies"] for r in mix_sources(df.repartition(7), targets, seed=7).records.collect()}
    assert again == {r["record"]: r["copies"] for r in got}
    heavy = {w: sum(r["copies"] for r in got if r["source"] == "mid" and rows[r["record"]][3] == w) for w in (1.0, 0.5)}
    assert 1.5 < heavy[1.0] / heavy[0.5] < 2.5
    assert mix_sources(df.limit(0), targets).records.count() == 0
