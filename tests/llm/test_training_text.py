"""Languages, splitting, distinctive terms, leaks and reading levels, against brute force and on dirty rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termforest.llm import leakage
from termforest.llm.distinctive import term_scores
from termforest.llm.langid import LanguageModel, fit_language_model, label_languages
from termforest.llm.leakage import leaked_items, passages_of, words_of
from termforest.llm.reading import ReadingModel, fit_reading_model, score_texts, with_levels
from termforest.llm.split import oversized, piece_spans, spans_of

LANGS = {
    "en": "the river runs past our old house and the children walk to school every morning with their friends in the rain",
    "de": "der fluss geht an unserem alten haus vorbei und die kinder laufen jeden morgen mit ihren freunden im regen zur schule",
    "ru": "река течёт мимо нашего старого дома и дети каждое утро идут в школу вместе со своими друзьями под дождём",
}


def sentence(rnd, lang):
    words = LANGS[lang].split()
    return " ".join(rnd.choice(words) for _ in range(9)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    return [(f"{lang}{k}", f" {lang.upper()}_XX" if k % 2 else lang, " ".join(sentence(rnd, lang) for _ in range(3))) for lang in LANGS for k in range(60)]


def test_languages_survive_dirty_labels(spark, corpus):
    rnd = random.Random(6)
    mixed = sentence(rnd, "en") + " " + sentence(rnd, "ru") + " " + sentence(rnd, "en")
    rows = [(i, "de" if k % 15 == 0 else lab, t) for k, (i, lab, t) in enumerate(corpus)]
    rows += [("null", "en", None), ("empty", "en", ""), ("codes", "en", "12a4 99f1 0b3c " * 30), ("mixed", None, mixed), ("unseen", None, "Unglaublichkeiten wanderten zwischen merkwürdigen Schulfreunden umher."), ("long", "xx", mixed * 2000), ("entity", None, "&amp; &nbsp;")]
    df = spark.createDataFrame(rows, "id string, lang string, text string").withColumn("segments", F.lit("clash"))
    model = fit_language_model(df, "id", "text", "lang", ["en", "de", "ru", "kk"])
    got = {r["id"]: r["language"] for r in label_languages(df.union(df).select("id", "text"), "text", model).collect()}
    for i, _, _ in corpus:
        assert got[i]["langs"] == [i[:2]] and got[i]["confidence"] > 0.9
    assert got["null"] is got["empty"] is got["codes"] is got["entity"] is None
    assert got["mixed"]["langs"] == ["en", "ru"] and [s["lang"] for s in got["mixed"]["segments"]] == ["en", "ru", "en"]
    spans = [(s["start"], s["stop"]) for s in got["mixed"]["segments"]]
    assert spans[0][0] == 0 and spans[-1][1] == len(mixed) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert got["unseen"]["lang"] == "de" and got["long"]["langs"] == ["en", "ru"]


def test_languages_without_training_rows(spark):
    df = spark.createDataFrame([("a", None, "Some words stand here today.")], "id string, lang string, text string")
    model = fit_language_model(df, "id", "text", "lang", ["en", "ru"])
    assert label_languages(df, "text", model).first()["language"] is None
    assert label_languages(df.limit(0), "text", LanguageModel([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n,;é", max_size=400), st.integers(-1, 60), st.integers(-3, 40))
def test_pieces_cover_and_overlap(text, limit, overlap):
    spans = piece_spans(text, limit, overlap)
    size = max(1, limit)
    lap = min(max(0, overlap), size // 2)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= size for a, b in spans)
    assert all(x[1] - y[0] == min(lap, x[1]) for x, y in zip(spans, spans[1:]))


def test_pieces_end_at_natural_boundaries(spark):
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven twelve."
    assert [text[a:b] for a, b in piece_spans(text, 40, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven twelve."]
    rows = [("a", text, 40, 5), ("b", None, 40, 5), ("c", text, None, 5), ("d", "short", 40, None), ("e", "x" * 100_000, 1000, 10)]
    df = spark.createDataFrame(rows, "id string, text string, m int, o int")
    got = {r["id"]: r for r in df.select("id", oversized(F.col("text"), F.col("m")).alias("over"), spans_of(F.col("text"), F.col("m"), F.col("o")).alias("s")).collect()}
    assert [i for i in "abcde" if got[i]["over"]] == ["a", "e"] and got["b"]["s"] is None and got["c"]["s"] is None and len(got["d"]["s"]) == 1
    assert len(got["e"]["s"]) == math.ceil(100_000 / 990)


def test_scores_of_terms_match_the_formula(spark):
    texts = {"a": "Solar grid grid grid, solar!", "b": "solar wind", "c": "Wind wind grid-42 42", "d": "solar wind", "e": None, "f": "", "g": "..."}
    df = spark.createDataFrame(list(texts.items()), "id string, body string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(0))
    got = {(r["record"], r["term"]): r for r in term_scores(df.union(df), "id", "body", prior=10.0).collect()}
    counts = {t: Counter(re.findall(r"[^\W_]+", t.lower())) for t in texts.values() if t}
    total = sum(counts.values(), Counter())
    everything = sum(total.values())
    want = {(i, w) for i, t in texts.items() if t for w in counts[t]}
    assert set(got) == want
    for i, w in want:
        y, n, a = counts[texts[i]][w], sum(counts[texts[i]].values()), 10.0 * total[w] / everything
        r, m = total[w] - y, everything - n
        z = (math.log((y + a) / (n + 10 - y - a)) - math.log((r + a) / (m + 10 - r - a))) / math.sqrt(1 / (y + a) + 1 / (r + a))
        assert got[i, w]["z"] == pytest.approx(z) and got[i, w]["y"] == y and got[i, w]["texts"] == sum(w in c for c in counts.values())
    some = term_scores(df, "id", "body", min_count=2, min_texts=2, max_texts=2).collect()
    assert {(r["record"], r["term"]) for r in some} == {("a", "grid"), ("a", "solar"), ("c", "wind")}
    above = {(r["record"], r["term"]) for r in term_scores(df, "id", "body", min_z=0.0, prior=10.0).collect()}
    assert above == {k for k, r in got.items() if r["z"] > 0} and len(above) < len(got)
    assert term_scores(df.limit(0), "id", "body").count() == 0


def passage(rnd, n=4):
    return " ".join(" ".join("".join(rnd.choice("abcdefgho") for _ in range(6)) for _ in range(14)).capitalize() + "." for _ in range(n))


def test_leaks_whole_partial_and_changed(spark):
    rnd = random.Random(7)
    ask = "Read this and answer now please."
    items = [(k, f"{ask} {passage(rnd)}") for k in range(6)] + [(90, None), (91, ""), (None, "x y z")]
    body = {k: t[len(ask) + 1 :] if t and len(t) > len(ask) else t for k, t in items}
    noise = [passage(rnd, 8) for _ in range(30)]
    words = body[2].split()
    changed = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(words))
    docs = [(k, t) for k, t in enumerate(noise)]
    docs += [(100, noise[0] + " " + body[0] + " " + noise[1]), (101, " ".join(body[1].split()[20:33])), (102, " ".join(body[1].split()[20:31]) + " " + noise[2]), (103, noise[3] + " " + changed)]
    docs += [(104, ask + " " + noise[4]), (105, body[3].upper().replace("O", "О").replace(" ", "​  - ")), (106, None), (None, body[4]), (107, ""), (108, body[5] + " " + body[0])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("doc", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc"], r["item"]) for r in leaked_items(d.union(d), "doc_id", "text", q.union(q), "item_id", "text").collect()]
    assert sorted(got) == [(100, 0), (101, 1), (103, 2), (105, 3), (108, 0), (108, 5)]
    assert leaked_items(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0
    assert words_of("Ｔhe C​at-s") == ["the", "cat", "s"]


def test_equal_passages_are_not_taken_for_instructions(spark, monkeypatch):
    rnd = random.Random(9)
    ask, same, own = "Please read the following text with care and answer all the questions below it.", passage(rnd), [passage(rnd) for _ in range(8)]
    items = [(k, f"{ask} {same}") for k in range(6)] + [(10 + k, f"{ask} {p}") for k, p in enumerate(own)] + [(30, same)]
    kept = passages_of(items)
    assert all(kept[k] == kept[30] == passages_of([(0, same)])[0] for k in range(6)) and all(len(kept[10 + k]) == 4 for k in range(8))
    docs = [(1, passage(rnd) + " " + same), (2, own[3]), (3, ask + " " + passage(rnd))]
    want = [(1, k) for k in (*range(6), 30)] + [(2, 13)]
    for block in (400_000, 50):
        monkeypatch.setattr(leakage, "BLOCK", block)
        got = leaked_items(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t")
        assert sorted((r["doc"], r["item"]) for r in got.collect()) == want


EASY, HARD = "the cat sat on a mat we ran home and had tea".split(), "heterogeneity calibration interpretation methodological notwithstanding degradation coefficient".split()


def graded(rnd, level):
    short = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n)).capitalize() + "."
    if level == "basic":
        return " ".join(short(EASY, 5) for _ in range(8))
    if level == "general":
        return " ".join(short(EASY + HARD[:2], 16) for _ in range(5))
    return " ".join(short(HARD, rnd.choice([3, 22])) for _ in range(5))


def test_levels_are_learned(spark):
    rnd = random.Random(8)
    levels = ["basic", "general", "specialist"]
    truth = {k: levels[k % 3] for k in range(240)}
    rows = [(k, "Title: Heterogeneity\n\n" + graded(rnd, v)) for k, v in truth.items()] + [(900, None), (901, ""), (902, "12 34"), (903, "cat"), (904, graded(rnd, "specialist") * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(k, truth[k]) for k in range(60)] + [(900, "basic"), (5555, "basic"), (1, "unknown"), (2, None)]
    model = fit_reading_model(docs, "doc_id", "text", spark.createDataFrame(marks, "doc_id long, level string"), "level", levels)
    got = {r["doc_id"]: r for r in with_levels(score_texts(docs, "text", model), model).collect()}
    right = sum(got[k]["level"] == v for k, v in truth.items() if k >= 60)
    assert right >= 0.95 * 180
    assert all(got[k]["level"] is None and got[k]["reading_score"] is None for k in (900, 901, 902)) and got[903]["level"] and got[904]["level"] == "specialist"
    none = fit_reading_model(docs, "doc_id", "text", spark.createDataFrame([(1, "basic")], "doc_id long, level string"), "level", levels)
    assert with_levels(score_texts(docs, "text", none), none).filter("level is not null").count() == 0
    assert score_texts(docs.limit(0), "text", model).count() == 0


def test_ordinal_fit_orders_and_adjusts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x[:, 0] + 0.2 * rng.normal(size=600), [-0.5, 0.7])
    m = ReadingModel(["a", "b", "c"]).fit(x, y)
    p = m.probabilities(m.score(x), adjusted=False)
    assert (p.argmax(axis=1) == y).mean() > 0.85 and m.cuts[0] < m.cuts[1] and np.allclose(p.sum(axis=1), 1)
    skew = np.concatenate([m.score(x)[y == 0]] * 8 + [m.score(x)])
    m.adjust(skew, np.ones(len(skew)))
    assert m.true_prior[0] > m.prior[0]
