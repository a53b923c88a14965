"""Parent-child candidates from text: lexical patterns, co-occurrence and directional evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforest.functions import text as X
from termforest.operators.joins import spread_join
from termforest.operators.terms import occurrences, phrase_hits
from termforest.session import cut

_P = r"([\p{L}\p{N}_\s]+?)"
_PS = r"([\p{L}\p{N}_\s,]+?)"
# fixed values: (language, pattern, whether the parent comes first)
PATTERNS = (
    ("en", _P + r"\s+such\s+as\s+" + _PS + r"(?:\.|,\s*and\s|\s+and\s)", True),
    ("en", _PS + r"\s+and\s+other\s+" + _P + r"(?:\.|,|;)", False),
    ("en", _P + r"\s*,?\s*including\s+" + _PS + r"(?:\.|,\s*and\s|\s+and\s)", True),
    ("en", _P + r"\s*,?\s*especially\s+" + _PS + r"(?:\.|,)", True),
    ("en", _P + r"\s+is\s+a\s+(?:kind|type|form|sort)\s+of\s+" + _P + r"(?:\.|,)", False),
    ("en", _P + r"\s+is\s+one\s+of\s+the\s+" + _P + r"(?:\.|,)", False),
    ("en", _P + r"\s+belongs\s+to\s+the\s+" + _P + r"(?:\.|,)", False),
    ("ru", _P + r"\s*,?\s*такие?\s+как\s+" + _PS + r"(?:\.|,)", True),
    ("ru", _PS + r"\s+и\s+други[еих]\s+" + _P + r"(?:\.|,)", False),
    ("ru", _P + r"\s*,?\s*в\s+частности\s+" + _PS + r"(?:\.|,)", True),
    ("ru", _P + r"\s*,?\s*например\s+" + _PS + r"(?:\.|,)", True),
    ("ru", _P + r"\s+является\s+(?:видом|разновидностью|типом)\s+" + _P + r"(?:\.|,)", False),
    ("ru", _P + r"\s+является\s+одним\s+из\s+" + _P + r"(?:\.|,)", False),
    ("ru", _P + r"\s+относится\s+к\s+(?:классу|типу)\s+" + _P + r"(?:\.|,)", False),
    ("kk", _P + r"\s*,?\s*мысалы\s+" + _PS + r"(?:\.|,)", True),
    ("kk", _P + r"\s*,?\s*атап\s+айтқанда\s+" + _PS + r"(?:\.|,)", True),
    ("kk", _P + r"\s+сияқты\s+" + _PS + r"(?:\.|,)", True),
    ("kk", _P + r"\s+және\s+басқа\s+" + _P + r"(?:\.|,)", False),
    ("kk", _P + r"\s+" + _P + r"\s+түрі\s+болып\s+табылады(?:\.|,)", False),
    ("kk", _P + r"\s+" + _P + r"\s+қатарына\s+жатады(?:\.|,)", False),
)
# fixed values: phrases that announce a relation
TRIGGERS = {
    "en": ("such as", "including", "especially", "is a type of", "is one of"),
    "ru": ("такие как", "в частности", "например", "является одним из", "относится к"),
    "kk": ("мысалы", "атап айтқанда", "сияқты", "қатарына жатады"),
}


def _announcement(pattern: str) -> str:
    """The words of a pattern between its two groups, or behind them: without these it cannot match."""
    words = pattern.replace(_P, " ").replace(_PS, " ").split("(?:\\.|")[0]
    return re.sub(r"^(?:\\s[*+]|,\?|\s)+|(?:\\s[*+]|\s)+$", "", words)


def hearst_matches(chunks: DataFrame) -> DataFrame:
    """REX-01: (chunk_id, document_id, lang, pattern, parent_text, child_text) of every pattern hit.

    A pattern runs only over texts that hold its own words; the rest is passed over by one linear search.
    """
    text = F.lower("text")
    nothing = F.array().cast("array<struct<pattern:int,parent_text:string,child_text:string>>")

    def hits_of(number: int, pattern: str, parent_first: bool) -> Column:
        # one search through the text; the groups are read from what it found
        def group(found: Column, n: int) -> Column:
            return F.regexp_extract(found, pattern, n)

        p, c = (1, 2) if parent_first else (2, 1)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(number).alias("pattern"), group(m, p).alias("parent_text"), group(m, c).alias("child_text")))

    hits = [
        F.when((F.col("lang") == lang) & text.rlike(_announcement(pattern)), hits_of(k, pattern, first)).otherwise(nothing)
        for k, (lang, pattern, first) in enumerate(PATTERNS)
    ]
    return chunks.select("chunk_id", "document_id", "lang", F.explode(F.concat(*hits)).alias("m")).select("chunk_id", "document_id", "lang", "m.*")


def hearst_pairs(chunks: DataFrame) -> DataFrame:
    """Normalised (parent, child) pairs of the hits, one per member of an enumeration on either side, with their support."""
    m = hearst_matches(chunks)
    parents = m.select("document_id", "lang", "pattern", "child_text", F.explode(X.split_enumeration("parent_text")).alias("parent"))
    pairs = parents.select("document_id", "lang", "pattern", "parent", F.explode(X.split_enumeration("child_text")).alias("child"))
    return pairs.filter("parent <> child").groupBy("lang", "parent", "child").agg(F.count("*").alias("support"), F.count_distinct("document_id").alias("docs"))


def _pairs(words: Column) -> Column:
    """All pairs of different words, the smaller first, as texts with a blank, which no word holds."""
    ordered = F.array_sort(words)
    return X.let(ordered, lambda w: F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: F.concat(x, F.lit(" "), y)))))


def closest_labels(phrases: DataFrame, labels: DataFrame, least: float = 0.62, least_overlap: float = 0.6, least_ratio: float = 0.72) -> DataFrame:
    """TXT-24: (phrase, label, overlap): the closest label of each phrase; ties to the smaller label.

    That is the label of the best token overlap, if it reaches ``least``; else, among labels that hold the phrase or stand
    in it, both of five characters or more, with ``least_overlap`` of the phrase's tokens, the best by that share and the
    ratio of equal characters, which is that of the shorter one where it stands in the longer. Either way the two share a
    fixed part of the phrase's tokens. Where that is one token, they are found by an equality join over tokens; where it
    is ``need`` of n, two are among any n - need + 2 of the phrase, so they are found by a join over pairs of tokens.
    """
    p = phrases.select("phrase").distinct().select("phrase", F.array_distinct(X.tokens("phrase")).alias("pt"))
    c = labels.select("label").distinct().select("label", F.array_distinct(X.tokens("label")).alias("lt"))
    need = F.greatest(F.lit(1), F.ceil(F.size("pt") * min(least, least_overlap) - 1e-9))
    some = F.when(need == 1, F.col("pt")).otherwise(_pairs(F.slice("pt", F.lit(1), (F.size("pt") - need + 2).cast("int"))))
    asked = p.filter(F.size("pt") > 0).select("phrase", "pt", F.explode(some).alias("key"))
    shared = asked.join(c.select("label", "lt", F.explode(F.concat("lt", _pairs(F.col("lt")))).alias("key")), "key")
    counted = shared.select("phrase", "label", F.size("pt").alias("np"), F.size("lt").alias("nl"), F.size(F.array_intersect("pt", "lt")).alias("k"))
    scored = counted.withColumn("overlap", F.col("k") / (F.col("np") + F.col("nl") - F.col("k")))
    inside = F.col("phrase").contains(F.col("label")) | F.col("label").contains(F.col("phrase"))
    sizes = (F.length("phrase"), F.length("label"))
    second = (F.length("phrase") >= 5) & (F.length("label") >= 5) & inside & (F.col("k") / F.col("np") >= least_overlap)
    options = scored.filter((F.col("overlap") >= least) | second).withColumn("first", F.col("overlap") >= least)
    judged = options.filter("first").withColumn("value", F.col("overlap")).unionByName(
        options.filter(~F.col("first")).withColumn("ratio", 2 * F.least(*sizes) / (sizes[0] + sizes[1])).filter(F.col("ratio") >= least_ratio).withColumn("value", F.col("k") / F.col("np") + 0.35 * F.col("ratio")).drop("ratio")
    )
    best = F.min_by(F.struct("label", "overlap"), F.struct(~F.col("first"), -F.col("value"), "label"))
    return judged.groupBy("phrase").agg(best.alias("b")).select("phrase", "b.label", "b.overlap")


def concept_relations(chunks: DataFrame, concepts: DataFrame, soft: bool = False) -> DataFrame:
    """REX-02: pattern pairs whose two sides are concept labels, exactly or by the closest one, with their score."""
    pairs = hearst_pairs(chunks)
    sides = pairs.select(F.col("parent").alias("phrase")).union(pairs.select("child")).distinct()
    labels = concepts.select(F.lower("label").alias("label")).distinct()
    near = closest_labels(sides, labels).withColumn("exact", F.col("phrase") == F.col("label"))
    a = near.select(F.col("phrase").alias("parent"), F.col("label").alias("p"), F.col("exact").alias("pe"))
    b = near.select(F.col("phrase").alias("child"), F.col("label").alias("c"), F.col("exact").alias("ce"))
    words_p, words_c = F.size(X.tokens("p")), F.size(X.tokens("c"))
    j = pairs.join(a, "parent").join(b, "child").filter((F.col("p") != F.col("c")) & (X.token_jaccard("p", "c") >= (0.08 if soft else 0.2)))
    if not soft:
        j = j.filter(~((words_p == 1) & (words_c == 1)))
    def part(flag):
        return F.when(F.col(flag), 0.1).otherwise(0.03)

    score = F.least(F.lit(0.82 if soft else 0.9), (0.45 if soft else 0.6) + part("pe") + part("ce") + F.when(words_c > 1, 0.05).otherwise(0.0) - F.when(F.col("pe") & F.col("ce"), 0.0).otherwise(0.06))
    return j.groupBy(F.col("p").alias("parent"), F.col("c").alias("child")).agg(F.max(F.round(score, 4)).alias("score"), F.sum("support").alias("support"))


def label_presence(chunks: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, chunk_id, document_id, term): which labels a chunk holds."""
    return phrase_hits(chunks, labels, keys).drop("hits")


def cooccurrence_support(presence: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """REX-05: (keys, a, b, n, support) of labels that stand in one chunk, ``a`` before ``b``; the measure is symmetric.

    The pairs of a chunk are bounded by the labels its text can hold; they are summed before they are shuffled.
    """
    counts = presence.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    x = presence.select(*keys, "chunk_id", F.col("term").alias("a"))
    y = presence.select(*keys, "chunk_id", F.col("term").alias("b"))
    pairs = x.join(y, [*keys, "chunk_id"]).filter("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    top = pairs.groupBy(*keys).agg(F.max("n").alias("most")) if keys else None
    pairs = pairs.join(F.broadcast(top), list(keys)) if keys else pairs.withColumn("most", pairs.agg(F.max("n")).scalar())
    pairs = pairs.join(counts.select(*keys, F.col("term").alias("a"), F.col("n").alias("na")), [*keys, "a"]).join(counts.select(*keys, F.col("term").alias("b"), F.col("n").alias("nb")), [*keys, "b"])
    value = F.col("n") / F.col("most") * (1.0 / (1.0 + 0.02 * F.greatest(F.col("na") + F.col("nb") - 4, F.lit(0))))
    return pairs.select(*keys, "a", "b", "n", F.least(F.lit(1.0), value).alias("support"))


def trigger_pairs(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """REX-03: (lang, parent, child, score, support) of similar labels in one chunk that holds a trigger phrase.

    The label in two documents more is the parent, else the one of fewer words, else the more frequent, then the smaller.
    A pair counts once per language however many chunks hold it; ``support`` is their number.
    """
    announced = X.any_of([(F.col("lang") == lang) & F.lower("text").contains(t) for lang, ts in TRIGGERS.items() for t in ts])
    fit = labels.select("term").filter((F.length("term") >= 3) & (F.size(X.tokens("term")) <= 5))
    df = phrase_hits(chunks, fit).groupBy("term").agg(F.count_distinct("document_id").alias("df"))
    found = phrase_hits(chunks.filter(announced), fit).drop("hits").join(chunks.select("chunk_id", "lang"), "chunk_id").join(df, "term").withColumn("n", F.size(X.tokens("term")))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("term", "df", "n")]
    pairs = found.select("lang", "chunk_id", *side("a")).join(found.select("lang", "chunk_id", *side("b")), ["lang", "chunk_id"]).filter("a_term < b_term")
    pairs = pairs.groupBy("lang", "a_term", "b_term", "a_df", "b_df", "a_n", "b_n").agg(F.count("*").alias("support"))
    overlap, inside = X.token_jaccard("a_term", "b_term"), X.containment("a_term", "b_term")
    kept = pairs.withColumn("o", overlap).withColumn("c", inside).filter(((F.col("o") >= 0.2) | (F.col("c") > 0)) & ~((F.col("a_n") == 1) & (F.col("b_n") == 1)))
    gap = F.col("a_df") - F.col("b_df")
    first = F.when(gap >= 2, True).when(gap <= -2, False).when(F.col("a_n") != F.col("b_n"), F.col("a_n") < F.col("b_n")).otherwise(gap >= 0)
    rows = kept.withColumn("first", first)
    lead = F.when(F.col("first"), gap).otherwise(-gap)
    score = F.greatest(F.lit(0.60), F.least(F.lit(0.82), 0.58 + 0.10 * F.col("o") + 0.05 * F.col("c") + F.when(lead >= 1, 0.03).otherwise(0.0)))
    return rows.select("lang", F.when(F.col("first"), F.col("a_term")).otherwise(F.col("b_term")).alias("parent"), F.when(F.col("first"), F.col("b_term")).otherwise(F.col("a_term")).alias("child"), F.round(score, 4).alias("score"), "support")


def evidence_snippets(chunks: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """REX-07: the sentences of the first ``k`` uses of each label, one of each document first (a report of that size).

    A sentence is cut to 600 characters, as published.
    """
    found = occurrences(chunks, labels, k).select("term", "rank", "chunk_id", "document_id", "snippet").join(chunks.select("chunk_id", "lang"), "chunk_id")
    return found.select("term", "rank", "document_id", "lang", F.substring("snippet", 1, 600).alias("snippet"))


def directional_evidence(pairs: DataFrame, snippets: DataFrame) -> DataFrame:
    """REX-08: (parent, child, hits, contra, evidence): how far the snippets of both labels state the direction.

    A snippet with both labels counts once: as a hit if it states the pair in one of the published forms, else as a
    contradiction if the published words stand beside a label set apart by blanks. The ratio is that of the documents
    with snippets of both labels to those with snippets of either. Each pair meets the snippets of its parent and of its
    child one after the other; only counts and document ids go on, so no text moves with the pairs.
    """
    p, c = F.lower("parent"), F.lower("child")

    def quoted(x: Column) -> Column:
        return F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}_])"))

    # fixed values: the forms that state the direction
    forms = [(p, "such as", c), (c, "is (?:a|an|one of)", p), (c, "является", p), (p, "такие как", c), (p, "мысалы", c)]
    gap, start, stop = ".{0,80}", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    stated = F.concat_ws("|", *[F.concat(quoted(a), F.lit(f"{gap}{start}{words}{stop}{gap}"), quoted(b)) for a, words, b in forms])
    apart = [(p, " such as "), (c, " явля")]
    of_term = cut(snippets.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("document_id", F.lower("snippet").alias("s")))).alias("texts")))
    found = pairs.withColumn("hits", F.lit(0)).withColumn("contra", F.lit(0)).withColumn("stated", stated)
    for label, name in ((p, "of_parent"), (c, "of_child")):
        keyed = found.withColumn("term", label)
        met = spread_join(keyed, of_term, ["term"], ["parent", "child"], how="left")
        both = F.filter("texts", lambda x: x["s"].contains(p) & x["s"].contains(c))
        hit = F.filter(both, lambda x: F.regexp_like(x["s"], F.col("stated")))
        missed = F.filter(both, lambda x: ~F.regexp_like(x["s"], F.col("stated")) & X.any_of([x["s"].contains(F.concat(F.lit(" "), a, F.lit(" "))) & x["s"].contains(w) for a, w in apart]))
        docs = F.array_distinct(F.transform("texts", lambda x: x["document_id"]))
        found = met.withColumn("hits", F.col("hits") + F.coalesce(F.size(hit), F.lit(0))).withColumn("contra", F.col("contra") + F.coalesce(F.size(missed), F.lit(0))).withColumn(name, F.coalesce(docs, F.array().cast("array<string>"))).drop("texts", "term")
    ratio = F.size(F.array_intersect("of_parent", "of_child")) / F.greatest(F.lit(1), F.size(F.array_union("of_parent", "of_child")))
    value = 0.60 * F.least(F.lit(1.0), F.col("hits") / 3) + 0.40 * ratio - F.least(F.lit(0.35), 0.12 * F.col("contra"))
    return found.filter((F.size("of_parent") > 0) | (F.size("of_child") > 0)).select("parent", "child", "hits", "contra", F.greatest(F.lit(0.0), value).alias("evidence"))


def attach_evidence(edges: DataFrame, evidence: DataFrame, weight: float = 0.12) -> DataFrame:
    """REX-09: ``edges`` (parent, child, score and more) with ``evidence`` blended into the score; without any it stays."""
    known = evidence.select("parent", "child", F.col("evidence").alias("_e"))
    blended = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - weight) * F.col("score") + weight * F.col("_e"))), 4)
    return edges.join(known, ["parent", "child"], "left").withColumn("score", F.coalesce(blended, "score")).withColumn("retrieval_evidence_score", F.round("_e", 4)).drop("_e")


def relation_candidates(hard: DataFrame, soft: DataFrame, triggers: DataFrame, embedded: DataFrame, concepts: DataFrame, method: str = "hybrid", most: int = 1000) -> DataFrame:
    """REX-04, SET-06: (lang, parent, child, score, method) of all strategies that ``method`` (hearst, embedding, hybrid) asks for.

    Trigger pairs of a language join in only where its patterns gave fewer than ``max(4, concepts // 25)`` pairs; each
    language has at most ``max(6, most // languages)`` of them, the best first (a limit that is part of the feature).
    """
    patterns = hard.select("lang", "parent", "child", "score", F.lit("hearst").alias("method")).unionByName(soft.select("lang", "parent", "child", "score", F.lit("hearst").alias("method")))
    langs = concepts.select("lang").distinct().agg(F.count("*")).scalar()
    enough = F.greatest(F.lit(4), F.floor(concepts.agg(F.count("*")).scalar() / 25))
    rich = patterns.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= enough).select("lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), "parent", "child")
    few = triggers.join(rich, "lang", "left_anti").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.greatest(F.lit(6), F.floor(F.lit(most) / langs)))
    spoken = patterns.unionByName(few.select("lang", "parent", "child", "score", F.lit("hearst_trigger_fallback").alias("method")))
    near = embedded.select("lang", "parent", "child", "score", "method")
    return spoken if method == "hearst" else near if method == "embedding" else spoken.unionByName(near)
