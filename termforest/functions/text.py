"""Text expressions over columns. All of them stay inside the JVM and yield null for null."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termforest.functions import lexicon as L

TOKEN = r"[\p{L}\p{N}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(c: str | Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def squeeze(c: str | Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def tokens(c: str | Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def clean_text(c: str | Column) -> Column:
    """Extracted text without header lines, banners, NULs, surplus blanks and blank lines."""
    lines = F.transform(F.split(F.regexp_replace(_col(c), "\x00", " "), r"\r\n|\n|\r"), strip)

    def keep(line: Column) -> Column:
        low = F.lower(line)
        return ~any_of([low.startswith(p) for p in (*L.HEADER_PREFIXES, *L.BANNERS)])

    text = F.array_join(F.filter(lines, keep), "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def sentences(c: str | Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    return F.split(_col(c), r"(?<=[.!?])\s+")


def normalize_lang(c: str | Column, default: str = "en") -> Column:
    """Language by prefix; anything else is the default."""
    low = F.lower(F.trim(_col(c)))
    return F.when(low.startswith("en"), "en").when(low.startswith("ru"), "ru").when(low.startswith("kk"), "kk").otherwise(default)


def cyrillic_language(c: str | Column, default: str = "en") -> Column:
    """kk if a Kazakh letter occurs, else the language with more stop-word hits, as substrings and as tokens."""
    low = F.lower(_col(c))
    words = tokens(c)

    def hits(stop: list[str]) -> Column:
        inside = sum((low.contains(w).cast("int") for w in stop[1:]), low.contains(stop[0]).cast("int"))
        return inside + F.size(F.filter(words, lambda t: t.isin(stop)))

    kk, ru = hits(L.LANG_STOP_KK), hits(L.LANG_STOP_RU)
    return F.when(low.rlike(f"[{L.KAZAKH_LETTERS}]"), "kk").when(kk > ru, "kk").when(ru > kk, "ru").otherwise(default)


def detect_language(c: str | Column, default: str = "en") -> Column:
    """Language of the first 3000 characters by script and stop words; a blank text has the default."""
    head = F.substring(_col(c), 1, 3000)
    cyrillic = F.length(F.regexp_replace(head, r"[^Ѐ-ԯ]", ""))
    latin = F.length(F.regexp_replace(head, r"[^A-Za-z]", ""))
    return F.when(cyrillic > latin, cyrillic_language(head, "ru")).otherwise(default)


def is_noise_token(t: Column) -> Column:
    """Too short, a stop, generic or unit word, or digits with fewer than three letters."""
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) <= 1) | t.isin([*L.STOPWORDS, *L.GENERIC_TERMS, *L.UNIT_TOKENS]) | (t.rlike(r"\p{N}") & (letters < 3))


def content_tokens(c: str | Column) -> Column:
    return F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~is_noise_token(t))


def ngrams(array: Column, n: int | Column) -> Column:
    """Adjacent ``n`` elements joined by a blank."""
    count = F.size(array) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(array, i, n), " "))).otherwise(F.array().cast("array<string>"))


def extract_ngrams(c: str | Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """N-grams over the tokens that are no noise."""
    return let(content_tokens(c), lambda words: F.concat(*[words if n == 1 else ngrams(words, n) for n in sizes]))


def is_noise_term(c: str | Column) -> Column:
    def judged(t: Column, words: Column) -> Column:
        n = F.size(words)
        first, last = F.get(words, F.lit(0)), F.get(words, n - 1)
        phrase = t.isin(*L.BAD_TERM_PHRASES) | any_of([t.contains(p) for p in L.BAD_TERM_PHRASES if " " in p])
        shape = (F.length(t) < 2) | phrase | any_of([t.rlike(p) for p in L.NOISE_PATTERNS]) | (n == 0) | (n > 6)
        ends = ((n == 1) & first.isin(L.BAD_SINGLES)) | ((n >= 2) & (first == last))
        return let(F.size(F.filter(words, is_noise_token)), lambda noise: shape | (noise == n) | ((n >= 2) & (n - noise < 2)) | ends)

    return let(F.lower(F.trim(_col(c))), lambda t: let(tokens(t), lambda words: judged(t, words)))


def normalize_term(c: str | Column) -> Column:
    """Term in lower case without generic words and connectors, or null if it is no term."""

    def judged(t: Column, words: Column, kept: Column) -> Column:
        several = F.size(words) > 1
        lone = ~several & F.get(words, F.lit(0)).isin([*L.STOPWORDS, *L.GENERIC_TERMS])
        left = several & ((F.size(kept) == 0) | (F.size(kept) > 4) | ((F.size(kept) == 1) & F.get(kept, F.lit(0)).isin(L.STOPWORDS)))
        bad = (F.length(t) < 2) | t.rlike("^[0-9]+$") | (F.size(words) == 0) | lone | t.isin(*L.BAD_TERM_PHRASES) | left
        term = F.when(~bad, F.when(several, F.array_join(kept, " ")).otherwise(t))
        return let(term, lambda x: F.when((F.length(x) >= 2) & ~is_noise_term(x), x))

    def stripped(t: Column, words: Column) -> Column:
        return let(F.filter(words, lambda w: ~w.isin([*L.GENERIC_TERMS, *L.CONNECTORS])), lambda kept: judged(t, words, kept))

    return let(squeeze(F.lower(_col(c))), lambda t: let(tokens(t), lambda words: stripped(t, words)))


def is_functional_phrase(c: str | Column, lang: str | Column) -> Column:
    code = F.substring(F.lower(F.coalesce(_col(lang), F.lit(""))), 1, 2)

    def functional(t: Column) -> Column:
        return F.when(code == "ru", t.isin(L.FUNCTIONAL["ru"])).when(code == "kk", t.isin(L.FUNCTIONAL["kk"])).otherwise(t.isin(L.FUNCTIONAL["en"]))

    def judged(words: Column) -> Column:
        n = F.size(words)
        hits = F.size(F.filter(words, lambda t: functional(t) | t.isin(L.STOPWORDS)))
        first, last = F.get(words, F.lit(0)), F.get(words, n - 1)
        tail = last.isin(L.KK_VERBAL_TAILS) | F.exists(words, lambda t: t.rlike(f"(?:{'|'.join(L.KK_PARTICIPLES)})$"))
        several = (n >= 2) & ((hits / F.greatest(n, F.lit(1)) >= 0.6) | functional(first) | functional(last))
        return (n == 0) | ((n == 1) & functional(first)) | several | ((code == "kk") & (n <= 3) & tail)

    return let(tokens(c), judged)


def normalize_candidate(c: str | Column) -> Column:
    """Relation candidate in lower case without generic words, or null."""

    def judged(t: Column, kept: Column) -> Column:
        lone = (F.size(kept) == 1) & F.get(kept, F.lit(0)).isin(L.GENERIC_LABELS)
        joined = F.array_join(kept, " ")
        return F.when((F.length(t) >= 2) & ~t.isin(*L.BAD_LABEL_PHRASES) & (F.size(kept) > 0) & ~lone & (F.length(joined) >= 2), joined)

    def stripped(t: Column, words: Column) -> Column:
        return let(F.when(F.size(words) > 1, F.filter(words, lambda w: ~w.isin(L.GENERIC_LABELS))).otherwise(words), lambda kept: judged(t, kept))

    edges = F.regexp_replace(squeeze(F.lower(_col(c))), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return let(edges, lambda t: let(tokens(t), lambda words: stripped(t, words)))


def is_low_quality_label(c: str | Column) -> Column:
    """Labels unfit for a hierarchy; a null label is unfit."""

    def judged(t: Column, words: Column) -> Column:
        n = F.size(words)
        first = F.get(words, F.lit(0))
        tech = F.size(F.filter(words, lambda w: w.isin(L.TECH_LABEL_TOKENS)))
        letters = F.length(F.regexp_replace(first, r"[^\p{L}]", ""))
        single = first.isin([*L.GENERIC_LABELS, *L.BAD_LABEL_SINGLES]) | (first.rlike(r"\p{N}") & (letters < 3)) | (F.length(first) <= 2)
        phrase = t.isin(*L.BAD_LABEL_PHRASES) | any_of([t.contains(p) for p in L.BAD_LABEL_PHRASES if " " in p]) | any_of([t.rlike(p) for p in L.NOISE_PATTERNS])
        return phrase | (n == 0) | (n > 4) | ((n >= 3) & (F.size(F.array_distinct(words)) < n)) | ((n == 1) & single) | (tech == n)

    return F.coalesce(let(normalize_candidate(c), lambda t: let(tokens(t), lambda words: judged(t, words))), F.lit(True))


def split_enumeration(c: str | Column) -> Column:
    """Members of an enumeration, normalised."""
    parts = F.split(_col(c), r"\s*,\s*|\s+(?:and|or|и|или|және|немесе)\s+")
    return F.filter(F.transform(parts, normalize_candidate), lambda x: x.isNotNull())


def split_phrase(c: str | Column) -> Column:
    parts = F.split(_col(c), r"\s*[,;/]\s*|\s+(?:and|or|и|или|және|немесе)\s+")
    return F.filter(F.transform(parts, F.trim), lambda x: F.length(x) >= 2)


def token_jaccard(a: str | Column, b: str | Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def containment(a: str | Column, b: str | Column) -> Column:
    """1.0 if one label holds the other, else 0.0."""
    x, y = F.lower(_col(a)), F.lower(_col(b))
    return (x.contains(y) | y.contains(x)).cast("double")


def anchor(c: str | Column) -> Column:
    """The first four tokens."""
    return F.array_join(F.slice(tokens(c), 1, 4), " ")


def word_runs(c: str | Column) -> Column:
    """The stretches of words with single blanks between them in lower case, some with a blank at an end."""
    return F.split(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_ ]+|  +", "\n"), "\n")


def phrases(c: str | Column, longest: int) -> Column:
    """All runs of up to ``longest`` words that stand in the text with single blanks between them.

    These are exactly the strings that a whole-term search, ignoring case, finds for terms of word characters and single
    blanks; so looking up terms is an equality join instead of a scan of every text for every term.
    """
    parts = F.transform(word_runs(c), lambda s: F.filter(F.split(s, " "), lambda w: w != ""))
    # the array is worked out before the lambda that reads it again and again
    return F.flatten(F.transform(parts, lambda words: let(words, lambda w: F.concat(*[w if n == 1 else ngrams(w, n) for n in range(1, longest + 1)]))))
