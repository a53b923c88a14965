"""SQL text helpers for the checks, written apart from the column functions they check."""

from __future__ import annotations

from collections.abc import Iterable

from termforest.functions import lexicon as L


def quoted(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}]+')"


def noise_token(t: str) -> str:
    lists = quoted([*L.STOPWORDS, *L.GENERIC_TERMS, *L.UNIT_TOKENS])
    return rf"(length({t}) <= 1 OR {t} IN ({lists}) OR (regexp_matches({t}, '\p{{N}}') AND length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) < 3))"


def content(e: str) -> str:
    return f"list_filter({tokens(e)}, lambda w: length(w) >= 2 AND NOT {noise_token('w')})"


def _contains_any(e: str, phrases: Iterable[str]) -> str:
    return " OR ".join(f"contains({e}, '{p}')" for p in phrases if " " in p)


def _patterns(e: str) -> str:
    return " OR ".join(f"regexp_matches({e}, '{p}')" for p in L.NOISE_PATTERNS)


def noise_term(e: str) -> str:
    w, t = tokens(e), f"lower(trim({e}))"
    noise = f"len(list_filter({w}, lambda k: {noise_token('k')}))"
    return f"""(length({t}) < 2 OR {t} IN ({quoted(L.BAD_TERM_PHRASES)}) OR {_contains_any(t, L.BAD_TERM_PHRASES)} OR {_patterns(t)}
      OR len({w}) = 0 OR len({w}) > 6 OR {noise} = len({w}) OR (len({w}) >= 2 AND len({w}) - {noise} < 2)
      OR (len({w}) = 1 AND {w}[1] IN ({quoted(L.BAD_SINGLES)})) OR (len({w}) >= 2 AND {w}[1] = {w}[-1]))"""


def normal_term(e: str) -> str:
    """For terms that are tokens joined by single blanks already."""
    w = tokens(e)
    kept = f"list_filter({w}, lambda k: k NOT IN ({quoted([*L.GENERIC_TERMS, *L.CONNECTORS])}))"
    term = f"CASE WHEN len({w}) > 1 THEN array_to_string({kept}, ' ') ELSE lower({e}) END"
    return f"""CASE WHEN len({w}) = 1 AND {w}[1] IN ({quoted([*L.STOPWORDS, *L.GENERIC_TERMS])}) THEN NULL
      WHEN lower({e}) IN ({quoted(L.BAD_TERM_PHRASES)}) OR length({term}) < 2 THEN NULL
      WHEN len({w}) > 1 AND len({kept}) = 1 AND {kept}[1] IN ({quoted(L.STOPWORDS)}) THEN NULL
      WHEN len({kept}) > 4 OR {noise_term(f'({term})')} THEN NULL ELSE {term} END"""


def functional_phrase(e: str, lang: str) -> str:
    w = tokens(e)
    sets = {k: quoted(v) for k, v in L.FUNCTIONAL.items()}

    def f(t: str) -> str:
        return f"CASE {lang} WHEN 'ru' THEN {t} IN ({sets['ru']}) WHEN 'kk' THEN {t} IN ({sets['kk']}) ELSE {t} IN ({sets['en']}) END"

    hits = f"len(list_filter({w}, lambda k: ({f('k')}) OR k IN ({quoted(L.STOPWORDS)})))"
    kazakh = f"({lang} = 'kk' AND len({w}) <= 3 AND ({w}[-1] IN ({quoted(L.KK_VERBAL_TAILS)}) OR len(list_filter({w}, lambda k: regexp_matches(k, '(?:{'|'.join(L.KK_PARTICIPLES)})$'))) > 0))"
    return f"(len({w}) = 0 OR (len({w}) = 1 AND ({f(w + '[1]')})) OR (len({w}) >= 2 AND {hits}::DOUBLE / len({w}) >= 0.6) OR (len({w}) >= 2 AND (({f(w + '[1]')}) OR ({f(w + '[-1]')}))) OR {kazakh})"


def candidate(e: str) -> str:
    t = rf"regexp_replace(trim(regexp_replace(lower({e}), '\s+', ' ', 'g')), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')"
    w = tokens(e)
    generic = quoted(L.GENERIC_LABELS)
    kept = f"CASE WHEN len({w}) > 1 THEN list_filter({w}, lambda k: k NOT IN ({generic})) ELSE {w} END"
    return f"""CASE WHEN length({t}) < 2 OR {t} IN ({quoted(L.BAD_LABEL_PHRASES)}) OR len({kept}) = 0 THEN NULL
      WHEN len({kept}) = 1 AND ({kept})[1] IN ({generic}) THEN NULL WHEN length(array_to_string({kept}, ' ')) < 2 THEN NULL
      ELSE array_to_string({kept}, ' ') END"""


def low_quality(e: str) -> str:
    """``e`` is the candidate form of the label (see :func:`candidate`)."""
    c = e
    w = tokens(c)
    tech = f"len(list_filter({w}, lambda k: k IN ({quoted(L.TECH_LABEL_TOKENS)})))"
    return rf"""coalesce({c} IN ({quoted(L.BAD_LABEL_PHRASES)}) OR {_contains_any(c, L.BAD_LABEL_PHRASES)} OR {_patterns(c)} OR len({w}) = 0 OR len({w}) > 4
      OR (len({w}) >= 3 AND len(list_distinct({w})) < len({w})) OR (len({w}) = 1 AND {w}[1] IN ({quoted([*L.GENERIC_LABELS, *L.BAD_LABEL_SINGLES])}))
      OR {tech} = len({w}) OR (len({w}) = 1 AND regexp_matches({w}[1], '\p{{N}}') AND length(regexp_replace({w}[1], '[^\p{{L}}]', '', 'g')) < 3)
      OR (len({w}) = 1 AND length({w}[1]) <= 2), TRUE)"""


def phrases(e: str, longest: int) -> str:
    parts = rf"string_split(regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_ ]+|  +', chr(10), 'g'), chr(10))"
    words = "list_filter(string_split(s, ' '), lambda k: k <> '')"
    grams = f"flatten(list_transform(range(1, {longest + 1}), lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i+n-1], ' '))))"
    return f"flatten(list_transform(list_transform({parts}, lambda s: {words}), lambda ws: {grams}))"


def normal_lang(e: str) -> str:
    low = f"lower(trim({e}))"
    return f"CASE WHEN starts_with({low}, 'en') THEN 'en' WHEN starts_with({low}, 'ru') THEN 'ru' WHEN starts_with({low}, 'kk') THEN 'kk' ELSE 'en' END"
