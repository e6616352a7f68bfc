"""The SQL dialect of the checks: the same scalar operators for DuckDB."""

from __future__ import annotations

from ..functions import vocab as V
from ..functions.expressions import WORD, consuming


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_in(words) -> str:
    return ", ".join(q(w) for w in words)


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + consuming(pattern))})"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def rule_reason(t: str) -> str:
    """t: a column that is stripped already."""
    rules = " ".join(f"when {matches(t, p)} then '{why}'" for p, why in V.FILTER_RULES)
    return (
        rf"case when {t} = '' then 'empty' when length({t}) < 40 and regexp_matches({t}, '^[^\p{{L}}]{{0,12}}$') then 'too_short_junk' {rules} "
        rf"when len(regexp_extract_all({t}, '(?i)https?://')) >= 4 and length({t}) < 280 then 'link_spam' when length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) < 20 and length({t}) > 30 then 'low_text_signal' else 'pass' end"
    )


def language(x: str) -> str:
    s = f"substr(coalesce({x}, ''), 1, 500)"
    cyr, lat = f"length(regexp_replace({s}, '[^а-яА-ЯёЁ]', '', 'g'))", f"length(regexp_replace({s}, '[^a-zA-Z]', '', 'g'))"
    return f"case when {cyr} > {lat} * 1.2 then 'ru' when {lat} > 0 then 'en' else 'ru' end"


def without_footers(x: str) -> str:
    footer = "|".join(f"(?:{p})" for p in V.FOOTER_LINES)
    return f"array_to_string(list_filter(string_split(coalesce({x}, ''), chr(10)), lambda l: not regexp_matches(l, {q('(?i)' + footer)})), chr(10))"


def theme(b: str) -> str:
    """b: text without footer lines."""
    return "case " + " ".join(f"when {matches(b, p)} then '{name}'" for p, name in V.THEME_RULES) + " else 'other' end"


def title_of(t: str) -> str:
    """t: stripped text."""
    line = f"substr(coalesce(list_filter(list_transform(string_split({t}, chr(10)), lambda l: trim(l)), lambda l: l <> '')[1], ''), 1, 180)"
    return f"case when length({line}) >= 8 then {line} when {t} <> '' then substr({t}, 1, 180) else 'Без заголовка' end"


def summary_of(t: str) -> str:
    return f"case when length({t}) > 400 then concat(regexp_replace(substr({t}, 1, 400), ' [^ ]*$', ''), '…') else {t} end"


def stem(t: str, suffixes: list[str]) -> str:
    three, two = [s for s in suffixes if len(s) == 3], [s for s in suffixes if len(s) == 2]
    return (
        f"case when length({t}) > 5 and right({t}, 3) in ({words_in(three)}) then left({t}, length({t}) - 3) when length({t}) > 5 and right({t}, 2) in ({words_in(two)}) then left({t}, length({t}) - 2) "
        f"when length({t}) > 4 and right({t}, 1) in ({words_in(V.STEM_VOWELS)}) then left({t}, length({t}) - 1) else {t} end"
    )


def content_tokens(x: str, stop: list[str], suffixes: list[str]) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}\-]{{3,}}')"
    kept = rf"list_filter({found}, lambda t: t not in ({words_in(stop)}) and not regexp_matches(t, '^\p{{Nd}}+$'))"
    return f"list_distinct(list_transform({kept}, lambda t: {stem('t', suffixes)}))"


def merge_tokens(x: str) -> str:
    return content_tokens(x, V.MERGE_STOP, V.MERGE_SUFFIXES)


def important_hits(x: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}]+'), lambda w: w in ({words_in(V.IMPORTANT_WORDS)})))"


def importance(sources: str, age_hours: str, length: str, hits: str) -> str:
    fresh = f"case when {age_hours} is null then 1.0::double else greatest(0.0::double, 3.0::double * (1.0::double - greatest(0.0::double, {age_hours}) / 48.0::double)) end"
    size = f"case when {length} < 80 then 0.3::double when {length} < 280 then 0.9::double when {length} < 1200 then 1.5::double else 1.2::double end"
    return f"round(least(10.0::double, greatest(0.0::double, least(4.0::double, {sources} * 1.2::double) + {fresh} + {size} + least(1.5::double, {hits} * 0.5::double))), 2)"


def rank_score(semantic: str, distance: str, sources: str, score: str, age_hours: str, personal: str) -> str:
    c = lambda v: f"least(1.0::double, greatest(0.0::double, {v}))"
    g = f"case when {distance} <= 0 then 1.0::double when {distance} = 1 then 0.65::double else 0.35::double end"
    return (
        f"0.35::double * {c(semantic)} + 0.20::double * ({g}) + 0.15::double * {c(f'{sources} / 12.0::double')} + 0.10::double * {c(f'{score} / 10.0::double')} + "
        f"0.10::double * {c(f'1.0::double - greatest(0.0::double, {age_hours}) / 336.0::double')} + 0.10::double * {c(personal)}"
    )
