"""Scalar operators as SQL expressions over a column expression; they stay inside Spark's generated code.

Patterns with word boundaries and look-around are put into the consuming form that Java and RE2 read alike.
"""

from __future__ import annotations

from . import vocab as V

WORD = r"\p{L}\p{N}_"


def quoted(text: str) -> str:
    """A SQL string literal for spark.sql.parser.escapedStringLiterals off (backslashes doubled)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def consuming(pattern: str) -> str:
    """The pattern for a yes-or-no search: boundaries and look-around consume a character or an end."""
    p = pattern.replace(r"(?<![a-zа-я])", "(?:^|[^a-zа-я])").replace(r"(?![a-zа-я])", "(?:[^a-zа-я]|$)").replace(r"(?![а-я])", "(?:[^а-я]|$)")
    if p.startswith(r"\b"):
        p = f"(?:^|[^{WORD}])" + p[2:]
    p = p.replace(r"\b", f"(?:[^{WORD}]|$)")
    return p.replace(r"\w", f"[{WORD}]")


def matches(x: str, pattern: str) -> str:
    return f"regexp_like({x}, {quoted('(?iu)' + consuming(pattern))})"


#: Letters that the Cyrillic letters of a pattern can match, whatever their case.
_CYRILLIC = r"[\x{400}-\x{52F}\x{1C80}-\x{1C8F}]"
_HEADS, _ENDS = (r"(?<![a-zа-я])", r"\b", ""), (r"(?![a-zа-я])", r"(?![а-я])")


def _alternatives(pattern: str) -> list[tuple[str, str]]:
    """The parts of a pattern between its bars, each as what it asks before it and the rest."""
    head = next(h for h in _HEADS if pattern.startswith(h))
    body, parts, depth = pattern[len(head) :], [""], 0
    if head == _HEADS[0]:
        body = body[1:-1]  # the whole is one group
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [(head, p) for p in parts]


def _by_first(parts: list[str]) -> str:
    """One pattern for all parts, which tries each first letter once."""
    groups: dict[str, list[str]] = {}
    for p in parts:
        letter = p[0].isalpha() and p[1:2] not in ("?", "*", "+", "{")
        groups.setdefault(p[0] if letter else p, []).append(p[1:] if letter else "")
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


def matches_any(x: str, patterns: list[str]) -> str:
    """Whether one of the patterns is found: one pass over the text for all of them, without those of Cyrillic letters where the text has none."""
    parts = [a for p in patterns for a in _alternatives(p)]

    def found(of: list[tuple[str, str]]) -> str:
        by_head = ((h, [p for g, p in of if g == h]) for h in _HEADS)
        return f"regexp_like({x}, {quoted('(?iu)' + '|'.join(consuming(f'{h}(?:{_by_first(own)})') for h, own in by_head if own))})"

    def cyrillic(part: str) -> bool:
        for end in _ENDS:
            part = part.replace(end, "")
        return any("\u0400" <= c <= "\u052f" for c in part)

    return f"if(regexp_like({x}, {quoted(_CYRILLIC)}), {found(parts)}, {found([(h, p) for h, p in parts if not cyrillic(p)])})"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '')"


def word_list(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


def rule_reason(x: str) -> str:
    """Why the rule filter turns a text away; 'pass' if it does not."""
    t = stripped(f"coalesce({x}, '')")
    rules = " ".join(f"when {matches('t', p)} then '{why}'" for p, why in V.FILTER_RULES)
    rest = (
        rf"case when length(t) < 280 and regexp_count(t, '(?i)https?://') >= 4 then 'link_spam' "
        rf"when length(t) > 30 and length(regexp_replace(t, '[^\\p{{L}}]+', '')) < 20 then 'low_text_signal' else 'pass' end"
    )
    case = (
        rf"case when t = '' then 'empty' when length(t) < 40 and regexp_like(t, '^[^\\p{{L}}]{{0,12}}$') then 'too_short_junk' "
        rf"else coalesce(case when {matches_any('t', [p for p, _ in V.FILTER_RULES])} then case {rules} end end, {rest}) end"
    )
    return f"element_at(transform(array({t}), t -> {case}), 1)"


def is_ad(x: str) -> str:
    return matches(f"coalesce({x}, '')", V.AD)


def has_ad_markers(x: str) -> str:
    return matches(f"coalesce({x}, '')", V.AD_MARKERS)


def language(x: str) -> str:
    s = f"substring(coalesce({x}, ''), 1, 500)"
    cyr, lat = f"length(regexp_replace({s}, '[^а-яА-ЯёЁ]+', ''))", f"length(regexp_replace({s}, '[^a-zA-Z]+', ''))"
    return f"case when {cyr} > {lat} * 1.2D then 'ru' when {lat} > 0 then 'en' else 'ru' end"


def without_footers(x: str) -> str:
    footer = "|".join(f"(?:{p})" for p in V.FOOTER_LINES)
    return f"array_join(filter(split(coalesce({x}, ''), '\\n'), l -> not regexp_like(l, {quoted('(?iu)' + footer)})), '\\n')"


def theme(x: str) -> str:
    rules = " ".join(f"when {matches('b', p)} then '{name}'" for p, name in V.THEME_RULES)
    return f"element_at(transform(array({without_footers(x)}), b -> if({matches_any('b', [p for p, _ in V.THEME_RULES])}, case {rules} else 'other' end, 'other')), 1)"


def event_theme(title: str, summary: str, topic: str, current: str) -> str:
    first = theme(rf"concat({title}, '\n', {topic})")
    second = theme(rf"concat({title}, '\n', {summary}, '\n', {topic})")
    return f"coalesce(nullif({first}, 'other'), nullif({second}, 'other'), {normal_theme(current)})"


def normal_theme(x: str) -> str:
    s = f"trim(coalesce({x}, ''))"
    aliases = " ".join(f"when {s} = {quoted(a)} then '{t}'" for a, t in V.THEME_ALIASES.items())
    return f"case when {s} in ({word_list(V.THEMES)}) then {s} {aliases} when lower({s}) in ({word_list(V.THEMES)}) then lower({s}) else 'other' end"


def title_of(x: str) -> str:
    """The first line that is not blank, 180 characters at most; the text's start if that has fewer than 8."""
    t = stripped(f"coalesce({x}, '')")
    line = f"substring(coalesce(try_element_at(filter(transform(split({t}, '\\n'), l -> trim(l)), l -> l <> ''), 1), ''), 1, 180)"
    return f"element_at(transform(array(struct({line} as a, substring({t}, 1, 180) as b)), s -> case when length(s.a) >= 8 then s.a when s.b <> '' then s.b else 'Без заголовка' end), 1)"


def summary_of(x: str) -> str:
    t = stripped(f"coalesce({x}, '')")
    return f"element_at(transform(array({t}), t -> case when length(t) > 400 then concat(regexp_replace(substring(t, 1, 400), ' [^ ]*$', ''), '…') else t end), 1)"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}]+', 0)".replace("\\p", "\\\\p")


def important_hits(x: str) -> str:
    return f"size(filter({words(x)}, w -> w in ({word_list(V.IMPORTANT_WORDS)})))"


def stem(t: str, suffixes: list[str]) -> str:
    three, two = [s for s in suffixes if len(s) == 3], [s for s in suffixes if len(s) == 2]
    return (
        f"case when length({t}) > 5 and right({t}, 3) in ({word_list(three)}) then left({t}, length({t}) - 3) when length({t}) > 5 and right({t}, 2) in ({word_list(two)}) then left({t}, length({t}) - 2) "
        f"when length({t}) > 4 and right({t}, 1) in ({word_list(list(V.STEM_VOWELS))}) then left({t}, length({t}) - 1) else {t} end"
    )


def content_tokens(x: str, stop: list[str], suffixes: list[str]) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}\-]{{3,}}', 0)".replace("\\", "\\\\")
    kept = rf"filter({found}, t -> t not in ({word_list(stop)}) and not regexp_like(t, '^\\p{{Nd}}+$'))"
    return f"array_sort(array_distinct(transform({kept}, t -> {stem('t', suffixes)})))"


def merge_tokens(x: str) -> str:
    return content_tokens(x, V.MERGE_STOP, V.MERGE_SUFFIXES)


def similarity_tokens(x: str) -> str:
    return content_tokens(x, V.SIMILARITY_STOP, V.SIMILARITY_SUFFIXES)


def brands(x: str) -> str:
    p = "(?iu)" + V.TOPIC_ENTITIES.replace(r"\b(", f"(?<![{WORD}])(", 1)[:-2] + f"(?![{WORD}])"
    return f"array_distinct(transform(regexp_extract_all(coalesce({x}, ''), {quoted(p)}, 0), w -> trim(w)))"


def normal_entity(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^{WORD}]+', ' '))".replace("\\p", "\\\\p")


def slug(x: str) -> str:
    s = f"lower(trim(coalesce({x}, '')))"
    s = rf"regexp_replace(regexp_replace({s}, '[\\s./+]', '-'), '[^\\p{{L}}\\p{{N}}_\\-]', '')"
    s = f"substring(trim(BOTH '-' FROM regexp_replace({s}, '-+', '-')), 1, 240)"
    return f"coalesce(nullif({s}, ''), 'node')"


def channel_refs(x: str) -> str:
    p = r"(?i)(?:(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me)/(?:s/)?[A-Za-z0-9_]{4,}|@[A-Za-z0-9_]{4,})"
    name = f"lower(regexp_extract(r, '([A-Za-z0-9_]+)$', 1))"
    return f"array_distinct(filter(transform(regexp_extract_all(coalesce({x}, ''), {quoted(p)}, 0), r -> {name}), n -> n not in ({word_list(V.BLOCKED_CHANNELS)})))"


def message_url(username: str, channel: str, message: str) -> str:
    raw = f"cast(abs({channel}) as string)"
    return (
        f"case when coalesce({username}, '') <> '' then concat('https://t.me/', trim(LEADING '@' FROM {username}), '/', {message}) "
        f"else concat('https://t.me/c/', case when {raw} like '100%' then cast(try_cast(substring({raw}, 4) as bigint) as string) else {raw} end, '/', {message}) end"
    )


def without_mentions(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pattern, to in (
        (r"(?iu)[,;:\-—–]?\s*(?:эксклюзив|источник(?:и)?|переда[юя]т\s+источники|via|source(?:s)?)\s*@[\p{L}\p{N}_]{2,64}", ""),
        (rf"(?iu)(?<![{WORD}])@[{WORD}]{{2,64}}", ""), (r"[ \t]{2,}", " "), (r"^\s+|[\s,;:\-—–]+$", ""), (r"\(\s*\)", ""), (r"\s{2,}", " "), (r"^\s+|\s+$", ""),
    ):
        t = f"regexp_replace({t}, {quoted(pattern)}, '{to}')"
    return t


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def normal_query(x: str) -> str:
    return rf"trim(regexp_replace(translate(coalesce({x}, ''), 'ёЁ', 'еЕ'), '\\s+', ' '))"


def period_days(x: str) -> str:
    return "case " + " ".join(f"when {matches(x, p)} then {n}" for p, n in V.PERIODS) + " end"


def intent(x: str) -> str:
    q = f"trim(coalesce({x}, ''))"
    qa, rec, news, line, all_ = (matches(q, p) for p in (V.INTENT_QA, V.INTENT_RECOMMEND, V.INTENT_NEWS, V.INTENT_TIMELINE, V.INTENT_ALL))
    short = rf"size(filter(split({q}, '\\s+'), w -> w <> '')) <= 3"
    return f"case when {qa} then 'qa' when {rec} then 'recommendation' when {line} and not {news} then 'timeline' when ({all_} or ({short} and not {news})) and not {news} then 'entity' when {news} then 'news' when {line} then 'timeline' else 'news' end"


def dated(x: str, day: str) -> str:
    """Relative day words as DD.MM of the day they mean; "in N days" with any number of digits whose day lies before the year 10000."""
    p = rf"(?iu)(?<![{WORD}])через\s+\d+\s+(?:день|дня|дней|day|days)(?![{WORD}])"
    date = f"if(try_cast(regexp_extract(m, '[0-9]+', 0) as int) <= 2900000, date_format(date_add({day}, cast(regexp_extract(m, '[0-9]+', 0) as int)), 'dd.MM'), m)"
    found = f"transform(regexp_extract_all(t, {quoted(p)}, 0), m -> if(length(regexp_extract(m, '[0-9]+', 0)) > 7, m, {date}))"
    t = f"element_at(transform(array(coalesce({x}, '')), t -> array_join(zip_with(split(t, {quoted(p)}), {found}, (a, d) -> concat(a, coalesce(d, ''))), '')), 1)"
    for word, n in V.DAY_COUNTS.items():
        p = rf"(?iu)(?<![{WORD}])через\s+{word}\s+(?:день|дня|дней)(?![{WORD}])"
        t = f"regexp_replace({t}, {quoted(p)}, date_format(date_add({day}, {n}), 'dd.MM'))"
    for pattern, n in V.DAY_WORDS:
        p = "(?iu)" + pattern.replace(r"\b", f"(?<![{WORD}])", 1).replace(r"\b", f"(?![{WORD}])")
        t = f"regexp_replace({t}, {quoted(p)}, date_format(date_add({day}, {n}), 'dd.MM'))"
    return t


def importance(sources: str, age_hours: str, length: str, hits: str) -> str:
    fresh = f"case when {age_hours} is null then 1.0D else greatest(0.0D, 3.0D * (1.0D - greatest(0.0D, {age_hours}) / 48.0D)) end"
    size = f"case when {length} < 80 then 0.3D when {length} < 280 then 0.9D when {length} < 1200 then 1.5D else 1.2D end"
    return f"round(least(10.0D, greatest(0.0D, least(4.0D, {sources} * 1.2D) + {fresh} + {size} + least(1.5D, {hits} * 0.5D))), 2)"


def rank_score(semantic: str, distance: str, sources: str, score: str, age_hours: str, personal: str) -> str:
    c = lambda v: f"least(1.0D, greatest(0.0D, {v}))"
    g = f"case when {distance} <= 0 then 1.0D when {distance} = 1 then 0.65D else 0.35D end"
    return (
        f"0.35D * {c(semantic)} + 0.20D * ({g}) + 0.15D * {c(f'{sources} / 12.0D')} + 0.10D * {c(f'{score} / 10.0D')} + "
        f"0.10D * {c(f'1.0D - greatest(0.0D, {age_hours}) / 336.0D')} + 0.10D * {c(personal)}"
    )


def entity_tokens(names: str) -> str:
    """Normalised names and their parts of three characters or more."""
    return f"array_distinct(flatten(transform(filter(transform({names}, n -> {normal_entity('n')}), n -> n <> ''), n -> concat(array(n), filter(split(n, ' '), p -> length(p) >= 3)))))"


def light_entities(x: str, limit: int = 12) -> str:
    """Quoted spans, then runs of up to four capitalised words, each once; at most limit of them."""
    quoted_ = f"transform(regexp_extract_all(coalesce({x}, ''), {quoted('[«\"“]([^»\"”]{2,80})[»\"”]')}, 1), v -> trim(v))"
    run = rf"(?<![{WORD}])([A-ZА-ЯЁ][{WORD}\-]*(?:\s+[A-ZА-ЯЁ][{WORD}\-]*){{0,3}})(?![{WORD}])"
    named = f"filter(transform(regexp_extract_all(coalesce({x}, ''), {quoted(run)}, 1), v -> trim(v)), v -> length(v) >= 3)"
    return f"slice(array_distinct(concat({quoted_}, {named})), 1, {limit})"


def significant_tokens(x: str) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}\-]{{2,}}', 0)".replace("\\", "\\\\")
    return rf"array_distinct(filter({found}, t -> t not in ({word_list(V.SEARCH_STOP)}) and not regexp_like(t, '^\\p{{Nd}}+$')))"


def faithful(query: str, answer: str, evidence: str) -> str:
    """False where the answer repeats a query token of five letters or more that the evidence does not have."""
    return f"not exists({significant_tokens(query)}, t -> length(t) >= 5 and contains(lower({answer}), t) and not contains(lower({evidence}), t))"


def relevant(query: str, blob: str, similarity: str) -> str:
    """Token overlap gate: one hit of one or two tokens, else half of them; similarity 0.45 passes anyway."""
    t = f"filter({significant_tokens(query)}, t -> length(t) >= 3)"
    return f"element_at(transform(array({t}), m -> size(m) = 0 or {similarity} >= 0.45 or size(filter(m, t -> contains(lower({blob}), t))) >= if(size(m) <= 2, 1, greatest(1, cast(floor(size(m) / 2) as int)))), 1)"


#: Letters whose capital form is one letter, where full case mapping gives several (ß: SS).
_ONE_CAPITAL = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x1F80, 0x1FFD)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c}


def capitals(x: str) -> str:
    """The text in capitals, letter by letter: its length stays, letters that have no single capital stay."""
    one = f"if(length(upper(c)) = 1, upper(c), translate(c, '{''.join(_ONE_CAPITAL)}', '{''.join(_ONE_CAPITAL.values())}'))"
    return f"if(length(upper({x})) = length({x}), upper({x}), array_join(transform(split({x}, ''), c -> if(c = '', '', {one})), ''))"


def title_case(x: str) -> str:
    """Titles that are mostly capitals are rewritten: brands by the list, short acronyms kept, other words capitalised."""
    t = f"trim(coalesce({x}, ''))"
    letters, upper = rf"length(regexp_replace({t}, '[^\\p{{L}}]', ''))", rf"length(regexp_replace({t}, '[^\\p{{Lu}}]', ''))"
    brand = "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in V.BRANDS.items()) + "), w)"
    word = f"case when w in ({word_list(list(V.BRANDS))}) then {brand} when length(w) <= 2 and regexp_like(w, '^[^0-9]+$') then {capitals('w')} else concat({capitals('left(w, 1)')}, substring(w, 2)) end"
    return f"case when {letters} > 0 and {upper} >= 0.65D * {letters} then array_join(transform(split(lower({t}), ' '), w -> {word}), ' ') else {t} end"


def stage_percent(stage: str, done: str, total: str) -> str:
    """Progress of a job whose stages have weights; within a stage by its tasks. 100 only when done."""
    base, case = 0, []
    for name, weight in V.STAGES[:-1]:
        case.append(f"when '{name}' then {base} + {weight} * if({total} > 0, least(1D, greatest(0D, {done} / cast({total} as double))), 0D)")
        base += weight
    return f"case {stage} when 'done' then 100 else cast(greatest(0, least(99, case {stage} {' '.join(case)} else 0 end)) as int) end"


def clean_weights(weights: str) -> str:
    """Weights of the known themes, 1 to 5, 3 where there is none."""
    return f"map_from_arrays(array({word_list(V.THEMES)}), transform(array({word_list(V.THEMES)}), k -> greatest(1, least(5, coalesce(try_element_at({weights}, k), 3)))))"


def enabled_themes(raw: str) -> str:
    """Known themes of an old list, in order, each once; none, or eight and more, means all."""
    known = f"array_distinct(transform({raw}, x -> {normal_theme('x')}))"
    return f"case when coalesce(size({raw}), 0) <= 0 then array({word_list(V.THEMES)}) when size({known}) >= 8 then array_distinct(concat({known}, array({word_list(V.THEMES)}))) else {known} end"
