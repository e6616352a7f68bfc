"""Queries over posts: filter, themes, language, importance, summaries, references, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import vocab as V
from ..sources.tables import POSTS_SQL, posts, table
from . import duck as D

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_T = f"(select id, channel, lang, minute, text, {D.stripped('text')} as t from {POSTS_SQL} p)"
_IMP = D.importance("1", "(1000000 - minute) / 60.0::double % 60", "length(text)", D.important_hits("text"))


@query(
    f"select id as event_id, channel, theme, importance from (select id, channel, {D.rule_reason('t')} as reason, {D.theme('b')} as theme, {_IMP} as importance "
    f"from (select *, {D.without_footers('text')} as b from {_T} x) y) z where reason = 'pass' order by importance desc, event_id limit 100"
)
def top_events_with_sources(spark: SparkSession, d: str) -> DataFrame:
    """Posts that pass the filter, with theme and importance: the 100 most important."""
    p = posts(spark, d).withColumn("reason", F.expr(E.rule_reason("text"))).where("reason = 'pass'")
    p = p.withColumn("hits", F.expr(E.important_hits("text"))).withColumn("age", F.expr("(1000000 - minute) / 60.0D % 60"))
    p = p.withColumn("importance", F.expr(E.importance("1", "age", "length(text)", "hits")))
    top = p.select(F.col("id").alias("event_id"), "channel", "text", "importance").orderBy(F.desc("importance"), "event_id").limit(100)
    return top.select("event_id", "channel", F.expr(E.theme("text")).alias("theme"), "importance")  # themes of a hundred posts


@query(f"select {D.rule_reason('t')} as reason, count(*) as n from {_T} x group by 1")
def rule_filter_reasons(spark, d):
    return posts(spark, d).select(F.expr(E.rule_reason("text")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"select {D.matches('text', V.AD)} as is_ad, {D.matches('text', V.AD_MARKERS)} as has_marker, count(*) as n from {POSTS_SQL} p group by 1, 2")
def ad_flag_counts(spark, d):
    return posts(spark, d).select(F.expr(E.is_ad("text")).alias("is_ad"), F.expr(E.has_ad_markers("text")).alias("has_marker")).groupBy("is_ad", "has_marker").agg(F.count(F.lit(1)).alias("n"))


@query(f"select lang, {D.language('text')} as detected, count(*) as n from {POSTS_SQL} p group by 1, 2")
def language_id(spark, d):
    return posts(spark, d).select("lang", F.expr(E.language("text")).alias("detected")).groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(f"select {D.theme('b')} as theme, count(*) as n from (select {D.without_footers('text')} as b from {POSTS_SQL} p) x group by 1")
def theme_distribution(spark, d):
    return posts(spark, d).select(F.expr(E.theme("text")).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


_NORMAL = "case " + f"when s in ({D.words_in(V.THEMES)}) then s " + " ".join(f"when s = {D.q(a)} then '{t}'" for a, t in V.THEME_ALIASES.items()) + f" when lower(s) in ({D.words_in(V.THEMES)}) then lower(s) else 'other' end"
_OLD = ["AI", "Software", "GAMING", "crypto", "Наука", "", "Nonsense", "work", "Politics & Society", "media"]


@query(
    f"select old_theme, {_NORMAL} as normal_theme, {D.theme('b')} as new_theme, count(*) as n from (select *, trim(old_theme) as s from (select ['{chr(39).join([])}" + "', '".join(_OLD) + f"'][id % 10 + 1] as old_theme, {D.without_footers('text')} as b from {POSTS_SQL} p) x) y group by 1, 2, 3"
)
def category_transitions(spark, d):
    """Old to normalised to newly classified theme."""
    old = f"element_at(array({E.word_list(_OLD)}), cast(id % 10 + 1 as int))"
    return (
        posts(spark, d).select(F.expr(old).alias("old_theme"), F.expr(E.theme("text")).alias("new_theme")).withColumn("normal_theme", F.expr(E.normal_theme("old_theme")))
        .groupBy("old_theme", "normal_theme", "new_theme").agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"select id, {_IMP} as importance from {POSTS_SQL} p")
def importance_scores(spark, d):
    p = posts(spark, d).select("id", F.expr("(1000000 - minute) / 60.0D % 60").alias("age"), F.expr(E.important_hits("text")).alias("hits"), F.length("text").alias("size"))
    return p.select("id", F.expr(E.importance("1", "age", "size", "hits")).alias("importance"))


@query(f"select id, {D.title_of('t')} as title, {D.summary_of('t')} as summary from {_T} x")
def extractive_summary(spark, d):
    return posts(spark, d).select("id", F.expr(E.title_of("text")).alias("title"), F.expr(E.summary_of("text")).alias("summary"))


_REF = r"(?i)(?:(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me)/(?:s/)?[A-Za-z0-9_]{4,}|@[A-Za-z0-9_]{4,})"


@query(
    f"select ref, count(*) as n from (select distinct id, lower(regexp_extract(r, '([A-Za-z0-9_]+)$', 1)) as ref from (select id, unnest(regexp_extract_all(text, {D.q(_REF)})) as r from {POSTS_SQL} p) x) y where ref not in ({D.words_in(V.BLOCKED_CHANNELS)}) group by ref"
)
def channel_refs_extract(spark, d):
    return posts(spark, d).select("id", F.explode(F.expr(E.channel_refs("text"))).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select c_custkey, case when c_custkey % 3 = 0 then concat('https://t.me/', ltrim(c_name, '@'), '/', c_custkey) else concat('https://t.me/c/', case when cast(c_custkey as varchar) like '100%' "
    "then cast(try_cast(substr(cast(c_custkey as varchar), 4) as bigint) as varchar) else cast(c_custkey as varchar) end, '/', c_custkey) end as url from customer where cast(c_custkey as varchar) <> '100'"
)
def url_builder(spark, d):
    c = table(spark, d, "customer").where("cast(c_custkey as string) <> '100'")
    return c.select("c_custkey", F.expr(E.message_url("case when c_custkey % 3 = 0 then c_name end", "-c_custkey", "c_custkey")).alias("url"))


@query(
    r"select p_partkey, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[\s./+]', '-', 'g'), '[^\p{L}\p{N}_\-]', '', 'g'), '-+', '-', 'g'), '-'), 1, 240), ''), 'node') as slug from part"
)
def slugify_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(E.slug("p_name")).alias("slug"))


@query(f"select id, len({D.merge_tokens('t')}) as n_tokens, len(regexp_extract_all(lower(t), '[{E.WORD}]+')) as n_words from {_T} x")
def token_stats(spark, d):
    t = posts(spark, d).select("id", F.expr(E.stripped("text")).alias("t"))
    return t.select("id", F.size(F.expr(E.merge_tokens("t"))).cast("long").alias("n_tokens"), F.size(F.expr(E.words("t"))).cast("long").alias("n_words"))


_QUESTIONS = ["Что нового по Apple?", "Почему Apple судится с OpenAI?", "Лучшие нейросети для блогеров", "новости NVIDIA за неделю", "today about Apple", "all news about the big launch", "NVIDIA", "best laptops this month", "hronology of events since yesterday evening", "how come it failed"]
_QV = ", ".join(f"({i}, {D.q(x)})" for i, x in enumerate(_QUESTIONS))


def _duck_intent(x: str) -> str:
    qa, rec, news, line, all_ = (D.matches(x, p) for p in (V.INTENT_QA, V.INTENT_RECOMMEND, V.INTENT_NEWS, V.INTENT_TIMELINE, V.INTENT_ALL))
    short = f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')) <= 3"
    return f"case when {qa} then 'qa' when {rec} then 'recommendation' when {line} and not {news} then 'timeline' when ({all_} or ({short} and not {news})) and not {news} then 'entity' when {news} then 'news' when {line} then 'timeline' else 'news' end"


_ASKED = f"(select conv_id * 1000 + turn as id, text as qs from conversations where text is not null union all select -1 - id, qs from (values {_QV}) k(id, qs))"


@query(f"select id, {_duck_intent('qs')} as intent, case {' '.join(f'when {D.matches(chr(113) + chr(115), p)} then {n}' for p, n in V.PERIODS)} end as period_days from {_ASKED} v")
def intent_detect(spark, d):
    """Intent and period of what users say in conversations, and of the known questions."""
    said = table(spark, d, "conversations").where("text is not null").select(F.expr("conv_id * 1000 + turn").alias("id"), F.col("text").alias("qs"))
    known = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(_QUESTIONS)], "id long, qs string")
    return said.unionAll(known).select("id", F.expr(E.intent("qs")).alias("intent"), F.expr(E.period_days("qs")).alias("period_days"))


@query(f"select id, regexp_replace(regexp_replace(trim(regexp_replace(translate(t, 'ёЁ', 'еЕ'), '\\s+', ' ', 'g')), '&', '&amp;', 'g'), '<', '&lt;', 'g') as line from (select id, replace(text, '>', '') as t from {POSTS_SQL} p) x")
def normalized_lines(spark, d):
    """Query normalisation and escaping over whole texts."""
    return posts(spark, d).select("id", F.expr(E.escaped(E.normal_query("replace(text, '>', '')"))).alias("line"))


def _duck_dated(t: str, day: str) -> str:
    """Numbers of days first: their places are marked twice, because a match consumes its right neighbour."""
    w, mark = E.WORD, "chr(57344)"
    num = D.q(rf"(?i)(^|[^{w}])через\s+(\d+)\s+(?:день|дня|дней|day|days)($|[^{w}])")
    once = lambda x: f"regexp_replace({x}, {num}, concat('\\1', {mark}, '\\2', {mark}, '\\3'), 'g')"
    label = lambda n: f"strftime({day} + {n} * interval 1 day, '%d.%m')"
    # numbers beyond the calendar stay as they are
    part = f"case when i % 2 = 1 then x when length(x) > 7 or x::bigint > 2900000 then concat('через ', x, ' дней') else {label('x::bigint')} end"
    out = f"array_to_string(list_transform(string_split({once(once(t))}, {mark}), lambda x, i: {part}), '')"
    words = [(rf"через\s+{k}\s+(?:день|дня|дней)", n) for k, n in V.DAY_COUNTS.items()] + [(p.replace(r"\b", ""), n) for p, n in V.DAY_WORDS]
    for pattern, n in words:
        for _ in range(2):
            out = f"regexp_replace({out}, {D.q(rf'(?i)(^|[^{w}]){pattern}($|[^{w}])')}, concat('\\1', {label(n)}, '\\2'), 'g')"
    return out


@query(f"select id, sha256({_duck_dated('text', 'day')}) as text_sha256 from (select id, text, date '2024-01-01' + (id % 300)::int as day from {POSTS_SQL} p) x")
def relative_dates(spark, d):
    """Day words, counts of days and numbers of days become dates, by each post's own day."""
    p = posts(spark, d).select("id", "text", F.expr("date_add(date'2024-01-01', cast(id % 300 as int))").alias("day"))
    return p.select("id", F.sha2(F.expr(E.dated("text", "day")), 256).alias("text_sha256"))


def _duck_mentions(t: str) -> str:
    w, sp = E.WORD, r"[ \t\n\x0B\f\r]"
    for pattern, to in (
        (rf"(?i)[,;:\-—–]?{sp}*(?:эксклюзив|источник(?:и)?|переда[юя]т{sp}+источники|via|source(?:s)?){sp}*@[{w}]{{2,64}}", ""),
        (rf"(^|[^{w}])@[{w}]{{2,64}}", r"\1"), (r"[ \t]{2,}", " "), (rf"^{sp}+|[ \t\n\x0B\f\r,;:\-—–]+$", ""), (rf"\({sp}*\)", ""), (rf"{sp}{{2,}}", " "), (rf"^{sp}+|{sp}+$", ""),
    ):
        t = f"regexp_replace({t}, {D.q(pattern)}, '{to}', 'g')"
    return t


@query(f"select id, sha256({_duck_mentions('text')}) as text_sha256 from {POSTS_SQL} p")
def mentions_removed(spark, d):
    """whole texts without mentions and what they leave behind."""
    return posts(spark, d).select("id", F.sha2(F.expr(E.without_mentions("text")), 256).alias("text_sha256"))


_BRAND = V.TOPIC_ENTITIES.replace(r"\b(", f"(?i)(?:^|[^{E.WORD}])(", 1)[:-2] + f"(?:[^{E.WORD}]|$)"


@query(f"select brand, count(*) as n from (select distinct id, trim(b) as brand from (select id, unnest(regexp_extract_all(text, {D.q(_BRAND)}, 1)) as b from {POSTS_SQL} p) x) y group by 1")
def brand_entities(spark, d):
    """Brands named in posts, once per post."""
    p = posts(spark, d).select(F.explode(F.expr(E.brands("text"))).alias("brand"))
    return p.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
