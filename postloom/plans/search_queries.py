"""Ranked search over whole posts: every post whose id is divisible by 100 asks, all posts answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import keeper
from ..functions import expressions as E
from ..functions import vocab as V
from ..operators import graph as G
from ..operators import readers as R
from ..operators import search as S
from ..sources.tables import POSTS_SQL, actions, posts
from . import duck as D
from .graph_queries import _AL, _MENTION
from .reader_queries import _STATES
from .text_queries import _duck_intent

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: The time of the searches, in minutes; posts are spread over the time before it.
NOW = 50_000
#: What is put behind the text of a question, by its number, so that every intent, period and kind of seed occurs.
ASKED = {1: " OpenAI", 2: " Apple и NVIDIA за месяц", 3: " новости за неделю", 4: " лучшие игры Steam", 5: " хронология Microsoft", 6: " почему Apple судится"}
_PHRASE = "case {no} % 7 " + " ".join(f"when {k} then '{v}'" for k, v in ASKED.items()) + " else '' end"


def _parts(spark, d):
    """(events, mentions, questions without settings): the inputs of the searches."""
    p = posts(spark, d)
    e = p.select(
        "id", F.expr(E.title_of("text")).alias("title"), F.expr(E.summary_of("text")).alias("summary"), "text", F.expr(E.theme("text")).alias("theme"), F.expr(f"pmod(minute * 37, {NOW})").alias("updated"),
        F.expr("id % 13 + 1").alias("sources"), F.expr("id * 7 % 101 / 10D").alias("importance"),
    )
    q = p.where("id % 100 = 0").select("id", F.concat("text", F.expr(_PHRASE.format(no="(id div 100)"))).alias("text"))
    return e, G.mentioned_nodes(spark, p).select("id", "name"), q


def _inputs(spark, d):
    """(writer, events, questions, questions as asked, searchable events), kept: all searches of a query share them."""
    keep = keeper(spark)
    e, mentions, q = _parts(spark, d)
    e, mentions = keep(e, "events"), keep(mentions, "mentions")
    edges = G.weighted(G.cooccurrence(mentions.select(F.col("id").alias("event_id"), F.col("name").alias("node_id"))))
    return keep, e, q, keep(S.asked(q, edges, NOW), "asked"), keep(S.searchable(e, mentions), "searchable")


def _searched(spark, d, user: bool, inputs=None):
    """(hits, questions as asked, events)."""
    keep, e, q, asked, searchable = inputs or _inputs(spark, d)
    personal = None
    if user:
        themes = E.word_list(V.THEMES)
        asked = asked.withColumn("weights", F.expr(f"map_from_arrays(array({themes}), transform(sequence(1, {len(V.THEMES)}), i -> cast((id div 100 + i) % 5 + 1 as int)))"))
        asked = asked.withColumn("enabled", F.expr(f"if(id div 100 % 4 = 0, cast(array() as array<string>), slice(array({themes}), 1, 5))"))
        s = R.user_states(actions(spark, d)).select("user_id", F.col("news_id").alias("event"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("personal") + 2) / 6.0)).alias("personal"))
        personal = q.select(F.col("id").alias("question"), F.expr("id div 100 % 50").alias("user_id")).join(s, "user_id").select("question", "event", "personal")
    within = lambda df, name: keep(df, f"{'own' if user else 'every'}-{name}")
    return S.ranked(searchable, asked, within, NOW, personal=personal), asked, e


def _sql(user: bool) -> str:
    sparse = lambda t: f"""(select id, dim, sum(s)::bigint as weight from (select id, ('0x' || substr(md5(word), 1, 8))::bigint % 384 as dim, case when ('0x' || substr(md5(word), 9, 2))::bigint % 2 = 0 then 1 else -1 end as s
  from (select id, unnest(regexp_extract_all(lower(text), '[{E.WORD}]+')) as word from {t}) w) x group by 1, 2)"""  # noqa: E731
    significant = f"list_filter(regexp_extract_all(lower(text), '[{E.WORD}\\-]{{2,}}'), lambda t: t not in ({D.words_in(V.SEARCH_STOP)}) and not regexp_matches(t, '^\\p{{Nd}}+$') and length(t) >= 4)"
    anyof = lambda words: "(" + " or ".join(f"contains(lower(x.blob), {D.q(w)}) or contains(lower(y.blob), {D.q(w)})" for w in words) + ")"
    clip = lambda x: f"least(1.0::double, greatest(0.0::double, {x}))"
    fresh = clip(f"1.0::double - greatest(0.0::double, ({NOW} - updated) / 60.0::double) / 336.0::double")
    personal = f"coalesce({clip('(st.personal + 2) / 6.0::double')}, 0.0::double)" if user else "0.0::double"
    taste = f"least(1.0::double, ((q.id // 100 + list_position([{D.words_in(V.THEMES)}], theme)) % 5 + 1) / 5.0::double) * case when q.id // 100 % 4 <> 0 and not list_contains([{D.words_in(V.THEMES[:5])}], theme) then 0.35::double else 1.0::double end"
    total = f"least(1.0::double, 0.70::double * turned + 0.30::double * (0.55::double * ({taste}) + 0.45::double * pers))" if user else "turned"
    period = " ".join(f"when {D.matches('text', p)} then {n}" for p, n in V.PERIODS)
    return f"""with recursive ev as (select id, {D.title_of('t')} as title, {D.summary_of('t')} as summary, text, {D.theme('b')} as theme, minute * 37 % {NOW} as updated, id % 13 + 1 as sources, (id * 7 % 101) / 10.0::double as importance
  from (select id, text, minute, {D.stripped('text')} as t, {D.without_footers('text')} as b from {POSTS_SQL} p) x),
 q as (select id, text, {_duck_intent('text')} as intent, {NOW} - coalesce(case {period} end, 30) * 1440 as since from (select id, trim(regexp_replace(translate(concat(text, {_PHRASE.format(no='(id // 100)')}), 'ёЁ', 'еЕ'), '\\s+', ' ', 'g')) as text from {POSTS_SQL} p where id % 100 = 0) x where text <> ''),
 mention as materialized (select id, name from {_MENTION} m), edge as (select x.name as a, y.name as b, least(1.0::double, 0.45::double + 0.04::double * (count(*) - 1)) as weight from mention x join mention y on x.id = y.id and x.name <> y.name group by 1, 2),
 alias as (select q.id, al.name, min(ord - 1000 * length(alias)) as p from q join {_AL} on contains(lower(q.text), alias) and length(alias) >= 3 group by 1, 2),
 seed as (select q.id, coalesce(s.names, list_slice(list_filter({significant}, lambda x, i: list_position({significant}, x) = i), 1, 5)) as seeds from q left join (select id, list(name order by p) as names from alias group by 1) s on s.id = q.id),
 around as (select alias.id, edge.b as name, max(weight) as weight from alias join edge on edge.a = alias.name where not exists (select 1 from alias z where z.id = alias.id and z.name = edge.b) group by 1, 2),
 node as (select id, name, 0 as distance from alias union all select id, name, 1 from (select *, row_number() over (partition by id order by weight desc, name) as k from around) x where k <= 10),
 hit as (select n.id as qid, m.id as eid, min(n.distance) as distance, list(n.name order by n.name) as matched from node n join mention m on m.name = n.name join q on q.id = n.id join ev on ev.id = m.id where updated >= since group by 1, 2),
 evv as materialized {sparse('ev')}, qv as materialized {sparse('q')}, en as (select id, sqrt(sum(weight * weight)) as n from evv group by 1), qn as (select id, sqrt(sum(weight * weight)) as n from qv group by 1),
 dot as (select qv.id as qid, evv.id as eid, sum(qv.weight * evv.weight) as s from qv join evv using (dim) group by 1, 2),
 sim as materialized (select qid, eid, round({clip('s / nullif(qn.n * en.n, 0)')}, 6) as sim from dot join qn on qn.id = qid join en on en.id = eid),
 near as (select qid, eid from (select qid, eid, row_number() over (partition by qid order by sim desc, eid) as k from sim join q on q.id = qid join ev on ev.id = eid where updated >= since and sim >= 0.16 and (intent in ('recommendation', 'qa') or qid not in (select qid from hit))) x where k <= 40),
 cand as (select qid, eid from hit union select qid, eid from near),
 parts as (select c.qid, c.eid, q.id, q.intent, theme, coalesce(sim, 0.0::double) as sim, h.distance is not null as graph, coalesce(h.distance, 2) as distance, coalesce(matched, []) as matched, seeds, sources, importance, {fresh} as fresh, {personal} as pers
  from cand c join q on q.id = c.qid join ev on ev.id = c.eid join seed on seed.id = c.qid left join hit h on h.qid = c.qid and h.eid = c.eid left join sim on sim.qid = c.qid and sim.eid = c.eid {f'left join {_STATES} st on st.user_id = c.qid // 100 % 50 and st.news_id = c.eid' if user else ''}),
 scored as (select *, 0.35::double * sim + 0.20::double * case when distance = 0 then 1.0::double when distance = 1 then 0.65::double else 0.35::double end + 0.15::double * {clip('sources / 12.0::double')} + 0.10::double * {clip('importance / 10.0::double')} + 0.10::double * fresh + 0.10::double * pers as score from parts),
 turned as (select * exclude (score), case intent when 'timeline' then 0.55::double * fresh + 0.45::double * score when 'entity' then case when graph then least(1.0::double, score + 0.08::double) else score end when 'recommendation' then 0.5::double * score + 0.3::double * {clip('importance / 10.0::double')} + 0.2::double * pers else score end as turned from scored),
 taken as (select * from (select q.*, round({total}, 6) as score from turned q) x where score >= 0.38 and (graph or len(seeds) = 0 or (sim >= 0.45 and (sim >= 0.48 or intent in ('qa', 'recommendation'))))),
 ordered as materialized (select *, row_number() over (partition by qid order by score desc, eid) as r from taken),
 blobs as (select id, concat_ws(' ', title, summary) as blob from ev where id in (select eid from ordered)), toks as materialized (select id, blob, {D.merge_tokens('blob')} as tokens from blobs), tok as (select id, unnest(tokens) as token from toks),
 met as (select a.id as i, b.id as j, count(*) as shared, max(case when a.token in ('max', 'макс') then 1 else 0 end) as m from tok a join tok b on a.token = b.token and a.id < b.id group by 1, 2),
 twin as materialized (select i, j from (select i, j, shared, m, shared / (len(x.tokens) + len(y.tokens) - shared)::double as overlap, least(len(x.tokens), len(y.tokens)) as low, {anyof(V.REMOVAL_WORDS)} as gone, {anyof(V.STORE_WORDS)} as store from met join toks x on x.id = i join toks y on y.id = j) z
  where overlap >= 0.30 or (shared >= 3 and overlap >= 0.22) or (low >= 3 and shared / low::double >= 0.72) or (shared >= 2 and gone and ((store and m = 1) or overlap >= 0.12))),
 twins as (select i as a, j as b from twin union all select j, i from twin), dups as materialized (select o.qid, o.r, o.eid, coalesce(list(p.eid) filter (p.eid is not null), []) as like_ from ordered o left join twins on a = o.eid left join ordered p on p.qid = o.qid and p.eid = b and p.r < o.r group by 1, 2, 3),
 fold(qid, r, kept) as (select distinct qid, 0::bigint, []::bigint[] from ordered union all select d.qid, d.r, case when len(kept) < 10 and not list_has_any(kept, like_) then list_append(kept, d.eid) else kept end from fold join dups d on d.qid = fold.qid and d.r = fold.r + 1),
 last as (select qid, arg_max(kept, r) as kept from fold group by 1), found as (select o.*, list_position(kept, o.eid) as place from ordered o join last on last.qid = o.qid and list_contains(kept, o.eid))"""


_WHY = f"""array_to_string(list_concat(list_transform(list_slice(case when graph then matched else list_slice(seeds, 1, 2) end, 1, 4), lambda n: concat({D.q(V.WHY['node'])}, n)), case when graph then [{D.q(V.WHY['graph'])}] else [] end,
 case when sources >= 2 then [concat({D.q(V.WHY['sources'][0])}, sources, {D.q(V.WHY['sources'][1])})] else [] end, case when fresh >= 0.7 then [{D.q(V.WHY['fresh'])}] else [] end, case when importance >= 6 then [{D.q(V.WHY['important'])}] else [] end), '; ')"""
_HITS = f"select qid as question, place, eid as event, score, sim as semantic, distance, {_WHY} as explanation from found"


def _hits(spark, d, user: bool):
    hits, asked, _ = _searched(spark, d, user)
    return S.explained(hits, asked).select("question", F.col("place").cast("long").alias("place"), "event", "score", "semantic", F.col("distance").cast("long").alias("distance"), F.array_join("explanation", "; ").alias("explanation"))


@query(f"{_sql(False)} {_HITS}")
def search_ranked(spark, d):
    """The ten best events of each question, with scores and reasons."""
    return _hits(spark, d, False)


@query(f"{_sql(True)} {_HITS}")
def search_ranked_users(spark, d):
    """N3 with N4 and M11: the same for users with history, weights and enabled themes."""
    return _hits(spark, d, True)


_ANSWER = f"""{_sql(False)}, top as (select f.*, row_number() over (partition by qid order by f.sources desc, fresh desc, f.score desc, eid) as k, title, substr(summary, 1, 600) as short from found f join ev on ev.id = eid),
 words as (select id, text, case when len(list_filter(w, lambda t: not regexp_matches(t, '^\\p{{Nd}}+$'))) > 0 then list_filter(w, lambda t: not regexp_matches(t, '^\\p{{Nd}}+$')) else w end as w from (select id, text, list_distinct(regexp_extract_all(lower(text), '[{E.WORD}]{{3,}}')) as w from q) x),
 rel as (select t.*, w.text, row_number() over (partition by qid order by k) as n from top t join words w on w.id = qid where k <= 6 and len(list_filter(w.w, lambda x: contains(lower(concat_ws(' ', title, short)), x))) >= case when len(w.w) <= 2 then 1 else greatest(1, len(w.w) // 2) end),
 said as (select qid, list(eid order by n) as used, string_agg(concat('• ', title, ': ', substr(short, 1, 160)), chr(10) order by n) as lines, string_agg(lower(concat_ws(' ', title, short)), ' ' order by n) as evidence from rel where n <= 5 group by 1),
 full_ as (select q.id as question, q.text, case when qid is null then {D.q(V.ANSWER_EMPTY)} else concat({D.q(V.ANSWER_HEAD[0])}, q.text, {D.q(V.ANSWER_HEAD[1])}, chr(10), lines) end as answer, array_to_string(coalesce(used, []), ',') as used, qid is not null as relevant, coalesce(evidence, '') as evidence from q left join said on qid = q.id)
 select question, sha256(answer) as answer_sha256, used, relevant, len(list_filter(regexp_extract_all(lower(text), '[{E.WORD}\\-]{{2,}}'), lambda t: t not in ({D.words_in(V.SEARCH_STOP)}) and not regexp_matches(t, '^\\p{{Nd}}+$') and length(t) >= 5 and contains(lower(answer), t) and not contains(evidence, t))) = 0 as faithful from full_"""


@query(_ANSWER)
def search_answers(spark, d):
    """Answers assembled from the six best confirmed hits."""
    hits, asked, e = _searched(spark, d, False)
    a = S.answered(hits, asked, e)
    return a.select("question", F.sha2("answer", 256).alias("answer_sha256"), F.array_join(F.transform("used", lambda x: x.cast("string")), ",").alias("used"), "relevant", "faithful")


@query(
    f"""with every as ({_sql(False)} select qid, eid from found), own as ({_sql(True)} select qid, eid from found), asking as (select id from (select id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from {POSTS_SQL} p where id % 100 = 0) x where t <> '' or id // 100 % 7 > 0)
 select id as question, coalesce(n, 0) as external from asking left join (select qid, count(*) as n from every where not exists (select 1 from own where own.qid = every.qid and own.eid = every.eid) group by 1) x on qid = id"""
)
def search_external(spark, d):
    """Hits of each question among all events that its user's own search does not show."""
    inputs = _inputs(spark, d)
    own, _, _ = _searched(spark, d, True, inputs)
    every, asked, _ = _searched(spark, d, False, inputs)
    extra = every.select("question", "event").join(own.select("question", "event"), ["question", "event"], "left_anti").groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    return asked.select(F.col("id").alias("question")).join(extra, "question", "left").select("question", F.coalesce("n", F.lit(0)).alias("external"))
