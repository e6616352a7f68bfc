"""Queries that build records: full similarity, analyses, entities, titles, progress, preferences, scans, trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import expressions as E
from ..functions import vocab as V
from ..operators import pairs as P
from ..sources.tables import ACTIONS_SQL, LINKS_SQL, NEWS_SQL, POSTS_SQL, actions, links, news, posts, table
from . import duck as D
from .pair_queries import _NEAR, _ST
from .text_queries import _NORMAL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_BR = V.TOPIC_ENTITIES.replace(r"\b(", f"(?i)(?:^|[^{E.WORD}])(", 1)[:-2] + f"(?:[^{E.WORD}]|$)"
_NAMES = rf"list_transform(list_distinct(list_transform(regexp_extract_all(blob, {D.q(_BR)}, 1), lambda w: trim(w))), lambda n: trim(regexp_replace(lower(n), '[^{E.WORD}]+', ' ', 'g')))"
_ENT = f"list_distinct(flatten(list_transform(list_filter({_NAMES}, lambda n: n <> ''), lambda n: list_concat([n], list_filter(string_split(n, ' '), lambda p: length(p) >= 3)))))"


@query(
    f"""with {_ST}, near as (select a, b from pairs where {_NEAR}),
 v as (select rep, ('0x' || substr(md5(word), 1, 8))::bigint % 384 as dim, sum(case when ('0x' || substr(md5(word), 9, 2))::bigint % 2 = 0 then 1 else -1 end)::bigint as w from (select rep, unnest(regexp_extract_all(lower(blob), '[{E.WORD}]+')) as word from items) x group by 1, 2),
 nm as (select rep, sqrt(sum(w * w)) as norm from v group by rep), dots as (select a, b, sum(x.w * y.w) as dot from near join v x on x.rep = a join v y on y.rep = b and y.dim = x.dim group by 1, 2),
 side as (select items.rep, norm, {_ENT} as ent, {D.content_tokens('blob', V.SIMILARITY_STOP, V.SIMILARITY_SUFFIXES)} as kw, {D.theme('blob')} as theme from items left join nm on nm.rep = items.rep),
 parts as (select near.a, near.b, least(1.0::double, greatest(0.0::double, coalesce(dot / (x.norm * y.norm), 0))) as emb, case when len(x.ent) = 0 and len(y.ent) = 0 then 0.0 when len(x.ent) = 0 or len(y.ent) = 0 then 0.35 else len(list_intersect(x.ent, y.ent)) / len(list_distinct(list_concat(x.ent, y.ent)))::double end::double as ent,
  case when len(x.kw) = 0 or len(y.kw) = 0 then 0 else len(list_intersect(x.kw, y.kw)) / len(list_distinct(list_concat(x.kw, y.kw)))::double end::double as key, len(list_intersect(x.kw, y.kw)) as sh, greatest(0.0::double, 1.0::double - abs(near.a - near.b) / 60.0::double / 72.0::double) as tim, x.theme = y.theme as same
  from near left join dots on dots.a = near.a and dots.b = near.b join side x on x.rep = near.a join side y on y.rep = near.b)
 select a, b, round(emb, 4) as embedding, round(ent, 4) as entities, round(key, 4) as keywords, round(tim, 4) as time, round(greatest(least(1.0::double, 0.60::double * emb + 0.20::double * ent + 0.10::double * key + 0.10::double * tim + case when same then 0.04::double else 0 end),
  case when ent >= 0.45 and (key >= 0.18 or emb >= 0.40) then 0.72::double else 0 end, case when ent >= 0.33 and key >= 0.28 then 0.70::double else 0 end, case when sh >= 2 and key >= 0.22 and tim >= 0.4 then 0.68::double else 0 end), 4) as total from parts"""
)
def similarity_breakdown(spark, d):
    """All parts and the total of the composite similarity of near-duplicate stories."""
    items = P.stories(posts(spark, d))
    return P.composite(items)


@query(
    rf"""select id, list_slice(list_distinct_ordered, 1, 12) as entities from (select id, list_reduce(list_concat([[]::varchar[]], list_transform(e, lambda v: [v])), lambda s, v: case when list_contains(s, v[1]) then s else list_concat(s, v) end) as list_distinct_ordered from (select id, list_concat(
 list_transform(regexp_extract_all(text, '[«"“]([^»"”]{{2,80}})[»"”]', 1), lambda v: trim(v)), list_filter(list_transform(regexp_extract_all(text, '(?:^|[^{E.WORD}])([A-ZА-ЯЁ][{E.WORD}\-]*(?:\s+[A-ZА-ЯЁ][{E.WORD}\-]*){{0,3}})', 1), lambda v: trim(v)), lambda v: length(v) >= 3)) as e
 from {POSTS_SQL} p) x) y"""
)
def light_entities(spark, d):
    """Quoted spans and capitalised runs of whole posts."""
    return posts(spark, d).select("id", F.expr(E.light_entities("text")).alias("entities"))


_ANALYSIS = f"select id, not ad and t <> '' as is_news, ad as is_advertisement, case when ad or t = '' then '' else {D.title_of('t')} end as title, case when ad or t = '' then 'other' else {D.theme('b')} end as theme, case when t = '' then 'empty' when ad then 'advertisement' else '' end as reason from (select id, {D.stripped('text')} as t, {D.matches('text', V.AD_MARKERS)} as ad, {D.without_footers('text')} as b from {POSTS_SQL} p) x"


@query(f"select * from ({_ANALYSIS}) y")
def post_analysis(spark, d):
    """The rule-based analysis of a post as one projection."""
    p = posts(spark, d).select("id", F.expr(E.stripped("text")).alias("t"), F.expr(E.has_ad_markers("text")).alias("ad"), F.expr(E.theme("text")).alias("theme"), F.expr(E.title_of("text")).alias("title"))
    off = F.col("ad") | (F.col("t") == "")
    return p.select(
        "id", (~off).alias("is_news"), F.col("ad").alias("is_advertisement"), F.when(off, "").otherwise(F.col("title")).alias("title"), F.when(off, "other").otherwise(F.col("theme")).alias("theme"),
        F.when(F.col("t") == "", "empty").when(F.col("ad"), "advertisement").otherwise("").alias("reason"),
    )


_SAID = "case (conv_id + turn) % 5 when 1 then 'prose' when 2 then 'none' when 3 then 'empty' else 'json' end"
_CAT = ["CryptoXYZ", "ИИ", "work", "Software", "", "Politics & Society"]


@query(
    f"""select id, case when how in ('none', 'empty') or trim(coalesce(text, '')) = '' then 'Без заголовка' else substr(trim(text, ' '), 1, 512) end as title, case when how in ('none', 'empty') then 0.0::double else round(least(10.0::double, greatest(0.0::double, score)), 2) end as score,
 case when how in ('none', 'empty') then 'other' else {_NORMAL} end as category, how in ('json', 'prose') and turn % 2 = 0 as is_news from (select conv_id * 1000 + turn as id, turn, text, {_SAID} as how, (conv_id * 7 + turn) % 1300 / 100.0::double - 1 as score, ['{"', '".join(_CAT)}'][(conv_id + turn) % {len(_CAT)} + 1] as s from conversations) x"""
)
def analysis_from_json(spark, d):
    """records out of model answers (JSON, JSON within prose, prose alone, nothing), clamped and normalised; the answers are made of conversations."""
    cat = f"element_at(array({E.word_list(_CAT)}), cast((conv_id + turn) % {len(_CAT)} + 1 as int))"
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr(_SAID).alias("how"), F.expr("(conv_id * 7 + turn) % 1300 / 100D - 1").alias("score"), F.expr(cat).alias("cat"))
    j = F.to_json(F.struct(F.col("text").alias("title"), F.col("score").alias("importance_score"), F.col("cat").alias("category"), (F.col("turn") % 2 == 0).alias("is_news")))
    raw = F.when(F.col("how") == "prose", F.concat(F.lit("Sure! "), j, F.lit(" done"))).when(F.col("how") == "none", "no json").when(F.col("how") == "empty", "").otherwise(j)
    j = c.select(F.expr("conv_id * 1000 + turn").alias("id"), raw.alias("raw"))
    j = j.select("id", F.from_json(F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)\{.*\}", 0), F.lit("")), F.lit("{}")), "title string, importance_score double, category string, is_news boolean").alias("j"))
    title = F.coalesce(F.nullif(F.trim("j.title"), F.lit("")), F.lit("Без заголовка"))
    return j.select("id", F.substring(title, 1, 512).alias("title"), F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("j.importance_score", F.lit(0.0)))), 2).alias("score"), F.expr(E.normal_theme("j.category")).alias("category"), F.coalesce("j.is_news", F.lit(False)).alias("is_news"))


_BRAND_OF = "case w " + " ".join(f"when {D.q(k)} then {D.q(v)}" for k, v in V.BRANDS.items()) + r" else case when length(w) <= 2 and regexp_matches(w, '^[^0-9]+$') then upper(w) else concat(upper(left(w, 1)), substr(w, 2)) end end"


@query(
    rf"""select id, case when l > 0 and u >= 0.65::double * l then array_to_string(list_transform(string_split(lower(t), ' '), lambda w: {_BRAND_OF}), ' ') else t end as title from (select id, t, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as l, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as u from
 (select id, trim(case when id % 3 = 0 then upper({D.title_of('t')}) else {D.title_of('t')} end, ' ') as t from (select id, {D.stripped('text')} as t from {POSTS_SQL} p where lang = 'en') x) y) z"""
)
def title_case(spark, d):
    """titles of English posts, every third in capitals: mostly capitals are rewritten, brands and short words as they are known."""
    t = posts(spark, d).where("lang = 'en'").select("id", F.expr(E.title_of("text")).alias("t"))
    return t.select("id", F.expr(E.title_case(f"if(id % 3 = 0, {E.capitals('t')}, t)")).alias("title"))


_STG = ", ".join(f"({i}, {D.q(n)}, {sum(w for _, w in V.STAGES[:i])}, {w})" for i, (n, w) in enumerate(V.STAGES[:-1]))


@query(f"select o_orderkey as job_id, case when o_orderkey % 9 = 8 then 100 else greatest(0, least(99, floor(base + weight * (o_orderkey % 101) / 100.0::double)))::int end as percent from orders left join (values {_STG}) s(i, name, base, weight) on i = o_orderkey % 9")
def stage_progress(spark, d):
    """Stage-weighted progress of jobs."""
    stage = f"element_at(array({E.word_list([n for n, _ in V.STAGES])}), cast(o_orderkey % 9 + 1 as int))"
    o = table(spark, d, "orders").select("o_orderkey", F.expr(stage).alias("stage"))
    return o.select(F.col("o_orderkey").alias("job_id"), F.expr(E.stage_percent("stage", "o_orderkey % 101", "100")).cast("int").alias("percent"))


@query("select c_custkey as user_id, " + ", ".join(f"case when (c_custkey + {i}) % 3 <> 0 then greatest(1, least(5, (c_custkey * {i + 1}) % 9 - 1)) else 3 end::int as {t}" for i, t in enumerate(V.THEMES)) + " from customer")
def theme_weights_clean(spark, d):
    """M7: every theme's weight from 1 to 5; absent ones are 3, unknown ones go."""
    pairs = ", ".join(f"struct('{t}', if((c_custkey + {i}) % 3 <> 0, cast((c_custkey * {i + 1}) % 9 - 1 as int), null))" for i, t in enumerate(V.THEMES))
    w = f"map_from_entries(filter(array({pairs}, struct('unknown', 9)), e -> e.col2 is not null))"
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(E.clean_weights(w)).alias("w"))
    return c.select("user_id", *(F.col(f"w.{k}").alias(k) for k in V.THEMES))


_OLD_LIST = "list_filter([" + ", ".join(f"case when c_custkey % {k} = 0 then {D.q(t)} end" for k, t in ((2, "AI"), (3, "Software"), (4, "GAMING"), (5, "Наука"), (2, "work"), (7, "Politics & Society"), (3, "business"), (6, "technology"), (6, "tools"), (5, "Nonsense"), (1, "software"))) + "], lambda x: x is not null)"


@query(
    f"""select user_id, array_to_string(case when len(raw) = 0 then all_ when len(known) >= 8 then list_concat(known, list_filter(all_, lambda t: not list_contains(known, t))) else known end, ',') as themes from
 (select user_id, raw, [{D.words_in(V.THEMES)}] as all_, list_filter(named, lambda x, i: list_position(named, x) = i) as known from (select user_id, raw, list_transform(raw, lambda o: (list_transform([trim(o)], lambda s: {_NORMAL}))[1]) as named from (select c_custkey as user_id, case when c_custkey % 11 = 0 then [] else {_OLD_LIST} end as raw from customer) x) y) z"""
)
def enabled_themes(spark, d):
    """M8: old lists of enabled themes as the known ones in order; none, or eight and more, means all."""
    raw = ", ".join(f"if(c_custkey % {k} = 0, {E.quoted(t)}, null)" for k, t in ((2, "AI"), (3, "Software"), (4, "GAMING"), (5, "Наука"), (2, "work"), (7, "Politics & Society"), (3, "business"), (6, "technology"), (6, "tools"), (5, "Nonsense"), (1, "software")))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(f"if(c_custkey % 11 = 0, cast(array() as array<string>), array_compact(array({raw})))").alias("raw"))
    return c.select("user_id", F.array_join(F.expr(E.enabled_themes("raw")), ",").alias("themes"))


@query(f"select channel, count(*) as n, min(id) as first_id from (select channel, id, row_number() over (partition by channel order by id desc) as k from {POSTS_SQL} p where minute >= 100) x where k <= 800 group by 1")
def backfill_scan(spark, d):
    """The newest posts of each channel after a cutoff, up to the limit of seven days."""
    w = Window.partitionBy("channel").orderBy(F.desc("id"))
    p = posts(spark, d).where("minute >= 100").withColumn("k", F.row_number().over(w)).where(F.col("k") <= V.BACKFILL_LIMITS[7])
    return p.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"select event_id, round(importance, 6) as importance from {NEWS_SQL} n where status = 'active' and importance >= 2 and channel_id in (3, 5, 8) and event_id not in (select l_orderkey from lineitem group by 1 having bool_and(l_returnflag = 'R'))")
def active_event_index(spark, d):
    """Active events of some channels that are not advertisements alone."""
    ads = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.bool_and(F.col("l_returnflag") == "R").alias("only")).where("only")
    n = news(spark, d).where("status = 'active' and importance >= 2 and channel_id in (3, 5, 8)").join(ads, "event_id", "left_anti")
    return n.select("event_id", F.round("importance", 6).alias("importance"))


@query("select c_custkey as user_id, c_custkey % 11 = 0 or c_nationkey <> 3 or c_acctbal > 5000 as allowed from customer")
def access_allowed(spark, d):
    """Administrators, users of an open service, or those on the list."""
    listed = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey").withColumn("listed", F.lit(True))
    c = table(spark, d, "customer").join(listed, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("user_id"), ((F.col("c_custkey") % 11 == 0) | (F.col("c_nationkey") != 3) | F.coalesce("listed", F.lit(False))).alias("allowed"))


@query(f"select event_id, coalesce(epoch(min(a.ts))::bigint, epoch(n.created_at)::bigint) // 86400 as day from {NEWS_SQL} n left join {ACTIONS_SQL} a on a.news_id = n.event_id group by event_id, created_at")
def published_at_backfill(spark, d):
    """The day of an event's first action, else of its creation."""
    first = actions(spark, d).groupBy(F.col("news_id").alias("event_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("first"))
    return news(spark, d).join(first, "event_id", "left").select("event_id", F.floor(F.unix_timestamp(F.coalesce("first", F.col("created_at").cast("timestamp"))) / 86400).alias("day"))


@query(f"select user_id, count(*) as n from (select distinct user_id from events) u join {NEWS_SQL} n on n.status = 'active' and n.importance >= 7 and n.channel_id <> user_id % 97 group by 1")
def external_count(spark, d):
    """Important events outside a user's own channel."""
    n = news(spark, d).where("status = 'active' and importance >= 7")
    by = n.groupBy("channel_id").agg(F.count(F.lit(1)).alias("own"))
    total = n.agg(F.count(F.lit(1)).alias("total"))  # one row
    u = table(spark, d, "events").select("user_id").distinct().withColumn("channel_id", F.col("user_id") % 97)
    out = u.join(by, "channel_id", "left").join(F.broadcast(total)).select("user_id", (F.col("total") - F.coalesce("own", F.lit(0))).alias("n"))
    return out.where("n > 0")


@query(f"select user_id, bool_or(not is_read) as has_unread from (select user_id, news_id, bool_or(action = 'read') as is_read from {ACTIONS_SQL} a group by 1, 2) s group by 1")
def digest_unread(spark, d):
    s = actions(spark, d).groupBy("user_id", "news_id").agg(F.bool_or(F.col("action") == "read").alias("is_read"))
    return s.groupBy("user_id").agg(F.bool_or(~F.col("is_read")).alias("has_unread"))


@query("select conv_id, count(*) as turns, max_by(text, length(text) * 1000000 - turn) as longest from conversations group by 1".replace("max_by(text, length(text) * 1000000 - turn)", "length(arg_max(text, length(text) * 1000000 - turn))"))
def longest_text(spark, d):
    """The longest text of each conversation (its first, of equals), by length."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("text", F.length("text") * F.lit(1_000_000).cast("long") - F.col("turn")).alias("t"))
    return c.select("conv_id", "turns", F.length("t").cast("long").alias("longest"))


_TOK = f"list_filter(regexp_extract_all(lower(coalesce(q, '')), '[{E.WORD}\\-]{{2,}}'), lambda t: t not in ({D.words_in(V.SEARCH_STOP)}) and not regexp_matches(t, '^\\p{{Nd}}+$'))"
_PAIRS = f"(select x.id as question, y.id as post, x.text as q, coalesce(y.text, '') as e, (y.id % 10) / 10.0::double as sim from {POSTS_SQL} x join {POSTS_SQL} y on y.id > x.id and y.id <= x.id + 5 where x.id % 100 = 0)"


@query(
    f"""select question, post, len(list_filter(t, lambda w: length(w) >= 5 and contains(lower(concat(q, ' said')), w) and not contains(lower(e), w))) = 0 as faithful,
 len(m) = 0 or sim >= 0.45 or len(list_filter(m, lambda w: contains(lower(e), w))) >= case when len(m) <= 2 then 1 else greatest(1, len(m) // 2) end as relevant from (select *, list_filter(list_distinct({_TOK}), lambda w: length(w) >= 3) as m, {_TOK} as t from {_PAIRS} p) x"""
)
def answer_gates(spark, d):
    """Whether an answer that repeats a question is covered by each of the next five posts, and whether those fit the question."""
    p = posts(spark, d).select("id", "text")
    q = p.where("id % 100 = 0").select(F.col("id").alias("question"), F.col("text").alias("q")).withColumn("post", F.explode(F.sequence(F.col("question") + 1, F.col("question") + 5)))
    r = q.join(p.select(F.col("id").alias("post"), F.coalesce("text", F.lit("")).alias("e")), "post").withColumn("sim", F.expr("(post % 10) / 10D"))
    return r.select("question", "post", F.expr(E.faithful("q", "concat(q, ' said')", "lower(e)")).alias("faithful"), F.expr(E.relevant("q", "e", "sim")).alias("relevant"))


@query(f"select event_id, c.n as sources from (select event_id, n from (select event_id, count(*) as n from {LINKS_SQL} l group by 1) x where n >= 3) c join {NEWS_SQL} n using (event_id) where status = 'merged'")
def merged_with_sources(spark, d):
    c = links(spark, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("sources")).where("sources >= 3")
    return news(spark, d).where("status = 'merged'").select("event_id").join(c, "event_id")


@query()
def feed_collapse(spark, d):
    """Each channel's page of its 20 longest stories without near-duplicates; tested against a plain loop."""
    from ..operators.readers import collapsed

    items = P.stories(posts(spark, d))
    page = items.join(posts(spark, d).select(F.col("id").alias("rep"), "channel"), "rep").withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc(F.length("blob")), "rep")))
    page = cut(page.where("place <= 20"))  # only stories of the pages are compared
    return collapsed(page.select(F.col("channel").alias("list_id"), F.col("place").cast("long").alias("place"), F.col("rep").alias("id"), F.col("n_posts").alias("sources")), P.near_duplicates(page.select("rep", "blob", "tokens")))


@query()
def trends_distinct(spark, d):
    """The ten first of the 200 strongest trends that do not share their nodes; tested against a plain loop."""
    from ..operators.readers import distinct_trends
    from .reader_queries import trends_top

    t = trends_top(spark, d)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_nodes"), F.desc("importance"), "event_id")  # 200 rows
    return distinct_trends(t.withColumn("place", F.row_number().over(w).cast("long")).select("event_id", "place"), links(spark, d), 10)
