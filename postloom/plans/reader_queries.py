"""Search, feed, trend and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import readers as R
from ..sources.tables import ACTIONS_SQL, LINKS_SQL, NEWS_SQL, POSTS_SQL, actions, links, news, posts, table, tasks
from . import duck as D

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"select id, length(text) as size from {POSTS_SQL} p where text ilike '%google%' or channel ilike '%google%' order by length(text) desc, id limit 20")
def keyword_search(spark, d):
    p = posts(spark, d).where(F.col("text").ilike("%google%") | F.col("channel").ilike("%google%"))
    return p.select("id", F.length("text").cast("long").alias("size")).orderBy(F.desc("size"), "id").limit(20)


_STATES = f"""(select user_id, news_id, bool_or(action = 'read') as is_read, bool_or(action = 'like') as liked, bool_or(action = 'dislike') as disliked, sum(case when action = 'favorite' then 1 else 0 end) % 2 = 1 as favorite,
  sum(case when action = 'shown' then 1 else 0 end)::bigint as shown_count, case when bool_or(action = 'like') then 1.5 else 0.0 end::double - 2.0::double * sum(case when action = 'dislike' then 1 else 0 end) as personal, max(ts) as last_ts from {ACTIONS_SQL} a group by 1, 2)"""


@query(f"select user_id, news_id, is_read, liked, disliked, favorite, shown_count, personal from {_STATES} s")
def user_state_fold(spark, d):
    return R.user_states(actions(spark, d)).drop("last_ts")


@query(f"select user_id, news_id, arg_max(action, action_id) as reaction from {ACTIONS_SQL} a where action in ('like', 'dislike') group by 1, 2")
def reaction_last_value(spark, d):
    return actions(spark, d).where("action in ('like', 'dislike')").groupBy("user_id", "news_id").agg(F.max_by("action", "action_id").alias("reaction"))


_SUBS = "(select distinct user_id, user_id % 97 as channel_id from events union select distinct user_id, user_id * 31 % 97 from events)"


def _subscriptions(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", (F.col("user_id") % 97).alias("channel_id")).unionAll(u.select("user_id", (F.col("user_id") * 31 % 97).alias("channel_id"))).distinct()


_FEED = f"""(select s.user_id, n.event_id as news_id, round(coalesce(st.personal, 0.0) + n.importance * (0.6::double + 0.4::double * theme_no / 5.0::double), 6) as score from {_SUBS} s join {NEWS_SQL} n using (channel_id) left join {_STATES} st on st.user_id = s.user_id and st.news_id = n.event_id
  where n.status = 'active' and n.importance >= 1.0 and not coalesce(st.is_read or st.disliked, false))"""


@query(f"select user_id, count(*) as n from {_FEED} f group by 1")
def feed_candidates(spark, d):
    return R.feed_sizes(news(spark, d), R.user_states(actions(spark, d)), _subscriptions(spark, d), 1.0)


@query(f"select user_id, news_id, score, place from (select *, row_number() over (partition by user_id order by score desc, news_id) as place from {_FEED} f) x where place <= 5")
def feed_ranked_per_user(spark, d):
    return R.feed(news(spark, d), R.user_states(actions(spark, d)), _subscriptions(spark, d), 5, 1.0).select("user_id", "news_id", "score", F.col("place").cast("long").alias("place"))


@query("select p_partkey from part where lower(p_name) not like '%blue%' and lower(p_type) not like '%steel%'")
def ignored_topics_filter(spark, d):
    return table(spark, d, "part").where("lower(p_name) not like '%blue%' and lower(p_type) not like '%steel%'").select("p_partkey")


@query(f"select user_id, news_id from (select user_id, news_id, row_number() over (partition by user_id order by personal desc, news_id desc) as k from {_STATES} s where not is_read and not favorite) x where k > 5")
def unread_prune(spark, d):
    """Unread entries beyond the strongest five of a user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("personal"), F.desc("news_id"))
    s = R.user_states(actions(spark, d)).where("not is_read and not favorite")
    return s.withColumn("k", F.row_number().over(w)).where("k > 5").select("user_id", "news_id")


@query(f"select s.user_id, s.news_id, round(n.importance, 6) as importance from {_STATES} s join {NEWS_SQL} n on n.event_id = s.news_id where favorite")
def favorites_list(spark, d):
    s = R.user_states(actions(spark, d)).where("favorite").select("user_id", "news_id")
    return s.join(news(spark, d).select(F.col("event_id").alias("news_id"), "importance"), "news_id").select("user_id", "news_id", F.round("importance", 6).alias("importance"))


@query(f"select user_id, news_id, k from (select user_id, news_id, row_number() over (partition by user_id order by last_ts desc nulls last, news_id) as k from {_STATES} s where is_read) x where k > 3 and k <= 6")
def history_page(spark, d):
    """The second page of three of each user's history."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("last_ts"), "news_id")
    s = R.user_states(actions(spark, d)).where("is_read").withColumn("k", F.row_number().over(w))
    return s.where("k > 3 and k <= 6").select("user_id", "news_id", F.col("k").cast("long").alias("k"))


_AGE = "date_diff('second', created_at, timestamp '2024-01-31 00:00:00') / 3600.0::double"
_DIST = f"""(select event_id, min(case when p_size > 45 then 0 when p_size > 40 then 1 else 2 end) as distance from {LINKS_SQL} l join part on p_partkey = node_id group by 1)"""
_RANK = f"""(select n.event_id, {D.rank_score("case when distance < 2 then 0.35 else 0.15 end", "distance", "importance * 3", "importance", _AGE, "0.0")} as score from {NEWS_SQL} n join {_DIST} x using (event_id) where status = 'active')"""


def _ranked(spark, d):
    from ..sources.tables import table as t

    near = links(spark, d).join(t(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.expr("case when p_size > 45 then 0 when p_size > 40 then 1 else 2 end").alias("dist")), "node_id").groupBy("event_id").agg(F.min("dist").alias("distance"))
    n = news(spark, d).where("status = 'active'").join(near, "event_id").withColumn("age", F.expr("(unix_timestamp(timestamp'2024-01-31 00:00:00') - unix_timestamp(cast(created_at as timestamp))) / 3600.0D"))
    return n.select("event_id", F.expr(E.rank_score("case when distance < 2 then 0.35D else 0.15D end", "distance", "importance * 3", "importance", "age", "0.0D")).alias("score"))


@query(f"select event_id, round(score, 6) as score from {_RANK} r")
def search_rank_scores(spark, d):
    """Multi-factor scores of active events by their nearest node."""
    return _ranked(spark, d).select("event_id", F.round("score", 6).alias("score"))


@query(f"select user_id, event_id, round(0.70::double * score + 0.30::double * least(1.0::double, greatest(0.0::double, (personal + 2) / 6.0::double)), 6) as score from {_RANK} r join {_STATES} s on s.news_id = r.event_id where 0.70 * score + 0.30 * least(1.0, greatest(0.0, (personal + 2) / 6.0)) >= 0.38")
def search_personalized(spark, d):
    s = R.user_states(actions(spark, d)).select("user_id", F.col("news_id").alias("event_id"), "personal")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("personal") + 2) / 6.0))
    r = _ranked(spark, d).join(s, "event_id").withColumn("total", 0.70 * F.col("score") + 0.30 * p)
    return r.where("total >= 0.38").select("user_id", "event_id", F.round("total", 6).alias("score"))


@query(f"select event_id, n_nodes, round(importance, 6) as importance from {NEWS_SQL} n join (select event_id, count(*) as n_nodes from {LINKS_SQL} l group by 1) c using (event_id) where status = 'active' and importance >= 3 order by n_nodes desc, importance desc, event_id limit 200")
def trends_top(spark, d):
    """The 200 active events of importance 3 and more with most sources."""
    c = links(spark, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    n = news(spark, d).where("status = 'active' and importance >= 3").join(c, "event_id")
    return n.orderBy(F.desc("n_nodes"), F.desc("importance"), "event_id").limit(200).select("event_id", "n_nodes", F.round("importance", 6).alias("importance"))


@query(f"select news_id, sum(case when ts >= timestamp '2024-01-29 00:00:00' then 1 else 0 end)::bigint as growth, floor(epoch(min(ts)))::bigint as first_seen, count(*) as total from {ACTIONS_SQL} a group by 1")
def trend_growth_24h(spark, d):
    a = actions(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return a.groupBy("news_id").agg(F.count_if(F.col("ts") >= F.expr("timestamp'2024-01-29 00:00:00'")).alias("growth"), F.unix_timestamp(F.min("ts")).alias("first_seen"), F.count(F.lit(1)).alias("total"))


@query(
    f"""with st as {_STATES}, nd as (select user_id, node_id, count(*) as n from st join {LINKS_SQL} l on l.event_id = st.news_id where liked or favorite or is_read group by 1, 2),
 best as (select user_id, node_id from nd qualify row_number() over (partition by user_id order by n desc, node_id) <= 12),
 c as (select distinct user_id, l.event_id from best join {LINKS_SQL} l using (node_id)),
 f as (select c.user_id, c.event_id, n.importance from c join {NEWS_SQL} n using (event_id) left join st on st.user_id = c.user_id and st.news_id = c.event_id where n.status = 'active' and not coalesce(st.shown_count > 0 or st.disliked, false))
 select user_id, event_id, round(importance, 6) as importance from f qualify row_number() over (partition by user_id order by importance desc, event_id) <= 5"""
)
def recommend_for_user(spark, d):
    return R.recommended(news(spark, d), links(spark, d), R.user_states(actions(spark, d)), 12, 5, tasks(table(spark, d, "events")))


_LOG = f"(select user_id, news_id, case when action = 'shown' and action_id % 5 = 0 then 'remove' else action end as action, ts, action_id from {ACTIONS_SQL} a)"


@query(
    f"""with l as materialized (select *, row_number() over (order by ts, action_id) as o from {_LOG} x), k as (select *, lag(action) over (partition by user_id, news_id order by o) as before from l where action in ('like', 'dislike')),
 s as (select user_id, news_id, arg_max(action <> 'remove', o) filter (action in ('read', 'like', 'dislike', 'remove')) as is_read, arg_max(action = 'like', o) filter (action in ('like', 'dislike')) as liked, arg_max(action = 'dislike', o) filter (action in ('like', 'dislike')) as hidden,
  count_if(action = 'favorite') % 2 = 1 as favorite, count_if(action = 'shown') as shown, min(o) filter (action in ('read', 'dislike')) as opened, min(o) filter (action = 'shown') as seen, count_if(action = 'dislike') as dislikes from l group by 1, 2),
 p as (select user_id, news_id, count(*) as likes from k where action = 'like' and coalesce(before, '') <> 'like' group by 1, 2)
 select user_id, news_id, coalesce(is_read, false) as is_read, coalesce(liked, false) as liked, coalesce(hidden, false) as hidden, favorite, (shown + case when opened is not null and (seen is null or opened < seen) then 1 else 0 end)::bigint as shown_count,
 1.5::double * coalesce(likes, 0) - 2.0::double * dislikes as personal, not coalesce(is_read, false) and not coalesce(hidden, false) as visible from s left join p using (user_id, news_id)"""
)
def user_states_ordered(spark, d):
    """States in which order counts: hiding, removal from the history, likes taken back."""
    a = actions(spark, d).withColumn("action", F.expr("if(action = 'shown' and action_id % 5 = 0, 'remove', action)"))
    return R.ordered_states(a)


@query(
    f"""with st as {_STATES}, lately as (select user_id, news_id from st where liked or favorite or is_read qualify row_number() over (partition by user_id order by last_ts desc, news_id) <= 40), m as (select node_id, count(*) as m from {LINKS_SQL} l group by 1),
 liked as (select user_id, node_id from (select distinct user_id, node_id from lately join {LINKS_SQL} l on l.event_id = news_id) x join m using (node_id) qualify row_number() over (partition by user_id order by m desc, node_id) <= 12),
 w as materialized (select x.node_id as a, y.node_id as b, least(1.0::double, 0.45::double + 0.04::double * (count(*) - 1)) as weight from {LINKS_SQL} x join {LINKS_SQL} y on x.event_id = y.event_id and x.node_id <> y.node_id group by 1, 2),
 around as (select user_id, b as node_id from (select distinct user_id, w.b from liked join w on w.a = node_id where weight >= 0.3) x where not exists (select 1 from liked z where z.user_id = x.user_id and z.node_id = x.b)),
 near as (select user_id, node_id from liked union all select user_id, node_id from around join m using (node_id) qualify row_number() over (partition by user_id order by m desc, node_id) <= 16),
 c as (select distinct user_id, event_id from (select user_id, node_id from near) x join {LINKS_SQL} l using (node_id)),
 g as (select c.user_id, c.event_id, n.importance from c join {NEWS_SQL} n using (event_id) left join st on st.user_id = c.user_id and st.news_id = c.event_id where n.status = 'active' and not coalesce(st.shown_count > 0 or st.disliked, false)),
 top as (select user_id, event_id, importance, 'graph' as via from g qualify row_number() over (partition by user_id order by importance desc, event_id) <= 5),
 users as (select distinct user_id from {ACTIONS_SQL} a union select max(user_id) + 1 from {ACTIONS_SQL} a), best as (select event_id, importance from {NEWS_SQL} n where status = 'active' order by importance desc, event_id limit 200),
 feed as (select u.user_id, b.event_id, b.importance, 'feed' as via from users u join best b on u.user_id not in (select user_id from top) left join st on st.user_id = u.user_id and st.news_id = b.event_id where not coalesce(st.is_read or st.disliked, false) qualify row_number() over (partition by u.user_id order by importance desc, b.event_id) <= 5)
 select user_id, event_id, round(importance, 6) as importance, via from top union all select user_id, event_id, round(importance, 6), via from feed"""
)
def recommend_expanded(spark, d):
    """Events by the nodes of the last 40 that a user liked, kept or read, and 16 strong neighbours; without any, the most important of the feed."""
    a = actions(spark, d)
    users = a.select("user_id").distinct().unionAll(a.agg((F.max("user_id") + 1).alias("user_id")))
    return R.recommended_wide(news(spark, d), links(spark, d), R.user_states(a), users, tasks=tasks(table(spark, d, "events")))
