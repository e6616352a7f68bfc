"""Scans, pages, user and channel upkeep, quiet hours of weekdays and weekends, and vector searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions.vectors import nearest
from ..operators import upkeep as U
from ..operators.readers import feed_page, feed_window, user_states
from ..sources.tables import ACTIONS_SQL, NEWS_SQL, POSTS_SQL, actions, news, posts, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_COS = """select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s from embeddings e join embeddings q on q.vec_id % 100 = 0"""


@query(f"select query_id, vec_id, round(s, 6) as similarity from (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as k from ({_COS}) x) y where k <= 10")
def vector_topk_cosine(spark, d):
    """The ten nearest vectors of every query (ids divisible by 100) among all rows."""
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), k=10).select("query_id", "vec_id", F.round("s", 6).alias("similarity"))


@query(f"select query_id, vec_id, round(s, 6) as similarity from ({_COS}) x where s >= 0.2")
def vector_topk_minsim(spark, d):
    """T4: all vectors of a similarity of 0.2 or more to each query."""
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), floor=0.2).select("query_id", "vec_id", F.round("s", 6).alias("similarity"))


@query(f"select id, channel from {POSTS_SQL} p where id not in (select doc_id from labels) order by minute, id limit 100")
def raw_posts(spark, d):
    """The oldest posts without a status, at most 100 (the feature's page)."""
    done = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return posts(spark, d).join(done, "id", "left_anti").orderBy("minute", "id").limit(100).select("id", "channel")


@query(f"select event_id, status, round(importance, 6) as importance from {NEWS_SQL} n where event_id = 7")
def event_by_id(spark, d):
    """One event by its key; the filter is pushed to the scan."""
    return news(spark, d).where("event_id = 7").select("event_id", "status", F.round("importance", 6).alias("importance"))


@query(f"select event_id, created_at::date::varchar as day from {NEWS_SQL} n where status = 'active' and importance >= 1 and created_at >= timestamp '1996-01-01' order by created_at desc, event_id limit 50")
def active_events_since(spark, d):
    """Active events of an importance and age, the newest 50."""
    n = news(spark, d).where("status = 'active' and importance >= 1 and created_at >= timestamp'1996-01-01'")
    return n.orderBy(F.desc("created_at"), "event_id").limit(50).select("event_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("select c_custkey as user_id from customer where lower(c_mktsegment) = lower('Building')")
def users_by_name(spark, d):
    """Equality without case."""
    return table(spark, d, "customer").where(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select(F.col("c_custkey").alias("user_id"))


_SOURCES = "(select o_orderkey as event_id, case when o_orderkey % 3 = 0 then null else o_custkey end as message_id, case o_orderkey % 5 when 0 then 'automobile' when 1 then 'Building' when 2 then 'FURNITURE' when 3 then 'machinery' else 'Household' end as username from orders)"


@query(
    f"""select event_id, c_mktsegment as channel from {_SOURCES} s join customer on c_custkey = message_id
 union all select event_id, c.name as channel from {_SOURCES} s join (select distinct c_mktsegment as name from customer) c on lower(c.name) = lower(username) where message_id is null"""
)
def event_channels(spark, d):
    """The channel of an event's message, or of its user name (without case) where it has no message. Two equi-joins."""
    s = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.expr("case when o_orderkey % 3 = 0 then null else o_custkey end").alias("message_id"),
        F.expr("case o_orderkey % 5 when 0 then 'automobile' when 1 then 'Building' when 2 then 'FURNITURE' when 3 then 'machinery' else 'Household' end").alias("username"),
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("message_id"), F.col("c_mktsegment").alias("channel"))
    by_id = s.join(c, "message_id").select("event_id", "channel")
    by_name = s.where("message_id is null").join(c.select("channel").distinct(), F.lower("channel") == F.lower("username")).select("event_id", "channel")
    return by_id.unionAll(by_name)


@query("select c_custkey as user_id, n_name as place, r_name as area from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_acctbal > 0")
def member_listing(spark, d):
    """Members with their place and area."""
    c = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("place"), F.col("r_name").alias("area"))


_STATES = f"(select user_id, news_id, count(*) filter (action = 'read') > 0 as is_read, count(*) filter (action = 'like') > 0 as liked, count(*) filter (action = 'favorite') % 2 = 1 as favorite from {ACTIONS_SQL} a group by 1, 2)"


@query(f"select user_id, count(*) filter (is_read) as n_read, count(*) filter (favorite) as n_saved, count(*) filter (liked) as n_liked from {_STATES} s group by 1")
def user_counts(spark, d):
    """Events that each user read, saved and liked."""
    s = user_states(actions(spark, d))
    return s.groupBy("user_id").agg(F.count_if("is_read").alias("n_read"), F.count_if("favorite").alias("n_saved"), F.count_if("liked").alias("n_liked"))


@query(
    f"""select user_id, count(*) as n_actions, count(*) filter (action = 'read') as n_reads, string_agg(action, ' ' order by k) filter (k <= 12) as latest
 from (select *, row_number() over (partition by user_id order by ts desc, action_id desc) as k from {ACTIONS_SQL} a) x group by 1"""
)
def user_cards(spark, d):
    """Totals of each user and the last twelve actions."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("action_id"))
    a = actions(spark, d).withColumn("k", F.row_number().over(w))
    last = F.sort_array(F.collect_list(F.when(F.col("k") <= 12, F.struct("k", "action"))))
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_actions"), F.count_if(F.col("action") == "read").alias("n_reads"), F.array_join(F.transform(last, lambda x: x["action"]), " ").alias("latest"))


@query("select count(*) filter (o_orderstatus = 'O') as waiting, count(*) filter (o_orderstatus = 'P') as running, count(*) filter (o_orderstatus = 'F') as done from orders")
def queue_depth(spark, d):
    """Jobs by status in one pass."""
    n = lambda s, a: F.count_if(F.col("o_orderstatus") == s).alias(a)
    return table(spark, d, "orders").agg(n("O", "waiting"), n("P", "running"), n("F", "done"))


@query(f"select event_id, round(importance, 6) as importance from {NEWS_SQL} n where created_at >= (select max(created_at) - interval 24 hours from {NEWS_SQL} m) order by n.importance desc, event_id limit 20")
def daily_top(spark, d):
    """The most important events of the last 24 hours of the table; the time is one row."""
    n = news(spark, d)
    since = n.agg((F.max("created_at") - F.expr("interval 24 hours")).alias("since"))
    return n.join(F.broadcast(since), F.col("created_at") >= F.col("since")).orderBy(F.desc("importance"), "event_id").limit(20).select("event_id", F.round("importance", 6).alias("importance"))


@query(f"select count(*) filter (k <= 30) as shown, 20 + count(*) filter (k <= 30) + count(*) filter (k = 31) as total from (select row_number() over () as k2, k from (select row_number() over (order by importance desc, event_id) as k from {NEWS_SQL} n where status = 'active' order by 1 limit 31) x where k > 20) y")
def page_with_more(spark, d):
    """A page of ten after twenty, read with one row more, which says whether there is another page."""
    page = news(spark, d).where("status = 'active'").orderBy(F.desc("importance"), "event_id").offset(20).limit(11).select("event_id")
    n = page.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(10)).cast("long").alias("shown"), (20 + F.col("n")).cast("long").alias("total"))


@query(f"select event_id, n_sources from (select n.event_id, n_sources, created_at, importance from {NEWS_SQL} n join (select l_orderkey as event_id, count(*) as n_sources from lineitem group by 1) s on s.event_id = n.event_id) x order by n_sources desc, created_at desc, importance desc, event_id limit 6")
def answer_context(spark, d):
    """The six events that an answer is built on."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count(F.lit(1)).alias("n_sources"))
    return news(spark, d).join(s, "event_id").orderBy(F.desc("n_sources"), F.desc("created_at"), F.desc("importance"), "event_id").limit(6).select("event_id", "n_sources")


@query("select o_orderkey as job_id from orders where o_orderstatus = 'O' order by o_orderpriority, o_orderkey limit 1")
def next_job(spark, d):
    """The waiting job of the lowest priority number and id."""
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderkey").limit(1).select(F.col("o_orderkey").alias("job_id"))


_SPELLED = "case when l_linenumber % 2 = 0 then upper(p_brand) else lower(p_brand) end"


@query(
    f"""select story, string_agg(name, '|' order by k) as entities from (select story, name, row_number() over (partition by story order by o, l) as k from
 (select o_custkey as story, lower(p_brand) as low, arg_min({_SPELLED}, l_orderkey * 100 + l_linenumber) as name, min(l_orderkey * 100 + l_linenumber) as o, min(lower(p_brand)) as l
 from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1, 2) x) y where k <= 40 group by 1"""
)
def merged_entities(spark, d):
    """Ordered union of entities without case, the first spelling of each, at most 40 (the feature's cap)."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    items = li.select(F.col("o_custkey").alias("story"), F.expr(_SPELLED).alias("name"), F.expr("l_orderkey * 100 + l_linenumber").alias("o"))
    return U.ordered_union(items, "story", "name", "o", 40).select("story", F.array_join("names", "|").alias("entities"))


@query("select item_id, len(k) as n, array_to_string(k, '|') as keys from (select item_id, list_filter(l, lambda x, i: list_position(l, x) = i) as k from (select item_id, list_filter(list_transform(string_split_regex(text, '[,\\n]'), lambda x: trim(x)), lambda x: x <> '') as l from benchmark) a) b")
def key_lists(spark, d):
    """parts at commas and line ends, trimmed, the first of each."""
    keys = F.expr("array_distinct(filter(transform(split(text, '[,\\n]'), x -> trim(x)), x -> x <> ''))")
    return table(spark, d, "benchmark").select("item_id", F.size(keys).cast("long").alias("n"), F.array_join(keys, "|").alias("keys"))


@query(f"select event_id, to_json(list_value(struct_pack(at := strftime(created_at, '%Y-%m-%d'), kind := 'created', sources := 1)))::varchar as timeline from {NEWS_SQL} n")
def first_timelines(spark, d):
    """M9: the timeline that an event starts with, as JSON."""
    entry = F.struct(F.date_format("created_at", "yyyy-MM-dd").alias("at"), F.lit("created").alias("kind"), F.lit(1).alias("sources"))
    return news(spark, d).select("event_id", F.to_json(F.array(entry)).alias("timeline"))


@query("select doc_id as id, case lang when 'de' then concat('Quelle: ', source) when 'fr' then concat('Source : ', source) else source end as label from documents")
def localised_labels(spark, d):
    """the text of a language, or the base text."""
    own = F.create_map(F.lit("de"), F.concat(F.lit("Quelle: "), "source"), F.lit("fr"), F.concat(F.lit("Source : "), "source"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.try_element_at(own, F.col("lang")), "source").alias("label"))


_ZONE = "case when c_custkey % 9 = 0 then 'No/Where' when c_custkey % 3 = 0 then 'Asia/Tokyo' when c_custkey % 3 = 1 then 'America/New_York' else 'Europe/Moscow' end"
_NOW = "timestamp '2024-01-05 00:00:00' + {hours}"
_HOURS = {"s": "c_custkey % 24 * 60", "e": "(c_custkey % 24 * 60 + 600) % 1440", "ws": "c_custkey % 12 * 60 + 720", "we": "case when c_custkey % 11 = 0 then c_custkey % 12 * 60 + 720 else c_custkey % 7 * 60 end"}
_WINDOWS = ", ".join(f"{x} as {n}" for n, x in _HOURS.items())


@query(
    f"""select user_id, strftime(loc, '%Y-%m-%d %H:%M') as local_time, on_ as quiet, case when on_ then strftime(date_trunc('day', loc) + to_minutes((b + case when a > b and m >= a then 1440 else 0 end)::bigint) - to_hours(z), '%Y-%m-%d %H:%M') end as ends_utc
 from (select *, case when a = b then false when a < b then m >= a and m < b else m >= a or m < b end as on_ from (select *, case when isodow(loc) >= 6 then ws else s end as a, case when isodow(loc) >= 6 then we else e end as b, hour(loc) * 60 + minute(loc) as m
 from (select *, {_NOW.format(hours="to_hours((user_id % 96)::bigint)")} + to_hours(z) as loc from (select c_custkey as user_id, {_WINDOWS}, case when c_custkey % 9 = 0 then 3 when c_custkey % 3 = 0 then 9 when c_custkey % 3 = 1 then -5 else 3 end as z from customer) u) v) w) x"""
)
def quiet_hours(spark, d):
    """Local time (an unknown zone counts as Moscow), quiet hours of weekdays and weekends that may pass midnight, and
    when they end in UTC."""
    known = ", ".join(f"'{z}'" for z in ("Asia/Tokyo", "America/New_York", "Europe/Moscow"))
    u = table(spark, d, "customer").selectExpr("c_custkey as user_id", *(f"{x} as {n}" for n, x in _HOURS.items()), f"{_ZONE} as named")
    u = u.withColumn("zone", F.expr(f"case when named in ({known}) then named else 'Europe/Moscow' end"))
    u = u.withColumn("now", F.expr("timestamp'2024-01-05 00:00:00' + make_interval(0, 0, 0, 0, cast(user_id % 96 as int))")).withColumn("loc", F.expr("from_utc_timestamp(now, zone)"))
    u = u.withColumn("a", F.expr(f"if({T.weekend('loc')}, ws, s)")).withColumn("b", F.expr(f"if({T.weekend('loc')}, we, e)"))
    end = F.expr(f"to_utc_timestamp({T.quiet_end('loc', 'a', 'b')}, zone)")
    return u.withColumn("quiet", F.expr(T.quiet("loc", "a", "b"))).select("user_id", F.date_format("loc", "yyyy-MM-dd HH:mm").alias("local_time"), "quiet", F.when(F.col("quiet"), F.date_format(end, "yyyy-MM-dd HH:mm")).alias("ends_utc"))


@query(f"select action, count(*) as n from {ACTIONS_SQL} a where not (user_id % 20 = 0 or (user_id % 10 = 0 and action in ('read', 'shown'))) group by 1")
def users_reset(spark, d):
    """What is left of the actions after a full reset of some users and a soft one of others, who keep likes and favourites."""
    full, soft = F.col("user_id") % 20 == 0, F.col("user_id") % 10 == 0
    return actions(spark, d).where(~(full | (soft & F.col("action").isin("read", "shown")))).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"select user_id, count(*) filter (not is_read and not favorite) as hidden, count(*) filter (is_read or favorite) as visible from {_STATES} s group by 1")
def unread_hidden(spark, d):
    """Every user's unread events are hidden, but for favourites."""
    s = user_states(actions(spark, d)).withColumn("hidden", ~F.col("is_read") & ~F.col("favorite"))
    return s.groupBy("user_id").agg(F.count_if("hidden").alias("hidden"), F.count_if(~F.col("hidden")).alias("visible"))


@query(
    """with c as (select c_custkey from customer where c_custkey % 50 <> 0), o as (select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 50 = 0)),
 l as (select 1 from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 50 = 0)))
 select 'channels' as kind, count(*) as n from c union all select 'events', count(*) from o union all select 'sources', count(*) from l"""
)
def channels_deleted(spark, d):
    """Rows left when channels go, and with them their events and those events' sources."""
    gone = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders")
    lost = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = {"channels": table(spark, d, "customer").where("c_custkey % 50 <> 0"), "events": orders.join(gone, "o_custkey", "left_anti"), "sources": table(spark, d, "lineitem").join(lost, "l_orderkey", "left_anti")}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in left.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query(f"select user_id, arg_max(action, row(ts, action_id)) as setting, count(*) filter (action = 'like') % 2 = 1 as enabled from {ACTIONS_SQL} a group by 1")
def settings_upsert(spark, d):
    """The last writer's setting of each user, and a switch that each like turns."""
    return actions(spark, d).groupBy("user_id").agg(F.max_by("action", F.struct("ts", "action_id")).alias("setting"), (F.count_if(F.col("action") == "like") % 2 == 1).alias("enabled"))


_AGED = f"(select p.id, p.minute, case when l.doc_id is null then 'raw' when l.quality = 1 then 'processed' else 'filtered' end as status from {POSTS_SQL} p left join labels l on l.doc_id = p.id)"


@query(f"select status, count(*) as n from {_AGED} p where status = 'raw' or minute >= 100 group by 1")
def retention_posts(spark, d):
    """Posts that stay: those of no status yet, and of the others the younger ones."""
    kind = F.expr("case when doc_id is null then 'raw' when quality = 1 then 'processed' else 'filtered' end")
    p = posts(spark, d).select("id", "minute").join(table(spark, d, "labels"), F.col("doc_id") == F.col("id"), "left").withColumn("status", kind)
    return p.where("status = 'raw' or minute >= 100").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"select l_orderkey as event_id, count(*) as n, count(*) filter (gone) as unlinked from (select l_orderkey, l_partkey in (select p.id from {_AGED} p where status <> 'raw' and minute < 100) as gone from lineitem) x group by 1 having count(*) filter (gone) > 0")
def retention_links(spark, d):
    """Sources whose post is deleted stay, without their link."""
    kind = F.expr("case when doc_id is null then 'raw' when quality = 1 then 'processed' else 'filtered' end")
    p = posts(spark, d).select("id", "minute").join(table(spark, d, "labels"), F.col("doc_id") == F.col("id"), "left").withColumn("status", kind)
    gone = p.where("status <> 'raw' and minute < 100").select(F.col("id").alias("l_partkey")).distinct().withColumn("gone", F.lit(True))
    s = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(gone, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("event_id"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("unlinked")).where("unlinked > 0")


@query(f"select query_id, case when s >= 0.3 then vec_id end as joins, s < 0.3 as is_new from (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as k from ({_COS}) x where vec_id <> query_id) y where k = 1")
def cosine_assign(spark, d):
    """The nearest other vector of each query from a similarity on, or none."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "vec_id")
    best = nearest(e, e.where("vec_id % 100 = 0"), k=2).where("vec_id <> query_id").withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.select("query_id", F.expr("case when s >= 0.3 then vec_id end").alias("joins"), (F.col("s") < 0.3).alias("is_new"))


@query(
    """with b as (select o_custkey as story, o_orderdate::date as d, count(*) as added from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
 r as (select *, sum(added) over (partition by story order by d) as total, row_number() over (partition by story order by d) as k from b),
 e as (select story, k, 0 as p, d, total, case when k = 1 then 'created' else 'sources' end as kind from r union all select story, k, 1, d, total, 'growth' from r where k > 1 and added >= 5)
 select story, string_agg(concat(strftime(d, '%Y-%m-%d'), ' ', kind, ' ', total::bigint::varchar), '|' order by k, p) as timeline from (select *, row_number() over (partition by story order by k desc, p desc) as n from e) x where n <= 40 group by 1"""
)
def story_timelines(spark, d):
    """The last forty timeline entries of each story, as sources are attached day by day."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = li.groupBy(F.col("o_custkey").alias("story"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("added"))
    text = F.transform("timeline", lambda x: F.concat_ws(" ", F.date_format(x["at"], "yyyy-MM-dd"), x["kind"], x["sources"].cast("string")))
    return U.timelines(days, "story", "day", "added").select("story", F.array_join(text, "|").alias("timeline"))


_THEMES = "['tech', 'ai', 'games', 'science']"
#: Events with words and themes (title, topic and summary of the part of their customer's number, where there is one).
_STORIES = f"""(select o_orderkey as event_id, case o_orderstatus when 'O' then 'active' when 'F' then 'archived' else 'merged' end as status, o_totalprice / 65536.0 as importance,
  {_THEMES}[o_orderkey % 5 + 1] as theme, p_name as title, p_brand as summary, p_type as topic, o_orderdate as updated_at from orders left join part on p_partkey = o_custkey)"""
_FEED_SETTINGS = f"""(select c_custkey as user_id, 3 + c_custkey % 5 as page_size, c_custkey % 5 * 0.2::double as min_importance, case when c_custkey % 7 = 0 then ['tech', 'other'] else list_concat({_THEMES}, ['other']) end as themes,
  case when c_custkey % 3 = 0 then null else c_custkey % 5 + 1 end as weight, case c_custkey % 4 when 0 then 'cold, Steel,' when 1 then ' economy ,b_ue' when 2 then '' end as ignored from customer)"""
_FEED_CHANNELS = "(select o_orderkey as event_id, o_custkey % 97 as channel_id from orders union select o_orderkey, o_orderkey % 97 from orders where o_orderkey % 3 = 0)"
_FEED_SUBS = "(select user_id, user_id % 97 as channel_id from events union select user_id, user_id * 31 % 97 from events)"
_FEED_STATES = f"""(select user_id, news_id, bool_or(action in ('read', 'dislike')) as gone, case when bool_or(action = 'like') then 1.5 else 0.0 end::double - 2.0::double * count(*) filter (action = 'dislike') as personal
  from {ACTIONS_SQL} a group by 1, 2)"""


@query(
    f"""with reach as (select distinct user_id, event_id from {_FEED_CHANNELS} c join {_FEED_SUBS} s using (channel_id)),
 c as (select r.user_id, n.event_id, n.importance, coalesce(n.theme, 'other') as th, coalesce(st.personal, 0.0)::double as pers, u.page_size, u.weight, n.updated_at,
   lower(concat_ws(chr(10), n.title, n.summary, n.topic)) as blob, list_filter(list_transform(string_split(coalesce(u.ignored, ''), ','), lambda t: lower(trim(t))), lambda t: t <> '') as words, u.themes, u.min_importance
   from reach r join {_STORIES} n using (event_id) join {_FEED_SETTINGS} u using (user_id) left join {_FEED_STATES} st on st.user_id = r.user_id and st.news_id = r.event_id where n.status = 'active' and not coalesce(st.gone, false)),
 f as (select * from c where importance >= min_importance and list_contains(themes, th) and len(list_filter(words, lambda w: blob like concat('%', w, '%'))) = 0),
 win as (select *, row_number() over (partition by user_id order by round(pers + importance, 9) desc, importance desc, updated_at desc, event_id) as k from f qualify k <= greatest(page_size * 4, 40) + 2),
 ranked as (select user_id, event_id as news_id, page_size, k, round(pers + importance * (0.6::double + 0.4::double * (case when th <> 'ai' then coalesce(weight, 3) else 3 end / 5.0::double)), 6) as score from win),
 placed as (select *, row_number() over (partition by user_id order by score desc, k) as place, count(*) over (partition by user_id) as n from ranked)
 select user_id, news_id, score, place, n > 2 + page_size as has_more from placed where place > 2 and place <= 2 + page_size"""
)
def personal_feed(spark, d):
    """The page behind the first two events of every user's feed, with their own words, themes, weights and page size."""
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("o_custkey"), F.col("p_name").alias("title"), F.col("p_brand").alias("summary"), F.col("p_type").alias("topic"))
    stories = o.join(part, "o_custkey", "left").select(
        F.col("o_orderkey").alias("event_id"), F.expr("case o_orderstatus when 'O' then 'active' when 'F' then 'archived' else 'merged' end").alias("status"), (F.col("o_totalprice") / 65536.0).alias("importance"),
        F.expr("try_element_at(array('tech', 'ai', 'games', 'science'), cast(o_orderkey % 5 + 1 as int))").alias("theme"), "title", "summary", "topic", F.col("o_orderdate").alias("updated_at"),
    )
    settings = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.expr("3 + c_custkey % 5").alias("page_size"), F.expr("c_custkey % 5 * 0.2D").alias("min_importance"),
        F.expr("case when c_custkey % 7 = 0 then array('tech', 'other') else array('tech', 'ai', 'games', 'science', 'other') end").alias("themes"),
        F.expr("case when c_custkey % 3 <> 0 then map_from_arrays(array('tech', 'games', 'science', 'other'), array_repeat(c_custkey % 5 + 1, 4)) end").alias("weights"),
        F.expr("case c_custkey % 4 when 0 then 'cold, Steel,' when 1 then ' economy ,b_ue' when 2 then '' end").alias("ignored"),
    )
    channels = o.select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 97).alias("channel_id")).unionAll(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderkey") % 97))
    users = e.select("user_id").distinct()
    subscriptions = users.select("user_id", (F.col("user_id") % 97).alias("channel_id")).unionAll(users.select("user_id", F.col("user_id") * 31 % 97))
    return feed_page(feed_window(stories, channels, user_states(actions(spark, d)), settings, subscriptions, 2), 2)
