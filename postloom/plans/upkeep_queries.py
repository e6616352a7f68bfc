"""Time preferences, statistics, retention, queue, ingestion and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions import dates as T
from ..functions import expressions as E
from ..operators import upkeep as U
from ..sources.tables import ACTIONS_SQL, LINKS_SQL, NEWS_SQL, POSTS_SQL, actions, links, news, posts, table
from ..sources.incremental import ChannelFeed
from ..streaming import live
from . import duck as D
from .graph_queries import _RAW, _slugged

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ZONES = ["Europe/Moscow", "America/New_York", "Asia/Tokyo", "UTC"]


def _users(spark, d):
    """Settings of users, made from customers."""
    zone = "element_at(array('Europe/Moscow', 'America/New_York', 'Asia/Tokyo', 'UTC'), cast(c_custkey % 4 + 1 as int))"
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.expr(zone).alias("zone"), F.expr("concat(cast(c_custkey % 24 as int), ':30')").alias("dnd_start"), F.expr("case when c_custkey % 7 = 0 then 'bad' else concat(cast((c_custkey + 9) % 24 as int), ':00') end").alias("dnd_end"),
        F.expr("cast(c_custkey * 5 % 500 as int)").alias("gap"), F.expr("case when c_custkey % 5 = 0 then null else timestamp'2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, cast(c_custkey % 30 as int)) end").alias("last"),
    ).withColumn("local", F.expr("from_utc_timestamp(timestamp'2024-01-31 00:00:00', zone)"))


_DU = """(select c_custkey as user_id, c_custkey % 24 * 60 + 30 as s, case when c_custkey % 7 = 0 then 480 else (c_custkey + 9) % 24 * 60 end as e, c_custkey * 5 % 500 as gap,
  case when c_custkey % 5 = 0 then null else timestamp '2024-01-31 00:00:00' - to_hours((c_custkey % 30)::bigint) end as last,
  timestamp '2024-01-31 00:00:00' + to_hours(case c_custkey % 4 when 0 then 3 when 1 then -5 when 2 then 9 else 0 end) as loc from customer)"""
_QUIET = "case when s = e then false when s < e then hour(loc) * 60 + minute(loc) >= s and hour(loc) * 60 + minute(loc) < e else hour(loc) * 60 + minute(loc) >= s or hour(loc) * 60 + minute(loc) < e end"
_MODE = "case when gap <= 0 then 'off' when gap <= 60 then '1h' when gap <= 180 then '3h' when gap <= 360 then '6h' else 'daily' end"


def _with_quiet(spark, d):
    u = _users(spark, d).withColumn("s", F.expr(T.minutes("dnd_start", 1380))).withColumn("e", F.expr(T.minutes("dnd_end", 480)))
    return u.withColumn("quiet", F.expr(T.quiet("local", "s", "e"))).withColumn("mode", F.expr(T.digest_mode("gap")))


@query(f"select user_id, {_QUIET} as quiet from {_DU} u")
def dnd_active(spark, d):
    return _with_quiet(spark, d).select("user_id", "quiet")


@query(f"select mode, count(*) as n from (select {_MODE} as mode from {_DU} u) x group by 1")
def digest_mode_bucket(spark, d):
    return _with_quiet(spark, d).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select user_id, case when mode = 'off' or quiet then false when mode = 'daily' then hour(loc) * 60 + minute(loc) >= 540 and (last is null or last::date < loc::date)
 else last is null or date_diff('second', last, timestamp '2024-01-31 00:00:00') / 3600.0 >= case mode when '1h' then 1 when '3h' then 3 else 6 end end as due from (select *, {_QUIET} as quiet, {_MODE} as mode from {_DU} u) x"""
)
def digest_due(spark, d):
    due = T.digest_due("mode", "last", "timestamp'2024-01-31 00:00:00'", "local", "540", "quiet")
    return _with_quiet(spark, d).select("user_id", F.expr(due).alias("due"))


@query(f"select user_id, strftime(case when hour(loc) < 8 then loc - interval 24 hours else date_trunc('day', loc) end, '%Y-%m-%d %H:%M') as start_at from {_DU} u")
def trends_window_start(spark, d):
    return _users(spark, d).select("user_id", F.date_format(F.expr(T.trends_start("local")), "yyyy-MM-dd HH:mm").alias("start_at"))


@query(f"select status, count(*) as n from (select case when n.status = 'active' and n.created_at < timestamp '1996-06-01 00:00:00' and f.news_id is null then 'archived' else n.status end as status from {NEWS_SQL} n left join (select distinct news_id from {ACTIONS_SQL} a where action = 'favorite') f on f.news_id = n.event_id) x group by 1")
def retention_archive(spark, d):
    kept = actions(spark, d).where("action = 'favorite'").select(F.col("news_id").alias("event_id"))
    return U.archived(news(spark, d), kept, "1996-06-01 00:00:00").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey as channel_id from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def orphan_channels(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("channel_id")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("channel_id")), "channel_id", "left_anti")


@query(f"select channel, batch, count(*) as n, min(id) as first_id, max(id) as last_id from (select channel, id, (row_number() over (partition by channel order by id) - 1) // 30 as batch from {POSTS_SQL} p where id not in (select doc_id from labels)) x group by 1, 2")
def queue_batches(spark, d):
    b = U.batches(posts(spark, d).select("channel", "id"), table(spark, d, "labels").select(F.col("doc_id").alias("id")), 30, "channel")
    return b.select("channel", "batch", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query(f"select channel, max(id) as last_id, count(*) as n from {POSTS_SQL} p group by 1")
def high_watermark_per_channel(spark, d):
    return posts(spark, d).groupBy("channel").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query(
    f"""select channel, count(*) as n from (select distinct channel, text from {POSTS_SQL} p) x where not exists (select 1 from {POSTS_SQL} s where s.id % 2 = 0 and s.channel = x.channel and s.text = x.text) group by 1"""
)
def ingest_dedupe(spark, d):
    """New posts of a channel: each arrives twice, those of even ids are stored already, and each new text is stored once."""
    p = posts(spark, d).select("id", "channel", "text")
    return U.new_rows(p.unionAll(p), p.where("id % 2 = 0"), ["channel", "text"]).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"select (select count(*) from {POSTS_SQL} p) as posts, (select count(*) from {NEWS_SQL} n) as events, (select count(*) from {NEWS_SQL} n where status = 'active') as active, (select count(*) from {NEWS_SQL} n where status = 'merged') as merged, (select count(*) from customer) as users, (select count(*) from part) as nodes, (select count(*) from {LINKS_SQL} l) as links")
def stats_snapshot(spark, d):
    one = lambda df, **aggs: df.agg(*(c.alias(n) for n, c in aggs.items()))
    n = F.count(F.lit(1))
    parts = [
        one(posts(spark, d), posts=n), one(news(spark, d), events=n, active=F.count_if(F.col("status") == "active"), merged=F.count_if(F.col("status") == "merged")), one(table(spark, d, "customer"), users=n),
        one(table(spark, d, "part"), nodes=n), one(links(spark, d), links=n),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out


@query(f"select count(distinct user_id) as users, count(distinct news_id) as events, sum(case when action = 'like' then 1 else 0 end)::bigint as likes, coalesce(sum(case when action = 'read' then 1 end), 0)::bigint as reads, count(*) as actions from {ACTIONS_SQL} a")
def admin_statistics(spark, d):
    return actions(spark, d).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("news_id").alias("events"), F.count_if(F.col("action") == "like").alias("likes"), F.coalesce(F.sum(F.when(F.col("action") == "read", 1)), F.lit(0)).alias("reads"), F.count(F.lit(1)).alias("actions"))


@query("select event_type as operation, count(*) as n, round(sum(value), 2) as tokens from events group by 1 order by n desc, operation limit 8")
def ai_usage_by_operation(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("tokens")).orderBy(F.desc("n"), "operation").limit(8)


@query(
    f"""with recursive e as (select n.event_id, n.importance as base, c.s as sources from {NEWS_SQL} n join (select event_id, count(*) as s from {LINKS_SQL} l group by 1) c using (event_id)),
 r as (select event_id, base::double as v, 1 as k, sources from e union all select event_id, least(10.0::double, v + least(3.0::double, 0.6::double * k)), k + 1, sources from r where k < sources) select event_id, round(max(v), 6) as importance from r group by 1"""
)
def importance_ratchet(spark, d):
    """Importance after sources attach one by one, each on top of the last."""
    c = links(spark, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("sources"))
    e = news(spark, d).select("event_id", F.col("importance").alias("base")).join(c, "event_id")
    return U.ratchet(e).select("event_id", F.round("importance", 6).alias("importance"))


@query("select conv_id, turn, role, k from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc, role, text) as k from conversations) x where k <= 3")
def timeline_last_n(spark, d):
    c = U.last_n(table(spark, d, "conversations"), "conv_id", [F.desc("turn"), "role", "text"], 3)
    return c.select("conv_id", "turn", "role", F.col("k").cast("long").alias("k"))


@query(
    "select o_orderkey as job_id, case when o_orderstatus = 'F' then 100 when total = 0 then 0 else greatest(0, least(99, 100 * done // greatest(1, total)))::int end as percent from (select o_orderkey, o_orderstatus, count(l_orderkey) as total, count(case when l_linestatus = 'F' then 1 end) as done from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2) x"
)
def backfill_progress(spark, d):
    """Jobs (orders) by their finished tasks (lines): 100 only when done."""
    tasks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    j = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(tasks, "o_orderkey", "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(100 * done / F.greatest(F.lit(1), total))))
    return j.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", 100).when(total == 0, 0).otherwise(part).cast("int").alias("percent"))


@query("select n_name as channel, count(c_custkey) as users from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by 1")
def users_per_channel(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000")
    n = table(spark, d, "nation")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy(F.col("n_name").alias("channel")).agg(F.count("c_custkey").alias("users"))


@query(f"select slug, count(*) as n from (select distinct raw, {_slugged('raw')} as slug from {_RAW} r) x group by 1 having count(*) > 1")
def duplicate_slugs(spark, d):
    """Slugs that several names of posts share."""
    names = posts(spark, d).select(F.explode(F.expr(E.light_entities("text"))).alias("raw")).where("length(trim(raw)) >= 2 and regexp_like(raw, '[A-Za-zА-Яа-я]')").distinct()
    return names.groupBy(F.expr(E.slug("raw")).alias("slug")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"select event_id from {NEWS_SQL} n where event_id not in (select l_orderkey from lineitem group by 1 having bool_and(l_returnflag = 'R'))")
def without_ad_only(spark, d):
    """Events that are not linked to advertisements alone."""
    ads = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.bool_and(F.col("l_returnflag") == "R").alias("only")).where("only")
    return news(spark, d).select("event_id").join(ads, "event_id", "left_anti")


def _scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(f"select reason, theme, count(*) as n from (select {D.rule_reason('t')} as reason, {D.theme('b')} as theme from (select {D.stripped('text')} as t, {D.without_footers('text')} as b from {POSTS_SQL} p) x) y group by 1, 2")
def stream_ingest_counts(spark, d):
    """Posts through the live path in two arrivals, the second with rows that are late by more than six hours: those take the second path, and both are
    counted as one table, one row a post."""
    at = _scratch(spark)
    p = posts(spark, d).select("id", "text", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minute") * 60).alias("ts"))
    p.withColumn("second", F.col("id") % 2 == 1).write.partitionBy("second").parquet(f"{at}/all")
    keep = lambda df: live.classified(df).select("id", "ts", "reason", "theme")
    for second in ("false", "true"):
        spark.read.schema(p.schema).parquet(f"{at}/all/second={second}").write.mode("append").parquet(f"{at}/in")
        live.two_paths(keep(live.incoming(spark, f"{at}/in", p.schema, 1 << 30)), "ts", "6 hours", f"{at}/out", f"{at}/state").awaitTermination()
    kept = live.merged(spark, "id long, ts timestamp, reason string, theme string", f"{at}/out", ["id"], "ts")
    return kept.groupBy("reason", "theme").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select action, start_s, count(*) as n from (select action, epoch(time_bucket(interval '6 hours', ts, timestamp '1970-01-01 00:00:00'))::bigint - 21600 * k as start_s from {ACTIONS_SQL} a, range(4) r(k)) x group by 1, 2"""
)
def stream_sliding_actions(spark, d):
    """Actions of the last day, every six hours, in a stream of four arrivals; each tenth row comes one arrival late, within the watermark."""
    at = _scratch(spark)
    a = actions(spark, d).select("action_id", "action", F.col("ts").cast("timestamp").alias("ts"))
    span = a.agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi")).first()
    step = max(1, (span["hi"] - span["lo"]) // 4 + 1)
    nth = F.floor((F.unix_timestamp("ts") - span["lo"]) / step) + F.when(F.col("action_id") % 10 == 0, 1).otherwise(0)
    a.select("action", "ts", F.least(nth, F.lit(3)).cast("int").alias("arrival")).write.partitionBy("arrival").parquet(f"{at}/all")
    w = lambda: live.windowed_counts(live.incoming(spark, f"{at}/in", "action string, ts timestamp", files_per_trigger=1 << 30), "ts", f"{2 * step} seconds", "1 day", "6 hours")
    for k in range(4):
        spark.read.schema("action string, ts timestamp").parquet(f"{at}/all/arrival={k}").write.mode("append").parquet(f"{at}/in")
        live.run_available(w(), f"{at}/out", f"{at}/state")
    spark.sql("select 'end' as action, timestamp'2100-01-01 00:00:00' as ts").write.mode("append").parquet(f"{at}/in")
    live.run_available(w(), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").where("action <> 'end'").select("action", F.unix_timestamp("start").alias("start_s"), "n")


_POISON = "case (conv_id * 31 + turn) % 17 when 0 then 'not json' when 1 then 'empty' when 2 then 'missing role' else '' end"


@query(f"select {_POISON} as problem, count(*) as n, sum(case when {_POISON} = '' then length(coalesce(text, '')) else 0 end)::bigint as chars from conversations group by 1")
def stream_dead_letters(spark, d):
    """Conversation records of which some are cut, empty or without a role: the bad ones lie in a dead-letter table, the others all come through,
    and the counters observed on the way are those of the tables."""
    at = _scratch(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.expr(_POISON).alias("poison"))
    j = F.to_json(F.struct("conv_id", "turn", F.when(F.col("poison") != "missing role", F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    raw = F.when(F.col("poison") == "not json", F.substring(j, 2, 20)).when(F.col("poison") == "empty", " ").otherwise(j)
    c.select(raw.alias("raw")).write.parquet(f"{at}/in")
    stream = live.incoming(spark, f"{at}/in", "raw string", 1 << 30)
    work = lambda df: df.select(F.length("text").cast("long").alias("chars"))
    live.isolated(stream, "raw", "conv_id bigint, turn bigint, role string not null, text string not null", work, f"{at}/out", f"{at}/state").awaitTermination()
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/out/{name}")
    good = read("results", "chars long").agg(F.sum("chars").alias("chars"))
    counts = read("counts", "good long, bad long").agg(F.sum("good").alias("n"))
    bad = read("dead", "raw string, problem string").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    return good.join(counts).select(F.lit("").alias("problem"), "n", "chars").unionByName(bad.withColumn("chars", F.lit(0).cast("long")))  # one row each


@query(f"select channel, count(*) as n, max(id) as last_id from (select channel, id, row_number() over (partition by channel order by id) as k from {POSTS_SQL} p) x where k <= 150 group by 1")
def incremental_scan(spark, d):
    """Three polls of at most 50 new posts a channel, each from where the last one ended."""
    feed = ChannelFeed(spark, _scratch(spark))
    for _ in range(3):
        feed.poll(posts(spark, d).select("channel", "id", "text"))
    return feed.rows().groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


@query(f"select action, epoch(time_bucket(interval '1 day', ts, timestamp '1970-01-01 00:00:00'))::bigint as start_s, count(*) as n from {ACTIONS_SQL} a group by 1, 2")
def stream_windowed_actions(spark, d):
    """Actions counted by event-time day in a stream; late rows are within the watermark."""
    at = _scratch(spark)
    a = actions(spark, d).select("action", F.col("ts").cast("timestamp").alias("ts"))
    a.write.parquet(f"{at}/in")
    # one batch: files come in no order of event time, and the watermark moves between batches
    w = lambda: live.windowed_counts(live.incoming(spark, f"{at}/in", a.schema, files_per_trigger=1 << 30), "ts", "1 day", "1 day")
    live.run_available(w(), f"{at}/out", f"{at}/state")
    # one row far ahead, which the second run reads from where the first one ended, closes the last windows
    spark.sql("select 'end' as action, timestamp'2100-01-01 00:00:00' as ts").write.mode("append").parquet(f"{at}/in")
    live.run_available(w(), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").where("action <> 'end'").select("action", F.unix_timestamp("start").alias("start_s"), "n")
