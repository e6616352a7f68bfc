"""Queries that show whole records: an event's brief with its related list, analyses, counters, queues, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..config import DEFAULT
from ..functions import expressions as E
from ..functions import vocab as V
from ..functions.vectors import hashed_words, nearest
from ..operators import graph as G
from ..operators import readers as R
from ..sources.tables import ACTIONS_SQL, LINKS_SQL, NEWS_SQL, POSTS_SQL, actions, links, news, post_tasks, posts, table, tasks
from ..streaming import live
from . import duck as D
from .pair_queries import _SPARSE
from .reader_queries import _STATES
from .record_queries import _BRAND_OF
from .text_queries import _duck_dated, _duck_mentions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_CASED = rf"case when length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) > 0 and length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) >= 0.65::double * length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) then array_to_string(list_transform(string_split(lower(t), ' '), lambda w: {_BRAND_OF}), ' ') else t end"


@query(
    f"""with s as (select l_orderkey as id, count(*) as sources, arg_min(l_shipdate::date, l_linenumber) as ref, min(l_shipdate::date) as first_pub, max(l_shipdate::date) as updated from lineitem group by 1),
 e as (select p.id, o_orderdate::date as created, {D.title_of('t')} as title, {D.summary_of('t')} as summary from (select id, {D.stripped('text')} as t from {POSTS_SQL} x) p join orders on o_orderkey = p.id),
 b as (select e.id, coalesce(sources, 0) as sources, coalesce(sources >= 2 and updated > created, false) as updated, least(created, coalesce(first_pub, created)) as first_seen, coalesce(ref, created) as ref, title, summary from e left join s using (id)),
 d as (select *, trim({_duck_mentions(_duck_dated('title', 'ref'))}, ' ') as t, {_duck_mentions(_duck_dated('summary', 'ref'))} as shown from b)
 select id, {_CASED} as title, sha256(shown) as summary_sha256, sources, updated, first_seen::varchar as first_seen from d"""
)
def brief_view(spark, d):
    """What a detail page shows of an event: title and summary with dates and without mentions, sources, whether it was updated, when it was first seen. Sources are
    aggregated before they meet the texts. Of sources of one number the one stored first gives the date."""
    day = lambda c: F.col(c).cast("date")
    stored = F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", stored.alias("stored")).groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("sources"), F.min_by(day("l_shipdate"), "stored").alias("ref"), F.min(day("l_shipdate")).alias("first_pub"), F.max(day("l_shipdate")).alias("updated")
    )
    e = posts(spark, d).select("id", F.expr(E.title_of("text")).alias("title"), F.expr(E.summary_of("text")).alias("summary")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("created")), "id")
    b = e.join(s, "id", "left").withColumn("ref", F.coalesce("ref", "created"))
    title, shown = E.title_case("told"), F.expr(E.without_mentions(E.dated("summary", "ref")))
    b = b.withColumn("told", F.expr(E.without_mentions(E.dated("title", "ref"))))
    updated = F.coalesce((F.col("sources") >= 2) & (F.col("updated") > F.col("created")), F.lit(False))
    return b.select("id", F.expr(title).alias("title"), F.sha2(shown, 256).alias("summary_sha256"), F.coalesce("sources", F.lit(0)).alias("sources"), updated.alias("updated"), F.least("created", F.coalesce("first_pub", "created")).cast("string").alias("first_seen"))


@query(
    f"""select event_id, peer, k from (select x.event_id, n.event_id as peer, row_number() over (partition by x.event_id order by n.importance desc, n.event_id) as k
 from (select distinct a.event_id, b.event_id as peer from {LINKS_SQL} a join {LINKS_SQL} b using (node_id) where a.event_id <> b.event_id) x join {NEWS_SQL} n on n.event_id = x.peer and n.status = 'active') y where k <= 6"""
)
def related_list(spark, d):
    """The six most important active events that share a node with each event."""
    r = G.important_peers(links(spark, d), news(spark, d).where("status = 'active'").select("event_id", "importance"), 6, tasks(table(spark, d, "lineitem")))
    return r.select("event_id", "peer", F.col("k").cast("long").alias("k"))


@query(
    f"""select id, {D.language('text')} as language, case when ad then 'other' else {D.theme('b')} end as theme, case when ad then 0.0::double else {D.importance('1', '0.0::double', 'length(text)', D.important_hits('text'))} end as importance, case when ad then '' else {D.title_of('t')} end as title, case when ad then '' else sha256({D.summary_of('t')}) end as summary_sha256, ad
 from (select id, coalesce(text, '') as text, {D.stripped('text')} as t, {D.matches('text', V.AD_MARKERS)} as ad, {D.without_footers('text')} as b from {POSTS_SQL} p) x where t <> ''"""
)
def analysis_records(spark, d):
    """the rule-based analysis with language, theme, importance, title and summary; advertisements have none but their mark and language."""
    p = posts(spark, d).where(F.expr(f"{E.stripped('text')} <> ''")).select("id", "text", F.expr(E.has_ad_markers("text")).alias("ad"), F.expr(E.important_hits("text")).alias("hits"), F.length("text").alias("size"))
    off = lambda x, none: F.when(F.col("ad"), none).otherwise(x)
    return p.select(
        "id", F.expr(E.language("text")).alias("language"), off(F.expr(E.theme("text")), "other").alias("theme"), off(F.expr(E.importance("1", "0D", "size", "hits")), 0.0).alias("importance"),
        off(F.expr(E.title_of("text")), "").alias("title"), off(F.sha2(F.expr(E.summary_of("text")), 256), "").alias("summary_sha256"), "ad",
    )


@query(f"select id, dim, round(weight / sqrt(sum(weight * weight) over (partition by id)), 6) as value from {_SPARSE} v")
def hash_embedding_unit(spark, d):
    """M2: the hashed vectors of norm 1, in sparse form. Norms come from one aggregation and meet the components by id."""
    v = hashed_words(posts(spark, d), "id", "text", DEFAULT.embedding_dim, post_tasks(spark, d))
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return v.join(norm, "id").select("id", "dim", F.round(F.col("weight") / F.col("norm"), 6).alias("value"))


_KNOWN = f"(select l_partkey as a, l_suppkey as b, round(0.5 + max(l_discount) * 4, 4) as weight from lineitem where l_linenumber = 3 group by 1, 2)"


@query(
    f"""with u as (select l_partkey as a, l_suppkey as b, count(*) as n, max(case when l_returnflag = 'R' then 0.85::double end) as given from lineitem where l_partkey <> l_suppkey group by 1, 2)
 select a, b, coalesce(n, 0) as bumps, round(least(1.0::double, greatest(coalesce(k.weight::double, 0.45::double), coalesce(given, 0.0::double)) + 0.04::double * (coalesce(n, 0) - case when k.a is null then 1 else 0 end)), 4) as weight from u full join (select * from {_KNOWN} x where a <> b) k using (a, b)"""
)
def kg_edge_upsert(spark, d):
    """K4: edges bumped by every mention on top of what is stored or given (the larger), none from a node to itself."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_linenumber", F.col("l_discount").cast("double").alias("discount"), F.when(F.col("l_returnflag") == "R", 0.85).alias("given"))
    stored = li.where("l_linenumber = 3").groupBy("a", "b").agg(F.round(0.5 + F.max("discount") * 4, 4).alias("weight"))
    e = G.upserted(stored, li.select("a", "b", "given"))
    return e.select("a", "b", F.col("bumps"), F.round("weight", 4).alias("weight"))


@query(
    f"""select (select count(distinct channel) from {POSTS_SQL} p) as channels, (select count(*) from {POSTS_SQL} p) as messages, (select count(*) from {POSTS_SQL} p where id in (select doc_id from labels)) as processed_messages, (select count(*) from {NEWS_SQL} n) as news,
 (select count(*) from {NEWS_SQL} n where status = 'active') as active, (select count(*) from lineitem) as sources, (select count(*) from customer) as users, (select count(*) from (select {D.rule_reason('t')} as r from (select {D.stripped('text')} as t from {POSTS_SQL} p) x) y where r <> 'pass') as filtered_messages,
 (select count(*) from events) as ai_requests, (select count(*) from events where event_type in ('view', 'click')) as ai_analyze, (select count(*) from events where event_type in ('purchase', 'error')) as ai_search, (select count(*) from part) as nodes,
 (select count(*) from (select distinct x.node_id, y.node_id from {LINKS_SQL} x join {LINKS_SQL} y on x.event_id = y.event_id and x.node_id < y.node_id)) as edges, (select count(*) from {LINKS_SQL} l) as links"""
)
def stats_all(spark, d):
    """All counters of the dashboard and the graph, one aggregation a table."""
    n = F.count(F.lit(1))
    p = posts(spark, d).select("id", "channel", F.expr(E.rule_reason("text")).alias("reason")).join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("done")).distinct(), "id", "left")
    one = [
        p.agg(F.count_distinct("channel").alias("channels"), n.alias("messages"), F.count("done").alias("processed_messages"), F.count_if(F.col("reason") != "pass").alias("filtered_messages")),
        news(spark, d).agg(n.alias("news"), F.count_if(F.col("status") == "active").alias("active")), table(spark, d, "lineitem").agg(n.alias("sources")), table(spark, d, "customer").agg(n.alias("users")),
        table(spark, d, "events").agg(n.alias("ai_requests"), F.count_if(F.col("event_type").isin("view", "click")).alias("ai_analyze"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("ai_search")),
        table(spark, d, "part").agg(n.alias("nodes")), G.cooccurrence(links(spark, d)).agg(n.alias("edges")), links(spark, d).agg(n.alias("links")),
    ]
    out = one[0]
    for x in one[1:]:  # one row each
        out = out.join(F.broadcast(x))
    return out


@query(
    f"""select id, k from (select p.id, row_number() over (order by (id * 7 % 101) desc, minute desc, id) as k from (select id, minute, {D.title_of('t')} as title, {D.summary_of('t')} as summary, {D.theme('b')} as theme from (select id, minute, {D.stripped('text')} as t, {D.without_footers('text')} as b from {POSTS_SQL} x) y) p
 where title ilike '%on%' or summary ilike '%on%' or theme ilike '%on%') z where k <= 20"""
)
def keyword_events(spark, d):
    """A keyword in title, summary or theme of an event, the most important and newest first."""
    p = posts(spark, d).select("id", "minute", F.expr(E.title_of("text")).alias("title"), F.expr(E.summary_of("text")).alias("summary"), F.expr(E.theme("text")).alias("theme"))
    hit = p.where(F.col("title").ilike("%on%") | F.col("summary").ilike("%on%") | F.col("theme").ilike("%on%"))
    top = hit.orderBy(F.desc(F.expr("id * 7 % 101")), F.desc("minute"), "id").limit(20)
    w = Window.orderBy(F.desc(F.expr("id * 7 % 101")), F.desc("minute"), "id")  # twenty rows
    return top.select("id", F.row_number().over(w).cast("long").alias("k"))


@query(
    f"""with own as (select distinct user_id, (user_id * 7 + k) % 97 as channel_id from events, range(3) r(k)), cand as (select user_id, n.event_id, importance, created_at from own join {NEWS_SQL} n using (channel_id) where status = 'active'
  and not exists (select 1 from {_STATES} s where s.user_id = own.user_id and s.news_id = n.event_id and (is_read or disliked or favorite))),
 scanned as (select *, row_number() over (partition by user_id order by created_at desc, event_id desc) as r from cand qualify r <= 130), weak as (select *, row_number() over (partition by user_id order by importance desc, created_at desc, event_id desc) as k from scanned)
 select user_id, event_id, k from weak where k > 50"""
)
def unread_overflow(spark, d):
    """Of the 130 newest unread events of a user's channels, the ones behind the 50 strongest, which are hidden without being read."""
    s = R.user_states(actions(spark, d)).where("is_read or disliked or favorite").select("user_id", F.col("news_id").alias("event_id"))
    own = table(spark, d, "events").select("user_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select("user_id", ((F.col("user_id") * 7 + F.col("k")) % 97).alias("channel_id")).distinct()
    return R.overflow(news(spark, d).where("status = 'active'"), own, s, 130, 50).withColumn("k", F.col("k").cast("long"))


@query("select event_type as operation, user_id % 10 as shard, count(*) as n, round(sum(value), 2) as tokens, max(event_id) as last_id from events group by 1, 2")
def usage_log(spark, d):
    """Calls logged by a stream in three arrivals, of which the second comes twice; the log holds each call once."""
    at = f"{shared_folder(spark).rstrip('/')}/usage-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("operation"), "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    e.withColumn("arrival", (F.col("event_id") % 3).cast("int")).write.partitionBy("arrival").parquet(f"{at}/all")
    for arrival in (0, 1, 1, 2):
        spark.read.schema(e.schema).parquet(f"{at}/all/arrival={arrival}").write.mode("append").parquet(f"{at}/in")
        live.two_paths(live.incoming(spark, f"{at}/in", e.schema, 1 << 30), "ts", "1 day", f"{at}/log", f"{at}/state").awaitTermination()
    log = live.merged(spark, e.schema, f"{at}/log", ["event_id"], "ts")
    return log.groupBy("operation", (F.col("user_id") % 10).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("tokens"), F.max("event_id").alias("last_id"))


@query(
    """with e as (select * from embeddings where vec_id > (select max(vec_id) from embeddings) - 1500), n as (select * from e order by vec_id desc limit 500)
 select query_id, vec_id, round(s, 6) as similarity from (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as k from (select q.vec_id as query_id, n.vec_id, list_cosine_similarity(n.embedding::double[], q.embedding::double[]) as s from n join embeddings q on q.vec_id % 100 = 0) x) y where k <= 10"""
)
def vector_topk_window(spark, d):
    """The ten nearest of the 500 newest vectors within a window (ids stand for time), for every query."""
    e = table(spark, d, "embeddings")
    last = e.agg(F.max("vec_id").alias("last"))  # one row
    recent = e.join(F.broadcast(last), F.col("vec_id") > F.col("last") - 1500).drop("last").orderBy(F.desc("vec_id")).limit(500)
    return nearest(recent, e.where("vec_id % 100 = 0"), k=10).select("query_id", "vec_id", F.round("s", 6).alias("similarity"))


@query(f"select event_id, place, total from (select event_id, row_number() over (order by importance desc, created_at desc, event_id) as place, count(*) over () as total from {NEWS_SQL} n where status = 'active') x where place > 20 and place <= 30")
def top_events_page(spark, d):
    """The third page of ten of the most important events, newest first among equals, with how many there are. Only the pages up to it are ordered."""
    n = news(spark, d).where("status = 'active'")
    order = [F.desc("importance"), F.desc("created_at"), F.col("event_id")]
    top = n.orderBy(*order).limit(30).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # thirty rows
    return top.where("place > 20").join(F.broadcast(n.agg(F.count(F.lit(1)).alias("total")))).select("event_id", "place", "total")


@query(f"select user_id, news_id, k, total from (select user_id, news_id, row_number() over (partition by user_id order by last_ts desc nulls last, news_id) as k, count(*) over (partition by user_id) as total from {_STATES} s where is_read) x where k > 3 and k <= 6")
def history_page_total(spark, d):
    """The second page of three of each user's history, with the exact number of entries. The rank is limited before the shuffle; totals are aggregated apart."""
    s = R.user_states(actions(spark, d)).where("is_read")
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("last_ts"), "news_id")
    page = s.withColumn("k", F.row_number().over(w)).where("k <= 6").where("k > 3")
    return page.join(s.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")), "user_id").select("user_id", "news_id", F.col("k").cast("long").alias("k"), "total")


@query(
    f"""select id, case when t1 <> 'other' then t1 when t2 <> 'other' then t2 else 'gaming' end as theme from (select id, {D.theme('b1')} as t1, {D.theme('b2')} as t2 from (select id, {D.without_footers("concat(title, chr(10), topic)")} as b1, {D.without_footers("concat(title, chr(10), summary, chr(10), topic)")} as b2
 from (select id, {D.title_of('t')} as title, {D.summary_of('t')} as summary, channel as topic from (select id, channel, {D.stripped('text')} as t from {POSTS_SQL} p) x) y) z) w"""
)
def event_themes(spark, d):
    """F16: an event's theme by title and topic, else with its summary, else the one it has."""
    p = posts(spark, d).select("id", F.col("channel").alias("topic"), F.expr(E.title_of("text")).alias("title"), F.expr(E.summary_of("text")).alias("summary"))
    return p.select("id", F.expr(E.event_theme("title", "summary", "topic", "'GAMING'")).alias("theme"))


_NOW = 50_000
_LIMITS = ", ".join(f"({k}, {n})" for k, n in V.BACKFILL_LIMITS.items())


@query(
    f"""select days, channel, count(*) as n, max(k) as last from (select days, channel, most, row_number() over (partition by days, channel order by minute * 37 % {_NOW} desc, id desc) as k from {POSTS_SQL} p join (values {_LIMITS}) l(days, most) on minute * 37 % {_NOW} >= {_NOW} - days * 1440) x where k <= most group by 1, 2"""
)
def backfill_bounds(spark, d):
    """S3: what a backfill of 1 to 30 days takes of each channel: the newest posts behind its cutoff, up to its limit."""
    bounds = spark.createDataFrame(list(V.BACKFILL_LIMITS.items()), "days long, most long")  # five rows
    p = posts(spark, d).select("id", "channel", F.expr(f"pmod(minute * 37, {_NOW})").alias("at"))
    j = p.join(F.broadcast(bounds), F.col("at") >= _NOW - F.col("days") * 1440)
    w = Window.partitionBy("days", "channel").orderBy(F.desc("at"), F.desc("id"))
    top = j.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max(V.BACKFILL_LIMITS.values())).where(F.col("k") <= F.col("most"))
    return top.groupBy("days", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("k").cast("long").alias("last"))


@query(
    f"""select id, sha256(t) as text_sha256, case when id % 3 = 0 then concat('https://t.me/', ltrim(channel, '@'), '/', id) else concat('https://t.me/c/', case when cast(id + 1 as varchar) like '100%' then cast(try_cast(substr(cast(id + 1 as varchar), 4) as bigint) as varchar) else cast(id + 1 as varchar) end, '/', id) end as url
 from (select id, channel, {D.stripped('text')} as t from {POSTS_SQL} p) x where t <> '' and id > 100"""
)
def shaped_rows(spark, d):
    """Posts as they are stored: stripped, empty ones left out, with their address."""
    p = posts(spark, d).where("id > 100").select("id", "channel", F.expr(E.stripped("text")).alias("t")).where("t <> ''")
    return p.select("id", F.sha2("t", 256).alias("text_sha256"), F.expr(E.message_url("case when id % 3 = 0 then channel end", "-(id + 1)", "id")).alias("url"))


@query(
    f"""with j as (select doc_id // 30 as job_id, list(doc_id) as ids, doc_id // 30 % 3 as state from labels group by 1, 3) select channel, count(*) as n, min(id) as first_id from {POSTS_SQL} p where id not in (select unnest(ids) from j where state < 2) group by 1"""
)
def queue_free(spark, d):
    """Posts that no queued or running job holds; the arrays of ids (30 a job at most) are exploded."""
    jobs = table(spark, d, "labels").groupBy(F.expr("doc_id div 30").alias("job_id")).agg(F.collect_list("doc_id").alias("ids")).withColumn("state", F.col("job_id") % 3)
    busy = jobs.where("state < 2").select(F.explode("ids").alias("id"))
    return posts(spark, d).select("id", "channel").join(busy, "id", "left_anti").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
