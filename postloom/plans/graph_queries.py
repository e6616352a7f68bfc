"""Queries over the knowledge graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions import expressions as E
from ..functions import vocab as V
from ..operators import graph as G
from ..sources.snapshots import Snapshots
from ..sources.tables import LINKS_SQL, POSTS_SQL, links, posts, table, tasks
from . import duck as D
from . import record_queries

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_AL = "(values " + ", ".join(f"({D.q(a)}, {D.q(n)}, {D.q(t)}, {i})" for i, (a, n, t) in enumerate(V.ALIASES)) + ") al(alias, name, node_type, ord)"
_MENTION = f"(select distinct id, name, node_type from {POSTS_SQL} p join {_AL} on contains(lower(p.text), alias) and length(alias) >= 3)"


@query(f"select name, node_type, count(*) as mentions from {_MENTION} m group by 1, 2")
def kg_node_mentions(spark, d):
    return G.mentioned_nodes(spark, posts(spark, d)).groupBy("name", "node_type").agg(F.count(F.lit(1)).alias("mentions"))


_LIGHT = record_queries.SQL["light_entities"]
_RAW = f"(select distinct id, raw from (select id, unnest(entities) as raw from ({_LIGHT}) le) u where length(trim(raw)) >= 2 and regexp_matches(raw, '[A-Za-zА-Яа-я]'))"
_RESOLVED = f"""(with n as (select distinct raw as name, lower(trim(raw)) as low from {_RAW} r), e as (select n.name, al.name as en, al.node_type as et from n join {_AL} on low = alias),
 i as (select n.name, arg_max(struct_pack(nm := al.name, tp := al.node_type), length(alias) * 1000 - ord) as best from n join {_AL} on contains(low, alias) and length(alias) >= 3 group by 1)
 select n.name, coalesce(en, best.nm, n.name) as canonical, coalesce(et, best.tp, case when regexp_matches(n.name, '[0-9]') then 'Product' when not regexp_matches(n.name, '\\p{{Lu}}') then 'Topic' when length(n.name) <= 16 and not regexp_matches(n.name, '\\s') then 'Company' else 'Product' end) as node_type
 from n left join e on n.name = e.name left join i on n.name = i.name)"""


@query(f"select * from {_RESOLVED} r")
def entity_resolution(spark, d):
    """K2: the names that whole posts hold, resolved."""
    raw = posts(spark, d).select(F.explode(F.expr(E.light_entities("text"))).alias("name")).where("length(trim(name)) >= 2 and regexp_like(name, '[A-Za-zА-Яа-я]')")
    return G.resolved(spark, raw)


def _slugged(x: str) -> str:
    return _SLUG.replace("p_name", x)


@query(f"select a.name as a, b.name as b, count(*) as mentions from {_MENTION} a join {_MENTION} b on a.id = b.id and a.name < b.name group by 1, 2")
def kg_post_cooccurrence(spark, d):
    m = G.mentioned_nodes(spark, posts(spark, d)).select(F.col("id").alias("event_id"), F.col("name").alias("node_id"))
    return G.cooccurrence(m)


_PAIR = f"(select x.node_id as a, y.node_id as b, count(*) as mentions from {LINKS_SQL} x join {LINKS_SQL} y on x.event_id = y.event_id and x.node_id < y.node_id group by 1, 2)"
_EDGE = f"(select a, b, mentions, least(1.0::double, 0.45::double + 0.04::double * (mentions - 1)) as weight, least(1.0::double, 0.55::double + 0.03::double * (mentions - 1)) as confidence from {_PAIR} p)"


def _dealt(spark, d) -> int:
    """Tasks for the pairs of nodes of one event: some two a line."""
    return 2 * tasks(table(spark, d, "lineitem"))


def _pairs(spark, d):
    return G.cooccurrence(links(spark, d), _dealt(spark, d))


@query(f"select mentions, count(*) as n_edges from {_PAIR} p group by 1")
def kg_cooccurrence_edges(spark, d):
    return _pairs(spark, d).groupBy("mentions").agg(F.count(F.lit(1)).alias("n_edges"))


@query(f"select a, b, mentions, round(weight, 4) as weight, round(confidence, 4) as confidence from {_EDGE} e")
def kg_edge_weights(spark, d):
    return G.weighted(_pairs(spark, d)).select("a", "b", "mentions", F.round("weight", 4).alias("weight"), F.round("confidence", 4).alias("confidence"))


@query(
    f"""with e as (select a, b from {_EDGE} x where weight >= 0.3), s as (select p_partkey as node_id from part where p_brand = 'Brand#11' and p_size > 40)
 select node_id, min(distance) as distance from (select node_id, 0 as distance from s union all select b, 1 from e join s on a = node_id union all select a, 1 from e join s on b = node_id) u group by 1"""
)
def kg_expand_one_hop(spark, d):
    seeds = table(spark, d, "part").where("p_brand = 'Brand#11' and p_size > 40").select(F.col("p_partkey").alias("node_id"))
    return G.expanded(seeds, G.weighted(_pairs(spark, d)), 0.3)


@query(
    f"""with own as (select l.event_id as e, l.node_id from {LINKS_SQL} l join orders o on o.o_orderkey = l.event_id where o.o_orderstatus = 'O'),
 p as (select e, l.event_id, count(*) as shared from own join {LINKS_SQL} l using (node_id) where e <> l.event_id group by 1, 2)
 select e as event_id, event_id as peer, shared from p qualify row_number() over (partition by e order by shared desc, event_id) <= 12"""
)
def kg_related_events(spark, d):
    active = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id"))
    return G.related(links(spark, d), active, tasks=tasks(table(spark, d, "lineitem")))


@query(f"select p_partkey as node_id from part where p_partkey not in (select node_id from {LINKS_SQL} l)")
def kg_orphan_nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node_id")).join(links(spark, d).select("node_id"), "node_id", "left_anti")


_SEEN = f"(select x.node_id as a, y.node_id as b, count(*) as mentions, max(o_orderdate) as last_seen from {LINKS_SQL} x join {LINKS_SQL} y on x.event_id = y.event_id and x.node_id < y.node_id join orders on o_orderkey = x.event_id group by 1, 2)"


@query(
    f"select a, b, round(case when datediff('day', last_seen::date, (select max(o_orderdate) from orders)::date) > 45 then greatest(0.05::double, weight * 0.92::double) else weight end, 6) as weight from (select *, least(1.0::double, 0.45::double + 0.04::double * (mentions - 1)) as weight from {_SEEN} s) e"
)
def kg_edge_decay(spark, d):
    """K9: edges that no event of the last 45 days mentions lose weight."""
    l = links(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderdate")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    j = G.met(l.join(o.repartition(tasks(table(spark, d, "lineitem")), "event_id").hint("merge"), "event_id"), l).select("a", "b", "o_orderdate")
    e = j.repartition(_dealt(spark, d), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("mentions"), F.max("o_orderdate").alias("last_seen"))
    e = G.weighted(e).join(F.broadcast(now))
    return G.decayed(e, "datediff(cast(now as date), cast(last_seen as date)) > 45").select("a", "b", F.round("weight", 6).alias("weight"))


_SLUG = r"coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[\s./+]', '-', 'g'), '[^\p{L}\p{N}_\-]', '', 'g'), '-+', '-', 'g'), '-'), 1, 240), ''), 'node')"


@query(
    f"""with n as (select p_partkey as node_id, {_SLUG} as slug from part), m as (select node_id, min(node_id) over (partition by slug) as keep from n)
 select x.keep as a, y.keep as b, max(weight) as weight from {_EDGE} e join m x on x.node_id = a join m y on y.node_id = b where x.keep <> y.keep group by 1, 2"""
)
def kg_slug_merge(spark, d):
    return G.merged_slugs(G.slugs(table(spark, d, "part")), G.weighted(_pairs(spark, d)).select("a", "b", "weight"), _dealt(spark, d))


_SEED = ", ".join(f"({D.q(a)}, {D.q(b)}, {D.q(t)})" for a, b, t in V.SEED_EDGES)


@query(f"with s as (select * from (values {_SEED}) v(a, b, edge_type)) select s.a, s.b, s.edge_type, round(least(1.0::double, 0.85::double + 0.04::double * coalesce(m.n, 0)), 4) as weight from s left join (select x.name as a, y.name as b, count(*) as n from {_MENTION} x join {_MENTION} y on x.id = y.id and x.name <> y.name group by 1, 2) m on m.a = s.a and m.b = s.b")
def kg_seed_edges(spark, d):
    """Seed edges, strengthened by every post that mentions both ends."""
    seed = spark.createDataFrame(V.SEED_EDGES, "a string, b string, edge_type string")
    m = G.mentioned_nodes(spark, posts(spark, d)).select("id", "name")
    ends = F.broadcast(seed.select("a", "b").distinct())
    n = m.join(ends, m["name"] == ends["a"]).select("id", "a", "b").join(m.select("id", F.col("name").alias("b")), ["id", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return seed.join(n, ["a", "b"], "left").select("a", "b", "edge_type", F.round(F.least(F.lit(1.0), 0.85 + 0.04 * F.coalesce("n", F.lit(0))), 4).alias("weight"))


_FOUND = f"""(select distinct id, {_slugged("name")} as slug, lower(raw) as raw, name, node_type from (select r.id, r.raw, c.canonical as name, c.node_type from {_RAW} r join {_RESOLVED} c on c.name = r.raw
 union all select id, name, name, node_type from (select id, al.name, al.node_type, row_number() over (partition by id order by length(alias) desc, ord) as k from {POSTS_SQL} p join {_AL} on contains(lower(p.text), alias) and length(alias) >= 3) s where k <= 12) f)"""


@query(
    f"""with f as materialized (select * from {_FOUND} f), a as (select slug, raw, row_number() over (partition by slug order by min(id), raw) as k from f group by 1, 2)
 select n.slug, n.f.name as name, n.f.node_type as node_type, n.mentions, al.aliases from (select slug, min(struct_pack(id := id, name := name, node_type := node_type)) as f, count(distinct id) as mentions from f group by 1) n
 join (select slug, string_agg(raw, '|' order by k) as aliases from a where k <= 48 group by 1) al using (slug)"""
)
def kg_nodes(spark, d):
    """K3: the nodes that posts mention, by slug, with their first 48 aliases."""
    return G.node_table(G.event_nodes(spark, posts(spark, d))).withColumn("aliases", F.array_join("aliases", "|"))


_CATS = ", ".join(f"({D.q(n)}, {D.q(c)})" for n, cs in V.CATEGORIES.items() for c in cs)


@query(
    f"""with o as materialized (select distinct id, slug from {_FOUND} f), s as (select slug from o union select {_slugged("name")} from {_AL}),
 c as (select {_slugged("name")} as slug, {_slugged("category")} as parent from (values {_CATS}) v(name, category)), u as (select o.slug, parent, count(*) as n from o join c using (slug) where o.slug <> parent and parent in (select slug from s) group by 1, 2),
 e as (select x.slug as a, y.slug as b, 'RELATED_TO' as edge_type, count(*) as n from o x join o y on x.id = y.id and x.slug <> y.slug group by 1, 2 union all select parent, slug, 'RELATED_TO', n from u union all select slug, parent, 'PART_OF', n from u)
 select a, b, edge_type, sum(n)::bigint as mentions, round(least(1.0::double, 0.45::double + 0.04::double * (sum(n) - 1)), 4) as weight from e group by 1, 2, 3"""
)
def kg_ingested_edges(spark, d):
    """K6: edges between the nodes of each post, and between nodes and what they belong to."""
    e = G.ingested_edges(spark, G.event_nodes(spark, posts(spark, d)))
    return G.weighted(e).select("a", "b", "edge_type", "mentions", F.round("weight", 4).alias("weight"))


_STORED = "select distinct l_orderkey as event_id, l_partkey as node_id, case when l_linenumber = 1 then 0.9::double else 0.5::double end as confidence from lineitem where l_linestatus = 'F'"


def _stored(spark, d, repeated: bool = False):
    li = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    rows = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("node_id"), F.expr("case when l_linenumber = 1 then 0.9D else 0.5D end").alias("confidence"))
    return rows if repeated else rows.distinct()


@query(f"select event_id, node_id, max(confidence) as confidence from ({_STORED} union all select l_orderkey, l_partkey, 0.75::double from lineitem) x group by 1, 2")
def kg_event_links(spark, d):
    """K5: links of events to nodes; one that is stored keeps the higher confidence."""
    li = table(spark, d, "lineitem")
    every = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("node_id"))
    return G.linked(_stored(spark, d, repeated=True), every, tasks=tasks(li))


@query(f"select o_orderkey as event_id, count(distinct l_partkey) as added from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' and o_orderkey not in (select event_id from ({_STORED}) s) group by 1")
def kg_missing_links(spark, d):
    """Active events without stored links, and how many each gets."""
    bare = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id")).join(_stored(spark, d), "event_id", "left_anti")
    return links(spark, d).join(bare, "event_id", "left_semi").groupBy("event_id").agg(F.count(F.lit(1)).alias("added"))


_QUESTIONS = "(select item_id as id, text from benchmark union all select 1000000000000 + doc_id, text from documents where doc_id % 100 = 0 union all select 2000000000000 + conv_id * 1000 + turn, text from conversations where role = 'user')"


def _questions(spark, d):
    """Questions (id, text): benchmark items, every document whose id is divisible by 100, users' turns."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), "text")
    t = table(spark, d, "documents").where("doc_id % 100 = 0").select((F.col("doc_id") + 1_000_000_000_000).alias("id"), "text")
    c = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 2_000_000_000_000).alias("id"), "text")
    return b.unionAll(t).unionAll(c)


_SIGNIFICANT = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[{E.WORD}\\-]{{2,}}'), lambda t: t not in ({D.words_in(V.SEARCH_STOP)}) and not regexp_matches(t, '^\\p{{Nd}}+$') and length(t) >= 4)"
_QUERY_NODES = f"""(with q as (select * from {_QUESTIONS} x), b as (select q.id, al.name, min(ord - 1000 * length(alias)) as p from q join {_AL} on contains(lower(q.text), alias) and length(alias) >= 3 group by 1, 2),
 n as (select id, list(name order by p) as nodes from b group by 1), s as (select id, text, {_SIGNIFICANT} as w from q)
 select s.id, text, coalesce(nodes, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5)) as names, nodes is not null as known from s left join n on n.id = s.id)"""


@query(f"select id, array_to_string(names, '|') as names, known from {_QUERY_NODES} n")
def query_nodes(spark, d):
    """What each question is about."""
    return G.query_nodes(spark, _questions(spark, d)).withColumn("names", F.array_join("names", "|"))


@query(f"select id, array_to_string(list_slice(list_filter(list_transform(list_slice(names, 1, 6), lambda n: concat('What''s new with ', n, '?')), lambda x: lower(x) <> lower(trim(coalesce(text, '')))), 1, 5), '|') as asked from {_QUERY_NODES} n")
def related_questions(spark, d):
    """follow-up questions."""
    q = _questions(spark, d)
    return G.questions_about(G.query_nodes(spark, q), q).withColumn("asked", F.array_join("asked", "|"))


@query(
    f"""with p as (select * from (select o_orderkey as a, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders) x where b is not null), l as (select distinct event_id, node_id % 50 as node_id from ({_STORED}) s),
 s as (select a, b, count(*) as shared from p join l x on x.event_id = a join l y on y.event_id = b and y.node_id = x.node_id group by 1, 2)
 select p.a, p.b, coalesce(shared, 0) as shared, shared is not null or p.a not in (select event_id from l) or p.b not in (select event_id from l) as ok from p left join s on s.a = p.a and s.b = p.b"""
)
def entity_gate(spark, d):
    """Each story's successive events share an entity, or one of them has none."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")
    return G.shared_gate(pairs, _stored(spark, d).select("event_id", (F.col("node_id") % 50).alias("node_id")).distinct())


def graph_stages(spark, posts_):
    """Stages of a full rebuild of the graph from posts: seed nodes and edges, nodes of every post, edges, and their links."""

    def seed(_):
        return {"seeds": G.alias_table(spark).select(F.expr(E.slug("name")).alias("slug"), "name", "node_type").distinct(), "seed_edges": spark.createDataFrame(V.SEED_EDGES, "a string, b string, edge_type string")}

    def relink(_):
        return {"links": G.event_nodes(spark, posts_)}

    def nodes(read):
        return {"nodes": G.node_table(read("links"))}

    def edges(read):
        return {"edges": G.weighted(G.ingested_edges(spark, read("links")))}

    return [("seed", seed), ("relink", relink), ("nodes", nodes), ("edges", edges)]


@query(f"select 'nodes' as kind, count(*) as n, sum(mentions)::bigint as mentions from ({SQL['kg_nodes']}) x union all select 'edges', count(*), sum(mentions)::bigint from ({SQL['kg_ingested_edges']}) y")
def kg_rebuilt(spark, d):
    """The graph rebuilt in stages, stopped before its last one and resumed; as large as what is derived in one go."""
    store = Snapshots(spark, f"{shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}")
    stages = graph_stages(spark, posts(spark, d))
    store.rebuild(stages, stop=lambda name: name == "edges")
    store.rebuild(stages)
    n, m = F.count(F.lit(1)).alias("n"), F.sum("mentions").alias("mentions")
    return store.read("nodes").agg(n, m).select(F.lit("nodes").alias("kind"), "n", "mentions").unionAll(store.read("edges").agg(n, m).select(F.lit("edges").alias("kind"), "n", "mentions"))


_STEP = lambda k: f"""n{k} as (select y as node_id, {k} as distance, coalesce(m, 0) as m from (select distinct y from e join n{k - 1} on n{k - 1}.node_id = x where y not in (select node_id from n0{''.join(f' union all select node_id from n{i}' for i in range(1, k))})) z left join m on m.node_id = y order by m desc, node_id limit 12)"""


@query(
    f"""with w as (select a, b from {_EDGE} x where weight >= 0.49), e as materialized (select a as x, b as y from w union all select b, a from w), m as (select node_id, count(*) as m from {LINKS_SQL} l group by 1),
 n0 as (select p_partkey as node_id, 0 as distance, coalesce(m, 0) as m from part left join m on m.node_id = p_partkey where p_brand = 'Brand#11' and p_size > 40), {_STEP(1)}, {_STEP(2)}, {_STEP(3)}
 select node_id, distance, row_number() over (order by distance, m desc, node_id) as place from (select * from n0 union all select * from n1 union all select * from n2 union all select * from n3) u"""
)
def kg_expand_hops(spark, d):
    """K8: three steps over edges of two and more mentions, the 12 most mentioned new nodes of each."""
    seeds = table(spark, d, "part").where("p_brand = 'Brand#11' and p_size > 40").select(F.col("p_partkey").alias("node_id"))
    mentions = links(spark, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("mentions"))
    return G.expanded_hops(seeds, G.weighted(_pairs(spark, d)), mentions, 0.49, 3, 12).withColumn("place", F.col("place").cast("long"))


_R_NODES = "(select p_partkey as node_id, lower(concat(p_brand, '-', p_partkey % 700)) as slug, case when p_size > 25 then 'Topic' else 'Product' end as node_type, coalesce(m, 0) as mentions from part left join (select l_partkey, count(*) as m from lineitem where l_linenumber = 1 and l_partkey % 3 = 0 group by 1) x on l_partkey = p_partkey)"
_R_LINKS = "(select distinct l_orderkey as event_id, l_partkey as node_id from lineitem where l_linenumber = 1 and l_partkey % 3 = 0)"
_R_EDGES = "(select l_partkey as a, case when l_suppkey % 40 = 0 then l_partkey else (l_partkey + l_suppkey) % (select count(*) from part) + 1 end as b, least(1.0::double, max(l_quantity) / 50.0::double) as weight, max(l_shipdate) as seen from lineitem group by 1, 2)"


@query(
    f"""with n as materialized (select * from {_R_NODES} x), e as materialized (select *, datediff('day', seen::date, (select max(l_shipdate) from lineitem)::date) > 45 as stale from {_R_EDGES} x), k as (select slug, min(node_id) as keep, sum(mentions) as m, count(*) as c from n group by 1),
 t as (select node_id, keep from n join k using (slug)), ne as (select x.keep as a, y.keep as b, max(case when stale then greatest(0.05::double, weight * 0.92::double) else weight end) as weight from e join t x on x.node_id = a join t y on y.node_id = b where a <> b and x.keep <> y.keep group by 1, 2),
 nl as (select distinct event_id, keep as node_id from {_R_LINKS} l join t using (node_id)), o as (select keep as node_id from k join n on n.node_id = keep where node_type = 'Topic' and m <= 1 and keep not in (select node_id from nl))
 select (select count(*) from n) as old_nodes, (select count(*) from e) as old_edges, (select count(*) from e where stale) as decayed, (select count(*) from e where a = b) as self_edges, (select sum(c - 1) from k)::bigint as merged_duplicates, (select count(*) from o) as deleted,
 (select count(*) from k) - (select count(*) from o) as new_nodes, (select count(*) from ne where a not in (select node_id from o) and b not in (select node_id from o)) as new_edges, (select count(*) from nl) as new_links, (select round(sum(weight), 4) from ne where a not in (select node_id from o) and b not in (select node_id from o)) as weight"""
)
def kg_repair_report(spark, d):
    """Decay, self-edges, double slugs and orphan topics in one repair, with its report and the weight that is left."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    first = li.where("l_linenumber = 1 and l_partkey % 3 = 0")
    m = first.groupBy(F.col("l_partkey").alias("node_id")).agg(F.count(F.lit(1)).alias("m"))
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.lower(F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 700).cast("string"))).alias("slug"), F.when(F.col("p_size") > 25, "Topic").otherwise("Product").alias("node_type"))
    nodes = nodes.join(m, "node_id", "left").select("node_id", "slug", "node_type", F.coalesce("m", F.lit(0)).alias("mentions"))
    one = part.agg(F.count(F.lit(1)).alias("parts")).join(li.agg(F.max("l_shipdate").alias("now")))  # one row
    edges = li.join(F.broadcast(one)).groupBy(F.col("l_partkey").alias("a"), F.expr("if(l_suppkey % 40 = 0, l_partkey, (l_partkey + l_suppkey) % parts + 1)").alias("b"), "now")
    edges = edges.agg(F.least(F.lit(1.0), F.max(F.col("l_quantity").cast("double")) / 50.0).alias("weight"), F.max("l_shipdate").alias("seen"))
    _, e, _, report = G.maintained(nodes, edges, first.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("node_id")).distinct(), "datediff(cast(now as date), cast(seen as date)) > 45")
    return report.join(F.broadcast(e.agg(F.round(F.sum("weight"), 4).alias("weight"))))
