"""The knowledge graph: alias scan, nodes, co-occurrence edges, expansion, related events, decay, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import expressions as E
from ..functions import vocab as V
from .upkeep import ordered_union


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, name, node_type, ord): a fixed, small table."""
    return spark.createDataFrame([(a, n, t, i) for i, (a, n, t) in enumerate(V.ALIASES)], "alias string, name string, node_type string, ord int")


def mentioned_nodes(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """(id, name, node_type): nodes one of whose aliases of three letters or more stands in the lower-case text."""
    low = posts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    hits = low.join(F.broadcast(alias_table(spark).where("length(alias) >= 3")), F.expr("contains(low, alias)"))
    return hits.select("id", "name", "node_type").distinct()


def resolved(spark: SparkSession, names: DataFrame) -> DataFrame:
    """(name, canonical, node_type) of raw names: exact alias, else longest alias inside, else by shape: a product with digits or
    several words, a company of one word, a topic without capitals."""
    a = F.broadcast(alias_table(spark))
    n = names.select("name").distinct().withColumn("low", F.lower(F.trim("name")))
    exact = n.join(a.select(F.col("alias").alias("low"), F.col("name").alias("e_name"), F.col("node_type").alias("e_type")), "low", "left")
    inside = n.join(a.where("length(alias) >= 3").select("alias", F.col("name").alias("i_name"), F.col("node_type").alias("i_type"), "ord"), F.expr("contains(low, alias)")).groupBy("name").agg(
        F.max_by(F.struct("i_name", "i_type"), F.struct(F.length("alias"), -F.col("ord"))).alias("best")
    )
    shape = "case when regexp_like(name, '[0-9]') then 'Product' when not regexp_like(name, '\\\\p{Lu}') then 'Topic' when length(name) <= 16 and not regexp_like(name, '\\\\s') then 'Company' else 'Product' end"
    return exact.join(inside, "name", "left").select("name", F.coalesce("e_name", "best.i_name", "name").alias("canonical"), F.coalesce(F.col("e_type"), F.col("best.i_type"), F.expr(shape)).alias("node_type"))


def cooccurrence(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(a, b, mentions), a < b: nodes of one event (events mention few nodes, so pairs are few). tasks: over how many tasks pairs are dealt before they are
    counted, where nearly all are distinct, so that counts before the shuffle would only take memory; None: counted before and after it."""
    pairs = met(links, links)
    return (pairs.repartition(tasks, "a", "b") if tasks else pairs).groupBy("a", "b").agg(F.count(F.lit(1)).alias("mentions"))


def met(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b), a < b, once for each event of x and y (event_id, node_id) that mentions both, with x's other columns. Sides are sorted, never held or broadcast."""
    x, y = x.withColumnRenamed("node_id", "a"), y.select("event_id", F.col("node_id").alias("b"))
    return x.join(y.hint("merge"), "event_id").where("a < b")


def weighted(pairs: DataFrame) -> DataFrame:
    """Edge weights of repeated mentions in closed form: each after the first adds 0.04 (confidence 0.03), up to 1."""
    return pairs.withColumn("weight", F.least(F.lit(1.0), 0.45 + 0.04 * (F.col("mentions") - 1))).withColumn("confidence", F.least(F.lit(1.0), 0.55 + 0.03 * (F.col("mentions") - 1)))


def expanded(seeds: DataFrame, edges: DataFrame, strong: float) -> DataFrame:
    """(node_id, distance): seeds at 0, their neighbours over strong edges at 1."""
    e = edges.where(F.col("weight") >= strong)
    both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = both.join(seeds.select(F.col("node_id").alias("x")), "x").select(F.col("y").alias("node_id"), F.lit(1).alias("distance"))
    return seeds.select("node_id", F.lit(0).alias("distance")).unionAll(near).groupBy("node_id").agg(F.min("distance").alias("distance"))


def related(links: DataFrame, event_ids: DataFrame, top: int = 12, heavy: int = 1_000, tasks: int | None = None) -> DataFrame:
    """(event_id, peer, shared): for each given event the top events that share most nodes, the smaller ids first among equals.

    If an event shares just the set S of nodes with one of its top, that one is among the top + 1 smallest ids of all events that mention S, because those before it share S
    too. So of a single node only its first top + 1 events are looked at: they come with each of its events as one row, and of an event's only the first top stay. Events that
    share two or more light nodes are found by pairs of nodes, which few events have in common. Nodes of more than heavy events never meet themselves: every set of an event's
    heavy nodes (there are few), alone and with one of its light nodes, is a key whose events are cut to top + 1, before the shuffle already. What a cut leaves out is
    counted too low at most, and is not among the top. tasks: over how many tasks links are dealt by event; pairs of nodes over twice as many.
    """
    dealt = lambda df, n, *by: df.repartition(n * tasks, *by) if tasks else df
    asked = event_ids.select("event_id").distinct().withColumn("asked", F.lit(True))
    named = links.select("event_id", "node_id").distinct().where("event_id is not null and node_id is not null").join(asked, "event_id", "left")
    named = dealt(named, 1, "node_id")
    hot = named.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("node_id", F.lit(True).alias("hot"))
    tagged, light = named.join(hot, "node_id", "left"), F.col("hot").isNull()
    of_node = Window.partitionBy("node_id", F.when(~light, F.col("event_id")))  # a heavy node's events lie apart
    tagged = tagged.withColumn("r", F.row_number().over(of_node.orderBy("event_id")))
    tagged = tagged.withColumn("first", F.collect_list(F.when(F.col("r") <= top + 1, F.col("event_id"))).over(of_node.orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = dealt(tagged.select("event_id", "node_id", light.alias("light"), F.coalesce("asked", F.lit(False)).alias("asked"), F.when(light & F.col("asked"), F.col("first")).alias("first")), 1, "event_id")
    events = rows.groupBy("event_id").agg(
        F.first("asked").alias("asked"), F.sort_array(F.collect_list(F.when(F.col("light"), F.col("node_id")))).alias("light"), F.sort_array(F.collect_list(F.when(~F.col("light"), F.col("node_id")))).alias("heavy"),
        F.flatten(F.collect_list("first")).alias("first"),
    )
    ones = F.slice(F.sort_array(F.array_except("first", F.array("event_id"))), 1, top)
    events = cut(events.select("event_id", "asked", "light", "heavy", ones.alias("ones")))  # read four times

    pairs = events.where("size(light) > 1").select("event_id", "asked", "heavy", F.explode(F.expr("flatten(transform(light, (x, i) -> transform(slice(light, i + 2, size(light)), y -> struct(x as a, y as b))))")).alias("p"))
    held = dealt(pairs.select("p.a", "p.b", F.struct("event_id", "asked", "heavy").alias("e")), 2, "a", "b").groupBy("a", "b").agg(F.collect_list("e").alias("es")).where("size(es) > 1")
    met = held.select("es", F.explode("es").alias("x")).where("x.asked").select("x", F.explode("es").alias("y")).where("x.event_id <> y.event_id")
    met = met.groupBy(F.col("x.event_id").alias("e"), F.col("y.event_id").alias("peer")).agg(F.count(F.lit(1)).alias("c"), F.first(F.size(F.array_intersect("x.heavy", "y.heavy"))).alias("h"))
    found = met.select("e", "peer", (F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2) + F.col("h")).cast("long").alias("shared"))  # c = n (n - 1) / 2 pairs of n nodes

    subsets = F.explode(F.expr("transform(sequence(1, cast(shiftleft(1, size(heavy)) as int) - 1), m -> filter(heavy, (x, i) -> shiftright(m, i) % 2 = 1))"))
    keyed = events.where("size(heavy) > 0").select("event_id", "asked", "light", subsets.alias("some"))
    keyed = keyed.select("event_id", "asked", F.explode(F.expr("concat(array(some), transform(light, x -> concat(some, array(x))))")).alias("key"))
    few = keyed.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("event_id"))).where(F.col("r") <= top + 1).select("key", F.col("event_id").alias("peer"))
    more = keyed.where("asked").select(F.col("event_id").alias("e"), "key").join(few, "key").where("e <> peer").select("e", "peer", F.size("key").cast("long").alias("shared"))
    found = found.unionAll(more).groupBy("e", "peer").agg(F.max("shared").alias("shared"))
    found = found.groupBy("e").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", F.negative("peer").alias("minus"))), asc=False), 1, top).alias("found"))

    all_ = events.where("asked").join(found, F.col("event_id") == F.col("e"), "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<shared:bigint,minus:bigint>>)")))
    rest = F.transform(F.array_except("ones", F.transform("found", lambda x: -x["minus"])), lambda p: F.struct(F.lit(1).cast("long").alias("shared"), F.negative(p).alias("minus")))
    best = F.slice(F.sort_array(F.concat("found", rest), asc=False), 1, top)
    return all_.select("event_id", F.explode(best).alias("x")).select("event_id", F.negative("x.minus").alias("peer"), "x.shared")


def decayed(edges: DataFrame, stale: str, factor: float = 0.92, least: float = 0.05) -> DataFrame:
    """Weights of stale edges times factor, not below least."""
    return edges.withColumn("weight", F.when(F.expr(stale), F.greatest(F.lit(least), F.col("weight") * factor)).otherwise(F.col("weight")))


def merged_slugs(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges (a, b, weight) rewired to the smallest node of each slug; self-edges go, doubles keep the largest weight. tasks: as in `cooccurrence`."""
    keep = nodes.groupBy("slug").agg(F.min("node_id").alias("keep"))
    to = nodes.join(keep, "slug").select("node_id", "keep")
    e = edges.join(to.select(F.col("node_id").alias("a"), F.col("keep").alias("ka")), "a").join(to.select(F.col("node_id").alias("b"), F.col("keep").alias("kb")), "b")
    e = e.where("ka <> kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "weight")
    return (e.repartition(tasks, "a", "b") if tasks else e).groupBy("a", "b").agg(F.max("weight").alias("weight"))


def slugs(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("p_partkey").alias("node_id"), F.expr(E.slug("p_name")).alias("slug"))


def scanned_aliases(spark: SparkSession, posts: DataFrame, cap: int = 12) -> DataFrame:
    """(id, name, node_type): nodes of the longest cap aliases of three letters or more in the text."""
    low = posts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    hits = low.join(F.broadcast(alias_table(spark).where("length(alias) >= 3")), F.expr("contains(low, alias)")).drop("low")
    w = Window.partitionBy("id").orderBy(F.desc(F.length("alias")), "ord")
    return hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).select("id", "name", "node_type").distinct()


def event_nodes(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """(id, slug, raw, name, node_type) of each post: its light entities, resolved, and the aliases in its text. A name is resolved
    once, however many posts hold it. At most 24 rows a post; posts without names have none."""
    raw = cut(posts.select("id", F.explode(F.expr(E.light_entities("text"))).alias("raw")).where("length(trim(raw)) >= 2 and regexp_like(raw, '[A-Za-zА-Яа-я]')"))  # read twice
    known = resolved(spark, raw.select(F.col("raw").alias("name"))).select(F.col("name").alias("raw"), F.col("canonical").alias("name"), "node_type")
    found = raw.join(known, "raw").select("id", "raw", "name", "node_type").unionByName(scanned_aliases(spark, posts).withColumn("raw", F.col("name")))
    return found.select("id", F.expr(E.slug("name")).alias("slug"), F.lower("raw").alias("raw"), "name", "node_type").distinct()


def node_table(nodes: DataFrame, cap: int = 48) -> DataFrame:
    """(slug, name, node_type, mentions, aliases): one row a slug, named as in its first post; the first cap aliases."""
    about = nodes.groupBy("slug").agg(F.min(F.struct("id", "name", "node_type")).alias("f"), F.count_distinct("id").alias("mentions"))
    return about.join(ordered_union(nodes, "slug", "raw", "id", cap), "slug").select("slug", "f.name", "f.node_type", "mentions", F.col("names").alias("aliases"))


def category_table(spark: SparkSession) -> DataFrame:
    """(slug, parent): a fixed, small table of what the known nodes belong to."""
    rows = [(n, c) for n, cs in V.CATEGORIES.items() for c in cs]
    return spark.createDataFrame(rows, "name string, category string").select(F.expr(E.slug("name")).alias("slug"), F.expr(E.slug("category")).alias("parent"))


def ingested_edges(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(a, b, edge_type, mentions): both directions between nodes of one post, and, for each post of a node, RELATED_TO from what it
    belongs to and PART_OF back, where that is a node of the graph (a known one, or one of any post). No edge from a node to itself."""
    own = cut(nodes.select("id", "slug").distinct())  # read four times
    pairs = own.alias("x").join(own.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.slug") != F.col("y.slug")))
    met = pairs.groupBy(F.col("x.slug").alias("a"), F.col("y.slug").alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("edge_type", F.lit("RELATED_TO"))
    seeded = alias_table(spark).select(F.expr(E.slug("name")).alias("parent"))
    parents = category_table(spark).where("slug <> parent")
    parents = parents.join(seeded.unionAll(own.join(F.broadcast(parents.select(F.col("parent").alias("slug")).distinct()), "slug", "left_semi").select(F.col("slug").alias("parent"))), "parent", "left_semi")
    up = own.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(parents), "slug")
    down = up.select(F.col("parent").alias("a"), F.col("slug").alias("b"), "n", F.lit("RELATED_TO").alias("edge_type"))
    part = up.select(F.col("slug").alias("a"), F.col("parent").alias("b"), "n", F.lit("PART_OF").alias("edge_type"))
    return met.unionByName(down).unionByName(part).groupBy("a", "b", "edge_type").agg(F.sum("n").alias("mentions"))


def linked(stored: DataFrame, found: DataFrame, confidence: float = 0.75, tasks: int | None = None) -> DataFrame:
    """(event_id, node_id, confidence): one row a link, however often it is in either; a stored one keeps the higher confidence. stored: (event_id, node_id, confidence).
    tasks: over how many tasks the rows are dealt by event first, where most links are distinct."""
    both = stored.unionByName(found.select("event_id", "node_id", F.lit(confidence).alias("confidence")))
    return (both.repartition(tasks, "event_id") if tasks else both).groupBy("event_id", "node_id").agg(F.max("confidence").alias("confidence"))


def query_nodes(spark: SparkSession, questions: DataFrame, top: int = 5) -> DataFrame:
    """(id, names, known) of questions (id, text): the nodes of their aliases, longest alias first, each once; without any, their
    first top significant words of four letters or more. The graph is only read. Questions without either have no names."""
    q = questions.select("id", F.coalesce("text", F.lit("")).alias("text"))
    hits = q.select("id", F.lower("text").alias("low")).join(F.broadcast(alias_table(spark).where("length(alias) >= 3")), F.expr("contains(low, alias)"))
    best = hits.groupBy("id", "name").agg(F.min(F.struct(-F.length("alias"), "ord")).alias("at"))
    named = best.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("nodes"))
    tokens = F.expr(f"slice(filter({E.significant_tokens('text')}, t -> length(t) >= 4), 1, {top})")
    return q.join(named, "id", "left").select("id", F.coalesce("nodes", tokens).alias("names"), F.col("nodes").isNotNull().alias("known"))


def questions_about(names: DataFrame, texts: DataFrame, width: int = 6, top: int = 5) -> DataFrame:
    """(id, asked): follow-up questions on the first width names of each question, without the question itself, at most top."""
    rows = names.join(texts.select("id", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("low")), "id")
    forms = F.expr(f"array_distinct(filter(transform(slice(names, 1, {width}), n -> concat('What\\'s new with ', n, '?')), x -> lower(x) <> low))")
    return rows.select("id", F.slice(forms, 1, top).alias("asked"))


def shared_gate(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, shared, ok) of pairs of events: whether they share a node, or one of them has none. links: (event_id, node_id), each once."""
    n = links.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    x, y = links.select(F.col("event_id").alias("a"), "node_id"), links.select(F.col("event_id").alias("b"), "node_id")
    both = pairs.join(x, "a").join(y, ["b", "node_id"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    p = pairs.join(both, ["a", "b"], "left").join(n.select(F.col("event_id").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("event_id").alias("b"), F.col("n").alias("nb")), "b", "left")
    return p.select("a", "b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), (F.col("shared").isNotNull() | F.col("na").isNull() | F.col("nb").isNull()).alias("ok"))


def expanded_hops(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, strong: float, hops: int, most: int) -> DataFrame:
    """(node_id, distance, place): seeds (node_id) at 0, and behind them the nodes that strong edges (a, b, weight) reach in up to hops steps; of each step's
    new nodes the most mentioned are kept and followed, most of them at most, ties by id. In order of distance, then mentions (node_id, mentions). Each step joins
    the edges with one frontier of at most most nodes; its result is cut off in the shared folder, as are the strong edges, which are so derived once."""
    e = cut(edges.where(F.col("weight") >= strong).select("a", "b", "weight"))
    both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    found = cut(seeds.select("node_id").distinct().join(mentions, "node_id", "left").select("node_id", F.lit(0).alias("distance"), F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions")))
    frontier = found
    for step in range(1, hops + 1):
        near = both.join(frontier.select(F.col("node_id").alias("x")), "x").select(F.col("y").alias("node_id")).distinct().join(found, "node_id", "left_anti")
        near = near.join(mentions, "node_id", "left").select("node_id", F.lit(step).alias("distance"), F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))
        frontier = cut(near.orderBy(F.desc("mentions"), "node_id").limit(most))
        found = found.unionAll(frontier)
        if frontier.isEmpty():
            break
    # seeds and hops * most nodes
    return found.withColumn("place", F.row_number().over(Window.orderBy("distance", F.desc("mentions"), "node_id"))).select("node_id", "distance", "place")


def maintained(nodes: DataFrame, edges: DataFrame, links: DataFrame, stale: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, links, report) of a repair: stale edges decay, edges from a node to itself go, nodes of one slug become the one of the smallest id with all
    mentions, and topics of at most one mention without links go with their edges. nodes: (node_id, slug, node_type, mentions); edges: (a, b, weight, ...); links:
    (event_id, node_id). Doubles that arise keep the larger weight. report is one row of counts."""
    keep = nodes.groupBy("slug").agg(F.min("node_id").alias("keep"), F.sum("mentions").alias("all"), F.count(F.lit(1)).alias("n"))
    to = cut(nodes.join(keep, "slug").select("node_id", "keep"))
    e = decayed(edges.where("a <> b"), stale)
    e = e.join(to.select(F.col("node_id").alias("a"), F.col("keep").alias("ka")), "a").join(to.select(F.col("node_id").alias("b"), F.col("keep").alias("kb")), "b")
    e = e.where("ka <> kb").groupBy(F.col("ka").alias("a"), F.col("kb").alias("b")).agg(F.max("weight").alias("weight"))
    new_links = links.join(to, "node_id").select("event_id", F.col("keep").alias("node_id")).distinct()
    whole = nodes.join(keep.select("slug", F.col("keep").alias("node_id"), "all"), ["slug", "node_id"]).select("node_id", "slug", "node_type", F.col("all").alias("mentions"))
    orphans = cut(whole.where("node_type = 'Topic' and mentions <= 1").join(new_links.select("node_id"), "node_id", "left_anti").select("node_id"))
    new_nodes = whole.join(orphans, "node_id", "left_anti")
    new_edges = e.join(orphans.select(F.col("node_id").alias("a")), "a", "left_anti").join(orphans.select(F.col("node_id").alias("b")), "b", "left_anti")
    n = F.count(F.lit(1))
    counts = [
        nodes.agg(n.alias("old_nodes")), edges.agg(n.alias("old_edges"), F.count_if(F.expr(stale)).alias("decayed"), F.count_if(F.col("a") == F.col("b")).alias("self_edges")),
        keep.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged_duplicates")), orphans.agg(n.alias("deleted")), new_nodes.agg(n.alias("new_nodes")), new_edges.agg(n.alias("new_edges")), new_links.agg(n.alias("new_links")),
    ]
    report = counts[0]
    for c in counts[1:]:  # one row each
        report = report.join(F.broadcast(c))
    return new_nodes, new_edges, new_links, report


def important_peers(links: DataFrame, events: DataFrame, top: int, tasks: int | None = None) -> DataFrame:
    """(event_id, peer, k): for each event the top events (event_id, importance) that share a node with it, the most important first. Of a node only its top + 1 events can
    be among them, so each node is cut to those before it meets its events: a node that a third of all events mention gives top + 1 peers an event, not all pairs. A node's
    peers are one row for each of its events, shuffled once, by event. tasks: over how many tasks they are dealt."""
    named = links.select("event_id", "node_id").distinct()
    w = Window.partitionBy("node_id").orderBy(F.desc("importance"), "event_id")
    best = named.join(events, "event_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1)
    best = best.groupBy("node_id").agg(F.collect_list(F.struct("importance", F.negative("event_id").alias("minus"))).alias("best"))
    met = named.join(best, "node_id").select("event_id", F.col("best.importance").alias("importance"), F.col("best.minus").alias("minus"))
    met = (met.repartition(tasks, "event_id") if tasks else met).groupBy("event_id").agg(F.flatten(F.collect_list(F.arrays_zip("importance", "minus"))).alias("met"))
    others = F.array_distinct(F.filter("met", lambda x: x["minus"] != -F.col("event_id")))
    first = F.slice(F.sort_array(others, asc=False), 1, top)  # importance falls, ids rise
    return met.select("event_id", F.posexplode(first)).select("event_id", F.negative("col.minus").alias("peer"), (F.col("pos") + 1).alias("k"))


def upserted(stored: DataFrame, mentions: DataFrame, first: float = 0.45, step: float = 0.04) -> DataFrame:
    """(a, b, bumps, weight) after every mention (a, b, given) of an edge in turn: the first makes one of weight first where none is stored (a, b, weight), each other adds
    step, up to 1; given, where one has it, is the least weight to start from. No edge from a node to itself. In closed form, so mentions are counted before the shuffle."""
    u = mentions.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("bumps"), F.max("given").alias("given"))
    e = stored.where("a <> b").join(u, ["a", "b"], "full")
    n = F.coalesce("bumps", F.lit(0))
    start = F.greatest(F.coalesce("weight", F.lit(first)), F.coalesce("given", F.lit(0.0)))
    weight = F.least(F.lit(1.0), start + step * (n - F.when(F.col("weight").isNull(), 1).otherwise(0)))
    return e.select("a", "b", n.alias("bumps"), weight.alias("weight"))
