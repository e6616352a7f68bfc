"""The knowledge graph on small cases: names, nodes, edges, links, questions, timelines."""

from pyspark.sql import functions as F

from postloom.operators import graph as G
from postloom.operators import upkeep as U


def test_names_are_resolved(spark):
    raw = ["айфон 18 pro", "Open AI", "Tesla Model 3", "Quantum", "quantum computing", "Steam Deck OLED", "Blue Sky Labs", "GPT9"]
    got = {r["name"]: (r["canonical"], r["node_type"]) for r in G.resolved(spark, spark.createDataFrame([(x,) for x in raw], "name string")).collect()}
    assert got == {
        "айфон 18 pro": ("iPhone 18 Pro", "Product"), "Open AI": ("OpenAI", "Company"), "Tesla Model 3": ("Tesla", "Company"), "Quantum": ("Quantum", "Company"), "quantum computing": ("quantum computing", "Topic"),
        "Steam Deck OLED": ("Steam Deck", "Product"), "Blue Sky Labs": ("Blue Sky Labs", "Product"), "GPT9": ("GPT9", "Product"),
    }


def posts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_posts_become_nodes_and_edges(spark):
    n = G.event_nodes(spark, posts(spark, "we saw Apple there", "an apple and the iphone", None, "", "no names"))
    table = {r["slug"]: (r["name"], r["mentions"], r["aliases"]) for r in G.node_table(n).collect()}
    assert table == {"apple": ("Apple", 2, ["apple"]), "iphone": ("iPhone", 1, ["iphone"])}
    edges = {(r["a"], r["b"], r["edge_type"]): r["mentions"] for r in G.ingested_edges(spark, n).collect()}
    # Apple's own category AI is a known node; iPhone belongs to Apple; both directions once for the post that holds both
    assert edges == {
        ("apple", "iphone", "RELATED_TO"): 2, ("iphone", "apple", "RELATED_TO"): 1, ("iphone", "apple", "PART_OF"): 1, ("ai", "apple", "RELATED_TO"): 2, ("apple", "ai", "PART_OF"): 2,
    }


def test_repeated_posts_and_empty_tables(spark):
    none = G.event_nodes(spark, spark.createDataFrame([], "id long, text string"))
    assert none.count() == 0 and G.node_table(none).count() == 0 and G.ingested_edges(spark, none).count() == 0
    twice = spark.createDataFrame([(1, "Apple"), (1, "Apple")], "id long, text string")
    assert [r["mentions"] for r in G.node_table(G.event_nodes(spark, twice)).collect()] == [1]


def test_links_keep_the_higher_confidence(spark):
    stored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5)], "event_id long, node_id long, confidence double")
    found = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "event_id long, node_id long")
    assert {(r[0], r[1]): r[2] for r in G.linked(stored, found).collect()} == {(1, 1): 0.9, (1, 2): 0.75, (2, 1): 0.75}


def test_questions(spark):
    q = posts(spark, "news on iphone 18 pro and Apple", "what about harvest weather", None, "a b")
    got = {r["id"]: (r["names"], r["known"]) for r in G.query_nodes(spark, q).collect()}
    assert got == {0: (["iPhone 18 Pro", "iPhone 18", "iPhone", "Apple"], True), 1: (["harvest", "weather"], False), 2: ([], False), 3: ([], False)}
    asked = {r["id"]: r["asked"] for r in G.questions_about(G.query_nodes(spark, q), q).collect()}
    assert asked[1] == ["What's new with harvest?", "What's new with weather?"] and asked[2] == []


def test_timelines_keep_the_last_entries(spark):
    b = spark.range(1, 61).select(F.lit(7).alias("story"), F.col("id").alias("day"), F.when(F.col("id") == 59, 5).otherwise(1).alias("added"))
    entries = U.timelines(b, "story", "day", "added").first()["timeline"]
    assert len(entries) == 40 and [(e["kind"], e["sources"]) for e in entries[-3:]] == [("sources", 63), ("growth", 63), ("sources", 64)]
    assert [e["kind"] for e in U.timelines(b.where("day = 1"), "story", "day", "added").first()["timeline"]] == ["created"]


def test_related_counts_heavy_nodes_apart(spark):
    """Any bound between light and heavy nodes gives the same peers as counting all pairs; so do lists cut by node."""
    import random

    r = random.Random(12)
    links = sorted({(e, min(r.randint(0, 9), r.randint(0, 9), r.randint(0, 9))) for e in range(60) for _ in range(r.randint(0, 5))})
    nodes = {}
    for e, n in links:
        nodes.setdefault(e, set()).add(n)
    asked = [e for e in range(0, 70, 3)]
    want = {(e, p, len(nodes[e] & nodes[p])) for e in asked if e in nodes for p in sorted((p for p in nodes if p != e and nodes[e] & nodes[p]), key=lambda p: (-len(nodes[e] & nodes[p]), p))[:4]}
    df, ids = spark.createDataFrame(links + links[:5], "event_id long, node_id long"), spark.createDataFrame([(e,) for e in asked], "event_id long")
    for heavy in (0, 5, 12, 1_000):
        assert {tuple(x) for x in G.related(df, ids, 4, heavy).collect()} == want, heavy
    importance = {e: r.randint(0, 9) / 2 for e in range(60) if e % 7}
    got = {tuple(x) for x in G.important_peers(df, spark.createDataFrame(list(importance.items()), "event_id long, importance double"), 3).collect()}
    ranks = {(e, p, k) for e in nodes for k, p in enumerate(sorted((p for p in nodes if p != e and p in importance and nodes[e] & nodes[p]), key=lambda p: (-importance[p], p))[:3], 1)}
    assert got == ranks


def test_tasks_grow_with_the_table(spark, sf, monkeypatch):
    """Links and their pairs are dealt over tasks by the table's rows, and nothing is made distinct before, so a task's memory stays as it is."""
    from postloom.plans import graph_queries as Q
    from postloom.sources import tables as T

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.count()
    monkeypatch.setattr(T.tasks, "__defaults__", (500,))
    n = -(-rows // 500)
    assert n > spark.sparkContext.defaultParallelism and T.tasks(li) == n
    assert T.links(spark, sf).rdd.getNumPartitions() == n
    assert Q.kg_event_links(spark, sf).rdd.getNumPartitions() == n and Q._pairs(spark, sf).rdd.getNumPartitions() == 2 * n
    assert Q.kg_edge_decay(spark, sf).rdd.getNumPartitions() == 2 * n


def test_links_that_repeat_and_pairs_dealt(spark):
    stored = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.9), (1, 1, 0.9)], "event_id long, node_id long, confidence double")
    found = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 1)], "event_id long, node_id long")
    assert sorted(map(tuple, G.linked(stored, found, tasks=3).collect())) == [(1, 1, 0.9), (1, 2, 0.75), (2, 1, 0.75), (2, 2, 0.75)]
    assert [tuple(r) for r in G.cooccurrence(found.distinct(), tasks=3).collect()] == [(1, 2, 2)]


def _most_shuffled(df):
    """Rows of a query, and the rows of its widest exchange; runs it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = df.collect()

        def walk(node):
            n = node.metrics().get("shuffleRecordsWritten")
            own = n.get().value() if n.isDefined() else 0
            return max([own, *(walk(node.children().apply(k)) for k in range(node.children().size()))])

        return got, walk(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _dense(spark):
    """400 events on 20 nodes, two or three each; importance, with doubles and without some."""
    import random

    r = random.Random(8)
    links = sorted({(e, r.randint(0, 19)) for e in range(400) for _ in range(3)})
    importance = {e: r.choice([None, *range(12)]) for e in range(400) if e % 9}
    nodes = {}
    for e, n in links:
        nodes.setdefault(e, set()).add(n)
    return links, nodes, importance, spark.createDataFrame(links, "event_id long, node_id long")


def test_important_peers_shuffle_links_not_pairs(spark):
    """A link is shuffled with its node's peers as one row; ties go by id, events without importance come last."""
    links, nodes, importance, df = _dense(spark)
    events = spark.createDataFrame([(e, None if i is None else float(i)) for e, i in importance.items()], "event_id long, importance double")
    order = lambda p: (importance[p] is None, -(importance[p] or 0), p)
    want = {(e, p, k) for e in nodes for k, p in enumerate(sorted((p for p in nodes if p != e and p in importance and nodes[e] & nodes[p]), key=order)[:6], 1)}
    for tasks in (None, 3):
        got, most = _most_shuffled(G.important_peers(df, events, 6, tasks))
        assert {tuple(x) for x in got} == want
        assert most <= len(links), (most, len(links))


def test_related_shuffles_first_events_of_nodes(spark):
    """Events that share one node are read from its first few, others by pairs of nodes; light and heavy nodes mixed, with and without dealing, null ids, events without links."""
    links, nodes, _, df = _dense(spark)
    asked = [*range(0, 500, 2)]
    ids = spark.createDataFrame([(e,) for e in asked], "event_id long")
    shared = {e: {p: len(nodes[e] & nodes[p]) for p in nodes if p != e and nodes[e] & nodes[p]} for e in asked if e in nodes}
    want = {(e, p, n[p]) for e, n in shared.items() for p in sorted(n, key=lambda p: (-n[p], p))[:5]}
    odd = df.unionAll(spark.createDataFrame([(None, 1), (1, None), (None, None)], "event_id long, node_id long"))
    for heavy, tasks in ((1_000, None), (1_000, 3), (57, 3), (0, None)):
        assert {tuple(x) for x in G.related(odd, ids, 5, heavy, tasks=tasks).collect()} == want, heavy
    got, most = _most_shuffled(G.related(df, ids, 5))
    assert len(got) == len(want) and most < sum(map(len, shared.values())) // 2, most
