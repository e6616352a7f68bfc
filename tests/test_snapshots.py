"""Rebuilds that stop and resume, repairs, hops and ordered states against plain loops."""

import random

import pytest

from postloom.operators import graph as G
from postloom.operators import readers as R
from postloom.plans.graph_queries import graph_stages
from postloom.sources.snapshots import Snapshots


def test_stopped_rebuild_resumes_and_swaps_when_whole(spark, tmp_path):
    posts = spark.createDataFrame([(1, "Apple представила iPhone вместе с OpenAI"), (2, "OpenAI and Microsoft"), (3, None), (4, "NVIDIA «Новый чип»")], "id long, text string")
    ran = []
    stages = [(name, lambda read, n=name, f=f: ran.append(n) or f(read)) for name, f in graph_stages(spark, posts)]
    names = [n for n, _ in stages]
    store, whole = Snapshots(spark, f"file://{tmp_path}/a"), Snapshots(spark, f"file://{tmp_path}/b")
    with pytest.raises(LookupError):
        store.read("nodes")
    for k, name in enumerate(names):
        assert store.rebuild(stages, stop=lambda n, at=name: n == at) is None and store.current() is None and store.stages(0) == sorted(names[:k], key=store.stages(0).index)
    assert store.rebuild(stages) == 0 and ran == names and store.current() == 0
    assert whole.rebuild(stages) == 0
    for table in ("nodes", "edges", "links", "seeds"):
        assert sorted(map(str, store.read(table).collect())) == sorted(map(str, whole.read(table).collect())) and whole.read(table).count() > 0
    fewer = graph_stages(spark, posts.where("id = 1"))
    broken = [*fewer[:2], ("nodes", lambda read: 1 / 0)]
    with pytest.raises(ZeroDivisionError):
        store.rebuild(broken)
    assert store.current() == 0 and store.read("links").count() == whole.read("links").count()  # readers see the old version
    assert store.rebuild(fewer) == 1 and store.read("links").count() < whole.read("links").count()
    store.forget(keep=1)
    assert store.current() == 1 and store._names("finished") == ["1"]


def test_hops(spark):
    r = random.Random(1)
    edges = [(a, b, r.choice([0.2, 0.5])) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.1]
    mentions = {n: r.randint(1, 3) for n in range(35)}
    seen, frontier = {3: 0, 8: 0, 99: 0}, [3, 8, 99]
    for step in (1, 2, 3):
        new = {y for a, b, w in edges if w >= 0.3 for x, y in ((a, b), (b, a)) if x in frontier} - set(seen)
        frontier = sorted(new, key=lambda n: (-mentions.get(n, 0), n))[:4]
        seen |= dict.fromkeys(frontier, step)
    want = sorted(seen, key=lambda n: (seen[n], -mentions.get(n, 0), n))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = G.expanded_hops(df([(3,), (8,), (99,), (3,)], "node_id long"), df(edges, "a long, b long, weight double"), df(list(mentions.items()), "node_id long, mentions long"), 0.3, 3, 4).orderBy("place").collect()
    assert [(x["node_id"], x["distance"]) for x in got] == [(n, seen[n]) for n in want] and len(want) > 6
    assert G.expanded_hops(df([], "node_id long"), df(edges, "a long, b long, weight double"), df([], "node_id long, mentions long"), 0.3, 2, 4).count() == 0


def test_repair(spark):
    nodes = spark.createDataFrame([(1, "x", "Topic", 1), (2, "x", "Topic", 1), (3, "y", "Topic", 1), (4, "z", "Company", 0), (5, "w", "Topic", 1)], "node_id long, slug string, node_type string, mentions long")
    edges = spark.createDataFrame([(1, 2, 0.9, True), (1, 4, 0.5, True), (2, 4, 0.4, False), (3, 4, 0.7, False), (4, 4, 0.3, False), (5, 1, 0.05, True)], "a long, b long, weight double, stale boolean")
    links = spark.createDataFrame([(10, 2), (10, 1), (11, 5)], "event_id long, node_id long")
    n, e, new_links, report = G.maintained(nodes, edges, links, "stale")
    assert {tuple(x) for x in n.collect()} == {(1, "x", "Topic", 2), (4, "z", "Company", 0), (5, "w", "Topic", 1)}
    assert {(x["a"], x["b"], round(x["weight"], 3)) for x in e.collect()} == {(1, 4, 0.46), (5, 1, 0.05)}
    assert {tuple(x) for x in new_links.collect()} == {(10, 1), (11, 5)}
    assert report.first().asDict() == {"old_nodes": 5, "old_edges": 6, "decayed": 3, "self_edges": 1, "merged_duplicates": 1, "deleted": 1, "new_nodes": 3, "new_edges": 2, "new_links": 2}


def test_ordered_states_equal_a_loop(spark):
    r = random.Random(4)
    log = [(u, n, r.choice(["read", "like", "dislike", "favorite", "shown", "remove"]), r.randint(0, 9), k) for k in range(400) for u, n in [(r.randint(0, 4), r.randint(0, 9))]]
    states = {}
    for u, n, a, _, _ in sorted(log, key=lambda x: (x[3], x[4])):
        s = states.setdefault((u, n), {"is_read": False, "liked": False, "hidden": False, "favorite": False, "shown_count": 0, "personal": 0.0})
        if a in ("read", "dislike"):
            s["is_read"], s["shown_count"] = True, max(s["shown_count"], 1)
        if a == "dislike":
            s["hidden"], s["liked"], s["personal"] = True, False, s["personal"] - 2
        elif a == "like":
            s["personal"] += 0 if s["liked"] else 1.5
            s["liked"], s["hidden"], s["is_read"] = True, False, True
        elif a == "favorite":
            s["favorite"] = not s["favorite"]
        elif a == "shown":
            s["shown_count"] += 1
        elif a == "remove":
            s["is_read"] = False
    got = {(x["user_id"], x["news_id"]): x.asDict() for x in R.ordered_states(spark.createDataFrame(log, "user_id long, news_id long, action string, ts long, action_id long")).collect()}
    assert {k: {c: v[c] for c in states[k]} for k, v in got.items()} == states
    assert all(v["visible"] == (not v["is_read"] and not v["hidden"]) for v in got.values())


def test_wide_recommendations_fall_back(spark):
    news = spark.createDataFrame([(1, 5.0, "active"), (2, 4.0, "active"), (3, 3.0, "merged"), (4, 2.0, "active"), (5, 1.0, "active")], "event_id long, importance double, status string")
    links = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (1, 8), (5, 9)], "event_id long, node_id long")
    states = R.user_states(spark.createDataFrame([(1, 5, "read", 1), (2, 2, "like", 1), (2, 1, "shown", 2), (3, 1, "dislike", 1)], "user_id long, news_id long, action string, ts long"))
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    got = {}
    for x in R.recommended_wide(news, links, states, users, top=2).collect():
        got.setdefault(x["user_id"], []).append((-x["importance"], x["event_id"], x["via"]))
    named = {u: [(e, v) for _, e, v in sorted(x)] for u, x in got.items()}
    assert named == {1: [(5, "graph")], 2: [(2, "graph"), (4, "graph")], 3: [(2, "feed"), (4, "feed")], 4: [(1, "feed"), (2, "feed")]}
