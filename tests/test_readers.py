"""Ordered folds over pages against plain loops."""

import random

from postloom.operators import readers as R


def test_collapsed(spark):
    r = random.Random(2)
    pages = [(str(p), k, p * 100 + k, r.randint(1, 5)) for p in range(4) for k in range(15)]
    near = [(p * 100 + a, p * 100 + b) for p in range(4) for a in range(15) for b in range(a + 1, 15) if r.random() < 0.1]
    wanted = set()
    for p in range(4):
        kept = []
        for lid, place, i, n in [x for x in pages if x[0] == str(p)]:
            hit = next((k for k in kept if (min(k[1], i), max(k[1], i)) in near), None)
            if hit is None:
                kept.append([place, i, n])
            elif n > hit[2]:
                hit[1:] = [i, n]
        wanted |= {(str(p), k[0], k[1]) for k in kept}
    got = R.collapsed(spark.createDataFrame(pages, "list_id string, place long, id long, sources long"), spark.createDataFrame(near, "a long, b long"))
    assert {tuple(x) for x in got.collect()} == wanted


def test_distinct_trends(spark):
    ranked = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "event_id long, place long")
    nodes = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 9), (5, 1)], "event_id long, node_id long")
    assert [x["event_id"] for x in R.distinct_trends(ranked, nodes, 10).orderBy("place").collect()] == [1, 3, 4, 5]
    assert R.distinct_trends(ranked, nodes, 2).count() == 2


def test_user_states_are_order_free(spark):
    log = spark.createDataFrame([(1, 5, "read", 1), (1, 5, "like", 2), (1, 5, "like", 3), (1, 5, "favorite", 4), (1, 5, "favorite", 5), (1, 6, "dislike", 6)], "user_id long, news_id long, action string, ts long")
    got = {x["news_id"]: x for x in R.user_states(log).collect()}
    assert got[5]["personal"] == 1.5 and got[5]["is_read"] and not got[5]["favorite"] and got[6]["personal"] == -2.0


def test_personal_window_and_page(spark):
    """Own words, themes, weights and page sizes against a plain loop; null titles and themes, repeated sources, users without settings."""
    import random

    from postloom.operators.readers import feed_page, feed_window

    r = random.Random(5)
    news = [(k, r.choice(["active", "active", "archived"]), r.choice([0.5, 2.0, 3.25, 7.5]), r.choice(["ai", "tech", None]), r.choice([None, "Red car", "blue CAR"]), r.choice([None, "fast"]), None, r.randint(0, 3)) for k in range(160)]
    sources = [(k, r.randint(0, 3)) for k in range(160) for _ in range(2)] + [(0, 0), (0, 0), (999, 1)]
    states = [(u, k, r.choice([1.5, -2.0, 0.0]), r.random() < 0.2, r.random() < 0.1) for u in (1, 2, 3) for k in range(0, 160, 3)]
    settings = [(1, 5, 0.0, ["ai", "tech", "other"], {"ai": 5, "tech": 1}, " BLUE ,"), (2, 12, 1.0, ["ai", "other"], None, None), (4, 3, 0.0, ["ai"], {}, "f_st"), (5, 3, 0.0, [], None, "")]
    subscriptions = [(u, c) for u in (1, 2, 3, 4, 5) for c in (0, 2)] + [(1, 2)]
    frame = spark.createDataFrame
    window = feed_window(
        frame(news, "event_id long, status string, importance double, theme string, title string, summary string, topic string, updated_at int"), frame(sources, "event_id long, channel_id int"),
        frame(states, "user_id long, news_id long, personal double, is_read boolean, disliked boolean"),
        frame(settings, "user_id long, page_size int, min_importance double, themes array<string>, weights map<string, int>, ignored string"), frame(subscriptions, "user_id long, channel_id int"), 3,
    )
    got = {(x["user_id"], x["place"]): (x["news_id"], x["score"], x["has_more"]) for x in feed_page(window, 3).collect()}
    wanted = {}
    for user, size, least, themes, weights, ignored in settings:
        words = [w.strip().lower() for w in (ignored or "").split(",") if w.strip()]
        own = {k: (p, read or bad) for u, k, p, read, bad in states if u == user}
        channels = {c for u, c in subscriptions if u == user}
        rows = []
        for k, status, imp, theme, title, summary, topic, at in news:
            texts = " ".join(x or "" for x in (title, summary, topic)).lower()
            hit = any(w in texts or (w == "f_st" and "fast" in texts) for w in words)
            p, gone = own.get(k, (0.0, False))
            if status == "active" and imp >= least and (theme or "other") in themes and not hit and not gone and any(e == k and c in channels for e, c in sources):
                rows.append((-(p + imp), -imp, -at, k, p + imp * (0.6 + 0.4 * ((weights or {}).get(theme or "other", 3) / 5))))
        rows = sorted(rows)[: max(4 * size, 40) + 3]
        ranked = sorted(((-round(x[4], 6), i, x[3]) for i, x in enumerate(rows)))
        for place, (score, _, k) in enumerate(ranked, 1):
            if 3 < place <= 3 + size:
                wanted[user, place] = (k, -score, len(ranked) > 3 + size)
    assert got == wanted and {u for u, _ in wanted} == {1, 2, 4} and {x[2] for x in wanted.values()} == {True}
    assert feed_page(window.where("false"), 3).count() == 0


def _most_rows(df):
    """The rows that come out of the widest operator of a query; runs it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = df.collect()

        def walk(node):
            n = node.metrics().get("numOutputRows")
            own = n.get().value() if n.isDefined() else 0
            return max([own, *(walk(node.children().apply(k)) for k in range(node.children().size()))])

        return got, walk(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


USERS, EVENTS = 40, 3_000


def _crowd(spark):
    """Many users of one channel with many events: news, states, subscriptions."""
    news = spark.range(EVENTS).selectExpr("id as event_id", "id % 2 as channel_id", "cast(id * 7919 % 1000 as double) / 100 + 1 as importance", "id % 5 + 1 as theme_no", "'active' as status", "id * 31 % 977 as created_at")
    states = spark.range(USERS * 30).selectExpr("id % 40 as user_id", "id div 40 * 97 as news_id", "if(id % 3 = 0, 1.5D, -2D) as personal", "id % 4 = 0 as is_read", "id % 7 = 0 as disliked", "false as favorite", "false as liked")
    return news, states, spark.range(USERS).selectExpr("id as user_id", "explode(array(0L, 1L, 5L)) as channel_id")


def test_feeds_are_not_users_times_events(spark):
    news, states, subs = _crowd(spark)
    events, said = [x.asDict() for x in news.collect()], {(x["user_id"], x["news_id"]): x for x in states.collect()}
    wanted = set()
    for u in range(USERS):
        rows = []
        for e in events:
            s = said.get((u, e["event_id"]))
            if s is None or not (s["is_read"] or s["disliked"]):
                rows.append((-round((s["personal"] if s else 0.0) + e["importance"] * (0.6 + 0.4 * e["theme_no"] / 5.0), 6), e["event_id"]))
        wanted |= {(u, i, k) for k, (_, i) in enumerate(sorted(rows)[:5], 1)}
    got, most = _most_rows(R.feed(news, states, subs, 5, 1.0))
    assert {(x["user_id"], x["news_id"], x["place"]) for x in got} == wanted and most < USERS * EVENTS / 4


def test_feed_sizes(spark):
    news, states, subs = _crowd(spark)
    got, most = _most_rows(R.feed_sizes(news, states, subs, 1.0))
    gone = states.where("is_read or disliked").join(news, news.event_id == states.news_id).groupBy("user_id").count().collect()
    assert {x["user_id"]: EVENTS - x["n"] for x in got} == {u: 0 for u in range(USERS)} | {x["user_id"]: x["count"] for x in gone} and most < USERS * EVENTS / 4


def test_overflow_reads_first_places_only(spark):
    news, states, subs = _crowd(spark)
    done = states.where("is_read").selectExpr("user_id", "news_id as event_id")
    got, most = _most_rows(R.overflow(news, subs, done, 60, 20))
    events, read = [x.asDict() for x in news.collect()], {(x["user_id"], x["event_id"]) for x in done.collect()}
    wanted = set()
    for u in range(USERS):
        recent = sorted((e for e in events if (u, e["event_id"]) not in read), key=lambda e: (-e["created_at"], -e["event_id"]))[:60]
        wanted |= {(u, e["event_id"], k) for k, e in enumerate(sorted(recent, key=lambda e: (-e["importance"], -e["created_at"], -e["event_id"])), 1) if k > 20}
    assert {(x["user_id"], x["event_id"], x["k"]) for x in got} == wanted and most < USERS * EVENTS / 4


def test_personal_window_reads_as_deep_as_it_must(spark, monkeypatch):
    """Words that hide nearly all events send a user to the lists' ends; the others read first places. Any depth gives the same rows."""
    news, states, subs = _crowd(spark)
    news = news.selectExpr("event_id", "status", "importance", "if(event_id % 3 = 0, 'ai', null) as theme", "if(event_id % 50 = 7, 'rare', 'common') as title", "'s' as summary", "null as topic", "created_at as updated_at")
    sources = spark.range(EVENTS).selectExpr("id as event_id", "id % 2 as channel_id").unionAll(spark.range(0, EVENTS, 4).selectExpr("id", "1L"))
    settings = spark.range(USERS).selectExpr("id as user_id", "3 as page_size", "1.5D as min_importance", "array('ai', 'other') as themes", "map('ai', 5) as weights", "if(id = 0, 'COMMON', null) as ignored")
    kept, cut = [], getattr(R, "cut", None)
    monkeypatch.setattr(R, "cut", lambda df: kept.append(cut(df)) or kept[-1], raising=False)
    got, most = _most_rows(R.feed_window(news, sources, states, settings, subs))
    assert max([most, *(x.count() for x in kept)]) < USERS * EVENTS / 4
    assert len([x for x in got if x["user_id"] == 0]) == 40 and len(kept) > 2
    monkeypatch.undo()
    assert sorted(got) == sorted(R.feed_window(news, sources, states, settings, subs, depth=2_000).collect())


def _readers_of_wide_nodes(spark):
    """60 users, who like some of 600 active events on 8 nodes (75 events and more each), and plain tables of them."""
    r = random.Random(3)
    news = {e: ("active" if e % 5 else "archived", r.randint(0, 40) / 4) for e in range(600)}
    links = sorted({(e, r.randint(0, 7)) for e in news for _ in range(r.randint(1, 2))})
    states = {(u, e): (r.random() < 0.3, False, r.random() < 0.2, r.random() < 0.1, r.randint(0, 2), r.randint(0, 99)) for u in range(60) for e in r.sample(range(600), 25)}
    frame = spark.createDataFrame
    rows = [(u, e, *x) for (u, e), x in states.items()]
    return news, links, states, (
        frame([(e, *x) for e, x in news.items()], "event_id long, status string, importance double"), frame(links, "event_id long, node_id long"),
        frame(rows, "user_id long, news_id long, liked boolean, favorite boolean, is_read boolean, disliked boolean, shown_count int, last_ts long"),
    )


def _first_unseen(news, links, states, user, nodes, top):
    seen = {e for (u, e), x in states.items() if u == user and (x[4] > 0 or x[3])}
    return sorted({(-news[e][1], e) for e, n in links if n in nodes and e not in seen and news[e][0] == "active"})[:top]


def test_recommended_reads_first_places_of_nodes(spark):
    """A plain loop's rows, with and without dealing by user; users do not meet all events of their nodes."""
    from collections import Counter

    news, links, states, frames = _readers_of_wide_nodes(spark)
    wanted = set()
    for user in range(60):
        counts = Counter(n for e, n in links if any(states.get((user, e), (False, False, False))[:3]))
        nodes = sorted(counts, key=lambda n: (-counts[n], n))[:6]
        wanted |= {(user, e, -i) for i, e in _first_unseen(news, links, states, user, nodes, 3)}
    for tasks in (None, 5):
        assert {tuple(x) for x in R.recommended(*frames, 6, 3, tasks=tasks).collect()} == wanted
    met = sum(len([1 for e, n in links if n == k and news[e][0] == "active"]) for k in range(8)) * 60 * 6 // 8
    most = _most_rows(R.recommended(*frames, 6, 3))[1]
    assert most < met // 2, (most, met)


def test_recommended_wide_reads_first_places_of_nodes(spark):
    """A plain loop's rows, with neighbours cut to the first few of a node."""
    from collections import Counter

    news, links, states, frames = _readers_of_wide_nodes(spark)
    m = Counter(n for _, n in links)
    of = {e: {n for x, n in links if x == e} for e in news}
    wanted = set()
    for user in range(60):
        lately = sorted((-x[5], e) for (u, e), x in states.items() if u == user and any(x[:3]))[:4]
        order = lambda ns, k: sorted(ns, key=lambda n: (-m[n], n))[:k]
        liked = order({n for _, e in lately for n in of[e]}, 2)
        around = order({b for a in liked for ns in of.values() if a in ns for b in ns} - set(liked), 2)
        wanted |= {(user, e, -i, "graph") for i, e in _first_unseen(news, links, states, user, {*liked, *around}, 3)}
    users = spark.range(60).withColumnRenamed("id", "user_id")
    for tasks in (None, 5):
        got = {tuple(x) for x in R.recommended_wide(*frames, users, 4, 2, 2, 3, 20, tasks=tasks).where("via = 'graph'").collect()}
        assert got == wanted and {u for u, *_ in got} == set(range(60))
    most = _most_rows(R.recommended_wide(*frames, users, 4, 2, 2, 3, 20).where("via = 'graph'"))[1]
    assert most < 60 * 4 * 60, most
