"""What readers see: states, feeds, favourites, trends, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def user_states(actions: DataFrame) -> DataFrame:
    """One row per user and event from the log of actions: flags, counts, personal score (+1.5 for the first like, -2 a dislike)
    and whether it is a favourite (each action turns it). Order-free sums, so partial aggregation applies."""
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.groupBy("user_id", "news_id").agg(
        (n("read") > 0).alias("is_read"), (n("like") > 0).alias("liked"), (n("dislike") > 0).alias("disliked"), (n("favorite") % 2 == 1).alias("favorite"), n("shown").alias("shown_count"),
        (F.when(n("like") > 0, 1.5).otherwise(0.0) - 2.0 * n("dislike")).alias("personal"), F.max("ts").alias("last_ts"),
    )


def ordered_states(actions: DataFrame) -> DataFrame:
    """One row per user and event from a log of actions (user_id, news_id, action, ts, action_id) in which order counts: reading, liking and disliking make an event read,
    removal from the history undoes that; a dislike hides the event and takes the like back, a like shows it again; each favourite turns it.
    The personal score gains 1.5 by a like that is none yet and loses 2 by each dislike. Reading an event that was never shown counts as shown once. visible: neither read,
    hidden nor disliked. Last values are aggregated before the shuffle; only likes and dislikes are looked at in order."""
    order = F.struct("ts", "action_id")
    is_ = lambda *a: F.col("action").isin(*a)
    last = lambda flag, *of: F.coalesce(F.max_by(F.when(is_(*of), flag), F.when(is_(*of), order)), F.lit(False))
    first = lambda *of: F.min(F.when(is_(*of), order))
    s = actions.groupBy("user_id", "news_id").agg(
        last(is_("read", "like", "dislike"), "read", "like", "dislike", "remove").alias("is_read"), last(is_("like"), "like", "dislike").alias("liked"), last(is_("dislike"), "like", "dislike").alias("hidden"),
        (F.count_if(is_("favorite")) % 2 == 1).alias("favorite"), F.count_if(is_("shown")).alias("shown"), first("read", "dislike").alias("opened"), first("shown").alias("seen"), F.count_if(is_("dislike")).alias("dislikes"),
    )
    w = Window.partitionBy("user_id", "news_id").orderBy("ts", "action_id")
    likes = actions.where(is_("like", "dislike")).withColumn("before", F.lag("action").over(w)).where((F.col("action") == "like") & (F.coalesce("before", F.lit("")) != "like"))
    s = s.join(likes.groupBy("user_id", "news_id").agg(F.count(F.lit(1)).alias("likes")), ["user_id", "news_id"], "left")
    unseen = F.col("opened").isNotNull() & (F.col("seen").isNull() | (F.col("opened") < F.col("seen")))
    return s.select(
        "user_id", "news_id", "is_read", "liked", "hidden", "favorite", (F.col("shown") + F.when(unseen, 1).otherwise(0)).alias("shown_count"), (1.5 * F.coalesce("likes", F.lit(0)) - 2.0 * F.col("dislikes")).alias("personal"),
        (~F.col("is_read") & ~F.col("hidden")).alias("visible"),
    )


def _stated(allowed: DataFrame, states: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Allowed events of a user's channels that the user has a state of: at most as many rows as there are states."""
    return states.join(allowed, "news_id").join(subscriptions, ["user_id", "channel_id"])


def _first_of_channels(allowed: DataFrame, order: list, subscriptions: DataFrame, left_out: DataFrame, most: int, tasks: int | None = None) -> DataFrame:
    """The first most allowed events of each of a user's channels without those left out (user_id, channel_id, news_id; all of them allowed events of these channels).

    A channel's list is ordered once, for all users, and each reads as many more places as they leave out of it. Rows are subscriptions x most and what is left out,
    however many events the channels have."""
    out = left_out.groupBy("user_id", "channel_id").agg(F.count(F.lit(1)).alias("out"))
    longest = out.agg(F.max("out")).first()[0] or 0
    lists = allowed.withColumn("k", F.row_number().over(Window.partitionBy("channel_id").orderBy(*order))).where(F.col("k") <= most + longest)
    asked = subscriptions.join(out, ["user_id", "channel_id"], "left")
    asked = asked.repartition(tasks or int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")  # few small rows now, many places soon
    asked = asked.withColumn("k", F.explode(F.sequence(F.lit(1), (F.lit(most) + F.coalesce("out", F.lit(0))).cast("int")))).drop("out")
    return asked.join(lists, ["channel_id", "k"]).drop("k").join(left_out.select("user_id", "news_id"), ["user_id", "news_id"], "left_anti")


def _allowed(news: DataFrame, floor: float) -> DataFrame:
    return news.where((F.col("status") == "active") & (F.col("importance") >= floor)).select(F.col("event_id").alias("news_id"), "channel_id", "importance", "theme_no")


def feed(news: DataFrame, states: DataFrame, subscriptions: DataFrame, page: int, floor: float) -> DataFrame:
    """(user_id, news_id, score, place): each user's page of visible events of subscribed channels, by importance and
    personal score. Subscriptions: (user_id, channel_id), each once. Events without a state of the user have the same score for all, so they come from
    the first places of their channels; the others are looked at one by one."""
    allowed = _allowed(news, floor)
    score = lambda personal: F.round(personal + F.col("importance") * (0.6 + 0.4 * F.col("theme_no") / 5.0), 6).alias("score")
    own = _stated(allowed, states.select("user_id", "news_id", "personal", (F.col("is_read") | F.col("disliked")).alias("gone")), subscriptions)
    rest = _first_of_channels(allowed.select("news_id", "channel_id", score(F.lit(0.0))), [F.desc("score"), F.col("news_id")], subscriptions, own.select("user_id", "channel_id", "news_id"), page)
    c = own.where("not gone").select("user_id", "news_id", score(F.coalesce("personal", F.lit(0.0)))).unionAll(rest.select("user_id", "news_id", "score"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "news_id")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= page)


def feed_sizes(news: DataFrame, states: DataFrame, subscriptions: DataFrame, floor: float) -> DataFrame:
    """(user_id, n): how many events each user's feed has, where it has any: those of the channels, counted once a channel, less those that the user has read or disliked."""
    allowed = _allowed(news, floor)
    of_channel = allowed.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))
    gone = _stated(allowed, states.where("is_read or disliked").select("user_id", "news_id"), subscriptions).select("user_id", F.lit(-1).cast("long").alias("n"))
    n = subscriptions.join(of_channel, "channel_id").select("user_id", "n").unionAll(gone)
    return n.groupBy("user_id").agg(F.sum("n").alias("n")).where("n > 0")


def feed_window(news: DataFrame, sources: DataFrame, states: DataFrame, settings: DataFrame, subscriptions: DataFrame, offset: int = 0, depth: int = 16) -> DataFrame:
    """(user_id, news_id, score, place): each user's window of events of subscribed channels, ranked.

    An event counts if it is active, important enough for the user, of one of their themes (null: 'other'), not read or disliked, and none
    of their ignored words stands in its title, summary or topic (words are LIKE patterns without case). The first max(4 page, 40) +
    offset by personal score and importance make the window; within it the weight of the theme (3 where there is none) counts.
    news: (event_id, status, importance, theme, title, summary, topic, updated_at); sources: (event_id, channel_id), several an event;
    settings: (user_id, page_size, min_importance, themes, weights map, ignored text with commas or null); users without settings have no feed.

    Events that a user has a state of are looked at one by one. The others are in the same order for all: each channel and theme has a list by importance, of which
    users read the first depth places. Who has a whole window before the first place that was not read is done; the others read four times as deep, down to
    the lists' ends, so depth changes no row."""
    words = F.expr("filter(transform(split(coalesce(ignored, ''), ','), t -> lower(trim(t))), t -> t <> '')")
    own = settings.select("user_id", "page_size", "min_importance", F.array_distinct("themes").alias("themes"), "weights", words.alias("words"), (F.greatest(F.col("page_size") * 4, F.lit(40)) + offset).alias("most"))
    subs = subscriptions.select("user_id", "channel_id").distinct()
    active = news.where("status = 'active' and importance is not null").select(
        "event_id", "importance", F.round("importance", 9).alias("r"), F.coalesce("theme", F.lit("other")).alias("theme"), F.lower(F.concat_ws("\n", "title", "summary", "topic")).alias("blob"), "updated_at"
    )
    shown = sources.select("event_id", "channel_id").distinct().join(active, "event_id")
    fits = "importance >= min_importance and not exists(words, w -> blob like concat('%', w, '%'))"
    seen = states.select("user_id", F.col("news_id").alias("event_id"), "personal", (F.col("is_read") | F.col("disliked")).alias("gone"))
    columns = ["user_id", "event_id", "personal", "importance", "theme", "updated_at"]

    said = seen.where("not coalesce(gone, false)").join(sources.select("event_id", "channel_id"), "event_id").join(subs, ["user_id", "channel_id"], "left_semi").select("user_id", "event_id", "personal").distinct()
    said = said.join(active, "event_id").join(own, "user_id").where("array_contains(themes, theme)").where(fits)
    parts = [said.withColumn("personal", F.coalesce("personal", F.lit(0.0))).select(*columns)]

    place = Window.partitionBy("channel_id", "theme").orderBy(F.desc("r"), F.desc("importance"), F.desc("updated_at"), "event_id")
    asking = own.drop("page_size", "weights").join(subs, "user_id").select("*", F.explode("themes").alias("theme"))
    while True:
        lists = shown.withColumn("k", F.row_number().over(place)).where(F.col("k") <= depth + 1)
        met = asking.join(lists.withColumn("unread", F.col("k") > depth), ["channel_id", "theme"]).where("importance >= min_importance").where(f"unread or ({fits})")
        met = met.select("user_id", F.when(~F.col("unread"), F.col("event_id")).alias("event_id"), "unread", "most", "importance", "r", "theme", "updated_at").distinct()
        met = met.join(seen.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")
        edge = Window.partitionBy("user_id")
        met = met.withColumn("edge", F.max(F.when(F.col("unread"), F.col("r"))).over(edge))
        met = cut(met.withColumn("open", F.col("edge").isNotNull() & (F.count_if(~F.col("unread") & (F.col("r") > F.col("edge"))).over(edge) < F.col("most"))))
        parts.append(met.where("not open and not unread").withColumn("personal", F.lit(0.0)).select(*columns))
        again = met.where("open").select("user_id").distinct()
        if again.isEmpty():
            break
        asking, depth = asking.join(again, "user_id", "left_semi"), depth * 4

    c = parts[0]
    for p in parts[1:]:
        c = c.unionAll(p)
    c = c.join(own.select("user_id", "page_size", "weights", "most"), "user_id")
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round(F.col("personal") + F.col("importance"), 9)), F.desc("importance"), F.desc("updated_at"), "event_id")
    top = c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("most"))
    score = F.col("personal") + F.col("importance") * (0.6 + 0.4 * (F.coalesce(F.try_element_at("weights", F.col("theme")), F.lit(3)) / 5.0))
    ranked = top.select("user_id", F.col("event_id").alias("news_id"), F.round(score, 6).alias("score"), "k", "page_size")
    again = Window.partitionBy("user_id").orderBy(F.desc("score"), "k")
    return ranked.withColumn("place", F.row_number().over(again).cast("long")).select("user_id", "news_id", "score", "place", "page_size")


def feed_page(window: DataFrame, offset: int = 0) -> DataFrame:
    """(user_id, news_id, score, place, has_more): the page of each ranked window behind offset, and whether there is more behind it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    w = window.withColumn("has_more", n > offset + F.col("page_size"))
    return w.where((F.col("place") > offset) & (F.col("place") <= offset + F.col("page_size"))).select("user_id", "news_id", "score", "place", "has_more")


def _best_of_nodes(near: DataFrame, links: DataFrame, active: DataFrame, seen: DataFrame, top: int, tasks: int | None) -> DataFrame:
    """(user_id, event_id, importance): the top active events (event_id, importance) of a user's nodes (user_id, node_id; each once), without those seen (user_id, event_id).
    A node's events are ordered once for all users, and each reads its first top and as many more as they have seen of it."""
    lists = links.join(near.select("node_id").distinct(), "node_id", "left_semi").join(active, "event_id").select(F.col("node_id").alias("channel_id"), F.col("event_id").alias("news_id"), "importance")
    lists, mine = cut(lists), near.select("user_id", F.col("node_id").alias("channel_id"))  # read twice
    left_out = _stated(lists.select("news_id", "channel_id"), seen.select("user_id", F.col("event_id").alias("news_id")).distinct(), mine)
    c = _first_of_channels(lists, [F.desc("importance"), "news_id"], mine, left_out, top, tasks).withColumnRenamed("news_id", "event_id").select("user_id", "event_id", "importance")
    w = Window.partitionBy("user_id").orderBy(F.desc("importance"), "event_id")
    return _dealt(c, tasks).distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("user_id", "event_id", "importance")


def _dealt(df: DataFrame, tasks: int | None) -> DataFrame:
    """Rows by user over so many tasks, before they are made distinct or ranked: so a task's memory stays as it is when users grow."""
    return df.repartition(tasks, "user_id") if tasks else df


def recommended(news: DataFrame, links: DataFrame, states: DataFrame, top_nodes: int, top: int, tasks: int | None = None) -> DataFrame:
    """(user_id, event_id, importance): active events that share a node with what a user liked, kept or read, without those seen
    or disliked; the most important ones. tasks: over how many tasks what users have is dealt."""
    liked = states.where("liked or favorite or is_read").select("user_id", F.col("news_id").alias("event_id"))
    nodes = _dealt(liked.join(links, "event_id").select("user_id", "node_id"), tasks).groupBy("user_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "node_id")
    best = cut(nodes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_nodes).select("user_id", "node_id"))  # read three times
    seen = states.where("shown_count > 0 or disliked").select("user_id", F.col("news_id").alias("event_id"))
    return _best_of_nodes(best, links, news.where("status = 'active'").select("event_id", "importance"), seen, top, tasks).withColumn("importance", F.round("importance", 6))


def recommended_wide(
    news: DataFrame, links: DataFrame, states: DataFrame, users: DataFrame, last: int = 40, nodes: int = 12, extra: int = 16, top: int = 5, pool: int = 200, tasks: int | None = None
) -> DataFrame:
    """(user_id, event_id, importance, via): for each user the top active events, not yet seen or disliked, that mention one of the nodes (by mentions) of the last
    events that they liked, kept or read, or one of extra neighbours of those over strong edges. Users who get none, new ones too, have the first of the pool most
    important events that they have not read or disliked. Ranks are limited before the shuffle; edges are derived for nodes that somebody likes, and of a node's
    neighbours only the first extra + nodes are read, because those before one of a user's extra are others of them or nodes that they like. tasks: as in `recommended`."""
    from .graph import weighted

    rank = lambda df, n, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("k") <= n).drop("k")
    mentions = links.groupBy("node_id").agg(F.count(F.lit(1)).alias("m"))
    lately = rank(states.where("liked or favorite or is_read"), last, F.desc("last_ts"), "news_id").select("user_id", F.col("news_id").alias("event_id"))
    liked = rank(_dealt(lately.join(links, "event_id").select("user_id", "node_id").join(mentions, "node_id"), tasks).distinct(), nodes, F.desc("m"), "node_id")
    liked = cut(liked.select("user_id", "node_id"))  # read four times
    x = links.join(liked.select("node_id").distinct(), "node_id", "left_semi").withColumnRenamed("node_id", "a")
    pairs = x.join(links.withColumnRenamed("node_id", "to"), "event_id").where("a <> to").select("a", "to")
    strong = weighted((pairs.repartition(tasks, "a", "to") if tasks else pairs).groupBy("a", "to").agg(F.count(F.lit(1)).alias("mentions"))).where("weight >= 0.3")
    first = Window.partitionBy("a").orderBy(F.desc("m"), "to")
    lists = strong.join(mentions.withColumnRenamed("node_id", "to"), "to").withColumn("k", F.row_number().over(first)).where(F.col("k") <= extra + nodes).select(F.col("a").alias("node_id"), "to", "m")
    around = liked.join(lists, "node_id").select("user_id", F.col("to").alias("node_id"), "m", F.lit(False).alias("own")).unionAll(liked.select("user_id", "node_id", F.lit(0).cast("long"), F.lit(True)))
    around = _dealt(around, tasks).groupBy("user_id", "node_id").agg(F.max("m").alias("m"), F.max("own").alias("own")).where("not own")
    near = cut(liked.unionAll(rank(around, extra, F.desc("m"), "node_id").select("user_id", "node_id")))  # read three times
    seen = states.where("shown_count > 0 or disliked").select("user_id", F.col("news_id").alias("event_id"))
    active = news.where("status = 'active'").select("event_id", "importance")
    found = cut(_best_of_nodes(near, links, active, seen, top, tasks)).select("user_id", "event_id", "importance", F.lit("graph").alias("via"))  # read twice
    best = active.orderBy(F.desc("importance"), "event_id").limit(pool)  # pool rows for every user without finds
    read = states.where("is_read or disliked").select("user_id", F.col("news_id").alias("event_id"))
    rest = users.join(found.select("user_id").distinct(), "user_id", "left_anti").join(F.broadcast(best)).join(read, ["user_id", "event_id"], "left_anti")
    feed_ = rank(rest, top, F.desc("importance"), "event_id").select("user_id", "event_id", "importance", F.lit("feed").alias("via"))
    return found.unionAll(feed_).withColumn("importance", F.round("importance", 6))


def overflow(news: DataFrame, subscriptions: DataFrame, done: DataFrame, scan: int, most: int) -> DataFrame:
    """(user_id, event_id, k) of unread events that a full queue hides: of the scan newest of a user's channels (user_id, channel_id) without done (user_id, event_id), those behind the
    most strongest. The newest come from the first places of the channels' own lists, which are ordered once for all users."""
    events = news.select(F.col("event_id").alias("news_id"), "channel_id", "importance", "created_at")
    left_out = _stated(events.select("news_id", "channel_id"), done.select("user_id", F.col("event_id").alias("news_id")).distinct(), subscriptions)
    mine = _first_of_channels(events, [F.desc("created_at"), F.desc("news_id")], subscriptions, left_out, scan).withColumnRenamed("news_id", "event_id")
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    recent = mine.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= scan)
    strongest = Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("created_at"), F.desc("event_id"))
    return recent.withColumn("k", F.row_number().over(strongest)).where(F.col("k") > most).select("user_id", "event_id", "k")


def collapsed(lists: DataFrame, near: DataFrame) -> DataFrame:
    """(list_id, place, id) of ranked lists without near-duplicates: the first of a story stays at its place, but a later one with
    more sources takes that place over. lists: (list_id, place, id, sources), each a page that its query has cut to a fixed
    number of rows; near: (a, b) of near-duplicates. The fold is over one page at a time."""
    import pandas as pd

    both = near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("like"))
    rows = lists.join(both, "id", "left").select("list_id", "place", "id", "sources", F.coalesce("like", F.array().cast("array<long>")).alias("like"))

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []  # place, id, sources
        for r in page.sort_values("place").itertuples():
            same = set(r.like)
            hit = next((k for k in kept if k[1] in same), None)
            if hit is None:
                kept.append([r.place, r.id, r.sources])
            elif r.sources > hit[2]:
                hit[1:] = [r.id, r.sources]
        return pd.DataFrame({"list_id": page["list_id"].iloc[0], "place": [k[0] for k in kept], "id": [k[1] for k in kept]})

    return rows.groupBy("list_id").applyInPandas(fold, "list_id string, place long, id long")


def distinct_trends(ranked: DataFrame, nodes: DataFrame, limit: int, width: int = 5, shared: int = 2) -> DataFrame:
    """(event_id, place): a ranked list (event_id, place), cut to a fixed number by its query, taken in order; an event is skipped if its
    first nodes are those of an earlier one or share two and more with them. Events without nodes stay. At most limit rows."""
    import pandas as pd

    w = Window.partitionBy("event_id").orderBy("node_id")
    first = nodes.join(ranked.select("event_id"), "event_id", "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= width)
    sets = first.groupBy("event_id").agg(F.collect_set("node_id").alias("nodes"))
    rows = ranked.join(sets, "event_id", "left").select(F.lit(0).alias("one"), "event_id", "place", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"))

    def take(page: pd.DataFrame) -> pd.DataFrame:
        used: list[frozenset] = []
        out = []
        for r in page.sort_values("place").itertuples():
            own = frozenset(r.nodes)
            if own and any(own == u or len(own & u) >= shared for u in used):
                continue
            if own:
                used.append(own)
            out.append((r.event_id, r.place))
            if len(out) == limit:
                break
        return pd.DataFrame(out, columns=["event_id", "place"])

    return rows.groupBy("one").applyInPandas(take, "event_id long, place long")
