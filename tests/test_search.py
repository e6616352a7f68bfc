"""Ranked search against a plain loop on small cases: pages, deep search, reasons, answers."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.checkpoints import keeper
from postloom.functions import vocab as V
from postloom.operators import search as S

NOW = 20_000


def small(spark, n=120, seed=4):
    r = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    base = [" ".join(r.choice(words) for _ in range(9)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = r.choice(base) if r.random() < 0.7 else " ".join(r.choice(words) for _ in range(9))
        rows.append((i, text, f"{text} more", r.choice(V.THEMES), r.randint(0, NOW), r.randint(1, 15), r.randint(0, 100) / 10, r.sample(["Apple", "OpenAI", "NVIDIA", "Steam"], r.randint(0, 2))))
    e = spark.createDataFrame(rows, "id long, title string, text string, theme string, updated long, sources long, importance double, names array<string>").withColumn("summary", F.col("title"))
    return e, e.select("id", F.explode("names").alias("name"))


EDGES = [("Apple", "OpenAI", 0.9), ("Apple", "NVIDIA", 0.5), ("Steam", "Apple", 0.29)]
QUESTIONS = [(1, "Apple wab wcd"), (2, "wab wac wad wae"), (3, "лучшие игры Steam"), (4, None), (5, " "), (6, "хронология NVIDIA за неделю"), (7, "почему OpenAI wab")]


@pytest.mark.parametrize("page, block, deep", [(64, 256, False), (4, 2, False), (4, 256, True)])
def test_hits_of_any_page_and_block(spark, page, block, deep):
    """Small pages have to be followed by others, because near-duplicates are dropped from them: hits stay the same."""
    e, mentions = small(spark)
    keep = keeper(spark)
    asked = S.asked(spark.createDataFrame(QUESTIONS, "id long, text string"), spark.createDataFrame(EDGES, "a string, b string, weight double"), NOW, deep=deep)
    events = keep(S.searchable(e, mentions), "events")
    hits = S.ranked(events, asked, keep, NOW, deep=deep, page=page, block=block).collect()
    q = {x["id"]: x for x in asked.collect()}
    assert set(q) == {1, 2, 3, 6, 7} and {n["name"] for n in q[1]["nodes"]} == {"Apple", "OpenAI", "NVIDIA"}
    rows = {x["id"]: x for x in events.collect()}
    raw = {x["id"]: x for x in e.collect()}
    wanted = {}
    for qid, ask in q.items():
        vec = {i: _cos(ask["codes"], x["codes"]) for i, x in rows.items()}
        nodes = {n["name"]: n["distance"] for n in ask["nodes"]}
        live = [i for i, x in rows.items() if x["updated"] >= ask["since"]]
        graph = {i for i in live if set(rows[i]["names"]) & set(nodes)}
        near = sorted((i for i in live if vec[i] >= (0.12 if deep else 0.16)), key=lambda i: (-vec[i], i))[: 60 if deep else 40]
        cand = graph | (set(near) if deep or ask["intent"] in ("qa", "recommendation") or not graph else set())
        scored = []
        for i in cand:
            x = rows[i]
            d = min((nodes[n] for n in x["names"] if n in nodes), default=9)
            fresh, imp = min(1, max(0, 1 - max(0, (NOW - x["updated"]) / 60) / 336)), min(1, x["importance"] / 10)
            s = 0.35 * vec[i] + 0.2 * (1 if d == 0 else 0.65 if d == 1 else 0.35) + 0.15 * min(1, x["sources"] / 12) + 0.1 * imp + 0.1 * fresh
            s = 0.55 * fresh + 0.45 * s if ask["intent"] == "timeline" else min(1, s + 0.08) if ask["intent"] == "entity" and d < 9 else 0.5 * s + 0.3 * imp if ask["intent"] == "recommendation" else s
            if s < (0.34 if deep else 0.38) or (ask["seeds"] and d == 9 and (vec[i] < (0.40 if deep else 0.45) or (not deep and ask["intent"] not in ("qa", "recommendation") and vec[i] < 0.48))):
                continue
            scored.append((-round(s, 6), i))
        kept = []
        for _, i in sorted(scored):
            if len(kept) < (12 if deep else 10) and not any(_twins(raw[i]["title"], raw[j]["title"]) for j in kept):
                kept.append(i)
        wanted[qid] = kept
    got = {}
    for h in sorted(hits, key=lambda h: h["place"]):
        got.setdefault(h["question"], []).append(h["event"])
    assert got == {k: v for k, v in wanted.items() if v} and any(len(v) > 4 for v in got.values())


def _cos(a, b):
    import numpy as np

    x, y = (np.bincount([c >> 1 for c in v], [1 - 2 * (c & 1) for c in v], 384) for v in (a, b))
    return round(max(0.0, float(x @ y / ((x @ x) ** 0.5 * (y @ y) ** 0.5))), 6)


def _twins(a, b):
    a, b = set(a.split()), set(b.split())
    a, b = ({w[:-1] if len(w) > 4 else w for w in s} for s in (a, b))
    n = len(a & b)
    return n > 0 and (n / len(a | b) >= 0.30 or (n >= 3 and n / len(a | b) >= 0.22) or (min(len(a), len(b)) >= 3 and n / min(len(a), len(b)) >= 0.72))


def test_reasons_and_answers(spark):
    q = spark.createDataFrame([(1, "Apple news of wab", ["Apple", "x", "y"]), (2, "nothing like it", [])], "id long, text string, seeds array<string>")
    hits = spark.createDataFrame(
        [(1, 1, 10, 0.9, 0.5, 0, ["Apple"], 3, 0.8, 7.0), (1, 2, 11, 0.8, 0.5, 2, [], 1, 0.2, 1.0), (2, 1, 10, 0.7, 0.5, 2, [], 1, 0.2, 1.0)],
        "question long, place int, event long, score double, semantic double, distance int, matched array<string>, sources long, fresh double, importance double",
    )
    seeds = spark.createDataFrame([(1, 11)], "question long, event long")
    got = {(x["question"], x["event"]): x["explanation"] for x in S.explained(hits, q, seeds).collect()}
    assert got[1, 10] == ["связано с Apple", V.WHY["graph"], "подтверждено 3 источниками", V.WHY["fresh"], V.WHY["important"]]
    assert got[1, 11] == ["связано с Apple", "связано с x", V.WHY["deep"]] and got[2, 10] == []
    events = spark.createDataFrame([(10, "Apple news", "wab and more"), (11, "Other", "news of nothing")], "id long, title string, summary string")
    a = {x["question"]: x for x in S.answered(hits, q, events).collect()}
    assert a[1]["used"] == [10, 11] and a[1]["answer"] == "По запросу «Apple news of wab»:\n• Apple news: wab and more\n• Other: news of nothing" and a[1]["relevant"] and a[1]["faithful"]
    assert not a[2]["relevant"] and a[2]["answer"] == V.ANSWER_EMPTY and a[2]["used"] == []
    assert S.ranked(S.searchable(*small(spark, 1)), S.asked(spark.createDataFrame([], "id long, text string"), spark.createDataFrame(EDGES, "a string, b string, weight double"), NOW), keeper(spark), NOW) is None


def test_copies_take_no_pages_of_their_own(spark):
    """600 copies of one event before the second hit: the next page leaves them out, instead of reading all events once for every page of copies."""
    rows = [(i, "wab wac wad wae waf", "Apple wab wac wad", V.THEMES[0], NOW, 12, 9.0) for i in range(600)] + [(1000 + i, f"x{chr(97 + i)}a x{chr(97 + i)}b x{chr(97 + i)}c", "Apple", V.THEMES[0], NOW, 3, 1.0) for i in range(4)]
    e = spark.createDataFrame(rows, "id long, title string, text string, theme string, updated long, sources long, importance double").withColumn("summary", F.col("title"))
    keep, names = keeper(spark), []

    def write(df, name):
        names.append(name)
        return keep(df, name)

    asked = keep(S.asked(spark.createDataFrame([(1, "Apple wab"), (2, "OpenAI")], "id long, text string"), spark.createDataFrame(EDGES, "a string, b string, weight double"), NOW), "asked")
    events = keep(S.searchable(e, e.select("id", F.lit("Apple").alias("name"))), "events")
    hits = S.ranked(events, asked, write, NOW, page=8).where("question = 1").orderBy("place").collect()
    assert [h["event"] for h in hits] == [0, 1000, 1001, 1002, 1003]
    assert len([n for n in names if n.startswith("page-")]) <= 3


def test_a_task_sends_one_page_a_question(spark):
    """However many batches and slices a task reads, it sends its nearest events and its page of a question once, the best of all of them."""
    from types import SimpleNamespace

    from postloom.config import DEFAULT
    from postloom.operators.matching import Lists

    e, mentions = small(spark, n=1_500)
    asked = S.asked(spark.createDataFrame(QUESTIONS, "id long, text string"), spark.createDataFrame(EDGES, "a string, b string, weight double"), NOW).toArrow()
    table = S.searchable(e, mentions).withColumn("personal", F.lit(None).cast("array<struct<question:long,personal:double>>")).toArrow().combine_chunks()
    q = S.Questions(asked.drop_columns(["codes"]).to_pylist(), Lists.of(asked["codes"]), DEFAULT, NOW, False)
    for task, most, sort in ((S._nearest, S.SEMANTIC, lambda r: (-r["sim"], r["event"])), (lambda s: S._best(s, 8), 8, lambda r: (-r["score"], r["event"]))):
        once, parts = ([r for b in task(SimpleNamespace(value=q))(batches) for r in b.to_pylist() if not r.get("graph")] for batches in (table.to_batches(), table.to_batches(max_chunksize=70)))
        assert sorted(map(str, once)) == sorted(map(str, parts)) and once
        whole = [r for b in table.to_batches(max_chunksize=1) for x in task(SimpleNamespace(value=q))([b]) for r in x.to_pylist() if not r.get("graph")]
        for k in q.ids.tolist():
            mine = [r for r in once if r["question"] == k]
            assert [r["event"] for r in sorted(mine, key=sort)] == [r["event"] for r in sorted((r for r in whole if r["question"] == k), key=sort)[:most]]
