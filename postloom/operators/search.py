"""Ranked search: from questions to events with scores and reasons, and from those to an answer.

A question has an intent, a period, and seed nodes; seeds are expanded over strong edges. Candidates are the events of its period that mention one of
those nodes, and, for some intents or where there are none, the SEMANTIC nearest events. They are scored by meaning, graph distance, sources,
importance, freshness and the user's history, turned by intent and taste, and taken from the best on without near-duplicates.

Questions are a stated set: blocks of QUESTIONS of them (vectors, node distances, settings) are broadcast, events are read where they lie, and each task
keeps its PAGE best events of each question over all that it reads, so that no pair is a row; only events with a question's nodes, or near to it, are scored. The few best are folded a question at a time; where a whole page
leaves fewer hits than asked for, the next page is read from where it ended, without the near-duplicates of the hits so far. Its first event is then a hit,
so events are read once for each hit asked for at most, however many copies there are, and no limit hides a hit.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import expressions as E
from ..functions import vocab as V
from .graph import query_nodes
from .matching import Lists, _any, _codes, _hashes, _max_tokens, _Postings, _unit

QUESTIONS, PAGE, SEMANTIC = 1_024, 64, 40
#: Events that meet a block of questions at once.
AT_ONCE = 256
#: Least similarity of the nearest events, least score, and least similarity of events that no seed or neighbour leads to (deep search: second).
NEAREST, LEAST, APART, FAR = (0.16, 0.12), (0.38, 0.34), (0.45, 0.40), 0.48

Write = Callable[[DataFrame, str], DataFrame]


def strong_neighbours(seeds: DataFrame, edges: DataFrame, strong: float = DEFAULT.edge_strong, most: int = 10) -> DataFrame:
    """(id, name, distance) of seeds (id, name) and, behind them, the most neighbours of a question over edges (a, b, weight) of that weight and more,
    by weight, then name."""
    both = edges.where(F.col("weight") >= strong).select(F.col("a").alias("name"), F.col("b").alias("to"), "weight")
    both = both.unionAll(both.select(F.col("to").alias("name"), F.col("name").alias("to"), "weight"))
    near = both.join(seeds, "name").groupBy("id", F.col("to").alias("name")).agg(F.max("weight").alias("weight")).join(seeds, ["id", "name"], "left_anti")
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "name")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return seeds.select("id", "name", F.lit(0).alias("distance")).unionAll(near.select("id", "name", F.lit(1).alias("distance")))


def asked(questions: DataFrame, edges: DataFrame, now: int, deep: bool = False, config: EngineConfig = DEFAULT) -> DataFrame:
    """(id, text, intent, since, seeds, nodes, codes) of questions (id, text): nodes are (name, distance)."""
    q = questions.select("id", F.expr(E.normal_query("text")).alias("text")).where("text <> ''")
    q = q.select("id", "text", F.lit("deep").alias("intent") if deep else F.expr(E.intent("text")).alias("intent"), F.coalesce(F.expr(E.period_days("text")), F.lit(30)).alias("days"))
    q = q.withColumn("since", F.lit(now) - (F.greatest("days", F.lit(60)) if deep else F.col("days")) * 1440)
    names = query_nodes(questions.sparkSession, q)
    known = names.where("known").select("id", F.explode("names").alias("name"))
    nodes = strong_neighbours(known, edges, config.edge_strong, 24 if deep else 10).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "name"))).alias("nodes"))
    q = q.join(names.select("id", F.col("names").alias("seeds")), "id", "left").join(nodes, "id", "left")
    return q.select("id", "text", "intent", F.col("since").cast("long").alias("since"), F.coalesce("seeds", F.array().cast("array<string>")).alias("seeds"), F.coalesce("nodes", F.array().cast("array<struct<distance:int,name:string>>")).alias("nodes"), F.expr(_codes("text", config.embedding_dim)).alias("codes"))


def searchable(events: DataFrame, mentions: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """What searches read of events (id, title, summary, text, theme, updated, sources, importance): vector, tokens, names of their nodes. mentions: (id, name)."""
    names = mentions.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))  # at most the alias table's names
    blob = F.concat_ws(" ", "title", "summary")
    e = events.select("id", "theme", "updated", "sources", "importance", "text", blob.alias("blob")).join(names, "id", "left")
    flags = f"cast({_any('blob', V.REMOVAL_WORDS)} as int) + 2 * cast({_any('blob', V.STORE_WORDS)} as int)"
    return e.select(
        "id", "theme", "updated", "sources", F.col("importance").cast("double").alias("importance"), F.coalesce("names", F.array().cast("array<string>")).alias("names"),
        F.expr(_codes("text", config.embedding_dim)).alias("codes"), F.expr(_hashes(E.merge_tokens("blob"))).alias("tokens"), F.expr(flags).alias("flags"),
    )


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, half up."""
    return np.floor(x * 1e6 + 0.5) / 1e6


class Questions:
    """A block of questions as arrays."""

    def __init__(self, rows: list[dict], codes: Lists, config: EngineConfig, now: int, deep: bool):
        self.rows, self.now, self.deep = rows, now, deep
        self.ids = np.asarray([r["id"] for r in rows], np.int64)
        self.vectors = _unit(codes, config.embedding_dim)
        self.dim = config.embedding_dim
        self.since = np.asarray([r["since"] for r in rows], np.int64)
        self.intent = np.asarray([r["intent"] for r in rows], object)
        self.seeded = np.asarray([bool(r["seeds"]) for r in rows])
        self.nodes: dict[str, list[tuple[int, int]]] = {}
        for k, r in enumerate(rows):
            for n in r["nodes"]:
                self.nodes.setdefault(n["name"], []).append((k, n["distance"]))
        self.near: dict[int, list[int]] = {}  # event -> questions that it is near to
        self.user = np.asarray([r.get("weights") is not None for r in rows])
        self.taste = [{t: _taste(r, t) for t in V.THEMES} if r.get("weights") is not None else {} for r in rows]
        self.end = [(np.inf, -1)] * len(rows)  # score and id behind which the page begins
        self.told: list[list[int]] = [[] for _ in rows]  # hits of earlier pages, as places in told_hits
        self.told_hits: list[tuple[np.ndarray, int]] = []  # tokens and flags

    def only(self, at: list[int]) -> "Questions":
        """Some of the questions."""
        q, new = copy.copy(self), {k: i for i, k in enumerate(at)}
        for name in ("ids", "vectors", "since", "intent", "seeded", "user"):
            setattr(q, name, getattr(self, name)[at])
        for name in ("rows", "taste", "end", "told"):
            setattr(q, name, [getattr(self, name)[k] for k in at])
        q.nodes = {n: own for n, x in self.nodes.items() if (own := [(new[k], d) for k, d in x if k in new])}
        q.near = {e: own for e, x in self.near.items() if (own := [new[k] for k in x if k in new])}
        return q

    def similar(self, codes: Lists) -> np.ndarray:
        return _rounded(np.clip(_unit(codes, self.dim) @ self.vectors.T, 0.0, 1.0))

    def distances(self, names: list[list[str]]) -> np.ndarray:
        d = np.full((len(names), len(self.rows)), 9)
        for k, own in enumerate(names):
            for name in own:
                for q, at in self.nodes.get(name, ()):
                    d[k, q] = min(d[k, q], at)
        return d


def _taste(row: dict, theme: str) -> float:
    """How much a user wants a theme, 0 to 1; what they have turned off counts 0.35 of that."""
    weight = min(1.0, max(0.0, float((row["weights"] or {}).get(theme, 3)) / 5.0))
    return weight * (0.35 if row["enabled"] and theme not in row["enabled"] else 1.0)


def scores(q: Questions, e: dict, i: np.ndarray, k: np.ndarray, sim: np.ndarray, distance: np.ndarray, personal: np.ndarray) -> np.ndarray:
    """Scores of pairs: of the events at i for the questions at k."""
    clip = lambda x: np.clip(x, 0.0, 1.0)
    fresh, importance = clip(1.0 - np.maximum(0.0, (q.now - e["updated"]) / 60.0) / 336.0)[i], clip(e["importance"] / 10.0)[i]
    graph = np.where(distance <= 0, 1.0, np.where(distance == 1, 0.65, 0.35))
    score = 0.35 * sim + 0.20 * graph + 0.15 * clip(e["sources"] / 12.0)[i] + 0.10 * importance + 0.10 * fresh + 0.10 * personal
    kind = q.intent[k]
    score = np.where(kind == "timeline", 0.55 * fresh + 0.45 * score, score)
    score = np.where((kind == "entity") & (distance < 9), np.minimum(1.0, score + 0.08), score)
    score = np.where(kind == "recommendation", 0.5 * score + 0.3 * importance + 0.2 * personal, score)
    if not q.user.any():
        return score
    taste = np.asarray([q.taste[y].get(e["theme"][x], 0.0) for x, y in zip(i.tolist(), k.tolist(), strict=True)])
    return np.where(q.user[k], np.minimum(1.0, 0.70 * score + 0.30 * (0.55 * taste + 0.45 * personal)), score)


class _Most:
    """The best rows of each question that a task has seen so far: value from the highest on, then id. What cannot be among them is known by floor."""

    def __init__(self, n: int, most: int):
        self.most, self.floor, self.rows = most, np.full(n, -np.inf), [[] for _ in range(n)]

    def add(self, k: int, rows: list[tuple]) -> None:
        """Rows (value, id, ...) of a question."""
        own = self.rows[k]
        own += rows
        if len(own) >= self.most + 32:
            self.cut(k)

    def cut(self, k: int) -> list[tuple]:
        own = self.rows[k]
        own.sort(key=lambda r: (-r[0], r[1]))
        del own[self.most :]
        if len(own) == self.most:
            self.floor[k] = own[-1][0]
        return own


def _batches(rows, schema: list[tuple[str, pa.DataType]], each: int = 4_096):
    """Rows as record batches."""
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == each:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), schema, strict=True)], [n for n, _ in schema])
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), schema, strict=True)], [n for n, _ in schema])


def _sliced(batches):
    for b in batches:
        for first in range(0, b.num_rows, AT_ONCE):
            yield b.slice(first, AT_ONCE)


def _nearest(shared):
    """Task: its SEMANTIC nearest events of each question that looks for them, and whether any event has one of its nodes."""

    def run(batches):
        q: Questions = shared.value
        floor, most = NEAREST[q.deep], _Most(len(q.ids), 60 if q.deep else SEMANTIC)
        graph = np.zeros(len(q.ids), bool)
        for b in _sliced(batches):
            sim = q.similar(Lists.of(b.column("codes")))
            ids, updated = np.asarray(b.column("id")), np.asarray(b.column("updated"))
            live = updated[:, None] >= q.since[None, :]
            for i, own in enumerate(b.column("names").to_pylist()):
                for name in own:
                    for k, _ in q.nodes.get(name, ()):
                        graph[k] |= live[i, k]
            fits = live & (sim >= np.maximum(floor, most.floor)[None, :])
            for k in np.flatnonzero(fits.any(0)).tolist():
                at = np.flatnonzero(fits[:, k])
                most.add(k, list(zip(sim[at, k].tolist(), ids[at].tolist(), strict=True)))
        found = ((qid, i, v, False) for k, qid in enumerate(q.ids.tolist()) for v, i in most.cut(k))
        yield from _batches(found, [("question", pa.int64()), ("event", pa.int64()), ("sim", pa.float64()), ("graph", pa.bool_())])
        yield from _batches(((int(i), None, None, True) for i in q.ids[graph]), [("question", pa.int64()), ("event", pa.int64()), ("sim", pa.float64()), ("graph", pa.bool_())])

    return run


_HIT = "question long, event long, score double, semantic double, distance int, matched array<string>, sources long, fresh double, importance double, tokens array<long>, flags int"


def _copies(q: Questions, tokens: Lists, flags: np.ndarray, fits: np.ndarray, config: EngineConfig = DEFAULT) -> dict[int, np.ndarray]:
    """For each earlier hit of a question that still asks and has events here: which of the events are near-duplicates of it, as in `near_duplicate`."""
    wanted = sorted({h for k, told in enumerate(q.told) if told and q.end[k][0] > -np.inf and fits[:, k].any() for h in told})
    if not wanted:
        return {}
    sets, names, out = _Postings(tokens), sorted(_max_tokens()), {}
    named = [sets.shared(Lists.one([m]))[0] > 0 for m in names]
    for h in wanted:
        own, mine = q.told_hits[h]
        both, low, f = sets.shared(Lists.one(own))[0], np.minimum(sets.sizes, len(own)), flags | mine
        overlap = both / np.maximum(sets.sizes + len(own) - both, 1)
        near = (overlap >= config.near_jaccard) | ((both >= 3) & (overlap >= config.near_jaccard_shared)) | ((low >= 3) & (both / np.maximum(low, 1) >= config.near_containment))
        common = np.any([x for x, m in zip(named, names, strict=True) if m in own] or [np.zeros(sets.n, bool)], axis=0)
        near |= (both >= 2) & ((f & 1) > 0) & ((((f & 2) > 0) & common) | (overlap >= config.near_removal))
        out[h] = near & (both > 0)
    return out


def _best(shared, page: int):
    """Task: its page of events of each question, from the best on, behind where the question's last page ended. Only events that have a question's nodes, or are
    near to it, are scored for it."""

    def run(batches):
        q: Questions = shared.value
        deep, most = int(q.deep), _Most(len(q.ids), page)
        place, mine = {int(i): k for k, i in enumerate(q.ids)}, [{n["name"] for n in r["nodes"]} for r in q.rows]
        end, last = np.asarray([x for x, _ in q.end], float), np.asarray([x for _, x in q.end], np.int64)
        open_kind = np.isin(q.intent.astype(str), ("qa", "recommendation", "deep"))
        for b in _sliced(batches):
            e = {c: np.asarray(b.column(c)) for c in ("id", "updated", "sources", "importance", "flags")} | {"theme": b.column("theme").to_pylist()}
            names, tokens = b.column("names").to_pylist(), Lists.of(b.column("tokens"))
            d = q.distances(names)
            wanted = d < 9
            for i, event in enumerate(e["id"].tolist()):
                if event in q.near:
                    wanted[i, q.near[event]] = True
            wanted &= e["updated"][:, None] >= q.since[None, :]
            rows = np.flatnonzero(wanted.any(1))
            if not len(rows):
                continue
            sims = q.similar(Lists.of(b.column("codes")).take(rows))
            at, k = np.nonzero(wanted[rows])
            i, sim = rows[at], sims[at, k]
            told = {}
            if b.schema.field("personal").type != pa.null():
                told = {(x, place[p["question"]]): p["personal"] for x, said in enumerate(b.column("personal").to_pylist()) for p in said or () if p["question"] in place}
            personal = np.asarray([told.get(x, 0.0) for x in zip(i.tolist(), k.tolist(), strict=True)]) if told else np.zeros(len(i))
            near_by = d[i, k]
            matched = near_by < 9
            score = _rounded(scores(q, e, i, k, sim, near_by, personal))
            ok = (score >= LEAST[deep]) & (score >= most.floor[k]) & ((score < end[k]) | ((score == end[k]) & (e["id"][i] > last[k])))
            ok &= ~(q.seeded[k] & ~matched) | ((sim >= APART[deep]) & ((sim >= FAR) | open_kind[k]))
            fits = np.zeros(wanted.shape, bool)
            fits[i[ok], k[ok]] = True
            for h, copy_of in _copies(q, tokens, e["flags"], fits).items():
                ok &= ~(copy_of[i] & np.asarray([h in x for x in q.told])[k])
            distance, fresh = np.where(matched, near_by, 2), np.clip(1.0 - np.maximum(0.0, (q.now - e["updated"]) / 60.0) / 336.0, 0.0, 1.0)
            sent: dict[int, np.ndarray] = {}
            order = np.flatnonzero(ok)
            for x in order[np.argsort(k[order], kind="stable")].tolist():
                y, z = int(i[x]), int(k[x])
                if y not in sent:
                    sent[y] = tokens[y].copy()
                shown = [n for n in names[y] if n in mine[z]]
                most.add(z, [(float(score[x]), int(e["id"][y]), float(sim[x]), int(distance[x]), shown, int(e["sources"][y]), float(fresh[y]), float(e["importance"][y]), sent[y], int(e["flags"][y]))])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.int32())
        found = ((qid, r[1], r[0], *r[2:]) for k, qid in enumerate(q.ids.tolist()) for r in most.cut(k))
        yield from _batches(found, list(zip([x.split()[0] for x in _HIT.split(", ")], kinds, strict=True)))

    return run


def near_duplicate(a: set, b: set, flags: int, config: EngineConfig = DEFAULT) -> bool:
    """The near-duplicate test on hashed content tokens; flags: removal words, store words in either text."""
    both = len(a & b)
    if not both:
        return False
    overlap, low = both / len(a | b), min(len(a), len(b))
    if overlap >= config.near_jaccard or (both >= 3 and overlap >= config.near_jaccard_shared) or (low >= 3 and both / low >= config.near_containment):
        return True
    return both >= 2 and bool(flags & 1) and ((bool(flags & 2) and bool(_max_tokens() & a & b)) or overlap >= config.near_removal)


def _kept(limits: dict[int, int], told: dict[int, list], config: EngineConfig):
    """Task: of a question's page, in order, the hits that are no near-duplicates of earlier ones (told: those of earlier pages)."""

    def fold(t: pa.Table) -> pa.Table:
        qid = t["question"][0].as_py()
        rows = sorted(t.to_pylist(), key=lambda r: (-r["score"], r["event"]))
        used = [(set(x), f) for x, f in told.get(qid, [])]
        keep = []
        for r in rows:
            if len(used) >= limits[qid]:
                break
            own = set(r["tokens"])
            if not any(near_duplicate(own, x, r["flags"] | f, config) for x, f in used):
                used.append((own, r["flags"]))
                keep.append(r)
        return pa.Table.from_pylist(keep, schema=t.schema)

    return fold


def ranked(events: DataFrame, questions: DataFrame, write: Write, now: int, limit: int = 10, personal: DataFrame | None = None, deep: bool = False, config: EngineConfig = DEFAULT, block: int = QUESTIONS, page: int = PAGE) -> DataFrame | None:
    """(question, place, event, score, semantic, distance, matched, sources, fresh, importance) of the hits of each question, at most limit (deep: 12 and more).

    events: `searchable`; questions: `asked`, and, for a user's search, weights (map of themes) and enabled (list of themes, empty: all); personal: (question, event,
    personal from 0 to 1). Events are read in place, once for each block of questions and page. None where there are no questions.
    """
    spark = events.sparkSession
    limit = max(limit, 12) if deep else limit
    if personal is not None:
        said = personal.groupBy(F.col("event").alias("id")).agg(F.collect_list(F.struct("question", "personal")).alias("personal"))  # one for each stated question at most
        events = events.join(said, "id", "left")
    else:
        events = events.withColumn("personal", F.lit(None).cast("array<struct<question:long,personal:double>>"))
    found: list[DataFrame] = []
    n = max(1, -(-questions.count() // block))
    for k in range(n):
        mine = questions.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id").toArrow()
        if not mine.num_rows:
            continue
        rows = [dict(r, weights=dict(r["weights"]) if r.get("weights") is not None else None) for r in mine.drop_columns(["codes"]).to_pylist()]
        q = Questions(rows, Lists.of(mine["codes"]), config, now, deep)
        shared = spark.sparkContext.broadcast(q)
        wants = write(events.mapInArrow(_nearest(shared), "question long, event long, sim double, graph boolean"), f"near-{k}")
        with_nodes = {r["question"] for r in wants.where("graph").select("question").distinct().collect()}
        top = Window.partitionBy("question").orderBy(F.desc("sim"), "event")
        nearest = wants.where("not graph").withColumn("k", F.row_number().over(top)).where(F.col("k") <= (60 if deep else SEMANTIC))
        place = {r["id"]: i for i, r in enumerate(rows)}
        for r in nearest.select("question", "event").collect():  # at most 60 a question of the block
            i = place[r["question"]]
            if deep or rows[i]["intent"] in ("recommendation", "qa", "deep") or r["question"] not in with_nodes:
                q.near.setdefault(r["event"], []).append(i)
        limits, told, turn, asking = {r["id"]: limit for r in rows}, {}, 0, q
        while True:
            shared = spark.sparkContext.broadcast(asking)
            order = Window.partitionBy("question").orderBy(F.desc("score"), "event")
            hits = write(events.mapInArrow(_best(shared, page), _HIT).withColumn("k", F.row_number().over(order)).where(F.col("k") <= page).drop("k"), f"page-{k}-{turn}")
            kept = write(hits.groupBy("question").applyInArrow(_kept(limits, told, config), _HIT), f"kept-{k}-{turn}")
            found.append(kept)
            full = {r["question"]: (r["last"]["s"], -r["last"]["e"]) for r in hits.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("score").alias("s"), (-F.col("event")).alias("e"))).alias("last")).where(F.col("n") == page).collect()}
            for r in kept.select("question", "tokens", "flags").collect():  # at most limit a question
                told.setdefault(r["question"], []).append((r["tokens"], r["flags"]))
            more = [i for i, x in full.items() if len(told.get(i, [])) < limit]
            if not more:
                break
            # questions that are done read nothing more; hits are sent once, however many questions have them
            hit_at: dict[tuple, int] = {}
            q.told_hits, q.told = [], [[] for _ in rows]
            for i in more:
                for own, f in told.get(i, []):
                    key = (tuple(own), f)
                    if key not in hit_at:
                        hit_at[key] = len(q.told_hits)
                        q.told_hits.append((np.asarray(own, np.int64), f))
                    q.told[place[i]].append(hit_at[key])
            q.end = [full[r["id"]] if r["id"] in more else (-np.inf, 0) for r in rows]
            asking = q.only(sorted(place[i] for i in more))
            turn += 1
    if not found:
        return None
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    order = Window.partitionBy("question").orderBy(F.desc("score"), "event")
    return out.drop("tokens", "flags").withColumn("place", F.row_number().over(order))


def explained(hits: DataFrame, questions: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """hits with explanation: the nodes it is found by (or the question's first two), the graph, sources, freshness, importance. seeds: (question, event) of a deep search."""
    h = hits.join(questions.select(F.col("id").alias("question"), F.slice("seeds", 1, 2).alias("first")), "question")
    graph = F.size("matched") > 0
    names = F.transform(F.slice(F.when(graph, F.col("matched")).otherwise(F.col("first")), 1, 4), lambda n: F.concat(F.lit(V.WHY["node"]), n))
    one = lambda where, text: F.when(where, F.array(text)).otherwise(F.array().cast("array<string>"))
    head, tail = V.WHY["sources"]
    parts = [names, one(graph, F.lit(V.WHY["graph"])), one(F.col("sources") >= 2, F.concat(F.lit(head), F.col("sources").cast("string"), F.lit(tail))), one(F.col("fresh") >= 0.7, F.lit(V.WHY["fresh"])), one(F.col("importance") >= 6, F.lit(V.WHY["important"]))]
    if seeds is not None:
        h = h.join(seeds.select("question", "event", F.lit(True).alias("seed")).distinct(), ["question", "event"], "left")
        parts.append(one(F.col("seed"), F.lit(V.WHY["deep"])))
    return h.withColumn("explanation", F.concat(*parts)).drop("first")


def answered(hits: DataFrame, questions: DataFrame, events: DataFrame, contexts: int = 6, most: int = 5) -> DataFrame:
    """(question, answer, used, relevant, faithful) of questions (id, text): the best confirmed, freshest hits that hold enough of the question's words, a line each.
    events: (id, title, summary). Questions without such hits get the empty answer."""
    order = Window.partitionBy("question").orderBy(F.desc("sources"), F.desc("fresh"), F.desc("score"), "event")
    top = hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= contexts).join(events.select(F.col("id").alias("event"), "title", F.substring("summary", 1, 600).alias("summary")), "event")
    q = questions.select(F.col("id").alias("question"), "text")
    word = rf"array_distinct(regexp_extract_all(lower(text), '[{E.WORD}]{{3,}}', 0))".replace("\\", "\\\\")
    q = q.withColumn("all", F.expr(word)).withColumn("told", F.filter("all", lambda t: ~F.regexp_like(t, F.lit(r"^\p{Nd}+$"))))
    q = q.withColumn("words", F.when(F.size("told") > 0, F.col("told")).otherwise(F.col("all"))).drop("all", "told")
    c = top.join(q, "question").withColumn("blob", F.lower(F.concat_ws(" ", "title", "summary")))
    need = F.when(F.size("words") <= 2, 1).otherwise(F.greatest(F.lit(1), F.floor(F.size("words") / 2)))
    c = c.where(F.size(F.filter("words", lambda t: F.contains(F.col("blob"), t))) >= need)
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("k"))).where(F.col("n") <= most)
    lines = c.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("n", "event", F.concat(F.lit("• "), "title", F.lit(": "), F.substring("summary", 1, 160)).alias("line"), "blob"))).alias("c"))
    a = q.join(lines, "question", "left").withColumn("relevant", F.col("c").isNotNull())
    head, tail = V.ANSWER_HEAD
    answer = F.when(F.col("relevant"), F.concat_ws("\n", F.concat(F.lit(head), "text", F.lit(tail)), F.array_join(F.col("c.line"), "\n"))).otherwise(V.ANSWER_EMPTY)
    a = a.select("question", "text", answer.alias("answer"), F.coalesce(F.col("c.event"), F.array().cast("array<long>")).alias("used"), "relevant", F.coalesce(F.array_join(F.col("c.blob"), " "), F.lit("")).alias("evidence"))
    return a.select("question", "answer", "used", "relevant", F.expr(E.faithful("text", "answer", "evidence")).alias("faithful"))
