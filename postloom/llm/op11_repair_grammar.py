"""Operator 11: conversation structure repair by dynamic programming over a grammar-compressed corpus.

A conversation's rows become one symbol each: the initial of the role (system, user, assistant, other) and the row's fault (none, truncated,
or blank/duplicate, which must go). Re-Pair replaces the most frequent adjacent symbols of the whole corpus by rules, round by round. Each
symbol has a transfer matrix over the states of `(s?(ua)+)?` whose entries are the least cost and the audit (the edits' initials) as a rope;
a rule's matrix is the min-plus product of its two symbols' matrices, made once, bottom-up, for all conversations. A conversation is then a
product of few matrices. Of equal costs the ASCII-least audit wins; that is sound in products, because no audit of a row sequence is the start of
another of equal cost (the rest would be inserts, which cost).

On Spark: texts are read twice and shuffled once. Light rows (ids, role, a digest of role and text, faults) find repeated messages by an aggregation,
are sorted by ranges of (conversation, turn), so that a conversation with a third of all rows lies in many tasks, and are cut into segments of at
most SEGMENT rows. The grammar has at most ROUNDS * RULES rules and is all that the driver sees; it bounds compression, never results. Segments
are evaluated where they lie; only those that may continue elsewhere are joined by matrix products. At last texts and plans meet, sorted by
conversation and turn, and flow through: no conversation's texts are held. What must be in one place is what the output has in one value: a
conversation's audit, and its digest, which by its nature is computed in order.

Nulls: in role and text they count as one space; null turns come first, null conversations are one conversation. Rows of one turn are taken by role,
then by a digest of role and text; repeated rows are duplicates. A role that is empty has no initial and is like any other role. An empty
table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, Scratch, alone, resident

#: Rows of a segment.
SEGMENT = 4_096
#: Re-Pair: rounds over the corpus, and the most rules that a round adds.
ROUNDS, RULES = 6, 64
#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the output so far: nothing, system, user, assistant. It may end in the first and the last.
STATES, ENDS = 4, (0, 3)
_NEXT = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
_SPACE = " \t\n\x0b\x0c\r"
_FIRST_RULE = 0x4E00

Entry = tuple[int, object] | None


def leaves(rope: object) -> Iterator[str]:
    """A rope is a text or a pair of ropes."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if top:
                yield top
        else:
            stack += (top[1], top[0])


def earlier(x: object, y: object) -> bool:
    """x comes before y in ASCII order; neither is flattened further than to their first difference."""
    if x is y:
        return False
    a, b, p, q = leaves(x), leaves(y), "", ""
    while True:
        p, q = p or next(a, ""), q or next(b, "")
        if not p or not q:
            return bool(q)
        n = min(len(p), len(q))
        if p[:n] != q[:n]:
            return p[:n] < q[:n]
        p, q = p[n:], q[n:]


def better(x: Entry, y: Entry) -> Entry:
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if earlier(y[1], x[1]) else x


def product(a: list[list[Entry]], b: list[list[Entry]]) -> list[list[Entry]]:
    """Min-plus product of transfer matrices (or of a row of one); audits are joined as ropes."""
    out = []
    for row in a:
        line: list[Entry] = [None] * STATES
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None:
                        line[j] = better(line[j], (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]))
        out.append(line)
    return out


def _matrix(entries) -> list[list[Entry]]:
    m: list[list[Entry]] = [[None] * STATES for _ in range(STATES)]
    for i, j, cost, letter in entries:
        m[i][j] = better(m[i][j], (cost, letter))
    return m


_SAME = [(i, i, 0, "") for i in range(STATES)]
_INSERT = _matrix(_SAME + [(i, j, INSERT, "I") for c in "ua" for i, j in _NEXT[c]])
#: Any number of inserts; more than two would pass a state twice.
INSERTS = product(_INSERT, _INSERT)


def symbol(initial: str, fault: str) -> str:
    """One letter of a row: its role's initial (o: none that fits), a capital where it is truncated, x where it must go."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = initial if initial in _NEXT else "o"
    return letter.upper() if fault == "truncated" else letter


def terminal(letter: str) -> list[list[Entry]]:
    """Transfer matrix of a row, with the inserts before it."""
    edits = [(i, i, DELETE, "D") for i in range(STATES)]
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        edits += [(i, j, REROLE + more, "R") for c in "ua" for i, j in _NEXT[c]]
        edits += [(i, j, KEEP + more, "K") for i, j in _NEXT.get(letter.lower(), ())]
    return product(INSERTS, _matrix(edits))


class Grammar:
    """Rules, each of two symbols (letters or earlier rules), with a matrix for every symbol."""

    def __init__(self, rules: tuple[str, ...]):
        self.rules = rules
        self.matrix = {c: terminal(c) for c in "suaoSUAOx"}
        for k, pair in enumerate(rules):
            self.matrix[chr(_FIRST_RULE + k)] = product(self.matrix[pair[0]], self.matrix[pair[1]])
        self.whole = Memo(lambda s: self._ends(self._times(s, [[(0, "")] + [None] * (STATES - 1)])), 100_000)

    def compressed(self, sequences: list[str]) -> list[str]:
        """Every rule replaced from the left, in the order of the rules; all sequences at once."""
        joined = "\n".join(sequences)
        for k, pair in enumerate(self.rules):
            joined = joined.replace(pair, chr(_FIRST_RULE + k))
        return joined.split("\n") if sequences else []

    def _times(self, compressed: str, start: list[list[Entry]]) -> list[list[Entry]]:
        for c in compressed:
            start = product(start, self.matrix[c])
        return start

    @staticmethod
    def _ends(row: list[list[Entry]]) -> tuple[int, str]:
        last = product(row, INSERTS)[0]
        cost, rope = better(last[ENDS[0]], last[ENDS[1]])
        return cost, "".join(leaves(rope))

    def transfer(self, compressed: str) -> list[list[Entry]]:
        return self._times(compressed, _matrix(_SAME))


def repaired_cost(symbols: str) -> tuple[int, str]:
    """(cost, audit) of one sequence of symbols, without a grammar."""
    return Grammar(()).whole[symbols]


def joined_cost(parts: list[list[list[Entry]]]) -> tuple[int, str]:
    """(cost, audit) of consecutive segments by their matrices."""
    row: list[list[Entry]] = [[(0, "")] + [None] * (STATES - 1)]
    for m in parts:
        row = product(row, m)
    return Grammar._ends(row)


def pair_counts(sequences: list[str]) -> dict[str, int]:
    """How often each two symbols stand side by side; of a run of one symbol, pairs that do not overlap."""
    code = np.frombuffer("\n".join(sequences).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(code) < 2:
        return {}
    a, b = code[:-1], code[1:]
    run = np.arange(len(code)) - np.maximum.accumulate(np.where(np.append(True, code[1:] != code[:-1]), np.arange(len(code)), 0))
    good = (a != 10) & (b != 10) & ((a != b) | (run[:-1] % 2 == 0))
    pairs, n = np.unique(a[good] << 21 | b[good], return_counts=True)
    return {chr(p >> 21) + chr(p & 0x1FFFFF): k for p, k in zip(pairs.tolist(), n.tolist(), strict=True)}


def learned(segments: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> tuple[str, ...]:
    """Re-Pair over all segments: each round counts the pairs of all compressed sequences (pre-aggregated in the tasks) and makes rules of the most
    frequent ones that do not share a symbol end to end, until no pair occurs twice or the rounds are over."""
    rules: tuple[str, ...] = ()
    for _ in range(rounds):

        def count(batches, rules=rules):
            grammar = resident("repair-" + "".join(rules), lambda: Grammar(rules))
            for b in batches:
                found = pair_counts(grammar.compressed(b.column("symbols").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

        counted = segments.select("symbols").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        chosen: list[str] = []
        for row in counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * most).collect():
            x, y = row["pair"]
            if len(chosen) < most and all(x != p[1] and y != p[0] for p in chosen):
                chosen.append(row["pair"])
        if not chosen:
            break
        rules += tuple(chosen)
    return rules


def _keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    r = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    return r.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _sorted(*first: Column) -> list[Column]:
    return [*first, F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _light(keyed: DataFrame) -> DataFrame:
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "none").otherwise("truncated")
    return keyed.select("conv_id", "turn", "role", "digest", fault.alias("fault"))


def _with_repeats(light: DataFrame) -> DataFrame:
    """light with later: the same role and text stand in an earlier turn. (Rows of the same turn lie side by side once sorted.)"""
    first = light.groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    found = light.join(first, light["conv_id"].eqNullSafe(first["c"]) & (light["digest"] == first["d"]), "left")
    return found.select(*light.columns, (F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later"))


_SEGMENT_SCHEMA = "conv_id long, edge boolean, turn long, role string, digest binary, low long, high long, turns long, initials string, blank long, duplicate long, truncated long, illegal long, symbols string"
_FITS = {"su", "ua", "au"}


def _segment(conv, rows: list, before, edge: bool) -> tuple:
    """One segment's record from (turn, role, digest, fault, later) rows; before: the row in front of it in the same task."""
    faults, kinds = [], {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
    last = before
    for row in rows:
        turn, role, digest, fault, later = row
        if fault != "blank" and (later or (last is not None and last[:3] == row[:3])):
            fault = "duplicate"
        kinds[fault] += 1
        faults.append(symbol(role[:1], fault))
        last = row
    initials = [r[1][:1] or " " for r in rows]
    illegal = sum(x + y not in _FITS for x, y in zip(initials, initials[1:]))  # noqa: B905
    seen = {r[0] for r in rows} - {None}
    turn, role, digest = rows[0][:3]
    return conv, edge, turn, role, digest, min(seen, default=None), max(seen, default=None), len(seen), initials[0] + initials[-1], kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, "".join(faults)


def segments(light: DataFrame, rows: int = SEGMENT) -> DataFrame:
    """Sorted light rows as segments: edge marks those that may go on in another segment."""

    def run(batches):
        alone()
        conv, held, before, first, cut, out = None, [], None, True, False, []

        def flush(edge: bool) -> None:
            out.append(_segment(conv, held, before, edge))

        def table():
            names = [c.split()[0] for c in _SEGMENT_SCHEMA.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
            types = [kinds[c.split()[1]] for c in _SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            for this, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "fault", "later")), strict=True):
                if held and this != conv:
                    flush(first or cut)
                    first, cut, held, before = False, False, [], None
                elif len(held) == rows:
                    flush(True)
                    cut, before, held = True, held[-1], []
                conv = this
                held.append(tuple(row))
            if out:
                yield table()
                out = []
        if held:
            flush(True)
            yield table()

    return light.repartitionByRange(*_sorted(F.col("conv_id").asc_nulls_first())).sortWithinPartitions(*_sorted(F.col("conv_id").asc_nulls_first())).mapInArrow(run, _SEGMENT_SCHEMA)


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _evaluated(parts: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Segments with costs and audits: one value each where the segment is a whole conversation, a whole matrix where it may go on."""

    def run(batches):
        grammar = resident("repair-" + "".join(rules), lambda: Grammar(rules))
        for b in batches:
            costs, audits = [], []
            for edge, s in zip(b.column("edge").to_pylist(), grammar.compressed(b.column("symbols").to_pylist()), strict=True):
                if edge:
                    flat = [x for line in grammar.transfer(s) for x in line]
                    costs.append([x and x[0] for x in flat])
                    audits.append([x and "".join(leaves(x[1])) for x in flat])
                else:
                    cost, audit = grammar.whole[s]
                    costs.append([cost])
                    audits.append([audit])
            keep = [k for k, n in enumerate(b.schema.names) if n != "symbols"]
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in keep] + [pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], [b.schema.names[k] for k in keep] + ["costs", "audits"]
            )

    return parts.mapInArrow(run, _SEGMENT_SCHEMA.removesuffix(", symbols string") + ", costs array<long>, audits array<string>")


def _joined(parts: DataFrame) -> DataFrame:
    """One plan a conversation from its segments' matrices and counts."""
    fields = [c for c in parts.columns if c not in ("conv_id", "edge", "turn", "role", "digest")]
    one = F.struct(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "digest").alias("at"), *fields)
    groups = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("parts"))

    def run(batches):
        for b in batches:
            out = []
            for conv, items in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist(), strict=True):
                sums = {c: sum(x[c] for x in items) for c in _COUNTS}
                sums["illegal"] += sum(x["initials"][1] + y["initials"][0] not in _FITS for x, y in zip(items, items[1:]))  # noqa: B905
                timed = [x for x in items if x["low"] is not None]
                n = sum(x["turns"] for x in timed) - sum(x["high"] == y["low"] for x, y in zip(timed, timed[1:]))  # noqa: B905
                gaps = timed[-1]["high"] - timed[0]["low"] + 1 - n if timed else 0
                flat = [[None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True)] for x in items]
                cost, audit = joined_cost([[m[STATES * i : STATES * i + STATES] for i in range(STATES)] for m in flat])
                out.append((conv, gaps, *sums.values(), cost, audit))
            names = ["conv_id", "gaps", *_COUNTS, "cost", "audit"]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return groups.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def plans(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    scratch = Scratch(rows.sparkSession)
    light = scratch.save(_light(_keyed(rows, conv, turn, role, text)), "light")
    parts = scratch.save(segments(_with_repeats(light), segment), "segments")
    done = scratch.save(_evaluated(parts, learned(parts)), "evaluated")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    whole = done.where("not edge").select("conv_id", gaps.alias("gaps"), *_COUNTS, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    return whole.unionByName(_joined(done.where("edge")))


def _flow(rows: DataFrame, planned: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Plans, rows and further ids of conversations in one stream: by conversation its plan first, then its rows in order."""
    plan = F.struct("gaps", *_COUNTS, "cost", "audit")
    kind = planned.select(plan.alias("plan")).schema["plan"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    stream = planned.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), plan.alias("plan"))
    stream = stream.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", none(kind).alias("plan")))
    if ids is not None:
        stream = stream.unionByName(ids.select("conv_id", F.lit(2).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), none(kind).alias("plan")))
    return stream.repartition("conv_id").sortWithinPartitions(*_sorted(F.col("conv_id").asc_nulls_first(), F.col("kind").asc())).drop("digest")


class _Edits:
    """Applies a conversation's audit to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _say(self, role: str | None) -> str:
        if role is None:
            role = "assistant" if self.state == 2 else "user"
        self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        return role

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", None, self._say(None), ""

    def row(self, turn, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        yield edit, turn, role if edit == "D" else self._say(role if edit == "K" else None), text


def _stream(batches) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its (kind, turn, role, text, plan) in order), one row after the other."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "plan")), strict=True))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, (r[1:] for r in group)


def _edited(group: Iterator[tuple], plan: Callable[[dict], None] = lambda p: None) -> Iterator[tuple]:
    """(edit, turn, role, text) of a conversation's edits in order."""
    edits = _Edits("")
    for kind, turn, role, text, planned in group:
        if kind == 0:
            edits = _Edits(planned["audit"])
            plan(planned)
        elif kind == 1:
            yield from edits.row(turn, role, text)
    yield from edits.inserts()


def repaired(rows: DataFrame, planned: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, edit, turn, role, text): every edit of every conversation in order; without those of edit D it is the repaired corpus."""

    def run(batches):
        alone()
        out = []

        def table():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "position", "edit", "turn", "role", "text"])

        for conv_id, group in _stream(batches):
            for k, edit in enumerate(_edited(group)):
                out.append((conv_id, k, *edit))
                if len(out) == 1_000:
                    yield table()
                    out = []
        if out:
            yield table()

    return _flow(_keyed(rows, conv, turn, role, text), planned, None).mapInArrow(run, "conv_id long, position long, edit string, turn long, role string, text string")


def report(rows: DataFrame, planned: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The plans with repaired_sha256, the digest of the repaired `role:text` lines; with zeros for ids that have no rows."""
    counts = ["gaps", *_COUNTS, "cost"]

    def run(batches):
        alone()
        out = []

        def table():
            names = ["conv_id", *counts, "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in names[-2:] else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names)

        for conv_id, group in _stream(batches):
            found, sha, new = {}, hashlib.sha256(), True
            for edit, _, said, text_ in _edited(group, found.update):
                if edit != "D":
                    sha.update(f"{'' if new else chr(10)}{said}:{text_}".encode())
                    new = False
            out.append((conv_id, *(found.get(c, 0) for c in counts), found.get("audit", ""), sha.hexdigest()))
            if len(out) == 1_000:
                yield table()
                out = []
        if out:
            yield table()

    return _flow(_keyed(rows, conv, turn, role, text), planned, ids).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage_kind(conv: str = "conv_id", turn: str = "turn") -> Column:
    """0: the row is dropped, 1: emptied, 2: loses its sentence ends, 3: is repeated, 4: gets the role user; others stay."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of id and turn."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), damage_kind().alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    c = c.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return c.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text")


def op11_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(conversations)
    return report(rows, plans(rows), conversations.where(damage_kind() == 0).select("conv_id"))
