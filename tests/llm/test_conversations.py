"""Operators 11, 12 and 13 against enumeration, round trips and plain folds, and their edge cases."""

import functools
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.llm import op11_repair_grammar as R
from postloom.llm import op12_fim_skiplist as S
from postloom.llm import op13_event_chat as E

# ---- 11


def cheapest(symbols):
    """(cost, audit) by trying every sequence of edits, with up to two inserts in a row."""
    fits = re.compile("(s?(ua)+)?")

    @functools.cache
    def ways(k):
        """Every (cost, audit, initials) of the rows from k on."""
        tail = [(0, "", "")]
        if k < len(symbols):
            c, more = symbols[k], 5 if symbols[k].isupper() else 0
            own = [(2, "D", "")]
            if c != "x":
                own += [(1 + more, "R", "u"), (1 + more, "R", "a"), (more, "K", c.lower())]
            tail = [(p + q, x + y, i + j) for p, x, i in own for q, y, j in ways(k + 1)]
        gaps = [(5 * len(g), "I" * len(g), g) for g in ("", "u", "a", "ua", "au")]
        return [(p + q, x + y, i + j) for p, x, i in gaps for q, y, j in tail]

    return min((cost, audit) for cost, audit, initials in ways(0) if fits.fullmatch(initials))


def test_matrices_equal_enumeration():
    r = random.Random(1)
    for _ in range(150):
        symbols = "".join(r.choice("suaoSUAOx") for _ in range(r.randrange(0, 4)))
        assert R.repaired_cost(symbols) == cheapest(symbols), symbols


def test_grammar_and_segments_change_nothing():
    r = random.Random(2)
    sequences = ["".join(r.choice("suaoSUAOxuaua") for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["u" * 40, "ua" * 50, "a" * 33]
    rules = ()
    for _ in range(12):
        counts = R.pair_counts(R.Grammar(rules).compressed(sequences))
        best = max(counts, key=lambda p: (counts[p], p))
        if counts[best] < 2:
            break
        rules += (best,)
    grammar = R.Grammar(rules)
    packed = grammar.compressed(sequences)
    assert sum(map(len, packed)) < 0.8 * sum(map(len, sequences))
    for s, p in zip(sequences, packed, strict=True):
        want = R.repaired_cost(s)
        assert grammar.whole[p] == want
        cut = sorted(r.sample(range(len(s) + 1), 2))
        assert R.joined_cost([grammar.transfer(x) for x in grammar.compressed([s[: cut[0]], s[cut[0] : cut[1]], s[cut[1] :]])]) == want


def test_pairs_of_a_run_do_not_overlap():
    assert R.pair_counts(["aaaaa", "aab"]) == {"aa": 3, "ab": 1} and R.pair_counts([]) == {} and R.pair_counts(["a"]) == {}


def test_ropes_compare_without_flattening():
    x, y = ("KK", ("D", "K")), (("K", "KD"), "KR")
    assert R.earlier(x, y) and not R.earlier(y, x) and not R.earlier(x, x) and not R.earlier(("K", "K"), "KK") and "".join(R.leaves(y)) == "KKDKR"


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
    (2, 0, "system", "Be good."), (2, 1, "assistant", "cut off"), (2, 4, "user", "Hello!\n"), (2, 5, "user", "Hello!\n"), (2, 6, "tool", "x?"),
    (3, None, None, None), (3, None, "user", "a."), (3, 7, "user", "a."), (3, 7, "user", "a."), (3, 9, "", "odd."),
    (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (4, None, "user", "\x0b\t "), (5, 3, "assistant", "é. \x0c"),
]


def plain_report(rows):
    """The report of (turn, role, text) rows in order, by a loop."""
    faults, seen, out = [], set(), []
    for turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "none" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = R.repaired_cost("".join(R.symbol(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)))
    left, state = list(rows), ""
    for e in audit:
        row = left.pop(0) if e != "I" else (None, "", "")
        if e == "D":
            continue
        role = row[1] if e == "K" else "assistant" if state == "u" else "user"
        state = role[:1]
        out.append(f"{role}:{row[2]}")
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]  # noqa: B905
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    told = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(told, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))


@pytest.mark.parametrize("segment", [4_096, 2])
def test_repair_of_odd_conversations(spark, segment):
    r = random.Random(segment)
    long = [(9, t // 3, r.choice(["user", "assistant", "system", "assistant"]), r.choice(["Yes.", "no", "", f"{t}.", f"{t}"])) for t in range(400)]
    names = "conv_id long, turn long, role string, text string, kind string, plan string, digest string"
    df = spark.createDataFrame([(*x, "k", "p", "d") for x in ROWS + long], names).repartition(5)
    ids = spark.createDataFrame([(1,), (77,), (77,)], "conv_id long")
    planned = R.plans(df, segment=segment)
    got = {x["conv_id"]: tuple(x)[1:] for x in R.report(df, planned, ids).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 9, 77, None} and got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in set(got) - {77}:
        assert got[conv] == plain_report(in_order([x[1:] for x in ROWS + long if x[0] == conv])), conv
    assert got[1][5:7] == (0, "KK") and got[4][5:7] == (2, "D")
    lines = {}
    for x in sorted(R.repaired(df, planned).where("edit <> 'D'").collect(), key=lambda x: x["position"]):
        lines.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
    for conv, found in lines.items():
        assert hashlib.sha256("\n".join(found).encode()).hexdigest() == got[conv][-1]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.report(none, R.plans(none), none.select("conv_id")).collect() == [] and R.damaged(none).collect() == []


# ---- 12

TEXTS = [None, "", " ", "a", " a", "a ", "a b\n c\t\td  ", "é ü\x0b日本 語", "has <P> inside", "<S>", "<M", "x<", "a <P <S b>", "\xa0 \x85 \x1c", "w " * 20_000 + "end", "😀 " * 300]


def test_transformation_of_texts_and_back(spark):
    rows = [(k * 17 + j, t) for k, t in enumerate(TEXTS) for j in range(17)] + [(None, "a b c"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    for plan in (S.Plan(), S.Plan(seed=7, plain=100, spm=50)):
        out = S.fill_in_middle(df, plan=plan)
        want = {}
        for i, t in rows:
            text = t or ""
            h = hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
            tok = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
            n = len(tok)
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            p, m, s = ("".join(x) for x in (tok[:a], tok[a:b], tok[b:]))
            if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.plain:
                want[i] = (n, "plain", None, None, text)
            elif h4 % 100 < plan.spm:
                want[i] = (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
            else:
                want[i] = (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        got = out.collect()
        assert len(got) == len(rows) and {x["doc_id"]: tuple(x)[1:] for x in got} == want
        assert sorted((x["doc_id"] or 0, x["text"]) for x in S.restored(out).collect()) == sorted((i or 0, t or "") for i, t in rows)
        assert {x["doc_id"]: x["restored_sha256"] for x in S.digests(df, plan=plan).collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_skip_list_reaches_every_rank(fan):
    r = random.Random(fan)
    for n in (0, 1, 2, 15, 16, 17, 300):
        text = "".join(r.choice(["a", "é", "日本", "😀"]) * r.randrange(1, 4) + " " * r.randrange(1, 3) for _ in range(n))
        widths = S.token_widths(text.encode())
        tokens = re.findall(r" *[^ ]+| +", text)
        assert len(widths) == len(tokens)
        index = S.SkipList(widths, fan)
        for rank in range(len(tokens) + 1):
            before = "".join(tokens[:rank])
            assert index.seek(rank) == (len(before), len(before.encode()))
        with pytest.raises(IndexError):
            index.seek(len(tokens) + 1)


def test_transformation_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.fill_in_middle(none).collect() == [] and S.digests(none).collect() == []


# ---- 13

TALKS = [
    (1, 0, "system", "\\b \\l <turn user>"), (1, 1, "user", "</turn>\n"), (1, 2, "assistant", "x" * 900 + "<\\"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, None, "assistant", "first"), (2, 0, None, "no role"), (2, 0, "a>b\n", "é😀"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"),
    (None, 1, "assistant", "null id"), (3, 5, "user", "alone"),
]


def expected(rows):
    turns = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    loss = "".join(x for _, r, x in turns if r == "assistant")
    size = lambda s: len(s) + sum(s.count(c) for c in "\\<>")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), sum(16 + size(r) + size(x) for _, r, x in turns)


def test_logs_are_folded_rendered_and_read_back(spark):
    df = spark.createDataFrame([(*x, "m", "l") for x in TALKS], "conv_id long, turn long, role string, text string, message string, loss string").repartition(3)
    log = E.log_of(df).repartition(4)
    twice = log.unionAll(log.where("kind <> 'edit'")).unionAll(log.where("kind = 'edit'"))
    for events in (log, twice):
        parts = E.fragments(E.folded(events))
        got = {x["conv_id"]: tuple(x)[1:] for x in E.report(E.assembled(parts)).collect()}
        assert got == {c: expected([x[1:] for x in TALKS if x[0] == c]) for c in {x[0] for x in TALKS}}
        for row in E.assembled(parts).collect():
            for m, p in zip(row["mask"], sorted((p for p in parts.collect() if p["conv_id"] == row["conv_id"]), key=lambda p: p["position"]), strict=True):
                assert row["formatted"][m["start"] :].startswith(p["fragment"])


def test_fold_of_edits_and_regenerations(spark):
    rows = [
        (1, 1, 10, "open", "assistant", None), (1, 1, 11, "delta", None, "a"), (1, 1, 12, "regenerate", None, None), (1, 1, 14, "delta", None, "c"), (1, 1, 13, "delta", None, "b"),
        (1, 2, 20, "open", "user", None), (1, 2, 21, "delta", None, "old"), (1, 2, 40, "edit", None, "new"), (1, 2, 41, "delta", None, "er"), (1, 2, 40, "edit", None, "new"),
        (1, 3, 30, "open", "user", None), (1, 3, 31, "edit", None, None), (1, 4, 50, "note", None, "unknown"), (1, 5, None, "delta", None, "unnumbered"), (1, 6, 60, None, "x", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, payload string")
    got = {x["message"]: (x["first"], x["role"], x["text"]) for x in E.folded(df).collect()}
    assert got == {1: (10, "assistant", "bc"), 2: (20, "user", "newer"), 3: (30, "user", ""), 4: (50, "", ""), 5: (None, "", "unnumbered"), 6: (60, "", "")}


def test_chat_runs_no_python_and_takes_empty_tables(spark, sf):
    plan = E.op13_event_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert E.report(E.assembled(E.fragments(E.folded(E.log_of(none))))).collect() == []
    assert E.report(E.assembled(E.fragments(E.folded(E.log_of(none.unionByName(E.nasty(spark))))))).select("conv_id", "n_turns", "loss_chars").collect() == [(-7, 2, 26)]
    assert E.log_of(spark.createDataFrame(TALKS, none.schema)).where(F.col("kind") == "edit").count() > 0
