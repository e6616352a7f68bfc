"""Operators 1, 3 and 7 against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest

from postloom.llm import op1_minhash as M
from postloom.llm import op3_pstable as V
from postloom.llm import op7_suffix_index as S
from postloom.llm.common import Scratch, components


def _words(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 40)) for _ in range(n)]


def _edited(r, words, share):
    return [w if r.random() > share else f"x{r.randint(0, 10**6)}" for w in words]


def _components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _shingles(text, w):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + w]) for k in range(max(1, len(words) - w + 1))} if words else set()


@pytest.mark.parametrize("block, width", [(512, 4), (16, 4), (16, 5)])
def test_minhash_equals_brute_force(spark, docs_of, block, width):
    r = random.Random(3)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "a b c d", "A B C D", "a b c e"]
    base = _words(r, 150)
    texts += [" ".join(_edited(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.04, 0.08]))) for _ in range(90)]
    passage = _words(r, 60)
    texts += [" ".join(_words(r, 50) + passage + _words(r, 30)) for _ in range(40)]
    for _ in range(25):
        other = _words(r, r.choice([20, 80, 300]))
        texts += [" ".join(_edited(r, other, s)) for s in (0, 0.01, 0.02, 0.1)]
    sets = [_shingles(t, width) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    wanted = _components(len(sets), links)
    got = {x["doc_id"]: x for x in M.near_duplicates(spark, docs_of(list(enumerate(texts))), width=width, block=block).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == wanted
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (wanted[i] == i) for i in got)


def test_minhash_edges(spark, docs_of):
    assert M.near_duplicates(spark, docs_of([])).count() == 0
    got = M.near_duplicates(spark, docs_of([(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e")])).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in got) == [(-1, -1), (3, 3), (5, 3), (5, 3)]
    assert M.miss_rate(0.8) < 1e-5


def test_minhash_ids_of_several_texts_are_one_document(spark, docs_of):
    a, b, c = "a b c d e", "p q r s t", "u v w x y"
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, None), (9, c), (9, c), (11, b), (12, ""), (None, a)]
    got = M.near_duplicates(spark, docs_of(rows)).collect()
    assert sorted((x["doc_id"] or -1, x["n_shingles"], x["component_id"] or -1) for x in got) == sorted(
        [(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 2, 3), (8, 2, 8), (9, 0, 8), (9, 2, 8), (9, 2, 8), (11, 2, 3), (12, 0, 12), (-1, 2, -1)]
    )
    assert all(x["kept"] == (x["doc_id"] in (3, 8, 12, None)) for x in got)


def test_minhash_merging_counts_collisions():
    """Prefix merging and skipping find exactly the documents whose signatures agree in enough coordinates."""
    import pyarrow as pa

    g = np.random.default_rng(4)
    base = g.integers(0, 2**32, (6, 64), dtype=np.uint32)
    sig = np.stack([np.where(g.random(64) < 0.8 - 0.1 * (k % 4), base[k % 6], g.integers(0, 9, 64).astype(np.uint32)) for k in range(80)])
    rows = pa.table({"doc": np.arange(80), "shingles": [np.arange(3, dtype=np.uint64).tobytes()] * 80, "sig": [s.tobytes() for s in sig]})
    block = M._Block(rows, 80, 36)
    for i in range(80):
        agree = (sig == sig[i]).sum(1)
        found, hits = block.merged(i, np.arange(80) != i)
        assert found.tolist() == [j for j in range(80) if j != i and agree[j] >= 36] and (hits == agree[found]).all()


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 199), r.randint(0, 199)) for _ in range(120)] + [(i, i + 1) for i in range(150, 180)]
    wanted = _components(200, links)
    got = {x["v"]: x["label"] for x in components(spark, spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {v: wanted[v] for e in links if e[0] != e[1] for v in e}


@pytest.mark.parametrize("block", [512, 8])
def test_vectors_equal_brute_force(spark, block):
    r = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = r.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(12):
            rows.append((len(rows), (centre + 0.09 * r.standard_normal(32) / np.sqrt(32)).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)] + [(len(rows) + 5, rows[0][1], 1), (len(rows) + 6, rows[0][1], None)]
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [None] * 32, [1.0, 2.0]]
    rows += [(1000 + k, x, 0) for k, x in enumerate(bad)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {x["vec_id"]: x for x in V.near_vectors(spark, df, block=block).collect()}
    fine = [x for x in rows if x[1] and len(x[1]) == 32 and None not in x[1] and np.isfinite(x[1]).all() and any(x[1]) and x[2] is not None]
    u = np.array([np.float32(x[1]) for x in fine], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & np.equal.outer([x[2] for x in fine], [x[2] for x in fine])
    np.fill_diagonal(near, False)
    comp = _components(len(fine), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    for k, x in enumerate(fine):
        assert (got[x[0]]["n_links"], got[x[0]]["component_id"]) == (near[k].sum(), fine[comp[k]][0])
    for k in range(len(bad)):
        assert (got[1000 + k]["n_links"], got[1000 + k]["component_id"], got[1000 + k]["kept"]) == (0, 1000 + k, True)
    assert V.near_vectors(spark, df.limit(0)).count() == 0 and len(got) == len(rows)
    assert V.miss_rate(0.98) < 1e-3 and V.miss_rate(0.99) < 1e-5


def _without(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha) by the definition."""
    out, seen = {}, set()
    for i in sorted({i for i, _ in rows}):
        fresh = set()
        for j, text in rows:
            if j != i:
                continue
            raw = (text or "").encode()
            gone = np.zeros(len(raw) + 1, int)
            for k in range(len(raw) - length + 1):
                if raw[k : k + length] in seen:
                    gone[k : k + length] = 1
                fresh.add(raw[k : k + length])
            left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
            out[i] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(left).hexdigest())
        seen |= fresh
    return out


@pytest.mark.parametrize("batch, hot, block_bytes", [(2048, 20_000, 4 << 20), (3, 20_000, 3_000), (3, 4, 3_000), (2048, 2, 1)])
def test_repeats_equal_brute_force(spark, docs_of, batch, hot, block_bytes):
    """Levels that merge, hot anchors and blocks of one document."""
    r = random.Random(4)
    long_ = " ".join(_words(r, 60))
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 50, "x" * 130, long_, long_, long_[7:200], "é" * 80, "ab" + "é" * 60, "日本語テキスト" * 10, "語テキスト日本" * 10, "nul\0" * 30, "\0" * 120]
    texts += [" ".join(_words(r, 30)) + long_[a : a + r.choice([30, 49, 50, 51, 80])] + " ".join(_words(r, 20)) for a in range(0, 100, 5)]
    rows = list(enumerate(texts)) + [(7, long_)]
    r.shuffle(rows)
    got = S.without_repeats(spark, docs_of(rows), batch=batch, hot=hot, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    wanted = _without(rows)
    for x in got:
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) == wanted[x["doc_id"]], x["doc_id"]


def test_repeats_edges(spark, docs_of):
    assert S.without_repeats(spark, docs_of([])).count() == 0
    got = S.without_repeats(spark, docs_of([(None, "q" * 60), (1, "q" * 60)]), carry={"carried": "score"}).collect()
    assert sorted((x["doc_id"] or -1, x["n_removed"], x["carried"]) for x in got) == [(-1, 0, "x"), (1, 0, "x")]


def test_only_windows_that_repeat_are_indexed(monkeypatch):
    """Pieces of one bucket share an anchor but mostly not a whole window: those windows take no place in an index, and the covered runs are those of brute force."""
    r = random.Random(9)
    word = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    shared = [word(20) for _ in range(3)]
    places, texts = {}, []
    for doc in range(400):
        piece = word(r.randint(15, 40)) + r.choice(shared) + word(r.randint(15, 40))
        if doc % 20 == 19:
            piece = texts[doc - 1]
        elif doc % 10 == 9:
            piece = word(5) + texts[doc - 3][:58] + word(6)
        texts.append(piece)
        places.setdefault(piece, []).append((doc, doc // 50, doc, 0))
    indexed = []

    class Level(S._Level):
        def __init__(self, text, at, *rest):
            indexed.append(len(at))
            super().__init__(text, at, *rest)

    monkeypatch.setattr(S, "_Level", Level)
    got = set()
    for _, row, x, y in S._judged(places, S.LENGTH, 64):
        got |= {(row, k) for k in range(x, y)}
    seen, want = set(), set()
    for doc, text in enumerate(texts):
        own = {text[k : k + S.LENGTH]: k for k in range(len(text) - S.LENGTH + 1)}
        want |= {(doc, k + j) for w, k in own.items() if w in seen for j in range(S.LENGTH)}
        seen |= set(own)
    windows = sum(len(p) - S.LENGTH + 1 for p in places)
    assert got == want and want
    assert max(indexed) < windows // 8, (max(indexed), windows)
    assert S._judged({}, S.LENGTH, 64) == [] and not S.repeated_windows([], S.LENGTH, 64).any()


def test_rows_of_one_id_are_judged_by_their_own_text(spark, docs_of):
    a, b = "q" * 60, "z" * 70
    got = S.without_repeats(spark, docs_of([(1, a), (2, a), (2, b), (2, b), (3, b)]), as_text=True).collect()
    assert sorted((x["doc_id"], x["n_removed"], x["kept"]) for x in got) == [(1, 0, a), (2, 0, b), (2, 0, b), (2, 60, ""), (3, 70, "")]


def test_index_family_equals_definition():
    """Many batches: levels hold powers of two, and every suffix is judged as a dictionary of all before it would."""
    r = random.Random(9)
    family, seen, adds = S.IndexFamily(8, scan=5), {}, 0
    for k in range(13):
        pieces = ["".join(r.choice("ab") for _ in range(r.randint(8, 20))).encode() for _ in range(r.randint(1, 4))]
        docs = np.array(sorted(r.randint(3 * k, 3 * k + 3) for _ in pieces))
        for p, d in zip(pieces, docs.tolist(), strict=True):
            for x in range(len(p) - 7):
                seen[p[x : x + 8]] = min(d, seen.get(p[x : x + 8], d))
        wanted = [seen[p[x : x + 8]] < d for p, d in zip(pieces, docs.tolist(), strict=True) for x in range(len(p) - 7)]
        assert family.add(pieces, docs).tolist() == wanted
        adds += 1
        assert [x.batches for x in family.levels] == [1 << b for b in range(9, -1, -1) if adds >> b & 1]
        assert all((x.heads()[1:] > x.heads()[:-1]).all() for x in family.levels)


def test_anchor_runs_in_steps():
    raw = np.random.default_rng(2).integers(0, 3, 5_000).astype(np.uint8)
    for step in (1, 7, 1_000):
        assert all((x == y).all() for x, y in zip(S.anchor_runs(raw, 7), S.anchor_runs(raw, 7, step=step), strict=True))
    names = S.anchor_runs(raw, 7)[2]
    assert (S._received(S._sent(names[names >> np.uint64(40) == 3]), 3) == names[names >> np.uint64(40) == 3]).all()


def test_window_anchors_depend_on_windows_alone():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, 300).astype(np.uint8), r.integers(0, 4, 300).astype(np.uint8)
    b[100:180] = a[37:117]
    x, y = S.window_anchors(a), S.window_anchors(b)
    assert (x[37 : 117 - 49] == y[100 : 180 - 49]).all() and len(x) == 251


def test_exchanges_of_repeats_grow_with_the_input(spark):
    """With small blocks and buckets, so that no minimum hides it: ten times the input gives at most some ten times the rows, in every exchange."""
    r = random.Random(8)
    common = ["".join(r.choice("abcdefgh ") for _ in range(120)) for _ in range(20)]

    def rows(n):
        docs = spark.createDataFrame([(i, r.choice(common) + "".join(r.choice("abcdefgh ") for _ in range(1_500)) + r.choice(common)) for i in range(n)], "doc_id long, text string").repartition(4, "doc_id")
        blocks = docs.mapInArrow(S._blocks(4_000), "block long, n_bytes long, packed binary").persist()
        total = sum(x["n_bytes"] for x in blocks.select("n_bytes").collect())
        found = S.exchanges(blocks.select("block", "packed"), total, bucket_bytes=2_000, gather=1 << 20)
        counts = {k: v.count() for k, v in found.items()}
        n_blocks = blocks.count()
        blocks.unpersist()
        return n_blocks, counts

    (few, small), (many, large) = rows(60), rows(600)
    assert many > 8 * few and all(small.values())
    for name, n in large.items():
        assert n <= 12 * small[name] and n <= 10 * many, (name, small, large)
