"""Operators 5 and 8: held-out accuracy, restoration, marginals against brute force; the pipeline."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import op5_toxicity as X
from postloom.llm import op8_line_crf as Q
from postloom.llm.registry import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, accuracy", [("op5_toxicity", "toxic", 0.9), ("op8_line_crf", "quality", 0.97)])
def test_held_out_accuracy(spark, held_out, name, label, accuracy):
    got = queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(held_out)).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert (out.predicted == out[label]).mean() >= accuracy


@pytest.fixture(scope="module")
def toxicity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return X.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_restores_noisy_words(toxicity):
    """A model of its own text: signs, spacing and repeats come off."""
    n = np.full((27, 27, 27), 1e-4)
    for w in ["stupid", "idiot", "loser", "trash", "a", "a"] * 5:
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            n[a, b, d] += 1
    r = X.Restorer(np.log(n / n.sum(2, keepdims=True)))
    for noisy, word in (("stup1d", "stupid"), ("$tup1d", "stupid"), ("1d10t", "idiot"), ("l0ser", "loser"), ("tr@sh", "trash"), ("stuuupid", "stupid"), ("looooser", "loser")):
        assert r.decode(noisy) == word
    assert r.words("you are such a s t u p i d l0ser and an idiooot") == ["a", "stupid", "loser", "idiot"]
    assert r.restore("You are such a $tup1d L0SER, and (s-t-u-u-u-p-1-d).") == "you are such a stupid loser, and (stupid)."
    assert r.words("plain words, 3 of them; a - b and c!!") == []


def test_restores_mixed_noise():
    """Signs anywhere, any separators, three units or more, doubled letters, and these together."""
    n = np.full((27, 27, 27), 1e-4)
    for w in ["idiot", "shit", "ass", "stupid"] * 5:
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            n[a, b, d] += 1
    r = X.Restorer(np.log(n / n.sum(2, keepdims=True)))
    wanted = {
        "idiot": ["i d 1 o t", "i  d  i  o  t", "i\nd\ni\no\nt", "i/d/i/o/t", "i,d,i,o,t", "i. d. i. o. t", "i-d-i_o.t", "idio7", "1d10t!!", "iiddiioott", "11ddiioott", "ii dd 1 oo t"],
        "shit": ["s-h-1-t", "s.h/!.t", "5h17"], "ass": ["a s s", "a$$", "a-$-$"], "stupid": ["s t u p 1 d", "$ t  u-p,i d", "ssttuuppiidd"],
    }
    for word, spans in wanted.items():
        for noisy in spans:
            assert r.words(f"you are {noisy}, they say") == [word], noisy
    assert r.words("so! 3, 4, 5 and 2024; a+ b") == []


def test_viterbi_equals_enumeration():
    """The decoded reading is the cheapest of all readings of the lattice."""
    g = np.random.default_rng(6)
    model = np.log(g.dirichlet(np.full(27, 0.2), (27, 27)) + 1e-9)
    r = X.Restorer(model)

    def cost(read, extra):
        c = [0, 0, *(X._CODES.get(x, 0) for x in read), 0]
        return extra - sum(model[a, b, d] for a, b, d in zip(c, c[1:], c[2:], strict=False))

    for span in ["s7up1d", "s t u p 1 d", "a55", "é t é", "ii dd 1 oo t", "1d10t!!", "b-4-d", "looose", "0", "x", "|1|"]:
        ways = [("".join(a for a, _ in arcs), sum(c for _, c in arcs)) for arcs in itertools.product(*r.lattice(span))]
        assert np.isclose(cost_of := min(cost(*w) for w in ways), min(cost(w, e) for w, e in ways if w == r.decode(span))), (span, cost_of)


def test_accented_letters_count_as_their_base(spark):
    rows = {x["gram"]: x["n"] for x in X.char_counts(spark.createDataFrame([("École",), (None,), ("ÉCOLE日",)], "text string")).collect()}
    code = lambda s: sum((ord(c) - 96) * 27**k for k, c in enumerate(reversed(s)))
    assert rows[code("eco")] == rows[code("col")] == rows[code("ole")] == 2


def test_feature_counts_do_not_depend_on_partitions(spark):
    rows = [("idiot common words", 1), ("common words here", 0), ("words alone", 0), ("common idiot", 0), ("stupid words", 1), ("nothing", 0)]
    chars = np.log(np.full((27, 27, 27), 1 / 27))
    n, pos = {b"": len(rows)}, {b"": 2}
    for text, y in rows:
        for g in {g for w in text.split() for g in X.word_grams(w.encode())}:
            n[g], pos[g] = n.get(g, 0) + 1, pos.get(g, 0) + y
    wanted = {g: (pos[g], n[g]) for g in n if pos[g]}
    for parts in (1, 3, 6):
        sample = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "text string, label int")
        assert {bytes(r["gram"]): (r["pos"], r["n"]) for r in X.gram_stats(sample, chars).collect()} == wanted


def test_toxicity_edges(spark, docs_of, toxicity):
    rows = [(1, None), (1, None), (2, ""), (3, "x" * 20_000), (None, "idiot"), (4, "4" * 3_000 + "a")]
    got = X.score_rows(docs_of(rows).drop("score"), toxicity).collect()
    assert len(got) == len(rows) and len({x["score"] for x in got if not x["text"]}) == 1 and all(0 <= x["score"] <= 1 for x in got)
    assert X.score_rows(docs_of(rows), toxicity).columns == [*docs_of(rows).drop("score").columns, "score"]
    assert X.score_rows(docs_of([]), toxicity).count() == 0
    none = X.fit(docs_of([]).select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert X.score_rows(docs_of(rows).drop("score"), none).count() == len(rows)


def test_forward_backward_equals_enumeration():
    g = np.random.default_rng(1)
    sizes = np.array([3, 1, 5, 2])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    unary, trans = g.standard_normal(sizes.sum()), g.standard_normal((2, 2))
    marginal, expected, _ = Q.chain(unary, trans, starts, sizes)
    total = np.zeros((2, 2))
    for s, n in zip(starts, sizes, strict=True):
        z, on, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(unary[s + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            z += p
            on += p * np.array(y)
            for i in range(n - 1):
                pair[y[i], y[i + 1]] += p
        assert np.allclose(marginal[s : s + n], on / z)
        total += pair / z
    assert np.allclose(expected, total)


def test_quality_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "x"), (5, "line\n" * 3_000), (None, "a b")]
    docs = docs_of(rows).drop("score")
    model = Q.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = Q.score_rows(docs, model).collect()
    assert len(got) == len(rows) and len({x["score"] for x in got if x["doc_id"] in (1, 2, 3)}) == 1
    none = Q.fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["score"] for x in Q.score_rows(docs, none).collect()} == {0.5}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a document of each kind that must go, and a clean one that must stay
    toxic = "The idiot and the moron are stupid, pathetic, worthless trash, you disgusting scum, clown and loser. " * 5
    extra = spark.createDataFrame([(900_001, toxic, "en", "s", len(toxic)), (900_002, None, None, None, None), (None, "no id here", "en", "s", 10)], docs.schema)
    now, before = docs.unionByName(extra), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        if name == "toxicity":
            assert now.where("doc_id = 900001").count() == 0
        if name == "near_duplicates":
            assert now.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0 and now.where("doc_id is null").count() == 1
        if name == "repeats":
            assert now.count() == before.count() and now.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]
    assert now.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "repeats", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_fitted_model_leaves_clean_words_alone(spark):
    """The character model of the tables: disguises of one doubling or of many separators are read, ordinals and junk stay, and of the clean documents' words
    at most one in fifty changes."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = X.Restorer(X.char_model(docs))
    for noisy, word in {"stuupid": "stupid", "i    d    i    o    t": "idiot", "i" + " " * 50 + "d i o t": "idiot", "idioot": "idiot", "idi0t": "idiot"}.items():
        assert r.restore(f"an {noisy}, here") == f"an {word}, here", noisy
    for clean in ("the 3rd of", "a 1st one", "b c d 5", "stteen", "thheed", "all", "1 2 3 x 4"):
        assert r.restore(clean) == clean, clean
    n = changed = 0
    for x in docs.join(labels.where("toxic = 0"), "doc_id").select("text").collect():
        own = X.text_words((x["text"] or "").lower())
        n, changed = n + len(own), changed + len(own - X.text_words(r.restore(x["text"] or "")))
    assert n > 10_000 and changed < n / 50


def test_pipeline_stages_take_empty_tables_and_any_columns(spark):
    """Every stage on no rows, and on rows with columns of the names that stages use inside; columns come back as they are."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, kept boolean, toxicity_score double, quality_score string, Gone_ int, block long, carried_0 string"
    text = "The history of the river and of the towns along it is told in the museum of the old harbour. "
    rows = [(i, text * (1 + i % 3) + str(i), "en", "s", 1, "g", True, 0.5, "q", 1, 2, "c") for i in range(6)] + [(7, text * 2, "en", "s", 1, None, None, None, None, None, None, None), (7, text * 2, "en", "s", 1, None, None, None, None, None, None, None)]
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, spark.createDataFrame([], schema), SF)
        assert none.collect() == [], name
        full = spark.createDataFrame(rows, schema)
        out = stage(spark, full, SF)
        if name != "packing":
            assert out.columns == full.columns and [f.dataType for f in out.schema] == [f.dataType for f in full.schema], name
            got = out.where("doc_id < 7").select("doc_id", "gone", "kept", "toxicity_score", "quality_score", "Gone_", "block", "carried_0").collect()
            assert got and all(tuple(x)[1:] == ("g", True, 0.5, "q", 1, 2, "c") for x in got), name
        else:
            assert {x["doc_id"] for x in out.collect()} == {0, 1, 2, 3, 4, 5, 7}
