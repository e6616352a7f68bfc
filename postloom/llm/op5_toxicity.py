"""Operator 5: toxicity of noisy-channel restored text.

1. A character trigram model is counted over all documents (pre-aggregated per task, then summed). Its letters are a-z, with
   the accented letters of Latin-1 counted as their base letter, and one sign for anything else.
2. Spans that the channel can have made - words with leet signs anywhere (ordinal numbers apart), with doubled or repeated
   letters, three or more single or repeated letters and signs set apart by separators of any kind and number -
   become character lattices: a sign may stand for each letter it resembles or for itself, closing marks for nothing, a run
   of one letter for one or two of it, a separator run for nothing or the end of a word. Spans that touch are one lattice.
   Viterbi search finds the likeliest reading under the trigram model and the channel's costs, which replaces the span; what is
   written has no cost, so a clean word stays unless the model finds another far likelier, and letters set apart stay if digits are left among them.
3. The restored text is scored by a logistic regression over whole words and word beginnings, which are counted by
   distinct word. It is fitted on a bounded labelled sample (learning.TRAIN_ROWS); its features are those whose
   frequency differs most between the labels.

Null and empty texts get the score of a text without features. Repeated rows get equal scores; only doc_id and text are
read, so columns of other names cannot clash. Without labels of both kinds every score is the labels' rate.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, alone, held_out_column, slices
from .learning import TRAIN_ROWS, fit_logistic, labelled_sample, with_score

#: What a sign may stand for (the channel's substitutions).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "+": "t", "!": "i", "|": "il",
}
SIGN_COST, KEEP_COST, DOUBLE_COST, SPLIT_COST = 1.0, 2.5, 0.7, 1.0
#: What it costs to take a letter of a pair away in a word without longer runs: most such words are written so.
PAIR_COST = 3.5
FEATURES, PREFIXES, BINS = 1_000, (4, 5, 6, 7), (1, 2, 4)

_LETTER = "[^\\W\\d_]"
_LEET_HIT = re.compile(r"[0-9@$+!|]+[a-z]|[a-z][0-9@$+!|]")
_LEET_SPAN = re.compile(r"[a-z0-9@$+!|]+")
_RUN = re.compile(rf"({_LETTER})\1(?:\1+|{_LETTER}*?({_LETTER})\2)")
_WORD_AROUND = re.compile(rf"{_LETTER}+")
_PAIR = re.compile(rf"({_LETTER})\1")
_ORDINAL = re.compile(r"[0-9]+(?:st|nd|rd|th)")
_UNIT, _APART = r"(?:[^\W_]|[@$+!|])", r"(?:[^\w@$+!|]|_)+"
_SPACED = re.compile(rf"(?<![^\W_])(?<![@$+!|])(?:({_UNIT})\1*{_APART}){{2,}}({_UNIT})\2*(?![^\W_])(?![@$])")
_CLOSING = "!+|"
_SAME = re.compile(rf"({_UNIT})\1*")

#: Latin-1 characters as letters 1 to 26 (accents taken off), anything else 0.
_CODE = np.array([ord(b) - 96 if "a" <= (b := unicodedata.normalize("NFD", chr(c).lower())[0]) <= "z" else 0 for c in range(256)], np.uint8)
_CODES = {chr(c): n for c, n in enumerate(_CODE.tolist()) if n}
#: Bytes that end a word, as one table for bytes.translate.
_TO_SPACE = bytes(32 if c < 128 and not (97 <= c <= 122) else c for c in range(256))


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): trigrams of letters and of 'anything else', over all texts."""

    def count(batches):
        alone()
        total = np.zeros(27**3, np.int64)
        for b in slices(batches):
            raw = np.frombuffer("\n".join(b.column(0).to_pylist()).encode("latin-1", "replace"), np.uint8)
            for at in range(0, len(raw), 1 << 22):
                c = _CODE[raw[at : at + (1 << 22) + 2]].astype(np.int32)
                if len(c) > 2:
                    total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["gram", "n"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [before, last, next] with counts shrunk towards the pair and the single letter. 19,683 numbers."""
    n = np.zeros(27**3)
    for row in char_counts(docs).collect():
        n[row["gram"]] = row["n"]
    n = n.reshape(27, 27, 27)
    one = n.sum((0, 1)) + 1.0
    one /= one.sum()
    two = n.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = n + 5 * two
    return np.log(three / three.sum(2, keepdims=True))


class Restorer:
    """Viterbi decoding of character lattices under a trigram model."""

    def __init__(self, model: np.ndarray):
        self.cost = (-model).tolist()
        self.of = Memo(self.reading, 100_000)

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """Arcs of each position: (what it reads as, the channel's cost)."""
        arcs, i, n, before = [], 0, len(span), ""
        marks = len(span.rstrip(_CLOSING))
        units = [len(m.group()) for m in _SAME.finditer(span)]
        repeated = len(units) >= 3 and min(units) >= 2  # every letter is written twice or more
        pair = DOUBLE_COST if repeated or max(units) > 2 else PAIR_COST
        while i < n:
            c, j = span[i], i + 1
            apart = not c.isalnum() and c not in LEET
            while j < n and (not span[j].isalnum() and span[j] not in LEET if apart else span[j] == c):
                j += 1
            if apart:
                arcs.append([("", 0.0), (" ", SPLIT_COST)])  # set letters apart, or parts two words
            elif i > 1 and c == before and j - i == 1 and not repeated:
                arcs.append([(c, 0.0), ("", DOUBLE_COST)])  # the letter or sign before the separators once more
                if c in LEET:
                    arcs[-1] += [(x, SIGN_COST) for x in LEET[c]]
            elif c in LEET:
                for k in range(i, j):
                    arcs.append([(x, SIGN_COST) for x in LEET[c]] + [(c, KEEP_COST)])
                    if k >= marks or (k > i and (repeated or j - i >= 3)):
                        arcs[-1].append(("", 0.0))  # a closing mark, or a sign once more
            elif j - i >= 3 or repeated:
                arcs.append([(c, 0.0), (c + c, DOUBLE_COST)])
            elif j - i == 2:
                arcs.append([(c + c, 0.0), (c, pair)])
            else:
                arcs.append([(c, 0.0)])
            if not apart:
                before = c
            i = j
        return arcs

    def decode(self, span: str) -> str:
        """The likeliest reading of a span between two boundaries."""
        cost, code = self.cost, _CODES
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for arcs in self.lattice(span):
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (p, q), (total, read) in best.items():
                for letters, extra in arcs:
                    a, b, t = p, q, total + extra
                    for ch in letters:
                        c = code.get(ch, 0)
                        t += cost[a][b][c]
                        a, b = b, c
                    if (a, b) not in nxt or t < nxt[a, b][0]:
                        nxt[a, b] = (t, read + letters)
            best = nxt
        return min((t + cost[p][q][0], read) for (p, q), (t, read) in best.items())[1]

    def reading(self, span: str) -> str:
        """The likeliest reading; letters set apart between which digits or signs are left are no disguise."""
        read = self.decode(span)
        return span if any(c in LEET for c in read) and any(not c.isalnum() and c not in LEET for c in span) else read

    def word(self, word: bytes) -> bytes:
        """The likeliest reading of a word of letters with one doubled; any other word is its own."""
        s = word.decode("utf-8", "replace")
        return self.decode(s).encode() if _PAIR.search(s) and not _RUN.search(s) else word

    def spans(self, lower: str, pairs: bool = True) -> list[tuple[int, int]]:
        """Where a lower-case text may be disguised: disjoint stretches, in order. Without pairs, words with one doubled letter are left to `word`."""
        found: list[tuple[int, int]] = []
        for hit, around in ((_LEET_HIT, _LEET_SPAN), (_RUN, _WORD_AROUND), *([(_PAIR, _WORD_AROUND)] if pairs else [])):
            until = -1
            for m in hit.finditer(lower):
                if m.start() < until or m.end() <= until:
                    continue
                start = m.start()
                while start and around.match(lower[start - 1]):
                    start -= 1
                until = around.match(lower, start).end()
                if not _ORDINAL.fullmatch(lower, start, until):
                    found.append((start, until))
        found += [m.span() for m in _SPACED.finditer(lower) if _WORD_AROUND.search(m.group())]
        found.sort()
        out: list[tuple[int, int]] = []
        for x, y in found:
            if out and x < out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]))
            else:
                out.append((x, y))
        return out

    def words(self, lower: str) -> list[str]:
        """The words of the readings whose words are not those that are written."""
        return [w for x, y in self.spans(lower) if (read := self.of[lower[x:y]].split()) != _WORD_AROUND.findall(lower[x:y]) for w in read]

    def restore(self, text: str, pairs: bool = True) -> str:
        """The lower-case text with the readings of its suspicious spans in their places."""
        lower, out, at = text.lower(), [], 0
        for x, y in self.spans(lower, pairs):
            out += [lower[at:x], self.of[lower[x:y]]]
            at = y
        return "".join([*out, lower[at:]])


def text_words(restored: str) -> set[bytes]:
    """Distinct words of a restored text, as UTF-8: runs of a-z and of non-ASCII letters."""
    return set(restored.encode("utf-8", "replace").translate(_TO_SPACE).split())


def word_grams(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, by characters."""
    s = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"^" + s[:n].encode() for n in PREFIXES if len(s) >= n)]


def _chosen(features: dict[bytes, int], r: Restorer):
    """The features of a written word: those of its reading, which is looked for once a word, not once a text."""
    return Memo(lambda w: tuple(features[g] for g in word_grams(r.word(w)) if g in features), 500_000)


def _counts(words: set[bytes], of) -> Counter:
    hits: Counter = Counter()
    for w in words:
        f = of[w]
        if f:
            hits.update(f)
    return hits


def gram_stats(sample: DataFrame, chars: np.ndarray) -> DataFrame:
    """(gram, pos, n): rows of the labelled sample that have a gram, over all tasks, of grams in toxic rows; the empty gram counts all rows."""

    def grams(batches):
        alone()
        r = Restorer(chars)
        read = Memo(r.word, 100_000)
        pos: Counter = Counter()
        all_: Counter = Counter()
        n = [0, 0]
        for b in slices(batches):
            for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                got = {g for w in text_words(r.restore(text, pairs=False)) for g in word_grams(read[w])}
                all_.update(got)
                n[0] += 1
                if y:
                    pos.update(got)
                    n[1] += 1
        keys = list(all_)  # a gram without toxic rows here may have some in another task
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *keys], pa.binary()), pa.array([n[1], *(pos[k] for k in keys)], pa.int64()), pa.array([n[0], *(all_[k] for k in keys)], pa.int64())],
            ["gram", "pos", "n"],
        )

    found = sample.select("text", "label").mapInArrow(grams, "gram binary, pos long, n long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return found.where((F.col("pos") > 0) | (F.col("gram") == b""))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """The model: character model, features and weights. Features are counted on the executors; the driver gets
    FEATURES rows of them and the sample's feature numbers."""
    chars = char_model(docs)
    sample = labelled_sample(docs, labels, label, rows)

    stats = gram_stats(sample, chars)
    top = {bytes(r["gram"]): (r["pos"], r["n"]) for r in stats.orderBy(F.col("gram") != b"", F.desc(F.col("pos") * F.col("pos") / (F.col("n") + 2)), "gram").limit(8 * FEATURES).collect()}
    pos_n, all_n = top.pop(b"", (0, 0))
    if not pos_n or pos_n == all_n:
        return {"chars": chars, "features": {}, "weights": np.zeros((0, len(BINS))), "bias": fit_logistic([np.zeros(0)] * all_n, 0, np.full(all_n, float(bool(pos_n))))[1]}
    rate = pos_n / all_n
    z = {g: (p - n * rate) / np.sqrt(n * rate * (1 - rate) + 1.0) for g, (p, n) in top.items()}
    best = sorted(z, key=lambda g: (-z[g], g))[:FEATURES]
    features = {g: i for i, g in enumerate(best)}

    def vectors(batches):
        r = Restorer(chars)
        of = _chosen(features, r)
        for b in slices(batches):
            hits = [_counts(text_words(r.restore(t, pairs=False)), of) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("label").cast(pa.int32()), pa.array([list(h) for h in hits], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.int32()))],
                ["label", "f", "k"],
            )

    got = sample.select("text", "label").mapInArrow(vectors, "label int, f array<int>, k array<int>").collect()
    rows = [np.array([f * len(BINS) + j for f, k in zip(row["f"], row["k"], strict=True) for j, least in enumerate(BINS) if k >= least], np.int64) for row in got]
    w, bias = fit_logistic(rows, len(features) * len(BINS), np.array([row["label"] for row in got], float), l2=2.0)
    return {"chars": chars, "features": features, "weights": w.reshape(-1, len(BINS)), "bias": bias}


def score_rows(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs with their score: narrow, the model travels with the tasks (some hundred kB)."""

    def make():
        r = Restorer(model["chars"])
        of = _chosen(model["features"], r)
        # weight of a feature seen k times, k up to the last bin
        table = [[sum(row[j] for j, least in enumerate(BINS) if k >= least) for k in range(BINS[-1] + 1)] for row in model["weights"].tolist()]

        def one(text: str) -> float:
            t = model["bias"]
            for f, k in sorted(_counts(text_words(r.restore(text, pairs=False)), of).items()):
                t += table[f][min(k, BINS[-1])]
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, t)))))

        return lambda texts: np.array([one(t) for t in texts])

    return with_score(docs, make, text_col, score_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
