"""Operator 8: document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potentials use its own features and those of the lines before and after it:
shares of letters, capitals, digits, marks and pipes, word length, how many of its words are distinct, whether the line
repeats an earlier one, length and final mark. Forward-backward gives each line's marginal of being good; the document's
quality is their mean weighted by line length, passed through a logistic curve that is fitted on the training documents.

Training is weak: every line of a labelled document has the document's label; likelihood is maximised by gradient ascent on
a bounded sample (learning.TRAIN_ROWS). Scoring is one narrow stage; the model is some hundred numbers. Null, empty and
blank texts have no line and get the labels' rate. Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out_column
from .learning import TRAIN_ROWS, fit_logistic, labelled_sample, with_score

_CLASS = np.zeros(256, np.uint8)  # 0 other, then as in _NAMES
for _c in range(256):
    ch = chr(_c)
    _CLASS[_c] = (
        1 if "a" <= ch <= "z" or _c >= 128 else 2 if "A" <= ch <= "Z" else 3 if ch.isdigit() and _c < 128 else 4 if _c in (32, 9) else
        5 if ch in "#$%&*@^~<>{}[]=+\\/_" else 6 if ch == "|" else 7 if ch == "!" else 8 if ch in ".,;:?'\"()-" else 0
    )
OWN = 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features (lines, OWN), lengths in bytes) of a text's lines that are not blank."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, OWN)), np.zeros(0)
    raw = [x.encode("utf-8", "replace") for x in lines]
    size = np.array([len(x) for x in raw], np.int64)
    codes = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    row = np.repeat(np.arange(len(raw)) * 9, size)
    count = np.bincount(row + codes, minlength=9 * len(raw)).reshape(-1, 9)
    letters = count[:, 1] + count[:, 2]
    words, distinct, again, seen = np.empty(len(raw)), np.empty(len(raw)), np.zeros(len(raw)), set()
    for i, x in enumerate(raw):
        w = x.split()
        words[i] = max(1, len(w))
        distinct[i] = max(1, len(set(w)))
        if len(w) > 1 and x in seen:
            again[i] = 1
        seen.add(x)
    f = np.empty((len(raw), OWN))
    f[:, 0] = letters / size
    f[:, 1] = count[:, 2] / np.maximum(1, letters)
    f[:, 2] = count[:, 3] / size
    f[:, 3] = np.minimum(1, count[:, 5] / words)
    f[:, 4] = np.minimum(1, count[:, 6] / words)
    f[:, 5] = np.minimum(1, count[:, 7] / words)
    f[:, 6] = np.minimum(1, count[:, 8] / words)
    f[:, 7] = np.minimum(2, letters / words / 10)
    f[:, 8] = (1 + np.log(distinct)) / (1 + np.log(words))
    f[:, 9] = (distinct / words < 0.35) & (words > 8)
    f[:, 10] = again
    f[:, 11] = np.minimum(1, np.log1p(size) / 10)
    f[:, 12] = words <= 3
    f[:, 13] = [x.rstrip()[-1:] in (b".", b"?", b"!") for x in raw]
    return f, size.astype(float)


def with_neighbours(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, the previous line's, the next line's, edge marks and 1; starts: the first line of each document."""
    n = len(f)
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.append(first[1:], True)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first], after[last] = 0, 0
    return np.hstack([f, before, after, first[:, None], last[:, None], np.ones((n, 1))])


def chain(unary: np.ndarray, trans: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (marginal of state 1 per line, expected transitions, log-partitions).

    unary: potential of state 1 (state 0 has 0). starts, sizes: each chain's lines. Chains advance together, position by
    position, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n, longest = len(unary), int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    pot = np.stack([np.zeros(n), unary], 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[starts] = pot[starts]
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        prev = alpha[at - 1]
        alpha[at] = pot[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        nxt = pot[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    ends = starts + sizes - 1
    z_of = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.empty(n)
    z[:] = np.repeat(z_of[np.argsort(order)], sizes[np.argsort(order)]) if n else 0
    marginal = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - z))
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            expected[i, j] = np.exp(np.minimum(0, alpha[at - 1, i] + trans[i, j] + pot[at, j] + beta[at, j] - z[at])).sum()
    return marginal, expected, z_of


def fit_chain(x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int = 150, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions that maximise the penalised likelihood of the line labels y; every document counts
    alike, whatever its number of lines."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.concatenate([w, trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.repeat(1 / sizes, sizes)
    inner = np.ones(len(y), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[at - 1].astype(int), y[at].astype(int)), 1)
    for t in range(1, steps + 1):
        marginal, expected, _ = chain(x @ w, trans, starts, sizes)
        g = np.concatenate([x.T @ (weight * (y - marginal)) / len(starts), ((observed - expected) / max(1, len(at))).ravel()]) - l2 / len(starts) / 10 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, trans = theta[: x.shape[1]], np.clip(theta[x.shape[1] :].reshape(2, 2), -3, 3)
    return w, trans


def document_means(texts: list[str], w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each text; NaN where it has no line."""
    parts = [line_features(t) for t in texts]
    sizes = np.array([len(f) for f, _ in parts], np.int64)
    out = np.full(len(texts), np.nan)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    f, length = np.concatenate([parts[i][0] for i in has]), np.concatenate([parts[i][1] for i in has])
    starts = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
    marginal, _, _ = chain(with_neighbours(f, starts) @ w, trans, starts, sizes[has])
    out[has] = np.add.reduceat(marginal * length, starts) / np.add.reduceat(length, starts)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """The model, fitted on a bounded labelled sample whose line features (not texts) reach the driver."""

    def features(batches):
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                f, size = line_features(text)
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([f.astype(np.float32).tobytes()], pa.binary()), pa.array([size.astype(np.float32).tobytes()], pa.binary())], ["label", "f", "size"])

    got = labelled_sample(docs, labels, label, rows).select("label", "text").mapInArrow(features, "label int, f binary, size binary").collect()
    rate = float(np.mean([r["label"] for r in got])) if got else 0.5
    got = [r for r in got if len(r["f"])]
    if not got or len({r["label"] for r in got}) < 2:
        return {"w": None, "trans": np.zeros((2, 2)), "curve": (0.0, 0.0), "rate": rate}
    fs = [np.frombuffer(r["f"], np.float32).reshape(-1, OWN).astype(float) for r in got]
    sizes = np.array([len(f) for f in fs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    y_doc = np.array([r["label"] for r in got], float)
    x = with_neighbours(np.concatenate(fs), starts)
    w, trans = fit_chain(x, np.repeat(y_doc, sizes), starts, sizes)
    marginal, _, _ = chain(x @ w, trans, starts, sizes)
    length = np.concatenate([np.frombuffer(r["size"], np.float32) for r in got]).astype(float)
    mean = np.add.reduceat(marginal * length, starts) / np.add.reduceat(length, starts)
    slope, offset = fit_logistic([np.zeros(1, np.int64)] * len(mean), 1, y_doc, l2=0.1, steps=600, close=0.0, values=mean * 8 - 4)
    return {"w": w, "trans": trans, "curve": (float(max(0.2, slope[0])), float(offset)), "rate": rate}


def score_rows(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs with their score."""

    def scores(texts: list[str]) -> np.ndarray:
        if model["w"] is None or not texts:
            return np.full(len(texts), model["rate"])
        mean = np.concatenate([document_means(texts[i : i + 500], model["w"], model["trans"]) for i in range(0, len(texts), 500)])
        slope, offset = model["curve"]
        return np.where(np.isnan(mean), model["rate"], 1 / (1 + np.exp(-(slope * (np.nan_to_num(mean) * 8 - 4) + offset))))

    return with_score(docs, lambda: scores, text_col, score_col)


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
