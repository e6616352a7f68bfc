"""Labelled samples and a small logistic regression for the classifiers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, slices

#: Labelled rows that a classifier is fitted on, at most (in expectation: rows are chosen by a hash of their id).
TRAIN_ROWS = 8_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of labelled rows whose crc32(doc_id as text) mod 5 is not 0; the others are held out.

    Of more than ``rows`` such rows, those whose id hashes below a threshold are taken, so that about ``rows`` remain: a
    documented bound, which also bounds what is broadcast here. Null ids, labels or texts are left out.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = own.count()
    if n > rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * rows / n))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id")


def fit_logistic(rows: list[np.ndarray], d: int, y: np.ndarray, l2: float = 1.0, steps: int = 300, close: float = 1e-4, values: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by accelerated gradient descent. rows holds the numbers (below d) of each row's
    features, so a step costs as much as there are features, not rows x d; their values (all rows' in turn) are 1 if not given.
    Ends after steps, or when the mean loss falls by less than a share ``close`` in ten of them; l2 is per row set, not per row."""
    n = len(rows)
    if not n or y.min() == y.max():
        rate = float(y.mean()) if n else 0.5
        return np.zeros(d), float(np.log((rate * n + 0.5) / ((1 - rate) * n + 0.5)))
    sizes = np.array([len(r) for r in rows], np.int64)
    f, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), sizes)
    x = np.ones(len(f)) if values is None else values
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb, before = np.zeros(d), np.zeros(d), 0.0, 0.0, np.inf
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(row, w[f] * x, n) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        g, gb = np.bincount(f, (p - y)[row] * x, d) / n + l2 / n * w, float((p - y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 + t / 200)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        if t % 10 == 0:
            loss = float(np.mean(np.logaddexp(0, z) - y * z)) + l2 / (2 * n) * float(w @ w)
            if before - loss < close * before:
                break
            before = loss
    return w, b


def with_score(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str, score_col: str) -> DataFrame:
    """All rows and columns of docs and a score of their text; make() builds the scorer once per task. A column of docs that is
    named as the score is replaced by it."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == score_col.lower()))

    def run(batches):
        alone()
        score = make()
        for b in slices(batches):
            texts = ["" if t is None else t for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(texts), pa.float64())], [*b.schema.names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")
