"""Operator 12: fill-in-middle transformation over an indexable skip list of tokens.

A text's tokens (white space with the word behind it; trailing white space alone) are the bottom lane of a skip list. Every
lane above has one node for each FAN nodes below. A node's link carries three widths: units (tokens), code points and bytes.
A cut rank is reached by going along the top lane while the link's units fit into what is left of the rank, then down a lane,
to the bottom: the accumulated widths are the rank itself and the exact code point and byte of the cut. Lanes are arrays, so a
text of any length costs some bytes a token beside itself. One narrow stage, no shuffle.

The prefix ends after the smaller of two ranks, the middle after the larger. Whether and how a document is transformed follows
from its id and a seed. Rebuilding needs only the output and the form: a text that holds a mark stays plain, and no mark can
arise where a piece meets a mark, so the first of each mark is the one that was written.

Null texts are empty, empty texts are plain; a null id is an empty decimal. Rows are independent: repeated rows give repeated
rows, an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Nodes of a lane for each node of the lane above.
FAN = 16
#: The white space of tokens: space and 9 to 13.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


@dataclass(frozen=True)
class Plan:
    """Which documents are transformed, and how: percentages of hashes of the seed and the id."""

    seed: int = 42
    plain: int = 50
    spm: int = 80


def token_widths(raw: bytes) -> np.ndarray:
    """(code points, bytes) of every token of a UTF-8 text, in order."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros((0, 2), np.int64)
    blank = _BLANK[b]
    end = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    if blank[-1]:
        end = np.append(end, len(b))
    start = np.append(0, end[:-1])
    return np.stack([np.add.reduceat((b & 0xC0) != 0x80, start, dtype=np.int64), end - start], axis=1)


class SkipList:
    """An indexable skip list over nodes with widths. lanes[0] has a link for every node; a link of lanes[k] passes FAN links below."""

    def __init__(self, widths: np.ndarray, fan: int = FAN):
        self.fan = fan
        lane = np.concatenate([np.ones((len(widths), 1), np.int64), widths], axis=1)
        self.lanes = [lane]
        while len(lane) > fan:
            lane = np.add.reduceat(lane, np.arange(0, len(lane), fan), axis=0)
            self.lanes.append(lane)

    def __len__(self) -> int:
        return len(self.lanes[0])

    def seek(self, rank: int) -> tuple[int, ...]:
        """The widths before the node of that rank: code points, then bytes. The rank may be the number of nodes."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        at, left, passed = 0, rank, np.zeros(self.lanes[0].shape[1] - 1, np.int64)
        for lane in reversed(self.lanes):
            while at < len(lane) and lane[at, 0] <= left:
                left -= int(lane[at, 0])
                passed += lane[at, 1:]
                at += 1
            at *= self.fan
        return tuple(passed.tolist())


def transform(raw: bytes, doc_id: int | None, plan: Plan = Plan()) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, code points of the middle, output) of a UTF-8 text."""
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    tokens = SkipList(token_widths(raw))
    n = len(tokens)
    if not raw or h3 % 100 >= plan.plain or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (chars, at), (to_chars, to) = tokens.seek(low), tokens.seek(high)
    prefix, middle, suffix = raw[:at], raw[at:to], raw[to:]
    if h4 % 100 < plan.spm:
        return n, "spm", chars, to_chars - chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", chars, to_chars - chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    body, _, middle = rest.partition(MIDDLE)
    return head + middle + body if form == "psm" else body + middle + head


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def _mapped(df: DataFrame, one, schema: str, types: list[tuple[str, pa.DataType]]) -> DataFrame:
    def run(batches):
        alone()
        for b in slices(batches):
            out = [one(i, raw) for i, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(types)], [n for n, _ in types])

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; the chars are null where the form is plain."""

    def one(doc_id, raw):
        n, form, prefix, middle, output = transform(raw, doc_id, plan)
        return doc_id, n, form, prefix, middle, output.decode("utf-8", "replace")

    types = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    return _mapped(_rows(docs, id_col, text_col), one, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", types)


def restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """(doc_id, form, text) rebuilt from the outputs."""

    def run(batches):
        for b in slices(batches):
            texts = [restore((o or "").encode(), f).decode("utf-8", "replace") for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("form"), pa.array(texts, pa.string())], ["doc_id", "form", "text"])

    return outputs.select("doc_id", F.col(form_col).alias("form"), F.col(output_col).alias("output")).mapInArrow(run, "doc_id long, form string, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """fill_in_middle with the output's digest and the digest of what is rebuilt from it, instead of the texts themselves."""

    def one(doc_id, raw):
        n, form, prefix, middle, output = transform(raw, doc_id, plan)
        return doc_id, n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()

    types = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    return _mapped(_rows(docs, id_col, text_col), one, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", types)


def op12_fim_skiplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
