"""Operator 6: token counts by heap-and-linked-list byte-pair merging.

A pre-token's count is its number of bytes minus the number of merges done: the lowest-ranked adjacent pair is popped
from a heap, its two list nodes become one, and the pairs with both new neighbours are pushed. No identifiers are
built. Counts of pre-token units are kept per worker in a bounded memo. One narrow stage, no shuffle.

Nulls and empty texts count 0 tokens. Repeated rows give repeated rows. Special strings in a text count one token
each, as the tokenizers library does by default. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, resident
from .pretokens import compiled, units

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
LIMIT = 1024
#: Bits of a heap entry that hold a position: a pre-token may have 2^40 bytes.
AT = 40


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1 bytes stand for themselves,
    the others follow from 256 in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class HeapMerger:
    """Counts the tokens of pre-tokens by the ranked merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [ids[letters[b]] for b in range(256)]
        #: (left id, right id) as one int -> rank, shifted to leave room for a position
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[ids[a] << 20 | ids[b]] = rank << AT
            self.made.append(ids[a + b])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = compiled(pattern)
        self.by_piece = Memo(lambda piece: self.merged(piece.encode("utf-8", "surrogatepass")))
        self.by_unit = Memo(self._unit)

    def merged(self, piece: bytes) -> int:
        """Symbols left of one pre-token: bytes minus merges."""
        n = len(piece)
        sym = [self.first[b] for b in piece]
        get, made, low = self.pairs.get, self.made, (1 << AT) - 1
        heap = [rank | i for i in range(n - 1) if (rank := get(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            entry = heappop(heap)
            i = entry & low
            j = after[i]
            if j >= n or sym[i] < 0 or get(sym[i] << 20 | sym[j]) != entry - i:
                continue  # a neighbour has merged since this pair was pushed
            new = sym[i] = made[entry >> AT]
            sym[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                rank = get(new << 20 | sym[k])
                if rank is not None:
                    heappush(heap, rank | i)
            h = before[i]
            if h >= 0:
                rank = get(sym[h] << 20 | new)
                if rank is not None:
                    heappush(heap, rank | h)
        return left

    def _unit(self, unit: str) -> int:
        return sum(map(self.by_piece.__getitem__, self.split.findall(unit)))

    def count(self, text: str) -> int:
        for special in self.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(self.count(p) for p in parts)
        return sum(map(self.by_unit.__getitem__, units(text)))


def merger(path: str, pattern: str) -> HeapMerger:
    return resident(f"merger {path} {pattern}", lambda: HeapMerger(path, pattern))


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row. path: a byte-level BPE .json that every executor can open."""

    def counts(batches):
        m = merger(path, pattern)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([m.count(t) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(counts, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
