"""Operator 2: best-two-fit packing of tokenised documents into sequences.

Documents become ids of a tokenizer (called on distinct words, whose ids are kept in a bounded memo: the vocabulary's
pre-tokens never span white space), then id 0. Documents longer than a sequence are cut into pieces of its size.

Pieces are dealt by a hash to shards of about SHARD pieces; a shard is packed by itself, so waste is at most a bin or two a
shard. Within a shard a bin starts with the longest piece left and is filled greedily with the longest that fits. Then the
bin's smallest piece is taken out if two unpacked pieces fit the gap that it leaves more tightly, the pair that fills most of
it. Lengths are packed as counts (a length is at most the sequence size), then handed to the pieces.

Null and empty texts are one id 0. Rows with equal ids are packed as separate rows. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, resident

SIZE, SHARD, END = 2_048, 20_000, 0
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?]+)")
_MARKS = frozenset(b".,;:!?")
_END_BYTES = np.array([END], "<u4").tobytes()


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by distinct words."""

    def __init__(self, path: str, bound: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.bound, self.older = bound, {}
        self.of: dict[bytes, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words. A word of letters alone is one pre-token, whose last id is the only one that closes one: many such
        words are encoded as one text, which takes half the time."""
        out: dict[bytes, bytes] = {}
        letters, other = [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            (letters if text.isalpha() and text.lower().isalpha() else other).append((w, text))
        for k in range(0, len(letters), 1_000):
            part = letters[k : k + 1_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), end in zip(part, ends, strict=True):
                out[w] = raw[at:end]
                at = end
        out.update(zip([w for w, _ in other], self._each([t for _, t in other]), strict=True))
        return out

    def learn(self, wanted: set[bytes]) -> None:
        """Adds the ids of words; a word that is letters and then marks is the letters' ids and the marks', if lowering leaves
        letters alone (an I with a dot becomes a letter and a sign, which joins the marks)."""
        if len(self.of) >= self.bound:
            self.older, self.of = self.of, {}
        known, older = self.of, self.older
        split: dict[bytes, tuple[bytes, bytes]] = {}
        for w in wanted:
            if w[-1] not in _MARKS:
                continue
            m = _PLAIN.fullmatch(w.decode("utf-8", "replace"))
            if m and m[1].lower().isalpha():
                split[w] = (m[1].encode(), m[2].encode())
        plain = {p for w in wanted for p in split.get(w, (w,))}
        new = []
        for p in plain:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        known.update(self._encode(new))
        for w, (a, b) in split.items():
            known[w] = known[a] + known[b]

    def texts(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            raw = t.encode("utf-8", "replace")
            # the tokenizer lowers letters itself; a special token's string is left as it is, and so is a text with a dot above (U+0307),
            # which composes with a capital I but not with a small one
            cut.append((raw if b"<|" in raw or b"\xcc\x87" in raw else raw.lower()).split())
        wanted = set().union(*cut).difference(self.of)
        if wanted:
            self.learn(wanted)
            lost = set().union(*cut).difference(self.of)  # the memo began a new generation
            for w in lost:
                if w in self.older:
                    self.of[w] = self.older[w]
        get = self.of.__getitem__
        return [b"".join(map(get, words)) + _END_BYTES for words in cut]


def word_ids(path: str) -> WordIds:
    return resident(f"word_ids {path}", lambda: WordIds(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of every document."""

    def run(batches):
        w = word_ids(path)
        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 500):
                rows = []
                for doc, ids in zip(ids_of[at : at + 500], w.texts(texts[at : at + 500]), strict=True):
                    for k, x in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[x : x + 4 * size]
                        rows.append((doc, k, x // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths are 1 to size."""
    count = np.bincount(lengths, minlength=size + 1).tolist()
    mask = 0  # bit n: a piece of length n is left
    for n, c in enumerate(count):
        if c:
            mask |= 1 << n
    bins: list[list[int]] = []

    def take(n: int) -> None:
        nonlocal mask
        count[n] -= 1
        if not count[n]:
            mask &= ~(1 << n)

    def give(n: int) -> None:
        nonlocal mask
        count[n] += 1
        mask |= 1 << n

    below = [(1 << (g + 1)) - 1 for g in range(size + 1)]
    while mask:
        n = mask.bit_length() - 1
        take(n)
        held, gap = [n], size - n
        while gap and (fit := (mask & below[gap]).bit_length() - 1) > 0:
            take(fit)
            held.append(fit)
            gap -= fit
        if gap and len(held) > 1:
            small = min(held)
            room = gap + small
            best, pair = small, None
            first = mask & below[room - 1]
            while first:
                a = first.bit_length() - 1
                if 2 * a <= best:  # the second is no longer than the first
                    break
                second = mask & below[min(a, room - a)]
                if second >> a & 1 and count[a] < 2:
                    second &= ~(1 << a)
                b = second.bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                first &= ~(1 << a)
            if pair:
                held.remove(small)
                give(small)
                for x in pair:
                    take(x)
                    held.append(x)
        bins.append(held)
    of: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable").tolist():
        of[int(lengths[i])].append(i)
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, held in enumerate(bins):
        at = 0
        for n in held:
            i = of[n].pop()
            where[i], offset[i] = k, at
            at += n
    return where, offset


def pack(spark: SparkSession, cut: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    held = Scratch(spark).save(cut, "pieces")
    shards = max(1, -(-held.count() // shard))
    names = held.columns

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        where, offset = best_two_fit(g["length"].to_numpy(), size)
        g["sequence_id"] = (g["shard"].to_numpy().astype(np.int64) << 32) | where
        g["offset"] = offset
        return g[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + ", sequence_id long, offset long"
    return held.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
