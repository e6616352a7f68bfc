"""Operator 10: byte-level BPE encoding and decoding over overlapping chunks.

Every text is cut into chunks that overlap (CHUNK characters, a size that most texts exceed). Each chunk is pre-tokenised by
the pattern by itself, from its own start. Two neighbouring chunks are stitched where their pre-token boundaries resynchronise:
at the first position in the overlap at which both begin a pre-token. From there on both see the same characters, so the left
chunk's boundaries hold before it and the right chunk's after it. Where they do not meet inside the overlap (a run longer than
it), the text is pre-tokenised again from the left chunk's last sure boundary, in windows that double until the run ends. The
pieces are then encoded by rank merging; decoding concatenates the raw bytes of the ids.

Narrow: chunks are cut, stitched and encoded in the task that holds the text, with no shuffle: sending chunks to other tasks and
their ids back would shuffle about twice the input. Null and empty texts give no ids. Special tokens are ordinary text. Repeated
rows give repeated rows; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, resident
from .pretokens import compiled

CHUNK, OVERLAP = 1_024, 64


class RankCodec:
    """Encodes pre-tokens by a rank file (base64 token, rank per line) and decodes ids by concatenating token bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.split = compiled(pattern)
        self.by_piece = Memo(lambda piece: self.piece(piece.encode("utf-8", "surrogatepass")), 300_000)
        self.forms = Memo(self._forms, 300_000)

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent parts with the lowest-ranked union are merged until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._long_piece(piece)
        get = ranks.get
        joined = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while joined:
            low = min(joined)
            if low == 1 << 30:
                break
            i = joined.index(low)
            parts[i] += parts.pop(i + 1)
            joined.pop(i)
            if i < len(joined):
                joined[i] = get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                joined[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _long_piece(self, piece: bytes) -> list[int]:
        """The same merges with a heap, for runs where scanning for the minimum would be quadratic."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _forms(self, piece: str) -> tuple[int, str, bytes]:
        """(number of ids, "id id ... ", bytes decoded from those ids) of a pre-token."""
        ids = self.piece(piece.encode("utf-8", "surrogatepass"))
        return len(ids), "".join([f"{i} " for i in ids]), self.decode(ids)

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by one space, SHA-256 of the bytes decoded from them)."""
        forms = list(map(self.forms.__getitem__, stitched(text, self.split.findall)))
        n = sum([f[0] for f in forms])
        ids = "".join([f[1] for f in forms])[:-1]
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([f[2] for f in forms])).hexdigest()

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        get = self.by_piece.__getitem__
        return [i for p in stitched(text, self.split.findall, chunk, overlap) for i in get(p)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def stitched(text: str, split: Callable[[str], list[str]], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pre-tokens of the text from chunks that were pre-tokenised separately; equal to split(text)."""
    starts = range(0, max(1, len(text) - overlap), chunk - overlap)
    chunks = [split(text[s : s + chunk]) for s in starts]  # independent of each other
    done, at = chunks[0], min(chunk, len(text))
    for s, cut in zip(starts[1:], chunks[1:], strict=True):
        end = min(s + chunk, len(text))
        if end <= at:
            continue  # a run that began further left went on beyond it
        left: dict[int, int] = {}  # where the left side's pre-tokens begin, in the overlap
        pos, k = at, len(done)
        while pos > s:
            k -= 1
            pos -= len(done[k])
            left[pos] = k
        right = s
        for meet, piece in enumerate(cut):
            # the right chunk's first pre-token may have begun before it
            if meet and right in left:
                del done[left[right] :]
                done += cut[meet:]
                at = end
                break
            right += len(piece)
            if right >= at:
                break
        if at == end:
            continue
        # the left side's last pre-token may go on beyond its end: it is found whole
        last = at - len(done.pop())
        window = 2 * chunk
        while len(again := split(text[last : last + window])) < 2 and last + window < len(text):
            window *= 2
        done += again
        at = min(last + window, len(text))
    return done


def codec(path: str, pattern: str) -> RankCodec:
    return resident(f"codec {path} {pattern}", lambda: RankCodec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the inverse of encode()."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            raw = pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw], ["doc_id", "ids", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids in the same task, so that
    neither ids nor bytes travel."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            found = [c.digests(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
