"""Operator 7: exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. The work is dealt out so
that no task needs the corpus:

1. Blocks. Documents are written once, in blocks of about BLOCK_BYTES of text, to a table in the shared folder; everything
   that follows asks and answers by block. Buckets lie side by side in parts, some for each shuffle partition. What goes to buckets is packed by
   part: one row for a part and a block, or some GATHER bytes of a task, whatever number of buckets that is; what comes back is one row for a block
   and a task. So an exchange has at most as many rows as blocks times partitions, and for given partitions rows grow with the input.
2. Anchors. In every window of LENGTH bytes the GRAM-byte string with the smallest hash is its anchor; equal windows have
   equal anchors. A block asks each anchor's bucket whether another block holds it too; an anchor of one document rules out
   all windows that it stands for. The answer also says which anchors are *hot* (HOT documents or more).
3. Pieces. Neighbouring windows with the same shared anchor form a piece of text, which goes to the anchor's bucket - once per
   block and content: of equal pieces only those of the smallest document need judging, the others are covered. Windows of a
   hot anchor go by a hash of their own LENGTH bytes instead, each to the bucket of its content, so that one phrase that a
   third of all documents hold does not gather them in one bucket.
4. Index family. A bucket takes its distinct pieces by rising document id, in batches. Windows whose hash no other window of the bucket
   has are left out (they start nowhere else; all others are compared byte by byte). A batch gets its suffix array (positions
   into its pieces), is merge-scanned against every level of the family for matches of LENGTH bytes, and its new suffixes become
   a level; levels that hold equally many batches are merged, so there are logarithmically many. A suffix found in a level,
   or in the batch under a smaller id, covers its window.
5. The covered runs go back to their blocks, whose documents' remaining bytes are concatenated.

All matches are decided on bytes. Texts are read as UTF-8; null is empty; texts shorter than LENGTH lose nothing. A null doc_id
loses nothing and covers nothing. Rows of one id do not cover each other, whether their texts are equal or not; each row is
judged by its own text. Other columns are not read, but those that carry names are returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, alone
from .grouped import consecutive

LENGTH, GRAM, BATCH = 50, 20, 2_048
#: Bytes of text in a block, and on average in a bucket's share of the corpus.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Bytes that a task gathers before it sends them on. (32 MB took an executor of the pipeline over 3,000 MB: the JVM keeps what Arrow's batches once needed.)
GATHER = 4 << 20
#: Documents of an anchor from which on its windows are dealt by their own content.
HOT = 20_000
_TABLE = np.random.default_rng(50).integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: The name of an anchor is its bucket, 36 bits of its hash, and four low bits that are free: a question holds the number of
#: documents there, an answer what is known. Questions and answers between blocks and a bucket are the five low bytes. (Two
#: anchors of one name, some 1e-5 of a bucket's 300,000, only send pieces that are then found to differ.)
_LOW, _BYTES = np.uint64(15), 5
_SHARED, _HOT = np.uint64(1), np.uint64(2)


def window_anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor hash of each window of a byte array (empty if it is shorter than one window)."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, size = _TABLE[raw], 1
        whole, done = None, 0
        # hashes of 1, 2, 4, ... bytes; those in gram's binary form are joined
        for bit, p in enumerate(_P):
            if gram >> bit & 1:
                if whole is None:
                    whole, done = h, size
                else:
                    whole = h[: len(whole) - size] * _P[-1] + whole[size:]
                    done += size
            if done == gram:
                break
            h = h[: len(h) - size] * p + h[size:]
            size *= 2
        whole = whole ^ (whole >> np.uint64(29))
        whole *= _P[1]
        whole ^= whole >> np.uint64(32)
    span, low, have = length - gram + 1, whole, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return low


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values, and their ends."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return starts, np.append(starts[1:], len(values))


def anchor_names(hashes: np.ndarray, buckets: int) -> np.ndarray:
    h, n = hashes >> np.uint64(4), np.uint64(buckets)
    return (h % n) << np.uint64(40) | ((h // n) & np.uint64((1 << 36) - 1)) << np.uint64(4)


def anchor_runs(raw: np.ndarray, buckets: int, length: int = LENGTH, gram: int = GRAM, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, names) of the runs of windows with one anchor; step windows at a time, so that a long text needs no
    arrays of its own size."""
    starts, hashes, last = [], [], None
    for at in range(0, max(0, len(raw) - length + 1), step):
        a = window_anchors(raw[at : at + step + length - 1], length, gram)
        s = runs_of(a)[0]
        if last is not None and last == a[0]:
            s = s[1:]
        last = a[-1]
        starts.append(s + at)
        hashes.append(a[s])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.concatenate(starts)
    return s, np.append(s[1:], len(raw) - length + 1), anchor_names(np.concatenate(hashes), buckets)


def _sent(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def _received(packed: bytes, bucket: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, _BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_BYTES] = raw
    return out.view("<u8").ravel() | np.uint64(bucket) << np.uint64(40)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of known, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _blocks(block_bytes: int):
    """(block, n_bytes, packed): rows as Arrow streams of some MB."""

    def run(batches):
        alone()
        block = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        held, size = [], 0

        def packed():
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=options) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_bytes", "packed"])

        for b in batches:
            if not b.num_rows:
                continue
            ends = size + np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at = 0
            while at < b.num_rows:
                k = max(at, int(np.searchsorted(ends, block_bytes)))
                held.append(b.slice(at, k + 1 - at))
                size = int(ends[min(k, b.num_rows - 1)])
                at = k + 1
                if k < b.num_rows:
                    yield packed()
                    held, block = [], block + 1
                    ends -= size
                    size = 0
        if held:
            yield packed()

    return run


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _rows(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """(doc_id, UTF-8 bytes) of each row."""
    raw = table.column("text").cast(pa.binary()).to_pylist()
    return [(i, t or b"") for i, t in zip(table.column("doc_id").to_pylist(), raw, strict=True)]


def _block_anchors(rows: list[tuple[int | None, bytes]], buckets: int, length: int, gram: int):
    """Per row its anchor runs, and the block's distinct anchors (buckets in order) with their number of rows."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    runs = [anchor_runs(np.frombuffer(t, np.uint8), buckets, length, gram) if d is not None else none for d, t in rows]
    own = [np.unique(r[2]) for r in runs]
    return runs, *np.unique(np.concatenate(own) if own else none[2], return_counts=True)


def _binaries(parts) -> pa.Array:
    return pa.array(list(parts), pa.binary())


def _asked(buckets: int, each: int, length: int, gram: int, gather: int):
    """(part, blocks, counts, codes): anchors of a part's buckets that some blocks of the task have. counts: for each of the blocks, and each of the
    part's buckets, how many codes are its own; the low bits of a code hold the bit length of the number of rows."""

    def run(batches):
        alone()
        held: dict[int, list[tuple[int, np.ndarray, bytes]]] = defaultdict(list)
        size = 0

        def table():
            rows = [(p, [np.array([x[0] for x in held[p]], np.int64).tobytes()], [x[1] for x in held[p]], [x[2] for x in held[p]]) for p in sorted(held)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(_binaries(b"".join(r[k]) for r in rows) for k in (1, 2, 3))], ["part", "blocks", "counts", "codes"])

        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("packed"), strict=True):
                _, names, n = _block_anchors(_rows(_unpacked(packed.as_py())), buckets, length, gram)
                if not len(names):
                    continue
                where = (names >> np.uint64(40)).astype(np.int64)
                names |= np.minimum(15, np.floor(np.log2(n)) + 1).astype(np.uint64)
                s, e = runs_of(where // each)
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    part = int(where[x]) // each
                    held[part].append((block, np.bincount(where[x:y] - part * each, minlength=each).astype(np.int32).tobytes(), _sent(names[x:y])))
                size += _BYTES * len(names)
                if size >= gather:
                    yield table()
                    held.clear()
                    size = 0
        if held:
            yield table()

    return run


class _Back:
    """What goes back to blocks, until it is some MB: one row for each block."""

    def __init__(self, gather: int):
        self.gather, self.size, self.by = gather, 0, defaultdict(list)

    def add(self, block: int, head: bytes, body: bytes) -> None:
        self.by[block].append((head, body))
        self.size += len(head) + len(body)

    def rows(self, names: tuple[str, str], least: bool = True) -> Iterator[pa.RecordBatch]:
        if self.by and (not least or self.size >= self.gather):
            blocks = sorted(self.by)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(_binaries(b"".join(x[k] for x in self.by[b]) for b in blocks) for k in (0, 1))], ["block", *names])
            self.by.clear()
            self.size = 0


def _shared(each: int, hot: int, gather: int):
    """(block, buckets, codes): what a block did not know of the anchors that it asked about; buckets has (bucket, number of codes) in order."""

    def run(batches):
        alone()
        back = _Back(gather)
        for (part,), rows in consecutive(batches, ["part"]):
            asks = []
            for blocks, counts, codes in zip(*(rows.column(c).to_pylist() for c in ("blocks", "counts", "codes")), strict=True):
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32))]) * _BYTES
                asks += [(block, codes, ends[k * each : (k + 1) * each + 1].tolist()) for k, block in enumerate(np.frombuffer(blocks, np.int64).tolist())]
            for j in range(each):
                bucket = part * each + j
                mine = [(block, _received(codes[at[j] : at[j + 1]], bucket)) for block, codes, at in asks if at[j + 1] > at[j]]
                if not mine:
                    continue
                who = np.repeat(np.arange(len(mine)), [len(c) for _, c in mine])
                c = np.concatenate([c for _, c in mine])
                h, n = c & ~_LOW, (c & _LOW).astype(np.int64)
                order = np.argsort(h, kind="stable")
                s, e = runs_of(h[order])
                docs = np.add.reduceat(np.int64(1) << (n[order] - 1), s)
                known = np.repeat(np.where(docs >= hot, _HOT, np.where(e - s > 1, _SHARED, np.uint64(0))), e - s)
                tell = (known == _HOT) | ((known == _SHARED) & (n[order] == 1))
                told, by = (h[order] | known)[tell], who[order][tell]
                order = np.argsort(by, kind="stable")
                told, by = told[order], by[order]
                for x, y in zip(*(v.tolist() for v in runs_of(by)), strict=True):
                    back.add(mine[by[x]][0], np.array([bucket, y - x], np.int32).tobytes(), _sent(told[x:y]))
                yield from back.rows(("buckets", "codes"))
        yield from back.rows(("buckets", "codes"), least=False)

    return run


def _told(buckets: bytes, codes: bytes) -> Iterator[np.ndarray]:
    at = 0
    for bucket, n in np.frombuffer(buckets, np.int32).reshape(-1, 2).tolist():
        yield _received(codes[at : at + _BYTES * n], bucket)
        at += _BYTES * n


_ITEM = pa.struct([("bucket", pa.int32()), ("block", pa.int64()), ("head", pa.binary()), ("text", pa.binary())])


def _pieces(buckets: int, each: int, length: int, gram: int):
    """(part, items) of a block's pieces to judge; items has (bucket, block, head, text) of the part's buckets; in bucket -1 - x, runs that are covered already, which pass
    through bucket x. head has columns doc, row, start, size of each place; a negative size is the piece before once more. They are packed here, not in a map of their own,
    because that would be a second Python worker for every task."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        alone()
        zip_ = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        block = left.column("block")[0].as_py()
        rows = _rows(_unpacked(left.column("packed")[0].as_py()))
        runs, names, n = _block_anchors(rows, buckets, length, gram)
        told = np.concatenate([np.zeros(0, np.uint64), *(x for row in zip(right.column("buckets").to_pylist(), right.column("codes").to_pylist(), strict=True) for x in _told(*row))])
        shared = np.union1d(told & ~_LOW, names[n > 1])
        hot = np.sort(told[told & _LOW == _HOT] & ~_LOW)
        by: dict[int, dict[bytes, list]] = defaultdict(dict)
        done: list[tuple[int, int, int]] = []

        def place(bucket: int, piece: bytes, doc: int, row: int, start: int) -> None:
            seen = by[bucket].setdefault(piece, [doc])
            if seen[0] == doc:
                seen.append((row, start))
            else:
                done.append((row, start, start + len(piece)))

        for row in sorted((k for k, r in enumerate(rows) if r[0] is not None), key=lambda k: rows[k][0]):
            doc, text = rows[row]
            s, e, a = runs[row]
            own = _among(a, shared)
            if not own.any():
                continue
            s, e, a = s[own], e[own], a[own]
            special = _among(a, hot)
            where = (a >> np.uint64(40)).tolist()
            for x, y, bucket, single in zip(s.tolist(), e.tolist(), where, special.tolist(), strict=True):
                if single:
                    windows = window_anchors(np.frombuffer(text[x : y + length - 1], np.uint8), length, length)
                    for k, w in enumerate(((windows >> np.uint64(4)) % np.uint64(buckets)).tolist(), x):
                        place(w, text[k : k + length], doc, row, k)
                else:
                    place(bucket, text[x : y + length - 1], doc, row, x)
        out: dict[int, list[dict]] = defaultdict(list)
        item = lambda bucket, head, text: {"bucket": bucket, "block": block, "head": head, "text": text}
        if done:
            out[block % buckets // each].append(item(-1 - block % buckets, np.array(done, np.int32).tobytes(), b""))
        for bucket, pieces in by.items():
            head = [(doc, row, start, -len(piece) if k else len(piece)) for piece, (doc, *places) in pieces.items() for k, (row, start) in enumerate(places)]
            out[bucket // each].append(item(bucket, zip_(np.array(head, np.int64).T.tobytes()), zip_(b"".join(pieces))))
        return pa.table([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.list_(_ITEM))], names=["part", "items"])

    return one


class _Level:
    """A sorted suffix array: positions into the pieces' text, suffixes compared by their first length bytes."""

    def __init__(self, text: np.ndarray, at: np.ndarray, least: np.ndarray, length: int, batches: int = 1):
        self.text, self.at, self.least, self.length, self.batches = text, at, least, length, batches

    def heads(self, x: int = 0, y: int | None = None) -> np.ndarray:
        """The suffixes x to y, cut at length bytes. Bytes are raised by one: UTF-8 has no 0xFF, and NumPy's byte strings must
        not end in zeros."""
        cut = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[self.at[x:y]] + np.uint8(1)
        return np.ascontiguousarray(cut).view(f"S{self.length}").ravel()


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order that merges two sorted runs (NumPy's stable sort of strings finds runs and merges them)."""
    return np.argsort(np.concatenate([a, b]), kind="stable")


def _suffixes(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, begin in the joined pieces) of every suffix of at least length bytes."""
    size = np.array([len(p) for p in pieces], np.int64)
    counts = size - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    return piece, np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]) - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(piece))


def repeated_windows(pieces: list[bytes], length: int, batch: int) -> np.ndarray:
    """Whether the hash of each window (in the pieces' order) is that of another one. Equal windows have equal hashes, so all others start
    nowhere else and need no place in an index: most of a bucket's, whose pieces share an anchor but not LENGTH bytes."""
    parts = [pieces[k : k + batch] for k in range(0, len(pieces), batch)]
    h = np.concatenate([np.zeros(0, np.uint64), *(window_anchors(np.frombuffer(b"".join(p), np.uint8), length, length)[_suffixes(p, length)[1]] for p in parts)])
    order = np.argsort(h)
    h = h[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    out = np.zeros(len(h), bool)
    out[order[same]] = out[order[same + 1]] = True
    return out


class IndexFamily:
    """Suffix arrays whose sizes are powers of two batches, each with the smallest document of every suffix."""

    def __init__(self, length: int, scan: int = 1 << 16):
        self.length, self.scan = length, scan
        self.levels: list[_Level] = []

    def add(self, pieces: list[bytes], docs: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Whether each suffix of at least length bytes (in the pieces' order) also starts in a smaller document seen before or
        in this batch. Suffixes that are not wanted, if given, are known to start nowhere else: they are not indexed, and not covered."""
        piece, begin = _suffixes(pieces, self.length)
        mine = np.arange(len(piece)) if wanted is None else np.flatnonzero(wanted)
        covered = np.zeros(len(piece), bool)
        if not len(mine):
            return covered
        new = _Level(np.frombuffer(b"".join(pieces), np.uint8), begin[mine], docs[piece[mine]], self.length)
        heads = new.heads()
        order = np.argsort(heads, kind="stable")
        heads = heads[order]
        first = np.append(True, heads[1:] != heads[:-1])
        starts = np.flatnonzero(first)
        least = np.minimum.reduceat(new.least[order], starts)
        heads = heads[starts]
        fresh = np.ones(len(heads), bool)
        for level in self.levels:
            self._match(level, heads, least, fresh)
        covered[mine[order]] = new.least[order] > least[np.cumsum(first) - 1]
        self._push(_Level(new.text, new.at[order][starts][fresh], least[fresh], self.length))
        return covered

    def _match(self, level: _Level, heads: np.ndarray, least: np.ndarray, fresh: np.ndarray) -> None:
        """Merge-scans a level with a batch's sorted suffixes, scan suffixes of the level at a time: equal neighbours match."""
        for x in range(0, len(level.at), self.scan):
            known = level.heads(x, x + self.scan)
            lo, hi = np.searchsorted(heads, known[0], "left"), np.searchsorted(heads, known[-1], "right")
            if lo == hi:
                continue
            both = np.concatenate([known, heads[lo:hi]])
            order = _merged(known, heads[lo:hi])
            same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
            theirs, ours = order[same] + x, order[same + 1] - len(known) + lo
            least[ours] = np.minimum(least[ours], level.least[theirs])
            fresh[ours] = False

    def _push(self, level: _Level) -> None:
        while self.levels and self.levels[-1].batches == level.batches:
            old = self.levels.pop()
            order = _merged(old.heads(), level.heads())
            at = np.concatenate([old.at, level.at + len(old.text)])[order]
            level = _Level(np.concatenate([old.text, level.text]), at, np.concatenate([old.least, level.least])[order], self.length, old.batches + level.batches)
        self.levels.append(level)


def _judged(places: dict[bytes, list[tuple[int, int, int, int]]], length: int, batch: int) -> list[tuple[int, int, int, int]]:
    """(block, row, begin, end) of the covered runs of a bucket's pieces; places has (doc, block, row, start) of each."""
    least = {p: min(x)[0] for p, x in places.items()}
    pieces = sorted(places, key=lambda p: (least[p], p))
    family, out = IndexFamily(length), []
    for p in pieces:
        if len(places[p]) > 1:
            out += [(b, r, s, s + len(p)) for d, b, r, s in places[p] if d != least[p]]
    wanted = repeated_windows(pieces, length, batch)
    begin = np.concatenate([[0], np.cumsum([len(p) - length + 1 for p in pieces])]).astype(np.int64)
    any_ = np.add.reduceat(wanted, begin[:-1]) > 0 if pieces else wanted
    wanted = wanted[np.repeat(any_, np.diff(begin))]
    pieces = [pieces[k] for k in np.flatnonzero(any_).tolist()]
    for k in range(0, len(pieces), batch):
        part = pieces[k : k + batch]
        n = sum(len(p) - length + 1 for p in part)
        covered = family.add(part, np.array([least[p] for p in part], np.int64), wanted[:n])
        wanted = wanted[n:]
        edge = np.concatenate([[0], np.cumsum([len(p) - length + 1 for p in part])])
        inside = np.zeros(len(covered) + 1, bool)
        inside[:-1] = covered
        head = np.append(True, ~inside[:-2]) & covered
        head[edge[:-1]] = covered[edge[:-1]]
        tail = ~inside[1:] & covered
        tail[edge[1:] - 1] = covered[edge[1:] - 1]
        begins, ends = np.flatnonzero(head), np.flatnonzero(tail)
        whose = np.searchsorted(edge, begins, side="right") - 1
        for p, x, y in zip(whose.tolist(), (begins - edge[whose]).tolist(), (ends - edge[whose]).tolist(), strict=True):
            out += [(b, r, s + x, s + y + length) for d, b, r, s in places[part[p]] if d == least[part[p]]]
    return out


def _covered(length: int, batch: int, gather: int):
    """(block, places, runs): packed covered runs (row, begin, end) of a block, from the pieces of a task's buckets. places is empty."""

    def run(batches):
        alone()
        unzip = zstandard.ZstdDecompressor().decompress
        back = _Back(gather)
        for _, rows in consecutive(batches, ["part"]):
            by: dict[int, list[tuple[int, bytes, bytes]]] = defaultdict(list)
            for items in rows.column("items"):
                for x in items.as_py():
                    if x["bucket"] < 0:
                        back.add(x["block"], b"", x["head"])
                    else:
                        by[x["bucket"]].append((x["block"], x["head"], x["text"]))
            for bucket in sorted(by):
                places: dict[bytes, list] = defaultdict(list)
                for block, head, zipped in by.pop(bucket):
                    text, at, piece = unzip(zipped), 0, b""
                    for doc, row, start, size in zip(*np.frombuffer(unzip(head), np.int64).reshape(4, -1).tolist(), strict=True):
                        if size > 0:
                            piece = text[at : at + size]
                            at += size
                        places[piece].append((doc, block, row, start))
                found = np.array(_judged(places, length, batch), np.int64).reshape(-1, 4)
                found = found[np.argsort(found[:, 0], kind="stable")]
                for x, y in zip(*(v.tolist() for v in runs_of(found[:, 0])), strict=True):
                    back.add(int(found[x, 0]), b"", found[x:y, 1:].astype(np.int32).tobytes())
                yield from back.rows(("places", "runs"))
        yield from back.rows(("places", "runs"), least=False)

    return run


def merged_runs(runs: np.ndarray) -> np.ndarray:
    """Disjoint, maximal (begin, end) runs in order, of runs that may overlap or touch."""
    if not len(runs):
        return runs
    r = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    starts = np.flatnonzero(np.append(True, r[1:, 0] > reach[:-1]))
    return np.stack([r[starts, 0], reach[np.append(starts[1:], len(r)) - 1]], 1)


def kept_bytes(raw: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for x, y in runs.tolist():
        out.append(raw[at:x])
        at = y
    out.append(raw[at:])
    return b"".join(out)


def _left(as_text: bool):
    """A block's rows without their covered runs."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        alone()
        table = _unpacked(left.column("packed")[0].as_py())
        runs = np.frombuffer(b"".join(right.column("runs").to_pylist()), np.int32).reshape(-1, 3).astype(np.int64)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        s, e = runs_of(runs[:, 0])
        of = {int(runs[x, 0]): runs[x:y, 1:] for x, y in zip(s, e, strict=True)}
        none, out = np.zeros((0, 2), np.int64), []
        for row, (_, raw) in enumerate(_rows(table)):
            r = merged_runs(of.get(row, none))
            kept = kept_bytes(raw, r)
            out.append((len(raw), int((r[:, 1] - r[:, 0]).sum()), len(r), kept.decode("utf-8", "ignore") if as_text else kept))
        arrays = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
        rest = [n for n in table.schema.names if n not in ("doc_id", "text")]
        return pa.table([table.column("doc_id"), *arrays, *(table.column(n) for n in rest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *rest])

    return one


def exchanges(blocks: DataFrame, total: int, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, gather: int = GATHER) -> dict[str, DataFrame]:
    """What is shuffled, by name: asked, told, pieces and covered of blocks (block, packed) with total bytes of text."""
    parts = 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-total // (parts * bucket_bytes)))  # the data decides how many buckets a part has
    buckets = parts * each
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    asked = blocks.mapInArrow(_asked(buckets, each, length, gram, gather), "part int, blocks binary, counts binary, codes binary")
    told = by_part(asked).mapInArrow(_shared(each, hot, gather), "block long, buckets binary, codes binary")
    pieces = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_pieces(buckets, each, length, gram), "part int, items array<struct<bucket:int,block:long,head:binary,text:binary>>")
    # not cut off here: the blocks' exchange of the first cogroup then serves the second one too
    covered = by_part(pieces).mapInArrow(_covered(length, batch, gather), "block long, places binary, runs binary").drop("places")
    return {"asked": asked, "told": told, "pieces": pieces, "covered": covered}


def without_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
    carry: dict[str, str] | None = None, as_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row, and the columns that carry names (as -> column).
    as_text returns kept as a string, without the characters of which bytes went."""
    scratch = Scratch(spark)
    extra = [F.col(c).alias(a) for a, c in (carry or {}).items()]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    blocks = scratch.save(chosen.mapInArrow(_blocks(block_bytes), "block long, n_bytes long, packed binary"), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    blocks = blocks.select("block", "packed")
    covered = exchanges(blocks, total, length, gram, batch, hot)["covered"]
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema.fields) if extra else ""
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{more}"
    return blocks.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(_left(as_text), schema)


def op7_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
