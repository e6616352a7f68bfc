"""Operator 4: media columns as MPEG transport streams.

store() wraps a payload of 8-bit samples as an MPEG-2 transport stream: a program association table and a program map
table (with their CRC-32) before every group of access units, one elementary stream of packetised (PES) access units with
presentation timestamps, a clock reference and, at the first unit of each group, the random-access indicator; 188-byte
packets with continuity counters, the last packet of a unit stuffed by its adaptation field.

read() knows nothing of store(): it parses the program tables, checks sync bytes, transport errors, table CRCs and
continuity counters, reassembles the elementary packets from the payloads of their packets, and returns the payload with
every unit's timestamp and the byte offset of each random-access point. A stream that is not whole raises ValueError.

Both are narrow maps over Arrow batches. Null texts count as empty; the payload is then 64 zero bytes. Equal texts give
equal bytes. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
UNIT, GROUP, TICKS = 8_192, 8, 3_600  # bytes of an access unit, units of a group, 90 kHz ticks of a unit
ALIGN = 64
#: Bytes of output after which a batch is passed on.
FLUSH = 16 << 20


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


def crc32_mpeg(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def tables() -> np.ndarray:
    """The association and the map table, one packet each, with continuity counters still 0."""
    pat = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = np.full((2, PACKET), 0xFF, np.uint8)
    for k, (pid, section) in enumerate(((0, pat), (PMT_PID, pmt))):
        packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
        out[k, : len(packet)] = np.frombuffer(packet, np.uint8)
    return out


def _units(samples: np.ndarray, first: int) -> np.ndarray:
    """Packets (units, packets, 188) of equal access units, whose numbers begin at first; counters still 0."""
    n, size = samples.shape
    number = np.arange(first, first + n, dtype=np.uint64)
    pts = number * np.uint64(TICKS)
    pes = np.empty((n, 14 + size), np.uint8)
    pes[:, :9] = np.frombuffer(bytes([0, 0, 1, STREAM_ID]) + (size + 8).to_bytes(2, "big") + bytes([0x80, 0x80, 5]), np.uint8)
    at = lambda shift, mask: (pts >> np.uint64(shift) & np.uint64(mask)).astype(np.uint8)
    pes[:, 9], pes[:, 10], pes[:, 11] = 0x21 | at(30, 7) << 1, at(22, 0xFF), 1 | at(15, 0x7F) << 1
    pes[:, 12], pes[:, 13] = at(7, 0xFF), 1 | at(0, 0x7F) << 1
    pes[:, 14:] = samples
    total = 14 + size
    packets = 1 if total <= 176 else 1 + -(-(total - 176) // 184)
    out = np.full((n, packets, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    room = min(total, 176)
    field = 183 - room
    out[:, 0, 4] = field
    out[:, 0, 5] = np.where(number % np.uint64(GROUP) == 0, 0x50, 0x10)
    out[:, 0, 6], out[:, 0, 7] = at(25, 0xFF), at(17, 0xFF)  # the clock reference's base; its extension is 0
    out[:, 0, 8], out[:, 0, 9] = at(9, 0xFF), at(1, 0xFF)
    out[:, 0, 10], out[:, 0, 11] = at(0, 1) << 7 | 0x7E, 0
    out[:, 0, 5 + field :] = pes[:, :room]
    if packets > 1:
        rest = total - room
        whole = packets - 2
        if whole:
            out[:, 1 : 1 + whole, 4:] = pes[:, room : room + whole * 184].reshape(n, whole, 184)
        tail = rest - whole * 184
        if tail < 184:
            out[:, -1, 3] = 0x30
            out[:, -1, 4] = 183 - tail
            if tail < 183:
                out[:, -1, 5] = 0
        out[:, -1, PACKET - tail :] = pes[:, total - tail :]
    return out


def store(payload: bytes) -> bytes:
    """The transport stream of a payload of one byte or more."""
    data = np.frombuffer(payload, np.uint8)
    full = len(data) // UNIT
    packs = []
    if full:
        per = _units(data[: full * UNIT].reshape(full, UNIT), 0)
        packs = [per[i : i + GROUP].reshape(-1, PACKET) for i in range(0, full, GROUP)]
    if len(data) > full * UNIT:
        last = _units(data[full * UNIT :].reshape(1, -1), full).reshape(-1, PACKET)
        if full % GROUP and packs:
            packs[-1] = np.concatenate([packs[-1], last])
        else:
            packs.append(last)
    media = np.concatenate([x for p in packs for x in (tables(), p)])
    is_table = np.zeros(len(media), bool)
    starts = np.cumsum([0] + [len(p) + 2 for p in packs[:-1]])
    is_table[starts] = is_table[starts + 1] = True
    counter = np.empty(len(media), np.uint8)
    counter[~is_table] = np.arange(len(media) - 2 * len(packs)) & 15
    counter[starts] = counter[starts + 1] = np.arange(len(packs)) & 15
    media[:, 3] |= counter
    return media.tobytes()


def _table(packet: np.ndarray) -> bytes:
    """The section that a packet begins."""
    offset = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    body = packet[offset + 1 + int(packet[offset]) :].tobytes()
    section = body[: 3 + (int.from_bytes(body[1:3], "big") & 0xFFF)]
    if crc32_mpeg(section):
        raise ValueError("a program table's CRC does not hold")
    return section


def _checked(packets: np.ndarray) -> bytes:
    """The first of the sections that packets begin; the CRC of each different one has to hold. Counters are not part of it."""
    if not len(packets):
        raise ValueError("a program table is missing")
    counted = packets.copy()
    counted[:, 3] &= 0xF0
    different = np.flatnonzero((counted != counted[0]).any(1))
    first = _table(packets[0])
    for one in dict.fromkeys(counted[k].tobytes() for k in different):
        _table(np.frombuffer(one, np.uint8))
    return first


def read(media: bytes) -> dict:
    """The stream's payload, units' timestamps (90 kHz), random-access points (byte offset, timestamp) and figures."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise ValueError("sync byte lost or transport error")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    pats = np.flatnonzero((pid == 0) & starts)
    if not len(pats):
        raise ValueError("no program association table")
    pat = _checked(p[pats])
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4)}
    map_pid = next(v for k, v in programs.items() if k)
    pmt = _checked(p[np.flatnonzero((pid == map_pid) & starts)])
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    media_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    breaks = 0
    for one in {0, map_pid, media_pid}:
        counters = p[(pid == one) & ((p[:, 3] & 0x10) != 0), 3] & 15
        breaks += int(((counters[1:] - counters[:-1] & 15) != 1).sum())
    if breaks:
        raise ValueError(f"{breaks} continuity counters do not follow their predecessors")
    own = np.flatnonzero(pid == media_pid)
    e = p[own]
    adapted = (e[:, 3] & 0x20) != 0
    offset = np.where(adapted, 5 + e[:, 4].astype(np.int32), 4)
    stream = e[np.arange(PACKET) >= offset[:, None]]
    begin = np.concatenate([[0], np.cumsum(PACKET - offset)])[:-1]
    first = (e[:, 1] & 0x40) != 0
    s = begin[first]
    if not len(s) or s[0] or (stream[s] | stream[s + 1]).any() or (stream[s + 2] != 1).any():
        raise ValueError("an elementary packet does not begin with its start code")
    g = lambda k: stream[s + k].astype(np.int64)
    pts = (g(9) >> 1 & 7) << 30 | g(10) << 22 | g(11) >> 1 << 15 | g(12) << 7 | g(13) >> 1
    head = 9 + g(8)
    size = (g(4) << 8 | g(5)) + 6 - head
    ends = np.append(s[1:], len(stream))
    if (ends - s - head != size).any():
        raise ValueError("an elementary packet is not as long as it says")
    keep = np.ones(len(stream) + 1, np.int8)
    edge = np.zeros(len(stream) + 1, np.int8)
    edge[s] += 1
    edge[s + head] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    access = first & adapted & ((e[:, 5] & 0x40) != 0)
    points = own[access] * PACKET
    return {
        "payload": stream[keep].tobytes(), "timestamps": pts, "access_offsets": points, "access_timestamps": pts[np.flatnonzero(access[first])],
        "packets": len(p), "units": len(s), "stream_type": pmt[at], "stuffing": int((offset - 4).sum()),
    }


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def _flushed(batches, one, schema: pa.Schema):
    """Rows one(row values) of each batch, passed on in bounded pieces."""
    for b in batches:
        rows, held = [], 0
        for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            row, weight = one(*values)
            rows.append(row)
            held += weight
            if held >= FLUSH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


STORED = "doc_id long, n_bytes long, media binary"
STORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded, as a transport stream."""

    def one(doc_id, text):
        n, payload = padded(text)
        media = store(payload)
        return {"doc_id": doc_id, "n_bytes": n, "media": media}, len(media)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(lambda batches: _flushed(batches, one, STORED_ARROW), STORED)


READ = "doc_id long, n_bytes long, media_bytes long, payload binary, timestamps array<long>, access_offsets array<long>, access_timestamps array<long>, feature string"
READ_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("payload", pa.binary()), ("timestamps", pa.list_(pa.int64())), ("access_offsets", pa.list_(pa.int64())), ("access_timestamps", pa.list_(pa.int64())), ("feature", pa.string())]
)


def feature(got: dict) -> str:
    """What the stream says of itself and its samples, as text."""
    hist = np.bincount(np.frombuffer(got["payload"], np.uint8), minlength=256)
    p = hist[hist > 0] / hist.sum()
    level = float((hist * np.arange(256)).sum() / hist.sum())
    return (
        f"type={got['stream_type']} packets={got['packets']} units={got['units']} access={len(got['access_offsets'])} last_pts={int(got['timestamps'][-1])} "
        f"stuffing={got['stuffing']} mean={level:.3f} entropy={max(0.0, float(-(p * np.log2(p)).sum())):.3f}"
    )


def read_column(stored: DataFrame) -> DataFrame:
    """Reads each stored stream back: payload, timestamps, random-access points and features."""

    def one(doc_id, n_bytes, media):
        got = read(media)
        row = {k: got[k] for k in ("payload", "timestamps", "access_offsets", "access_timestamps")}
        return row | {"doc_id": doc_id, "n_bytes": n_bytes, "media_bytes": len(media), "feature": feature(got)}, len(media)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _flushed(batches, one, READ_ARROW), READ)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_access long"
DIGESTS_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in DIGESTS.split(", "))])


def digest_column(stored: DataFrame) -> DataFrame:
    """read_column() reduced to digests inside the task, so that payloads do not travel back."""

    def one(doc_id, n_bytes, media):
        got = read(media)
        payload = got["payload"]
        return {
            "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-ALIGN:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
            "feature": feature(got), "n_units": got["units"], "n_access": len(got["access_offsets"]),
        }, 400

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _flushed(batches, one, DIGESTS_ARROW), DIGESTS)


def op4_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_column(store_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
