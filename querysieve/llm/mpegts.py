"""Media columns: MPEG transport streams as binary values.

``mux`` stores payload bytes as a transport stream (one program, one private elementary stream), ``demux``
reads streams back: program tables, continuity counters, elementary packets, timestamps, random-access points.

A stream starts with a program association table and a program map table and repeats both before every
random-access point.  The payload travels in access units of ``UNIT_BYTES``, one elementary (PES) packet each,
with a presentation time ``UNIT_TICKS`` after the last; every ``GROUP``-th unit is a random-access point and
carries a clock reference.

Reading takes foreign streams too: any number of programs and elementary streams, each put together by its own PID;
table sections over several packets, several in one; elementary packets without a stated length; a packet sent twice
(allowed once) is dropped, a stated discontinuity is no error.

Edge cases: null and empty text are stored as 64 zero bytes, so no stream is without a unit; a stream that is
null, torn (no multiple of 188 bytes), out of sync, without program tables, with a wrong table checksum or a
short elementary packet gets ``error`` and no payload, its feature says -1 for times it hasn't; a lost packet shows in
``cc_errors``, a repeated one in ``repeated``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import as_bytes, id_and_text

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data, private stream 1
NULL_PID, MAP_TABLE = 0x1FFF, 0x02
# Stream ids whose packets have no flags (map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 E, directory).
PLAIN_STREAMS = [bytes([i]) for i in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)]
UNIT_BYTES, GROUP, UNIT_TICKS, FIRST_TICK = 8192, 8, 3600, 90_000
PAD = 64


def padded(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of 64 bytes."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        crc = i << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=256)
def table_crc(section: bytes) -> int:
    """The checksum of program tables: zero over a section with its own checksum."""
    crc = 0xFFFFFFFF
    for b in section:
        crc = (crc << 8 ^ _CRC[crc >> 24 ^ b]) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + table_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(0x02, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _timestamp(ticks: int) -> bytes:
    """33 bits in five bytes with marker bits, as presentation times are written."""
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _clock(ticks: int) -> bytes:
    """Clock reference: a 33-bit base, six reserved bits, an extension of zero."""
    return (ticks << 15 | 0x3F << 9).to_bytes(6, "big")


def mux_bytes(payload: bytes) -> bytes:
    packets = []
    media_cc = 0
    for unit, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        key = unit % GROUP == 0
        ticks = FIRST_TICK + unit * UNIT_TICKS
        data = payload[start : start + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(ticks) + data
        # The first packet of a random-access point spends 8 bytes on flags and clock.
        room = PACKET - 4 - 8 if key else PACKET - 4
        rest = max(0, len(pes) - room)
        n = 1 + -(-rest // (PACKET - 4))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (media_cc + np.arange(n)) & 0x0F
        media_cc += n
        sizes = [len(pes)] if n == 1 else [room, *[PACKET - 4] * (n - 2), len(pes) - room - (PACKET - 4) * (n - 2)]
        whole = np.frombuffer(pes, np.uint8)
        if n > 2:
            out[1 : n - 1, 4:] = whole[room : room + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
        at = 0
        for row in dict.fromkeys((0, n - 1)):
            size = sizes[row]
            at = 0 if row == 0 else len(pes) - size
            out[row, PACKET - size :] = whole[at : at + size]
            extra = PACKET - 4 - size
            if extra:
                out[row, 3] |= 0x20
                out[row, 4] = extra - 1
                if extra > 1:
                    out[row, 5] = 0x50 if key and row == 0 else 0x00
                if key and row == 0:
                    out[row, 6:12] = np.frombuffer(_clock(ticks), np.uint8)
        if key:
            pair = np.stack([_PAT, _PMT])
            pair[:, 3] |= unit // GROUP & 0x0F
            packets.append(pair)
        packets.append(out)
    return np.concatenate(packets).tobytes()


@dataclass
class Unit:
    """One elementary packet: its stream, presentation time (-1: none), payload bytes and the packet it starts in."""

    pid: int
    pts: int
    n_bytes: int
    random_access: bool
    byte_offset: int


@dataclass
class Stream:
    """What ``demux_bytes`` found; ``payloads`` and ``types`` by PID."""

    payloads: dict[int, bytes] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    error: str | None = None
    packets: int = 0
    cc_errors: int = 0
    repeated: int = 0
    tables: int = 0
    units: list[Unit] = field(default_factory=list)

    @property
    def payload(self) -> bytes | None:
        """All elementary streams, by PID; None if something is wrong."""
        return None if self.error else b"".join(self.payloads[p] for p in sorted(self.payloads))


class Packets:
    """The packets of a transport stream, their header fields as arrays; ``own`` are those to be read of a PID."""

    def __init__(self, media: bytes):
        self.rows = rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        self.pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        self.first = rows[:, 1] & 0x40 != 0
        self.adapted, self.filled = rows[:, 3] & 0x20 != 0, rows[:, 3] & 0x10 != 0
        self.starts = np.where(self.adapted, np.minimum(5 + rows[:, 4].astype(np.int32), PACKET), 4)
        self.flags = np.where(self.adapted & (rows[:, 4] > 0), rows[:, 5], 0)
        self.counters = rows[:, 3] & 0x0F
        self.cc_errors = self.repeated = 0
        self.own: dict[int, np.ndarray] = {}
        damaged = rows[:, 1] & 0x80 != 0
        for p in np.unique(self.pid).tolist():
            at = np.flatnonzero((self.pid == p) & self.filled & ~damaged)
            step = np.diff(self.counters[at].astype(np.int32)) % 16
            again = np.concatenate(([False], (step == 0) & self._equal(at[1:], at[:-1])))
            again[1:] &= ~again[:-1]  # a packet can be sent twice, not more often
            self.repeated += int(again.sum())
            at = at[~again]
            step = np.diff(self.counters[at].astype(np.int32)) % 16
            self.cc_errors += int(((step != 1) & (self.flags[at[1:]] & 0x80 == 0)).sum()) if p != NULL_PID else 0
            self.own[p] = at

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tails = np.arange(PACKET) >= self.starts[a][:, None]
        return (self.starts[a] == self.starts[b]) & ((self.rows[a] == self.rows[b]) | ~tails).all(axis=1)

    def payload(self, i: int) -> bytes:
        return self.rows[i, self.starts[i] :].tobytes()

    def sections(self, pid: int) -> list[bytes]:
        """All table sections of a PID, put together over packets and checked."""
        found, open_ = [], None
        for i in self.own.get(pid, np.empty(0, np.int64)).tolist():
            data = self.payload(i)
            if self.first[i]:
                if open_:
                    open_ = self._closed(open_ + data[1 : 1 + data[0]], found)
                open_ = data[1 + data[0] :]
            elif open_ is None:
                continue
            else:
                open_ += data
            open_ = self._closed(open_, found)
        if open_:
            raise ValueError("short table")
        return found

    @staticmethod
    def _closed(data: bytes, found: list[bytes]) -> bytes | None:
        """Takes whole sections off the front; what is left of an open one (None: nothing but padding)."""
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + (data[1] & 0x0F) * 256 + data[2]
            if len(data) < size:
                return data
            if table_crc(data[:size]):
                raise ValueError("table checksum")
            found.append(data[:size])
            data = data[size:]
        return data if 0 < len(data) < 3 and data[0] != 0xFF else None


def _program_streams(packets: Packets) -> tuple[dict[int, int], int]:
    """The elementary PIDs of all programs with their types, and how many tables were read."""
    maps, media, tables = [], {}, 0
    for section in packets.sections(PAT_PID):
        tables += 1
        for at in range(8, len(section) - 4, 4):
            if int.from_bytes(section[at : at + 2], "big"):
                maps.append(int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF)
    for pid in dict.fromkeys(maps):
        for section in packets.sections(pid):
            if section[0] != MAP_TABLE:
                continue
            tables += 1
            at = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
            while at < len(section) - 4:
                media[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)
    return media, tables


def _elementary(packets: Packets, pid: int) -> tuple[bytes, list[Unit]]:
    """The payload and units of one elementary stream; what comes before its first unit start can't be read."""
    own = packets.own.get(pid, np.empty(0, np.int64))
    heads = np.flatnonzero(packets.first[own])
    if not len(heads):
        return b"", []
    own, heads = own[heads[0] :], heads - heads[0]
    sizes = PACKET - packets.starts[own]
    body = packets.rows[own][np.arange(PACKET) >= packets.starts[own][:, None]].tobytes()
    bounds = [*(np.cumsum(sizes) - sizes)[heads].tolist(), len(body)]
    parts, units = [], []
    for head, at, to in zip(own[heads].tolist(), bounds, bounds[1:]):
        length = int.from_bytes(body[at + 4 : at + 6], "big")
        plain = body[at + 3 : at + 4] in PLAIN_STREAMS
        if body[at : at + 3] != b"\x00\x00\x01" or to - at < (6 if plain else 9) or (length and to - at != length + 6):
            raise ValueError("short elementary packet")
        data = at + 6 if plain else at + 9 + body[at + 8]
        timed = not plain and body[at + 7] & 0x80 and data >= at + 14
        if data > to:
            raise ValueError("short elementary packet")
        units.append(Unit(pid, _read_timestamp(body[at + 9 : at + 14]) if timed else -1, to - data, bool(packets.flags[head] & 0x40), head * PACKET))
        parts.append(body[data:to])
    return b"".join(parts), units


def demux_bytes(media: bytes | None) -> Stream:
    found = Stream()
    if not media or len(media) % PACKET:
        found.error = "no whole packets"
        return found
    found.packets = len(media) // PACKET
    if set(media[::PACKET]) != {SYNC}:
        found.error = "lost sync"
        return found
    packets = Packets(media)
    found.cc_errors, found.repeated = packets.cc_errors, packets.repeated
    try:
        found.types, found.tables = _program_streams(packets)
        for pid in sorted(found.types):
            found.payloads[pid], units = _elementary(packets, pid)
            found.units += units
        if not found.units:
            raise ValueError("no elementary stream")
    except (ValueError, IndexError) as e:
        found.error = str(e)
    return found


def mux(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes (of the text), media binary."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch["text"])
            media = pa.array([mux_bytes(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(map(len, texts)), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pid:int,pts:long,n_bytes:long,random_access:boolean,byte_offset:long>>"
STREAMS = "array<struct<pid:int,type:int,payload:binary>>"


def demux(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) -> the same with payload, streams, error, packets, tables, cc_errors, repeated, units.

    ``units`` is the stored index: by stream a presentation time, a size, a random-access flag and the byte to seek to.
    """
    numbers = ["packets", "tables", "cc_errors", "repeated"]
    schema = f"doc_id long, n_bytes long, media binary, payload binary, streams {STREAMS}, error string, {' long, '.join(numbers)} long, units {UNITS}"
    stream_type = pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32()), ("payload", pa.binary())]))
    unit_type = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("n_bytes", pa.int64()), ("random_access", pa.bool_()), ("byte_offset", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [demux_bytes(m.as_py()) for m in batch["media"]]
            units = [[vars(u) for u in s.units] for s in found]
            streams = [[] if s.error else [{"pid": p, "type": s.types[p], "payload": s.payloads[p]} for p in sorted(s.payloads)] for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], batch["media"], pa.array([s.payload for s in found], pa.binary()), pa.array(streams, stream_type), pa.array([s.error for s in found], pa.string())]
                + [pa.array([getattr(s, k) for s in found], pa.int64()) for k in numbers]
                + [pa.array(units, unit_type)],
                ["doc_id", "n_bytes", "media", "payload", "streams", "error", *numbers, "units"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def _feature() -> Column:
    """Units, random-access points, times and stream health in one line."""
    at = lambda where: F.coalesce(F.get("units", where)["pts"], F.lit(-1).cast("long"))
    return F.format_string(
        "units=%d;random_access=%d;first_pts=%d;last_pts=%d;packets=%d;tables=%d;cc_errors=%d",
        F.size("units"),
        F.size(F.filter("units", lambda u: u["random_access"])),
        at(F.lit(0)),
        at(F.size("units") - 1),
        "packets",
        "tables",
        "cc_errors",
    )


def digests(docs: DataFrame) -> DataFrame:
    """Store, read back, describe: the digest columns, all computed from the stored bytes.  Runs without a shuffle."""
    read = demux(mux(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{PAD}, {PAD})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        _feature().alias("feature"),
        "error",
    )


__all__ = ["Stream", "Unit", "demux", "demux_bytes", "digests", "mux", "mux_bytes", "padded"]
