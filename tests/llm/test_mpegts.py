import hashlib
import random
import zlib

import pytest

from querysieve.llm import mpegts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100, 150, 154, 155, 170, 171, 172, 173, 176, 184, 185, 330, 8191, 8192, 8193, 70_000])
def test_round_trip(n):
    payload = mpegts.padded(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
    found = mpegts.demux_bytes(mpegts.mux_bytes(payload))
    assert (found.payload, found.error, found.cc_errors) == (payload, None, 0)
    assert sum(u.n_bytes for u in found.units) == len(payload) and [u.pts for u in found.units] == [90_000 + 3600 * k for k in range(len(found.units))]
    assert [u.random_access for u in found.units] == [k % 8 == 0 for k in range(len(found.units))]


def test_damage_shows():
    media = bytearray(mpegts.mux_bytes(mpegts.padded(b"x" * 5000)))
    lost = bytes(media[: 5 * 188] + media[6 * 188 :])
    assert mpegts.demux_bytes(lost).cc_errors == 1 and mpegts.demux_bytes(lost).error == "short elementary packet"
    assert mpegts.demux_bytes(bytes(media[:-1])).error == "no whole packets"
    assert mpegts.demux_bytes(None).error == "no whole packets"
    assert mpegts.demux_bytes(bytes(media[2 * 188 :])).error == "no elementary stream"
    torn = media.copy()
    torn[0] = 0
    assert mpegts.demux_bytes(bytes(torn)).error == "lost sync"
    torn = media.copy()
    torn[8] ^= 1
    assert mpegts.demux_bytes(bytes(torn)).error == "table checksum"


def packet(pid, counter, data, start=False, filler=b""):
    """One packet, written by hand: the adaptation field takes what the payload leaves."""
    spare = 184 - len(data)
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if spare else 0x10) | counter % 16])
    return head + (bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"") if spare else b"") + data


def spread(pid, data, start_at=0):
    return [packet(pid, start_at + k, data[at : at + 184], at == 0) for k, at in enumerate(range(0, len(data), 184))]


def section(table, number, body):
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    crc = 0xFFFFFFFF
    for bit in "".join(f"{b:08b}" for b in head + body):
        crc = (crc << 1) & 0xFFFFFFFF ^ (0x04C11DB7 if (crc >> 31) ^ int(bit) else 0)
    return head + body + crc.to_bytes(4, "big")


def pes(stream_id, data, pts=None, sized=True):
    flags = bytes([0x80, 0x80 if pts is not None else 0, 5 if pts is not None else 0])
    stamp = b"" if pts is None else bytes([0x21 | (pts >> 30) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])
    return b"\x00\x00\x01" + bytes([stream_id]) + (len(flags + stamp + data) if sized else 0).to_bytes(2, "big") + flags + stamp + data


def test_foreign_streams():
    """Two interleaved streams, a map over three packets, a packet sent twice, an open-ended unit: by another writer."""
    draw = random.Random(0)
    entries = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info for kind, pid, info in ((0x1B, 0x101, b"\x05" * 200), (0x0F, 0x102, b"\x06" * 200)))
    tables = spread(0, b"\x00" + section(0, 1, b"\x00\x00\xe0\x10" + b"\x00\x07" + (0xE000 | 0x1F0).to_bytes(2, "big")))
    tables += spread(0x1F0, b"\x00" + section(2, 7, b"\xe1\x01\xf0\x00" + entries))
    one, two = draw.randbytes(900), [draw.randbytes(300), draw.randbytes(50)]
    first = spread(0x101, pes(0xE0, one, 12345, sized=False))
    later = spread(0x102, pes(0xC0, two[0], 777))
    later += spread(0x102, pes(0xC0, two[1]), len(later))
    media = list(tables)
    for k in range(max(len(first), len(later))):
        media += first[k : k + 1] + later[k : k + 1]
        if k == 1:
            media.append(later[1])  # sent twice
    found = mpegts.demux_bytes(b"".join(media))
    assert (found.error, found.cc_errors, found.repeated, found.tables) == (None, 0, 1, 2)
    assert found.payloads == {0x101: one, 0x102: b"".join(two)} and found.types == {0x101: 0x1B, 0x102: 0x0F}
    assert [(u.pid, u.pts, u.n_bytes) for u in found.units] == [(0x101, 12345, 900), (0x102, 777, 300), (0x102, -1, 50)]
    lost = b"".join(p for k, p in enumerate(media) if k != len(tables) + 2)
    assert mpegts.demux_bytes(lost).cc_errors == 1


def test_damaged_streams_have_a_feature(spark):
    whole = mpegts.mux_bytes(mpegts.padded(b"y" * 3000))
    rows = [(1, 0, None), (2, 0, b""), (3, 0, whole[:-1]), (4, 0, whole[2 * 188 :]), (5, 0, whole[: 188 * 6]), (6, 0, bytes(188 * 3)), (7, 0, whole)]
    got = mpegts.demux(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).select("doc_id", "error", mpegts._feature().alias("f")).collect()
    assert {r.doc_id for r in got if r.error} == {1, 2, 3, 4, 5, 6} and all(r.f.startswith("units=") for r in got)


def test_checksum_is_the_standard_one():
    assert mpegts.table_crc(b"123456789") == 0x0376E6E7


def test_timestamps_survive():
    for ticks in (0, 1, 90_000, (1 << 33) - 1, 0x155555555):
        assert mpegts._read_timestamp(mpegts._timestamp(ticks)) == ticks


def test_frames(spark, odd, none):
    rows = mpegts.digests(odd).collect()
    by_text = {}
    for r in odd.collect():
        p = mpegts.padded((r.text or "").encode())
        by_text[hashlib.sha256(p).hexdigest()] = (len((r.text or "").encode()), len(p), zlib.crc32(p[-64:]))
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == by_text[r.payload_sha256] and r.error is None and r.media_bytes % 188 == 0
    assert mpegts.digests(none).count() == 0
    first = mpegts.demux(mpegts.mux(odd)).where("doc_id = 5").first()
    assert first.units[0].random_access and first.units[8].random_access and not first.units[1].random_access
    assert first.units[1].byte_offset % 188 == 0
