import hashlib
import random
import zlib

import numpy as np
import pytest

from paperloom.llm import flac


def payloads():
    rng = np.random.default_rng(3)
    ramp = (np.cumsum(rng.integers(-2, 3, 5000)) + 128) % 256
    raw = [b"", b"a", b"a" * 64, b"ab" * 1500, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes(range(256)) * 9, b"\x80" * 3000, ramp.astype(np.uint8).tobytes(), "naïve ".encode() * 900, b"z" * 200_000]
    return [flac.padded(p) for p in raw]


def test_batch_round_trip_and_plain_decoder():
    p = payloads()
    media = flac.encode_batch(p)
    assert flac.decode_batch(media) == p
    for one, m in zip(p[:9], media, strict=False):
        (channel,) = flac.decode_stream(m)
        assert (channel + 128).astype(np.uint8).tobytes() == one
    assert flac.encode_batch(p[3:5]) == media[3:5]


def test_seek_points_cover_the_samples():
    (p,) = [flac.padded(b"seek me " * 1000)]
    info = flac.metadata(flac.encode_batch([p])[0])
    assert [x[0] for x in info["points"]] == list(range(0, len(p), flac.BLOCK)) and sum(x[2] for x in info["points"]) == len(p) == info["samples"]


def test_damage_is_found():
    (m,) = flac.encode_batch([flac.padded(bytes(random.Random(1).choices(b"etaoin shrdlu", k=4000)))])
    start = flac.metadata(m)["start"]
    for at in (start, start + 4, start + 30, len(m) - 1, len(m) - 700):
        bad = bytearray(m)
        bad[at] ^= 4
        for decode in (lambda b: flac.decode_batch([b]), flac.decode_stream):
            with pytest.raises(flac.FlacError):
                decode(bytes(bad))


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def subframe(w, x, width, weights, shift, partitions):
    order = len(weights)
    w.put(0, 1), w.put(31 + order, 6), w.put(0, 1)
    for v in x[:order]:
        w.put(v, width)
    w.put(11, 4), w.put(shift, 5)
    for c in weights:
        w.put(c, 12)
    r = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))]
    w.put(0, 2), w.put(partitions, 4)
    size, at = len(x) >> partitions, 0
    for p in range(1 << partitions):
        part = r[at : at + size - (order if p == 0 else 0)]
        at += len(part)
        if p == 1:  # escaped: raw numbers
            w.put(15, 4), w.put(20, 5)
            for v in part:
                w.put(v, 20)
        else:
            w.put(5, 4)
            for v in part:
                z = v << 1 if v >= 0 else (-v << 1) - 1
                w.bits += "0" * (z >> 5) + "1"
                w.put(z, 5)


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
def test_lpc_stereo_stream(assignment):
    n = 256
    left = [int(3000 * np.sin(i / 9) + i % 7) for i in range(n)]
    right = [int(2500 * np.sin(i / 9 + 0.3)) for i in range(n)]
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: (mid, side)}[assignment]
    w = Writer()
    for v, k in ((0x7FFC, 15), (0, 1), (8, 4), (0, 4), (assignment, 4), (4, 3), (0, 1), (0, 8)):
        w.put(v, k)
    w.put(flac.crc8(Writer.bytes(w)), 8)
    subframe(w, first, 16 + (assignment == 9), (2000, -980), 10, 2)
    subframe(w, second, 16 + (assignment in (8, 10)), (1990, -970), 10, 2)
    frame = w.bytes()
    frame += flac.crc16(frame).to_bytes(2, "big")
    pcm = np.array([left, right], "<i2").T.tobytes()
    info = b"\x01\x00\x01\x00" + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    got = flac.decode_stream(b"fLaC" + (0x80 << 24 | 34).to_bytes(4, "big") + info + frame)
    assert got[0].tolist() == left and got[1].tolist() == right


def test_report_and_blocks(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 5000), (1, "héllo"), (None, "y" * 64)]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string")
    got = flac.report(docs).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, {x[0]: x[1] for x in rows}.get(r.doc_id)))), strict=True):
        p = flac.padded((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = flac.pcm_blocks(flac.store(docs)).where("doc_id = 4").orderBy("block").collect()
    assert b"".join(b.pcm for b in blocks) == flac.padded(b"x" * 5000) and [b.sample_offset for b in blocks] == [b.block * 1024 for b in blocks]
    assert flac.report(docs.limit(0)).count() == 0


def with_rate_code(stream, code):
    """The same stream with another rate code in its frame headers, checksums redone."""
    info = flac.metadata(stream)
    ends = [p[1] for p in info["points"][1:]] + [len(stream) - info["start"]]
    out = bytearray(stream)
    for i, ((_, at, n), end) in enumerate(zip(info["points"], ends, strict=True)):
        a, b = info["start"] + at, info["start"] + end
        out[a + 2] |= code
        head = a + 5 + (i > 127) + 2 * (n != flac.BLOCK)
        out[head] = flac.crc8(bytes(out[a:head]))
        out[b - 2 : b] = flac.crc16(bytes(out[a : b - 2])).to_bytes(2, "big")
    return bytes(out)


def test_valid_streams_that_the_quick_reader_refuses_are_read():
    p = [flac.padded(b"some words " * 300), flac.padded(b"other words " * 300)]
    media = flac.encode_batch(p)
    assert flac.decode_batch([with_rate_code(media[0], 4), media[1]]) == p


def test_long_payloads_are_cut_into_runs_of_frames(monkeypatch):
    p = payloads()
    whole = flac.encode_batch(p)
    monkeypatch.setattr(flac, "FRAMES", 3)
    assert flac.encode_batch(p) == whole and flac.decode_batch(whole) == p


def test_reading_begins_at_any_sample():
    p = flac.padded(bytes(random.Random(2).choices(b"etaoin shrdlu", k=5000)))
    (m,) = flac.encode_batch([p])
    for at in (0, 1, 1023, 1024, 3000, len(p) - 1, len(p)):
        for count in (None, 0, 7, 2000):
            (got,) = flac.read_from(m, at, count)
            assert (got + 128).astype(np.uint8).tobytes() == p[at : None if count is None else at + count]
    broken = bytearray(m)  # what lies before the seek point is not read
    broken[flac.metadata(m)["start"] + 10] ^= 255
    (got,) = flac.read_from(bytes(broken), 2048, 100)
    assert (got + 128).astype(np.uint8).tobytes() == p[2048:2148]
