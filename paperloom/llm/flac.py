"""FLAC: lossless 8-bit mono streams, written and read in batches of frames.

Writing picks for each block of 1024 samples the cheapest of a constant, a
verbatim or a fixed linear predictor of order 0 to 2 with Rice-coded residuals;
each frame has its CRC-8 and CRC-16, each stream its MD5 and a seek point per
block.  With all frame offsets at hand, reading decodes the Rice codes of
FRAMES frames in step, one code of every frame at a time, so numpy works on
thousands of values and a long text takes no more memory than FRAMES blocks
besides its bytes.  `decode_stream` reads any stream of this format (stereo
decorrelation, LPC, wasted bits, partitions, escapes, no seek table), sample by
sample; streams that the quick way does not know go there.  Both check every
checksum and raise FlacError.  `read_from` decodes from any sample on, starting
at the seek point before it.

Null text is empty, and its payload one unit of zero bytes.  Rows keep their
number; repeated rows have equal streams.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, texts_of

BLOCK = 1024
RATE = 8000
UNIT = 64
MAX_QUOTIENT = 24  # the writer's; the quick reader sends longer codes to the plain one
FRAMES = 2048
SLICE = 2 << 20
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # coefficients of the fixed predictors: fixed values


class FlacError(ValueError):
    pass


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (width - 1) & 1 else c << 1
        out.append(c & ((1 << width) - 1))
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ int(CRC16[(c >> 8) ^ b])
    return c


def _crc16_all(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[start : start + size] for each pair, in step."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.zeros(len(order), np.uint16)
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for t, n in enumerate(live.tolist()):
        crc[:n] = (crc[:n] << 8) ^ CRC16[(crc[:n] >> 8) ^ buf[start[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _headers(number: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Header bytes (rows, padded) and their sizes for frames of mono 8-bit audio."""
    size = len(number)
    out, at = np.zeros((size, 12), np.uint8), np.full(size, 4)
    rows = np.arange(size)
    out[:, 0], out[:, 1], out[:, 3] = 0xFF, 0xF8, 0x02
    whole = n == BLOCK
    out[:, 2] = np.where(whole, 0xA0, 0x70)
    more = (number >= 1 << 7).astype(int) + (number >= 1 << 11) + (number >= 1 << 16)  # continuation bytes
    lead = np.array([0x00, 0xC0, 0xE0, 0xF0])[more]
    out[:, 4] = lead | (number >> (6 * more))
    for j in range(1, 4):
        has = more >= j
        out[rows[has], 4 + j] = 0x80 | ((number[has] >> (6 * (more[has] - j))) & 0x3F)
    at = 5 + more
    short = rows[~whole]
    out[short, at[short]], out[short, at[short] + 1] = (n[short] - 1) >> 8, (n[short] - 1) & 255
    at = at + 2 * ~whole
    crc = np.zeros(size, np.uint16)
    for t in range(int(at.max(initial=0))):
        has = t < at
        crc[has] = CRC8[crc[has] ^ out[has, t]]
    out[rows, at] = crc
    return out, at + 1


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload of 8-bit samples (byte b is level b - 128)."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    per = -(-sizes // BLOCK)
    total = int(per.sum())
    if not total:
        return [_stream(p, [], [], b"") for p in payloads]
    number = np.concatenate([np.arange(k) for k in per])
    owner = np.repeat(np.arange(len(payloads)), per)
    n = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    raw, at, parts, frame_size = b"".join(payloads), np.concatenate([[0], np.cumsum(n)]), [], []
    for a in range(0, total, FRAMES):
        b = min(a + FRAMES, total)
        frames, size = _encode_frames(np.frombuffer(raw, np.uint8, int(at[b] - at[a]), int(at[a])), number[a:b], n[a:b])
        parts.append(frames)
        frame_size.append(size)
    frame_size, raw = np.concatenate(frame_size), b"".join(parts)
    begin, first = np.concatenate([[0], np.cumsum(frame_size)]), np.concatenate([[0], np.cumsum(per)])
    out = []
    for i, payload in enumerate(payloads):
        a, b = first[i], first[i + 1]
        out.append(_stream(payload, (begin[a:b] - begin[a]).tolist(), frame_size[a:b].tolist(), raw[begin[a] : begin[b]]))
    return out


def _encode_frames(samples: np.ndarray, number: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames of consecutive blocks and their sizes; number: of the block in
    its stream, n: its samples."""
    total, column = len(n), np.arange(BLOCK)
    valid = column < n[:, None]
    x = np.full((total, BLOCK), 128, np.uint8)
    x[valid] = samples
    x = x.astype(np.int16) - 128
    z = np.empty((3, total, BLOCK), np.int16)
    r = x
    for order in range(3):
        if order:
            r = np.concatenate([r[:, :1] * 0, r[:, 1:] - r[:, :-1]], axis=1)
        z[order] = (r << 1) ^ (r >> 15)
        z[order][:, :order] = 0
        z[order][~valid] = 0
    order = z.sum(axis=2, dtype=np.int64).argmin(axis=0)
    order = np.where(n > 2, order, 0)
    z = z[order, np.arange(total)]
    codes = n - order
    bits = np.stack([(z >> k).sum(axis=1, dtype=np.int64) + codes * (k + 1) for k in range(8)])
    top = z.max(axis=1).astype(np.int64)
    bits[(top >> np.arange(8)[:, None]) > MAX_QUOTIENT] = 1 << 40
    rice = bits.argmin(axis=0)
    fixed = 8 * order + 10 + bits.min(axis=0) < 8 * n
    constant = np.where(valid, x, x[:, :1]).min(axis=1) == np.where(valid, x, x[:, :1]).max(axis=1)
    fixed &= ~constant
    is_code = fixed[:, None] & (column >= order[:, None])
    k = rice[:, None].astype(np.int16)
    size = np.where(is_code, (z >> k) + 1 + k, 8)
    size[~valid | constant[:, None] & (column > 0)] = 0
    ends = size.cumsum(axis=1, dtype=np.int32)
    head, head_size = _headers(number, n)
    whole_bits = 8 * head_size + 8 + ends[:, -1] + 10 * fixed
    frame_size = -(-whole_bits // 8) + 2
    begin = np.concatenate([[0], np.cumsum(frame_size)])
    buf = np.zeros(int(begin[-1]) + 2, np.float64)
    width = np.where(is_code, k + 1, 8)[size > 0].astype(np.int64)
    value = np.where(is_code, (1 << k) | (z & ((1 << k) - 1)), x & 255)[size > 0].astype(np.int64)
    base = 8 * begin[:-1] + 8 * head_size + 8
    at = (base[:, None] + ends + 10 * is_code)[size > 0] - width
    extra = base[fixed] + 8 * order[fixed] + 6  # method 0, partition order 0, then the parameter
    for where, w, v in ((at, width, value), (extra, 4, rice[fixed])):
        v = v << (16 - (where & 7) - w)
        buf += np.bincount(where >> 3, weights=v >> 8, minlength=len(buf)) + np.bincount((where >> 3) + 1, weights=v & 255, minlength=len(buf))
    buf = buf.astype(np.uint8)
    for j in range(head.shape[1]):
        has = j < head_size
        buf[begin[:-1][has] + j] = head[has, j]
    buf[begin[:-1] + head_size] = np.where(constant, 0, np.where(fixed, (8 | order) << 1, 2))
    crc = _crc16_all(buf, begin[:-1], frame_size - 2)
    buf[begin[1:] - 2], buf[begin[1:] - 1] = crc >> 8, crc & 255
    return buf[: int(begin[-1])].tobytes(), frame_size


def _stream(payload: bytes, offsets: list[int], sizes: list[int], frames: bytes) -> bytes:
    signed = payload.translate(bytes(b ^ 128 for b in range(256)))
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
    points = b"".join(struct.pack(">QQH", BLOCK * i, at, min(BLOCK, len(payload) - BLOCK * i)) for i, at in enumerate(offsets))
    return b"fLaC" + (len(info)).to_bytes(4, "big") + info + (0x83 << 24 | len(points)).to_bytes(4, "big") + points + frames


def metadata(stream: bytes) -> dict:
    """STREAMINFO fields, seek points (sample, offset, samples) and where frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, out, last = 4, {"points": []}, False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut off")
        word = int.from_bytes(stream[at : at + 4], "big")
        last, kind, size = bool(word >> 31), word >> 24 & 127, word & 0xFFFFFF
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            out["points"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    if "md5" not in out:
        raise FlacError("no STREAMINFO")
    return out | {"start": at}


def decode_batch(streams: list[bytes]) -> list[bytes]:
    """Payloads of 8-bit mono streams: those written by encode_batch in step,
    others, and any that the quick reader refuses, by decode_stream."""
    infos = [metadata(s) for s in streams]
    own = [i for i, m in enumerate(infos) if m["bits"] == 8 and m["channels"] == 1 and m["block"] == BLOCK and m["samples"] and len(m["points"]) == -(-m["samples"] // BLOCK)]
    out: list[bytes | None] = [None] * len(streams)
    if own:
        try:
            for i, payload in zip(own, _decode_own([streams[i] for i in own], [infos[i] for i in own]), strict=True):
                out[i] = payload
        except FlacError:
            if len(own) > 1:  # find the one; the others stay on the quick way
                for i in own:
                    (out[i],) = decode_batch([streams[i]])
    for i, payload in enumerate(out):
        if payload is None:
            out[i] = _unsigned(decode_stream(streams[i]))
    return out


def _decode_own(streams: list[bytes], infos: list[dict]) -> list[bytes]:
    """Payloads of streams that encode_batch wrote."""
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    begin = np.concatenate([b + m["start"] + np.array([p[1] for p in m["points"]], np.int64) for m, b in zip(infos, base, strict=False)])
    n = np.concatenate([np.array([p[2] for p in m["points"]], np.int64) for m in infos])
    counts = np.array([len(m["points"]) for m in infos])
    number = np.concatenate([np.arange(c) for c in counts])
    first = np.concatenate([[0], np.cumsum(counts)])
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:]
    end[first[1:] - 1] = base[1:]
    if (end - begin < 8).any() or (begin < 0).any() or (end > base[-1]).any() or (n < 1).any() or (n > BLOCK).any():
        raise FlacError("seek points that no frame fits")
    parts = []
    for a in range(0, len(begin), FRAMES):
        at = slice(a, a + FRAMES)
        samples = _decode_frames(buf, begin[at], end[at], number[at], n[at])
        parts.append((samples + 128).astype(np.uint8)[np.arange(BLOCK) < n[at][:, None]].tobytes())
    flat, at, out = b"".join(parts), 0, []
    for m in infos:
        out.append(flat[at : at + m["samples"]])
        at += m["samples"]
        if hashlib.md5(out[-1].translate(bytes(b ^ 128 for b in range(256)))).digest() != m["md5"]:
            raise FlacError("MD5 differs")
    return out


def read_from(stream: bytes, sample: int, count: int | None = None) -> list[np.ndarray]:
    """`count` samples (all, if None) of each channel from `sample` on: frames
    are decoded from the last seek point at or before it, those before are not
    read.  Without a seek table decoding begins at the first frame."""
    info = metadata(stream)
    ends = [x for x in (info["samples"] or None, None if count is None else sample + count) if x is not None]
    end = min(ends, default=None)
    at, offset, _ = max((p for p in info["points"] if p[0] <= sample), default=(0, 0, 0))
    bits, parts = _Bits(stream, info["start"] + offset), [[] for _ in range(info["channels"])]
    begin = at
    while bits.at < 8 * len(stream) and (end is None or at < end):
        got = _frame(bits, info)
        at += len(got[0])
        if at > sample:
            for to, x in zip(parts, got, strict=True):
                to.append(np.array(x, np.int64))
        else:
            begin = at
    stop = None if end is None else max(0, end - begin)
    return [(np.concatenate(p) if p else np.empty(0, np.int64))[sample - begin : stop] for p in parts]


def _decode_frames(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples (rows of BLOCK) of all frames."""
    head, head_size = _headers(number, n)
    for j in range(head.shape[1]):
        has = j < head_size
        if (buf[begin[has] + j] != head[has, j]).any():
            raise FlacError("a frame header or its CRC-8 differs")
    crc = _crc16_all(buf, begin, end - begin - 2)
    if ((buf[end - 2].astype(np.uint16) << 8 | buf[end - 1]) != crc).any():
        raise FlacError("a frame's CRC-16 differs")
    kind = buf[begin + head_size]
    body = begin + head_size + 1
    out = np.zeros((len(begin), BLOCK), np.int16)
    rows = np.flatnonzero(kind == 0)
    out[rows] = buf[body[rows]].view(np.int8)[:, None]
    rows = np.flatnonzero(kind == 2)
    out[rows] = buf[np.minimum(body[rows][:, None] + np.arange(BLOCK), len(buf) - 1)].view(np.int8)
    rows = np.flatnonzero((kind != 0) & (kind != 2))
    if ((kind[rows] < 16) | (kind[rows] > 20) | (kind[rows] & 1 > 0)).any():
        raise FlacError("unknown subframe")
    if len(rows):
        rows = rows[np.argsort(-n[rows], kind="stable")]
        out[rows] = _decode_fixed(buf, 8 * body[rows], (kind[rows] >> 1) & 7, n[rows], 8 * (end[rows] - 2))
    return out


def _decode_fixed(buf: np.ndarray, at: np.ndarray, order: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Samples of fixed-predictor frames, sorted by size descending, in step."""
    words = np.ndarray((len(buf) - 8,), ">u8", buf, strides=(1,))
    top = len(words) - 1

    def peek(where: np.ndarray) -> np.ndarray:
        return words[np.minimum(where >> 3, top)].astype(np.uint64) << (where & 7).astype(np.uint64)

    r = np.zeros((len(at), BLOCK), np.int32)
    for t in range(int(order.max())):
        has = t < order
        r[has, t] = (peek(at[has]) >> np.uint64(56)).astype(np.uint8).view(np.int8)
        at = at + 8 * has
    lead = (peek(at) >> np.uint64(54)).astype(np.int64)
    if (lead >> 4).any() or (lead == 15).any():
        raise FlacError("not a single Rice partition")
    at, k = at + 10, lead
    ku, mask = k.astype(np.uint64), (1 << k) - 1
    live = np.searchsorted(-n, -np.arange(BLOCK), side="left")
    late = int(order.max())
    for t in range(int(n.max())):
        m = int(live[t])
        w = peek(at[:m])
        hi = (w >> np.uint64(32)).astype(np.float64)
        exponent = (hi.view(np.int64) >> 52) - 1023
        q = 31 - exponent
        if (q > MAX_QUOTIENT).any():
            raise FlacError("a Rice quotient is too large")
        tail = (w >> (np.uint64(63) - q.astype(np.uint64) - ku[:m])).astype(np.int64) & mask[:m]
        z = q << k[:m] | tail
        value, used = (z >> 1) ^ -(z & 1), q + 1 + k[:m]
        if t < late:
            code = t >= order[:m]
            r[:m, t] = np.where(code, value, r[:m, t])
            at[:m] += np.where(code, used, 0)
        else:
            r[:m, t] = value
            at[:m] += used
    if ((at > limit) | (at <= limit - 8)).any():
        raise FlacError("a frame does not end where its codes do")
    for o in (1, 2):
        rows = order == o
        if o == 1:
            r[rows] = r[rows].cumsum(axis=1)
        else:
            x = r[rows]
            first = x[:, 1] - x[:, 0]
            d = x.copy()
            d[:, 0], d[:, 1] = 0, first
            d = d.cumsum(axis=1)
            r[rows] = x[:, :1] + np.concatenate([d[:, :1] * 0, d[:, 1:]], axis=1).cumsum(axis=1)
    return r.astype(np.int16)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at, self.at + n
        if b > 8 * len(self.data):
            raise FlacError("the stream is cut off")
        self.at = b
        return (int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big") >> (-b % 8)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


def decode_stream(stream: bytes) -> list[np.ndarray]:
    """Samples of each channel of any stream."""
    info = metadata(stream)
    bits, parts = _Bits(stream, info["start"]), [[] for _ in range(info["channels"])]
    done = 0
    while bits.at < 8 * len(stream) and (not info["samples"] or done < info["samples"]):
        got = _frame(bits, info)
        done += len(got[0])
        for to, x in zip(parts, got, strict=True):
            to.append(np.array(x, np.int64))
    channels = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
    if info["samples"] and done != info["samples"]:
        raise FlacError("samples are missing")
    width = -(-info["bits"] // 8)
    raw = np.stack(channels, axis=1).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes() if done else b""
    if any(info["md5"]) and hashlib.md5(raw).digest() != info["md5"]:
        raise FlacError("MD5 differs")
    return channels


def _frame(bits: _Bits, info: dict) -> list[list[int]]:
    start = bits.at // 8
    if bits.take(15) != 0x7FFC:
        raise FlacError("no frame sync")
    bits.take(1)
    size_code, rate_code, assignment, width_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    bits.take(8 * max(0, 8 - (lead ^ 0xFF).bit_length() - 1))
    n = {1: 192, 6: -6, 7: -7}.get(size_code, 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8) if size_code >= 8 else 0)
    n = bits.take(8) + 1 if n == -6 else bits.take(16) + 1 if n == -7 else n
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if crc8(bits.data[start : bits.at // 8]) != bits.take(8):
        raise FlacError("a header's CRC-8 differs")
    width = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(width_code)
    if width is None or assignment > 10 or not n:
        raise FlacError("reserved values in a header")
    side = {8: 1, 9: 0, 10: 1}.get(assignment)
    got = [_subframe(bits, n, width + (c == side)) for c in range(2 if side is not None else assignment + 1)]
    bits.at = -(-bits.at // 8) * 8
    if crc16(bits.data[start : bits.at // 8]) != bits.take(16):
        raise FlacError("a frame's CRC-16 differs")
    a, b = got if side is not None else (None, None)
    if assignment == 8:
        return [a, [x - y for x, y in zip(a, b, strict=True)]]
    if assignment == 9:
        return [[x + y for x, y in zip(a, b, strict=True)], b]
    if assignment == 10:
        mid = [(m << 1) | (s & 1) for m, s in zip(a, b, strict=True)]
        return [[(m + s) >> 1 for m, s in zip(mid, b, strict=True)], [(m - s) >> 1 for m, s in zip(mid, b, strict=True)]]
    return got


def _subframe(bits: _Bits, n: int, width: int) -> list[int]:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        x = [bits.signed(width)] * n
    elif kind == 1:
        x = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(width) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, n, order):
            x.append(r + (sum(c * v for c, v in zip(weights, reversed(x[-order:] if order else ()), strict=True)) >> shift))
    else:
        raise FlacError("unknown subframe")
    return [v << wasted for v in x]


def _residual(bits: _Bits, n: int, order: int) -> Iterator[int]:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1:
        raise FlacError("unknown residual coding")
    for p in range(parts):
        k = bits.take(4 + method)
        count = n // parts - (order if p == 0 else 0)
        if k == (15 if method == 0 else 31):
            raw = bits.take(5)
            yield from (bits.signed(raw) for _ in range(count))
        else:
            for _ in range(count):
                z = bits.unary() << k | bits.take(k)
                yield (z >> 1) ^ -(z & 1)


def _unsigned(channels: list[np.ndarray]) -> bytes:
    if len(channels) != 1:
        raise FlacError("not a mono stream")
    return (channels[0] + 128).astype(np.uint8).tobytes()


def padded(text: bytes | None, unit: int = UNIT) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % unit if text else unit)


def feature(payload: bytes) -> str:
    """Blocks, level, zero crossings and energy envelope of read-back samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    sums = np.add.reduceat(x.astype(np.int64) ** 2, np.arange(0, len(x), BLOCK))
    rms = np.sqrt(int(sums.sum()) / len(x))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={len(sums)};rms={rms:.4f};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};peak={int(np.abs(x).max())};crossings={crossings};loudest={int(sums.argmax())}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stream of each text's padded UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE):
            texts = texts_of(batch)
            media = encode_batch([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, block, sample_offset, samples, pcm): the decoded blocks of each
    stream with the sample at which each begins.  Null media has no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            held = [(i, m) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if m is not None]
            rows = []
            for (i, _), pcm in zip(held, decode_batch([m for _, m in held]), strict=True):
                rows += [(i, a // BLOCK, a, len(pcm[a : a + BLOCK]), pcm[a : a + BLOCK]) for a in range(0, len(pcm), BLOCK)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["doc_id", "block", "sample_offset", "samples", "pcm"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, block int, sample_offset long, samples int, pcm binary")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Checksums of what is stored and of what is read back, in one pass."""
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, max_bytes=SLICE):
            texts = texts_of(batch)
            media = encode_batch([padded(t) for t in texts])
            back = decode_batch(media)
            columns = [[len(t or b"") for t in texts], list(map(len, back)), list(map(sha, back)), [zlib.crc32(p[-UNIT:]) for p in back], list(map(len, media)), list(map(sha, media)), list(map(feature, back))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=names)

    kinds = "long long long string long long string string".split()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
