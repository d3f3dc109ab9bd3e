"""FLAC streams of 8-bit mono samples, many frames at a time.

The encoder writes frames of 192 samples: constant, verbatim, fixed-predictor (orders 0-4) or linear-predictor (order 2)
subframes, whichever is shortest, with Rice-coded residuals, and a seek point for each frame. The decoder verifies the
headers' CRC-8 and the frames' CRC-16 and the stream's MD5; it follows the seek points, so the frames of all streams of a
block decode in step: sample i of every frame at once. Streams without a point for each frame, and odd frames (other block
sizes, long unary runs, escaped or split partitions), take a plain decoder, sample by sample.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

BLOCK = 192
RATE = 8000
_HEAD = 42  # marker, one block header, STREAMINFO


class Corrupt(ValueError):
    """A checksum or a field of the stream is wrong."""


@lru_cache
def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint16)


def crc(rows: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 (polynomial 7) or CRC-16 (polynomial 0x8005) of the first ``lengths`` bytes of each row."""
    table = _crc_table(bits, 7 if bits == 8 else 0x8005)
    order = np.argsort(-lengths, kind="stable")
    columns = np.ascontiguousarray(rows[order].T)
    n = np.searchsorted(-lengths[order], -np.arange(1, rows.shape[1] + 1), "right")
    out = np.zeros(len(rows), np.uint16)
    for j in range(int(lengths.max(initial=0))):
        c = out[: n[j]]
        if bits == 8:
            out[: n[j]] = table[c ^ columns[j, : n[j]]]
        else:
            out[: n[j]] = (c << 8) ^ table[(c >> 8) ^ columns[j, : n[j]]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    head = (0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1)
    return bytes([head, *(0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1))])


@lru_cache(1 << 14)
def _header(n: int) -> bytes:
    head = b"\xff\xf8\x14\x02" + _number(n)
    c = 0
    for b in head:
        c = int(_crc_table(8, 7)[c ^ b])
    return head + bytes([c])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best parameter of each row and its bits."""
    n = u.shape[1]
    mean = u.sum(axis=1) / n
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 12).astype(np.int32)
    best, bits = guess, np.full(len(u), 1 << 40, np.int64)
    for k in (np.maximum(guess - 1, 0), guess, guess + 1):
        cost = (u >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (k + 1)
        best, bits = np.where(cost < bits, k, best), np.minimum(cost, bits)
    return best, bits


def _predictor(x: np.ndarray) -> np.ndarray:
    """Quantised order-2 coefficients (times 32) of each row, by least squares."""
    a, b, y = (v.astype(np.float64) for v in (x[:, 1:-1], x[:, :-2], x[:, 2:]))
    aa, ab, bb, ay, by = (np.einsum("ij,ij->i", p, q) for p, q in ((a, a), (a, b), (b, b), (a, y), (b, y)))
    det = aa * bb - ab * ab
    det = np.where(np.abs(det) < 1e-9, 1, det)
    return np.clip(np.rint(np.stack([(ay * bb - by * ab) / det, (by * aa - ay * ab) / det], 1) * 32), -64, 63).astype(np.int32)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the rows of ``x`` (int32, BLOCK wide): bytes one after another, and lengths."""
    m = len(x)
    kinds, residuals = [], []
    r = x
    for order in range(5):
        kinds.append(order)
        residuals.append(r)
        r = r[:, 1:] - r[:, :-1]
    cost = np.stack([np.abs(r).sum(axis=1) + (5 * i) for i, r in enumerate(residuals)])
    order = cost.argmin(axis=0)
    coef = _predictor(x)
    linear = x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> 5)
    lpc = np.abs(linear).sum(axis=1) + 30 < cost.min(axis=0)
    order = np.where(lpc, 2, order)
    u = np.zeros((m, BLOCK), np.int32)
    for p in range(5):
        rows = np.flatnonzero((order == p) & ~lpc)
        u[rows, p:] = _zigzag(residuals[p][rows])
    rows = np.flatnonzero(lpc)
    u[rows, 2:] = _zigzag(linear[rows])
    k, _ = _rice(u)  # the warm-up counts as zeros: it only sways the guess
    q = u >> k[:, None]
    used = np.arange(BLOCK) >= order[:, None]
    size = np.where(used, q + 1 + k[:, None], 0)
    warm = np.where(lpc, 16 + 4 + 5 + 14, 8 * order)
    bits = 8 + warm + 10 + size.sum(axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits >= 8 + 8 * BLOCK)
    bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, bits))
    heads = [_header(int(i)) for i in numbers]
    head_size = np.array([len(h) for h in heads])
    body = (bits + 7) // 8
    length = head_size + body + 2
    ends = np.cumsum(length)
    starts = ends - length
    out = np.zeros(int(ends[-1]) * 8, np.uint8)  # bits
    base = (starts + head_size) * 8

    def put(rows: np.ndarray, at, values, width: int) -> None:
        shifts = np.arange(width - 1, -1, -1)
        values = np.asarray(values)[..., None] >> shifts & 1
        out[(np.asarray(at)[..., None] + np.arange(width)).reshape(-1)] = values.reshape(-1)

    every = np.arange(m)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + 1, 8 + order)))
    put(every, base, kind << 1, 8)
    put(np.flatnonzero(constant), base[constant] + 8, x[constant, 0] & 255, 8)
    rows = np.flatnonzero(verbatim)
    put(rows, base[rows, None] + 8 + 8 * np.arange(BLOCK), x[rows] & 255, 8)
    coded = ~constant & ~verbatim
    for p in range(1, 5):
        rows = np.flatnonzero(coded & (order == p))
        put(rows, base[rows, None] + 8 + 8 * np.arange(p), x[rows, :p] & 255, 8)
    rows = np.flatnonzero(coded & lpc)
    put(rows, base[rows] + 24, np.full(len(rows), 6), 4)  # precision 7
    put(rows, base[rows] + 28, np.full(len(rows), 5), 5)  # shift
    put(rows, base[rows, None] + 33 + 7 * np.arange(2), coef[rows] & 127, 7)
    rest = base + 8 + warm
    rows = np.flatnonzero(coded)
    put(rows, rest[rows] + 6, k[rows], 4)
    at = rest[:, None] + 10 + np.cumsum(size, axis=1) - size + q
    for v in np.unique(k[rows]).tolist():
        pick = used & (coded & (k == v))[:, None]
        put(rows, at[pick], (1 << v) | (u[pick] & ((1 << v) - 1)), v + 1)
    got = np.packbits(out)
    for i, h in enumerate(heads):
        got[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc(_rows(got, starts, length - 2), length - 2, 16)
    got[ends - 2] = sums >> 8
    got[ends - 1] = sums & 255
    return got, length


def _rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(int(lengths.max(initial=0)))
    return data[np.minimum(at, len(data) - 1)]


def encode(samples: list[np.ndarray]) -> list[bytes]:
    """A stream for each array of int8 samples, whose length is a positive multiple of BLOCK."""
    counts = np.array([len(s) // BLOCK for s in samples])
    if not len(counts):
        return []
    numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    data, length = encode_frames(np.concatenate(samples).astype(np.int32).reshape(-1, BLOCK), numbers)
    out, frame, at = [], 0, 0
    ends = np.cumsum(length)
    for s, n in zip(samples, counts.tolist(), strict=True):
        own = length[frame : frame + n]
        stop = int(ends[frame + n - 1])
        points = np.zeros(n, [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        points["s"], points["o"], points["n"] = np.arange(n) * BLOCK, np.cumsum(own) - own, BLOCK
        info = BLOCK.to_bytes(2) * 2 + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + (RATE << 44 | 7 << 36 | len(s)).to_bytes(8) + hashlib.md5(s.tobytes(), usedforsecurity=False).digest()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + (18 * n).to_bytes(3) + points.tobytes() + data[at:stop].tobytes())
        frame, at = frame + n, stop
    return out


def _first_one() -> np.ndarray:
    out = np.full(1 << 16, 16, np.uint8)
    for z in range(15, -1, -1):
        out[1 << (15 - z) : 2 << (15 - z)] = z
    return out


_ZEROS = _first_one()


class _Bits:
    """Plain reading of one frame."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at // 8, (self.at + n + 7) // 8
        if b > len(self.data):
            raise Corrupt("the stream ends early")
        v = int.from_bytes(self.data[a:b]) >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_frame(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Samples of the frame that starts at byte ``at``, and where the next one starts."""
    b = _Bits(data, at)
    if b.take(15) != 0x7FFC:
        raise Corrupt("no frame here")
    b.take(1)
    size, rate, channel, depth, zero = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
    if channel or depth not in (0, 1) or zero:
        raise Corrupt("not 8-bit mono")
    first = b.take(8)
    for _ in range(max(0, 8 - (~first & 0xFF).bit_length() - 1) if first >= 0xC0 else 0):
        b.take(8)
    n = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
    if rate in (12, 13, 14):
        b.take(8 if rate == 12 else 16)
    head = np.frombuffer(data[at : b.at // 8], np.uint8)[None]
    if int(crc(head, np.array([head.shape[1]]), 8)[0]) != b.take(8):
        raise Corrupt("header checksum")
    b.take(1)
    kind = b.take(6)
    wasted = 1 + b.unary() if b.take(1) else 0
    depth = 8 - wasted
    if kind == 0:
        x = [b.signed(depth)] * n
    elif kind == 1:
        x = [b.signed(depth) for _ in range(n)]
    else:
        order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
        if order < 0:
            raise Corrupt("reserved subframe")
        x = [b.signed(depth) for _ in range(order)]
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            coefs = [b.signed(precision) for _ in range(order)]
        else:
            shift, coefs = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        wide = 4 + b.take(2)
        parts = b.take(4)
        for part in range(1 << parts):
            count = (n >> parts) - (order if part == 0 else 0)
            k = b.take(wide)
            raw = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range(count):
                if raw is not None:
                    v = b.signed(raw) if raw else 0
                else:
                    q = b.unary()
                    v = q << k | (b.take(k) if k else 0)
                    v = v >> 1 ^ -(v & 1)
                x.append(v + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
    end = (b.at + 7) // 8
    body = np.frombuffer(data[at:end], np.uint8)[None]
    b.at = end * 8
    if int(crc(body, np.array([body.shape[1]]), 16)[0]) != b.take(16):
        raise Corrupt("frame checksum")
    return np.array(x, np.int32) << wasted, end + 2


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples (frames x BLOCK) of frames with known places; checksums are verified."""
    m = len(starts)
    length = ends - starts
    rows = _rows(data, starts, length)
    if (crc(rows, length, 16) != 0).any():  # over the frame with its checksum
        raise Corrupt("frame checksum")
    lead = rows[:, 4].astype(np.int64)
    extra = np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, 5)))))
    head = 6 + extra
    if (crc(rows[:, :12], head, 8) != 0).any():
        raise Corrupt("header checksum")
    odd = (rows[:, 0] != 0xFF) | (rows[:, 1] != 0xF8) | (rows[:, 2] != 0x14) | (rows[:, 3] != 0x02)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(len(data) + 8, np.uint64)  # the 8 bytes at each place
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(word)]

    def read(rows: np.ndarray, at: np.ndarray, n: int, signed: bool = False) -> np.ndarray:
        v = ((word[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(64 - n)).astype(np.int64)
        return np.where(v >> (n - 1) & 1, v - (1 << n), v) if signed else v

    base = (starts + head) * 8
    every = np.arange(m)
    kind = read(every, base, 8) >> 1
    odd |= read(every, base, 8) & 1 == 1
    x = np.zeros((m, BLOCK), np.int32)
    rows = np.flatnonzero(~odd & (kind == 0))
    x[rows] = read(rows, base[rows] + 8, 8, True)[:, None]
    rows = np.flatnonzero(~odd & (kind == 1))
    x[rows] = data[((base[rows] >> 3) + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    lpc = kind == 33
    odd |= ~((kind <= 1) | (kind >= 8) & (kind <= 12) | lpc)
    order = np.where(lpc, 2, kind - 8)
    coded = np.flatnonzero(~odd & (kind > 1))
    if len(coded):
        order, at, linear = order[coded], base[coded] + 8, lpc[coded]
        r = np.zeros((BLOCK, len(coded)), np.int32)
        for j in range(4):
            rows = np.flatnonzero(order > j)
            r[j, rows] = read(rows, at[rows] + 8 * j, 8, True)
        at = at + 8 * order
        coef = np.zeros((2, len(coded)), np.int64)
        rows = np.flatnonzero(linear)
        strange = np.zeros(len(coded), bool)
        strange[rows] = read(rows, at[rows], 9) != (6 << 5 | 5)
        for j in range(2):
            coef[j, rows] = read(rows, at[rows] + 9 + 7 * j, 7, True)
        at = at + np.where(linear, 23, 0)
        split = read(coded, at, 6)
        k = read(coded, at + 6, 4)
        strange |= (split != 0) | (k == 15)
        pos, ku = at + 10, k.astype(np.uint64)
        limit = len(word) - 1
        for i in range(BLOCK):
            w = word[np.minimum(pos >> 3, limit)] << (pos & 7).astype(np.uint64)
            q = _ZEROS[w >> np.uint64(48)].astype(np.int64)
            if (q == 16).any():
                q += np.where(q == 16, _ZEROS[(w >> np.uint64(32)) & np.uint64(0xFFFF)], 0)
            low = ((w << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (np.uint64(63) - ku)
            u = (q << k | low.astype(np.int64)).astype(np.int32)
            on = i >= order
            strange |= on & ((q >= 32) | (q + 1 + k > 56))
            r[i] = np.where(on, (u >> 1) ^ -(u & 1), r[i])
            pos = pos + np.where(on, q + 1 + k, 0)
        for p in range(1, 5):
            rows = np.flatnonzero((order == p) & ~linear)
            if len(rows):
                y = r[:, rows].astype(np.int64)
                seeds = [y[:p]]
                for _ in range(p - 1):
                    seeds.append(seeds[-1][1:] - seeds[-1][:-1])
                run = y[p:]
                for s in range(p - 1, -1, -1):
                    run = seeds[s][-1] + np.cumsum(run, axis=0)
                r[p:, rows] = run
        rows = np.flatnonzero(linear)
        if len(rows):
            y, c = r[:, rows].astype(np.int64), coef[:, rows]
            for i in range(2, BLOCK):
                y[i] += (c[0] * y[i - 1] + c[1] * y[i - 2]) >> 5
            r[:, rows] = y
        x[coded] = r.T
        odd[coded[strange]] = True
    for i in np.flatnonzero(odd).tolist():
        got, _ = plain_frame(data[starts[i] : ends[i]].tobytes(), 0)
        if len(got) != BLOCK:
            raise Corrupt("block size")
        x[i] = got
    return x


def _parts(stream: bytes) -> tuple[int, bytes, bytes, int]:
    """Samples, MD5, seek table and where the frames start."""
    if stream[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, last, table, info = 4, False, b"", b""
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        info, table = (body if kind == 0 else info), (body if kind == 3 else table)
        at += 4 + size
    if len(info) != 34:
        raise Corrupt("no stream information")
    return int.from_bytes(info[10:18]) & ((1 << 36) - 1), info[18:34], table, at


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The int8 samples of each stream."""
    fields = [_parts(s) for s in streams]
    out: list[np.ndarray | None] = [None] * len(streams)
    starts, ends, which, at = [], [], [], 0
    for i, (s, (n, _, table, first)) in enumerate(zip(streams, fields, strict=True)):
        points = np.frombuffer(table, [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        if n and len(points) * BLOCK == n and (points["n"] == BLOCK).all() and (points["s"] == np.arange(len(points)) * BLOCK).all():
            a = points["o"].astype(np.int64) + first
            starts.append(a + at)
            ends.append(np.append(a[1:], len(s)) + at)
            which.append((i, len(points)))
        else:
            parts, place = [], first
            while place < len(s):
                got, place = plain_frame(s, place)
                parts.append(got)
            out[i] = np.concatenate(parts).astype(np.int8) if parts else np.zeros(0, np.int8)
        at += len(s)
    if which:
        x = decode_frames(np.frombuffer(b"".join(streams), np.uint8), np.concatenate(starts), np.concatenate(ends)).astype(np.int8)
        frame = 0
        for i, n in which:
            out[i] = x[frame : frame + n].ravel()
            frame += n
    for x, (n, md5, _, _) in zip(out, fields, strict=True):
        if len(x) != n or hashlib.md5(x.tobytes(), usedforsecurity=False).digest() != md5:
            raise Corrupt("the stream's checksum")
    return out
