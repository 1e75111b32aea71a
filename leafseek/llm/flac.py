"""FLAC streams on numpy arrays: many frames are coded or decoded side by side.

The decoder reads constant, verbatim, fixed and linear-prediction subframes, Rice
residuals of both kinds with partitions and escapes, wasted bits, and all channel
assignments of mono and stereo; it verifies the header and frame checksums and
the stream's MD5. The encoder writes mono streams of one block size with a seek
table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from . import bits

#: Samples of a block the encoder writes, and frames between two seek points.
BLOCK, SEEK_FRAMES = 576, 4
#: Orders of fixed predictors that the encoder tries; order and coefficient bits of its linear predictor.
ENCODED = (1,)
ORDER, PRECISION = 4, 12
#: Frames coded or seek points decoded side by side.
SIDE_BY_SIDE = 4096
# Fixed values of the format.
SYNC = 0xFFF8
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
BLOCK_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
SAMPLE_BITS = [0, 8, 12, 0, 16, 20, 24, 32]


class DamagedStream(ValueError):
    """A stream that is cut short, malformed or fails a checksum."""


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, table << 1 ^ polynomial, table << 1) & ((1 << width) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Checksums of the stretches of ``data``; zeros before a stretch leave a sum that starts at zero alone."""
    crc = np.zeros(len(starts), np.uint32)
    most = int((ends - starts).max(initial=0))
    for k in range(most, 0, -1):
        at = ends - k
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0)
        crc = (crc << 8 ^ table[(crc >> (width - 8)) ^ byte]) & ((1 << width) - 1)
    return crc


# ---- encoding


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized coefficients and shifts of the linear predictor of each row, by Levinson-Durbin."""
    n = x.shape[1]
    windowed = x * (1 - ((np.arange(n) - (n - 1) / 2) / ((n + 1) / 2)) ** 2)
    r = np.stack([np.einsum("ij,ij->i", windowed[:, lag:], windowed[:, : n - lag]) for lag in range(ORDER + 1)])
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((ORDER, len(x)))
    for i in range(ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.frexp(np.abs(a).max(0) + 1e-12)[1]
    shift = np.clip(PRECISION - 1 - top, 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -limit, limit).astype(np.int32), shift.astype(np.int32)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values of rows of residuals, the Rice parameter of each row, and its bits."""
    folded = (residual << 1 ^ residual >> 31).astype(np.uint32)
    mean = folded.mean(1, dtype=np.float64)
    best_k = np.clip(np.frexp(np.maximum(mean * np.log(2), 1e-9))[1], 0, 14).astype(np.uint32)
    best = np.full(len(folded), np.iinfo(np.int64).max)
    out = best_k.copy()
    for d in (-1, 0):
        k = np.maximum(best_k.astype(np.int64) + d, 0).astype(np.uint32)
        cost = (folded >> k[:, None]).sum(1, dtype=np.int64) + folded.shape[1] * (k.astype(np.int64) + 1)
        out, best = np.where(cost < best, k, out), np.minimum(cost, best)
    return folded, out, best


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame numbers' coded bytes in 6 columns, and their widths in bits (0: none)."""
    n = numbers.astype(np.int64)
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26], [1, 2, 3, 4, 5], 6)
    column = np.arange(6)
    shift = 6 * (size[:, None] - 1 - column)
    lead = np.where(size == 1, 0, (0xFF << (8 - size)) & 0xFF)
    value = np.where(column == 0, lead[:, None] | n[:, None] >> np.maximum(shift, 0), 0x80 | (n[:, None] >> np.maximum(shift, 0) & 0x3F))
    there = column < size[:, None]
    return np.where(there, value, 0), there * 8


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of rows of 8-bit samples (int32, BLOCK columns)."""
    n = x.shape[1]
    flat = (x == x[:, :1]).all(1)
    plans = {order: x[:, order:] - sum((c * x[:, order - 1 - j : n - 1 - j] for j, c in enumerate(cs)), np.zeros((1, 1), np.int32)) for order, cs in FIXED.items() if order in ENCODED}
    coefs, shift = _predictors(x)
    plans["lpc"] = x[:, ORDER:] - (sum(coefs[j][:, None] * x[:, ORDER - 1 - j : n - 1 - j] for j in range(ORDER)) >> shift[:, None])
    coded = {k: _rice(v) for k, v in plans.items()}
    extra = {k: 8 * k for k in plans if k != "lpc"} | {"lpc": 8 * ORDER + 9 + ORDER * PRECISION}
    names = [*plans]
    cost = np.stack([coded[k][2] + extra[k] + 18 for k in names] + [np.full(len(x), 8 * n), np.where(flat, 0, 1 << 40)])
    choice = cost.argmin(0)
    frames: list[bytes] = [b""] * len(x)
    for c in np.unique(choice):
        rows = np.flatnonzero(choice == c)
        own, fields = x[rows], []

        def put(value, width, fields=fields, m=len(rows)):
            fields.append((np.broadcast_to(np.asarray(value, np.int64).reshape(-1, 1) if np.ndim(value) < 2 else value, (m, 1 if np.ndim(value) < 2 else value.shape[1])), np.broadcast_to(np.asarray(width, np.int64).reshape(-1, 1) if np.ndim(width) < 2 else width, (m, 1 if np.ndim(value) < 2 else value.shape[1]))))

        head = np.array([SYNC >> 8, SYNC & 255, BLOCK_SIZES.index(BLOCK) << 4 | 4, SAMPLE_BITS.index(8) << 1])
        number, number_bits = _number_bytes(numbers[rows])
        crc = np.zeros(len(rows), np.uint32)
        for value in head:
            crc = _CRC8[crc ^ value]
        for j in range(6):
            crc = np.where(number_bits[:, j] > 0, _CRC8[crc ^ number[:, j]], crc)
        for value in head:
            put(int(value), 8)
        put(number, number_bits)
        put(crc, 8)
        if c < len(names):
            name = names[c]
            order = ORDER if name == "lpc" else name
            put((32 + ORDER - 1 if name == "lpc" else 8 + order) << 1, 8)
            if order:
                put(own[:, :order].astype(np.int64) & 255, np.full((1, order), 8))
            if name == "lpc":
                put(PRECISION - 1, 4)
                put(shift[rows], 5)
                for j in range(ORDER):
                    put(coefs[j][rows].astype(np.int64) & (1 << PRECISION) - 1, PRECISION)
            folded, k, _ = coded[name]
            folded, k = folded[rows], k[rows].astype(np.int64)
            put(0, 6)  # 4-bit parameters, one partition
            put(k, 4)
            low = folded & ((1 << k) - 1).astype(np.uint32)[:, None]
            fields.append((low.astype(np.int64) | (1 << k)[:, None], (folded >> k.astype(np.uint32)[:, None]).astype(np.int64) + 1 + k[:, None]))
            shown = k + 1
        elif c == len(names):
            put(1 << 1, 8)
            put(own.astype(np.int64) & 255, np.full((1, n), 8))
            shown = None
        else:
            put(0, 8)
            put(own[:, 0].astype(np.int64) & 255, 8)
            shown = None
        values, widths = np.concatenate([f[0] for f in fields], 1), np.concatenate([f[1] for f in fields], 1)
        ends = np.cumsum(widths, 1)
        size = (ends[:, -1] + 7) // 8
        base = np.cumsum(size) - size
        kept = widths.copy()
        if shown is not None:  # the zeros of a unary part need no writing
            m = fields[-1][0].shape[1]
            kept[:, -m:] = shown[:, None]
        data = bits.pack((ends - kept + 8 * base[:, None]).ravel(), values.ravel(), kept.ravel(), 8 * int(size.sum()))
        crc = _crc(data, base, base + size, _CRC16, 16)
        whole = data.tobytes()
        for i, row in enumerate(rows):
            frames[row] = whole[base[i] : base[i] + size[i]] + int(crc[i]).to_bytes(2, "big")
    return frames


def encode_streams(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """A mono 8-bit stream of each payload, whose bytes are unsigned samples; lengths are multiples of BLOCK."""
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    frames: list[bytes] = []
    for at in range(0, len(joined), SIDE_BY_SIDE):
        frames += encode_frames(joined[at : at + SIDE_BY_SIDE].astype(np.int32) - 128, numbers[at : at + SIDE_BY_SIDE])
    out, at = [], 0
    for payload, count in zip(payloads, counts, strict=True):
        own = frames[at : at + count]
        at += count
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, offset = [], 0
        for i, size in enumerate(sizes):
            if i % SEEK_FRAMES == 0:
                points.append((i * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + BLOCK.to_bytes(2, "big"))
            offset += size
        points = points[: (1 << 24) // 18 - 1]
        table = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


# ---- decoding


@dataclass
class Info:
    channels: int
    sample_bits: int
    total: int
    md5: bytes
    first_frame: int
    points: list[tuple[int, int]]


def read_info(stream: bytes) -> Info:
    """The stream's description and its seek points (first sample, place of the frame)."""
    if stream[:4] != b"fLaC":
        raise DamagedStream("no FLAC stream")
    at, info, points, last = 4, None, [], False
    while not last:
        if at + 4 > len(stream):
            raise DamagedStream("the stream ends in its description")
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(body) == 34:
            packed = int.from_bytes(body[10:18], "big")
            info = Info((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:], 0, [])
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, len(body) - 17, 18)]
    if info is None or info.channels > 2:
        raise DamagedStream("no description of one or two channels")
    info.first_frame = at
    info.points = [(sample, at + place) for sample, place in points if sample != (1 << 64) - 1] or [(0, at)]
    return info


class _Reader:
    """Bit positions of many lanes in one buffer."""

    def __init__(self, data: np.ndarray):
        self.window, self.end = bits.windows(data), 8 * len(data)

    def peek(self, p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, self.end)
        return self.window[p >> 3] << (p & 7).astype(np.uint64)

    def read(self, p: np.ndarray, width) -> np.ndarray:
        """Unsigned values of ``width`` bits, 32 at most; 0 bits give 0."""
        return (self.peek(p) >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(self, p: np.ndarray, width) -> np.ndarray:
        value, half = self.read(p, width), np.int64(1) << np.maximum(np.asarray(width, np.int64) - 1, 0)
        return np.where(np.asarray(width) > 0, (value ^ half) - half, 0)

    def rice(self, p: np.ndarray, k: np.ndarray, out: np.ndarray) -> None:
        """Zigzag values of Rice codes with parameters under 31; ``p`` moves on."""
        x = self.window.take(p >> 3) << (p & 7).view(np.uint64)
        q = _LEADING.take((x >> np.uint64(48)).view(np.int64))
        if (q == 16).any() or (k > 30).any():
            q = self.zeros(p)
            out[:] = q << k | self.read(p + q + 1, k)
            p += q + 1 + k
            return
        q1 = q + 1
        low = x << q1.view(np.uint64) >> np.uint64(1) >> (63 - k).view(np.uint64)
        np.bitwise_or(q << k, low.view(np.int64), out=out)
        p += q1
        p += k

    def zeros(self, p: np.ndarray) -> np.ndarray:
        """Zero bits before the next one."""
        x = self.peek(p)
        found = _LEADING[x >> np.uint64(48)]
        more = np.flatnonzero(found == 16)
        count = 16
        while len(more):
            if ((p[more] + count) >= self.end).any():
                raise DamagedStream("a unary code does not end")
            next_ = _LEADING[self.peek(p[more] + count) >> np.uint64(48)]
            found[more] += next_
            more, count = more[next_ == 16], count + 16
        return found


_LEADING = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _residuals(reader: _Reader, p: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Residuals (n, lanes) of lanes, each from its predictor's order on; ``p`` moves on."""
    wide = reader.read(p, 2)
    if (wide > 1).any():
        raise DamagedStream("unknown residual coding")
    size = n >> reader.read(p + 2, 4)
    p += 6
    width = 4 + wide
    sizes = np.unique(size)
    if (size < np.maximum(order, 1)).any():
        raise DamagedStream("a partition is too short")
    out = np.zeros((n, len(p)), np.int64)
    k, raw, escapes = np.zeros(len(p), np.int64), np.full(len(p), -1, np.int64), False
    begun, least, all_begun = np.zeros(len(p), bool), int(order.min(initial=n)), False
    for i in range(least, n):
        if not all_begun or (i % sizes == 0).any():
            at = np.flatnonzero((order == i) | ((i % size == 0) & (i > order)))
            if len(at):
                k[at] = reader.read(p[at], width[at])
                p[at] += width[at]
                begun[at] = True
                escaped = k[at] == (1 << width[at]) - 1
                raw[at] = -1
                if escaped.any():
                    own = at[escaped]
                    raw[own] = reader.read(p[own], 5)
                    p[own] += 5
                escapes, all_begun = bool((raw >= 0).any()), bool(begun.all())
        if escapes or not all_begun:
            own, plain = np.flatnonzero(begun & (raw >= 0)), np.flatnonzero(begun & (raw < 0))
            value = reader.signed(p[own], raw[own])
            out[i, own] = value << 1 ^ value >> 63
            p[own] += raw[own]
            q = reader.zeros(p[plain])
            out[i, plain] = q << k[plain] | reader.read(p[plain] + q + 1, k[plain])
            p[plain] += q + 1 + k[plain]
        else:
            reader.rice(p, k, out[i])
    return out >> 1 ^ -(out & 1)


def _restored(x: np.ndarray, order: int, coefs: list | None, shift) -> None:
    """Turn residuals behind warm-up samples into samples, in place."""
    if coefs is None:  # the residual of a fixed predictor is the difference of that order
        run = x[order:]
        for j in range(order, 0, -1):
            begin = np.diff(x[:order], n=j - 1, axis=0)[-1]
            run = np.cumsum(np.concatenate([begin[None], run]), axis=0)[1:]
        x[order:] = run
        return
    for i in range(order, len(x)):
        total = coefs[0] * x[i - 1]
        for j in range(1, order):
            total += coefs[j] * x[i - 1 - j]
        x[i] += total >> shift


def _subframe(reader: _Reader, p: np.ndarray, n: int, sample_bits: np.ndarray) -> np.ndarray:
    """Samples (n, lanes) of one channel of each lane; ``p`` moves on."""
    out = np.zeros((n, len(p)), np.int64)
    kind, wasted = reader.read(p, 8), np.zeros(len(p), np.int64)
    p += 8
    if (kind & 128).any():
        raise DamagedStream("a subframe begins with a one")
    if (kind & 1).any():
        at = np.flatnonzero(kind & 1)
        wasted[at] = reader.zeros(p[at]) + 1
        p[at] += wasted[at]
    width = sample_bits - wasted
    kind = kind >> 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise DamagedStream("unknown subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if (order > n).any():
        raise DamagedStream("more warm-up samples than samples")
    for t in (0, 1):
        at = np.flatnonzero(kind == t)
        for i in range(n if t else min(1, len(at))):
            out[i if t else slice(None), at] = reader.signed(p[at], width[at])
            p[at] += width[at]
    for i in range(int(order.max(initial=0))):
        at = np.flatnonzero(order > i)
        out[i, at] = reader.signed(p[at], width[at])
        p[at] += width[at]
    coefs, shift = np.zeros((32, len(p)), np.int64), np.zeros(len(p), np.int64)
    if len(at := np.flatnonzero(linear)):
        precision = reader.read(p[at], 4) + 1
        shift[at] = reader.signed(p[at] + 4, np.full(len(at), 5))
        if (precision == 16).any() or (shift < 0).any():
            raise DamagedStream("unknown predictor")
        p[at] += 9
        for j in range(int(order[at].max())):
            more = order[at] > j
            own = at[more]
            coefs[j, own] = reader.signed(p[own], precision[more])
            p[own] += precision[more]
    coded = np.flatnonzero(fixed | linear)
    if len(coded):
        q = p[coded]
        residual = _residuals(reader, q, order[coded], n)
        p[coded] = q
        for o, t in {*zip(order[coded].tolist(), linear[coded].tolist(), strict=True)}:
            own = np.flatnonzero((order[coded] == o) & (linear[coded] == t))
            x = residual[:, own]
            at = coded[own]
            x[:o] = out[:o, at]
            if o:
                _restored(x, o, [coefs[j, at] for j in range(o)] if t else None, shift[at])
            out[:, at] = x
    return out << wasted


def _frames(data: np.ndarray, reader: _Reader, starts: np.ndarray, info_bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (n, channels) of the frame at each start, and where it ends."""
    byte = lambda at: data[np.minimum(at, len(data) - 1)].astype(np.int64)
    head = [byte(starts + i) for i in range(5)]
    if ((head[0] << 8 | head[1]) & 0xFFFE != SYNC).any():
        raise DamagedStream("no frame where one was expected")
    code, rate, channel, depth = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    ones = np.select([head[4] < 128, head[4] < 0xE0, head[4] < 0xF0, head[4] < 0xF8, head[4] < 0xFC, head[4] < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = starts + 4 + ones
    n = np.array(BLOCK_SIZES)[code]
    n = np.where(code == 6, byte(at) + 1, np.where(code == 7, (byte(at) << 8 | byte(at + 1)) + 1, n))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    at = at + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    if (byte(at) != _crc(data, starts, at, _CRC8, 8)).any():
        raise DamagedStream("wrong header checksum")
    width = np.where(depth == 0, info_bits, np.array(SAMPLE_BITS)[depth])
    if (n == 0).any() or (channel > 10).any() or ((channel > 1) & (channel < 8)).any():
        raise DamagedStream("unknown frame header")
    position, out = 8 * (at + 1), [None] * len(starts)
    for size, kind in {*zip(n.tolist(), channel.tolist(), strict=True)}:
        own = np.flatnonzero((n == size) & (channel == kind))
        p, w = position[own], width[own]
        a = _subframe(reader, p, size, w + (kind == 9))
        if kind:
            b = _subframe(reader, p, size, w + (kind in (8, 10)))
            if kind == 8:
                a, b = a, a - b
            elif kind == 9:
                a, b = a + b, b
            elif kind == 10:
                mid = a << 1 | b & 1
                a, b = mid + b >> 1, mid - b >> 1
        position[own] = p
        for i, lane in enumerate(own):
            out[lane] = np.stack([a[:, i], b[:, i]], 1) if kind else a[:, i : i + 1]
    ends = (position + 7) // 8
    if (ends + 2 > len(data)).any() or (byte(ends) << 8 | byte(ends + 1) != _crc(data, starts, ends, _CRC16, 16)).any():
        raise DamagedStream("wrong frame checksum")
    return out, ends + 2


def _decode(streams: list[bytes]) -> list[list[np.ndarray]]:
    """Blocks of samples of each stream; all stretches between seek points run side by side."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    reader = _Reader(data)
    infos, base, lanes = [], 0, []
    for s, stream in enumerate(streams):
        info = read_info(stream)
        infos.append(info)
        limits = [place for _, place in info.points[1:]] + [len(stream)]
        lanes += [(s, base + a, base + b) for (_, a), b in zip(info.points, limits, strict=True)]
        base += len(stream)
    stream_of = np.array([x[0] for x in lanes])
    at, limit = np.array([x[1] for x in lanes], np.int64), np.array([x[2] for x in lanes], np.int64)
    found: list[list[np.ndarray]] = [[] for _ in lanes]
    depth = np.array([i.sample_bits for i in infos])
    left = np.flatnonzero(at < limit)
    while len(left):
        for i in range(0, len(left), SIDE_BY_SIDE):
            some = left[i : i + SIDE_BY_SIDE]
            blocks, ends = _frames(data, reader, at[some], depth[stream_of[some]])
            at[some] = ends
            for lane, block in zip(some, blocks, strict=True):
                found[lane].append(block)
        if (at > limit).any():
            raise DamagedStream("a frame goes beyond its seek point or its stream")
        left = left[at[left] < limit[left]]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for s, own in zip(stream_of, found, strict=True):
        out[s] += own
    for info, own in zip(infos, out, strict=True):
        if info.total and sum(len(x) for x in own) != info.total:
            raise DamagedStream("samples are missing")
        size = (info.sample_bits + 7) // 8
        digest = hashlib.md5()
        for x in own:
            digest.update(x.astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
        if any(info.md5) and digest.digest() != info.md5:
            raise DamagedStream("wrong MD5")
    return out


def decode_streams(streams: list[bytes]) -> list[list[np.ndarray] | DamagedStream]:
    """Blocks of samples (samples, channels) of each stream, or what is wrong with it."""
    if not streams:
        return []
    try:
        return _decode(streams)
    except (DamagedStream, IndexError) as error:
        if len(streams) == 1:
            return [error if isinstance(error, DamagedStream) else DamagedStream("the stream ends early")]
        half = len(streams) // 2
        return decode_streams(streams[:half]) + decode_streams(streams[half:])
