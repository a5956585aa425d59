"""FLAC media columns: lossless 8-bit mono streams, their decoding with checksums, and seekable PCM blocks.

Streams follow the published format (RFC 9639). All frames of a slice of rows are handled at once, as lanes of numpy
arrays: the writer picks each frame's cheapest of fixed predictors 0 and 1, a quantised linear predictor and verbatim
samples, and Rice-codes the residuals; the reader parses headers, decodes Rice residuals (both parameter widths, all
partition orders, escapes) and fixed or linear predictors, and checks CRC-8, CRC-16 and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A

BLOCK = 1024
RATE = 8000
LPC_ORDER = 4
LPC_BITS, LPC_SHIFT = 12, 9
SEEK_EVERY = 8  # frames between seek points
SLICE_BYTES = 2_000_000
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


class FlacError(ValueError):
    """A stream that does not decode or whose checksums differ."""


def _crc_lanes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each span; longest first, so that active lanes are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    crc = np.zeros(len(s), np.uint32)
    live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right") if len(n) else []
    table, shift, mask = (CRC8, 0, 0xFF) if bits == 8 else (CRC16, 8, 0xFFFF)
    for t, m in enumerate(live):
        c = crc[:m]
        crc[:m] = ((c << 8) & mask) ^ table[(c >> shift) ^ buf[s[:m] + t]] if bits == 16 else table[c ^ buf[s[:m] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """The frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    for size in range(2, 8):
        if n < 1 << (5 * size + 1):
            tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
            return bytes([(0xFF << (8 - size) & 0xFF) | n >> (6 * (size - 1)), *tail])
    raise FlacError("frame number too large")


# -- writing ------------------------------------------------------------------------------------------------------


LANES = 256  # frames of like length that the writer handles at once, so that its arrays stay in cache
PREDICTORS = (0, 1, 5)  # fixed orders the writer tries; 5: the linear predictor


def _residuals(x: np.ndarray, coefs, shift: int, order: int) -> np.ndarray:
    """x: samples by time and lane; residual of each lane's predictor from time order on."""
    pred = np.zeros(x[order:].shape, np.int32)
    for j in range(order):
        pred += np.int32(coefs[j]) * x[order - 1 - j : len(x) - 1 - j] if np.isscalar(coefs[j]) else coefs[j].astype(np.int32) * x[order - 1 - j : len(x) - 1 - j]
    return x[order:] - (pred >> shift)


def _samples(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples by time and lane, zero beyond each lane's end, and where they are live."""
    t = np.arange(int(n.max()), dtype=np.int32)[:, None]
    live = t < n.astype(np.int32)
    x = data[np.minimum(start.astype(np.int32) + t, len(data) - 1)]
    x[~live] = 0
    return x, live


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each lane, from exact integer autocorrelations."""
    lags = np.stack([np.einsum("tf,tf->f", x[k:], x[: len(x) - k]) for k in range(LPC_ORDER + 1)]).astype(np.float64)
    r = np.stack([np.stack([lags[abs(i - j)] for j in range(LPC_ORDER)], -1) for i in range(LPC_ORDER)], -2)
    r[:, range(LPC_ORDER), range(LPC_ORDER)] += lags[0][:, None] * 1e-9 + 1.0
    a = np.linalg.solve(r, lags[1:].T[:, :, None])[:, :, 0]
    top = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top, top - 1).astype(np.int64).T


def _fold(res: np.ndarray, live: np.ndarray) -> np.ndarray:
    z = (res << 1) ^ (res >> 31)
    z[~live] = 0
    return z


def _rice_bits(z: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Rice parameter near the best of each lane, of three, and its bits."""
    mean = z.sum(0, dtype=np.int64) / np.maximum(count, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 1, 13).astype(np.int32)
    ks = np.stack([guess - 1, guess, guess + 1])
    cost = np.stack([(z >> k).sum(0, dtype=np.int64) + count * (k + 1) for k in ks])
    best = cost.argmin(0)
    lanes = np.arange(len(count))
    return ks[best, lanes].astype(np.int64), cost[best, lanes]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each non-empty payload; byte b is the sample b - 128."""
    doc, start, size, number = [], [], [], []
    at = 0
    for d, p in enumerate(payloads):
        if not p:
            raise FlacError("a stream needs a sample at least")
        for i in range(0, len(p), BLOCK):
            doc.append(d), start.append(at + i), size.append(min(BLOCK, len(p) - i)), number.append(i // BLOCK)
        at += len(p)
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    start, n = np.array(start), np.array(size)
    frames = len(n)
    # Candidates: bits of the body after the subframe byte.
    by_length = np.argsort(n, kind="stable")
    groups = [by_length[i : i + LANES] for i in range(0, frames, LANES)]
    cut = [_samples(data, start[g], n[g]) for g in groups]
    lpc = np.zeros((LPC_ORDER, frames), np.int32)
    best = n * 8  # verbatim
    kind, param = np.full(frames, -1), np.zeros(frames, np.int64)  # -1 verbatim, 0 and 1 fixed, 5 linear predictor, 6 constant
    for g, (x, live) in zip(groups, cut):
        lpc[:, g] = _lpc(x)
        for o in PREDICTORS:
            order = o if o < 5 else LPC_ORDER
            if len(x) <= order:
                continue
            z = _fold(_residuals(x, FIXED[o] if o < 5 else lpc[:, g], 0 if o < 5 else LPC_SHIFT, order), live[order:])
            k, bits = _rice_bits(z, np.maximum(n[g] - order, 0))
            bits = bits + 8 * order + 10 + (9 + LPC_BITS * LPC_ORDER if o == 5 else 0)
            better = (n[g] > order) & (bits < best[g])
            f = g[better]
            best[f], kind[f], param[f] = bits[better], o, k[better]
        same = g[~((x != x[0]) & live).any(0)]
        kind[same], best[same] = 6, 8
    # Headers, then each frame's place.
    heads = []
    for i in range(frames):
        full = n[i] == BLOCK
        h = bytes([0xFF, 0xF8, (0xA0 if full else 0x70) | 0x04, 0x02]) + _number(number[i]) + (b"" if full else struct.pack(">H", int(n[i]) - 1))
        heads.append(h)
    head_n = np.array([len(h) + 1 for h in heads])
    body = 1 + (best + 7) // 8
    size_bytes = head_n + body + 2
    place = np.cumsum(size_bytes) - size_bytes
    out = np.zeros(int(size_bytes.sum()), np.uint8)
    flat = np.frombuffer(b"".join(h + b"\0" for h in heads), np.uint8)
    out[A.ragged(place, head_n)] = flat
    out[place + head_n - 1] = _crc_lanes(out, place, head_n - 1, 8)
    sub = place + head_n
    out[sub] = np.select([kind == 6, kind == -1, kind == 5], [0, 2, (32 + LPC_ORDER - 1) << 1], (8 + np.clip(kind, 0, 4)) << 1)
    raw = (data & 0xFF).astype(np.uint8)
    for i in np.flatnonzero(kind == 6):
        out[sub[i] + 1] = raw[start[i]]
    for i in np.flatnonzero(kind == -1):
        out[sub[i] + 1 : sub[i] + 1 + n[i]] = raw[start[i] : start[i] + n[i]]
    words = np.zeros(len(out) // 4 + 3)  # 32 bits each: codes do not overlap, so sums of their parts are exact

    def put(at: np.ndarray, values: np.ndarray, width) -> None:
        v = values.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        i = at >> 5
        lo, hi = int(i.min()), int(i.max()) + 1
        words[lo:hi] += np.bincount(i - lo, (v >> np.uint64(32)).astype(np.float64))
        words[lo + 1 : hi + 1] += np.bincount(i - lo, (v & np.uint64(0xFFFFFFFF)).astype(np.float64))

    for group, (x, live) in zip(groups, cut):
        for o in PREDICTORS:
            lane = np.flatnonzero(kind[group] == o)
            if not len(lane):
                continue
            lane = lane[np.argsort(group[lane])]
            f = group[lane]
            order = o if o < 5 else LPC_ORDER
            at = (sub[f] + 1) * 8
            for j in range(order):
                put(at, x[j, lane] & 0xFF, 8)
                at = at + 8
            if o == 5:
                put(at, np.full(len(f), (LPC_BITS - 1) << 5 | LPC_SHIFT), 9)
                at = at + 9
                for j in range(LPC_ORDER):
                    put(at, lpc[j, f] & ((1 << LPC_BITS) - 1), LPC_BITS)
                    at = at + LPC_BITS
            put(at + 6, param[f], 4)  # method 0 and partition order 0 before it
            at = at + 10
            z = _fold(_residuals(x[:, lane], FIXED[o] if o < 5 else lpc[:, f], 0 if o < 5 else LPC_SHIFT, order), live[order:, lane])
            k, on = param[f].astype(np.int32), live[order:, lane]
            width = (z >> k) + (1 + k)
            width[~on] = 0
            stop = (np.cumsum(width, 0) - (k + 1) + at)[on]
            k = np.broadcast_to(k, z.shape)[on]
            put(stop, (1 << k) | (z[on] & ((1 << k) - 1)), k + 1)
    out |= words.astype(np.uint32).astype(">u4").view(np.uint8)[: len(out)]
    crc = _crc_lanes(out, place, size_bytes - 2, 16)
    out[place + size_bytes - 2], out[place + size_bytes - 1] = crc >> 8, crc & 0xFF
    # Streams.
    doc = np.array(doc)
    first = np.searchsorted(doc, np.arange(len(payloads) + 1))
    streams = []
    for d, p in enumerate(payloads):
        lo, hi = int(first[d]), int(first[d + 1])
        sizes = size_bytes[lo:hi]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(raw_pcm(p)).digest()
        begin = int(place[lo])
        points = b"".join(struct.pack(">QQH", number[i] * BLOCK, int(place[i]) - begin, int(n[i])) for i in range(lo, hi, SEEK_EVERY))
        frames_bytes = out[begin : int(place[hi - 1] + size_bytes[hi - 1])].tobytes()
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + frames_bytes)
    return streams


def raw_pcm(payload: bytes) -> bytes:
    """The payload's samples as signed bytes."""
    return (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()


# -- reading ------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    samples: np.ndarray  # signed
    rate: int
    total: int
    seek: list[tuple[int, int, int]]
    frames: list[tuple[int, int, int]]  # first sample, byte offset from the first frame, samples


class _Bits:
    """Bit reads at many positions at once."""

    def __init__(self, data: np.ndarray):
        pad = np.zeros(len(data) + 16, np.uint8)
        pad[: len(data)] = data
        self.words = np.ndarray((len(data) + 8,), ">u8", pad.data, strides=(1,)).astype(np.uint64)
        self.n = len(data) * 8

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Up to 56 bits, unsigned; beyond the end: zeros."""
        at = np.minimum(at, self.n)
        w = self.words[at >> 3]
        width = np.asarray(width)
        v = (w << (at & 7).astype(np.uint64)) >> (64 - np.maximum(width, 1)).astype(np.uint64)
        return np.where(width == 0, 0, v).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v = self.read(at, width)
        width = np.asarray(width, np.int64)
        return np.where(width == 0, 0, v - ((v >> np.maximum(width - 1, 0)) << width))

    def one_after(self, at: np.ndarray) -> np.ndarray:
        """Position of the first 1 bit at or after each position; the end, if none."""
        at = np.array(at, np.int64)
        out = np.full(len(at), self.n, np.int64)
        todo = np.flatnonzero(at < self.n)
        while len(todo):
            w = self.read(at[todo], 32)
            hit = w > 0
            out[todo[hit]] = at[todo[hit]] + 31 - ((w[hit].astype(np.float64).view(np.int64) >> 52) - 1023)
            todo = todo[~hit]
            at[todo] += 32
            todo = todo[at[todo] < self.n]
        return np.minimum(out, self.n)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folded value and end of the Rice code at each position."""
        here = np.minimum(at, self.n)
        w = self.words[here >> 3] << (here & 7).view(np.uint64)
        top = w >> np.uint64(32)
        if top.all():
            q = 1054 - (top.astype(np.float64).view(np.int64) >> 52)  # zeros before the first 1
            low = ((w << (q + 1).view(np.uint64)) >> np.uint64(1)) >> (63 - k).view(np.uint64)
            return (q << k) | low.view(np.int64), here + q + 1 + k
        stop = self.one_after(here)
        return ((stop - here) << k) | self.read(stop + 1, k), stop + 1 + k


_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame_header(data: bytes, at: int, depth: int) -> tuple[int, int, int, int, bool, int]:
    """Header bytes with the CRC, samples, bits a sample, number, whether that counts samples, channel code."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    b, r = data[at + 2] >> 4, data[at + 2] & 15
    p = at + 4
    lead = 8 - (data[p] ^ 0xFF).bit_length()
    extra = max(lead - 1, 0)
    if lead == 1 or lead > 7:
        raise FlacError("bad frame number")
    number = data[p] & (0xFF >> (lead + 1) if lead else 0x7F)
    for c in data[p + 1 : p + 1 + extra]:
        number = number << 6 | c & 0x3F
    p += 1 + extra
    if b == 6:
        n, p = data[p] + 1, p + 1
    elif b == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    elif b == 1:
        n = 192
    elif 2 <= b <= 5:
        n = 576 << (b - 2)
    elif b >= 8:
        n = 256 << (b - 8)
    else:
        raise FlacError("reserved block size")
    p += {12: 1, 13: 2, 14: 2}.get(r, 0)
    code = data[at + 3] >> 1 & 7
    return p + 1 - at, n, _DEPTHS.get(code, depth) if code else depth, number, bool(data[at + 1] & 1), data[at + 3] >> 4


def _info(data: bytes) -> tuple[dict, int]:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info, seek = 4, None, []
    while True:
        if len(data) < at + 4:
            raise FlacError("metadata cut off")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            x = int.from_bytes(block[10:18], "big")
            info = {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "depth": (x >> 36 & 31) + 1, "total": x & (1 << 36) - 1, "md5": block[18:34], "block": int.from_bytes(block[:2], "big")}
        elif kind == 3:
            seek = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, len(block) - 17, 18)]
        at += 4 + size
        if last:
            break
    if info is None:
        raise FlacError("no stream information")
    return info | {"seek": seek}, at


def _rice(bits: _Bits, at: np.ndarray, n: np.ndarray, order: np.ndarray, res: np.ndarray) -> np.ndarray:
    """Residuals of all lanes into res (time by lane, from time order on); returns each lane's end."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    wide = np.where(method == 1, 5, 4)
    at = at + 6
    lanes = np.arange(len(at))
    t = order.copy()
    for p in range(int((1 << parts).max())):
        on = lanes[p < (1 << parts)]
        param = bits.read(at[on], wide[on])
        escape = param == (1 << wide[on]) - 1
        at[on] += wide[on]
        raw = np.zeros(len(on), np.int64)
        raw[escape] = bits.read(at[on[escape]], 5)
        at[on[escape]] += 5
        count = (n[on] >> parts[on]) - (order[on] if p == 0 else 0)
        if (count < 0).any():
            raise FlacError("partition shorter than the predictor")
        by = np.argsort(-count, kind="stable")
        on, param, escape, raw, count = on[by], param[by], escape[by], raw[by], count[by]
        pos, row = at[on], t[on]
        live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), "right") if len(on) else []
        any_escape = bool(escape.any())
        for i, m in enumerate(live):
            here, k = pos[:m], param[:m]
            z, to = bits.rice(here, k)
            v = (z >> 1) ^ -(z & 1)
            if any_escape:
                v = np.where(escape[:m], bits.signed(here, raw[:m]), v)
                to = np.where(escape[:m], here + raw[:m], to)
            res[row[:m] + i, on[:m]] = v
            pos[:m] = to
        if (pos > bits.n).any():
            raise FlacError("residual cut off")
        at[on] = pos
        t[on] += count
    return at


def _subframes(bits: _Bits, at: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (time by lane) and end of one subframe in each lane."""
    head = bits.read(at, 8)
    if (head >> 7).any():
        raise FlacError("bad subframe")
    kind, at = head >> 1 & 63, at + 8
    wasted = np.where(head & 1, bits.one_after(at) - at + 1, 0)
    at = at + wasted
    depth = depth - wasted
    kept = np.int32 if depth.max() <= 11 else np.int64  # with coefficients of 15 bits and 32 of them, sums of 11-bit samples fit
    out = np.zeros((int(n.max()), len(n)), kept)
    f = np.flatnonzero(kind == 0)
    out[:, f] = bits.signed(at[f], depth[f])
    at[f] += depth[f]
    f = np.flatnonzero(kind == 1)
    for t in range(int(n[f].max()) if len(f) else 0):
        g = f[n[f] > t]
        out[t, g] = bits.signed(at[g], depth[g])
        at[g] += depth[g]
    f = np.flatnonzero((kind >= 8) & (kind <= 12) | (kind >= 32))
    if len(f) + ((kind == 0) | (kind == 1)).sum() < len(n):
        raise FlacError("reserved subframe")
    if len(f):
        linear = kind[f] >= 32
        order = np.where(linear, kind[f] - 31, kind[f] - 8)
        pos = at[f]
        x = np.zeros((int(n[f].max()), len(f)), kept)
        for t in range(int(order.max())):
            m = order > t
            x[t, m] = bits.signed(pos[m], depth[f[m]])
            pos[m] += depth[f[m]]
        coefs, shift = np.zeros((int(order.max()), len(f)), np.int64), np.zeros(len(f), np.int64)
        for i in np.flatnonzero(~linear):
            coefs[: order[i], i] = FIXED[int(order[i])]
        m = np.flatnonzero(linear)
        width = bits.read(pos[m], 4) + 1
        shift[m] = bits.signed(pos[m] + 4, np.full(len(m), 5))
        if (shift < 0).any():
            raise FlacError("negative predictor shift")
        pos[m] += 9
        for j in range(int(order[m].max()) if len(m) else 0):
            g = order[m] > j
            coefs[j, m[g]] = bits.signed(pos[m[g]], width[g])
            pos[m[g]] += width[g]
        res = np.zeros_like(x)
        at[f] = _rice(bits, pos, n[f], order, res)
        most = int(order.max())
        for t in range(min(most, len(x))):
            x[t] = np.where(order <= t, res[t], x[t])
            m = np.flatnonzero((order <= t) & (order > 0))
            x[t, m] += (coefs[:t, m] * x[:t, m][::-1]).sum(0) >> shift[m]
        x[most:] = res[most:]
        coefs, shift = coefs.astype(kept), shift.astype(kept)
        for t in range(most, len(x) if most else 0):
            pred = coefs[0] * x[t - 1]
            for j in range(1, most):
                pred += coefs[j] * x[t - 1 - j]
            pred >>= shift
            x[t] += pred
        out[: len(x), f] = x
    return (out << wasted.astype(kept) if wasted.any() else out), at


def decode_streams(streams: list[bytes]) -> list[Stream]:
    """Decodes whole streams; raises FlacError where a frame, a CRC-8, a CRC-16 or the MD5 does not fit.

    Candidate frames are found by their sync codes and CRC-8 and decoded all at once; those that follow one another
    without a gap are the stream.
    """
    heads = [_info(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    # Candidate frames by sync code with a right CRC-8; the walk below keeps those that follow one another.
    lanes = []
    for i, (s, (info, at)) in enumerate(zip(streams, heads)):
        pos = at
        while (pos := s.find(b"\xff", pos)) >= 0:
            if pos + 6 <= len(s) and s[pos + 1] & 0xFE == 0xF8:
                try:
                    h = _frame_header(s, pos, info["depth"])
                    crc = 0
                    for c in s[pos : pos + h[0] - 1]:
                        crc = int(CRC8[crc ^ c])
                    if s[pos + h[0] - 1] == crc:
                        lanes.append((i, pos, *h))
                except (FlacError, IndexError):
                    pass
            pos += 1
    bits = _Bits(data)
    frames: dict[tuple[int, int], tuple] = {}
    by_channels: dict[int, list[tuple]] = {}
    for x in lanes:
        by_channels.setdefault(x[7], []).append(x)
    for code, group in by_channels.items():
        channels = code + 1 if code < 8 else 2
        if code > 10:
            continue
        # A sync code inside a frame can pass for one; halving the lanes finds such lanes and leaves them out.
        todo, done = [group], {}
        while todo:
            some = todo.pop()
            try:
                done |= _decode_lanes(bits, data, base, some, code, channels)
            except FlacError:
                if len(some) > 1:
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]
        frames |= done
    out = []
    for i, (s, (info, at)) in enumerate(zip(streams, heads)):
        pos, parts, table, total = at, [], [], 0
        while pos < len(s):
            if (i, pos) not in frames:
                raise FlacError(f"no valid frame at byte {pos}")
            end, block, number, by_sample = frames[i, pos]
            if (number if by_sample else number * info["block"]) != total:
                raise FlacError("frame out of order")
            table.append((total, pos - at, len(block)))
            parts.append(block)
            total += len(block)
            pos = end
        samples = np.concatenate(parts) if parts else np.zeros((0, info["channels"]), np.int64)
        if info["total"] and info["total"] != total:
            raise FlacError("samples missing")
        size = (info["depth"] + 7) // 8
        pcm = samples.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
        if any(info["md5"]) and hashlib.md5(pcm).digest() != info["md5"]:
            raise FlacError("MD5 differs")
        out.append(Stream(samples[:, 0] if info["channels"] == 1 else samples, info["rate"], total, info["seek"], table))
    return out


def _decode_lanes(bits: _Bits, data: np.ndarray, base: np.ndarray, lanes: list[tuple], code: int, channels: int) -> dict:
    doc, pos, head, n, depth, number = (np.array([x[k] for x in lanes]) for k in range(6))
    start = base[doc] + pos
    at = (start + head) * 8
    found = []
    for c in range(channels):
        side = (code == 8 and c == 1) or (code == 9 and c == 0) or (code == 10 and c == 1)
        x, at = _subframes(bits, at, n, depth + side)
        found.append(x)
    if code == 8:
        found[1] = found[0] - found[1]
    elif code == 9:
        found[0] = found[0] + found[1]
    elif code == 10:
        mid = (found[0] << 1) | (found[1] & 1)
        found = [(mid + found[1]) >> 1, (mid - found[1]) >> 1]
    end = (at + 7) >> 3
    if (end + 2 > base[doc + 1]).any():
        raise FlacError("frame cut off")
    crc = _crc_lanes(data, start, end - start, 16)
    if (crc != (data[end].astype(np.uint32) << 8 | data[end + 1])).any():
        raise FlacError("CRC-16 differs")
    return {(int(doc[j]), int(pos[j])): (int(end[j] + 2 - base[doc[j]]), np.stack([f[: n[j], j] for f in found], -1), int(number[j]), lanes[j][6]) for j in range(len(lanes))}


def read_from(stream: bytes, sample: int) -> tuple[int, int]:
    """The seek point at or before a sample: its first sample and its byte offset in the stream."""
    info, at = _info(stream)
    first, offset = _seek(info["seek"], sample)
    return first, at + offset


def _seek(points: list[tuple[int, int, int]], sample: int) -> tuple[int, int]:
    """First sample and offset after the metadata of the seek point at or before a sample; the start without one."""
    best = max((p for p in points if p[0] <= sample and p[0] != (1 << 64) - 1), default=(0, 0, 0))
    return best[0], best[1]


def blocks(s: Stream) -> list[tuple[int, int, int, bytes]]:
    """The PCM blocks of a stream, a frame each: number, first sample, byte offset after the metadata, signed bytes.

    Blocks follow one another without a gap, and every seek point is the start of one; else FlacError.
    """
    pcm = (s.samples & 0xFF).astype(np.uint8)
    out = [(k, first, at, pcm[first : first + n].tobytes()) for k, (first, at, n) in enumerate(s.frames)]
    starts, due = {first: at for first, at, _ in s.frames}, 0
    for first, _, n in s.frames:
        if first != due:
            raise FlacError("blocks do not follow one another")
        due += n
    if due != len(pcm) or any(starts.get(p[0]) != p[1] for p in s.seek if p[0] != (1 << 64) - 1):
        raise FlacError("a seek point is no start of a block")
    return out


# -- Spark --------------------------------------------------------------------------------------------------------


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(-len(raw) % 64, 0) if raw else 64)


def _payload(samples: np.ndarray) -> bytes:
    """Signed samples as the unsigned bytes that were stored."""
    return (samples.view(np.uint8) ^ 0x80).tobytes()


def features(samples: np.ndarray) -> str:
    """Integer features of the PCM samples: length, level, energy, peaks and sign changes."""
    x = samples.astype(np.int64)
    signs = int((np.diff(np.signbit(x).astype(np.int8)) != 0).sum())
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};min={int(x.min())};max={int(x.max())};crossings={signs};motion={int(np.abs(np.diff(x)).sum())}"


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the FLAC stream (media) of every whole text; a null text is empty: 64 zero bytes."""

    def run(batches):
        for b in A.slices(batches, "text", SLICE_BYTES):
            packed = [payload(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in packed], pa.int64()), pa.array(encode_streams([p for _, p in packed]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return _docs(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each frame of every stream: block number, first sample, byte offset after the metadata, and its PCM bytes.

    A null stream has no blocks. A damaged stream stops the job with FlacError.
    """

    def run(batches):
        for b in A.slices(batches, "media", SLICE_BYTES):
            rows = [(i, m) for i, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()) if m is not None]
            out = [(i, *block) for (i, _), s in zip(rows, decode_streams([m for _, m in rows])) for block in blocks(s)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "block", "first_sample", "byte_offset", "pcm"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "doc_id long, block long, first_sample long, byte_offset long, pcm binary")


def read_back(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """Decodes stored streams into PCM blocks and derives digests and features from those.

    The payload is the blocks joined in order; its tail is read from the block at the seek point before it.
    Null texts were stored as 64 zero bytes, so every row has a stream; repeated rows give equal rows; an empty table
    gives an empty result; a stream whose checksums differ stops the job.
    """

    def run(batches):
        for b in A.slices(batches, "media", SLICE_BYTES):
            media = b.column("media").to_pylist()
            out = []
            for m, s in zip(media, decode_streams(media)):
                found = blocks(s)
                samples = np.frombuffer(b"".join(pcm for *_, pcm in found), np.int8)
                back = _payload(samples)
                first, _ = _seek(s.seek, len(samples) - 64)
                tail = _payload(np.frombuffer(b"".join(pcm for _, at, _, pcm in found if at >= first), np.int8))[-64:]
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), features(samples)))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).cast("long").alias("n_bytes"), F.col(media_col).alias("media")).mapInArrow(run, schema)
