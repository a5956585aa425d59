"""Vectorised text primitives on Arrow batches: word boundaries, 64-bit hashes, ragged arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None

U64 = np.uint64
# ASCII white space: a word is a maximal run of other bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words above this many bytes are hashed one by one.
LONG_WORD = 512


def release() -> None:
    """Gives memory that is not used any more back to the system: workers live on and would keep their peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds at most max_bytes of the column, or one row."""
    for batch in batches:
        col = batch.column(column)
        n = batch.num_rows
        if n == 0:
            continue
        size = np.frombuffer(col.buffers()[1], np.int32 if col.type in (pa.string(), pa.binary()) else np.int64, n + 1 + col.offset)[col.offset :]
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(size, int(size[lo]) + max_bytes, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, col, size
        release()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes without gaps, and each row's offsets into them; nulls are empty."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def span_hash(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: eight bytes at a time over all spans at once."""
    n = len(starts)
    h = mix(lengths.astype(U64) + U64(0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF))
    if n == 0:
        return h
    pad = np.zeros(len(buf) + 16, np.uint8)
    pad[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 8,), "<u8", pad.data, strides=(1,))
    long = lengths > LONG_WORD
    act = np.flatnonzero(~long)
    at, left = starts[act], lengths[act]
    while True:
        keep = left > 0
        if not keep.all():
            act, at, left = act[keep], at[keep], left[keep]
        if not len(act):
            break
        v = lanes[at]
        part = left < 8
        if part.any():
            v = np.where(part, v & ((U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1)), v)
        h[act] = mix((h[act] ^ v) * U64(0x9FB21C651E98DF25) + U64(0x632BE59BD9B4E019))
        at, left = at + 8, left - 8
    view = memoryview(pad)
    for i in np.flatnonzero(long):
        s = int(starts[i])
        h[i] = U64(xxhash.xxh3_64_intdigest(view[s : s + int(lengths[i])], seed))
    return h


class Words:
    """The words of a slice of texts, A-Z lower-cased: byte starts and lengths, and each text's first word."""

    def __init__(self, col: pa.Array):
        raw, self.off = utf8(col)
        self.n_docs = len(col)
        self.buf = _LOWER[raw]
        inside = np.zeros(len(raw) + 1, bool)
        np.logical_not(_SPACE[raw], out=inside[:-1])
        edge = np.zeros(len(raw) + 1, bool)  # a text starts here
        edge[self.off] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (edge | ~before))
        ends = np.flatnonzero(before & (edge | ~inside))
        self.lengths = ends - self.starts
        self.first = np.searchsorted(self.starts, self.off)
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hash(self.buf, self.starts, self.lengths, seed)


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all width-word shingles of each text (the whole sequence, if shorter) and each text's first one."""
    counts = np.diff(first)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(each, out=at[1:])
    start = np.repeat(first[:-1] - at[:-1], each) + np.arange(at[-1])
    size = np.repeat(np.minimum(counts, width), each)
    out = mix(size.astype(U64) + U64(0xA0761D6478BD642F))
    for k in range(width):
        on = size > k
        g = h[np.minimum(start + k, max(len(h) - 1, 0))] if len(h) else np.zeros(0, U64)
        out = np.where(on, mix(out * U64(0x9E3779B97F4A7C15) + g), out)
    return out, at


def ragged(flat_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(flat_starts - (ends - lengths), lengths) + np.arange(total)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    c = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


class HashIndex:
    """64-bit keys to numbers 0, 1, 2 ... in the order added; looks up whole arrays. Key 0 stands for 1."""

    def __init__(self, room: int):
        self.bits = max(10, (2 * room - 1).bit_length())
        self.key = np.zeros((1 << self.bits) + 1024, U64)
        self.value = np.zeros(len(self.key), np.int32)
        self.n = 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where there is none."""
        keys = np.maximum(keys, U64(1))
        out = np.full(len(keys), -1, np.int32)
        slot = self._home(keys)
        there = self.key[slot]
        hit = there == keys
        out[hit] = self.value[slot[hit]]
        todo = np.flatnonzero(~hit & (there != 0))
        while len(todo):
            slot[todo] += 1
            there = self.key[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Adds distinct keys that are not there yet; returns their numbers."""
        keys = np.maximum(keys, U64(1))
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.key[slot[todo]] == 0
            _, first = np.unique(slot[todo], return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= free
            put = todo[mine]
            self.key[slot[put]], self.value[slot[put]] = keys[put], number[put]
            todo = todo[~mine]
            slot[todo] += 1
        return number


class SpanCache:
    """Word hashes to runs of ids; forgets everything when more words would be kept than it has room for."""

    def __init__(self, room: int):
        self.room = room
        self.reset()

    def reset(self) -> None:
        self.index = HashIndex(self.room)
        self.ids = np.zeros(1 << 16, np.int32)
        self.span = np.zeros((1 << 14, 2), np.int64)
        self.n_ids = 0

    def lookup(self, keys: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all keys and each key's count; learn(positions) gives flat ids and counts of words not met before."""
        at = self.index.get(keys)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            fresh, first, inv = np.unique(keys[miss], return_index=True, return_inverse=True)
            if self.index.n + len(fresh) > self.room:
                self.reset()
                fresh, first, inv = np.unique(keys, return_index=True, return_inverse=True)
                miss = np.arange(len(keys))
                if len(fresh) > self.room:
                    self.index = HashIndex(len(fresh))
            ids, counts = learn(miss[first])
            number = self.index.add(fresh)
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            while self.index.n > len(self.span):
                self.span = np.r_[self.span, np.zeros_like(self.span)]
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.span[number, 0] = self.n_ids + np.cumsum(counts) - counts
            self.span[number, 1] = counts
            self.n_ids += len(ids)
            at[miss] = number[inv]
        span = self.span[at]
        return self.ids[ragged(span[:, 0], span[:, 1])], span[:, 1]
