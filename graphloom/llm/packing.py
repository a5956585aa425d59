"""Packing along a space-filling curve.

Each document's words hash to random sign vectors; their mean is projected to a few dimensions and quantised, and the
Hilbert key of that cell places near documents near each other on a curve. Documents are dealt into ranges of the
curve (bounds from a quantile sketch, about RANGE_BYTES of text each; equal keys are told apart by a hash of the document, so
a group of copies spreads over as many ranges as its size needs). Each range is a partition of its own, sorted, and cut into
sequences of a fixed length one after another. Only the last sequence of a range can need padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.bytetokens import Encoder
from graphloom.llm.sparkio import partitions

DIMS, BITS = 4, 8
BUCKETS = 1 << 12
SLICE_BYTES = 2_000_000
RANGE_SHIFT = 32
RANGE_BYTES = 16_000_000
MOST_RANGES = 2048  # quantiles that the sketch is asked for; beyond, ranges get longer and are still cut as they stream by
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of cell coordinates (below 2**bits), by transposing axes."""
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _signs() -> np.ndarray:
    """Two random signs, as 0 or 2, in the halves of an integer, for each pair of dimensions and bucket."""
    bits = np.random.RandomState(7).randint(0, 2, (DIMS, BUCKETS)).astype(np.int64) * 2
    return bits[0::2] + (bits[1::2] << 32)


_SIGNS = _signs()


def curve_keys(texts: pa.Array, ids: pa.Array) -> np.ndarray:
    """62-bit keys: the Hilbert cell of each text's projected word vector, then a hash of its id."""
    w = A.Words(texts)
    pad = np.zeros(len(w.buf) + 16, np.uint8)
    pad[: len(w.buf)] = w.buf
    head = np.ndarray((len(w.buf) + 8,), "<u8", pad.data, strides=(1,))[w.starts]  # a word's first bytes and its length
    left = np.maximum(8 - w.lengths, 0).astype(np.uint64) * np.uint64(8)
    head = np.where(left < 64, head << np.minimum(left, np.uint64(63)), head) + w.lengths.astype(np.uint64)
    h = ((head * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) & (BUCKETS - 1)
    root = np.sqrt(np.maximum(w.counts, 1))
    cells = np.zeros((len(texts), DIMS), np.int64)
    for i, table in enumerate(_SIGNS):
        c = np.zeros(len(h) + 1, np.int64)
        np.cumsum(table[h], out=c[1:])
        both = c[w.first[1:]] - c[w.first[:-1]]
        for j, part in ((2 * i, both & 0xFFFFFFFF), (2 * i + 1, both >> 32)):
            z = (part - w.counts) / root  # about normal for unrelated words; a language's common words shift it
            cells[:, j] = np.clip(np.floor((z / 16 + 0.5) * (1 << BITS)), 0, (1 << BITS) - 1)
    salt = A.mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(34)
    return (hilbert(cells) << 30) | salt.astype(np.int64)


class Packer:
    """Cuts token arrays into sequences of a fixed length, in the order given."""

    def __init__(self, first: int, length: int):
        self.sequence, self.room, self.length = first, length, length

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        out, at = [], 0
        while at < len(ids):
            take = min(self.room, len(ids) - at)
            piece = np.ascontiguousarray(ids[at : at + take], "<u4")
            out.append((doc, at, take, zlib.crc32(piece.tobytes()), len(ids), self.sequence, self.length - self.room))
            at += take
            self.room -= take
            if not self.room:
                self.sequence, self.room = self.sequence + 1, self.length
        return out


def pack(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; offsets in a sequence run from 0 without a gap. A null or
    empty text is the end id alone. Repeated rows are packed each; a null id stays null. Other columns are ignored.
    An empty table gives an empty result. A very long text is tokenised as a whole and goes on over many sequences.
    ranges: parts of the curve, by default as many as the texts need and as shuffle partitions at least.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def keys(batches):
        for b in A.slices(batches, "text", SLICE_BYTES):
            size = np.diff(A.utf8(b.column("text"))[1])
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(b.column("text"), b.column("doc_id"))), pa.array(size)], ["key", "bytes"])

    # A sketch of fixed size; its quantiles, of which every so many bounds a range, go to the driver.
    most = max(MOST_RANGES, ranges or 0)
    quantiles = ", ".join(f"{i / most}D" for i in range(1, most))
    found, total = docs.mapInArrow(keys, "key long, bytes long").agg(F.expr(f"percentile_approx(key, array({quantiles}), {10 * most})"), F.coalesce(F.sum("bytes"), F.lit(0))).head()
    n = ranges or min(max(partitions(df.sparkSession), -(-total // RANGE_BYTES)), most)
    bounds = np.array([found[i * most // n - 1] for i in range(1, n)] if found else [], np.int64)

    def tokens(batches):
        encoder = Encoder.of(tokenizer)
        for b in A.slices(batches, "text", SLICE_BYTES):
            key = curve_keys(b.column("text"), b.column("doc_id"))
            ids, counts = encoder.encode(b.column("text"))
            kept = ids.astype("<u2" if encoder.size <= 1 << 16 else "<u4")
            off = np.r_[0, np.cumsum(counts)] * kept.itemsize
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key), pa.array(np.searchsorted(bounds, key, "left")), blob], ["doc_id", "key", "part", "ids"])

    def cut(batches):
        packer, part = None, -1
        width = "<u2" if Encoder.of(tokenizer).size <= 1 << 16 else "<u4"
        for b in batches:
            rows = []
            for doc, p, blob in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("ids")):
                if p != part:  # sequences of a range are numbered within it
                    packer, part = Packer(p << RANGE_SHIFT, length), p
                rows += packer.add(doc, np.append(np.frombuffer(blob.as_buffer(), width).astype(np.uint32), np.uint32(end_id)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = docs.mapInArrow(tokens, "doc_id long, key long, part long, ids binary").repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "key", "doc_id")
    return dealt.mapInArrow(cut, OUT)
