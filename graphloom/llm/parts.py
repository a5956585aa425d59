"""Documents dealt to parts by a hash of their id, as compressed blobs, and joined there with other blobs.

A part is about PART_BYTES of text, so a task's memory does not grow with the input; the number of parts does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.sparkio import partitions

PART_BYTES = 8_000_000
LEAST_BYTES = 1_000_000  # smaller parts would send more messages than they are worth
CHUNK_BYTES = 4_000_000
PACKED = "part int, n_raw long, blob binary"


def squeeze(*columns: np.ndarray) -> tuple[int, bytes]:
    """Arrays as one compressed blob, and its size before."""
    raw = b"".join(len(c).to_bytes(8, "little") + c.dtype.str.encode().ljust(4) + np.ascontiguousarray(c).tobytes() for c in columns)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def expand(n_raw: int, blob) -> list[np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=n_raw, codec="zstd")
    view, at, out = memoryview(raw), 0, []
    while at < n_raw:
        n, kind = int.from_bytes(view[at : at + 8], "little"), np.dtype(bytes(view[at + 8 : at + 12]).decode().strip())
        out.append(np.frombuffer(view, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def count_parts(df: DataFrame, text_col: str = "text") -> int:
    """How many parts the texts need: as many as shuffle partitions if that leaves each LEAST_BYTES, more for parts above PART_BYTES."""
    total = df.agg(F.sum(F.octet_length(text_col).cast("long"))).head()[0] or 0
    return max(1, min(partitions(df.sparkSession), -(-total // LEAST_BYTES)), -(-total // PART_BYTES))


def part_of(ids: np.ndarray, n: int) -> np.ndarray:
    return ((A.mix(ids.view(np.uint64) + A.U64(0x51ED270B9F3C2A17)) >> A.U64(33)) % A.U64(n)).astype(np.int32)


def grouped(batches, column: str, max_bytes: int = CHUNK_BYTES):
    """Tables of about max_bytes of the column, from batches of any size."""
    held, size = [], 0
    for b in A.slices(batches, column, max_bytes):
        held.append(b)
        size += b.column(column).nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack_documents(df: DataFrame, n_parts: int, place=None) -> DataFrame:
    """Rows (doc_id, text) without null ids as blobs of ids, variants, sizes and bytes.

    place: the parts of ids and variants, where they are not those of part_of().
    """

    def run(batches):
        for b in grouped(batches, "text"):
            buf, off = A.utf8(b.column("text"))
            ids = b.column("doc_id").to_numpy().astype(np.int64)
            kinds = variants(buf, off)
            part = place(ids, kinds) if place else part_of(ids, n_parts)
            order = np.argsort(part, kind="stable")
            sizes = np.diff(off)
            cut = np.searchsorted(part[order], np.arange(n_parts + 1))
            rows = []
            for p in np.unique(part):
                at = order[cut[p] : cut[p + 1]]
                rows.append((int(p), *squeeze(ids[at], kinds[at], sizes[at], buf[A.ragged(off[at], sizes[at])])))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], ["part", "n_raw", "blob"])

    return df.select("doc_id", "text").mapInArrow(run, PACKED)


def variants(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text, which tells rows of one id with different texts apart."""
    view = memoryview(np.ascontiguousarray(buf))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, len(off) - 1)


@dataclass
class Documents:
    ids: np.ndarray
    kinds: np.ndarray
    off: np.ndarray
    buf: np.ndarray

    @property
    def texts(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(self.off), pa.py_buffer(self.buf))


def unpack_documents(rows: pa.Table) -> Documents:
    """The documents of a part's blobs, in the order of id and variant."""
    parts = [expand(n, b) for n, b in zip(rows.column("n_raw").to_pylist(), rows.column("blob").to_pylist())]
    if not parts:
        return Documents(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint8))
    ids, kinds, sizes, buf = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.lexsort((kinds, ids))
    # Bytes move text by text: an index of every byte would take eight times as much.
    texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(buf)])
    buf, off = A.utf8(texts.take(pa.array(order)))
    return Documents(ids[order], kinds[order], off, buf)
