"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of `width` bytes that also starts in a document of a smaller id. Strings of width
bytes are dealt to tasks by an anchor: the least hash of their K-byte substrings, which depends on the string alone. The
strings of one anchor next to each other form a fragment. Equal fragments are held against each other by name, first
within a task, so copies collapse before any shuffle: all but the first document's are matched whole. Fragments of an
anchor that differ are put together, with the smallest document of each, into one text; its suffix array, the previous
and next suffixes of smaller documents in suffix order and their common prefixes give each position's longest earlier
match, and positions whose match is width bytes or longer remove them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm import parts as P
from graphloom.llm.sparkio import materialise, on_group, on_pair, partitions

K = 16
SLICE_BYTES = 500_000
TEXT_BYTES = 400_000  # fragments whose suffixes are sorted together, about
MANY = 2000  # open fragments of an anchor beyond which their windows are dealt one by one


# -- arrays over one text -----------------------------------------------------------------------------------------


def window_order(raw: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of raw that start at the positions `at`, in the order of their first depth bytes, and common prefixes.

    Returns places in `at` and the common prefix of each suffix with the one before it, depth at most. Eight bytes are
    compared at a time, and after the first eight only suffixes that have not come apart yet. Each position needs depth
    bytes; depth is 8 at least.
    """
    n = len(at)
    pad = np.zeros(len(raw) + 8, np.uint8)
    pad[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), ">u8", pad.data, strides=(1,))
    key = lanes[at].astype(np.uint64)
    order = np.argsort(key)
    common = np.full(n, depth, np.int64)
    common[:1] = 0
    head = np.zeros(n, bool)  # starts a run of suffixes that are equal so far
    head[:1] = True
    key = key[order]
    done = _apart(key, head, common, np.arange(1, n), 0)
    offset = 8
    while offset < depth and not done:
        offset = min(offset, depth - 8)  # the last eight may overlap those before: they are equal there
        run = np.cumsum(head) - 1
        i = np.flatnonzero(np.bincount(run)[run] > 1)
        key = lanes[at[order[i]] + offset].astype(np.uint64)
        by = np.lexsort((key, run[i]))
        order[i], key = order[i][by], key[by]
        whole = np.zeros(n, np.uint64)
        whole[i] = key
        done = _apart(whole, head, common, i[~head[i]], offset)
        offset += 8
    return order, common


def _apart(key: np.ndarray, head: np.ndarray, common: np.ndarray, i: np.ndarray, offset: int) -> bool:
    """Notes which of the places i differ from the one before them in eight bytes at offset; whether none is left equal."""
    differ = key[i] ^ key[i - 1]
    new = differ != 0
    at = i[new]
    head[at] = True
    common[at] = offset + 7 - np.searchsorted(_BYTE_STEPS, differ[new], "right")
    return not len(i) or bool(new.all())


_BYTE_STEPS = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


def nearest_smaller(owner: np.ndarray, common: np.ndarray, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order: the nearest place before it of a smaller owner (-1: none), and the common prefix with it.

    Every place points to the one before; places whose pointer is not smaller jump to where that one points, all at once,
    keeping the least common prefix on the way. Places whose common prefix falls below floor have none.
    """
    n = len(owner)
    least = common.copy()
    at = np.where(least < max(floor, 1), -1, np.arange(n) - 1)
    open_ = np.flatnonzero(at >= 0)
    open_ = open_[owner[at[open_]] >= owner[open_]]
    while len(open_):
        to = at[open_]
        least[open_] = np.minimum(least[open_], least[to])
        at[open_] = at[to]
        open_ = open_[at[open_] >= 0]
        open_ = open_[owner[at[open_]] >= owner[open_]]
    least[at < 0] = 0
    return at, least


def previous_factors(raw: np.ndarray, at: np.ndarray, owner: np.ndarray, depth: int, floor: int = 0) -> np.ndarray:
    """The longest match of each suffix that starts at a position of `at` with one of a strictly smaller owner.

    owner: the owner of each position. Exact up to depth, which every position has as bytes; matches below floor are 0.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    order, common = window_order(raw, at, depth)
    by = owner[order]
    _, before = nearest_smaller(by, common, floor)
    _, after = nearest_smaller(by[::-1], np.r_[0, common[:0:-1]], floor)
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def longest_previous_factors(text: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """Each position's longest match with a position of a strictly smaller owner (exact up to `depth`, else depth or more).

    text: numbers, of 255 different ones at most. The end of the text is a symbol of its own, smaller than any.
    """
    symbols, raw = np.unique(text, return_inverse=True)
    if len(symbols) > 255:
        raise ValueError("more than 255 symbols")
    depth = max(depth, 8)
    return previous_factors(np.r_[(raw + 1).astype(np.uint8), np.zeros(depth, np.uint8)], np.arange(len(text)), owner, depth)


# -- fragments ----------------------------------------------------------------------------------------------------


def fragments(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, anchor, name) of each fragment; starts are in the document, names are 48-bit hashes."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = len(buf) - width + 1
    if n <= 0:
        return none
    pad = np.zeros(len(buf) + 16, np.uint8)
    pad[: len(buf)] = buf
    lane = np.ndarray((len(buf) + 8,), "<u8", pad.data, strides=(1,))
    grams = len(buf) - K + 1
    h = A.mix(lane[:grams] * A.U64(0x9E3779B97F4A7C15) + A.mix(lane[8 : grams + 8]))
    low = A.U64(0xFFFFFF)
    v = (h & ~low) | np.arange(grams, dtype=np.uint64)  # the first of equal hashes; slices are below 2**24 bytes
    span, have, m = width - K + 1, 1, v
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[: n], m[span - have : span - have + n])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + width <= off[1:][doc]
    p = np.flatnonzero(inside)
    if not len(p):
        return none
    at = (m[p] & low).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = p[first], p[np.r_[first[1:], len(p)] - 1]
    d = doc[lo]
    length = hi - lo + width
    return d, lo - off[d], length, A.mix(h[at[first]]) >> A.U64(16), A.span_hash(buf, lo, length) >> A.U64(16)


def _pieces(buf: np.ndarray, off: np.ndarray, width: int, step: int = 8_000_000):
    """fragments() of texts of any length: those beyond a slice are cut into windows that share width - 1 bytes."""
    if len(buf) <= step:
        yield fragments(buf, off, width)
        return
    for d in range(len(off) - 1):
        for lo in range(int(off[d]), max(int(off[d + 1]) - width + 1, int(off[d]) + 1), step):
            hi = min(lo + step + width - 1, int(off[d + 1]))
            _, start, length, anchor, name = fragments(buf[lo:hi], np.array([0, hi - lo]), width)
            yield np.full(len(start), d), start + (lo - int(off[d])), length, anchor, name


def _merge(ids: np.ndarray, kinds: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching or overlapping runs of a document as one."""
    order = np.lexsort((start, kinds, ids))
    ids, kinds, start, end = ids[order], kinds[order], start[order], end[order]
    if not len(ids):
        return ids, kinds, start, end
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])
    group = np.cumsum(new) - 1
    lift = group * (int(end.max()) + 1)  # keeps each document's running end below the next one's starts
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= (start + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return ids[first], kinds[first], start[first], (reach - lift)[np.r_[first[1:], len(ids)] - 1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "kind", "n_raw", "blob"])


GONE, ANCHORS = 0, 1
_BLOBS = "part int, kind int, n_raw long, blob binary"


def _gone(n_parts: int, ids: np.ndarray, kinds: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """Runs to remove, merged, as blobs by the part of their document."""
    ids, kinds, start, end = _merge(ids, kinds, start, end)
    part = P.part_of(ids, n_parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [(int(p), GONE, *P.squeeze(*(c[order[cut[p] : cut[p + 1]]] for c in (ids, kinds, start, end)))) for p in np.unique(part)]


def _anchors(docs: DataFrame, width: int, n_parts: int) -> DataFrame:
    """Fragments as blobs by the part of their anchor; those that a smaller document of the same chunk has are removed here."""

    def run(batches):
        for b in P.grouped(batches, "text"):
            ids = b.column("doc_id").to_numpy().astype(np.int64)
            buf, off = A.utf8(b.column("text"))
            kinds = P.variants(buf, off)
            found, lo = [], 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
                for d, *rest in _pieces(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width):
                    found.append((d + lo, *rest))
                lo = hi
            doc, start, length, anchor, name = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((ids[doc], name, anchor))
            doc, start, length, anchor, name = doc[order], start[order], length[order], anchor[order], name[order]
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])
            least = ids[doc][np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else ids[:0]
            later = ids[doc] > least
            d = doc[later]
            rows = _gone(n_parts, ids[d], kinds[d], start[later], start[later] + length[later])
            keep = ~later
            doc, start, length, anchor, name = doc[keep], start[keep], length[keep], anchor[keep], name[keep]
            part = (anchor % A.U64(n_parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(n_parts + 1))
            for p in np.unique(part):
                at = by[cut[p] : cut[p + 1]]
                some, inv = np.unique(doc[at], return_inverse=True)
                rows.append((int(p), ANCHORS, *P.squeeze(ids[some], kinds[some], inv.astype(np.uint32 if len(some) > 65535 else np.uint16), start[at].astype(np.uint32) if len(at) and start[at].max() < 1 << 32 else start[at], length[at].astype(np.uint8), np.diff(anchor[at] // A.U64(n_parts), prepend=A.U64(0)), _six(name[at]))))
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOBS)


def _six(name: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _settle(n_parts: int, many: int):
    """For each part of anchors: runs to remove of fragments that a smaller document has whole, and the fragments to sort.

    A fragment is to be sorted if another of its anchor differs from it and another document has the anchor: rows of
    the fragment's smallest document, as blobs by the part of that document. Those of anchors with more than `many`
    different fragments are marked.
    """

    def run(rows: pa.Table) -> pa.Table:
        out = [(int(p), GONE, n, bytes(z)) for p, k, n, z in zip(*(rows.column(c).to_pylist() for c in ("part", "kind", "n_raw", "blob"))) if k == GONE]
        parts = []
        for k, n, z in zip(*(rows.column(c).to_pylist() for c in ("kind", "n_raw", "blob"))):
            if k == ANCHORS:
                ids, kinds, doc, start, length, anchor, name = P.expand(n, z)
                parts.append((ids[doc], kinds[doc], start.astype(np.int64), length.astype(np.int64), np.cumsum(anchor, dtype=np.uint64), _from_six(name)))
        if parts:
            ids, kinds, start, length, anchor, name = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((ids, name, anchor))
            ids, kinds, start, length, anchor, name = (c[order] for c in (ids, kinds, start, length, anchor, name))
            new_a = np.ones(len(ids), bool)
            new_a[1:] = anchor[1:] != anchor[:-1]
            new_f = new_a.copy()
            new_f[1:] |= name[1:] != name[:-1]
            a, f = np.cumsum(new_a) - 1, np.cumsum(new_f) - 1
            least = ids[new_f][f]
            later = ids > least
            out += _gone(n_parts, ids[later], kinds[later], start[later], start[later] + length[later])
            names = np.bincount(a[new_f])
            low, high = np.minimum.reduceat(ids, np.flatnonzero(new_a)), np.maximum.reduceat(ids, np.flatnonzero(new_a))
            open_ = ((names > 1) & (low < high))[a] & ~later
            crowded = (names > many)[a][open_].astype(np.uint8)
            part = P.part_of(ids[open_], n_parts)
            cols = (ids[open_], kinds[open_], start[open_], length[open_].astype(np.uint8), anchor[open_] * A.U64(n_parts) + A.U64(rows.column("part")[0].as_py()), crowded)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(n_parts + 1))
            out += [(int(p), ANCHORS, *P.squeeze(*(c[by[cut[p] : cut[p + 1]]] for c in cols))) for p in np.unique(part)]
        return pa.Table.from_batches([_batch(out)])

    return run


def _locate(documents: P.Documents, ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The first row of each id and variant among a part's documents; -1 if there is none."""
    lo = np.searchsorted(documents.ids, ids, "left")
    hi = np.searchsorted(documents.ids, ids, "right")
    at = lo.copy()
    for _ in range(int((hi - lo).max(initial=0))):  # rows of one id in order of their variant
        step = (at < hi) & (documents.kinds[np.minimum(at, len(documents.kinds) - 1)] != kinds)
        if not step.any():
            break
        at[step] += 1
    return np.where(at < hi, at, -1)


def _cut_out(n_parts: int, width: int):
    """The bytes of open fragments, by bucket of their anchor, from a part's documents.

    A fragment of a crowded anchor is cut into its windows, which go to buckets by their own bytes, so that no bucket
    gets all of them; windows that a smaller document of the part has too are removed here.
    """

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        parts = [P.expand(n, z) for n, z in zip(found.column("n_raw").to_pylist(), found.column("blob").to_pylist())]
        if not parts or not docs.num_rows:
            return pa.Table.from_batches([_batch([])])
        ids, kinds, start, length, anchor, crowded = (np.concatenate(c) for c in zip(*parts))
        d = P.unpack_documents(docs)
        row = _locate(d, ids, kinds)
        there = row >= 0
        row, start, length, anchor, crowded = row[there], start[there], length[there].astype(np.int64), anchor[there], crowded[there] > 0
        out = []
        if crowded.any():
            each = length[crowded] - width + 1
            w_row = np.repeat(row[crowded], each)
            w_start = A.ragged(start[crowded], each)
            place = d.off[w_row] + w_start
            name = A.span_hash(d.buf, place, np.full(len(place), width))
            # Neighbours of one fragment or of two overlapping ones may repeat a window.
            by = np.lexsort((place, d.ids[w_row], name))
            w_row, w_start, name = w_row[by], w_start[by], name[by]
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            least = d.ids[w_row][new][np.cumsum(new) - 1]
            later = d.ids[w_row] > least
            out += _gone(n_parts, d.ids[w_row][later], d.kinds[w_row][later], w_start[later], w_start[later] + width)
            keep = ~later
            row = np.r_[row[~crowded], w_row[keep]]
            start = np.r_[start[~crowded], w_start[keep]]
            length = np.r_[length[~crowded], np.full(int(keep.sum()), width)]
            anchor = np.r_[anchor[~crowded], name[keep]]
        ids, kinds = d.ids[row], d.kinds[row]
        bucket = (A.mix(anchor) % A.U64(n_parts)).astype(np.int32)
        by = np.lexsort((anchor, bucket))
        cut = np.searchsorted(bucket[by], np.arange(n_parts + 1))
        for p in np.unique(bucket):
            at = by[cut[p] : cut[p + 1]]
            out.append((int(p), ANCHORS, *P.squeeze(anchor[at], ids[at], kinds[at], start[at], length[at].astype(np.uint8), d.buf[A.ragged(d.off[row[at]] + start[at], length[at])])))
        return pa.Table.from_batches([_batch(out)])

    return run


def _sorted_texts(width: int, n_parts: int):
    """Runs to remove from the fragments of a bucket of anchors, by longest previous factors; runs found before pass through."""

    def run(found: pa.Table) -> pa.Table:
        rows = list(zip(*(found.column(c).to_pylist() for c in ("part", "kind", "n_raw", "blob"))))
        out = [r for r in rows if r[1] == GONE]
        parts = [P.expand(n, z) for _, k, n, z in rows if k == ANCHORS]
        if not parts:
            return pa.Table.from_batches([_batch(out)])
        anchor, ids, kinds, start, length, raw = (np.concatenate(c) for c in zip(*parts))
        length = length.astype(np.int64)
        first = np.cumsum(length) - length
        order = np.argsort(anchor, kind="stable")
        ends = np.flatnonzero(np.r_[anchor[order][1:] != anchor[order][:-1], True]) + 1  # a text ends with an anchor
        size = np.r_[0, np.cumsum(length[order])]
        gone, lo = [], 0
        while lo < len(order):
            k = np.searchsorted(size[ends], size[lo] + TEXT_BYTES, "right") - 1
            hi = int(ends[max(k, np.searchsorted(ends, lo, "right"))])
            at = order[lo:hi]
            n = length[at]
            text = raw[A.ragged(first[at], n)]
            place, windows = np.cumsum(n) - n, n - width + 1
            begin = A.ragged(place, windows)
            f = np.repeat(np.arange(len(at)), windows)
            pos = np.flatnonzero(previous_factors(text, begin, ids[at][f], width, width) >= width)
            f = f[pos]
            s = start[at][f] + begin[pos] - place[f]
            gone.append((ids[at][f], kinds[at][f], s, s + width))
            lo = hi
        return pa.Table.from_batches([_batch(out + _gone(n_parts, *(np.concatenate(c) for c in zip(*gone))))])

    return run


class _Found:
    """The documents of a part, in order, with the merged runs to remove from each."""

    def __init__(self, docs: pa.Table, found: pa.Table):
        self.docs = d = P.unpack_documents(docs)
        parts = [P.expand(n, z) for n, z in zip(found.column("n_raw").to_pylist(), found.column("blob").to_pylist())]
        cols = tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        ids, kinds, self.start, self.end = _merge(*cols)
        row = _locate(d, ids, kinds) if len(d.ids) else np.full(len(ids), -1)
        # Rows of the same id and variant are the same text; the first one's runs hold for all.
        same = np.ones(len(d.ids), bool)
        same[1:] = (d.ids[1:] != d.ids[:-1]) | (d.kinds[1:] != d.kinds[:-1])
        leader = np.maximum.accumulate(np.where(same, np.arange(len(same)), 0)) if len(same) else np.zeros(0, np.int64)
        self.lo, self.hi = np.searchsorted(row, leader, "left"), np.searchsorted(row, leader, "right")

    def __iter__(self):
        """(doc_id, bytes, starts, ends) of each document."""
        d, raw = self.docs, memoryview(self.docs.buf)
        for i in range(len(d.ids)):
            yield int(d.ids[i]), raw[d.off[i] : d.off[i + 1]], self.start[self.lo[i] : self.hi[i]], self.end[self.lo[i] : self.hi[i]]


SPANS = "doc_id long, raw binary, starts array<long>, ends array<long>"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXTS = "doc_id long, text string, n_removed long"


def _as_spans(rows) -> pa.Table:
    cols = list(zip(*((i, bytes(raw), s, e) for i, raw, s, e in rows))) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["doc_id", "raw", "starts", "ends"])


def _pieces_kept(raw, starts, ends):
    at = 0
    for s, e in zip(starts, ends):
        yield raw[at:s]
        at = e
    yield raw[at:]


def _as_digests(rows) -> pa.Table:
    out = []
    for i, raw, s, e in rows:
        digest = hashlib.sha256()
        for piece in _pieces_kept(raw, s, e):
            digest.update(piece)
        out.append((i, len(raw), int(sum(e) - sum(s)), len(s), digest.hexdigest()))
    cols = list(zip(*out)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _as_texts(rows) -> pa.Table:
    cols = list(zip(*((i, b"".join(_pieces_kept(raw, s, e)).decode("utf-8", "ignore"), int(sum(e) - sum(s))) for i, raw, s, e in rows))) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["doc_id", "text", "n_removed"])


def repeated_spans(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, starts, ends) of every row: the text's UTF-8 bytes and the maximal runs of bytes to remove.

    Documents are compared by id: only a strictly smaller one removes. Rows of one id do not remove from each other and
    rows of a null id neither remove nor lose anything. A null text is empty. A very long text is cut in windows that
    overlap, so only its bytes themselves are in memory at once. Other columns are ignored; an empty table gives an
    empty result.
    """
    return _repeated(df, width, id_col, text_col, _as_spans, SPANS)


def kept_digests(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digests() of repeated_spans(), made where the spans are found, so that no text comes back."""
    return _repeated(df, width, id_col, text_col, _as_digests, DIGESTS)


def without_repeats(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kept_texts() of repeated_spans(), made where the spans are found."""
    return _repeated(df, width, id_col, text_col, _as_texts, TEXTS)


def _repeated(df: DataFrame, width: int, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    if not K + 1 <= width <= 128:
        raise ValueError(f"width must be {K + 1} to 128")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = rows.where("doc_id is not null")
    n_parts = P.count_parts(docs)
    n = partitions(df.sparkSession)
    found = materialise(_anchors(docs, width, n_parts).repartition(n, "part").groupBy("part").applyInArrow(on_group(_settle(n_parts, MANY)), _BLOBS), "suffix-found")
    packed = P.pack_documents(docs, n_parts)
    opened = found.where(F.col("kind") == ANCHORS)
    cut = packed.groupBy("part").cogroup(opened.groupBy("part")).applyInArrow(on_pair(_cut_out(n_parts, width)), _BLOBS)
    more = materialise(cut.groupBy("part").applyInArrow(on_group(_sorted_texts(width, n_parts)), _BLOBS), "suffix-sorted")
    gone = found.where(F.col("kind") == GONE).union(more)

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        return finish(_Found(texts, found))

    out = packed.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(on_pair(apply), schema)

    def plain(batches):
        for b in A.slices(batches, "raw", SLICE_BYTES):
            yield from finish((None, raw, [], []) for raw in b.column("raw").to_pylist()).to_batches()

    return out.union(rows.where("doc_id is null").select(F.encode("text", "UTF-8").alias("raw")).mapInArrow(plain, schema))


def _read(spans: DataFrame, finish, schema: str) -> DataFrame:
    def run(batches):
        for b in A.slices(batches, "raw", SLICE_BYTES):
            yield from finish(zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "starts", "ends")))).to_batches()

    return spans.mapInArrow(run, schema)


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of repeated_spans()."""
    return _read(spans, _as_digests, DIGESTS)


def kept_texts(spans: DataFrame) -> DataFrame:
    """doc_id, text and n_removed of every row of repeated_spans(): the bytes that stay; a character cut in two loses its rest."""
    return _read(spans, _as_texts, TEXTS)
