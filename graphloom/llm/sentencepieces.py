"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts become flat symbol arrays. A round finds each word's minimum pair rank (a segmented minimum), merges all
leftmost non-overlapping pairs of that rank at once, and compacts the arrays; words without a pair left drop out.
A word in which merging one pair could change what the library does with another of the same round (a merged symbol
forms a pair of a rank no higher) is redone one merge at a time, so the result is always the library's.

Words are cut where a space mark follows another character: no piece of the model has one inside, which is checked
when the model is loaded. Equal words are encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A

MARK = "▁"
NONE = np.int64(1 << 40)
SLICE_BYTES = 2_000_000
CACHE_WORDS = 1_500_000

_loaded: dict[str, "PieceModel"] = {}


def load(path: str) -> "PieceModel":
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        probe = " a  é　Ａé\t"
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models with the identity normaliser and a leading space mark are supported")
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        usable = {p: i for i, p in enumerate(pieces) if not (special[i] or byte[i] or sp.is_unused(i))}
        if any(MARK in p[p.rfind(MARK) - 1 : p.rfind(MARK)].replace(MARK, "") or MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a piece has a space mark after another character")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]}
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte fallback")
        # Symbols: the model's ids, then single characters that occur only inside pieces.
        symbol = dict(usable)
        for p in usable:
            for c in p:
                symbol.setdefault(c, n + len(symbol))
        names = {s: p for p, s in symbol.items()}
        self.n_symbols = max(names) + 1
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in usable.values()}, reverse=True))}
        left, right, made, rank = [], [], [], []
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), rank.append(ranks[sp.get_score(i)])
        key = np.array(left, np.int64) * self.n_symbols + np.array(right, np.int64)
        order = np.argsort(key)
        self.pair_key = key[order]
        self.pair_made = np.array(made, np.int64)[order]
        self.pair_rank = np.array(rank, np.int64)[order]
        self._index()
        self.pair = dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_made.tolist())))
        chars = sorted((ord(p), s) for p, s in symbol.items() if len(p) == 1)
        self.char_cp = np.array([c for c, _ in chars], np.int64)
        self.char_id = np.array([s for _, s in chars], np.int64)
        self.in_vocab = np.zeros(self.n_symbols + 1, bool)
        self.in_vocab[list(usable.values())] = True
        self.names = names
        # Decoding: the bytes of each id.
        out = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.piece_len = np.array([len(x) for x in out], np.int64)
        self.piece_off = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.marked = np.array([not (special[i] or byte[i]) and p.startswith(MARK) for i, p in enumerate(pieces)])
        self.cache = A.SpanCache(CACHE_WORDS)

    def _index(self) -> None:
        """Open addressing: slots of a table four to eight times the pairs, probed for all symbols of a round at once."""
        bits = int(len(self.pair_key)).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.slot = np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 1
        for i, h in enumerate(self._home(self.pair_key).tolist()):
            k = h
            while self.slot[k] >= 0:
                k += 1
            self.slot[k] = i
            self.probes = max(self.probes, k - h + 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    # -- encoding -------------------------------------------------------------------------------------------------
    def _pairs(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each symbol with its right neighbour in the same word (NONE: no piece)."""
        rank = np.full(len(sym), NONE)
        made = np.zeros(len(sym), np.int64)
        if len(sym) < 2:
            return rank, made
        at = np.flatnonzero(~last[:-1] & (sym[:-1] >= 0) & (sym[1:] >= 0))
        key = sym[at] * self.n_symbols + sym[at + 1]
        slot = self._home(key)
        for _ in range(self.probes):
            i = self.slot[slot]
            hit = self.pair_key[i] == key
            hit &= i >= 0
            rank[at[hit]] = self.pair_rank[i[hit]]
            made[at[hit]] = self.pair_made[i[hit]]
            on = (i >= 0) & ~hit
            if not on.any():
                break
            at, key, slot = at[on], key[on], slot[on] + 1
        return rank, made

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """Merges in the library's own order: best rank first, then leftmost."""
        n = len(sym)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i] if i >= 0 else n
            if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0 and (p := self.pair.get(sym[i] * self.n_symbols + sym[j])):
                heapq.heappush(heap, (p[0], i, sym[i], sym[j], p[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = made, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        return [s for s, ok in zip(sym, alive) if ok]

    def merge_words(self, cps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as code points one after another; returns flat ids and each word's count of ids."""
        at = np.minimum(np.searchsorted(self.char_cp, cps), len(self.char_cp) - 1)
        unknown = -2 - cps.astype(np.int64)  # keeps the character
        start_sym = np.where(self.char_cp[at] == cps, self.char_id[at], unknown)
        n_words = len(counts)
        word = np.repeat(np.arange(n_words), counts)
        sym = start_sym
        done_sym, done_word = [], []
        redo: set[int] = set()
        last = np.ones(len(sym), bool)
        last[:-1] = word[1:] != word[:-1]
        rank, made = self._pairs(sym, last)
        while len(sym):
            heads = np.flatnonzero(np.r_[True, last[:-1]])
            low = np.minimum.reduceat(rank, heads)
            active = low < NONE
            sizes = np.diff(np.r_[heads, len(sym)])
            if not active.all():
                off = np.repeat(~active, sizes)
                done_sym.append(sym[off]), done_word.append(word[off])
                on = ~off
                sym, word, rank, made, last = sym[on], word[on], rank[on], made[on], last[on]
                low, sizes = low[active], sizes[active]
                if not len(sym):
                    break
            pick = rank == np.repeat(low, sizes)
            where = np.flatnonzero(pick)
            new_run = np.r_[True, np.diff(where) > 1]
            run_first = where[new_run][np.cumsum(new_run) - 1]
            where = where[(where - run_first) % 2 == 0]
            sym = sym.copy()
            sym[where] = made[where]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            merged = np.zeros(len(sym), bool)
            merged[where] = True
            level = np.repeat(low, sizes)[keep]
            many = np.bincount(word[where], minlength=n_words)
            sym, word, merged = sym[keep], word[keep], merged[keep]
            # A product that forms a pair of no higher rank, where the round merged several: order matters.
            last = np.ones(len(sym), bool)
            last[:-1] = word[1:] != word[:-1]
            rank, made = self._pairs(sym, last)
            beside = merged.copy()
            beside[:-1] |= merged[1:]
            odd = beside & (rank <= level) & (many[word] > 1)
            if odd.any():
                bad = np.unique(word[odd])
                redo.update(bad.tolist())
                on = ~np.isin(word, bad)
                sym, word, rank, made, last = sym[on], word[on], rank[on], made[on], last[on]
        if redo:
            first = np.cumsum(counts) - counts
            for w in sorted(redo):
                out = self._one_by_one(start_sym[first[w] : first[w] + counts[w]].tolist())
                done_sym.append(np.array(out, np.int64)), done_word.append(np.full(len(out), w))
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        # What is not a piece falls back to its bytes.
        lost = np.flatnonzero((sym < 0) | ~self.in_vocab[np.maximum(sym, 0)])
        if len(lost):
            reps = np.ones(len(sym), np.int64)
            raw = [(chr(-2 - int(sym[i])) if sym[i] < 0 else self.names[int(sym[i])]).encode("utf-8", "surrogatepass") for i in lost]
            reps[lost] = [len(r) for r in raw]
            ids = np.repeat(sym, reps)
            first = np.cumsum(reps) - reps
            for i, r in zip(lost, raw):
                ids[first[i] : first[i] + len(r)] = [self.byte_id[b] for b in r]
            sym, word = ids, np.repeat(word, reps)
        return sym, np.bincount(word, minlength=n_words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and each text's count of ids."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        cps = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc_n = np.array([len(t) for t in marked], np.int64)
        doc_first = np.cumsum(doc_n) - doc_n
        is_mark = cps == ord(MARK)
        head = is_mark.copy()
        head[1:] &= ~is_mark[:-1]
        head[doc_first[doc_n > 0]] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.r_[starts, len(cps)])
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        keys = A.span_hash(cps.view(np.uint8), starts * 4, lengths * 4)
        ids, counts = self.cache.lookup(keys, lambda at: self.merge_words(cps[A.ragged(starts[at], lengths[at])], lengths[at]))
        per_doc = A.sums(counts, np.searchsorted(starts, np.r_[doc_first, len(cps)])).astype(np.int64)
        return ids.astype(np.int64), per_doc

    # -- decoding -------------------------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; what is not UTF-8 becomes U+FFFD, byte by byte."""
        size = self.piece_len[ids]
        raw = self.piece_bytes[A.ragged(self.piece_off[ids], size)].tobytes()
        first = np.cumsum(counts) - counts
        ends = np.r_[0, np.cumsum(size)]
        out = []
        for f, n in zip(first.tolist(), counts.tolist()):
            text = raw[ends[f] : ends[f + n]]
            if n and self.marked[ids[f]]:
                text = text[1:]
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            out.append(text)
        return out


ENCODED = "doc_id long, ids array<int>"


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text; a null text counts as empty and has no ids."""

    def run(batches):
        m = load(model)
        for b in A.slices(batches, "text", SLICE_BYTES):
            ids, counts = m.encode([t or "" for t in b.column("text").to_pylist()])
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode_documents(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every array of ids; a null array counts as empty."""

    def run(batches):
        m = load(model)
        for b in batches:
            col = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
            ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.diff(col.offsets.to_numpy())
            texts = [t.decode() for t in m.decode(ids, counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass and returns digests of both.

    A null text counts as empty: no tokens, and the digests of the empty string. Repeated rows and ties give
    repeated rows; a null id stays null; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        m = load(model)
        for b in A.slices(batches, "text", SLICE_BYTES):
            ids, counts = m.encode([t or "" for t in b.column("text").to_pylist()])
            first = np.cumsum(counts) - counts
            words = list(map(str, ids.tolist()))
            sha = [hashlib.sha256(",".join(words[f : f + n]).encode()).hexdigest() for f, n in zip(first.tolist(), counts.tolist())]
            back = [hashlib.sha256(t).hexdigest() for t in m.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
