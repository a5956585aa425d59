"""Ids of a byte-level BPE tokenizer for batches of texts, exactly as the tokenizers library gives them.

The library's work on a text is a split into words and a merge within each word. Here numpy splits whole batches, and
only words not met before are merged, by tiktoken, whose merges by rank are the library's wherever the ids of the
model follow its merge list (checked when it is loaded; otherwise the library merges them). Texts with characters outside the range whose classes are fixed below
go to the library whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from graphloom.llm import arrays as A

CACHE_WORDS = 1_500_000
#: Words joined into one text for the library.
JOINED = 5_000
#: Characters split here; texts with any other go to the library.
TOP = 0x250
#: The split pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(TOP, OTHER, np.int8)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


def splits(cp: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Where the words of texts, given as code points one after another, start."""
    n = len(cp)
    kind = CLASSES[cp]
    edge = np.zeros(n + 1, bool)
    edge[doc_first] = True
    edge[n] = True
    head = edge[:-1].copy()
    head[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(head)
    ends = np.r_[runs[1:], n]
    k = kind[runs]
    start = np.zeros(n + 1, bool)
    start[runs] = True
    # A run of white space before another run gives its last character away: a blank joins that run, another stands alone.
    sp = np.flatnonzero(k == SPACE)
    follows = ~edge[ends[sp]]
    sp = sp[follows]
    last = ends[sp] - 1
    blank = cp[last] == 32
    start[last] = True
    start[ends[sp][blank]] = False
    # An apostrophe run of one that no blank joins takes a contraction's letters from the run after it.
    q = np.flatnonzero((k == OTHER) & (ends - runs == 1) & (cp[runs] == 39) & (ends < n))
    q = q[start[runs[q]] & ~edge[ends[q]]]
    if len(q):
        a = ends[q]
        room = np.where(k[np.minimum(q + 1, len(k) - 1)] == LETTER, ends[np.minimum(q + 1, len(ends) - 1)] - a, 0)
        c1, c2 = cp[a], cp[np.minimum(a + 1, n - 1)]
        pair = c1.astype(np.int64) * 4096 + c2
        two = (room >= 2) & np.isin(pair, [ord(x) * 4096 + ord(y) for x, y in ("re", "ve", "ll")])
        one = (room >= 1) & np.isin(c1, [ord(c) for c in "stmd"])
        take = np.where(one, 1, np.where(two, 2, 0))
        hit = take > 0
        start[a[hit]] = False
        start[(a + take)[hit]] = True
    start[n] = False
    return np.flatnonzero(start)


class Encoder:
    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.library.get_vocab_size()
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec.get("pre_tokenizer") or {}
        self.fast = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.ranks = self._ranks(spec) if self.fast else None
        self.cache = A.SpanCache(CACHE_WORDS)

    def _ranks(self, spec: dict):
        """A merger of joined words and each id's length in bytes, if ranks and ids agree."""
        import tiktoken

        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model.get("type") not in (None, "BPE") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        # The byte alphabet of this kind of vocabulary: printable bytes stand for themselves, the others follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        if len(ranks) != 256 + len(merges):
            return None
        self.id_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.id_bytes[i] = len(t)
        return tiktoken.Encoding("joined words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts (null: empty) and each text's count of ids."""
        texts = [t or "" for t in col.to_pylist()]
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(n) - n
        if not self.fast:
            return self._whole(texts)
        odd = A.sums((cp >= TOP).astype(np.int8), np.r_[first, len(cp)]) > 0
        if odd.any():
            easy = np.flatnonzero(~odd)
            hard = np.flatnonzero(odd)
            ids_h, n_h = self._whole([texts[i] for i in hard])
            ids_e, n_e = self._split(cp[A.ragged(first[easy], n[easy])], n[easy])
            counts = np.zeros(len(texts), np.int64)
            counts[easy], counts[hard] = n_e, n_h
            source = np.zeros(len(texts), np.int64)
            source[easy] = np.cumsum(n_e) - n_e
            source[hard] = len(ids_e) + np.cumsum(n_h) - n_h
            return np.concatenate([ids_e, ids_h])[A.ragged(source, counts)], counts
        return self._split(cp, n)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array([len(x) for x in ids], np.int64)

    def _split(self, cp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(n), np.int64)
        first = np.cumsum(n) - n
        starts = splits(cp, first[n > 0])
        lengths = np.diff(np.r_[starts, len(cp)])
        short = cp.astype(np.uint16)
        keys = A.span_hash(short.view(np.uint8), starts * 2, lengths * 2)
        ids, counts = self.cache.lookup(keys, lambda at: self._learn(cp, starts[at], lengths[at]))
        per = A.sums(counts, np.searchsorted(starts, np.r_[first, len(cp)])).astype(np.int64)
        return ids, per

    def _learn(self, cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(lengths)
        text = cp[A.ragged(starts, lengths)].tobytes().decode("utf-32-le", "surrogatepass")
        words = [text[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
        # Words of a blank and letters split the same way when joined, so they go to the library as one text.
        joined = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and CLASSES[ord(w[1])] == LETTER]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(joined), JOINED):
            mine = joined[lo : lo + JOINED]
            if self.ranks is not None:
                chosen = [words[i] for i in mine]
                ids = np.array(self.ranks.encode_ordinary("".join(chosen)), np.int64)
                ends = np.cumsum([len(w.encode()) for w in chosen])
                parts.append((np.array(mine)[np.searchsorted(ends, np.cumsum(self.id_bytes[ids]), "left")], ids))
                continue
            e = self.library.encode("".join(words[i] for i in mine), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            if word[-1] + 1 != len(mine):
                raise ValueError("joined words were not split as expected")
            parts.append((np.array(mine)[word], np.array(e.ids, np.uint32)))
        alone = sorted(set(range(len(words))) - set(joined))
        found = [e.ids for e in self.library.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
        parts.append((np.repeat(np.array(alone, np.int64), [len(x) for x in found]), np.fromiter((i for x in found for i in x), np.uint32)))
        owner, flat = (np.concatenate(x) for x in zip(*parts))
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


CLASSES = _classes()
