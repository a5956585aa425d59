"""Language-model scores by deleted interpolation.

P(w | v) = l2 * c(vw) / c(v) + l1 * c(w) / N + l0 / (V + 1), maximum-likelihood estimates of both orders and a uniform
share; the weights l depend on the bucket (power of two) of the context's count and are learned by expectation-
maximisation on counts held out from the estimates: the n-grams of one in HELD training documents, by a hash of the id,
are counted apart, taken out of the counts, and explained by what is left. The final estimates use all training counts.
No number of parts or partitions changes a score.

Documents are dealt to parts, the held-out ones to parts of their own. A part asks for the counts of its distinct words and word pairs, each once, from the parts
that own them by hash; those add up what all parts have sent and answer in the same order. So counting and scoring
shuffle each distinct pair of a part once each way, frequent ones no more often than rare ones, and no vocabulary goes
to one task or to the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm import parts as P
from graphloom.llm.sparkio import materialise, on_group, on_pair

END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x9E6C63D0676A9A99)
HELD = 10  # one in so many documents is held out for the weights
ADD = 0.1  # of the base score
BUCKETS = 32
STEP = 0.05  # of the natural logarithms in the histogram that the weights are learned from
ROUNDS = 60
NO_ID = -(2**63)
WORDS, PAIRS, TOTALS = 0, 1, 2
ASKED = "owner int, kind int, part int, n_raw long, blob binary"
TOLD = "part int, kind int, owner int, n_raw long, blob binary"


def in_training(ids: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of the id as text, modulo folds, is not 0; a null id is never in training."""
    return np.fromiter((i != NO_ID and zlib.crc32(str(i).encode()) % folds != 0 for i in ids.tolist()), bool, len(ids))


def held_out(ids: np.ndarray) -> np.ndarray:
    """Whether a document's counts are for the weights. A null id's are not."""
    return (A.mix(ids.view(np.uint64) + A.U64(0x7C15F39CC0605CED)) % A.U64(HELD) == 0) & (ids != NO_ID)


def _place(n_main: int, n_parts: int):
    """Parts from n_main on hold the held-out documents. Rows of a null id, which may be many, are dealt by their text."""

    def run(ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        by = np.where(ids == NO_ID, kinds.view(np.int64), ids)
        return np.where(held_out(ids), n_main + P.part_of(by, n_parts - n_main), P.part_of(by, n_main)).astype(np.int32)

    return run


class Tokens:
    """The tokens of a part's documents: words, then an end; and the distinct words and pairs."""

    def __init__(self, d: P.Documents):
        w = A.Words(d.texts)
        n = w.counts + 1
        self.first = np.r_[0, np.cumsum(n)]
        total = int(self.first[-1])
        last = self.first[1:] - 1
        word = np.empty(total, np.uint64)
        inner = np.ones(total, bool)
        inner[last] = False
        word[inner] = w.hashes()
        word[last] = END
        context = np.empty(total, np.uint64)
        context[1:] = word[:-1]
        context[self.first[:-1]] = START
        self.doc = np.repeat(np.arange(len(n)), n)
        self.words, self.word = np.unique(np.r_[word, END], return_inverse=True)
        self.word = self.word[:-1]
        self.end = int(np.searchsorted(self.words, END))
        self.pairs, self.pair = np.unique(A.mix(context * A.U64(0x9FB21C651E98DF25) + A.mix(word)), return_inverse=True)
        self.context = np.empty(total, np.int64)
        self.context[1:] = self.word[:-1]
        self.context[self.first[:-1]] = self.end  # texts start as often as they end


def _dealt(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sorted keys by owner (in order within each), and where each owner's start."""
    owner = (keys % A.U64(n_parts)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(n_parts + 1))


def _ask(n_parts: int, folds: int):
    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        d = P.unpack_documents(rows)
        t = Tokens(d)
        train = in_training(d.ids, folds)[t.doc]
        out = []
        for kind, keys, at in ((WORDS, t.words, t.word), (PAIRS, t.pairs, t.pair)):
            counts = np.bincount(at[train], minlength=len(keys))
            order, cut = _dealt(keys, n_parts)
            for q in range(n_parts):
                mine = order[cut[q] : cut[q + 1]]
                if len(mine):
                    out.append((q, kind, part, *P.squeeze(np.diff(keys[mine] // A.U64(n_parts), prepend=A.U64(0)), _small(counts[mine]))))
        return _table(out, ["owner", "kind", "part"])

    return run


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint64)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], [*names, "n_raw", "blob"])


def _answer(n_main: int):
    """Totals of an owner's keys for each part that asked: all counts, and for held-out parts also the held-out ones."""

    def run(rows: pa.Table) -> pa.Table:
        return _totals(rows, n_main)

    return run


def _totals(rows: pa.Table, n_main: int) -> pa.Table:
    kind, owner = rows.column("kind")[0].as_py(), rows.column("owner")[0].as_py()
    parts = rows.column("part").to_pylist()
    keys, counts = zip(*(P.expand(n, z) for n, z in zip(rows.column("n_raw").to_pylist(), rows.column("blob").to_pylist())))
    size = np.array([len(k) for k in keys])
    every, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in keys]), return_inverse=True)
    counts = np.concatenate(counts).astype(np.int64)
    total = np.bincount(at, counts, len(every)).astype(np.int64)
    apart = np.repeat(np.array(parts) >= n_main, size)
    held = np.bincount(at[apart], counts[apart], len(every)).astype(np.int64)
    out, lo = [], 0
    for p, n in zip(parts, size.tolist()):
        mine = at[lo : lo + n]
        lo += n
        out.append((p, kind, owner, *P.squeeze(_small(total[mine]), *([_small(held[mine])] if p >= n_main else []))))
    if kind == WORDS:
        out.append((-1, TOTALS, owner, *P.squeeze(np.array([total.sum(), held.sum(), (total > 0).sum()]))))
    return _table(out, ["part", "kind", "owner"])


def _counts(t: Tokens, told: pa.Table, n_parts: int) -> tuple[np.ndarray, ...]:
    """All and held-out counts of a part's words and pairs, from the answers."""
    out = []
    for kind, keys in ((WORDS, t.words), (PAIRS, t.pairs)):
        order, cut = _dealt(keys, n_parts)
        total, held = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        seen = 0
        for k, q, n, z in zip(*(told.column(c).to_pylist() for c in ("kind", "owner", "n_raw", "blob"))):
            if k == kind:
                got = P.expand(n, z)
                mine = order[cut[q] : cut[q + 1]]
                if len(mine) != len(got[0]):
                    raise RuntimeError("an answer does not fit the part that asked")
                total[mine] = got[0]
                if len(got) > 1:
                    held[mine] = got[1]
                seen += len(mine)
        if seen != len(keys):
            raise RuntimeError("an answer is missing")
        out += [total, held]
    return tuple(out)


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of its base-2 logarithm."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64).clip(0, BUCKETS - 1)


@dataclass
class Weights:
    """Weights of the pair, word and uniform estimates by context bucket, and the corpus totals."""

    by_bucket: np.ndarray
    tokens: int
    vocabulary: int

    def probabilities(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.by_bucket[_bucket(context)]
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
        p1 = word / max(self.tokens, 1)
        return w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (self.vocabulary + 1)


def _histogram(n_parts: int, folds: int, tokens: int, vocabulary: int):
    """Held-out tokens by bucket and by the logarithms of both estimates against the uniform one, in steps."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, ["bucket", "pair", "word", "n"])
        d = P.unpack_documents(docs)
        t = Tokens(d)
        train = np.flatnonzero(in_training(d.ids, folds)[t.doc])
        word, word_held, pair, pair_held = _counts(t, told, n_parts)
        c1, c2 = (word - word_held)[t.word[train]], (pair - pair_held)[t.pair[train]]
        cv = (word - word_held)[t.context[train]]
        base = np.log(vocabulary + 1)
        with np.errstate(divide="ignore"):
            q2 = np.where(c2 > 0, np.rint((np.log(np.maximum(c2, 1)) - np.log(np.maximum(cv, 1)) + base) / STEP), -1000000).astype(np.int64)
            q1 = np.where(c1 > 0, np.rint((np.log(np.maximum(c1, 1)) - np.log(max(tokens, 1)) + base) / STEP), -1000000).astype(np.int64)
        cells, n = np.unique(np.stack([_bucket(cv), q2, q1]), axis=1, return_counts=True)
        return pa.table([pa.array(c) for c in (*cells, n)], ["bucket", "pair", "word", "n"])

    return run


def learn_weights(cells: np.ndarray) -> np.ndarray:
    """Weights by bucket from rows (bucket, pair, word, n) of the histogram, by expectation-maximisation.

    A bucket without held-out tokens takes the weights of all together; without any, fixed ones.
    """
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    if not len(cells):
        out[0] = [0, 0.6, 0.4]
        return out

    def fit(rows: np.ndarray) -> np.ndarray:
        p = np.stack([np.exp(np.where(rows[:, k] > -1000000, rows[:, k] * STEP, -np.inf)) for k in (1, 2)] + [np.ones(len(rows))], 1)
        n = rows[:, 3].astype(float)
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(ROUNDS):
            share = w * p
            share = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) + 0.1
            w = share / share.sum()
        return w

    cells = cells[np.lexsort(cells.T)]  # one order of summing, whatever the tasks
    out[:] = fit(cells)
    for b in np.unique(cells[:, 0]):
        out[b] = fit(cells[cells[:, 0] == b])
    out[0, 0] = 0  # a context never seen has no pair estimate
    out[0] /= out[0].sum()
    return out


def _score(n_parts: int, folds: int, weights: Weights):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        d = P.unpack_documents(docs)
        t = Tokens(d)
        word, _, pair, _ = _counts(t, told, n_parts)
        c = word[t.word]
        p = weights.probabilities(pair[t.pair], word[t.context], c)
        base = np.log10((word + ADD) / (weights.tokens + ADD * (weights.vocabulary + 1)))[t.word]
        score = np.add.reduceat(np.log10(p), t.first[:-1])
        return pa.table(
            [
                pa.array(d.ids, mask=d.ids == NO_ID),
                pa.array(~in_training(d.ids, folds)),
                pa.array(np.diff(t.first)),
                pa.array(np.add.reduceat((c > 0).astype(np.int64), t.first[:-1])),
                pa.array(np.full(len(d.ids), weights.tokens, np.int64)),
                pa.array(np.add.reduceat(base, t.first[:-1])),
                pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text under a model of the texts whose crc32(id as text) mod folds is not 0.

    A null or empty text is the end token alone. A null id stays null, is held out and teaches nothing. Repeated rows
    count and are scored each. With no training text the model is uniform over one unknown word; where all training
    documents are held out from the estimates, or none is, the weights are fixed ones. A very long text is one document
    of its part and in memory as a whole. Other columns are ignored; an empty table gives an empty result.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_main = P.count_parts(docs)
    n_parts = n_main + -(-n_main // (HELD - 1))
    packed = P.pack_documents(docs, n_parts, _place(n_main, n_parts))
    asked = packed.groupBy("part").applyInArrow(on_group(_ask(n_parts, folds)), ASKED)
    told = materialise(asked.groupBy("owner", "kind").applyInArrow(on_group(_answer(n_main)), TOLD), "lm-counts")
    totals = told.where(F.col("kind") == TOTALS).select("n_raw", "blob").toArrow()  # three numbers from each part
    sums = sum((P.expand(n, z)[0] for n, z in zip(totals["n_raw"].to_pylist(), totals["blob"].to_pylist())), np.zeros(3, np.int64))
    tokens, held, vocabulary = (int(x) for x in sums)
    replies = told.where(F.col("kind") != TOTALS)
    cells = np.zeros((0, 4), np.int64)
    if held < tokens:
        apart = F.col("part") >= n_main
        found = packed.where(apart).groupBy("part").cogroup(replies.where(apart).groupBy("part")).applyInArrow(on_pair(_histogram(n_parts, folds, tokens - held, vocabulary)), "bucket long, pair long, word long, n long")
        grid = found.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toArrow()  # as many cells at most as the grid of logarithms has
        cells = np.stack([grid[c].to_numpy() for c in ("bucket", "pair", "word", "n")], 1)
    weights = Weights(learn_weights(cells), tokens, vocabulary)
    return packed.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(on_pair(_score(n_parts, folds, weights)), SCORED)
