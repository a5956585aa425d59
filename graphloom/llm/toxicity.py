"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score sigmoid(bias + sum of its words' weights); the document's
is their noisy-or, 1 - prod(1 - score). Only documents carry labels; the gradient of the noisy-or passes through to the
sentences, so the weights say which sentences make a document toxic, and those are located with their own scores.

Clean sentences score a little each, so their noisy-or would reach any threshold in a long enough text. A document's
score therefore leaves out MARGIN times what clean sentences have on average, but is never below that of its strongest
sentence: a clean text of any length scores as its strongest sentence does.

Words enter with their first 3 to 6 bytes, their last 4 and whole, as 64-bit hashes. The model is fitted by numpy on a
bounded sample of labelled rows and sent to all tasks: at most MAX_FEATURES weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A

#: Bounds of what is learned from: labelled ids, taken in hash order, and the bytes of their texts together. Texts are
#: taken whole, whatever their length, as long as they stay within MAX_BYTES together.
MAX_ROWS = 10_000
MAX_BYTES = 64_000_000
MAX_FEATURES = 50_000
MIN_DOCS = 3
MIN_Z = 3.0
MARGIN = 2.0  # times the mean mass of clean sentences that a document's sum leaves out
SLICE_BYTES = 1_000_000
EPOCHS, RATE, DECAY = 300, 0.1, 1e-4

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


class Sentences:
    """Words of a slice of texts, the sentence of each, and the sentences of each text (those with a word)."""

    def __init__(self, col: pa.Array):
        raw, self.off = A.utf8(col)
        self.buf = A._LOWER[raw]
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = _WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.off] = True
        before = np.r_[False, inside[:-1]]
        self.starts = np.flatnonzero(inside & (edge | ~before))
        self.lengths = np.flatnonzero(before & (edge | ~inside)) - self.starts
        first = np.searchsorted(self.starts, self.off)
        doc = np.repeat(np.arange(len(col)), np.diff(first))
        ends = np.cumsum(_END[raw], dtype=np.int64)
        place = (ends[self.starts] if len(raw) else np.zeros(0, np.int64)) + doc
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 0) | (np.diff(doc) != 0)
        self.sentence = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)  # each sentence's first word
        self.doc = doc[self.heads]
        self.n_docs = len(col)

    def features(self) -> list[np.ndarray]:
        """One array of hashes over all words for each kind of feature."""
        out = [A.span_hash(self.buf, self.starts, self.lengths, 1)]
        for n in (3, 4, 5, 6):
            out.append(A.span_hash(self.buf, self.starts, np.minimum(self.lengths, n), n + 1))
        tail = np.minimum(self.lengths, 4)
        out.append(A.span_hash(self.buf, self.starts + self.lengths - tail, tail, 9))
        return out


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0
    plain: float = 0.0  # mass, softplus of the logit, that a sentence of clean text has on average

    def index(self) -> A.HashIndex:
        if not hasattr(self, "_index"):
            self._index = A.HashIndex(max(64, 4 * len(self.keys)))
            self._index.add(self.keys)
        return self._index

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "bias": self.bias, "plain": self.plain}

    def logits(self, s: Sentences) -> np.ndarray:
        z = np.zeros(len(s.heads))
        if len(self.keys):
            for h in s.features():
                at = self.index().get(h)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    z += np.bincount(s.sentence[hit], self.weights[at[hit]], len(z))
        return z + self.bias

    def scores(self, s: Sentences) -> np.ndarray:
        """The score of each text; 0 without a sentence."""
        mass = _softplus(self.logits(s))
        strongest = np.zeros(s.n_docs)
        np.maximum.at(strongest, s.doc, mass)
        together = np.bincount(s.doc, mass - MARGIN * self.plain, s.n_docs)
        return -np.expm1(-np.maximum(strongest, together))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """The noisy-or model of labelled whole texts; without both labels, one that scores 0."""
    y = np.asarray(labels) > 0
    if not y.any() or y.all():
        return Model()
    # Features that occur in more documents of a label than chance has it.
    rows = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(y)))], ["text", "row"])
    keys, pos, neg = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    for b in A.slices([rows], "text", SLICE_BYTES):
        s = Sentences(b.column("text"))
        row = b.column("row").to_numpy()[s.doc][s.sentence]
        k = np.concatenate(s.features())
        d = np.tile(row, len(k) // max(len(row), 1)) if len(row) else row
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        once = np.ones(len(k), bool)
        once[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, t = k[once], y[d[once]]
        k, inv = np.unique(k, return_inverse=True)
        bad = np.bincount(inv, t, len(k)).astype(np.int32)
        good = np.bincount(inv, minlength=len(k)).astype(np.int32) - bad
        # Sorted keys: known ones count on, new ones are put in between.
        at = np.searchsorted(keys, k)
        old = at < len(keys)
        old[old] = keys[at[old]] == k[old]
        pos[at[old]] += bad[old]
        neg[at[old]] += good[old]
        keys, pos, neg = (np.insert(x, at[~old], new[~old]) for x, new in ((keys, k), (pos, bad), (neg, good)))
    n1, n0 = int(y.sum()), int((~y).sum())
    share = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z[pos + neg < MIN_DOCS] = 0
    chosen = np.flatnonzero(np.abs(z) > MIN_Z)
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:MAX_FEATURES]]
    model = Model(keys[chosen], np.zeros(len(chosen)), -6.0)
    if not len(chosen):
        return Model()
    # Sparse sentence rows over the chosen features.
    sent, feat, doc, base = [], [], [], 0
    for b in A.slices([rows], "text", SLICE_BYTES):
        s = Sentences(b.column("text"))
        for h in s.features():
            at = model.index().get(h)
            hit = np.flatnonzero(at >= 0)
            sent.append(s.sentence[hit] + base), feat.append(at[hit].astype(np.int64))
        doc.append(b.column("row").to_numpy()[s.doc])
        base += len(s.heads)
    sent, feat, doc = np.concatenate(sent), np.concatenate(feat), np.concatenate(doc)
    # Sentences without any feature of one document behave alike: they count, but share one logit.
    used, inv = np.unique(sent, return_inverse=True)
    plain = np.bincount(doc, minlength=len(y)) - np.bincount(doc[used], minlength=len(y))
    owner = doc[used]
    theta, m, v = np.r_[model.weights, model.bias], 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        zs = theta[-1] + np.bincount(inv, theta[feat], len(used))
        a = np.bincount(owner, _softplus(zs), len(y)) + plain * _softplus(theta[-1])
        pull = np.where(y, -1 / np.expm1(np.clip(a, 1e-9, 500)), 1.0) / len(y)  # d loss / d sum of softplus
        slope = pull[owner] / (1 + np.exp(-np.clip(zs, -500, 500)))
        g = np.r_[np.bincount(feat, slope[inv], len(theta) - 1), slope.sum() + (pull * plain).sum() / (1 + np.exp(-theta[-1]))]
        g[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    kept = np.abs(theta[:-1]) > 0.02
    theta[:-1][~kept] = 0
    zs = theta[-1] + np.bincount(inv, theta[feat], len(used))
    clean = _softplus(zs)[~y[owner]].sum() + plain[~y].sum() * _softplus(theta[-1])
    return Model(model.keys[kept], theta[:-1][kept], float(theta[-1]), float(clean / max((~y[doc]).sum(), 1)))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most max_rows labelled documents, taken in the order of a hash of their id up to max_bytes of text.

    may_learn: a condition on the id column of labels. Rows without a label or an id teach nothing, nor do ids whose rows
    have more than max_bytes of text together, where all do not fit; a null text is empty. An empty table gives a model
    that scores 0.
    """
    found = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    if may_learn is not None:
        found = labels.where(may_learn).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    found = found.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    found = found.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = F.broadcast(found)  # max_rows rows at most
    sizes = texts.join(found, "id").groupBy("id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).select("id", "bytes", F.xxhash64("id").alias("place")).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    upto = np.cumsum(sizes["bytes"].to_numpy())
    if (upto > max_bytes).any():
        sizes = sizes.filter(pa.array(sizes["bytes"].to_numpy() <= max_bytes))  # an id with more text than that would be all there is
        upto = np.cumsum(sizes["bytes"].to_numpy())
        ids = sizes["id"].filter(pa.array(upto <= max_bytes)).to_pylist()
        found = F.broadcast(found.join(docs.sparkSession.createDataFrame([(i,) for i in ids], "id long"), "id"))
    got = texts.join(found, "id").select("id", "text", "label").distinct().toArrow()
    if not got.num_rows:
        return Model()
    got = got.sort_by([("id", "ascending"), ("text", "ascending")]).slice(0, max_rows)
    texts, labels = pa.concat_arrays(got["text"].chunks), got["label"].to_numpy()
    del got
    try:
        return fit(texts, labels)
    finally:
        del texts
        A.release()


def score(df: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 at threshold or above) of every whole text.

    A null or empty text has no sentence and scores 0. Repeated rows give equal rows; a null id stays null; other
    columns are ignored; an empty table gives an empty result. A very long text is scored as a whole, by itself.
    """

    def run(batches):
        for b in A.slices(batches, "text", SLICE_BYTES):
            s = Sentences(b.column("text"))
            p = model.scores(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def offending_sentences(df: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentences that score threshold or above: doc_id, byte start and end in the text's UTF-8, score and text.

    A null or empty text has none, equal sentences of a text are a row each, repeated rows give equal rows, a null id
    stays null, other columns are ignored, and an empty table gives an empty result.
    """

    def run(batches):
        for b in A.slices(batches, "text", SLICE_BYTES):
            s = Sentences(b.column("text"))
            p = 1 / (1 + np.exp(-model.logits(s)))
            raw, _ = A.utf8(b.column("text"))
            ends = np.r_[s.heads[1:], len(s.starts)] - 1
            ids, out = b.column("doc_id").to_pylist(), []
            for i in np.flatnonzero(p >= threshold).tolist():
                d, lo = int(s.doc[i]), int(s.starts[s.heads[i]])
                hi = int(s.starts[ends[i]] + s.lengths[ends[i]])
                out.append((ids[d], lo - int(s.off[d]), hi - int(s.off[d]), float(p[i]), raw[lo:hi].tobytes().decode("utf-8", "replace")))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "start", "end", "score", "sentence"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")


def keep(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose score is below threshold; null and empty texts stay.

    Only the texts go to the Python workers and only scores come back. Rows of a null id and repeated rows are judged
    like others; an empty table gives an empty result; a very long text is scored as a whole.
    """

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(Sentences(b.column("text"))) for b in A.slices([rows], "text", SLICE_BYTES))]))

    return df.where(scores(F.col(text_col).cast("string")) < threshold)
