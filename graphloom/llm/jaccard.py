"""N-gram Jaccard join with adaptive multi-match prefixes, down to connected components.

Texts become sets of word shingles. Equal sets are one class and only its document of the smallest id goes on, so copies
never meet each other. Shingles are counted over all classes: documents lie in parts, each part sends its distinct
shingles, as short hashes, to the parts that own them, and gets the counts back in the same order. Each set is ordered by
count, rare shingles first, and keeps a prefix: as long as a pair of the wanted similarity must share one shingle of it,
plus one for each further match asked for. How many matches a document asks for follows from the sets its prefix meets by
those counts.

How long a prefix must be depends on both sizes of a pair, so sets lie in bands of size and post their shingles for each
band that a linked larger set may have, with their place in the order; a pair meets in the band of the larger one and
counts only shingles within the prefixes that its two sizes ask for. A set with more shingles of its own than a link to a
band leaves room for posts nothing there: edited copies too far from all others fall out before any join. A pair is
verified, on the texts themselves, when it shares as many prefix shingles as the less demanding of the two asks for.

Groups of near copies would make every pair of theirs a candidate. As only components are asked for, seed rounds verify
a few pairs for each set and posting, in a line and with the posting's first set, which is one that shares most of its
prefix (an original among its edited copies); later rounds go on with sets whose component still differs, as long as
their postings are large. The last round counts and verifies every other pair of different components: sets outside a
posting's largest component against all in it. So no link that matters is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm import parts as P
from graphloom.llm.sparkio import materialise, on_group, on_pair, partitions
from graphloom.operators.components import connected_components

WIDTH = 5
#: The similarity as percent: linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
MAX_MATCHES = 4
SEEDS = 6  # pairs of the first round for each set, about, beyond those of small postings
ROUNDS = 4  # seed rounds at most; they end when one finds no link or few pairs are left
FEW = 4  # pairs to look at for each row of the postings that are few enough for the last round
STEPS = 4  # bands of size up to the ratio of sizes that may be linked
SLICE_BYTES = 1_000_000
SMALL = 50_000  # links of which one task finds the components, 16 bytes each; beyond, joins do


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted within it), each text's first one, and the texts' numbers."""
    w = A.Words(col)
    h, first = A.shingles(w.hashes(), w.first, WIDTH)
    doc = np.repeat(np.arange(len(col)), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[once], doc[once]
    return h, np.searchsorted(doc, np.arange(len(col) + 1)), doc


def _classes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; equal sets have equal names. Empty sets: -1."""
    n = np.diff(first)
    total = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(A.mix(h * A.U64(0x9FB21C651E98DF25)), first[:-1][some])
    name = (A.mix(total + n.astype(np.uint64) * A.U64(0x632BE59BD9B4E019)) >> A.U64(1)).astype(np.int64)
    return np.where(some, name, -1)


ASKED = "owner int, part int, n_raw long, blob binary"
TOLD = "part int, owner int, n_raw long, blob binary"


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], [*names, "n_raw", "blob"])


class _Part:
    """The sets of a part's documents that stand for their class, their distinct short hashes, and where those are owned."""

    def __init__(self, d: P.Documents, rows: np.ndarray, n_parts: int, bits: int):
        hs, sizes, names = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in A.slices([pa.RecordBatch.from_arrays([d.texts.take(pa.array(rows))], ["text"])], "text", SLICE_BYTES):
            h, first, _ = _sets(b.column("text"))
            hs.append(h), sizes.append(np.diff(first)), names.append(_classes(h, first))
        self.h, self.names = np.concatenate(hs), np.concatenate(names)
        self.first = np.r_[0, np.cumsum(np.concatenate(sizes))]
        self.short, self.at, self.n = np.unique(self.h >> A.U64(64 - bits), return_inverse=True, return_counts=True)
        owner = (self.short % A.U64(n_parts)).astype(np.int32)
        self.order = np.argsort(owner, kind="stable")
        self.cut = np.searchsorted(owner[self.order], np.arange(n_parts + 1))


def _chosen(d: P.Documents, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One row of the part's documents for each (id, class): the id's first row of that class."""
    order = np.argsort(ids, kind="stable")
    ids, classes = ids[order], classes[order]
    rows = np.flatnonzero(np.isin(d.ids, ids))
    if len(rows) == len(ids) and (np.diff(d.ids[rows]) > 0).all():
        return rows  # one row and one class each
    wish, out = set(zip(ids.tolist(), classes.tolist())), []
    for b in A.slices([pa.RecordBatch.from_arrays([d.texts.take(pa.array(rows)), pa.array(rows)], ["text", "row"])], "text", SLICE_BYTES):
        h, first, _ = _sets(b.column("text"))
        for row, name in zip(b.column("row").to_pylist(), _classes(h, first).tolist()):
            if (int(d.ids[row]), name) in wish:
                wish.discard((int(d.ids[row]), name))
                out.append(row)
    if wish:
        raise RuntimeError("a class has lost its document")
    return np.array(out, np.int64)


def _ask(n_parts: int, bits: int):
    """A part's distinct short hashes to their owners, and to itself the documents that it uses."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return _rows([], ["owner", "part"])
        part, d = docs.column("part")[0].as_py(), P.unpack_documents(docs)
        rows = _chosen(d, wanted.column("doc_id").to_numpy(), wanted.column("class").to_numpy())
        p, out = _Part(d, rows, n_parts, bits), [(-1 - part, part, *P.squeeze(rows))]
        for q in range(n_parts):
            mine = p.order[p.cut[q] : p.cut[q + 1]]
            if len(mine):
                step = np.diff(p.short[mine] // A.U64(n_parts), prepend=A.U64(0))
                out.append((q, part, *P.squeeze(step.astype(np.uint32) if step.max() < 1 << 32 else step, np.minimum(p.n[mine], 65535).astype(np.uint16))))
        return _rows(out, ["owner", "part"])

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """How many classes have each short hash."""
    if rows.column("owner")[0].as_py() < 0:
        return rows.select(["part", "owner", "n_raw", "blob"])
    got = [P.expand(n, z) for n, z in zip(rows.column("n_raw").to_pylist(), rows.column("blob").to_pylist())]
    every, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in got]), return_inverse=True)
    total = np.minimum(np.bincount(at, np.concatenate([n for _, n in got])), 2**31 - 1).astype(np.uint32)
    out, lo, owner = [], 0, rows.column("owner")[0].as_py()
    for part, (k, _) in zip(rows.column("part").to_pylist(), got):
        out.append((part, owner, *P.squeeze(total[at[lo : lo + len(k)]])))
        lo += len(k)
    return _rows(out, ["part", "owner"])


def _overlap(n, other, percent: int):
    """The shingles that linked sets of these sizes share at least."""
    return -(-percent * (n + other) // (100 + percent))


def _prefixes(h: np.ndarray, first: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Prefix shingles that other sets may have, their sets' numbers, each set's matches, and the shingles' places in the order.

    A set with more shingles of its own than any link leaves room for has none.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, counts, doc))
    h, c = h[order], counts[order].astype(np.int64)
    least = -(-percent * n // 100)  # shingles that a linked set shares at least
    equal = _overlap(n, n, percent)  # that one of the same size shares
    met_by = np.r_[0, np.cumsum(c - 1)]
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, MAX_MATCHES + 1):
        size = np.minimum(n - equal + m, n)
        met = met_by[first[:-1] + size] - met_by[first[:-1]]  # sets met in the prefix
        cost = size + met / 2.0 ** (m - 1)
        better = (cost < best) & (m <= np.maximum(least, 1))
        best, matches = np.where(better, cost, best), np.where(better, m, matches)
    own = _own(doc, c, len(n))
    size = np.where(own > n - least, 0, np.minimum(n - least + matches, n))
    at = A.ragged(first[:-1], size)
    owner = np.repeat(np.arange(len(n)), size)
    place = at - first[:-1][owner]
    shared = c[at] > 1
    return h[at][shared], owner[shared], matches, place[shared]


def _own(doc: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """How many shingles no other set has, of each set."""
    return np.bincount(doc[counts == 1], minlength=n_docs)


def _edges(percent: int, top: int) -> np.ndarray:
    """The least size of each band, up to one beyond top."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(out[-1] * (100 / percent) ** (1 / STEPS))))
    return np.array(out)


def _entries(tokens: np.ndarray, owner: np.ndarray, matches: np.ndarray, place: np.ndarray, n: np.ndarray, own: np.ndarray, percent: int):
    """Rows of the postings: key of shingle and band, set, place, and whether the band is the set's own."""
    edges = _edges(percent, int(n.max(initial=1)) * 100 // percent + 1)
    band = np.searchsorted(edges, n, "right") - 1
    keys, sets, places, home = [], [], [], []
    at, step = np.arange(len(tokens)), 0
    while len(at):
        d = owner[at]
        to = band[d] + step
        keys.append(A.mix(tokens[at] + A.mix(to.astype(np.uint64) + A.U64(0x3C6EF372FE94F82B))))
        sets.append(d), places.append(place[at]), home.append(np.full(len(at), step == 0))
        step += 1
        least = edges[np.minimum(band + step, len(edges) - 1)]  # of the next band
        room = n - _overlap(n, least, percent)
        room = np.where((100 * n >= percent * least) & (own <= room), room + matches, 0)
        at = np.flatnonzero(place < room[owner])
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in ((keys, np.uint64), (sets, np.int64), (places, np.int64), (home, bool)))


POSTED = "key long, class long, n int, place int, apart int, matches int, home boolean"


def _postings(n_parts: int, bits: int, percent: int):
    """Rows of the postings; apart: how little of its shingles others have, of 1000."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _posted([np.zeros(0, np.int64)] * 6 + [np.zeros(0, bool)])
        d, answers = P.unpack_documents(docs), list(zip(*(told.column(k).to_pylist() for k in ("owner", "n_raw", "blob"))))
        rows = next(P.expand(k, z)[0] for q, k, z in answers if q < 0)
        p = _Part(d, rows, n_parts, bits)
        total = np.zeros(len(p.short), np.int64)
        for q, k, z in answers:
            if q >= 0:
                total[p.order[p.cut[q] : p.cut[q + 1]]] = P.expand(k, z)[0]
        if (total == 0).any():
            raise RuntimeError("an answer is missing")
        counts, n = total[p.at], np.diff(p.first)
        own = _own(np.repeat(np.arange(len(n)), n), counts, len(n))
        tokens, owner, matches, place = _prefixes(p.h, p.first, counts, percent)
        key, x, place, home = _entries(tokens, owner, matches, place, n, own, percent)
        return _posted([key.view(np.int64), p.names[x], n[x], place, (1000 * own // np.maximum(n, 1))[x], matches[x], home])

    return run


def _posted(columns: list[np.ndarray]) -> pa.Table:
    names = ["key", "class", "n", "place", "apart", "matches", "home"]
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.bool_()]
    return pa.table([pa.array(c.astype(np.int32) if t == pa.int32() else c, t) for c, t in zip(columns, types)], names)


def _seeds(percent: int, seeds: int):
    """Pairs of a sorted posting: each set with the one before it and with the first, where sizes and places allow."""
    columns = ("key", "class", "n", "place", "matches", "home")

    def run(batches):
        carry = None  # the posting's first row, the row before, and the rows so far
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(k).to_numpy(zero_copy_only=False) for k in columns]
            added, before = 0, 0
            if carry and carry[0][0] == rows[0][0]:
                rows = [np.r_[carry[0][k], carry[1][k], c] for k, c in enumerate(rows)]
                added, before = 2, carry[2] - 2
            key, c, n, place, matches, home = rows
            i = np.arange(len(key))
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            lead = np.maximum.accumulate(np.where(head, i, 0))
            rank = i - lead + np.where(lead == 0, before, 0)
            n = n.astype(np.int64)
            size = np.maximum(n - _overlap(n, n, percent) + 1, 1)
            draw = (A.mix((key ^ c).view(np.uint64)) % size.astype(np.uint64)).astype(np.int64) < seeds
            k = np.flatnonzero((rank > 0) & (i >= added) & ((rank < 3) | draw))
            x, y = np.r_[lead[k], k - 1], np.r_[k, k]
            m = np.minimum(matches[x], matches[y])
            room = m - _overlap(n[x], n[y], percent)
            fits = (c[x] != c[y]) & (home[x] | home[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            fits &= (place[x] < n[x] + room) & (place[y] < n[y] + room)
            x, y = c[x[fits]], c[y[fits]]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            carry = ([r[lead[-1]] for r in rows], [r[-1] for r in rows], rank[-1] + 1)

    return run


def _verify(percent: int):
    """Whether the two texts of each row are linked: exact counts of their distinct shingles."""

    def run(batches):
        for b in batches:
            for s in A.slices([b], "text_a", SLICE_BYTES):
                for r in A.slices([s], "text_b", SLICE_BYTES):
                    ha, fa, da = _sets(r.column("text_a"))
                    hb, fb, db = _sets(r.column("text_b"))
                    h, d = np.r_[ha, hb], np.r_[da, db]
                    order = np.lexsort((h, d))
                    h, d = h[order], d[order]
                    twice = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
                    both = np.bincount(d[1:][twice], minlength=r.num_rows)
                    union = np.diff(fa) + np.diff(fb) - both
                    yield pa.RecordBatch.from_arrays([r.column("a"), r.column("b"), pa.array((100 * both >= percent * union) & (both > 0))], ["a", "b", "linked"])

    return run


def _checked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long, linked boolean")


def components(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    class_id is the smallest id with the same shingle set, component_id the smallest id reachable by links. A null or
    empty text, or one of white space, has no shingle and is linked with nothing. Rows of a null id keep it, take no part
    and have a null class_id and component_id. Repeated rows give equal rows; other columns are ignored; an empty table
    gives an empty result. A very long text is one set, held as a whole in the task of its part and of its pairs.
    """
    spark = df.sparkSession
    n_parts = partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = rows.where("doc_id is not null")

    def name(batches):
        for b in A.slices(batches, "text", SLICE_BYTES):
            h, first, _ = _sets(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(_classes(h, first))], ["doc_id", "n_shingles", "class"])

    named = materialise(rows.mapInArrow(name, "doc_id long, n_shingles long, class long"), "jaccard-classes")
    reps = materialise(named.where("class >= 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    n_blobs = P.count_parts(docs)
    bits = min(64, (n_blobs * P.PART_BYTES).bit_length() + 11)  # short hashes: so long that few shingles share one
    packed = P.pack_documents(docs, n_blobs)
    wanted = _placed(reps, n_blobs)
    told = packed.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(on_pair(_ask(n_blobs, bits)), ASKED).groupBy("owner").applyInArrow(on_group(_answer), TOLD)
    postings = packed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(on_pair(_postings(n_blobs, bits, percent)), POSTED)
    met = materialise(postings.repartition(n_parts, "key").withColumn("met", F.count("*").over(Window.partitionBy("key"))).where("met > 1").drop("met"), "jaccard-postings")
    n_met = met.count()
    # The texts of classes that share a prefix shingle with another, once.
    used = met.select("class").distinct().join(reps, "class")
    texts = materialise(_class_texts(packed, _placed(used, n_blobs)), "jaccard-texts")
    none = spark.createDataFrame([], "a long, b long, linked boolean")
    checked, comp, open_ = none, None, met
    for round_ in range(ROUNDS):
        by = F.xxhash64("key", "class", F.lit(round_))
        mixed = open_.withColumn("by", by).repartition(n_parts, "key").sortWithinPartitions("key", "apart", "by")
        pairs = mixed.select("key", "class", "n", "place", "matches", "home").mapInArrow(_seeds(percent, SEEDS << round_), "a long, b long").distinct()
        if comp is not None:
            own = comp.select(F.col("id"), "component")
            pairs = pairs.join(own.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left").join(own.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        new = materialise(_checked(pairs, texts, percent), "jaccard-checked")
        checked = checked.union(new)
        found = not new.where("linked").isEmpty()
        if found or comp is None:
            comp = materialise(connected_components(checked.where("linked"), "a", "b", small=SMALL), "jaccard-components")
        # Postings that still meet classes of different components, and the component that most of a posting's rows have.
        owned = met.join(comp.withColumnRenamed("id", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
        split = owned.groupBy("key", "comp").agg(F.count("*").alias("rows")).groupBy("key").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
        open_ = materialise(owned.join(split.select("key", "all", "most"), "key"), "jaccard-open")
        left = open_.where("comp <> most.comp").agg(F.sum("all")).head()[0] or 0
        if not found or left <= FEW * n_met:
            break
    # Last round: all pairs of different components.
    side = lambda a: (F.col(c).alias(c + a) for c in ("class", "n", "place", "matches", "home", "comp"))
    one = open_.where("comp <> most.comp").select("key", *side("_a"))
    two = open_.select("key", (F.col("comp") == F.col("most.comp")).alias("main"), *side("_b"))
    room = f"least(matches_a, matches_b) - cast(ceil({percent} * (n_a + n_b) / {100 + percent}) as int)"
    fits = F.expr(f"comp_a <> comp_b and (main or class_a < class_b) and (home_a or home_b) and 100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b) and place_a < n_a + {room} and place_b < n_b + {room}")
    shared = one.join(two, "key").where(fits).select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), F.least("matches_a", "matches_b").alias("need"))
    enough = shared.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")
    more = materialise(_checked(enough.join(checked.select("a", "b"), ["a", "b"], "left_anti"), texts, percent).where("linked").select("a", "b"), "jaccard-links")
    if not more.isEmpty():
        comp = materialise(connected_components(checked.where("linked").select("a", "b").union(more), "a", "b", small=SMALL), "jaccard-components")
    least = comp.join(reps.withColumnRenamed("class", "id"), "id").select("id", "component", "rep")
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(F.col("id").alias("class"), "component_id")
    by_class = reps.join(least, "class", "left").select("class", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id"))
    out = named.join(by_class, "class", "left")
    alone = (F.col("class") < 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", *(F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col(c))).alias(c) for c in ("class_id", "component_id")))


def _placed(reps: DataFrame, n_parts: int) -> DataFrame:
    """(part, class, doc_id) of classes and their documents: the part that holds the document."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(P.part_of(b.column("rep").to_numpy(), n_parts)), b.column("class"), b.column("rep")], ["part", "class", "doc_id"])

    return reps.select("class", "rep").mapInArrow(run, "part int, class long, doc_id long")


def _class_texts(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text): a row for each wanted class, from its document (rows of that id with another set are left out)."""

    def pick(docs: pa.Table, want: pa.Table) -> pa.Table:
        out = [pa.table({"class": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
        if docs.num_rows and want.num_rows:
            d = P.unpack_documents(docs)
            rows = _chosen(d, want.column("doc_id").to_numpy(), want.column("class").to_numpy())
            for b in A.slices([pa.RecordBatch.from_arrays([d.texts.take(pa.array(rows))], ["text"])], "text", SLICE_BYTES):
                h, first, _ = _sets(b.column("text"))
                out.append(pa.table({"class": pa.array(_classes(h, first)), "text": b.column("text").cast(pa.string())}))
        return pa.concat_tables(out)

    return packed.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(on_pair(pick), "class long, text string")


def representatives(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that stand for their component: those of its smallest id.

    Rows of a null id, and those without a shingle, stay. Of repeated rows (one id, one text) one stays. Columns may have
    any names; an empty table gives an empty result.
    """
    found = components(df, percent, id_col, text_col)
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    rows = df.join(chosen, id_col, "left_semi").unionByName(df.where(F.col(id_col).isNull()))
    if not df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        rows = rows.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(rows.where(F.col(id_col).isNull()))
    return rows
