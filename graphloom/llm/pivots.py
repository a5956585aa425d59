"""Exact top-k inner products through a pivot-distance index.

Vectors are lifted onto a sphere's tangent of equal norms (one more coordinate), which turns the largest inner product
into the smallest distance. Each vector is keyed by its nearest pivot and its distance to it; sorted by that key they
are cut into blocks, annuli around pivots. A query starts in the annulus that holds its own distance, expands to the
annuli next to it, and ends with those that the triangle inequality cannot rule out against its k-th best so far. Only
query and annulus pairs that may still matter are formed. However many blocks there are, the table of annuli has at most
one row for each pivot and ring. Scores are exact integers: products are summed in float64 where none can reach 2**53, in
int64 up to what a long holds, and as Python's integers beyond; a result that no long holds raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.sparkio import materialise, partitions

SCALE = 1024
PIVOTS = 32
#: Rows that pivots are fitted on, taken by a hash of their id; every row is indexed.
PIVOT_ROWS = 4096
BLOCK = 1024
RINGS = 1 << 12
CHUNK = 256  # queries that meet a block together, about
NEAR = 2  # annuli of the first round on each side of a query's own
CELLS = 1 << 21  # distances of queries to annuli that are held at once


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a float64 matrix of whole numbers."""
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vector) with floor(scale * x) for every component x as double; vectors null, empty or holding null or non-finite components go."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Centres by a few rounds of k-means over the sample, started far from one another."""
    count = min(count, len(rows))
    at = [0]
    far = np.full(len(rows), np.inf)
    for _ in range(count - 1):
        far = np.minimum(far, ((rows - rows[at[-1]]) ** 2).sum(1))
        at.append(int(far.argmax()))
    p = rows[at].copy()
    for _ in range(5):
        near = _distances(rows, p).argmin(1)
        for i in range(count):
            if (near == i).any():
                p[i] = rows[near == i].mean(0)
    return p


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


class Space:
    """The lift of vectors and the pivots in it. bound: the largest squared norm."""

    def __init__(self, bound: float, pivots: np.ndarray):
        self.bound, self.pivots = bound, pivots

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.bound - (x * x).sum(1), 0))]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.zeros(len(x))]


def top_k(df: DataFrame, k: int = 10, query: str = "id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query row with every other row.

    query: a condition on id. Ties go to the smaller id; fewer than k candidates give fewer rows; a row is no candidate
    of a query with its own id. Vectors null, empty, or holding null or non-finite components take no part, nor do rows
    of a null id; vectors of different lengths are no candidates of each other. Repeated rows are candidates each, and
    queries once (with the least vector, if they differ). Other columns are ignored; without a query or a candidate the
    result is empty. A quantised component or one of the k highest scores that does not fit in a long raises an error.
    """
    rows = materialise(quantise(df, id_col, vector_col, scale), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes = rows.groupBy(F.size("v")).agg(F.max(squares), F.count("*"), F.max(F.array_max("v")), F.min(F.array_min("v")))
    for size, bound, total, high, low in sorted(tuple(r) for r in sizes.toLocalIterator()):
        if high == 2**63 - 1 or low == -(2**63):
            raise OverflowError("a component does not fit in a long")
        out = out.union(_of_one_size(rows.where(F.size("v") == size), size, bound, total, k, query, pivots, block))
    return out


def _of_one_size(rows: DataFrame, size: int, bound: float, total: int, k: int, query: str, pivots: int, block: int) -> DataFrame:
    """top_k() of quantised vectors of one length. bound: the largest squared norm, which no product exceeds."""
    spark = rows.sparkSession
    exact = np.float64 if bound < 2.0**52 else np.int64 if bound < 2.0**62 else object
    stored = np.int32 if bound < 2.0**61 else np.int64
    sample = _least(rows, total).orderBy(F.xxhash64("id"), "id").select("v").limit(PIVOT_ROWS).toArrow().combine_chunks()
    x = _matrix(sample["v"].combine_chunks() if sample["v"].num_chunks != 1 else sample["v"].chunk(0))
    space = Space(float(bound), np.zeros((0, size + 1)))
    space.pivots = _pivots(np.unique(space.lift(x), axis=0), pivots)
    reach = float(_reach(space))

    # The index: rows dealt by pivot and ring of distance, and by a hash of the id within, so that equal vectors spread.
    def key(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"))
            d = _distances(space.lift(m), space.pivots)
            p = d.argmin(1)
            at = d[np.arange(len(p)), p]
            ring = np.minimum((at / reach * RINGS).astype(np.int64), RINGS - 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(p.astype(np.int64)), pa.array(at), pa.array(p * RINGS + ring)], ["id", "v", "pivot", "distance", "ring"])

    keyed = rows.mapInArrow(key, "id long, v array<long>, pivot long, distance double, ring long")
    parts = max(1, min(partitions(spark), -(-total // block)))
    dealt = keyed.repartitionByRange(parts, "ring", F.xxhash64("id")).sortWithinPartitions("pivot", "distance", "id")

    def cut(batches):
        held: list[tuple] = []

        def rows_of():
            for b in batches:
                yield from zip(b.column("ring").to_pylist(), b.column("distance").to_pylist(), b.column("id").to_pylist(), b.column("v").values.to_numpy()[b.column("v").offsets[0].as_py() :].reshape(-1, size)[: b.num_rows].astype(stored))

        def packed():
            ids = np.array([r[2] for r in held], np.int64)
            v = np.stack([r[3] for r in held])
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in ((held[0][0], pa.int64()), (held[0][1], pa.float64()), (held[-1][1], pa.float64()), (ids.tobytes(), pa.binary()), (v.tobytes(), pa.binary()))], ["annulus", "lo", "hi", "ids", "vectors"])

        for r in rows_of():
            if held and (len(held) == block or r[0] // RINGS != held[0][0] // RINGS):
                yield packed()
                held.clear()
            held.append(r)
        if held:
            yield packed()

    index = materialise(dealt.mapInArrow(cut, "annulus long, lo double, hi double, ids binary, vectors binary"), "pivot-blocks")
    # An annulus: the blocks that begin in one ring of a pivot. At most PIVOTS * RINGS of them.
    meta = index.groupBy("annulus").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("annulus").toArrow()
    name, lo, hi = (meta[c].to_numpy() for c in ("annulus", "lo", "hi"))
    pivot = name // RINGS
    asked = materialise(rows.where(query).groupBy("id").agg(F.min("v").alias("v")), "pivot-queries")
    chunks = -(-asked.count() // CHUNK) or 1
    step = max(1, CELLS // max(len(name), 1))

    def gaps(batches):
        """Slices of queries with their matrix, the least distance to each annulus, and the annuli of the first round."""
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                m = _matrix(b.column("v"))
                far = _distances(space.queries(m), space.pivots)[:, pivot]
                gap = np.maximum(np.maximum(lo[None] - far, far - hi[None]), 0)
                yield b, m, gap, np.lexsort((far, gap), axis=1)[:, : 2 * NEAR + 1]

    # Round one: a query's own annulus around its nearest pivot, and those next to it.
    def start(batches):
        for b, m, _, order in gaps(batches):
            q = pa.array(np.repeat(np.arange(len(m)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(name[order.ravel()]), b.column("id").take(q), b.column("v").take(q)], ["annulus", "query_id", "q"])

    begun = asked.mapInArrow(start, "annulus long, query_id long, q array<long>")
    near = materialise(_best(_scored(begun, index, size, k, chunks, exact, stored), k), "pivot-near")
    floor = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))

    # Round two: every other annulus whose best possible product reaches the k-th best so far.
    def rest(batches):
        for b, m, gap, done in gaps(batches):
            least = b.column("least").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            radius2 = (m * m).sum(1) + space.bound - 2 * least  # squared distance of the k-th best
            slack = 1e-6 * (np.abs(radius2) + (m * m).sum(1) + space.bound) + 1.0
            open_ = np.isnan(least)[:, None] | (gap * gap <= (radius2 + slack)[:, None])
            np.put_along_axis(open_, done, False, axis=1)
            q, a = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([pa.array(name[a]), b.column("id").take(pa.array(q)), b.column("v").take(pa.array(q))], ["annulus", "query_id", "q"])

    more = asked.hint("merge").join(floor, asked["id"] == floor["query_id"], "left").select("id", "v", "least").mapInArrow(rest, "annulus long, query_id long, q array<long>")
    every = near.select("query_id", "vec_id", "score").union(_scored(more, index, size, k, chunks, exact, stored))
    return _best(every, k).select("query_id", "rank", "vec_id", "score")


def _least(rows: DataFrame, total: int) -> DataFrame:
    """Rows of which some thousands of the least hashes are all that tasks send to the driver, PIVOT_ROWS at least.

    Without a bound on the hash, each task would send PIVOT_ROWS vectors of its own.
    """
    if total <= 4 * PIVOT_ROWS:
        return rows
    few = rows.where(F.xxhash64("id") < int(-(2**63) + 2**64 * (4 * PIVOT_ROWS / total)))
    return few if few.limit(PIVOT_ROWS).count() == PIVOT_ROWS else rows


def _reach(space: Space) -> float:
    """A bound of distances between lifted vectors and pivots."""
    return max(2 * np.sqrt(space.bound) + np.sqrt((space.pivots**2).sum(1)).max(initial=0.0), 1.0)


def _scored(pairs: DataFrame, index: DataFrame, size: int, k: int, chunks: int, exact: type, stored: type) -> DataFrame:
    """The k best of each query and block, ties to the smaller id. Queries meet a block in chunks, not one by one.

    No side is broadcast: files of repeated vectors are small, and what is read from them is not.
    """

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                asked = b.column("asked")[r].values
                qid = asked.field("query_id").to_numpy()
                q = asked.field("q").flatten().to_numpy().reshape(len(qid), size).astype(exact)
                ids = np.frombuffer(b.column("ids")[r].as_buffer(), np.int64)
                v = np.frombuffer(b.column("vectors")[r].as_buffer(), stored).reshape(-1, size).astype(exact)
                s = q @ v.T  # sums of whole numbers that the type holds: exact in any order
                if exact is object:
                    yield _by_python(s, qid, ids, k)
                    continue
                s = s.astype(np.int64)
                s[qid[:, None] == ids[None]] = NO_SCORE
                enough = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qid), NO_SCORE)
                x, y = np.nonzero((s >= enough[:, None]) & (s > NO_SCORE))
                order = np.lexsort((ids[y], -s[x, y], x))
                x, y = x[order], y[order]
                first = np.ones(len(x), bool)
                first[1:] = x[1:] != x[:-1]
                best = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0)) < k
                x, y = x[best], y[best]
                yield pa.RecordBatch.from_arrays([pa.array(qid[x]), pa.array(ids[y]), pa.array(s[x, y])], ["query_id", "vec_id", "score"])

    salt = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    met = pairs.groupBy("annulus", salt.alias("chunk")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked")).join(index.select("annulus", "ids", "vectors").hint("merge"), "annulus")
    return met.select("asked", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, score long")


NO_SCORE = -(2**63) + 1


def _by_python(s: np.ndarray, qid: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row of a matrix of Python's integers."""
    out = [(q, i, score) for q, row in zip(qid.tolist(), s) for score, i in sorted(((x, i) for x, i in zip(row, ids.tolist()) if i != q), key=lambda r: (-r[0], r[1]))[:k]]
    if any(abs(x) > 2**63 - 1 for _, _, x in out):
        raise OverflowError("a score does not fit in a long")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 3], ["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, in order; each task keeps k of a query before they meet."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
