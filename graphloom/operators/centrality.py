"""Centralities.

Betweenness runs Brandes' accumulation from every class of twins. Up to LIMIT edges between classes, the adjacency goes to all tasks and sources
spread over them; beyond, the same sums are formed by joins, a hop at a time, and nothing is sent whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.operators.twins import collapse
from graphloom.session import bucketed, materialise

#: Edges that are sent to every task: 16 bytes each.
LIMIT = 2_000_000
#: Nodes beyond which the arcs of ranks lie in buckets.
MANY = 50_000


def _brandes(first: np.ndarray, to: np.ndarray, w: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """What all members of class s, as sources, depend on one member of each class, and on one arc between members.

    A member as the source leaves w[s] - 1 of its class, which are reached like any other node.
    """
    n, size = len(first) - 1, w[s]
    w = w.copy()
    w[s] -= 1
    dist = np.full(n, -1)
    sigma = np.zeros(n)
    own = slice(first[s], first[s + 1])
    front, levels, d = to[own], [], 1
    if size == 1:
        dist[s] = 0
    dist[front], sigma[front] = 1, 1
    while len(front):
        deg = first[front + 1] - first[front]
        arc = np.repeat(first[front] - (np.cumsum(deg) - deg), deg) + np.arange(deg.sum())
        a, b = np.repeat(front, deg), to[arc]
        new = np.unique(b[dist[b] < 0])
        dist[new] = d + 1
        on = dist[b] == d + 1
        a, b, arc = a[on], b[on], arc[on]
        np.add.at(sigma, b, w[a] * sigma[a])
        levels.append((a, b, arc))
        front, d = new, d + 1
    delta, by_arc = np.zeros(n), np.zeros(len(to))
    for a, b, arc in reversed(levels):
        c = sigma[a] / sigma[b] * (1 + delta[b])
        by_arc[arc] = c * np.where((a == s) | (b == s), size - 1, size)
        np.add.at(delta, a, w[b] * c)
    by_arc[own] += 1 + delta[to[own]]  # the source's own arcs
    return delta * np.where(np.arange(n) == s, size - 1, size), by_arc


def _raw(graph: Topology) -> tuple[DataFrame, DataFrame]:
    """Sums of dependencies: (id, value) and, in the arcs' directions, (a, b, value). Sources are classes of twins."""
    g = graph
    found = collapse(g)
    if found.arcs.count() > 2 * LIMIT or found.sizes.count() > LIMIT:
        return _raw_by_joins(g, found.links)
    t, sizes = found.arcs.toArrow(), dict(zip(*found.sizes.toArrow().to_pydict().values()))  # 2 * LIMIT arcs and LIMIT nodes at most
    ids = np.array(sorted(sizes), object)
    w = np.array([sizes[i] for i in ids], float)
    where = {v: i for i, v in enumerate(ids)}
    a = np.array([where[x] for x in t["a"].to_pylist()], np.int64)
    b = np.array([where[x] for x in t["b"].to_pylist()], np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(len(ids) + 1))

    def run(batches):
        node, arc = np.zeros(len(ids)), np.zeros(len(b))
        for batch in batches:
            for s in batch.column("i").to_pylist():
                x, y = _brandes(first, b, w, s)
                node += x
                arc += y
        yield pa.RecordBatch.from_arrays([pa.array(["node"] * len(ids) + ["arc"] * len(b)), pa.array(np.r_[np.arange(len(ids)), a]), pa.array(np.r_[np.full(len(ids), -1), b]), pa.array(np.r_[node, arc])], ["kind", "x", "y", "value"])

    spark = g.nodes.sparkSession
    tasks = max(1, min(len(ids), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sums = spark.range(0, len(ids), 1, tasks).withColumnRenamed("id", "i").mapInArrow(run, "kind string, x long, y long, value double").groupBy("kind", "x", "y").agg(F.sum("value").alias("value"))
    sums = materialise(sums, "brandes")
    names = spark.createDataFrame([(i, str(v)) for i, v in enumerate(ids)] or [(0, "")], "x long, twin string")
    node = sums.where("kind = 'node'").join(names, "x").join(found.members, "twin").select("id", "value")
    of = sums.where("kind = 'arc'").join(names.withColumnRenamed("twin", "ta"), "x").join(names.select(F.col("x").alias("y"), F.col("twin").alias("tb")), "y").select("ta", "tb", "value")
    arc = found.links.join(found.members.select(F.col("id").alias("a"), F.col("twin").alias("ta")), "a").join(found.members.select(F.col("id").alias("b"), F.col("twin").alias("tb")), "b").join(of, ["ta", "tb"]).select("a", "b", "value")
    return node, arc


def _raw_by_joins(g: Topology, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    front = g.nodes.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma"))
    seen, levels = materialise(front, "brandes"), []
    front = seen
    while True:
        step = front.join(arcs, front["id"] == arcs["a"]).join(seen.select("source", F.col("id").alias("b")), ["source", "b"], "left_anti").select("source", "a", "b", "sigma")
        step = materialise(step, "brandes")
        if step.isEmpty():
            break
        levels.append(step)
        front = materialise(step.groupBy("source", F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma")), "brandes")
        seen = materialise(seen.union(front), "brandes")
    share, parts = None, []
    for step in reversed(levels):
        below = seen.select("source", F.col("id").alias("b"), F.col("sigma").alias("sb"))
        c = step.join(below, ["source", "b"])
        c = c.join(share, ["source", "b"], "left") if share is not None else c.withColumn("delta", F.lit(0.0))
        c = materialise(c.select("source", "a", "b", (F.col("sigma") / F.col("sb") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("c")), "brandes")
        parts.append(c)
        share = c.groupBy("source", F.col("a").alias("b")).agg(F.sum("c").alias("delta"))
    if not parts:
        empty = g.nodes.sparkSession.createDataFrame([], "a string, b string, value double")
        return g.nodes.select("id", F.lit(0.0).alias("value")), empty
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    node = every.where("a <> source").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("value"))
    return node, every.groupBy("a", "b").agg(F.sum("c").alias("value"))


def betweenness(graph: Topology) -> DataFrame:
    """(id, betweenness), divided by (n-1)(n-2)."""
    node, _ = _raw(graph)
    n = graph.nodes.agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return graph.nodes.select("id").join(node, "id", "left").crossJoin(n).select("id", (F.coalesce("value", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness(graph: Topology) -> DataFrame:
    """(src, dst, betweenness), divided by n(n-1); both directions of an undirected edge count."""
    _, arc = _raw(graph)
    n = graph.nodes.agg(F.count("*").alias("n"))
    a = arc if graph.directed else arc.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value").groupBy("a", "b").agg(F.sum("value").alias("value"))
    return a.crossJoin(n).select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("value") / (F.col("n") * (F.col("n") - 1))).alias("betweenness"))


def degree_centrality(graph: Topology) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("n"))
    return graph.degree().crossJoin(n).select("id", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("degree_centrality"))


def pagerank(graph: Topology, alpha: float = 0.85, tol: float = 1e-6, max_rounds: int = 100, rounds: int | None = None, every: int = 5) -> DataFrame:
    """(id, pagerank) over the edges' weights (1 where absent).

    Stops when the ranks move by less than n * tol in all, or after rounds if given; RuntimeError if max_rounds pass.
    """
    n = graph.nodes.count()
    if not n:
        return graph.nodes.select("id", F.lit(None).cast("double").alias("pagerank"))
    weighted = "weight" in graph.edges.columns
    w = [F.coalesce("weight", F.lit(1.0)).alias("w")] if weighted else []
    arc = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), *w)
    there, both = F.array(arc("src", "dst")), F.array(arc("src", "dst"), arc("dst", "src"))
    # Edges are read once, and their arcs shuffled once: a round then shuffles ranks and what they add up to.
    arcs = graph.edges.select(F.explode(there if graph.directed else F.when(F.col("src") != F.col("dst"), both).otherwise(there)).alias("arc")).select("arc.*")
    arcs = bucketed(arcs, "a", "pagerank") if n > MANY else materialise(arcs, "pagerank")
    w = F.col("w") if weighted else F.lit(1.0)
    out = arcs.groupBy(F.col("a").alias("id")).agg(F.sum(w).alias("total"))
    now = materialise(graph.nodes.select("id").join(out, "id", "left").withColumn("rank", F.lit(1.0 / n)), "pagerank")
    for r in range(1, (rounds or max_rounds) + 1):
        lost = now.where("total is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        share = now.where("total is not null").select("id", (F.col("rank") / F.col("total")).alias("share"))
        got = share.join(arcs, share["id"] == arcs["a"]).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("share") * w).alias("got"))
        after = now.join(got, "id", "left").crossJoin(lost).select("id", "total", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"), F.col("rank").alias("was"))
        if rounds:
            now = materialise(after.drop("was"), "pagerank") if r % every == 0 else after.drop("was")
            continue
        after = materialise(after, "pagerank")
        if after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).head()[0] < n * tol:
            return after.select("id", F.col("rank").alias("pagerank"))
        now = after.drop("was")
    if not rounds:
        raise RuntimeError(f"pagerank did not settle in {max_rounds} rounds")
    return now.select("id", F.col("rank").alias("pagerank"))


MEASURES = {"betweenness": betweenness, "degree": degree_centrality, "pagerank": pagerank}


def high_centrality(graph: Topology, k: int = 10, metric: str = "betweenness") -> DataFrame:
    """The k nodes of the highest measure (to 12 places; ties: the smaller id); ValueError for an unknown one."""
    from graphloom.operators.traversal import closeness

    found = {**MEASURES, "closeness": closeness}.get(metric)
    if found is None:
        raise ValueError(f"unknown metric: {metric}")
    got = found(graph)
    value = next(c for c in got.columns if c != "id")
    return got.select("id", F.col(value).alias("value")).orderBy(F.desc(F.round("value", 12)), "id").limit(k)


def high_centrality_graph(graph: Topology, k: int = 10, metric: str = "betweenness") -> Topology:
    """The subgraph of the k nodes of the highest measure."""
    return graph.induced(high_centrality(graph, k, metric))


def algebraic_connectivity(graph: Topology, limit: int = 3000, rounds: int = 300) -> float:
    """Second smallest eigenvalue of the Laplacian of a connected undirected graph; 0 for one that is not.

    Up to `limit` classes of twins by a dense solver on the driver; beyond by Lanczos steps in joins, `rounds` at most: RuntimeError
    if it has not settled by then.
    """
    from graphloom.operators.cuts import components

    g = graph.undirected()
    n = g.nodes.count()
    if n < 2 or components(g).select("component").distinct().count() > 1:
        return 0.0
    found = collapse(g)
    if found.sizes.count() <= limit:
        # A vector is the same on twins, or sums to 0 on one class and is 0 elsewhere: its value is their degree then.
        sizes = dict(zip(*found.sizes.toArrow().to_pydict().values()))
        ids = {v: i for i, v in enumerate(sizes)}
        w = np.array(list(sizes.values()), float)
        lap = np.zeros((len(w), len(w)))
        for r in found.arcs.toArrow().to_pylist():  # below limit squared
            i, j = ids[r["a"]], ids[r["b"]]
            lap[i, j] = -np.sqrt(w[i] * w[j])
            lap[i, i] += w[j]
        least = min([lap[i, i] for i in range(len(w)) if w[i] > 1], default=np.inf)
        return float(max(min(np.linalg.eigvalsh(lap)[1], least), 0.0))
    arcs = found.links
    deg = arcs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    return _lanczos(arcs, deg, rounds)


#: Vectors that Lanczos steps hold for each node, those kept when it starts over, and the residual that ends it.
VECTORS, KEPT, SETTLED = 40, 12, 1e-6


def _lanczos(arcs: DataFrame, deg: DataFrame, rounds: int) -> float:
    """The smallest eigenvalue of the Laplacian among vectors that sum to 0, by thick restarts.

    A node's row holds its entries of all vectors; one that is new is made orthogonal to them twice, and to the
    constant. Its residual bounds a value's distance from an eigenvalue.
    """
    n = deg.count()

    def times(weights) -> Column:  # the sum of the vectors by weights
        return F.aggregate(F.zip_with("q", F.array(*(F.lit(float(x)) for x in weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def sums(df: DataFrame, x: Column, k: int) -> np.ndarray:  # products with each vector, the sum and the square
        row = df.select("q", x.alias("x")).agg(*(F.sum(F.col("x") * F.col("q")[j]).alias(f"s{j}") for j in range(k)), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("square")).head()
        return np.array(row, float)

    now = materialise(deg.withColumn("x", F.xxhash64("id") / F.lit(2.0**63)), "fiedler")
    mean = now.agg(F.avg("x")).head()[0]
    norm = now.agg(F.sqrt(F.sum((F.col("x") - mean) * (F.col("x") - mean)))).head()[0]
    now = now.select("id", "d", F.array((F.col("x") - mean) / norm).alias("q"))
    h, k = np.zeros((VECTORS, VECTORS)), 1
    for _ in range(rounds):
        last = F.element_at("q", -1)
        near = now.select("id", last.alias("x")).join(arcs, F.col("id") == arcs["a"]).groupBy(F.col("b").alias("id")).agg(F.sum("x").alias("s"))
        now = materialise(now.join(near, "id").select("id", "d", "q", (F.col("d") * last - F.col("s")).alias("y")), "fiedler")
        got = sums(now, F.col("y"), k)
        h[:k, k - 1] = h[k - 1, :k] = got[:k]
        w = F.col("y") - times(got[:k]) - F.lit(got[k] / n)
        again = sums(now, w, k)
        w = w - times(again[:k]) - F.lit(again[k] / n)
        beta = float(np.sqrt(max(again[k + 1] - (again[:k] ** 2).sum() - again[k] ** 2 / n, 0.0)))
        values, vectors = np.linalg.eigh(h[:k, :k])
        if beta * abs(vectors[-1, 0]) <= SETTLED * values[0] or beta <= 1e-12 * values[-1] or k >= n - 1:
            return float(max(values[0], 0.0))
        new = w / F.lit(beta)
        if k == VECTORS:
            now = now.select("id", "d", F.array(*(times(vectors[:, i]) for i in range(KEPT)), new).alias("q"))
            h = np.zeros_like(h)
            h[np.arange(KEPT), np.arange(KEPT)] = values[:KEPT]
            k = KEPT + 1
        else:
            now = now.select("id", "d", F.array_append("q", new).alias("q"))
            k += 1
    raise RuntimeError(f"algebraic connectivity did not settle in {rounds} rounds")
