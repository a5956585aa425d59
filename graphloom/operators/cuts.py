"""Components of graphs, cut vertices and bridges, and what their removal leaves.

All cut vertices, all bridges and the sizes of the pieces that remain without each of them come from one pass, so no removal
is simulated. Components of up to LIMIT edges each are handled by a low-link pass in one task. Where one is larger, the same
rows come from joins: a breadth-first tree, numbers in preorder and subtree sizes by level, the least and greatest number that
each subtree has an edge to, and components of tree edges that lie on a common cycle, which are the blocks of the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.operators.components import connected_components
from graphloom.operators.ranks import running
from graphloom.operators.traversal import hops
from graphloom.session import materialise

#: Edges of one component that a task takes in: about 60 bytes each.
LIMIT = 2_000_000
SMALL = 500_000  # edges of a whole graph whose components one task finds


def components(graph: Topology) -> DataFrame:
    """(id, component): every node with the least id of its component; an isolate is its own."""
    found = connected_components(graph.edges.where("src <> dst"), "src", "dst", small=SMALL)
    return graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def low_links(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Of a connected simple graph: the piece sizes that each node's removal leaves, and bridges (parent, child, child's side)."""
    return _pass(a, b, n)[:2]


def _pass(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[list[int]], list[tuple[int, int, int]], list[list[int]]]:
    """low_links(), and the number of the node's neighbours in each of its pieces."""
    ends, other = np.r_[a, b], np.r_[b, a]
    order = np.argsort(ends, kind="stable")
    to = other[order].tolist()
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    at, seen, low, size = first[:], [-1] * n, [0] * n, [1] * n
    pieces: list[list[int]] = [[] for _ in range(n)]
    near: list[list[int]] = [[] for _ in range(n)]
    hits = [1] * n  # edges to a node's parent from the node and from below it
    bridges, stack, up, clock = [], [0], [-1] * n, 1
    seen[0] = 0
    while stack:
        v = stack[-1]
        if at[v] < first[v + 1]:
            w = to[at[v]]
            at[v] += 1
            if seen[w] < 0:
                seen[w] = low[w] = clock
                clock += 1
                up[w] = v
                stack.append(w)
            elif w != up[v] and seen[w] < seen[v]:
                hits[to[at[w] - 1]] += 1  # w is above v: its last edge taken leads here
                if seen[w] < low[v]:
                    low[v] = seen[w]
            continue
        stack.pop()
        p = up[v]
        if p >= 0:
            size[p] += size[v]
            if low[v] < low[p]:
                low[p] = low[v]
            if low[v] >= seen[p]:
                pieces[p].append(size[v])
                near[p].append(hits[v])
            if low[v] > seen[p]:
                bridges.append((p, v, size[v]))
    for v in range(n):
        rest = n - 1 - sum(pieces[v])
        if rest:
            pieces[v].append(rest)
            near[v].append(first[v + 1] - first[v] - sum(near[v]))
    return pieces, bridges, near


def _kernel(edges: pd.DataFrame) -> pd.DataFrame:
    ids, inv = np.unique(np.r_[edges["src"].to_numpy(str), edges["dst"].to_numpy(str)], return_inverse=True)
    m = len(edges)
    pieces, bridges, near = _pass(inv[:m], inv[m:], len(ids))
    comp = edges["component"].iloc[0]
    rows = [("node", ids[i], None, comp, len(ids), p, near[i]) for i, p in enumerate(pieces)]
    rows += [("bridge", min(ids[p], ids[c]), max(ids[p], ids[c]), comp, len(ids), [int(s), len(ids) - int(s)], None) for p, c, s in bridges]
    return pd.DataFrame(rows, columns=["kind", "id", "other", "component", "size", "pieces", "near"])


def cuts(graph: Topology, comp: DataFrame | None = None) -> DataFrame:
    """(kind, id, other, component, size, pieces, near) of every node with an edge and of every bridge.

    near: how many of a node's neighbours lie in each of its pieces.
    """
    g = graph.undirected()
    comp = comp if comp is not None else components(g)
    e = g.edges.where("src <> dst").select("src", "dst").join(comp.withColumnRenamed("id", "src"), "src")
    most = e.groupBy("component").count().agg(F.max("count")).head()[0] or 0
    if most > LIMIT:
        return _by_joins(materialise(e.select("component", "src", "dst").distinct(), "cuts"))
    return e.groupBy("component").applyInPandas(_kernel, "kind string, id string, other string, component string, size bigint, pieces array<bigint>, near array<bigint>")


def _by_joins(edges: DataFrame) -> DataFrame:
    """cuts() of simple edges (component, src, dst), a component being named by its least node, by joins alone."""
    arcs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    arcs = materialise(arcs, "cuts")
    roots = edges.select(F.col("component").alias("source"), F.col("component").alias("id")).distinct()
    level = materialise(hops(arcs, roots).select("id", F.col("source").alias("component"), "hop"), "cuts")
    up = arcs.join(level.select(F.col("id").alias("a"), "hop"), "a").join(level.select(F.col("id").alias("b"), (F.col("hop") + 1).alias("hop")), ["b", "hop"])
    tree = materialise(level.join(up.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent")), "id", "left"), "cuts")
    depth = tree.agg(F.max("hop")).head()[0]

    def upwards(rows: DataFrame, values: dict[str, Column], merge) -> DataFrame:
        """rows with values of each node merged with those of all nodes below it, from the deepest level on."""
        names, out, below = list(values), None, None
        for h in range(depth, -1, -1):
            now = rows.where(F.col("hop") == h).withColumns({k: v.cast("bigint") for k, v in values.items()})
            if below is not None:
                under = below.groupBy(F.col("parent").alias("id")).agg(*[merge[k][0](k).alias(f"_{k}") for k in names])
                now = now.join(under, "id", "left").withColumns({k: merge[k][1](F.col(k), F.coalesce(f"_{k}", F.lit(merge[k][2])) if merge[k][2] is not None else F.coalesce(f"_{k}", k)) for k in names}).drop(*[f"_{k}" for k in names])
            below = materialise(now, "cuts")
            out = below if out is None else out.union(below)
        return materialise(out, "cuts")

    sized = upwards(tree, {"size": F.lit(1)}, {"size": (F.sum, lambda x, y: x + y, 0)})
    # Numbers in preorder: a node's is its parent's, one, and the sizes of the siblings before it.
    child = running(sized.where("parent is not null"), ["parent", "id"], F.col("size"), "sum")
    child = child.join(child.groupBy("parent").agg(F.min("sum").alias("first")), "parent").select("id", (F.col("sum") - F.col("first") + 1).alias("step"))
    sized = materialise(sized.join(child, "id", "left"), "cuts")
    known = materialise(sized.where("hop = 0").withColumn("pre", F.lit(0).cast("bigint")), "cuts")
    numbered_ = known
    for h in range(1, depth + 1):
        known = materialise(sized.where(F.col("hop") == h).join(known.select(F.col("id").alias("parent"), F.col("pre").alias("_pre")), "parent").withColumn("pre", F.col("_pre") + F.col("step")).drop("_pre").select(*known.columns), "cuts")
        numbered_ = numbered_.union(known)
    nodes = materialise(numbered_.drop("step"), "cuts")
    # Edges outside the tree, each from its smaller number, and how far subtrees reach by them.
    at = nodes.select("id", "parent", "pre", "size")
    end = lambda x: at.select(*[F.col(c).alias(f"{c}_{x}") for c in at.columns])
    outside = arcs.join(end("u"), F.col("a") == F.col("id_u")).join(end("w"), F.col("b") == F.col("id_w")).where("pre_u < pre_w and not (parent_w <=> id_u)")
    outside = materialise(outside.select("id_u", "pre_u", "size_u", "id_w", "pre_w"), "cuts")
    both = outside.select(F.col("id_u").alias("id"), F.col("pre_w").alias("to")).union(outside.select(F.col("id_w").alias("id"), F.col("pre_u").alias("to")))
    reach = nodes.join(both.groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi")), "id", "left")
    reach = upwards(reach, {"low": F.least("pre", "lo"), "high": F.greatest("pre", "hi")}, {"low": (F.min, F.least, None), "high": (F.max, F.greatest, None)})
    # Tree edges, named by their lower end, that share a block.
    above = nodes.where("parent is not null").select(F.col("id").alias("parent"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"))
    along = reach.join(above, "parent").where("low < p_pre or high >= p_pre + p_size").select(F.col("id").alias("x"), F.col("parent").alias("y"))
    across = outside.where("pre_u + size_u <= pre_w").select(F.col("id_u").alias("x"), F.col("id_w").alias("y"))
    shared = connected_components(along.union(across), "x", "y").select("id", F.col("component").alias("block"))
    lower = materialise(nodes.where("parent is not null").join(shared, "id", "left").withColumn("block", F.coalesce("block", "id")), "cuts")
    members = lower.select("block").union(outside.select(F.col("id_w").alias("id")).join(lower.select("id", "block"), "id").select("block"))
    single = members.groupBy("block").count().where("count = 1").select("block")
    n = nodes.where("hop = 0").select("component", F.col("size").alias("whole"))
    link = lower.join(single, "block").join(n, "component")
    none = F.array().cast("array<bigint>")
    bridge = link.select(F.lit("bridge").alias("kind"), F.least("id", "parent").alias("id"), F.greatest("id", "parent").alias("other"), "component", F.col("whole").alias("size"), F.array("size", F.col("whole") - F.col("size")).alias("pieces"), F.lit(None).cast("array<bigint>"))
    # Without a node, the subtrees of its children fall apart by block; those of its own block stay with what is above.
    own = lower.select(F.col("id").alias("parent"), F.col("block").alias("own"))
    more = outside.select(F.col("id_u").alias("parent"), F.col("id_w").alias("id")).join(lower.select("id", "block"), "id").select("parent", "block", F.lit(0).cast("bigint").alias("size"))
    hung = lower.select("parent", "block", "size").union(more).groupBy("parent", "block").agg(F.sum("size").alias("piece"), F.count("*").alias("m")).join(own, "parent", "left").where("not (block <=> own)")
    down = hung.groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct("piece", "m")).alias("down"), F.sum("piece").alias("sum"), F.sum("m").alias("met"))
    k = arcs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("k"))
    node = nodes.join(n, "component").join(k, "id").join(down, "id", "left").withColumn("rest", F.col("whole") - 1 - F.coalesce("sum", F.lit(0)))
    both = lambda c, rest: F.concat(F.coalesce(F.col(f"down.{c}"), none), F.when(F.col("rest") > 0, F.array(rest)).otherwise(none))
    return bridge.union(node.select(F.lit("node"), "id", F.lit(None).cast("string"), "component", "whole", both("piece", F.col("rest")), both("m", F.col("k") - F.coalesce("met", F.lit(0))))).toDF("kind", "id", "other", "component", "size", "pieces", "near")


def articulation_points(found: DataFrame) -> DataFrame:
    return found.where("kind = 'node' and size(pieces) > 1").select("id")


def bridges(found: DataFrame) -> DataFrame:
    return found.where("kind = 'bridge'").select(F.col("id").alias("src"), F.col("other").alias("dst"))
