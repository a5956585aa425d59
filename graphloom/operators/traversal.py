"""Breadth-first traversals as joins: a visited table grows by one anti-joined frontier a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.operators.twins import collapse
from graphloom.session import materialise


#: Pairs of nodes that closeness holds at once.
PAIRS = 500_000_000
CHUNK = 1024  # ids of twins in a row


def hops(arcs: DataFrame, starts: DataFrame, limit: int | None = None, every: int = 3) -> DataFrame:
    """(source, id, hop): the least number of arcs from each start to each node it reaches, itself at 0.

    arcs: (a, b); starts: (source, id). Stops when no start reaches anything new, or after limit hops. What has been
    reached is written to the shared folder every few hops, so plans stay short.
    """
    seen = materialise(starts.select("source", "id", F.lit(0).alias("hop")).distinct(), "hops")
    front, hop = seen, 0
    while limit is None or hop < limit:
        hop += 1
        step = front.join(arcs, front["id"] == arcs["a"]).select("source", F.col("b").alias("id")).distinct()
        front = materialise(step.join(seen, ["source", "id"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hop % every == 0:
            seen = materialise(seen, "hops")
    return seen


def _exists(graph: Topology, *ids: str) -> None:
    for i in ids:
        if graph.nodes.where(F.col("id") == i).isEmpty():
            raise ValueError(f"no such node: {i}")


def k_hop(graph: Topology, center: str, k: int = 2) -> DataFrame:
    """(id, hop) of the nodes within k hops; ValueError if the centre is not there."""
    _exists(graph, center)
    start = graph.nodes.where(F.col("id") == center).select(F.col("id").alias("source"), "id")
    return hops(graph.arcs(), start, k).select("id", "hop")


def critical_path(graph: Topology, source: str, target: str) -> Topology:
    """The union of all shortest paths, induced; empty if the target is not reached."""
    _exists(graph, source, target)
    arcs = graph.arcs()
    there = hops(arcs, graph.nodes.where(F.col("id") == source).select(F.col("id").alias("source"), "id")).select("id", F.col("hop").alias("from_source"))
    back = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    home = hops(back, graph.nodes.where(F.col("id") == target).select(F.col("id").alias("source"), "id")).select("id", F.col("hop").alias("to_target"))
    total = there.where(F.col("id") == target).select(F.col("from_source").alias("total"))
    return graph.induced(there.join(home, "id").crossJoin(total).where("from_source + to_target = total").select("id"))


def _starts(ids: DataFrame, batches: int, k: int) -> DataFrame:
    """Every batches-th id as a start, by its hash."""
    return ids.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select(F.col("id").alias("source"), "id")


def all_pairs(graph: Topology) -> DataFrame:
    """(source, id, hop) between all pairs that reach each other; as many rows as the square of a component has.

    Only classes of twins are walked from; their rows are spread to all members as they are read, without a shuffle of pairs.
    """
    if graph.directed:
        return hops(graph.arcs(), graph.nodes.select(F.col("id").alias("source"), "id"))
    c = collapse(graph)
    found = materialise(hops(c.arcs, _starts(c.sizes, 1, 0)).withColumnsRenamed({"source": "twin", "id": "to"}), "hops")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("w") / CHUNK))
    sized = c.members.join(c.sizes.withColumnRenamed("id", "twin"), "twin")
    packed = materialise(sized.groupBy(F.col("twin").alias("to"), chunk.alias("chunk")).agg(F.collect_list("id").alias("ids")).select("to", "ids"), "members")
    parts = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = c.members.repartition(parts, "id").join(found, "twin").join(packed, "to").select(F.col("id").alias("source"), F.explode("ids").alias("id"), "hop")
    pairs = far.select("source", "id", F.when((F.col("hop") == 0) & (F.col("source") != F.col("id")), 2).otherwise(F.col("hop")).alias("hop"))
    alone = graph.nodes.select("id").distinct().join(c.members, "id", "left_anti")
    return pairs.union(alone.select(F.col("id").alias("source"), "id", F.lit(0)))


def closeness(graph: Topology, rows: int = PAIRS) -> DataFrame:
    """(id, closeness): nodes reached over the sum of their distances, scaled by the share reached; distances run inward.

    Starts, one for each class of twins, are walked from in batches, by a hash of their id, so that about `rows` pairs are
    held at once.
    """
    c = collapse(graph)
    arcs = c.arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    n, m = graph.nodes.count(), c.sizes.count()
    batches, per = max(1, -(-m * m // rows)), None
    for k in range(batches):
        reached = hops(arcs, _starts(c.sizes, batches, k)).join(c.sizes, "id")
        got = reached.groupBy("source").agg(F.sum("w").alias("r"), F.sum(F.when(F.col("hop") > 0, F.col("hop") * F.col("w")).otherwise(2 * (F.col("w") - 1))).alias("total"))
        got = materialise(got, "closeness") if batches > 1 else got
        per = got if per is None else per.union(got)
    share = (F.col("r") - 1) / F.col("total") * ((F.col("r") - 1) / F.lit(max(n - 1, 1)))
    of = c.members.join(per, F.col("twin") == F.col("source")).select("id", F.when(F.col("total") > 0, share).otherwise(0.0).alias("closeness"))
    return graph.nodes.select("id").join(of, "id", "left").select("id", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def clustering(graph: Topology) -> DataFrame:
    """(id, triangles, clustering) of the undirected graph without loops."""
    g = graph.undirected()
    e = g.edges.where("src <> dst").select("src", "dst")
    deg = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("k"))
    # Each edge points from its lower to its higher degree, so no node has many arcs out, and triangles meet once.
    d = e.join(deg.withColumnsRenamed({"id": "src", "k": "ks"}), "src").join(deg.withColumnsRenamed({"id": "dst", "k": "kd"}), "dst")
    first = F.expr("ks < kd or (ks = kd and src < dst)")
    arc = d.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("y"))
    wedge = arc.join(arc.withColumnRenamed("y", "z"), "x").where("y < z").select("x", "y", "z")
    tri = wedge.join(e, (F.col("y") == F.col("src")) & (F.col("z") == F.col("dst"))).select("x", "y", "z")
    at = tri.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    got = g.nodes.select("id").join(deg, "id", "left").join(at, "id", "left").na.fill(0, ["k", "triangles"])
    return got.select("id", "triangles", F.when(F.col("k") > 1, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def short_cycles(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles (a, y, z), and corners w, a, z of all cycles of four, of arcs (a, b) both ways without loops and repeats.

    Both are found from ranks by degree: a triangle from its lowest node; a cycle of four from its highest node w and the
    node z across, which meet in two nodes at least, by walks w - a - z where w ranks above both. So there are no more
    walks than edges times the lesser degree of each, and a hub does not give the square of its degree.
    """
    rank = ends.groupBy("a").agg(F.count("*").alias("k")).select(F.col("a").alias("id"), F.struct("k", F.col("a").alias("id")).alias("rank"))
    arcs = ends.join(rank.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(rank.withColumnsRenamed({"id": "b", "rank": "rb"}), "b")
    arcs = materialise(arcs, "arcs")
    up, every = arcs.where("rb > ra"), arcs.select("a", F.col("b").alias("z"), F.col("rb").alias("rz"))
    wedge = up.select("a", F.col("b").alias("y"), F.col("rb").alias("ry")).join(up.select("a", F.col("b").alias("z"), F.col("rb").alias("rz")), "a").where("ry < rz").select("a", "y", "z")
    three = wedge.join(up.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    walks = materialise(up.select("a", F.col("b").alias("w"), F.col("rb").alias("rw")).join(every, "a").where("rz < rw and w <> z").select("w", "z", "a"), "walks")
    met = walks.groupBy("w", "z").agg(F.count("*").alias("n")).where("n > 1").select("w", "z")
    return three, walks.join(met, ["w", "z"])


def redundant_edges(graph: Topology) -> DataFrame:
    """(src, dst, redundant): whether another simple path of at most three edges joins the ends.

    That is so for edges of a triangle or of a cycle of four.
    """
    g = graph.undirected()
    e = g.edges.select("src", "dst").where("src <> dst").distinct()
    three, four = short_cycles(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))))
    pair = lambda df, *ends: [df.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in ends]
    parts = pair(three, ("a", "y"), ("a", "z"), ("y", "z")) + pair(four, ("w", "a"), ("a", "z"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return e.join(found.distinct().withColumn("redundant", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("redundant", F.lit(False)).alias("redundant"))
