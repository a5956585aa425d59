"""Node and edge features, normalised adjacency and column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.functions.columns import EIGRP, OSPF
from graphloom.operators import centrality, traversal
from graphloom.operators.ranks import numbered

NODE_FEATURES = ("degree", "betweenness", "closeness", "clustering", "pagerank", "is_router", "is_switch", "interface_count", "error_rate", "utilization")
EDGE_FEATURES = ("speed", "utilization_in", "utilization_out", "error_rate", "is_ospf", "is_bgp", "is_static", "is_eigrp", "weight")


def node_index(graph: Topology) -> DataFrame:
    """(id, i): places in the order of ids."""
    return numbered(graph.nodes.select("id"), ["id"], "i")


def node_features(graph: Topology, names: tuple[str, ...] = NODE_FEATURES, pagerank_rounds: int | None = None) -> DataFrame:
    """(id, one column a feature). A name that is none of the known ones is read as an attribute, 0 where it is no number."""
    g = graph.undirected()
    made = {"degree": g.degree, "betweenness": lambda: centrality.betweenness(g), "closeness": lambda: traversal.closeness(g), "clustering": lambda: traversal.clustering(g).select("id", "clustering"), "pagerank": lambda: centrality.pagerank(g, rounds=pagerank_rounds)}
    got = graph.nodes
    for name in names:
        if name in made:
            got = got.drop(name).join(made[name](), "id", "left")
    flags = {"is_router": F.coalesce(F.col("type") == "router", F.lit(False)), "is_switch": F.coalesce(F.array_contains("capabilities", "Bridge"), F.lit(False))}
    out = []
    for name in names:
        if name in flags:
            value = flags[name].cast("double")
        elif name in got.columns:
            kind = dict(got.dtypes)[name]
            value = F.col(name).try_cast("double") if not kind.startswith(("array", "map", "struct")) else F.lit(0.0)
        else:
            value = F.lit(0.0)
        out.append(F.coalesce(value, F.lit(0.0)).alias(name))
    return got.select("id", *out)


def edge_features(graph: Topology) -> DataFrame:
    """(src, dst, one column a feature)."""
    e, have = graph.edges, set(graph.edges.columns)
    number = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)
    low = F.lower(F.coalesce("protocol", F.lit(""))) if "protocol" in have else F.lit("")
    flag = lambda *p: low.isin(*p).cast("double")
    return e.select("src", "dst", number("speed_mbps", 0.0).alias("speed"), *[number(c, 0.0).alias(c) for c in ("utilization_in", "utilization_out", "error_rate")], flag(*OSPF).alias("is_ospf"), flag("bgp").alias("is_bgp"), flag("static").alias("is_static"), flag(*EIGRP).alias("is_eigrp"), number("weight", 1.0).alias("weight"))


def normalised_adjacency(graph: Topology, weight: str | None = "weight") -> DataFrame:
    """(a, b, v) of the symmetric normalisation of the adjacency with self loops, in sparse cells."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in graph.edges.columns else F.lit(1.0)
    g = graph
    there = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w"))
    both = there if g.directed else there.union(g.edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), w.alias("w")))
    cells = both.union(g.nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w"))
    d = cells.groupBy("a").agg(F.sum("w").alias("d"))
    return cells.join(d, "a").join(d.withColumnsRenamed({"a": "b", "d": "e"}), "b").select("a", "b", (F.col("w") / (F.sqrt("d") * F.sqrt("e"))).alias("v"))


def z_norm(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is below 1e-8)."""
    stats = table.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    rest = [c for c in table.columns if c not in columns]
    return table.crossJoin(stats).select(*rest, *[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))).alias(c) for c in columns])


def matrices(graph: Topology, names: tuple[str, ...] = NODE_FEATURES, normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Features by node (id, i, one column a feature), normalised by column if asked for, and the normalised adjacency (a, b, v)."""
    table = node_features(graph, names)
    table = z_norm(table, list(names)) if normalise else table
    return node_index(graph).join(table, "id"), normalised_adjacency(graph)
