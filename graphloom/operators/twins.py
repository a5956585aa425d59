"""Undirected graphs with their twins as one: nodes that are not linked and have the same neighbours.

Distances, shortest paths and short cycles of all nodes follow from one node of each class and the sizes of the classes.
Only nodes of up to MOST neighbours are compared, by the neighbours themselves; a node of more stands for itself, so no row
holds a hub's neighbours. Without twins the classes are the nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.session import materialise

#: Neighbours of nodes that are compared.
MOST = 16


@dataclass
class Classes:
    """links (a, b): the graph's arcs without loops; members (id, twin): nodes with a neighbour and their class, named by its
    least node; sizes (id, w); arcs (a, b) between classes: all of the one with all of the other."""

    links: DataFrame
    members: DataFrame
    sizes: DataFrame
    arcs: DataFrame


def collapse(graph: Topology) -> Classes:
    """The classes of an undirected graph; a directed one has each node for itself."""
    links = materialise(graph.arcs().where("a <> b").select("a", "b").distinct(), "links")
    if graph.directed:
        ids = materialise(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "twins")
        return Classes(links, ids.select("id", F.col("id").alias("twin")), ids.select("id", F.lit(1).cast("bigint").alias("w")), links)
    size = links.groupBy("a").agg(F.count("*").alias("k"))
    few = links.join(size.where(F.col("k") <= MOST), "a", "left_semi").groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    few = materialise(few, "twins")
    twin = few.groupBy("near").agg(F.min("a").alias("twin"))
    members = few.join(twin, "near").select(F.col("a").alias("id"), "twin").union(size.where(F.col("k") > MOST).select(F.col("a").alias("id"), F.col("a").alias("twin")))
    members = materialise(members, "twins")
    sizes = materialise(members.groupBy(F.col("twin").alias("id")).agg(F.count("*").alias("w")), "twins")
    one = links.join(sizes.select(F.col("id").alias("a")), "a", "left_semi").join(members.withColumnRenamed("id", "b"), "b")
    return Classes(links, members, sizes, materialise(one.select("a", F.col("twin").alias("b")).distinct(), "twins"))
