"""Topology: a graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges with the smaller end first; the given ends stay as orig_src and orig_dst."""
    rest = [c for c in edges.columns if c not in (src, dst, "orig_src", "orig_dst")]
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), F.col(src).alias("orig_src"), F.col(dst).alias("orig_dst"), *rest)


def last_write_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row a key: each column's last value by ordinal that is not NULL (a NULL attribute is one not written)."""
    rest = [c for c in rows.columns if c not in keys and c != ordinal]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in rest])


@dataclass
class Topology:
    """nodes(id, ...) and edges(src, dst, ...); at most one edge for each pair. Undirected edges are canonical.

    linked: the nodes are known to be the edges' ends.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    linked: bool = False

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, directed: bool = False, ordinal: str | None = None, whole: bool = False, linked: bool = False) -> Topology:
        """Merges repeated nodes and edges, the last by ordinal winning, and adds ends that have no node row.

        whole: every end is known to have one. linked: besides, every node is an end.
        """
        if not directed:
            edges = canonical(edges)
        if ordinal:
            nodes = last_write_wins(nodes, ["id"], ordinal)
            edges = last_write_wins(edges, ["src", "dst"], ordinal)
        if whole or linked:
            return cls(nodes, edges, directed, linked)
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(nodes.join(ends, "id", "full_outer"), edges, directed)

    def undirected(self) -> Topology:
        if not self.directed:
            return self
        rest = [c for c in self.edges.columns if c not in ("src", "dst", "orig_src", "orig_dst")]
        flat = canonical(self.edges.select("src", "dst", *rest)).groupBy("src", "dst").agg(*[F.max_by(c, F.struct("orig_src", "orig_dst")).alias(c) for c in ["orig_src", "orig_dst", *rest]])
        return Topology(self.nodes, flat)

    def arcs(self, *columns: str) -> DataFrame:
        """(a, b) from each node to its neighbours: both ways if undirected, successors if directed."""
        there = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *columns)
        return there if self.directed else there.union(self.edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *columns))

    def degree(self) -> DataFrame:
        """(id, degree), 0 for isolates; a loop counts twice."""
        if self.linked:
            return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id")))
        return self.nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def isolates(self) -> DataFrame:
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id")))
        return self.nodes.join(ends, "id", "left_anti").select("id")

    def summary(self) -> DataFrame:
        """One row: nodes, edges, density, mean and population deviation of the degree."""
        d = self.degree().agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"), F.sum("degree").alias("ends"))
        n, m = F.col("nodes"), (F.col("ends") / 2).cast("bigint")
        pairs = n * (n - 1)
        return d.select("nodes", F.coalesce(m, F.lit(0)).alias("edges"), F.when(pairs > 0, m * (1.0 if self.directed else 2.0) / pairs).otherwise(0.0).alias("density"), F.coalesce("mean_degree", F.lit(0.0)).alias("mean_degree"), F.coalesce("std_degree", F.lit(0.0)).alias("std_degree"))

    def induced(self, ids: DataFrame) -> Topology:
        """The subgraph of the nodes whose id is in ids."""
        keep = ids.select("id").distinct()
        edges = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Topology(self.nodes.join(keep, "id", "left_semi"), edges.select(*self.edges.columns), self.directed)

    def where(self, condition: Column | str) -> Topology:
        return self.induced(self.nodes.where(condition).select("id"))

    def by_attribute(self, name: str, value) -> Topology:
        """Nodes whose attribute equals value; an absent attribute equals None."""
        return self.where(F.col(name).eqNullSafe(F.lit(value)))

    def without(self, ids: DataFrame) -> Topology:
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Topology(self.nodes.join(gone, "id", "left_anti"), edges.select(*self.edges.columns), self.directed)
