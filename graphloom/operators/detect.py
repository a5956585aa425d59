"""Anomaly detection: reconstruction, degree, structure and change over time, added up by node."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.gnn import links as L
from graphloom.gnn.models import Autoencoder
from graphloom.operators import cuts, features, ranks, temporal
from graphloom.session import materialise

#: Nodes of a graph whose dense matrices one process takes: 8 * n * n bytes each.
DENSE_LIMIT = 5_000
#: Nodes of which the driver itself sums up all pairs; beyond, tasks do.
HERE_LIMIT = 2_000


def degree_scores(degree: DataFrame, z_limit: float = 2.0) -> DataFrame:
    """(id, degree, z, score): a tenth of |z| where the degree is more than z_limit population deviations off."""
    stats = degree.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("degree") - F.col("m")) / F.col("s")).otherwise(0.0)
    got = degree.crossJoin(stats).select("id", "degree", z.alias("z"))
    return got.withColumn("score", F.when(F.abs("z") > z_limit, 0.1 * F.abs("z")).otherwise(0.0))


def structure_scores(graph: Topology, found: DataFrame | None = None) -> DataFrame:
    """(id, score): 0.3 for a cut vertex, 0.5 for an isolate."""
    points = cuts.articulation_points(found if found is not None else cuts.cuts(graph)).withColumn("score", F.lit(0.3))
    return points.union(graph.isolates().withColumn("score", F.lit(0.5))).groupBy("id").agg(F.sum("score").alias("score"))


def combine(*scores: DataFrame) -> DataFrame:
    """(id, score): contributions added up."""
    every = scores[0].select("id", "score")
    for s in scores[1:]:
        every = every.union(s.select("id", "score"))
    return every.groupBy("id").agg(F.sum("score").alias("score"))


def above(scores: DataFrame, percentile: float = 95.0, threshold: float | None = None) -> DataFrame:
    """Scores strictly above a threshold, or above the interpolated percentile of their own."""
    if threshold is not None:
        return scores.withColumn("threshold", F.lit(threshold)).where("score > threshold")
    value = ranks.percentile(scores, "score", percentile / 100)
    return scores.withColumn("threshold", F.lit(value).cast("double")).where("score > threshold")


def _by_tasks(spark: SparkSession):
    """Runs a sum over all pairs (graphloom.gnn.links) with blocks of rows spread over tasks; each holds all vectors, a few numbers a node."""

    def run(f, z: np.ndarray) -> np.ndarray:
        n, size = len(z), L.BLOCK
        blocks = -(-n // size)

        def part(batches):
            for batch in batches:
                for b in batch.column("id").to_pylist():
                    got = np.ascontiguousarray(f(z, b * size, min((b + 1) * size, n)))
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([got.tobytes()])], ["block", "sums"])

        tasks = min(blocks, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = spark.range(0, blocks, 1, tasks).mapInArrow(part, "block long, sums binary").toArrow().sort_by("block")
        return np.frombuffer(b"".join(rows["sums"].to_pylist())).reshape(n, -1)

    return run


class Detector:
    """Fits an autoencoder on a baseline graph; detect() scores another against it.

    The driver holds features and links, less than 1 kB for each; pairs of nodes are all looked at, by tasks, and never held.
    """

    def __init__(self, hidden: int = 32, latent: int = 16, percentile: float = 95.0, window: int = 10, seed: int = 42):
        self.hidden, self.latent, self.percentile, self.window, self.seed = hidden, latent, percentile, window, seed
        self.model: Autoencoder | None = None
        self.threshold: float | None = None
        self.baseline: dict[str, float] = {}
        self.snapshots: list[tuple[DataFrame, DataFrame]] = []
        self._known: tuple | None = None  # the last graph, with its features, links and errors

    def _links(self, graph: Topology) -> tuple[pa.Array, np.ndarray, L.Links]:
        """Ids in their order, normalised features and links."""
        table = features.node_features(graph, pagerank_rounds=20).orderBy("id").toArrow()
        ids = table["id"].combine_chunks()
        x = np.stack([np.nan_to_num(table[c].to_numpy()) for c in features.NODE_FEATURES], 1) if len(ids) else np.zeros((0, len(features.NODE_FEATURES)))
        std = x.std(0) if len(x) else 0
        x = (x - x.mean(0)) / np.where(std < 1e-8, 1, std) if len(x) else x
        edges = graph.undirected().edges.select("src", "dst").toArrow()
        src, dst = (pc.index_in(edges[c], value_set=ids).to_numpy() for c in ("src", "dst"))
        if edges.num_rows and (np.isnan(src).any() or np.isnan(dst).any()):
            raise KeyError("a link's end is no node")
        return ids, x, L.Links(len(ids), src, dst, _by_tasks(graph.nodes.sparkSession) if len(ids) > HERE_LIMIT else L.here)

    def _dense(self, graph: Topology) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = graph.nodes.count()
        if n > DENSE_LIMIT:
            raise ValueError(f"{n} nodes; dense matrices are made for {DENSE_LIMIT} at most")
        ids, x, links = self._links(graph)
        a = np.zeros((n, n))
        a[links.i, links.j] = 1.0
        return ids.to_pylist(), x, a

    def _snapshot(self, graph: Topology) -> None:
        g = graph.undirected()
        self.snapshots.append((materialise(g.nodes.select("id"), "snapshot"), materialise(g.edges.select("src", "dst"), "snapshot")))
        self.snapshots = self.snapshots[-1000:]

    def fit(self, graph: Topology, epochs: int = 100, rate: float = 0.001) -> Detector:
        ids, x, a = self._links(graph)
        self.model = Autoencoder(x.shape[1], self.hidden, self.latent, seed=self.seed)
        self.model.train(x, a, epochs, rate)
        node, links = self.model.errors(x, a)
        self._known = graph, ids, a, node, links
        self.threshold = float(np.percentile(node, self.percentile)) if len(node) else None
        self.baseline = {"mean": float(node.mean()), "std": float(node.std())} if len(node) else {}
        self._snapshot(graph)
        return self

    def detect(self, graph: Topology) -> dict:
        """node_scores, edge_scores, flagged (above the threshold), events and the graph's own score."""
        spark = graph.nodes.sparkSession
        self._snapshot(graph)
        parts, edges, score = [graph.nodes.select("id", F.lit(0.0).alias("score"))], spark.createDataFrame([], "src string, dst string, score double"), 0.0
        if self.model:
            if not self._known or self._known[0] is not graph:
                ids, x, a = self._links(graph)
                self._known = graph, ids, a, *self.model.errors(x, a)
            _, ids, a, node, links = self._known
            score = float(node.mean()) if len(node) else float("nan")
            if len(node):
                parts.append(spark.createDataFrame(pa.table({"id": ids, "score": node})))
            if len(links):
                edges = spark.createDataFrame(pa.table({"src": ids.take(pa.array(a.i)), "dst": ids.take(pa.array(a.j)), "score": links}))
        found = cuts.cuts(graph)
        parts += [degree_scores(graph.undirected().degree()), structure_scores(graph, found)]
        total = materialise(combine(*parts), "scores")
        return {
            "node_scores": total,
            "edge_scores": edges,
            "flagged": above(total, self.percentile, self.threshold) if self.model else above(total.where("score > 0"), self.percentile),
            "events": self._events(spark),
            "graph_score": score,
            "articulation_points": cuts.articulation_points(found),
            "bridges": cuts.bridges(found),
        }

    def _events(self, spark) -> DataFrame:
        nodes = edges = None
        for seq, (n, e) in enumerate(self.snapshots):
            n, e = n.withColumn("seq", F.lit(seq)), e.withColumn("seq", F.lit(seq))
            nodes, edges = (n, e) if nodes is None else (nodes.union(n), edges.union(e))
        seqs = spark.range(len(self.snapshots)).select(F.col("id").cast("int").alias("seq"))
        deltas = temporal.magnitudes(seqs, temporal.changes(nodes, ["id"], seqs), temporal.changes(edges, ["src", "dst"], seqs))
        return temporal.events(deltas, self.window).where(F.col("seq") == len(self.snapshots) - 1)
