"""Snapshots of graphs over time, as nodes(seq, id, ...) and edges(seq, src, dst, ...) with canonical edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.ranks import numbered


def changes(rows: DataFrame, keys: list[str], seqs: DataFrame | None = None, attributes: list[str] | None = None) -> DataFrame:
    """(seq, keys, kind) of what differs from the snapshot before: added, removed or modified.

    Each key's presence is compared along the snapshots' own order, so every pair of neighbours costs one shuffle by
    key, not a join each. seqs: the snapshots there are (by default those with rows). A modified row differs in one of the
    attributes; a null differs from any value.
    """
    seqs = (seqs if seqs is not None else rows.select("seq")).select("seq").distinct()
    ranked = seqs.select("seq", F.row_number().over(W.orderBy("seq")).alias("place"), F.lead("seq").over(W.orderBy("seq")).alias("next_seq"))
    print_ = F.struct(*attributes) if attributes else F.lit(0)
    have = rows.join(ranked, "seq").select(*keys, "seq", "place", "next_seq", print_.alias("print"))
    w = W.partitionBy(*keys).orderBy("place")
    seen = have.select("*", F.lag("place").over(w).alias("before"), F.lag("print").over(w).alias("old"), F.lead("place").over(w).alias("after"))
    added = seen.where("place > 1 and (before is null or before <> place - 1)").select("seq", *keys, F.lit("added").alias("kind"))
    gone = seen.where("next_seq is not null and (after is null or after <> place + 1)").select(F.col("next_seq").alias("seq"), *keys, F.lit("removed").alias("kind"))
    changed = seen.where("before = place - 1 and not (old <=> print)").select("seq", *keys, F.lit("modified").alias("kind"))
    return added.union(gone).union(changed)


def magnitudes(seqs: DataFrame, node_changes: DataFrame, edge_changes: DataFrame) -> DataFrame:
    """(seq, nodes_added, ..., magnitude, is_stable) of each snapshot but the first: nodes weigh 1, edges 2, changes 1.

    A snapshot is stable if nothing came or went; changed attributes do not count.
    """
    parts = node_changes.select("seq", F.concat(F.lit("nodes_"), "kind").alias("what")).union(edge_changes.select("seq", F.concat(F.lit("edges_"), "kind").alias("what")))
    names = [f"{a}_{b}" for a in ("nodes", "edges") for b in ("added", "removed", "modified")]
    counts = parts.groupBy("seq").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
    first = seqs.agg(F.min("seq").alias("_first"))
    got = seqs.select("seq").distinct().crossJoin(first).where("seq > _first").drop("_first").join(counts, "seq", "left").na.fill(0)
    return got.withColumns({"magnitude": F.expr("nodes_added + nodes_removed + 2 * (edges_added + edges_removed) + nodes_modified + edges_modified"), "is_stable": F.expr("nodes_added + nodes_removed + edges_added + edges_removed = 0")})


def z_scores(series: DataFrame, value: str, order: str = "seq", window: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Each value's distance from the mean of the window that ends with it, in population deviations (0 if they are 0)."""
    w = W.partitionBy(*(keys or [])).orderBy(order).rowsBetween(1 - window, 0)
    mean, std = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return series.withColumns({"window_mean": mean, "window_std": std, "z": F.when(std > 0, (F.col(value) - mean) / std).otherwise(0.0)})


def events(deltas: DataFrame, window: int = 10, threshold: float = 2.0) -> DataFrame:
    """(seq, event): sudden_change where the magnitude stands out, node_disappearance and new_nodes."""
    z = z_scores(deltas, "magnitude", window=window)
    found = F.array_compact(F.array(F.when(F.col("z") > threshold, "sudden_change"), F.when(F.col("nodes_removed") > 0, "node_disappearance"), F.when(F.col("nodes_added") > 0, "new_nodes")))
    return z.select("seq", "z", F.explode(found).alias("event"))


def last(rows: DataFrame, n: int, seqs: DataFrame) -> DataFrame:
    """Rows of the last n snapshots: also what is kept under a retention of n."""
    kept = seqs.select("seq").distinct().orderBy(F.desc("seq")).limit(n)
    return rows.join(kept, "seq", "left_semi")


def between(rows: DataFrame, start: float, end: float, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts).between(start, end))


def adjacency_cells(edges: DataFrame, nodes: DataFrame, value: str | None = None) -> DataFrame:
    """(t, i, j, v) of the snapshots' adjacency tensor, both directions; indices run over the ids of all snapshots in order."""
    index = numbered(nodes.select("id").distinct(), ["id"], "i")
    times = edges.select("seq").union(nodes.select("seq")).distinct()
    t = times.select("seq", (F.row_number().over(W.orderBy("seq")) - 1).alias("t"))
    one = F.coalesce(F.col(value), F.lit(1.0)).cast("float") if value else F.lit(1.0).cast("float")
    e = edges.select("seq", "src", "dst", one.alias("v")).join(t, "seq").join(index.withColumnsRenamed({"id": "src"}), "src").join(index.withColumnsRenamed({"id": "dst", "i": "j"}), "dst")
    return e.select("t", "i", "j", "v").union(e.where("i <> j").select("t", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def evolution(seqs: DataFrame, nodes: DataFrame, edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """One row: how many snapshots, sizes at both ends and their range, total and mean changes, stable ones."""
    per = seqs.select("seq").distinct().join(nodes.groupBy("seq").agg(F.count("*").alias("n")), "seq", "left").join(edges.groupBy("seq").agg(F.count("*").alias("m")), "seq", "left").na.fill(0)
    sizes = per.agg(F.count("*").alias("snapshots"), F.min_by("n", "seq").alias("first_nodes"), F.max_by("n", "seq").alias("last_nodes"), F.min_by("m", "seq").alias("first_edges"), F.max_by("m", "seq").alias("last_edges"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"), F.avg("n").alias("mean_nodes"), F.avg("m").alias("mean_edges"))
    moves = deltas.agg(F.coalesce(F.sum("magnitude"), F.lit(0)).alias("total_change"), F.coalesce(F.avg("magnitude"), F.lit(0.0)).alias("mean_change"), F.coalesce(F.max("magnitude"), F.lit(0)).alias("max_change"), F.count_if("is_stable").alias("stable"))
    return sizes.crossJoin(moves)
