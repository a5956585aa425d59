"""Failure, overload, capacity and service-level predictions from states and their trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.functions import columns as C
from graphloom.operators import centrality, traversal


def history(graph: Topology, seq: int, ts: float) -> DataFrame:
    """(seq, ts, entity_type, u, v, metric, value) of one observation of a graph."""
    e, n = graph.edges, graph.nodes
    has = set(e.columns)
    number = lambda df, c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    node = n.select(F.lit("node").alias("entity_type"), F.col("id").alias("u"), F.lit(None).cast("string").alias("v"), F.lit("util").alias("metric"), number(n, "utilization").alias("value"))
    names = {"errors": "error_rate", "util_in": "utilization_in", "util_out": "utilization_out"}
    parts = [e.select(F.lit("edge").alias("entity_type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(m).alias("metric"), number(e, c).alias("value")) for m, c in names.items() if c in has]
    for p in parts:
        node = node.union(p)
    return node.select(F.lit(seq).alias("seq"), F.lit(float(ts)).alias("ts"), *node.columns)


def trends(points: DataFrame, keys: list[str], value: str, order: str = "seq", lookback: int = 10) -> DataFrame:
    """(keys, trend, n): the slope of the last values against 0, 1, 2 ...; 0 for fewer than three."""
    recent = W.partitionBy(*keys).orderBy(F.desc(order))
    kept = points.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= lookback)
    got = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(value).cast("double"), -F.col("_r").cast("double")).alias("slope"))
    flat = F.abs("slope") < 1e-12  # what rounding leaves of a constant series
    return got.select(*keys, F.when((F.col("n") >= 3) & ~flat, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("trend"), "n")


def _sum(*terms: tuple[Column, float]) -> Column:
    return sum((F.when(c, F.lit(v)).otherwise(0.0) for c, v in terms), F.lit(0.0))


def _texts(*terms: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in terms]))


def _number(df: DataFrame, c: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in df.columns else F.lit(default)


def link_failures(edges: DataFrame, trend: DataFrame | None = None, observations: int = 1, horizon: float = 24.0) -> DataFrame:
    """One row a link (src, dst): risk, probability, level, hours, confidence and factors. trend: (src, dst, trend) of error rates."""
    e = edges.join(trend.select("src", "dst", "trend"), ["src", "dst"], "left") if trend is not None else edges.withColumn("trend", F.lit(0.0))
    rate, util = _number(e, "error_rate"), F.greatest(_number(e, "utilization_in"), _number(e, "utilization_out"))
    up = F.coalesce("trend", F.lit(0.0))
    down = F.coalesce(F.col("oper_status") == "down", F.lit(False)) if "oper_status" in e.columns else F.lit(False)
    risk = _sum((rate > 0.01, 0.3), (rate > 0.05, 0.3), (util > 80, 0.2), (util > 95, 0.2)) + F.when(up > 0, F.least(up * 10, F.lit(0.3))).otherwise(0.0)
    risk = F.when(down, 1.0).otherwise(risk)
    p = C.sigmoid(risk * 4 - 2)
    factors = _texts((rate > 0.01, F.format_string("High error rate: %.4f", rate)), (rate > 0.05, "Critical error rate"), (util > 80, F.format_string("High utilization: %.1f%%", util)), (util > 95, "Near capacity saturation"), (up > 0, F.format_string("Error trend increasing: %.4f/interval", up)), (down, "Link currently down"))
    return e.select("src", "dst", risk.alias("risk"), p.alias("probability"), C.risk_level(p).alias("risk_level"), F.when(p > 0.1, F.greatest(horizon * (1 - p), F.lit(1.0))).alias("hours"), F.lit(min(0.5 + 0.05 * observations, 0.95)).alias("confidence"), factors.alias("factors"))


def node_overloads(graph: Topology, between: DataFrame | None = None, observations: int = 1) -> DataFrame:
    """One row a node: degree over twice the mean, utilization over 70, betweenness over 0.3. between: (id, betweenness)."""
    between = between if between is not None else centrality.betweenness(graph)
    d = graph.degree()
    rows = graph.nodes.join(d, "id").join(between, "id", "left").crossJoin(d.agg(F.avg("degree").alias("mean_degree")))
    util, b = _number(rows, "utilization"), F.coalesce("betweenness", F.lit(0.0))
    big = F.col("degree") > 2 * F.col("mean_degree")
    p = C.sigmoid(_sum((big, 0.2), (util > 70, 0.3), (b > 0.3, 0.2)) * 4 - 2)
    factors = _texts((big, F.format_string("High degree: %d (avg: %.1f)", "degree", "mean_degree")), (util > 70, F.format_string("High utilization: %.1f%%", util)), (b > 0.3, "High betweenness centrality — traffic bottleneck"))
    return rows.select("id", p.alias("probability"), C.risk_level(p).alias("risk_level"), F.lit(min(0.5 + 0.05 * observations, 0.95)).alias("confidence"), factors.alias("factors")).where("probability > 0.05")


def capacity(edges: DataFrame, trend_in: DataFrame, trend_out: DataFrame, observations: int = 1, horizon: float = 24.0) -> DataFrame:
    """Links that grow towards their speed within seven horizons. Trends: (src, dst, trend) in percent an interval."""
    e = edges.join(trend_in.select("src", "dst", F.col("trend").alias("_in")), ["src", "dst"], "left").join(trend_out.select("src", "dst", F.col("trend").alias("_out")), ["src", "dst"], "left")
    util = F.greatest(_number(e, "utilization_in"), _number(e, "utilization_out"))
    t = F.when(F.coalesce("_in", F.lit(0.0)) > 0, F.col("_in")).otherwise(F.coalesce("_out", F.lit(0.0)))
    e = e.select("src", "dst", util.alias("utilization"), t.alias("trend"), _number(e, "speed_mbps").alias("speed_mbps")).where("speed_mbps > 0 and trend > 0 and utilization > 50")
    e = e.withColumn("hours", (100 - F.col("utilization")) / (F.col("trend") * 12)).where(F.col("hours") < horizon * 7)
    factors = F.array(F.format_string("Current utilization: %.1f%%", "utilization"), F.format_string("Growth trend: %.2f%%/interval", "trend"), F.format_string("Speed: %.0f Mbps", "speed_mbps"), F.format_string("Estimated exhaustion: %.0f hours", "hours"))
    return e.select("src", "dst", F.least(F.col("utilization") / 100, F.lit(0.99)).alias("probability"), C.risk_level(F.col("utilization") / 100).alias("risk_level"), "hours", F.lit(min(0.4 + 0.06 * observations, 0.9)).alias("confidence"), factors.alias("factors"))


def sla_violations(graph: Topology, redundant: DataFrame | None = None) -> DataFrame:
    """One row a link: loss over 0.1 percent, utilization over 70, no second path of up to three edges."""
    redundant = redundant if redundant is not None else traversal.redundant_edges(graph)
    e = graph.edges.join(redundant, ["src", "dst"], "left")
    rate, util = _number(e, "error_rate"), F.greatest(_number(e, "utilization_in"), _number(e, "utilization_out"))
    single = ~F.coalesce("redundant", F.lit(False))
    p = C.sigmoid(_sum((rate > 0.001, 0.3), (util > 70, 0.2), (single, 0.2)) * 4 - 2)
    factors = _texts((rate > 0.001, F.format_string("Packet loss: %.3f%%", rate * 100)), (util > 70, F.format_string("Congestion risk at %.1f%% utilization", util)), (single, "No redundant paths"))
    return e.select("src", "dst", p.alias("probability"), C.risk_level(p).alias("risk_level"), F.lit(0.6).alias("confidence"), factors.alias("factors")).where("probability > 0.1")


def summary(*lists: DataFrame) -> DataFrame:
    """One row: predictions in all, critical and high ones, and the health they give."""
    every = lists[0].select("risk_level")
    for x in lists[1:]:
        every = every.union(x.select("risk_level"))
    c = every.agg(F.count("*").alias("total"), F.count_if(F.col("risk_level") == "critical").alias("critical"), F.count_if(F.col("risk_level") == "high").alias("high"))
    return c.withColumn("health", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "degraded").otherwise("healthy"))
