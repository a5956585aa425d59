"""Interface states against each other and onto graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.functions import columns as C

COUNTERS = ("in_bytes", "out_bytes", "in_errors", "out_errors")


def derived(states: DataFrame) -> DataFrame:
    """States with is_up, utilization_in, utilization_out and error_rate."""
    return states.withColumns({"is_up": C.is_up("admin_status", "oper_status"), "utilization_in": C.utilization("input_rate_bps", "speed_mbps"), "utilization_out": C.utilization("output_rate_bps", "speed_mbps"), "error_rate": C.error_rate("in_errors", "out_errors", "in_packets", "out_packets")})


def device_summary(states: DataFrame, *keys: str) -> DataFrame:
    """Interfaces that are up and down, and all errors, of each device (and snapshot)."""
    up = C.is_up("admin_status", "oper_status")
    return states.groupBy("device", *keys).agg(F.count_if(up).alias("up_count"), F.count_if(~up).alias("down_count"), F.sum(F.col("in_errors") + F.col("out_errors")).alias("total_errors"))


def counter_deltas(polls: DataFrame, keys: list[str], order: str, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Growth of counters since the poll before; a counter that fell back counts as 0, a first poll has none."""
    w = W.partitionBy(*keys).orderBy(order)
    got = polls.select(*keys, order, *[F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)).alias(f"{c}_delta") for c in counters], F.lag(order).over(w).isNotNull().alias("_follows"))
    return got.where("_follows").drop("_follows")


def annotate(graph: Topology, states: DataFrame, by_device: bool = True) -> Topology:
    """Edges with the state of the interface at their local port; edges without one stay as they are.

    by_device: the interface must be of the edge's own device (orig_src); else the port's name alone decides. Of several
    states of an interface the last by ts counts (ties, or states without ts: the greatest by its other columns).
    """
    known = ("oper_status", "speed_mbps", "utilization_in", "utilization_out", "error_rate", "input_rate_bps", "output_rate_bps")
    keys = ["device", "name"] if by_device else ["name"]
    ts = [F.col("ts")] if "ts" in states.columns else []
    last = derived(states).groupBy(*keys).agg(F.max(F.struct(*ts, *known)).alias("last"))
    s = last.select(*([F.col("device").alias("_device")] if by_device else []), F.col("name").alias("_port"), *[F.col(f"last.{c}").alias(f"_{c}") for c in known])
    on = (F.col("local_port") == F.col("_port")) & (F.col("orig_src") == F.col("_device") if by_device else F.lit(True))
    e = graph.edges.join(s, on, "left")
    keep = [c for c in graph.edges.columns if c not in known]
    return Topology(graph.nodes, e.select(*keep, *[(F.coalesce(f"_{c}", c) if c in graph.edges.columns else F.col(f"_{c}")).alias(c) for c in known]), graph.directed)
