"""Graphs and series derived from the driver's tables, over all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, written: bool = False) -> Topology:
    """Customers and suppliers, linked by order lines: a large bipartite graph. With written, both tables are, as in site()."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    pairs = materialise(pairs, "trade") if written else pairs
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct()
    return Topology(materialise(ids, "trade") if written else ids, pairs)


def site(spark: SparkSession, sf_dir: str) -> Topology:
    """Suppliers, nations and regions as servers, switches and routers.

    A supplier is linked to its nation and to the nation whose customers bring it the most lines (ties: the smaller
    key); nations are linked to their region. Loads come from discounts, error rates from returned lines.
    Both tables are written: what asks for them many times does not read the lines again.
    """
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_returnflag")
    sold = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    per = sold.groupBy("l_suppkey", "c_nationkey").agg(F.count("*").alias("lines"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    per = materialise(per, "site")
    best = per.withColumn("r", F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("lines"), "c_nationkey"))).where("r = 1")
    load, bad = (F.col("discount") * 10.0 / F.col("lines")).alias("utilization_in"), (F.col("returned") * 0.05 / F.col("lines")).alias("error_rate")
    whole = per.groupBy("l_suppkey").agg(F.sum("lines").alias("lines"), F.sum("discount").alias("discount"), F.sum("returned").alias("returned"))
    ends = s.select("s_suppkey", "s_nationkey")
    home = ends.join(whole, F.col("s_suppkey") == F.col("l_suppkey"), "left").na.fill({"lines": 1, "discount": 0, "returned": 0}).select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst"), F.lit("ospf").alias("protocol"), F.lit(1000).alias("speed_mbps"), load, bad)
    back = best.join(ends, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").select(key("n", "c_nationkey").alias("src"), key("s", "l_suppkey").alias("dst"), F.lit("bgp").alias("protocol"), F.lit(100).alias("speed_mbps"), load, bad)
    up = n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("static").alias("protocol"), F.lit(10000).alias("speed_mbps"), F.lit(0.0).alias("utilization_in"), F.lit(0.0).alias("error_rate"))
    nodes = r.select(key("r", "r_regionkey").alias("id"), F.lit("router").alias("type"), F.array(F.lit("Router")).alias("capabilities"), F.lit(0.0).alias("utilization"))
    nodes = nodes.union(n.select(key("n", "n_nationkey"), F.lit("switch"), F.array(F.lit("Bridge")), F.lit(50.0))).union(s.select(key("s", "s_suppkey"), F.lit("server"), F.array().cast("array<string>"), F.abs("s_acctbal") / 100.0))
    return Topology(materialise(nodes, "site"), materialise(home.union(back).union(up), "site"))


def nation_flow(spark: SparkSession, sf_dir: str) -> Topology:
    """Customers' nations to suppliers' nations, directed, weighted by lines."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s, l = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    flow = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    name = lambda k: F.concat(F.lit("n"), F.col(k).cast("string"))
    e = flow.groupBy(name("c_nationkey").alias("src"), name("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return Topology(table(spark, sf_dir, "nation").select(name("n_nationkey").alias("id")), e, directed=True)


def daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots by day of users and the kinds of their events: (seqs, nodes, edges)."""
    e = table(spark, sf_dir, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"), F.concat(F.lit("e_"), "event_type").alias("k"))
    edges = e.groupBy("seq", F.col("k").alias("src"), F.col("u").alias("dst")).agg(F.count("*").alias("n"))
    nodes = edges.select("seq", F.col("src").alias("id")).union(edges.select("seq", F.col("dst").alias("id"))).distinct()
    return edges.select("seq").distinct(), nodes, edges


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, util, errors): each user's daily mean value in cents and share of errors."""
    e = table(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("seq"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), (F.col("event_type") == "error").cast("bigint").alias("bad"))
    return e.groupBy("user_id", "seq").agg((F.sum("cents") / 100.0 / F.count("*")).alias("util"), (F.sum("bad") / F.count("*")).alias("errors"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters of each supplier by month of shipment: octets from quantities, errors from returns."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("device"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    w = W.partitionBy("device").orderBy("month")
    return m.select("device", "month", F.sum("q").over(w).alias("in_bytes"), F.sum("r").over(w).alias("in_errors"), F.sum("n").over(w).alias("in_packets"))
