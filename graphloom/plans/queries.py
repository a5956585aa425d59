"""Registered queries over the driver's tables, one for each operator or rule."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.frame import Topology, last_write_wins
from graphloom.functions import columns as C
from graphloom.gnn import passing
from graphloom.operators import centrality, cuts, detect, features, impact, interfaces, predict, temporal, traversal
from graphloom.plans import inputs as I
from graphloom.plans import devices
from graphloom.session import materialise
from graphloom.sinks import exports
from graphloom.sources import graphs, texts

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def r(x, n: int = 6):
    return F.round(x, n)


# -- graphs -------------------------------------------------------------------------------------------------------


@query
def degree_outliers(spark, d):
    got = detect.degree_scores(I.trade(spark, d).degree()).where("score > 0")
    return got.select("id", "degree", r("z").alias("z"), r("score").alias("score"))


@query
def top_k_degree_subgraph(spark, d):
    g = I.trade(spark, d)
    top = g.degree().orderBy(F.desc("degree"), "id").limit(10)
    return g.induced(top).degree().join(top.withColumnRenamed("degree", "whole_degree"), "id").select("id", "whole_degree", F.col("degree").alias("degree_inside"))


@query
def lww_merge(spark, d):
    l = I.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity").alias("ordinal"), "l_quantity", "l_shipdate")
    return last_write_wins(l, ["l_partkey", "l_suppkey"], "ordinal")


@query
def attribute_subgraph(spark, d):
    g = I.site(spark, d)
    g = g.where(F.col("type").isin("switch", "router"))
    return g.degree()


@query
def graph_summary(spark, d):
    s = I.trade(spark, d).summary()
    return s.select("nodes", "edges", r("density", 9).alias("density"), r("mean_degree").alias("mean_degree"), r("std_degree").alias("std_degree"))


@query
def directed_neighbors(spark, d):
    return I.nation_flow(spark, d).arcs().groupBy(F.col("a").alias("id")).agg(F.count("*").alias("successors"))


@query
def undirected_merge(spark, d):
    return I.nation_flow(spark, d).undirected().edges.select("src", "dst")


@query
def isolates(spark, d):
    c = I.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return Topology(c, I.trade(spark, d).edges).isolates()


@query
def connected_components(spark, d):
    g = I.site(spark, d)
    c = I.table(spark, d, "customer")
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    tree = g.edges.where("protocol <> 'bgp'").select("src", "dst").union(c.select(key("n", "c_nationkey"), key("c", "c_custkey")))
    nodes = g.nodes.select("id").union(c.select(key("c", "c_custkey")))
    return cuts.components(Topology(nodes, tree))


@query
def articulation_points(spark, d):
    return cuts.articulation_points(cuts.cuts(I.site(spark, d)))


@query
def bridges(spark, d):
    return cuts.bridges(cuts.cuts(I.site(spark, d)))


@query
def blast_radius(spark, d):
    b = impact.blast_radius(I.site(spark, d))
    return b.select("id", "direct", "indirect", "total_affected", r("connectivity_loss").alias("connectivity_loss"), "component_increase", "severity")


@query
def blast_edges(spark, d):
    return impact.blast_radius_edges(I.site(spark, d))


@query
def redundancy_score(spark, d):
    x = impact.redundancy(I.site(spark, d))
    return x.select("id", r("score").alias("score"), "alternate_paths", "is_spof", C.grade("score").alias("grade"))


@query
def redundancy_way_round(spark, d):
    return impact.redundancy(I.site(spark, d)).select("id", "min_path_length", "details")


@query
def what_if(spark, d):
    steps = impact.what_if(I.site(spark, d), [{"type": "node", "target": "n0"}, {"type": "edge", "target": ("n1", "r1")}, {"type": "node", "target": "r2"}, {"type": "node", "target": "missing"}])
    return spark.createDataFrame([(s["step"], s["before_nodes"], s["before_edges"], s["after_nodes"], s["after_edges"], s["components"], len(s["isolated_nodes"]), s["network_partitioned"]) for s in steps], "step bigint, before_nodes bigint, before_edges bigint, after_nodes bigint, after_edges bigint, components bigint, isolated bigint, network_partitioned boolean")


@query
def resilience(spark, d):
    x = impact.resilience(I.site(spark, d))
    return x.select(r("node_redundancy").alias("node_redundancy"), r("link_redundancy").alias("link_redundancy"), r("degree_score").alias("degree_score"))


@query
def resilience_full(spark, d):
    return impact.resilience(I.site(spark, d))


@query
def k_hop(spark, d):
    return traversal.k_hop(I.site(spark, d), "r0", 3)


@query
def critical_path(spark, d):
    return traversal.critical_path(I.site(spark, d), "r0", "r4").nodes.select("id")


@query
def all_pairs_hops(spark, d):
    g = I.site(spark, d)
    return traversal.all_pairs(g)


@query
def closeness(spark, d):
    return traversal.closeness(I.site(spark, d)).select("id", r("closeness").alias("closeness"))


@query
def triangles_clustering(spark, d):
    x = traversal.clustering(I.nation_flow(spark, d))
    return x.select("id", F.col("triangles").cast("bigint").alias("triangles"), r("clustering").alias("clustering"))


@query
def redundant_paths(spark, d):
    return traversal.redundant_edges(I.site(spark, d))


@query
def betweenness(spark, d):
    return centrality.betweenness(I.site(spark, d)).select("id", r("betweenness").alias("betweenness"))


@query
def edge_betweenness(spark, d):
    return centrality.edge_betweenness(I.site(spark, d)).select("src", "dst", r("betweenness").alias("betweenness"))


@query
def critical_links(spark, d):
    x = impact.critical_links(I.site(spark, d), 10)
    return x.select("src", "dst", r("betweenness").alias("betweenness"), "is_bridge", "indirect", "severity")


@query
def degree_centrality(spark, d):
    return centrality.degree_centrality(I.trade(spark, d)).select("id", r("degree_centrality").alias("degree_centrality"))


@query
def pagerank(spark, d):
    return centrality.pagerank(I.nation_flow(spark, d), rounds=10).select("id", r("pagerank", 8).alias("pagerank"))


@query
def pagerank_settled(spark, d):
    return centrality.pagerank(I.trade(spark, d, written=True)).select("id", r("pagerank", 8).alias("pagerank"))


@query
def high_centrality(spark, d):
    return centrality.high_centrality(I.site(spark, d), 10, "degree").select("id", r("value").alias("value"))


# -- features and networks ----------------------------------------------------------------------------------------


@query
def normalized_adjacency(spark, d):
    return features.normalised_adjacency(I.site(spark, d), None).select("a", "b", r("v", 8).alias("v"))


@query
def node_features(spark, d):
    x = features.node_features(I.site(spark, d), ("degree", "clustering", "is_router", "is_switch", "interface_count", "error_rate", "utilization"))
    return x.select("id", *[r(c).alias(c) for c in x.columns if c != "id"])


@query
def node_features_full(spark, d):
    x = features.node_features(I.site(spark, d), pagerank_rounds=20)
    return x.select("id", *[r(c).alias(c) for c in features.NODE_FEATURES])


@query
def edge_features(spark, d):
    x = features.edge_features(I.site(spark, d))
    return x.select("src", "dst", *[r(c).alias(c) for c in features.EDGE_FEATURES])


@query
def znorm(spark, d):
    g = I.trade(spark, d)
    return features.z_norm(g.degree().select("id", F.col("degree").cast("double").alias("degree")), ["degree"]).select("id", r("degree").alias("degree"))


W2 = np.array([[0.5, -0.25, 0.1], [-0.3, 0.2, 0.4]])
TO, OF = np.array([0.3, -0.2, 0.1]), np.array([0.1, 0.25, -0.3])


def _h(g: Topology) -> DataFrame:
    return g.degree().select("id", F.array(F.col("degree") / 10.0, F.lit(1.0)).alias("h"))


def _three(df: DataFrame) -> DataFrame:
    return df.select("id", *[r(F.col("h")[i]).alias(f"h{i}") for i in range(3)])


@query
def gcn_forward(spark, d):
    g = I.site(spark, d)
    return _three(passing.gcn(_h(g), features.normalised_adjacency(g, None), W2, np.array([0.01, 0.02, 0.03])))


@query
def sage_mean(spark, d):
    g = I.site(spark, d)
    return _three(passing.sage(_h(g), g.arcs(), np.vstack([W2, -W2]), np.zeros(3), "mean"))


@query
def gat_attention(spark, d):
    g = I.site(spark, d)
    return passing.attention(_h(g), g.arcs(), W2, TO, OF).select("a", "b", r("alpha").alias("alpha"))


@query
def recon_scores(spark, d):
    """Reconstruction error of each link between vectors that follow one another within a label."""
    e = I.table(spark, d, "embeddings").select(F.col("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    nxt = e.select("vec_id", F.expr("lead(vec_id) over (partition by label order by vec_id)").alias("to")).where("to is not null")
    got = passing.edge_errors(e.select(F.col("vec_id").alias("id"), "h"), nxt.select(F.col("vec_id").alias("src"), F.col("to").alias("dst")))
    return got.select("src", "dst", r("error").alias("error"))


@query
def recon_node_scores(spark, d):
    """Each vector's mean reconstruction error against all vectors, linked to the next of its label."""
    e = I.table(spark, d, "embeddings").select(F.col("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    nxt = e.select("vec_id", F.expr("lead(vec_id) over (partition by label order by vec_id)").alias("to")).where("to is not null")
    got = passing.node_errors(e.select(F.col("vec_id").alias("id"), "h"), nxt.select(F.col("vec_id").alias("src"), F.col("to").alias("dst")), 200)
    return got.select("id", r("score").alias("score"))


@query
def anomaly_report(spark, d):
    g = I.site(spark, d)
    return detect.Detector().fit(g).detect(g)["node_scores"]


@query
def structural_anomalies(spark, d):
    g = I.site(spark, d)
    got = detect.combine(detect.degree_scores(g.degree()), detect.structure_scores(g))
    return detect.above(got, 95.0).select("id", r("score").alias("score"), r("threshold").alias("threshold"))


@query
def high_centrality_graphs(spark, d):
    """The subgraphs of the ten highest nodes by each measure."""
    out = None
    for metric in ("betweenness", "closeness", "degree", "pagerank"):
        g = centrality.high_centrality_graph(I.site(spark, d), 10, metric)
        one = g.degree().select(F.lit(metric).alias("metric"), "id", F.col("degree").alias("degree_inside"))
        out = one if out is None else out.union(one)
    return out


@query
def attribute_equals(spark, d):
    """Subgraphs of nodes by type, and of those whose type is not known."""
    g = I.site(spark, d)
    g = Topology(g.nodes.withColumn("type", F.nullif("type", F.lit("router"))), g.edges.select("src", "dst"))
    parts = [g.by_attribute("type", t).degree().select(F.lit(t or "none").alias("type"), "id", "degree") for t in ("switch", "server", None, "absent")]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@query
def isolates_of_bulk_orders(spark, d):
    """Customers without a returned line of a large quantity."""
    o, l = I.table(spark, d, "orders"), I.table(spark, d, "lineitem").where("l_quantity >= 45 and l_returnflag = 'R'")
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    pairs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(key("c", "o_custkey").alias("src"), key("s", "l_suppkey").alias("dst")).distinct()
    return Topology(I.table(spark, d, "customer").select(key("c", "c_custkey").alias("id")), pairs).isolates()


@query
def impact_lists(spark, d):
    """Severely hit nodes and single points of failure of the whole report."""
    s = impact.report(I.site(spark, d), 5)["summary"]
    one = s.select(F.lit("severe").alias("list"), F.explode("critical_nodes").alias("id"))
    return one.union(s.select(F.lit("single"), F.explode("single_points_of_failure")))


@query
def sage_sum(spark, d):
    g = I.site(spark, d)
    return _three(passing.sage(_h(g), g.arcs(), np.vstack([W2, -W2]), np.zeros(3), "sum"))


@query
def sage_max(spark, d):
    g = I.site(spark, d)
    return _three(passing.sage(_h(g), g.arcs(), np.vstack([W2, -W2]), np.zeros(3), "max"))


@query
def gat_forward(spark, d):
    g = I.site(spark, d)
    return _three(passing.gat(_h(g), g.arcs(), W2, TO, OF))


# -- interfaces and predictions -----------------------------------------------------------------------------------


@query
def counter_deltas(spark, d):
    return interfaces.counter_deltas(I.polls(spark, d), ["device"], "month", ("in_bytes", "in_errors", "in_packets"))


def _states(spark, d) -> DataFrame:
    s = I.table(spark, d, "supplier")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("device"), F.lit("p0").alias("name"), F.lit("up").alias("admin_status"), F.when(F.col("s_acctbal") < 0, "down").otherwise("up").alias("oper_status"), F.lit(100).alias("speed_mbps"), (F.abs("s_acctbal") * 10000).alias("input_rate_bps"), (F.abs("s_acctbal") * 2000).alias("output_rate_bps"), F.col("s_nationkey").cast("bigint").alias("in_errors"), F.lit(1).cast("bigint").alias("out_errors"), (F.col("s_suppkey") * 100).alias("in_packets"), F.lit(50).cast("bigint").alias("out_packets"))


@query
def interface_annotate(spark, d):
    g = I.site(spark, d)
    e = g.edges.where("protocol = 'ospf'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst").alias("orig_src"), F.lit("p0").alias("local_port"), "speed_mbps")
    x = interfaces.annotate(Topology(g.nodes, e), _states(spark, d)).edges
    return x.select("src", "dst", "oper_status", "speed_mbps", r("utilization_in").alias("utilization_in"), r("error_rate", 8).alias("error_rate"))


@query
def utilization_error_rate(spark, d):
    x = interfaces.derived(_states(spark, d))
    return x.select("device", "is_up", r("utilization_in").alias("utilization_in"), r("utilization_out").alias("utilization_out"), r("error_rate", 8).alias("error_rate"))


@query
def device_summary(spark, d):
    return interfaces.device_summary(_states(spark, d))


@query
def metric_trend(spark, d):
    x = predict.trends(I.metrics(spark, d), ["user_id"], "util")
    return x.select("user_id", r("trend").alias("trend"), "n")


def _user_links(spark, d) -> DataFrame:
    m = I.metrics(spark, d)
    now = m.groupBy("user_id").agg(F.max_by("util", "seq").alias("utilization_in"), F.max_by("errors", "seq").alias("error_rate"))
    return now.select(F.lit("hub").alias("src"), F.col("user_id").cast("string").alias("dst"), "utilization_in", "error_rate", F.lit(100).alias("speed_mbps"))


def _trend(spark, d, value) -> DataFrame:
    return predict.trends(I.metrics(spark, d), ["user_id"], value).select(F.lit("hub").alias("src"), F.col("user_id").cast("string").alias("dst"), "trend")


@query
def link_risk(spark, d):
    x = predict.link_failures(_user_links(spark, d), _trend(spark, d, "errors"))
    return x.select("dst", r("risk").alias("risk"), r("probability").alias("probability"), "risk_level", r("hours").alias("hours"), F.size("factors").cast("bigint").alias("factors"))


@query
def node_overload(spark, d):
    x = predict.node_overloads(I.site(spark, d))
    return x.select("id", r("probability").alias("probability"), "risk_level")


@query
def capacity(spark, d):
    t = _trend(spark, d, "util")
    x = predict.capacity(_user_links(spark, d), t, t)
    return x.select("dst", r("probability").alias("probability"), "risk_level", r("hours", 4).alias("hours"))


@query
def sla_risk(spark, d):
    x = predict.sla_violations(I.site(spark, d))
    return x.select("src", "dst", r("probability").alias("probability"), "risk_level")


@query
def prediction_summary(spark, d):
    g = I.site(spark, d)
    return predict.summary(predict.link_failures(g.edges), predict.sla_violations(g))


@query
def observation_history(spark, d):
    h = predict.history(I.site(spark, d), 3, 5.0)
    return h.select("seq", "ts", "entity_type", "u", F.coalesce("v", F.lit("")).alias("v"), "metric", r("value").alias("value"))


@query
def prediction_lists(spark, d):
    """All four lists in their order of report, with places."""
    g = I.site(spark, d)
    t = g.edges.select("src", "dst", (F.col("utilization_in") / 50).alias("trend"))
    parts = {"link": predict.link_failures(g.edges), "node": predict.node_overloads(g).withColumnsRenamed({"id": "src"}).withColumn("dst", F.lit("")), "capacity": predict.capacity(g.edges.withColumn("utilization_in", F.col("utilization_in") + 40), t, t), "sla": predict.sla_violations(g)}
    out = None
    for kind, x in parts.items():
        one = x.select(F.lit(kind).alias("kind"), "src", "dst", r("probability").alias("probability"), "risk_level")
        out = one if out is None else out.union(one)
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("probability"), "src", "dst"))
    return out.withColumn("place", place)


@query
def prediction_summary_of_all(spark, d):
    g = I.site(spark, d)
    none = g.edges.select("src", "dst", F.lit(0.0).alias("trend"))
    return predict.summary(predict.link_failures(g.edges), predict.node_overloads(g), predict.capacity(g.edges, none, none), predict.sla_violations(g))


# -- time ---------------------------------------------------------------------------------------------------------


@query
def snapshot_diff(spark, d):
    seqs, _, edges = I.daily(spark, d)
    return temporal.changes(edges, ["src", "dst"], seqs, ["n"]).groupBy("seq", "kind").agg(F.count("*").alias("edges"))


def _deltas(spark, d) -> tuple:
    seqs, nodes, edges = I.daily(spark, d)
    return seqs, nodes, edges, temporal.magnitudes(seqs, temporal.changes(nodes, ["id"], seqs), temporal.changes(edges, ["src", "dst"], seqs))


@query
def change_magnitude(spark, d):
    return _deltas(spark, d)[3].select("seq", *[F.col(c).cast("bigint").alias(c) for c in ("nodes_added", "nodes_removed", "edges_added", "edges_removed", "magnitude")], "is_stable")


@query
def temporal_zscore(spark, d):
    x = temporal.z_scores(_deltas(spark, d)[3], "magnitude")
    return x.select("seq", r("window_mean").alias("window_mean"), r("window_std").alias("window_std"), r("z").alias("z"))


@query
def temporal_events(spark, d):
    return temporal.events(_deltas(spark, d)[3]).select("seq", "event")


@query
def evolution_stats(spark, d):
    seqs, nodes, edges, deltas = _deltas(spark, d)
    x = temporal.evolution(seqs, nodes, edges, deltas)
    return x.select(*[(r(c).alias(c) if c.startswith("mean") else F.col(c).cast("bigint").alias(c)) for c in x.columns])


@query
def adjacency_tensor(spark, d):
    _, nodes, edges = I.daily(spark, d)
    x = temporal.adjacency_cells(edges, nodes)
    return x.groupBy("t").agg(F.count("*").alias("cells"), F.sum(F.col("i").cast("bigint")).alias("sum_i"), F.sum(F.col("j").cast("bigint") * F.col("i")).alias("sum_ij"))


@query
def snapshot_window(spark, d):
    seqs, _, edges = I.daily(spark, d)
    return temporal.last(edges, 5, seqs).groupBy("seq").agg(F.count("*").alias("edges"))


@query
def snapshot_attributes(spark, d):
    """Changes of two attributes of links, one of which may be missing."""
    seqs, _, edges = I.daily(spark, d)
    edges = edges.withColumn("w", F.when(F.col("n") % 3 > 0, F.col("n") % 2))
    return temporal.changes(edges, ["src", "dst"], seqs, ["n", "w"]).groupBy("seq", "kind").agg(F.count("*").alias("edges"))


@query
def time_range(spark, d):
    e = I.table(spark, d, "events").select("event_type", F.unix_timestamp("ts").cast("double").alias("ts"))
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).head()
    third = (ends["hi"] - ends["lo"]) // 3
    return temporal.between(e, ends["lo"] + third, ends["lo"] + 2 * third).groupBy("event_type").agg(F.count("*").alias("events"))


# -- texts --------------------------------------------------------------------------------------------------------


@query
def parse_lldp(spark, d):
    return texts.lldp_neighbors(devices.lldp(spark, d)).select("local_device", "local_port", "remote_device", "remote_port", "remote_system_description", "remote_mgmt_address", F.array_join("remote_capabilities", ",").alias("capabilities"), "ttl", "edge_id")


@query
def parse_cdp(spark, d):
    return texts.cdp_neighbors(devices.cdp(spark, d)).select("local_device", "local_port", "remote_device", "remote_port", F.col("remote_system_description").alias("platform"), "remote_mgmt_address", F.array_join("remote_capabilities", ",").alias("capabilities"), "ttl", "protocol")


@query
def parse_snmp(spark, d):
    return texts.snmp_interfaces(devices.snmp(spark, d)).select("device", "if_index", "name", "description", "admin_status", "oper_status", "speed", "in_octets", "out_octets", r("utilization_fraction", 9).alias("utilization"))


@query
def parse_snmp_system(spark, d):
    return texts.snmp_device(devices.snmp(spark, d))


@query
def parse_snmp_neighbors(spark, d):
    return texts.snmp_neighbors(devices.snmp(spark, d)).select("device", "system_name", "port_id", "port_desc")


_ROUTE = ("source_router", "network", "protocol", "next_hop", "next_hop_interface", "metric", "admin_distance")


@query
def parse_ios_routes(spark, d):
    return texts.ios_routes(devices.ios(spark, d)).select(*_ROUTE)


@query
def parse_ios_routes_compat(spark, d):
    return texts.ios_routes(devices.ios(spark, d), compat=True).select(*_ROUTE)


@query
def parse_junos(spark, d):
    return texts.routes(devices.junos(spark, d), "junos").select(*_ROUTE[:-1])


@query
def parse_interfaces(spark, d):
    return texts.ios_interfaces(devices.interfaces(spark, d), ts=0.0).drop("ts", "collection_method")


@query
def protocol_summary(spark, d):
    return graphs.protocol_summary(texts.ios_routes(devices.ios(spark, d)))


@query
def parse_json_records(spark, d):
    n = texts.json_neighbors(devices.json_neighbors(spark, d)).select(F.lit("neighbor").alias("kind"), "local_device", F.col("local_port").alias("port"), F.col("remote_device").alias("name"), F.col("remote_port").alias("detail"), F.col("ttl").cast("bigint").alias("number"))
    x = texts.routes(devices.json_routes(spark, d), "json").select(F.lit("route").alias("kind"), "source_router", "next_hop", "network", "protocol", F.col("metric").cast("bigint") * 100 + F.col("admin_distance"))
    i = texts.json_interfaces(devices.json_interfaces(spark, d), ts=0.0).select(F.lit("interface").alias("kind"), "device", "name", "oper_status", F.col("speed_mbps").cast("string"), F.col("in_bytes") * 100 + F.col("in_errors"))
    return n.union(x).union(i)


@query
def routing_graph(spark, d):
    return graphs.from_routes(texts.ios_routes(devices.ios(spark, d))).edges.select("src", "dst", "prefix", "protocol", "metric", "interface")


@query
def routing_graph_nodes(spark, d):
    return graphs.from_routes(texts.routes(devices.ios(spark, d))).nodes.select("id", "type")


@query
def neighbor_graph(spark, d):
    """The graph of LLDP neighbours: the last record of a pair gives a link its ports."""
    return graphs.from_neighbors(texts.lldp_neighbors(devices.lldp(spark, d))).edges.select("src", "dst", "local_port", "remote_port", "protocol", "ttl")


@query
def neighbor_graph_nodes(spark, d):
    return graphs.from_neighbors(texts.lldp_neighbors(devices.lldp(spark, d))).degree()


@query
def snmp_graph(spark, d):
    return graphs.from_stars(texts.snmp_stars(devices.snmp(spark, d))).edges.select("src", "dst", "remote_port", "protocol")


@query
def snmp_graph_nodes(spark, d):
    # Written, as nodes are read from it twice.
    return graphs.from_stars(materialise(texts.snmp_stars(devices.snmp(spark, d)), "stars")).nodes.select("id", "type", F.coalesce("uptime", F.lit(-1)).alias("uptime"), F.coalesce(F.col("interface_count").cast("bigint"), F.lit(-1)).alias("interface_count"))


@query
def node_link_round_trip(spark, d):
    """Interchange JSON of a graph, written and read again."""
    text = json.dumps(exports.to_node_link(I.site(spark, d)))
    g = graphs.from_node_link(spark.createDataFrame([(text,)], "value string"))
    e = g.edges.join(g.nodes.select(F.col("id").alias("dst"), "type"), "dst")
    return e.select("src", "dst", "type", "protocol", "speed_mbps", r("utilization_in").alias("utilization_in"), r("error_rate").alias("error_rate"))


# -- exports ------------------------------------------------------------------------------------------------------


@query
def d3_nodes(spark, d):
    return exports.d3_nodes(I.site(spark, d)).select("id", F.col("index").cast("bigint").alias("index"), "type", "group")


@query
def d3_links(spark, d):
    return exports.d3_links(I.site(spark, d)).select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), "protocol", "speed_mbps")


@query
def d3_scores(spark, d):
    """Exports with scores of nodes and links."""
    g = I.site(spark, d)
    scores = detect.degree_scores(g.degree()).where("score > 0")
    n = exports.d3_nodes(g, scores).select(F.lit("node").alias("kind"), F.col("index").alias("place"), F.coalesce(r("anomaly_score"), F.lit(-1.0)).alias("score"))
    links = g.edges.where("protocol = 'bgp'").select("src", "dst", (F.col("utilization_in") / 100).alias("score"))
    e = exports.d3_links(g, links).select(F.lit("link"), F.col("source") * 1000000 + F.col("target"), F.coalesce(r("anomaly_score"), F.lit(-1.0)))
    return n.union(e)


@query
def mermaid_lines(spark, d):
    return exports.mermaid_lines(I.site(spark, d)).select("part", F.col("place").cast("bigint").alias("place"), "line")


@query
def device_group(spark, d):
    return I.site(spark, d).nodes.groupBy(C.device_group("type", "capabilities").alias("device_group")).agg(F.count("*").alias("devices"))


@query
def demo_topology(spark, d):
    return graphs.demo(spark).degree()
