"""Graphs from records, from node-link JSON, and a demonstration topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frame import Topology


def from_neighbors(neighbors: DataFrame) -> Topology:
    """Both ends of every neighbour record are devices; the last record of a pair wins."""
    local = neighbors.select(F.col("local_device").alias("id"), F.lit("network_device").alias("type"), *[F.lit(None).cast(t).alias(c) for c, t in (("description", "string"), ("mgmt_address", "string"), ("capabilities", "array<string>"))], (F.col("ordinal") * 2).alias("ordinal"))
    remote = neighbors.select(F.col("remote_device").alias("id"), F.lit("network_device").alias("type"), F.col("remote_system_description").alias("description"), F.col("remote_mgmt_address").alias("mgmt_address"), F.col("remote_capabilities").alias("capabilities"), (F.col("ordinal") * 2 + 1).alias("ordinal"))
    edges = neighbors.select(F.col("local_device").alias("src"), F.col("remote_device").alias("dst"), "local_port", "remote_port", "protocol", "edge_id", "ttl", "ordinal")
    return Topology.build(local.union(remote), edges, ordinal="ordinal", linked=True)


def from_snmp(device: DataFrame, interfaces: DataFrame, neighbors: DataFrame) -> Topology:
    """A star of each walked device and the neighbours it reports."""
    count = interfaces.groupBy("device").agg(F.count("*").cast("int").alias("interface_count"))
    d = device.join(count, "device", "left")
    here = d.select(F.col("hostname").alias("id"), F.lit("network_device").alias("type"), "sys_descr", "sys_location", F.col("sys_uptime").alias("uptime"), F.coalesce("interface_count", F.lit(0)).alias("interface_count"), F.lit(1).alias("ordinal"))
    n = neighbors.join(device.select("device", "hostname"), "device")
    there = n.select(F.col("system_name").alias("id"), F.lit("network_device").alias("type"), *[F.lit(None).cast(t).alias(c) for c, t in (("sys_descr", "string"), ("sys_location", "string"), ("uptime", "bigint"), ("interface_count", "int"))], F.lit(0).alias("ordinal"))
    edges = n.select(F.col("hostname").alias("src"), F.col("system_name").alias("dst"), F.col("port_id").alias("remote_port"), F.lit("lldp-mib").alias("protocol"), F.col("key").alias("ordinal"))
    return Topology.build(here.union(there), edges, ordinal="ordinal")


def from_stars(stars: DataFrame) -> Topology:
    """from_snmp() of texts.snmp_stars(): a device's interfaces and neighbours come in its row, without joins."""
    here = stars.select(F.col("hostname").alias("id"), F.lit("network_device").alias("type"), "sys_descr", "sys_location", F.col("sys_uptime").alias("uptime"), "interface_count", F.lit(1).alias("ordinal"))
    ids = stars.select(F.explode("neighbors.system_name").alias("id")).distinct()
    there = ids.select("id", F.lit("network_device").alias("type"), *[F.lit(None).cast(t).alias(c) for c, t in (("sys_descr", "string"), ("sys_location", "string"), ("uptime", "bigint"), ("interface_count", "int"))], F.lit(0).alias("ordinal"))
    n = stars.select("hostname", F.inline("neighbors"))
    edges = n.select(F.col("hostname").alias("src"), F.col("system_name").alias("dst"), F.col("port_id").alias("remote_port"), F.lit("lldp-mib").alias("protocol"), F.col("key").alias("ordinal"))
    return Topology.build(here.union(there), edges, ordinal="ordinal", whole=True)


def from_routes(routes: DataFrame) -> Topology:
    """A directed star of each router and its next hops; connected routes give none, the last route to a hop wins."""
    r = routes.where("next_hop <> '' and protocol <> 'connected'")
    here = routes.select(F.col("source_router").alias("id"), F.lit("router").alias("type"), F.lit(1).alias("ordinal"))
    there = r.select(F.col("next_hop").alias("id"), F.lit("next_hop").alias("type"), F.lit(0).alias("ordinal"))
    edges = r.select(F.col("source_router").alias("src"), F.col("next_hop").alias("dst"), F.col("network").alias("prefix"), "protocol", "metric", "admin_distance", F.col("next_hop_interface").alias("interface"), "ordinal")
    return Topology.build(here.union(there), edges, directed=True, ordinal="ordinal")


def protocol_summary(routes: DataFrame) -> DataFrame:
    return routes.groupBy("protocol").agg(F.count("*").alias("routes"))


_NODE = {"type": "string", "description": "string", "mgmt_address": "string", "capabilities": "array<string>", "sys_descr": "string", "sys_location": "string", "uptime": "bigint", "interface_count": "int", "utilization": "double", "error_rate": "double"}
_EDGE = {"local_port": "string", "remote_port": "string", "protocol": "string", "edge_id": "string", "ttl": "int", "prefix": "string", "metric": "int", "admin_distance": "int", "interface": "string", "oper_status": "string", "speed_mbps": "int", "utilization_in": "double", "utilization_out": "double", "error_rate": "double", "input_rate_bps": "double", "output_rate_bps": "double", "weight": "double"}


def _fields(kinds: dict[str, str]) -> list:
    out = []
    for name, kind in kinds.items():
        raw = F.get_json_object("item", f"$.{name}")
        out.append((F.from_json(raw, kind) if kind.startswith("array") else raw.try_cast(kind)).alias(name))
    return out


def from_node_link(texts: DataFrame) -> Topology:
    """Node-link JSON in column value: nodes with an id; links, or edges, with source and target."""
    nodes = texts.select(F.posexplode(F.from_json(F.get_json_object("value", "$.nodes"), "array<string>")).alias("ordinal", "item"))
    links = texts.select(F.posexplode(F.from_json(F.coalesce(F.get_json_object("value", "$.links"), F.get_json_object("value", "$.edges")), "array<string>")).alias("ordinal", "item"))
    n = nodes.select(F.get_json_object("item", "$.id").alias("id"), *_fields(_NODE), "ordinal")
    e = links.select(F.get_json_object("item", "$.source").alias("src"), F.get_json_object("item", "$.target").alias("dst"), *_fields(_EDGE), "ordinal")
    return Topology.build(n, e, ordinal="ordinal")


def read_node_link(spark: SparkSession, path: str) -> Topology:
    return from_node_link(spark.read.text(path, wholetext=True).select("value"))


def demo(spark: SparkSession) -> Topology:
    """A campus of 17 devices and 21 links: two cores, four distribution and eight access switches, two WAN routers, a firewall."""
    roles = {"core": 2, "dist": 4, "access": 8, "wan": 2, "fw": 1}
    names = {r: [f"{r}-{i + 1}" for i in range(n)] for r, n in roles.items()}
    kind = {"core": ("switch", ["Bridge", "Router"]), "dist": ("switch", ["Bridge", "Router"]), "access": ("switch", ["Bridge"]), "wan": ("router", ["Router"]), "fw": ("firewall", ["Router"])}
    nodes = [(n, kind[r][0], kind[r][1], 20.0 + 7.0 * i, 4 * (i + 1)) for r in roles for i, n in enumerate(names[r])]
    pairs = [("core-1", "core-2", 40000)]
    pairs += [(c, d, 10000) for c in names["core"] for d in names["dist"]]
    pairs += [(names["dist"][i // 2], a, 1000) for i, a in enumerate(names["access"])]
    pairs += [("core-1", "wan-1", 1000), ("core-2", "wan-2", 1000), ("wan-1", "wan-2", 1000), ("core-1", "fw-1", 10000)]
    edges = [(u, v, "ospf" if s >= 10000 else "lldp", s, 10.0 + (37 * i) % 80, 0.001 * (i % 4)) for i, (u, v, s) in enumerate(pairs)]
    return Topology.build(
        spark.createDataFrame(nodes, "id string, type string, capabilities array<string>, utilization double, interface_count int"),
        spark.createDataFrame(edges, "src string, dst string, protocol string, speed_mbps int, utilization_in double, error_rate double"),
    )
