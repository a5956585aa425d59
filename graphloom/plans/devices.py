"""Device outputs rendered from order lines: one text for each order, a block or line for each of its lines.

An order is a device, a line one of its ports; parts, suppliers, quantities and flags fill in the rest. So the parsers
run over all rows of a table, and what they must find follows from the table (LINES and the queries' SQL).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.inputs import table

KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_tax")

#: The same lines in SQL.
LINES = f"""
l AS (SELECT 'o' || l_orderkey AS device, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS INTEGER) AS qty, l_returnflag AS ret, l_linestatus AS st,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(KEYS)}) AS INTEGER) AS k FROM lineitem),
x AS (SELECT *, '10.' || (part // 200 % 200) || '.' || (part % 200) AS net, ret = 'R' AS r, ret = 'A' AS a, st = 'F' AS f FROM l)"""

CODES = ("C", "S*", "O", "O IA", "O E2", "B", "D EX", "i L1")


def _fill(template: str, *args) -> Column:
    """What format_string gives for a template of %d and %s, without a formatter run by row."""
    parts, names = re.split("%[ds]", template), [F.col(a) if isinstance(a, str) else a for a in args]
    if len(parts) != len(names) + 1:
        raise ValueError("as many columns as places")
    out = [F.lit(parts[0])]
    for a, x in zip(names, parts[1:]):
        out += [F.coalesce(a.cast("string"), F.lit("null")), F.lit(x)]
    return F.concat(*out)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(device, k, part, supp, qty, net, r, a, f) of every order line; k counts the lines of an order.

    Rows are dealt by device, so that no later step by device moves the texts, and into all partitions: they are short,
    but what is rendered from them is long.
    """
    w = W.partitionBy("device").orderBy(*KEYS)
    part = F.col("l_partkey")
    net = _fill("10.%d.%d", F.floor(part / 200) % 200, part % 200)
    named = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("device"), *KEYS)
    named = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "device")
    return named.select("device", F.row_number().over(w).alias("k"), part.alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("qty"), net.alias("net"), (F.col("l_returnflag") == "R").alias("r"), (F.col("l_returnflag") == "A").alias("a"), (F.col("l_linestatus") == "F").alias("f"))


def _texts(rows: DataFrame, block: Column, between: str = "", head: Column | str = "") -> DataFrame:
    """(device, value): the blocks of each device in order."""
    got = rows.select("device", F.struct("k", block.alias("block")).alias("b")).groupBy("device").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    start = F.lit(head) if isinstance(head, str) else head
    return got.select("device", F.concat(start, F.array_join(F.transform("blocks", lambda b: b["block"]), between)).alias("value"))


def lldp(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in LLDP form. Those of quantity 50 have no system name; the description is on a line of its own."""
    able = F.when(F.col("r"), "System Capabilities: router, BRIDGE\n").when(F.col("a"), "System Capabilities: telephone\n").otherwise("")
    name = F.when(F.col("qty") == 50, "").otherwise(_fill("System Name: s%d.example.org\n", "supp"))
    reach = F.when(F.col("f"), _fill("Management Address: %s.%d\n", "net", "k")).otherwise("")
    body = _fill("Local Intf: xe-%d\nPort id: p%d\n%sSystem Description:\n  rack %d\nTime To Live: %d\n%s%s", "k", "part", name, "qty", F.col("qty") + 60, able, reach)
    return _texts(lines(spark, d), body, "-" * 24 + "\n")


def cdp(spark: SparkSession, d: str) -> DataFrame:
    body = _fill("Device ID: s%d.example.org\nEntry address(es):\n  IP address: %s.%d\nPlatform: box %d, Capabilities: Router Switch\nInterface: Te1/%d,  Port ID (outgoing port): Te2/%d\n", "supp", "net", "k", "part", "k", "qty")
    return _texts(lines(spark, d), body, "-" * 30 + "\n")


def ios(spark: SparkSession, d: str) -> DataFrame:
    """A routing table with a summary header; returned lines have no mask of their own."""
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("part") % len(CODES) + 1).cast("int"))
    mask = F.when(F.col("r"), "").otherwise(_fill("/%d", F.col("supp") % 8 + 17))
    way = F.when(code == "C", _fill(" is directly connected, Gi0/%d", "k")).otherwise(_fill(" [%d/%d] via 10.0.%d.1, 00:%d:00, Te1/%d", F.col("qty") + 10, "part", F.col("supp") % 250, "k", "k"))
    return _texts(lines(spark, d), F.concat(F.rpad(code, 6, " "), "net", F.lit(".0"), mask, way), "\n", "Codes: C - connected\nGateway of last resort is not set\n\n      10.0.0.0/8 is variably subnetted, 9 subnets\n")


def junos(spark: SparkSession, d: str) -> DataFrame:
    proto = F.element_at(F.array(F.lit("OSPF"), F.lit("BGP"), F.lit("Static")), (F.col("part") % 3 + 1).cast("int"))
    age = F.when(F.col("a"), "2w ago ").otherwise("")
    hop = F.when(F.col("f"), "").otherwise(_fill("to 10.1.%d.1 ", F.col("supp") % 250))
    return _texts(lines(spark, d), _fill("%s.0/%d *[%s/%d] %s> %svia ge-0/0/%d.0", "net", F.col("supp") % 8 + 17, proto, "qty", age, hop, "k"), "\n", "inet.0: some destinations\n")


def interfaces(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("r"), "administratively down").otherwise("up")
    link = F.when(F.col("f"), "up").otherwise("down")
    body = F.format_string(
        "Ethernet1/%d is %s, line protocol is %s\n  Hardware is 10G, address is 00a0.%04x.%04x (bia 00a0.%04x.%04x)\n  Description: rack of s%d, row %d\n  Internet address is %s.%d/24\n"
        "  MTU %d bytes, BW %d Kbit/sec, DLY 10 usec\n  5 minute input rate %d bits/sec, 3 packets/sec\n  5 minute output rate %d bits/sec, 4 packets/sec\n"
        "     %d packets input, 64 bytes\n     %d input errors, %d CRC, 0 frame\n     %d packets output, 64 bytes\n     %d output errors, %d collisions\n",
        "k", state, link, F.col("part") % 65536, F.col("supp") % 65536, F.col("part") % 65536, F.col("supp") % 65536, "supp", "k", "net", "k", F.col("qty") + 1400, F.col("supp") * 1700, F.col("part") * 1000, F.col("part") * 300, F.col("part") * 7, "qty", "k", F.col("part") * 5, "supp", F.col("qty") % 3,
    )
    return _texts(lines(spark, d), body)


def snmp(spark: SparkSession, d: str) -> DataFrame:
    """A walk: the system group, then the tables of interfaces and neighbours. A counter occurs twice: the later one counts."""
    names = F.when(F.col("f"), _fill('.1.3.6.1.2.1.31.1.1.1.1.%d = STRING: "xe-%d"\n', "k", "k")).otherwise("")
    fast = F.when(F.col("r"), _fill("1.3.6.1.2.1.31.1.1.1.15.%d = Gauge32: %d\n", "k", "supp")).otherwise("")
    base, far = "1.3.6.1.2.1.2.2.1", "1.0.8802.1.1.2.1.4.1.1"
    body = _fill(
        f"{base}.10.%d = Counter32: 1\n{base}.2.%d = STRING: \"port %d\"\n{base}.5.%d = Gauge32: %d\n{base}.7.%d = INTEGER: %d\n{base}.8.%d = INTEGER: %d\n{base}.10.%d = Counter32: %d\n{base}.16.%d = %d\n%s%s{far}.9.0.%d.1 = STRING: \"s%d\"\n{far}.7.0.%d.1 = STRING: \"p%d\"\n# next\n",
        "k", "k", "k", "k", F.col("qty") * 1000000, "k", F.when(F.col("a"), 2).otherwise(1), "k", F.when(F.col("f"), 1).otherwise(3), "k", F.col("part") * 100, "k", F.col("part") * 50, names, fast, "k", "supp", "k", "part",
    )
    group = "1.3.6.1.2.1.1"
    head = F.concat(_fill(f".{group}.1.0 = STRING: \"software of %s\"\n{group}.3.0 = %d\n{group}.5.0 = STRING: \"%s.example\"\n", "device", F.size("blocks") * 100, "device"))
    return _texts(lines(spark, d), body, "", head)


def json_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """An object of neighbours; returned lines use the other names of the keys, and have no more than a name and ports."""
    one = F.struct(F.concat(F.lit("e"), "k").alias("local_port"), F.concat(F.lit("s"), "supp").alias("remote_device"), F.concat(F.lit("p"), "part").alias("remote_port"), (F.col("qty") + 60).alias("ttl"), F.array(F.lit("Router")).alias("capabilities"))
    two = F.struct(F.concat(F.lit("e"), "k").alias("local_interface"), F.concat(F.lit("s"), "supp").alias("neighbor"), F.concat(F.lit("p"), "part").alias("neighbor_interface"))
    got = _texts(lines(spark, d), F.when(F.col("r"), F.to_json(two)).otherwise(F.to_json(one)), ",")
    return got.select("device", F.concat(F.lit('{"neighbors": ['), "value", F.lit("]}")).alias("value"))


def json_routes(spark: SparkSession, d: str) -> DataFrame:
    """A list of routes; those of returned lines have the length of their prefix apart."""
    prefix = F.concat("net", F.lit(".0"))
    one = F.struct(F.concat(prefix, F.lit("/20")).alias("prefix"), F.lit("ospf").alias("protocol"), F.concat(F.lit("10.1.1."), "k").alias("next_hop"), F.col("qty").alias("metric"))
    two = F.struct(prefix.alias("prefix"), F.lit(21).alias("mask_len"), F.lit("static").alias("protocol"), F.concat(F.lit("10.1.1."), "k").alias("nexthop"), F.col("qty").alias("preference"))
    got = _texts(lines(spark, d), F.when(F.col("r"), F.to_json(two)).otherwise(F.to_json(one)), ", ")
    return got.select("device", F.concat(F.lit("["), "value", F.lit("]")).alias("value"))


def json_interfaces(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.concat(F.lit("e"), "k").alias("name"), F.col("supp").alias("speed_mbps"), F.col("part").alias("in_bytes"), F.lit("down").alias("oper_status"))
    two = F.struct(F.concat(F.lit("e"), "k").alias("interface"), F.col("supp").alias("speed"), F.col("qty").alias("in_errors"))
    got = _texts(lines(spark, d), F.when(F.col("r"), F.to_json(two)).otherwise(F.to_json(one)), ",")
    return got.select("device", F.concat(F.lit('{"interfaces": ['), "value", F.lit("]}")).alias("value"))
