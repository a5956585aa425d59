"""Parsers, exports, service and streams."""

import json

import pytest

from graphloom.functions import columns as C
from graphloom.operators import interfaces
from graphloom.service import Service
from graphloom.sinks import exports
from graphloom.sources import graphs, texts
from tests import samples


def text(spark, name):
    return texts.from_literal(spark, "core-1", samples.TEXTS[name])


def test_lldp(spark):
    got = {r["remote_device"]: r for r in texts.lldp_neighbors(text(spark, "lldp")).collect()}
    assert got["hall-7.example.net"]["remote_port"] == "et-5" and got["desk-31"]["remote_capabilities"] == ["Telephone"] and got["desk-31"]["remote_port"] == "lan"
    assert got["hall-7.example.net"]["remote_system_description"] == "hall switch"
    assert texts.lldp_neighbors(text(spark, "lldp"), compat=True).head()["remote_port"] == "xe-0/2"
    assert graphs.from_neighbors(texts.lldp_neighbors(text(spark, "lldp"))).nodes.count() == 3


def test_edge_id_from_either_end(spark):
    a = spark.range(1).select(C.edge_id(*[texts.F.lit(x) for x in ("a", "1", "b", "2")]).alias("x"), C.edge_id(*[texts.F.lit(x) for x in ("b", "2", "a", "1")]).alias("y")).head()
    assert a["x"] == a["y"] and len(a["x"]) == 16


def test_routes(spark):
    got = {r["network"]: r["protocol"] for r in texts.ios_routes(text(spark, "ios")).collect()}
    assert got == {"10.61.0.0/18": "ospf-external-type2", "10.62.1.0/26": "ospf-inter-area", "10.63.0.0/30": "static"}
    old = {r["network"]: r["protocol"] for r in texts.ios_routes(text(spark, "ios"), compat=True).collect()}
    assert "10.61.0.0/18" not in old and old["10.62.0.0/20"] == "" and old["10.62.1.0/26"] == "O IA"
    with pytest.raises(ValueError):
        texts.routes(text(spark, "ios"), "other")


def test_stars_are_what_three_parsers_give(spark):
    """One pass gives the graph of devices, interfaces and neighbours; a device without lines stays, later lines win."""
    more = '\n'.join(['.1.3.6.1.2.1.1.5.0 = STRING: "one"', "1.3.6.1.2.1.1.5.0 = two", "1.3.6.1.2.1.2.2.1.2.1 = a", "1.3.6.1.2.1.31.1.1.1.1.1 = b", "1.3.6.1.2.1.2.2.1.2.2 = c", "1.3.6.1.2.1.2.2.1.5.3 = 9", "1.0.8802.1.1.2.1.4.1.1.9.0.1.1 = x", "1.0.8802.1.1.2.1.4.1.1.9.0.1.1 = y", "1.0.8802.1.1.2.1.4.1.1.9.0.2.1 = y", "1.0.8802.1.1.2.1.4.1.1.7.0.2.1 = p9", "1.0.8802.1.1.2.1.4.1.1.7.0.3.1 = p3", "1.3.6.1.2.1.1.3.0 = INTEGER: 7", "no line of 1.3.6.1.2.1.1.3.0"])
    t = text(spark, "snmp").select("device", "value").union(spark.createDataFrame([("m", more), ("bare", ""), ("none", None)], "device string, value string"))
    want = graphs.from_snmp(texts.snmp_device(t), texts.snmp_interfaces(t), texts.snmp_neighbors(t))
    stars = texts.snmp_stars(t)
    got = graphs.from_stars(stars)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got.nodes.select(*want.nodes.columns)) == rows(want.nodes) and rows(got.edges.select(*want.edges.columns)) == rows(want.edges)
    assert stars._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_neighbor_graph_reads_records_once(spark):
    t = text(spark, "lldp")
    g = graphs.from_neighbors(texts.lldp_neighbors(t))
    plain = type(g)(g.nodes, g.edges)
    assert sorted(g.degree().collect()) == sorted(plain.degree().collect())
    assert g.degree()._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_snmp(spark):
    t = text(spark, "snmp")
    assert texts.snmp_device(t).head()["hostname"] == "mast-2.example"
    g = graphs.from_snmp(texts.snmp_device(t), texts.snmp_interfaces(t), texts.snmp_neighbors(t))
    assert (g.nodes.count(), g.edges.count()) == (2, 1)


def test_interfaces_and_deltas(spark):
    s = interfaces.derived(texts.ios_interfaces(text(spark, "interfaces"), ts=1.0)).orderBy("name").collect()
    assert [r["is_up"] for r in s] == [True, False] and s[0]["error_rate"] == pytest.approx(6 / 4000)
    polls = spark.createDataFrame([("d", "e", 0.0, 100, 5, 0, 0), ("d", "e", 300.0, 1100, 0, 2, 0)], "device string, name string, ts double, in_bytes long, out_bytes long, in_errors long, out_errors long")
    d = interfaces.counter_deltas(polls, ["device", "name"], "ts").head()
    assert (d["in_bytes_delta"], d["out_bytes_delta"], d["in_errors_delta"]) == (1000, 0, 2)


def test_exports_round_trip(spark):
    g = graphs.demo(spark)
    again = graphs.from_node_link(spark.createDataFrame([(json.dumps(exports.to_node_link(g)),)], "value string"))
    assert (again.nodes.count(), again.edges.count()) == (17, 21)
    assert len(exports.to_d3(g)["links"]) == 21
    m = exports.to_mermaid(g, title="t").splitlines()
    assert m[3] == "graph TB" and "    wan_1{wan-1}" in m
    assert len(exports.to_dashboard(g)["dashboard"]["panels"]) == 8
    assert "</script" in exports.to_html(g)


def test_mermaid_names(spark):
    r = spark.createDataFrame([("10.0.0.1",), ("a-b c:d/e",)], "s string").select(C.mermaid_safe("s").alias("x")).collect()
    assert [x["x"] for x in r] == ["n10_0_0_1", "a_b_c_d_e"]
    C.register(spark)
    assert spark.sql("select mermaid_safe('1-a') x, risk_level(0.6) y, grade(0.85) z").head().asDict() == {"x": "n1_a", "y": "high", "z": "B"}


def test_service(spark):
    s = Service()
    assert s.get("/api/v1/health")[1]["graph_loaded"] is False and s.get("/api/v1/topology")[0] == 404
    s.set_graph(graphs.demo(spark))
    assert len(s.get("/api/v1/topology/nodes")[1]) == 17 and s.get("/api/v1/topology/node/none")[0] == 404
    assert s.get("/api/v1/topology/node/fw-1")[1]["neighbors"] == ["core-1"]
    assert s.post("/api/v1/impact/blast", {})[0] == 400 and s.post("/api/v1/impact/whatif", {})[0] == 400


def test_stream_of_counters(spark, tmp_path):
    from graphloom.streaming import state

    schema = "device string, name string, ts double, in_bytes bigint, out_bytes bigint, in_errors bigint, out_errors bigint"
    spark.createDataFrame([("d", "e", 0.0, 10, 0, 0, 0), ("d", "e", 1.0, 15, 0, 0, 0), ("d", "e", 2.0, 3, 0, 1, 0)], schema).write.parquet(str(tmp_path / "in"))
    stream = state.counter_deltas(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r["ts"], r["in_bytes_delta"], r["in_errors_delta"]) for r in spark.table("deltas").orderBy("ts").collect()] == [(1.0, 5, 0), (2.0, 0, 1)]


def test_columns_of_blocks_are_computed_once(spark):
    """Each block is cut into fields once: the plan has one split of lines, however many fields are read from it."""
    from graphloom.sources import texts

    df = texts.cdp_neighbors(spark.createDataFrame([("d", "x")], "device string, value string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(block") == 1 and "Generate explode(array" in plan


def test_words_beside_marks(spark):
    """The first word beside marks: none before the first word, and the next place if there is none."""
    from graphloom.sources import texts

    df = spark.createDataFrame([("CRC x BW BW 7 CRC, BW",), ("CRC",), ("5 CRC MTU",)], "joined string")
    got = [tuple(r) for r in df.select(texts._near(True, "CRC"), texts._near(False, "BW"), texts._near(False, "MTU")).collect()]
    assert got == [(None, "BW", None), (None, None, None), ("5", None, None)]
