"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import oracles, queries
from tests.conftest import SF

LIGHT = ["degree_outliers", "lww_merge", "graph_summary", "counter_deltas", "interface_annotate", "utilization_error_rate", "metric_trend", "link_risk", "capacity", "sla_risk", "snapshot_diff", "change_magnitude", "temporal_zscore", "temporal_events", "adjacency_tensor", "triangles_clustering", "redundant_paths", "betweenness", "normalized_adjacency", "node_features", "gcn_forward", "gat_attention", "recon_scores", "parse_lldp", "parse_cdp", "parse_snmp", "parse_ios_routes", "parse_junos", "parse_interfaces", "parse_json_records", "mermaid_lines", "d3_links", "parse_snmp_system", "parse_snmp_neighbors", "parse_ios_routes_compat", "routing_graph", "routing_graph_nodes", "neighbor_graph", "snmp_graph", "attribute_equals", "isolates_of_bulk_orders", "observation_history", "snapshot_attributes", "time_range", "d3_scores", "sage_max", "gat_forward", "recon_node_scores", "demo_topology"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(d):
    cols = sorted(d.columns)
    return d[cols].astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, duck, name):
    a, b = queries.FOUND[name](spark, SF).toPandas(), duck.sql(oracles.SQL[name]).df()
    assert norm(a).equals(norm(b))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "degree", "z", "score"]
