"""Global numbering and exact percentiles, and what uses them, against plain forms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.operators import interfaces, ranks, temporal, traversal


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), f"v{rng.randrange(9)}", i) for i in range(500)]
    got = ranks.numbered(spark.createDataFrame(rows, "a int, b string, c int"), ["a", "b", "c"], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(500)) and [tuple(r)[:3] for r in got] == sorted(rows)
    assert ranks.numbered(spark.createDataFrame([], "a int"), ["a"], "place").count() == 0


@pytest.mark.parametrize("few", [1, 5, 20_000])
def test_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.RandomState(few)
    for x in (rng.randn(400), np.r_[np.zeros(50), np.ones(50)], np.zeros(30), np.array([3.0]), np.round(rng.rand(200), 1)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        for share in (0.0, 0.5, 0.95, 1.0):
            assert ranks.percentile(df, "v", share) == pytest.approx(np.percentile(x, 100 * share))
    assert ranks.percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_second_paths_by_brute_force(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(22)]
    edges = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(26)} | {("hub", n) for n in nodes[:9]}
    g = Topology(spark.createDataFrame([(n,) for n in [*nodes, "hub"]], "id string"), spark.createDataFrame(sorted(edges), "src string, dst string"))
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in [*nodes, "hub"]}
    for r in traversal.redundant_edges(g).collect():
        u, v = r["src"], r["dst"]
        second = any(x != v and (v in near[x] or any(y not in (u, x) and v in near[y] for y in near[x])) for x in near[u])
        assert r["redundant"] == second, (u, v)


def test_closeness_in_batches(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(15), 2))) for _ in range(20)}
    g = Topology(spark.createDataFrame([(str(i),) for i in range(15)], "id string"), spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string"))
    whole = {r["id"]: r["closeness"] for r in traversal.closeness(g).collect()}
    assert {r["id"]: r["closeness"] for r in traversal.closeness(g, rows=60).collect()} == pytest.approx(whole) and len(whole) == 15


def test_changes_tell_nulls_apart(spark):
    rows = [(1, "a", None, 1), (2, "a", 5, 1), (3, "a", 5, None), (4, "a", 5, None)]
    got = temporal.changes(spark.createDataFrame(rows, "seq int, id string, x int, y int"), ["id"], None, ["x", "y"]).collect()
    assert sorted((r["seq"], r["kind"]) for r in got) == [(2, "modified"), (3, "modified")]


def test_annotate_takes_the_last_state(spark):
    cols = "device string, name string, admin_status string, oper_status string, speed_mbps int, input_rate_bps double, output_rate_bps double, in_errors long, out_errors long, in_packets long, out_packets long, ts double"
    states = [("a", "p", "up", s, 10, 0.0, 0.0, 0, 0, 1, 1, t) for t, s in ((2.0, "down"), (3.0, "up"), (1.0, "testing"))]
    edges = spark.createDataFrame([("a", "b", "a", "p")], "src string, dst string, orig_src string, local_port string")
    g = Topology(spark.createDataFrame([("a",), ("b",)], "id string"), edges)
    for order in itertools.permutations(states):
        assert interfaces.annotate(g, spark.createDataFrame(list(order), cols)).edges.head()["oper_status"] == "up"
    assert interfaces.annotate(g, spark.createDataFrame(states, cols), by_device=False).edges.select(F.col("oper_status")).head()[0] == "up"


def test_streams_of_scores_trends_and_errors(spark, tmp_path):
    from graphloom.streaming import state

    rows = [("k", float(i), float(i * i % 7)) for i in range(12)]
    spark.createDataFrame(rows, "key string, ts double, value double").write.parquet(str(tmp_path / "in"))

    def run(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    read = lambda: spark.readStream.schema("key string, ts double, value double").parquet(str(tmp_path / "in"))
    z = {r["ts"]: r["z"] for r in run(state.rolling_z(read(), "key", "ts", "value", 4), "z").collect()}
    t = {r["ts"]: r["trend"] for r in run(state.rolling_trend(read(), "key", "ts", "value", 5), "t").collect()}
    for i in range(12):
        w, x = [v for _, _, v in rows[max(0, i - 3) : i + 1]], [v for _, _, v in rows[max(0, i - 4) : i + 1]]
        assert z[float(i)] == pytest.approx((w[-1] - np.mean(w)) / np.std(w) if np.std(w) > 0 else 0.0)
        assert t[float(i)] == pytest.approx(np.polyfit(range(len(x)), x, 1)[0] if len(x) > 2 else 0.0)
    events = [(f"2024-01-01 0{h}:10:00", kind, 1.0) for h in range(5) for kind in (["error"] * h + ["view"])]
    spark.createDataFrame(events, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "ev"))
    e = run(state.windowed_errors(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))), "e", "complete")
    assert sorted((r["n"], r["errors"]) for r in e.collect()) == [(h + 1, h) for h in range(5)]


def test_cuts_of_large_components_equal_those_of_small_ones(spark, monkeypatch):
    """The joins that serve beyond LIMIT against the pass in one task, over random graphs side by side."""
    from graphloom.operators import cuts

    rng, edges = random.Random(9), set()
    for k, (n, m) in enumerate([(6, 6), (9, 9), (12, 16), (14, 14), (10, 25), (13, 13)]):
        names = [f"g{k}n{i:02}" for i in range(n)]
        for i in range(1, n):
            edges.add(tuple(sorted((names[i], names[rng.randrange(max(0, i - 3), i)]))))
        while sum(e[0].startswith(f"g{k}") for e in edges) < m:
            edges.add(tuple(sorted(rng.sample(names, 2))))
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    g = Topology(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(sorted(edges), "src string, dst string"))
    key = lambda df: sorted((r["kind"], r["id"], r["other"] or "", r["component"], r["size"], tuple(sorted(r["pieces"]))) for r in df.collect())
    small = key(cuts.cuts(g))
    monkeypatch.setattr(cuts, "LIMIT", 0)
    assert key(cuts.cuts(g)) == small and any(k == "bridge" for k, *_ in small) and any(len(p) > 2 for *_, p in small)


def test_components_of_small_graphs_equal_those_of_large_ones(spark):
    from graphloom.operators.components import connected_components

    rng = random.Random(12)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("é", "z"), ("x", "x"), (None, "y")]
    df = spark.createDataFrame(edges, "src string, dst string")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(connected_components(df, small=10**6)) == key(connected_components(df))
    assert connected_components(df.limit(0), small=10).count() == 0
    numbers = spark.createDataFrame([(5, 2), (2, 9), (7, 8)], "src long, dst long")
    assert key(connected_components(numbers, small=10)) == [(2, 2), (5, 2), (7, 7), (8, 7), (9, 2)]


def test_snapshots_of_a_stream_and_report_tables(spark, tmp_path):
    import json

    from graphloom import cli
    from graphloom.operators import features
    from graphloom.sinks import exports
    from graphloom.sources import graphs, texts
    from graphloom.streaming import state

    for k in range(3):
        spark.createDataFrame([(f"n{k}",), ("n",)], "id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.append_snapshots(stream, str(tmp_path / "snaps"), kept=2).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "snaps"))
    assert {r["seq"] for r in got.collect()} == {1, 2} and got.count() == 4
    g = graphs.demo(spark)
    exports.write_tables(str(tmp_path / "out"), cli.predict_tables(g))
    assert spark.read.json(str(tmp_path / "out" / "link_failures")).count() == 21
    assert json.loads(json.dumps(cli.predict_report(g)["summary"]))["total"] > 0
    x, a = features.matrices(g, ("degree", "is_router"))
    assert x.count() == 17 and abs(x.agg(F.avg("degree")).head()[0]) < 1e-9 and a.where("a = b").count() == 17
    (tmp_path / "sw-1.txt").write_text("Local Intf: e1\nSystem Name: b\n")
    assert texts.lldp_neighbors(texts.read_texts(spark, str(tmp_path / "sw-1.txt"))).head()["local_device"] == "sw-1"
