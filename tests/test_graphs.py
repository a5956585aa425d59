"""Graph operators against hand-derived values and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.operators import centrality, cuts, impact, predict, temporal, traversal
from graphloom.operators.components import connected_components
from graphloom.sources import graphs


def build(spark, pairs, nodes=()):
    ids = sorted({x for p in pairs for x in p} | set(nodes))
    return Topology.build(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string"))


@pytest.fixture(scope="module")
def hierarchy(spark):
    return build(spark, [("core1", "core2"), ("core1", "dist1"), ("core1", "dist2"), ("core2", "dist1"), ("core2", "dist2"), ("dist1", "acc1"), ("dist1", "acc2"), ("dist2", "acc3")])


def rows(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_blast_radius(spark, hierarchy):
    got = rows(impact.blast_radius(hierarchy))
    assert (got["dist1"]["direct"], got["dist1"]["indirect"], got["dist1"]["severity"]) == (4, 2, "critical")
    assert got["dist1"]["connectivity_loss"] == pytest.approx(71.428571, abs=1e-4)
    assert got["dist2"]["connectivity_loss"] == pytest.approx(52.380952, abs=1e-4)
    assert (got["core1"]["indirect"], got["core1"]["severity"]) == (0, "high")
    assert impact.blast_radius_node(hierarchy, "dist1")["indirect"] == ["acc1", "acc2"]
    assert impact.blast_radius_node(hierarchy, "none")["direct"] == []


def test_redundancy_and_cuts(spark, hierarchy):
    found = cuts.cuts(hierarchy)
    assert sorted(r["id"] for r in cuts.articulation_points(found).collect()) == ["dist1", "dist2"]
    assert cuts.bridges(found).count() == 3
    got = rows(impact.redundancy(hierarchy, found))
    assert got["dist1"]["score"] == pytest.approx(1 / 6) and got["dist1"]["min_path_length"] == 1
    assert got["dist2"]["score"] == pytest.approx(1 / 3) and got["acc1"]["score"] == 0


def test_what_if_accumulates(spark, hierarchy):
    steps = impact.what_if(hierarchy, [{"type": "node", "target": "dist1"}, {"type": "edge", "target": ("dist2", "acc3")}])
    assert [s["components"] for s in steps] == [3, 4] and steps[1]["isolated_nodes"] == ["acc1", "acc2", "acc3"]
    with pytest.raises(ValueError):
        impact.what_if(hierarchy, [{"type": "fire", "target": "x"}])


def test_low_links_match_removal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 9)
        pairs = [(i, rng.randrange(i)) for i in range(1, n)] + [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.15]
        pairs = sorted({tuple(sorted(p)) for p in pairs})
        pieces, bridges = cuts.low_links(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), n)

        def parts(keep, edges):
            left, out = set(keep), []
            while left:
                todo, seen = [left.pop()], 1
                while todo:
                    v = todo.pop()
                    for a, b in edges:
                        for x, y in ((a, b), (b, a)):
                            if x == v and y in left:
                                left.discard(y)
                                todo.append(y)
                                seen += 1
                out.append(seen)
            return sorted(out)

        for v in range(n):
            assert sorted(pieces[v]) == parts([x for x in range(n) if x != v], [p for p in pairs if v not in p])
        want = {p for p in pairs if len(parts(range(n), [q for q in pairs if q != p])) > 1}
        assert {tuple(sorted(b[:2])) for b in bridges} == want


def test_components_and_empty(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("x", "x"), ("x", "y"), (None, "q")], "src string, dst string")
    assert {r["id"]: r["component"] for r in connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(e.limit(0)).count() == 0


def test_betweenness_kernel_and_joins_agree(spark, hierarchy, monkeypatch):
    want = rows(centrality.betweenness(hierarchy))
    edges = {(r["src"], r["dst"]): r["betweenness"] for r in centrality.edge_betweenness(hierarchy).collect()}
    monkeypatch.setattr(centrality, "LIMIT", 0)
    for k, v in rows(centrality.betweenness(hierarchy)).items():
        assert v["betweenness"] == pytest.approx(want[k]["betweenness"])
    for r in centrality.edge_betweenness(hierarchy).collect():
        assert r["betweenness"] == pytest.approx(edges[r["src"], r["dst"]])
    assert want["dist1"]["betweenness"] == max(v["betweenness"] for v in want.values())


@pytest.mark.parametrize("many", [0, 10**9])
def test_pagerank_reads_edges_once(spark, monkeypatch, many):
    monkeypatch.setattr(centrality, "MANY", many)
    links = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", None), ("c", "d", 3.0), ("d", "d", 1.0)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    e = spark.createDataFrame(links, "src string, dst string, weight double").mapInArrow(count, "src string, dst string, weight double")
    got = {r["id"]: r["pagerank"] for r in centrality.pagerank(Topology(spark.createDataFrame([(c,) for c in "abcde"], "id string"), e), rounds=4).collect()}
    assert read.value == len(links)
    w = np.zeros((5, 5))
    for x, y, v in links:
        i, j = "abcde".index(x), "abcde".index(y)
        w[i, j] = w[j, i] = 1.0 if v is None else v
    rank, out = np.full(5, 0.2), w.sum(1)
    for _ in range(4):
        rank = 0.85 * ((rank[:4] / out[:4]) @ w[:4] + rank[4] / 5) + 0.03
    assert [got[c] for c in "abcde"] == pytest.approx(rank.tolist())


def test_pagerank_sums_to_one(spark, hierarchy):
    assert centrality.pagerank(hierarchy, rounds=8).agg(F.sum("pagerank")).head()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        centrality.high_centrality(hierarchy, 3, "nothing")


def test_fiedler_of_a_path(spark):
    g = build(spark, [("a", "b"), ("b", "c")])
    assert centrality.algebraic_connectivity(g) == pytest.approx(1.0)
    assert centrality.algebraic_connectivity(g, limit=1, rounds=60) == pytest.approx(1.0, abs=1e-4)


def test_fiedler_of_hubs(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(f"h{i}", f"h{i + 1}") for i in range(4)] + [(f"h{h}", f"l{i}") for i in range(90) for h in sorted({rng.randrange(5), rng.randrange(5)})]
    g = build(spark, pairs)
    want = centrality.algebraic_connectivity(g)
    assert centrality.algebraic_connectivity(g, limit=1, rounds=60) == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(centrality, "VECTORS", 12)
    monkeypatch.setattr(centrality, "KEPT", 4)
    assert centrality.algebraic_connectivity(g, limit=1, rounds=60) == pytest.approx(want, rel=1e-5)
    with pytest.raises(RuntimeError):
        centrality.algebraic_connectivity(g, limit=1, rounds=3)


def test_traversal(spark, hierarchy):
    assert {r["id"] for r in traversal.k_hop(hierarchy, "acc1", 1).collect()} == {"acc1", "dist1"}
    with pytest.raises(ValueError):
        traversal.k_hop(hierarchy, "none", 1)
    path = traversal.critical_path(hierarchy, "acc1", "acc3")
    assert {r["id"] for r in path.nodes.collect()} == {"acc1", "dist1", "core1", "core2", "dist2", "acc3"}
    assert {(r["src"], r["dst"]): r["redundant"] for r in traversal.redundant_edges(hierarchy).collect()}["core1", "core2"]


def test_snapshot_changes(spark):
    nodes = spark.createDataFrame([(0, "A"), (0, "B"), (0, "C"), (1, "A"), (1, "B"), (1, "C"), (1, "D")], "seq int, id string")
    edges = spark.createDataFrame([(0, "A", "B"), (0, "B", "C"), (0, "A", "C"), (1, "A", "B"), (1, "B", "C"), (1, "A", "C"), (1, "C", "D")], "seq int, src string, dst string")
    seqs = nodes.select("seq").distinct()
    d = temporal.magnitudes(seqs, temporal.changes(nodes, ["id"]), temporal.changes(edges, ["src", "dst"])).collect()
    assert [(r["magnitude"], r["is_stable"]) for r in d] == [(3, False)]


def test_risk_chain(spark):
    g = Topology(
        spark.createDataFrame([("core", 85.0), ("dist1", 40.0), ("acc1", 10.0), ("acc2", 10.0)], "id string, utilization double"),
        spark.createDataFrame([("core", "dist1", 1000, 90.0, 0.02), ("acc1", "dist1", 100, 10.0, 0.0), ("acc2", "dist1", 100, 10.0, 0.0)], "src string, dst string, speed_mbps int, utilization_in double, error_rate double"),
    )
    link = {(r["src"], r["dst"]): r for r in predict.link_failures(g.edges).collect()}
    assert link["core", "dist1"]["probability"] == pytest.approx(0.5) and link["core", "dist1"]["risk_level"] == "high"
    assert link["acc1", "dist1"]["probability"] == pytest.approx(0.1192, abs=1e-4)
    sla = {(r["src"], r["dst"]): r["probability"] for r in predict.sla_violations(g).collect()}
    assert sla["core", "dist1"] == pytest.approx(0.69, abs=1e-3) and sla["acc1", "dist1"] == pytest.approx(0.2315, abs=1e-3)
    over = rows(predict.node_overloads(g))
    assert over["dist1"]["risk_level"] == "medium" and over["acc1"]["probability"] == pytest.approx(0.1192, abs=1e-4)


def test_demo_has_17_nodes_and_21_edges(spark):
    s = graphs.demo(spark).summary().head()
    assert (s["nodes"], s["edges"]) == (17, 21)
