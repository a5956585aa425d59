"""Graphs of many twins: results from classes against those node by node, and how little is walked for them."""

import itertools
import random

import pytest

from graphloom.frame import Topology
from graphloom.operators import centrality, cuts, impact, traversal, twins


def of(spark, pairs, nodes=(), directed=False):
    ids = sorted({x for p in pairs for x in p} | set(nodes))
    return Topology(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(sorted({p if directed else tuple(sorted(p)) for p in pairs}), "src string, dst string"), directed)


def some(seed):
    """Hubs, leaves on one or two of them, a long ring without twins, a pair apart."""
    rng = random.Random(seed)
    pairs = {(f"h{i}", f"h{(i + 1) % 4}") for i in range(3)}
    for i in range(14):
        pairs |= {(f"l{i:02}", f"h{h}") for h in {rng.randrange(4), rng.randrange(4)}}
    pairs |= {(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)} | {("r0", "h0"), ("p", "q"), ("h1", "h1")}
    return pairs


def near_of(pairs):
    near = {x: set() for p in pairs for x in p}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def walk(near, s, without=None):
    far, front = {s: 0}, [s]
    while front:
        new = []
        for x in front:
            for y in near[x]:
                if y != without and y not in far:
                    far[y] = far[x] + 1
                    new.append(y)
        front = new
    return far


@pytest.mark.parametrize("most", [16, 0])
def test_distances(spark, monkeypatch, most):
    monkeypatch.setattr(twins, "MOST", most)
    pairs = some(1)
    g, near = of(spark, pairs, ["alone"]), near_of(pairs)
    near["alone"] = set()
    want = {(s, t): d for s in near for t, d in walk(near, s).items()}
    got = traversal.all_pairs(g).collect()
    assert {(r["source"], r["id"]): r["hop"] for r in got} == want and len(got) == len(want)
    n = len(near)
    close = {s: 0.0 if len(f) == 1 else (len(f) - 1) / sum(f.values()) * (len(f) - 1) / (n - 1) for s in near for f in [walk(near, s)]}
    for rows in (traversal.PAIRS,):
        assert {r["id"]: r["closeness"] for r in traversal.closeness(g, rows).collect()} == pytest.approx(close)


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_of_classes_equals_joins(spark, monkeypatch, directed):
    g = of(spark, some(2), ["alone"], directed)
    node, edge = ({r["id"]: r["betweenness"] for r in centrality.betweenness(g).collect()}, {(r["src"], r["dst"]): r["betweenness"] for r in centrality.edge_betweenness(g).collect()})
    monkeypatch.setattr(centrality, "LIMIT", 0)
    assert {r["id"]: r["betweenness"] for r in centrality.betweenness(g).collect()} == pytest.approx(node) and max(node.values()) > 0
    # Arcs on no shortest path have no row by joins.
    other = {(r["src"], r["dst"]): r["betweenness"] for r in centrality.edge_betweenness(g).collect()}
    assert {**dict.fromkeys(edge, 0.0), **other} == pytest.approx(edge)


def test_connectivity_of_classes(spark, monkeypatch):
    pairs = {p for p in some(3) if p not in (("p", "q"), ("h1", "h1"))}
    g = of(spark, pairs)
    got = centrality.algebraic_connectivity(g)
    star = of(spark, {("hub", f"x{i}") for i in range(9)})
    assert centrality.algebraic_connectivity(star) == pytest.approx(1.0)
    monkeypatch.setattr(twins, "MOST", 0)
    assert centrality.algebraic_connectivity(g) == pytest.approx(got) and got > 0


@pytest.mark.parametrize("limit", [cuts.LIMIT, 0])
def test_redundancy_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(cuts, "LIMIT", limit)
    pairs = some(4)
    g, near = of(spark, pairs, ["alone"]), near_of(pairs)
    got = {r["id"]: (r["alternate_paths"], r["min_path_length"], r["is_spof"]) for r in impact.redundancy(g).collect()}
    for v in near:
        ways = [walk(near, a, v).get(b) for a, b in itertools.combinations(sorted(near[v]), 2)]
        kept = [w for w in ways if w]
        assert got[v] == (len(kept), min(kept, default=0), len(kept) < len(ways)), v
    assert got["alone"] == (0, 0, False) and got["r3"][1] == 5


def test_a_hub_of_many_leaves_is_few_classes(spark):
    """What is walked from grows with the classes: a hub's thousand leaves are one, and no row holds its neighbours."""
    c = twins.collapse(of(spark, {("hub", f"x{i}") for i in range(1000)} | {("hub", "other"), ("other", "end")}))
    assert c.sizes.count() == 4 and c.arcs.count() == 6 and max(r["w"] for r in c.sizes.collect()) == 1000
