"""Networks: gradients against differences, table passes against matrices, training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.frame import Topology
from graphloom.gnn import links as L
from graphloom.gnn import models as M
from graphloom.gnn import passing
from graphloom.gnn import tape as T
from graphloom.operators import detect


def ring(n=8, seed=42):
    rng = np.random.RandomState(seed)
    a = np.zeros((n, n))
    for i in range(n):
        a[i, (i + 1) % n] = a[(i + 1) % n, i] = 1
    return rng.randn(n, 4), a


@pytest.mark.parametrize("make", [lambda: M.gcn(4, [5], 3, 0.0), lambda: M.gat(4, 3, 3, 2, 2, 0.0), lambda: M.sage(4, [5], 3, "mean", dropout=0.0), lambda: M.sage(4, [5], 3, "max", dropout=0.0), lambda: M.gcn(4, [5], 3, 0.0, "graph")])
def test_gradients(make):
    x, a = ring()
    net = make()
    y = np.arange(8) % 3

    def loss():
        out = net(x, a)
        return M.cross_entropy(out, y[: len(out.data)])

    v = loss()
    v.backward()
    for p in net.params:
        g = p.grad.copy()
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        p.data[i] += 1e-6
        up = loss().data
        p.data[i] -= 2e-6
        down = loss().data
        p.data[i] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[i], rel=1e-3, abs=1e-6)


def test_training_lowers_loss_and_weights_survive():
    x, a = ring(10)
    y = (x[:, 0] > 0).astype(int)
    net = M.gcn(4, [8], 2, 0.1)
    h = M.train_classifier(net, x, a, y, np.arange(10) < 7, np.arange(10) >= 7, 60)
    assert min(r[1] for r in h.rows) < h.rows[0][1]
    again = M.gcn(4, [8], 2, 0.1, seed=9)
    again.load_rows(net.rows())
    assert (again.predict(x, a) == net.predict(x, a)).all()


def test_autoencoder():
    x, a = ring()
    m = M.Autoencoder(4, 8, 4)
    h = m.train(x, a, 60, 0.01)
    assert h.rows[-1][1] < h.rows[0][1]
    node, edges, score = m.scores(x, a)
    assert len(node) == 8 and len(edges) == 16 and 0 <= score <= 1


def test_table_passes_match_matrices(spark):
    x, a = ring(6)
    w = np.random.RandomState(1).randn(4, 3)
    h = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, h array<double>")
    norm = M.normalised(a)
    cells = spark.createDataFrame([(str(i), str(j), float(norm[i, j])) for i, j in zip(*np.nonzero(norm))], "a string, b string, v double")
    got = {r["id"]: r["h"] for r in passing.gcn(h, cells, w).collect()}
    want = np.maximum(norm @ x @ w, 0)
    assert np.allclose([got[str(i)] for i in range(6)], want)
    arcs = spark.createDataFrame([(str(i), str(j)) for i, j in zip(*np.nonzero(a))], "a string, b string")
    got = {r["id"]: r["h"] for r in passing.sage(h, arcs, np.vstack([w, w]), None, "mean").collect()}
    z = np.c_[x, a / a.sum(1, keepdims=True) @ x] @ np.vstack([w, w])
    assert np.allclose([got[str(i)] for i in range(6)], np.maximum(z / np.linalg.norm(z, axis=1, keepdims=True), 0))
    alpha = passing.attention(h, arcs, w, np.ones(3), -np.ones(3)).groupBy("a").sum("alpha").collect()
    assert all(r[1] == pytest.approx(1) for r in alpha)


def test_unknown_aggregator(spark):
    with pytest.raises(ValueError):
        M.sage(4, [3], 2, "median")
    assert T.relu(T.lift(-1.0)).data == 0


@pytest.mark.parametrize("tasks", [False, True])
def test_autoencoder_of_links_equals_dense(spark, monkeypatch, tasks):
    monkeypatch.setattr(L, "BLOCK", 16)
    rng = np.random.RandomState(3)
    n, (i, j) = 70, rng.randint(0, 70, (2, 150))  # with loops and repeated links
    a, x = np.zeros((n, n)), rng.randn(n, 4)
    a[i, j] = a[j, i] = 1
    links = L.Links(n, i, j, detect._by_tasks(spark) if tasks else L.here)
    dense, sparse = M.Autoencoder(4, 6, 3), M.Autoencoder(4, 6, 3)
    want, got = dense.train(x, a, 4, 0.01), sparse.train(x, links, 4, 0.01)
    assert [r[1] for r in got.rows] == pytest.approx([r[1] for r in want.rows], abs=1e-9)
    node, edges, score = dense.scores(x, a)
    by_node, by_cell = sparse.errors(x, links)
    assert np.allclose(by_node, node, atol=1e-9) and by_node.mean() == pytest.approx(score)
    assert np.allclose(by_cell, [edges[k] for k in zip(links.i.tolist(), links.j.tolist())], atol=1e-9) and len(by_cell) == len(edges)


def test_detector_beyond_dense_matrices(spark, monkeypatch):
    monkeypatch.setattr(detect, "DENSE_LIMIT", 3)
    monkeypatch.setattr(detect, "HERE_LIMIT", 3)
    nodes = spark.createDataFrame([(c, "router", ["Router"], 0.5) for c in "abcdef"], "id string, type string, capabilities array<string>, utilization double")
    g = Topology(nodes, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "src string, dst string"))
    got = detect.Detector(4, 2).fit(g, 2).detect(g)
    assert sorted(r["id"] for r in got["node_scores"].collect()) == list("abcdef")
    assert got["edge_scores"].count() == 8 and 0 < got["graph_score"] < 1


def test_node_errors_send_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(passing, "CHUNK", 8 * 3 * 25)  # 4 chunks
    v = np.random.RandomState(5).randn(90, 3)
    h = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, h array<double>")
    got = passing.node_errors(h, spark.createDataFrame([(0, 1), (1, 0), (4, 4)], "src long, dst long"), 8)
    assert "explode" not in got._jdf.queryExecution().toString().lower()  # no copy of a block for each other block
    p = 1 / (1 + np.exp(-v @ v.T))
    p[[0, 1, 4], [1, 0, 4]] = 1 - p[[0, 1, 4], [1, 0, 4]]
    rows = sorted(got.collect())
    assert [r["id"] for r in rows] == list(range(90)) and np.allclose([r["score"] for r in rows], p.mean(1))
    none = passing.node_errors(h.where("id < 0"), h.where("id < 0").select(F.col("id").alias("src"), F.col("id").alias("dst")))
    assert none.collect() == []


def test_anomaly_report_trains_in_full(spark, monkeypatch):
    """The report's autoencoder has the detector's own sizes and rounds of training."""
    from graphloom.plans import queries

    seen = []
    plain = M.Autoencoder.train
    monkeypatch.setattr(queries.I, "site", lambda s, d: Topology(s.createDataFrame([(c, "router", ["Router"], 0.5) for c in "abcd"], "id string, type string, capabilities array<string>, utilization double"), s.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")))
    monkeypatch.setattr(M.Autoencoder, "train", lambda self, x, a, epochs, rate: seen.append((epochs, self.encode(x, a)[1].data.shape[1])) or plain(self, x, a, epochs, rate))
    assert queries.anomaly_report(spark, "").count() == 4
    assert seen == [(100, 16)]
