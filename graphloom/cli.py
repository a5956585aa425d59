"""Command line: ingest, detect, predict, impact, viz, train, serve and demo over node-link JSON files."""

from __future__ import annotations

import argparse
import json
import sys

from graphloom.session import forget, session


def _load(spark, path: str):
    from graphloom.sources import graphs

    return graphs.read_node_link(spark, path)


def ingest(spark, file: str, format: str, device: str):
    """A graph from a text or JSON file; JSON with nodes and links is taken as a graph already."""
    from graphloom.sources import graphs, texts

    t = texts.read_texts(spark, file, device)
    if format == "lldp":
        return graphs.from_neighbors(texts.lldp_neighbors(t))
    if format == "cdp":
        return graphs.from_neighbors(texts.cdp_neighbors(t))
    if format == "snmp":
        return graphs.from_snmp(texts.snmp_device(t), texts.snmp_interfaces(t), texts.snmp_neighbors(t))
    if format in ("routing", "ios", "junos", "routes-json"):
        return graphs.from_routes(texts.routes(t, {"routing": "ios", "routes-json": "json"}.get(format, format)))
    if format == "json":
        head = json.loads(t.head()["value"])
        if isinstance(head, dict) and "nodes" in head and ("links" in head or "edges" in head):
            return graphs.from_node_link(t)
        return graphs.from_neighbors(texts.json_neighbors(t))
    raise ValueError(f"unknown format: {format}")


def _rows(df, *order) -> list[dict]:
    from pyspark.sql import functions as F

    return [json.loads(r) for r in (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*")).alias("j")).toArrow()["j"].to_pylist()]


def predict_tables(graph) -> dict:
    from pyspark.sql import functions as F

    from graphloom.operators import predict

    none = graph.edges.select("src", "dst", F.lit(0.0).alias("trend"))
    parts = {"link_failures": predict.link_failures(graph.edges), "node_overloads": predict.node_overloads(graph), "capacity_exhaustion": predict.capacity(graph.edges, none, none), "sla_violations": predict.sla_violations(graph)}
    out = {k: v.orderBy(F.col("hours").asc() if k == "capacity_exhaustion" else F.desc("probability")) for k, v in parts.items()}
    return out | {"summary": predict.summary(*parts.values())}


def predict_report(graph) -> dict:
    out = {k: _rows(v) for k, v in predict_tables(graph).items()}
    return out | {"summary": out["summary"][0]}


def detect_report(graph, epochs: int = 50, percentile: float = 95.0) -> dict:
    from pyspark.sql import functions as F

    from graphloom.operators.detect import Detector

    got = Detector(percentile=percentile).fit(graph, epochs).detect(graph)
    return {"graph_score": got["graph_score"], "node_scores": _rows(got["node_scores"], F.desc("score"), "id"), "anomalous_nodes": _rows(got["flagged"], F.desc("score"), "id"), "articulation_points": [r["id"] for r in _rows(got["articulation_points"], "id")], "bridges": _rows(got["bridges"], "src", "dst"), "events": _rows(got["events"])}


def impact_report(graph, node: str | None = None) -> dict:
    from pyspark.sql import functions as F

    from graphloom.operators import impact

    if node:
        return impact.blast_radius_node(graph, node)
    got = impact.report(graph)
    return {k: _rows(v, F.desc("total_affected"), "id") if k == "blast_radius" else _rows(v) for k, v in got.items()}


def train(graph, labels: dict[str, int] | None = None, model: str = "gcn", epochs: int = 100, rate: float = 0.01, hidden: int = 32, seed: int = 0) -> list[tuple]:
    """Trains a node classifier; without labels, the device types are the classes."""
    import numpy as np

    from graphloom.gnn import models
    from graphloom.operators.detect import Detector

    ids, x, a = Detector()._dense(graph)
    if labels is None:
        kinds = {r["id"]: r["type"] or "" for r in graph.nodes.select("id", "type").toArrow().to_pylist()}
        names = sorted(set(kinds.values()))
        labels = {i: names.index(kinds[i]) for i in ids}
    y = np.array([labels.get(i, 0) for i in ids])
    mask = np.random.RandomState(seed).rand(len(ids)) < 0.7
    make = {"gcn": lambda n: models.gcn(x.shape[1], [hidden], n), "sage": lambda n: models.sage(x.shape[1], [hidden], n), "gat": lambda n: models.gat(x.shape[1], hidden, n)}[model]
    return models.train_classifier(make(int(y.max()) + 1), x, a, y, mask, ~mask, epochs, rate).rows


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("file"), c.add_argument("--format", "-f", default="lldp"), c.add_argument("--device", "-d", default="unknown"), c.add_argument("--output", "-o")
    for name in ("detect", "predict", "impact", "viz", "train", "serve"):
        c = sub.add_parser(name)
        c.add_argument("file"), c.add_argument("--output", "-o")
        if name in ("predict", "impact"):
            c.add_argument("--tables", help="a folder for the report's tables, written by the executors")
            c.add_argument("--show", type=int, default=0, help="print so many rows of each table")
        if name == "detect":
            c.add_argument("--threshold", type=float, default=95.0), c.add_argument("--epochs", type=int, default=50)
        if name == "impact":
            c.add_argument("--node")
        if name == "viz":
            c.add_argument("--format", "-f", default="html", choices=["html", "mermaid", "d3", "grafana"])
        if name == "train":
            c.add_argument("--model", default="gcn", choices=["gcn", "gat", "sage"]), c.add_argument("--epochs", type=int, default=100), c.add_argument("--lr", type=float, default=0.01), c.add_argument("--hidden", type=int, default=32)
        if name == "serve":
            c.add_argument("--port", type=int, default=5000)
    sub.add_parser("demo").add_argument("--output", "-o")
    a = p.parse_args(argv)
    spark = session()
    from graphloom.sinks import exports
    from graphloom.sources import graphs

    if a.command == "ingest":
        out = exports.to_node_link(ingest(spark, a.file, a.format, a.device))
    elif a.command == "demo":
        g = graphs.demo(spark)
        out = {"detect": detect_report(g, 50), "predict": predict_report(g), "impact": impact_report(g)}
    else:
        g = _load(spark, a.file)
        if a.command == "serve":
            from graphloom.service import serve

            serve(g, a.port)
            return 0
        if getattr(a, "tables", None) or getattr(a, "show", 0):
            from graphloom.operators import impact

            tables = predict_tables(g) if a.command == "predict" else impact.report(g)
            if a.tables:
                exports.write_tables(a.tables, tables)
            for name, df in tables.items() if a.show else ():
                sys.stdout.write(f"{name}\n")
                df.show(a.show, False)
            forget(spark)
            return 0
        out = {
            "detect": lambda: detect_report(g, a.epochs, a.threshold),
            "predict": lambda: predict_report(g),
            "impact": lambda: impact_report(g, a.node),
            "train": lambda: [list(r) for r in train(g, None, a.model, a.epochs, a.lr, a.hidden)],
            "viz": lambda: {"html": exports.to_html, "mermaid": exports.to_mermaid, "d3": exports.to_d3, "grafana": exports.to_dashboard}[a.format](g),
        }[a.command]()
    if a.output:
        exports.save(a.output, out)
    else:
        sys.stdout.write(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
        sys.stdout.write("\n")
    forget(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
