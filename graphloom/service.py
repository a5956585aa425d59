"""HTTP service over one graph, from the standard library: JSON endpoints and pages. Reads change nothing."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from graphloom import cli
from graphloom.frame import Topology
from graphloom.operators import impact
from graphloom.sinks import exports
from graphloom.sources import graphs


class Service:
    """Answers requests as (status, body); reports are made once for each graph."""

    def __init__(self, graph: Topology | None = None, epochs: int = 50):
        self.lock, self.epochs = threading.RLock(), epochs
        self.set_graph(graph)

    def set_graph(self, graph: Topology | None) -> None:
        with self.lock:
            self.graph, self._kept = graph, {}

    def _once(self, name: str, make):
        with self.lock:
            if name not in self._kept:
                self._kept[name] = make(self.graph)
            return self._kept[name]

    def get(self, path: str) -> tuple[int, dict | list | str]:
        path = path.split("?")[0].rstrip("/")
        if path == "/api/v1/health":
            return 200, {"status": "ok", "graph_loaded": self.graph is not None}
        if self.graph is None:
            return 404, {"error": "no graph loaded"}
        if path in ("", "/topology", "/anomaly", "/predict", "/impact"):
            return 200, self._once("page", exports.to_html)
        if path.startswith("/api/v1/topology"):
            d = self._once("topology", exports.to_d3)
            rest = path.removeprefix("/api/v1/topology").strip("/").split("/")
            if rest == [""]:
                return 200, d | {"summary": cli._rows(self.graph.summary())[0]}
            if rest in (["nodes"], ["edges"]):
                return 200, d["nodes" if rest == ["nodes"] else "links"]
            if rest[0] == "node" and len(rest) == 2:
                found = cli._rows(self.graph.nodes.where(F.col("id") == rest[1]))
                near = [r["b"] for r in self.graph.arcs().where(F.col("a") == rest[1]).select("b").toArrow().to_pylist()]
                return (200, found[0] | {"neighbors": sorted(near)}) if found else (404, {"error": "no such node"})
        if path.startswith("/api/v1/anomaly"):
            got = self._once("anomaly", lambda g: cli.detect_report(g, self.epochs))
            return 200, got["anomalous_nodes"][:10] if path.endswith("/nodes") else got
        if path == "/api/v1/predict":
            got = self._once("predict", cli.predict_report)
            return 200, {k: v[:10] if isinstance(v, list) else v for k, v in got.items()}
        return 404, {"error": "not found"}

    def post(self, path: str, body: dict) -> tuple[int, dict | list]:
        if path == "/set_graph":
            spark = cli.local_session()
            self.set_graph(graphs.from_node_link(spark.createDataFrame([(json.dumps(body),)], "value string")))
            return 200, {"status": "ok", "nodes": self.graph.nodes.count()}
        if self.graph is None:
            return 404, {"error": "no graph loaded"}
        if path == "/api/v1/impact/blast":
            if "node" in body:
                return 200, impact.blast_radius_node(self.graph, body["node"])
            if "edge" in body and len(body["edge"]) == 2:
                u, v = sorted(body["edge"])
                found = cli._rows(impact.blast_radius_edges(self.graph).where((F.col("src") == u) & (F.col("dst") == v)))
                return (200, found[0]) if found else (404, {"error": "no such edge"})
            return 400, {"error": "node or edge is required"}
        if path == "/api/v1/impact/whatif":
            if not body.get("failures"):
                return 400, {"error": "failures are required"}
            return 200, impact.what_if(self.graph, body["failures"])
        return 404, {"error": "not found"}


def serve(graph: Topology | None, port: int = 5000, host: str = "127.0.0.1") -> None:
    service = Service(graph)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body) -> None:
            raw = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._send(*service.get(self.path))

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._send(400, {"error": "the body is no JSON"})
            self._send(*service.post(self.path, body))

    ThreadingHTTPServer((host, port), Handler).serve_forever()
