"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from graphloom.plans.devices import LINES

SITE = """
sold AS (
  SELECT l_suppkey, c_nationkey, count(*) AS lines, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount,
         count(*) FILTER (l_returnflag = 'R') AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY lines DESC, c_nationkey) AS r FROM sold) WHERE r = 1),
whole AS (SELECT l_suppkey, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(discount) AS BIGINT) AS discount, CAST(sum(returned) AS BIGINT) AS returned FROM sold GROUP BY 1),
edges AS (
  SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, 'ospf' AS protocol, 1000 AS speed_mbps,
         coalesce(discount, 0) * 10.0::DOUBLE / coalesce(lines, 1) AS utilization_in, coalesce(returned, 0) * 0.05::DOUBLE / coalesce(lines, 1) AS error_rate
  FROM supplier LEFT JOIN whole ON s_suppkey = l_suppkey
  UNION ALL
  SELECT 'n' || c_nationkey, 's' || l_suppkey, 'bgp', 100, discount * 10.0::DOUBLE / lines, returned * 0.05::DOUBLE / lines
  FROM best JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey
  UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'static', 10000, 0.0::DOUBLE, 0.0::DOUBLE FROM nation),
nodes AS (
  SELECT 'r' || r_regionkey AS id, 'router' AS type, 'Router' AS cap, 0.0::DOUBLE AS utilization FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'switch', 'Bridge', 50.0::DOUBLE FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'server', '', abs(s_acctbal) / 100.0::DOUBLE FROM supplier),
arcs AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT id, count(b) AS degree FROM nodes LEFT JOIN arcs ON id = a GROUP BY 1)"""

HOPS = """,
far(source, id, hop) AS (
  SELECT id, id, 0 FROM nodes UNION SELECT source, b, hop + 1 FROM far JOIN arcs ON id = a WHERE hop < 16),
hops AS (SELECT source, id, min(hop) AS hop FROM far GROUP BY 1, 2),
comps AS (SELECT source AS id, min(id) AS comp FROM hops GROUP BY 1),
sizes AS (SELECT comp, count(*) AS n FROM comps GROUP BY 1)"""

WITHOUT = """,
left_(v, s, id) AS (
  SELECT a, b, b FROM arcs UNION SELECT v, s, b FROM left_ JOIN arcs ON id = a WHERE b <> v),
meets AS (SELECT l.v, l.s, l.id AS t FROM left_ l JOIN arcs k ON k.a = l.v AND k.b = l.id),
pieces AS (SELECT DISTINCT v, piece, n FROM (SELECT v, s, min(id) AS piece, count(*) AS n FROM left_ GROUP BY 1, 2))"""

CUT_EDGES = """,
side(src, dst, id) AS (
  SELECT src, dst, src FROM edges
  UNION SELECT s.src, s.dst, b FROM side s JOIN arcs ON s.id = a WHERE NOT ((a = s.src AND b = s.dst) OR (a = s.dst AND b = s.src))),
cut_edges AS (SELECT src, dst, count(*) AS n FROM side GROUP BY 1, 2 HAVING count(*) FILTER (id = dst) = 0)"""

PATHS = """,
ways(source, id, hop) AS (
  SELECT id, id, 0 FROM nodes
  UNION ALL SELECT w.source, b, w.hop + 1 FROM ways w JOIN arcs ON w.id = a JOIN hops h ON h.source = w.source AND h.id = b AND h.hop = w.hop + 1),
sigma AS (SELECT source, id, hop, CAST(count(*) AS DOUBLE) AS s FROM ways GROUP BY 1, 2, 3)"""

TRADE = """
pairs AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
arcs AS (SELECT src AS a, dst AS b FROM pairs UNION ALL SELECT dst, src FROM pairs),
deg AS (SELECT a AS id, count(*) AS degree FROM arcs GROUP BY 1)"""

FLOW = """
e AS (SELECT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e)"""

DAILY = """
ev AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS seq, 'u' || user_id AS u, 'e_' || event_type AS k FROM events),
edges AS (SELECT seq, k AS src, u AS dst, count(*) AS n FROM ev GROUP BY 1, 2, 3),
nodes AS (SELECT DISTINCT seq, src AS id FROM edges UNION SELECT DISTINCT seq, dst FROM edges),
seqs AS (SELECT seq, row_number() OVER (ORDER BY seq) AS place FROM (SELECT DISTINCT seq FROM edges)),
pe AS (SELECT e.*, place FROM edges e JOIN seqs USING (seq)),
pn AS (SELECT x.*, place FROM nodes x JOIN seqs USING (seq)),
ed AS (SELECT coalesce(b.place, a.place + 1) AS place, CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'modified' END AS kind
  FROM pe a FULL JOIN pe b ON a.src = b.src AND a.dst = b.dst AND b.place = a.place + 1),
nd AS (SELECT coalesce(b.place, a.place + 1) AS place, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' END AS kind
  FROM pn a FULL JOIN pn b ON a.id = b.id AND b.place = a.place + 1),
delta AS (
  SELECT seq, coalesce(na, 0) AS nodes_added, coalesce(nr, 0) AS nodes_removed, coalesce(ea, 0) AS edges_added, coalesce(er, 0) AS edges_removed
  FROM seqs s LEFT JOIN (SELECT place, count(*) FILTER (kind = 'added') AS na, count(*) FILTER (kind = 'removed') AS nr FROM nd GROUP BY 1) x ON s.place = x.place
  LEFT JOIN (SELECT place, count(*) FILTER (kind = 'added') AS ea, count(*) FILTER (kind = 'removed') AS er FROM ed GROUP BY 1) y ON s.place = y.place WHERE s.place > 1),
mag AS (SELECT *, nodes_added + nodes_removed + 2 * (edges_added + edges_removed) AS magnitude FROM delta),
zs AS (SELECT seq, magnitude, nodes_added, nodes_removed, avg(magnitude) OVER w AS m, stddev_pop(magnitude) OVER w AS s FROM mag WINDOW w AS (ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""

METRICS = """
m AS (SELECT user_id, seq, sum(cents) / 100.0::DOUBLE / count(*) AS util, CAST(sum(bad) AS DOUBLE) / count(*) AS errors FROM (
  SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS seq, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events) GROUP BY 1, 2),
last10 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM m QUALIFY r <= 10),
slopes AS (SELECT user_id, count(*) AS n, regr_slope(util, -CAST(r AS DOUBLE)) AS a, regr_slope(errors, -CAST(r AS DOUBLE)) AS b FROM last10 GROUP BY 1),
trend AS (SELECT user_id, n, CASE WHEN n >= 3 AND abs(a) >= 1e-12 THEN a ELSE 0 END AS util_trend, CASE WHEN n >= 3 AND abs(b) >= 1e-12 THEN b ELSE 0 END AS error_trend FROM slopes),
now AS (SELECT user_id, arg_max(util, seq) AS util, arg_max(errors, seq) AS errors FROM m GROUP BY 1)"""

LEVEL = "CASE WHEN {p} >= 0.8 THEN 'critical' WHEN {p} >= 0.5 THEN 'high' WHEN {p} >= 0.2 THEN 'medium' ELSE 'low' END"
SEVERITY = "CASE WHEN {t} = 0 THEN 'low' WHEN {a} / CAST({t} AS DOUBLE) > 0.5 OR {l} > 50 THEN 'critical' WHEN {a} / CAST({t} AS DOUBLE) > 0.25 OR {l} > 25 THEN 'high' WHEN {a} / CAST({t} AS DOUBLE) > 0.1 OR {l} > 10 THEN 'medium' ELSE 'low' END"


def _level(p: str) -> str:
    return LEVEL.format(p=p)


SLA = """,
two AS (SELECT e.src, e.dst, x.b AS x, y.b AS y FROM edges e JOIN arcs x ON x.a = e.src AND x.b <> e.dst JOIN arcs y ON y.a = x.b AND y.b <> e.src),
red AS (SELECT DISTINCT src, dst FROM two WHERE y = dst UNION SELECT DISTINCT t.src, t.dst FROM two t JOIN arcs z ON z.a = t.y AND z.b = t.dst WHERE t.y <> t.dst),
sla AS (SELECT e.src, e.dst, 1 / (1 + exp(-(4 * ((CASE WHEN error_rate > 0.001 THEN 0.3 ELSE 0 END) + (CASE WHEN utilization_in > 70 THEN 0.2 ELSE 0 END) + (CASE WHEN r.src IS NULL THEN 0.2 ELSE 0 END))::DOUBLE - 2))) AS p
  FROM edges e LEFT JOIN red r ON e.src = r.src AND e.dst = r.dst)"""

BETWEEN = HOPS + PATHS + """,
bt AS (SELECT n.id, coalesce(sum(x.s * y.s / z.s), 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS b
  FROM nodes n LEFT JOIN (sigma x JOIN sigma y ON x.id = y.source JOIN sigma z ON z.source = x.source AND z.id = y.id AND z.hop = x.hop + y.hop) ON x.id = n.id AND x.source <> n.id AND y.id <> n.id GROUP BY 1)"""

H = ", h AS (SELECT id, degree / 10.0::DOUBLE AS x, 1.0::DOUBLE AS y FROM deg)"
ADJ = """, cells AS (SELECT a, b, 1.0::DOUBLE AS w FROM arcs UNION ALL SELECT id, id, 1.0::DOUBLE FROM nodes), ds AS (SELECT a, sum(w) AS d FROM cells GROUP BY 1),
adj AS (SELECT c.a, c.b, w / (sqrt(x.d) * sqrt(y.d)) AS v FROM cells c JOIN ds x ON c.a = x.a JOIN ds y ON c.b = y.a)"""

STATES = """st AS (SELECT 's' || s_suppkey AS device, 'up' AS admin_status, CASE WHEN s_acctbal < 0 THEN 'down' ELSE 'up' END AS oper_status, abs(s_acctbal) * 10000 AS i, abs(s_acctbal) * 2000 AS o,
  CAST(s_nationkey AS BIGINT) + 1 AS errors, s_suppkey * 100 + 50 AS packets FROM supplier)"""


def _pr(rounds: int) -> str:
    """Unrolled rank rounds over the weighted flow."""
    sql = f"WITH {FLOW}, n AS (SELECT 'n' || n_nationkey AS id FROM nation), k AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM n), t AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), p0 AS (SELECT id, 1 / c AS r FROM n, k)"
    for i in range(1, rounds + 1):
        sql += f", p{i} AS (SELECT n.id, 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT src FROM t)) / c) + 0.15::DOUBLE / c AS r FROM n CROSS JOIN k LEFT JOIN (SELECT dst, sum(r * weight / t) AS g FROM p{i - 1} JOIN e ON id = e.src JOIN t ON t.src = e.src GROUP BY 1) ON dst = n.id)"
    return sql + f" SELECT id, round(r, 8) AS pagerank FROM p{rounds}"


IOS = """,
c AS (SELECT *, CAST(part % 8 AS INTEGER) AS c, CASE WHEN r THEN NULL ELSE supp % 8 + 17 END AS own FROM x),
m AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY device ORDER BY k ROWS UNBOUNDED PRECEDING), 24) AS mask FROM c),
routes AS (SELECT device AS source_router, k, net || '.0/' || mask AS network, ['connected', 'static', 'ospf', 'ospf-inter-area', 'ospf-external-type2', 'bgp', 'eigrp-external', 'isis-level1'][c + 1] AS protocol,
  CASE WHEN c = 0 THEN '' ELSE '10.0.' || (supp % 250) || '.1' END AS next_hop, CASE WHEN c = 0 THEN '' ELSE 'Te1/' || k END AS next_hop_interface, CAST(CASE WHEN c = 0 THEN 0 ELSE part END AS INTEGER) AS metric, CASE WHEN c = 0 THEN 0 ELSE qty + 10 END AS admin_distance FROM m)"""


def _settled(of: str, rounds: int) -> str:
    """CTEs of rank rounds over unweighted arcs, one after another, and settled: the ranks once they move by less than nodes / 1e6."""
    sql = ", pk AS (SELECT a, CAST(count(*) AS DOUBLE) AS k FROM arcs GROUP BY 1), pn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM deg), p0 AS MATERIALIZED (SELECT id, 1 / n AS r, 1e9::DOUBLE AS moved FROM deg, pn)"
    for i in range(1, rounds + 1):
        sql += f", p{i} AS MATERIALIZED (SELECT x.id, 0.85::DOUBLE * coalesce(g, 0) + 0.15::DOUBLE / n AS r, abs(0.85::DOUBLE * coalesce(g, 0) + 0.15::DOUBLE / n - x.r) AS moved FROM p{i - 1} x CROSS JOIN pn LEFT JOIN (SELECT b, sum(r / k) AS g FROM p{i - 1} JOIN arcs ON id = arcs.a JOIN pk ON pk.a = arcs.a GROUP BY 1) ON b = x.id)"
    every = " UNION ALL ".join(f"SELECT {i} AS round, id, r, moved FROM p{i}" for i in range(1, rounds + 1))
    return sql + f", every_round AS ({every}), {of} AS (SELECT id, r FROM every_round WHERE round = (SELECT min(round) FROM (SELECT round FROM every_round, pn GROUP BY round, n HAVING sum(moved) < n / 1e6)))"


def _rounds(rounds: int) -> str:
    """CTEs of as many rank rounds over unweighted arcs."""
    sql = ", pk AS (SELECT a, CAST(count(*) AS DOUBLE) AS k FROM arcs GROUP BY 1), pn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM deg), p0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM deg, pn)"
    for i in range(1, rounds + 1):
        sql += f", p{i} AS MATERIALIZED (SELECT x.id, 0.85::DOUBLE * coalesce(g, 0) + 0.15::DOUBLE / n AS r FROM deg x CROSS JOIN pn LEFT JOIN (SELECT b, sum(r / k) AS g FROM p{i - 1} JOIN arcs ON id = arcs.a JOIN pk ON pk.a = arcs.a GROUP BY 1) ON b = x.id)"
    return sql


CLOSE = """, close AS (SELECT id, CASE WHEN t > 0 THEN r / t * (r / CAST((SELECT count(*) - 1 FROM nodes) AS DOUBLE)) ELSE 0 END AS closeness FROM (SELECT source AS id, count(*) - 1 AS r, CAST(sum(hop) AS DOUBLE) AS t FROM hops GROUP BY 1))"""

SAGE = "WITH {site}{h}, g AS (SELECT a AS id, {how}(x) AS gx, {how}(y) AS gy FROM arcs JOIN h ON h.id = b GROUP BY 1), d AS (SELECT h.id, x - coalesce(gx, 0) AS x, y - coalesce(gy, 0) AS y FROM h LEFT JOIN g ON g.id = h.id), p AS (SELECT id, 0.5::DOUBLE * x - 0.3::DOUBLE * y AS a, -0.25::DOUBLE * x + 0.2::DOUBLE * y AS b, 0.1::DOUBLE * x + 0.4::DOUBLE * y AS c FROM d), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM p) SELECT id, round(CASE WHEN l > 0 THEN greatest(a / l, 0) ELSE 0 END, 6) AS h0, round(CASE WHEN l > 0 THEN greatest(b / l, 0) ELSE 0 END, 6) AS h1, round(CASE WHEN l > 0 THEN greatest(c / l, 0) ELSE 0 END, 6) AS h2 FROM n"

RISK = "1 / (1 + exp(-(4 * ({terms})::DOUBLE - 2)))"
LINK = RISK.format(terms="CASE WHEN error_rate > 0.01 THEN 0.3 ELSE 0 END + CASE WHEN error_rate > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN utilization_in > 80 THEN 0.2 ELSE 0 END + CASE WHEN utilization_in > 95 THEN 0.2 ELSE 0 END")
NODE = RISK.format(terms="CASE WHEN degree > 2 * (SELECT avg(degree) FROM deg) THEN 0.2 ELSE 0 END + CASE WHEN utilization > 70 THEN 0.3 ELSE 0 END + CASE WHEN b > 0.3 THEN 0.2 ELSE 0 END")

SQL = {
    "degree_outliers": f"WITH {TRADE}, z AS (SELECT id, degree, (degree - (SELECT avg(degree) FROM deg)) / (SELECT stddev_pop(degree) FROM deg) AS z FROM deg) SELECT id, degree, round(z, 6) AS z, round(0.1::DOUBLE * abs(z), 6) AS score FROM z WHERE abs(z) > 2",
    "top_k_degree_subgraph": f"WITH {TRADE}, t AS (SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 10) SELECT t.id, t.degree AS whole_degree, count(x.id) AS degree_inside FROM t LEFT JOIN arcs ON a = t.id LEFT JOIN t x ON x.id = b GROUP BY 1, 2",
    "lww_merge": "SELECT l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_shipdate DESC, l_quantity DESC) = 1",
    "attribute_subgraph": f"WITH {SITE}, k AS (SELECT id FROM nodes WHERE type IN ('switch', 'router')) SELECT k.id, count(x.id) AS degree FROM k LEFT JOIN arcs ON a = k.id LEFT JOIN k x ON x.id = b GROUP BY 1",
    "graph_summary": f"WITH {TRADE} SELECT count(*) AS nodes, (SELECT count(*) FROM pairs) AS edges, round(2.0::DOUBLE * (SELECT count(*) FROM pairs) / (count(*) * (count(*) - 1)), 9) AS density, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree FROM deg",
    "directed_neighbors": f"WITH {FLOW} SELECT src AS id, count(*) AS successors FROM e GROUP BY 1",
    "undirected_merge": f"WITH {FLOW} SELECT src, dst FROM u",
    "isolates": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)",
    "connected_components": "WITH j AS (SELECT 'r' || n_regionkey AS g, 'r' || n_regionkey AS id FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, min(id) OVER (PARTITION BY g) AS component FROM j",
    "articulation_points": f"WITH RECURSIVE {SITE}{WITHOUT} SELECT v AS id FROM meets JOIN deg ON deg.id = v GROUP BY v, degree HAVING count(*) < degree * degree",
    "bridges": f"WITH RECURSIVE {SITE}{CUT_EDGES} SELECT src, dst FROM cut_edges",
    "blast_radius": f"""WITH RECURSIVE {SITE}{HOPS}{WITHOUT}, t AS (SELECT CAST(count(*) AS BIGINT) AS t FROM nodes),
b AS (SELECT d.id, degree AS direct, t, (SELECT count(*) FROM pieces p WHERE p.v = d.id) AS k,
  greatest(coalesce((SELECT max(n) FROM pieces p WHERE p.v = d.id), 0), coalesce((SELECT max(n) FROM sizes s WHERE s.comp <> c.comp), 0)) AS top,
  coalesce((SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM pieces p WHERE p.v = d.id), 0) + coalesce((SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM sizes s WHERE s.comp <> c.comp), 0) AS pairs
  FROM deg d JOIN comps c ON c.id = d.id, t),
x AS (SELECT id, direct, CASE WHEN k > 1 THEN t - 1 - top ELSE 0 END AS indirect, (1 - pairs / (t * (t - 1) / 2.0::DOUBLE)) * 100 AS loss, k - 1 AS inc, t FROM b)
SELECT id, direct, CAST(indirect AS BIGINT) AS indirect, CAST(direct + indirect AS BIGINT) AS total_affected, round(loss, 6) AS connectivity_loss, CAST(inc AS BIGINT) AS component_increase, {SEVERITY.format(a='(direct + indirect)', t='t', l='loss')} AS severity FROM x""",
    "blast_edges": f"""WITH RECURSIVE {SITE}{HOPS}{CUT_EDGES}, t AS (SELECT CAST(count(*) AS BIGINT) AS t FROM nodes),
x AS (SELECT e.src, e.dst, k.n IS NOT NULL AS is_bridge, t, CASE WHEN k.n IS NULL THEN 0 ELSE t - greatest(k.n, s.n - k.n, coalesce((SELECT max(o.n) FROM sizes o WHERE o.comp <> c.comp), 0)) END AS i
  FROM edges e JOIN comps c ON c.id = e.src JOIN sizes s ON s.comp = c.comp LEFT JOIN cut_edges k ON k.src = e.src AND k.dst = e.dst, t)
SELECT src, dst, is_bridge, CAST(i AS BIGINT) AS indirect, {SEVERITY.format(a='i', t='t', l='0')} AS severity FROM x""",
    "redundancy_score": f"""WITH RECURSIVE {SITE}{WITHOUT}, x AS (SELECT d.id, degree * (degree - 1) // 2 AS pairs, (SELECT count(*) FROM meets m WHERE m.v = d.id AND m.s < m.t) AS alt, (SELECT count(*) FROM meets m WHERE m.v = d.id) < degree * degree AS spof FROM deg d),
y AS (SELECT *, CASE WHEN pairs > 0 THEN CAST(alt AS DOUBLE) / pairs ELSE 0 END AS score FROM x)
SELECT id, round(score, 6) AS score, CAST(alt AS BIGINT) AS alternate_paths, spof AS is_spof, CASE WHEN round(score, 6) >= 0.9 THEN 'A' WHEN round(score, 6) >= 0.8 THEN 'B' WHEN round(score, 6) >= 0.6 THEN 'C' WHEN round(score, 6) >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM y""",
    "resilience": f"WITH RECURSIVE {SITE}{WITHOUT}{CUT_EDGES}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM edges) SELECT round(1 - (SELECT count(*) FROM (SELECT v FROM meets JOIN deg ON deg.id = v GROUP BY v, degree HAVING count(*) < degree * degree)) / n, 6) AS node_redundancy, round(1 - (SELECT count(*) FROM cut_edges) / m, 6) AS link_redundancy, round(least(2 * m / n / 4, 1), 6) AS degree_score FROM n, m",
    "k_hop": f"WITH RECURSIVE {SITE}{HOPS} SELECT id, hop FROM hops WHERE source = 'r0' AND hop <= 3",
    "critical_path": f"WITH RECURSIVE {SITE}{HOPS} SELECT x.id FROM hops x JOIN hops y ON x.id = y.id JOIN hops z ON z.source = 'r0' AND z.id = 'r4' WHERE x.source = 'r0' AND y.source = 'r4' AND x.hop + y.hop = z.hop",
    "all_pairs_hops": f"WITH RECURSIVE {SITE}{HOPS} SELECT source, id, hop FROM hops",
    "closeness": f"WITH RECURSIVE {SITE}{HOPS}, c AS (SELECT source AS id, count(*) - 1 AS r, CAST(sum(hop) AS DOUBLE) AS t FROM hops GROUP BY 1) SELECT id, round(CASE WHEN t > 0 THEN r / t * (r / CAST((SELECT count(*) - 1 FROM nodes) AS DOUBLE)) ELSE 0 END, 6) AS closeness FROM c",
    "triangles_clustering": f"WITH {FLOW}, e2 AS (SELECT * FROM u WHERE src <> dst), a AS (SELECT src AS a, dst AS b FROM e2 UNION ALL SELECT dst, src FROM e2), k AS (SELECT 'n' || n_nationkey AS id, count(b) AS k FROM nation LEFT JOIN a ON a.a = 'n' || n_nationkey GROUP BY 1), t AS (SELECT x.a AS id, count(*) AS t FROM a x JOIN a y ON x.a = y.a AND x.b < y.b JOIN e2 ON e2.src = x.b AND e2.dst = y.b GROUP BY 1) SELECT k.id, coalesce(t, 0) AS triangles, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / CAST(k * (k - 1) AS DOUBLE) ELSE 0 END, 6) AS clustering FROM k LEFT JOIN t ON t.id = k.id",
    "redundant_paths": f"WITH {SITE}{SLA} SELECT e.src, e.dst, r.src IS NOT NULL AS redundant FROM edges e LEFT JOIN red r ON e.src = r.src AND e.dst = r.dst",
    "betweenness": f"WITH RECURSIVE {SITE}{BETWEEN} SELECT id, round(b, 6) AS betweenness FROM bt",
    "edge_betweenness": f"WITH RECURSIVE {SITE}{HOPS}{PATHS}, f AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, x.s * y.s / z.s AS v FROM arcs JOIN sigma x ON x.id = a JOIN sigma y ON y.source = b JOIN sigma z ON z.source = x.source AND z.id = y.id AND z.hop = x.hop + 1 + y.hop) SELECT src, dst, round(sum(v) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS betweenness FROM f GROUP BY 1, 2",
    "degree_centrality": f"WITH {TRADE} SELECT id, round(degree / CAST((SELECT count(*) - 1 FROM deg) AS DOUBLE), 6) AS degree_centrality FROM deg",
    "pagerank": _pr(10),
    "high_centrality": f"WITH {SITE} SELECT id, round(degree / CAST((SELECT count(*) - 1 FROM deg) AS DOUBLE), 6) AS value FROM deg ORDER BY degree DESC, id LIMIT 10",
    "normalized_adjacency": f"WITH {SITE}{ADJ} SELECT a, b, round(v, 8) AS v FROM adj",
    "node_features": f"WITH {SITE}, t AS (SELECT x.a AS id, count(*) AS t FROM arcs x JOIN arcs y ON x.a = y.a AND x.b < y.b JOIN arcs z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT n.id, CAST(degree AS DOUBLE) AS degree, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / CAST(degree * (degree - 1) AS DOUBLE) ELSE 0 END, 6) AS clustering, CASE WHEN type = 'router' THEN 1.0::DOUBLE ELSE 0 END AS is_router, CASE WHEN cap = 'Bridge' THEN 1.0::DOUBLE ELSE 0 END AS is_switch, 0.0::DOUBLE AS interface_count, 0.0::DOUBLE AS error_rate, round(utilization, 6) AS utilization FROM nodes n JOIN deg ON deg.id = n.id LEFT JOIN t ON t.id = n.id",
    "edge_features": f"WITH {SITE} SELECT src, dst, CAST(speed_mbps AS DOUBLE) AS speed, round(utilization_in, 6) AS utilization_in, 0.0::DOUBLE AS utilization_out, round(error_rate, 6) AS error_rate, CASE WHEN protocol = 'ospf' THEN 1.0::DOUBLE ELSE 0 END AS is_ospf, CASE WHEN protocol = 'bgp' THEN 1.0::DOUBLE ELSE 0 END AS is_bgp, CASE WHEN protocol = 'static' THEN 1.0::DOUBLE ELSE 0 END AS is_static, 0.0::DOUBLE AS is_eigrp, 1.0::DOUBLE AS weight FROM edges",
    "znorm": f"WITH {TRADE} SELECT id, round((degree - (SELECT avg(degree) FROM deg)) / (SELECT stddev_pop(degree) FROM deg), 6) AS degree FROM deg",
    "gcn_forward": f"WITH {SITE}{ADJ}{H}, s AS (SELECT adj.a AS id, sum(v * x) AS x, sum(v * y) AS y FROM adj JOIN h ON h.id = adj.b GROUP BY 1) SELECT id, round(greatest(0.5::DOUBLE * x - 0.3::DOUBLE * y + 0.01::DOUBLE, 0), 6) AS h0, round(greatest(-0.25::DOUBLE * x + 0.2::DOUBLE * y + 0.02::DOUBLE, 0), 6) AS h1, round(greatest(0.1::DOUBLE * x + 0.4::DOUBLE * y + 0.03::DOUBLE, 0), 6) AS h2 FROM s",
    "sage_mean": f"WITH {SITE}{H}, g AS (SELECT a AS id, avg(x) AS gx, avg(y) AS gy FROM arcs JOIN h ON h.id = b GROUP BY 1), d AS (SELECT h.id, x - coalesce(gx, 0) AS x, y - coalesce(gy, 0) AS y FROM h LEFT JOIN g ON g.id = h.id), p AS (SELECT id, 0.5::DOUBLE * x - 0.3::DOUBLE * y AS a, -0.25::DOUBLE * x + 0.2::DOUBLE * y AS b, 0.1::DOUBLE * x + 0.4::DOUBLE * y AS c FROM d), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM p) SELECT id, round(CASE WHEN l > 0 THEN greatest(a / l, 0) ELSE 0 END, 6) AS h0, round(CASE WHEN l > 0 THEN greatest(b / l, 0) ELSE 0 END, 6) AS h1, round(CASE WHEN l > 0 THEN greatest(c / l, 0) ELSE 0 END, 6) AS h2 FROM n",
    "gat_attention": f"WITH {SITE}{H}, z AS (SELECT id, 0.5::DOUBLE * x - 0.3::DOUBLE * y AS p, -0.25::DOUBLE * x + 0.2::DOUBLE * y AS q, 0.1::DOUBLE * x + 0.4::DOUBLE * y AS r FROM h), t AS (SELECT id, 0.3::DOUBLE * p - 0.2::DOUBLE * q + 0.1::DOUBLE * r AS t, 0.1::DOUBLE * p + 0.25::DOUBLE * q - 0.3::DOUBLE * r AS o FROM z), k AS (SELECT a, b FROM arcs UNION SELECT id, id FROM nodes), s AS (SELECT a, b, exp(CASE WHEN x.t + y.o > 0 THEN x.t + y.o ELSE 0.2::DOUBLE * (x.t + y.o) END) AS e FROM k JOIN t x ON x.id = a JOIN t y ON y.id = b) SELECT a, b, round(e / sum(e) OVER (PARTITION BY a), 6) AS alpha FROM s",
    "recon_scores": "WITH p AS (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst, embedding AS x FROM embeddings) SELECT src, dst, round(1 - 1 / (1 + exp(-list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))))), 6) AS error FROM p JOIN embeddings e ON e.vec_id = p.dst",
    "recon_node_scores": "WITH p AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), k AS (SELECT a, b FROM p WHERE b IS NOT NULL UNION SELECT b, a FROM p WHERE b IS NOT NULL), s AS (SELECT x.vec_id AS a, y.vec_id AS b, 1 / (1 + exp(-list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: CAST(x.embedding[i] AS DOUBLE) * CAST(y.embedding[i] AS DOUBLE))))) AS p FROM embeddings x CROSS JOIN embeddings y) SELECT s.a AS id, round(avg(CASE WHEN k.a IS NULL THEN p ELSE 1 - p END), 6) AS score FROM s LEFT JOIN k ON k.a = s.a AND k.b = s.b GROUP BY 1",
    "structural_anomalies": f"WITH RECURSIVE {SITE}{WITHOUT}, z AS (SELECT id, (degree - (SELECT avg(degree) FROM deg)) / (SELECT stddev_pop(degree) FROM deg) AS z FROM deg), c AS (SELECT v FROM meets JOIN deg ON deg.id = v GROUP BY v, degree HAVING count(*) < degree * degree), s AS (SELECT id, (CASE WHEN abs(z) > 2 THEN 0.1::DOUBLE * abs(z) ELSE 0 END) + (CASE WHEN c.v IS NULL THEN 0 ELSE 0.3::DOUBLE END) AS score FROM z LEFT JOIN c ON c.v = id), q AS (SELECT quantile_cont(score, 0.95) AS t FROM s) SELECT id, round(score, 6) AS score, round(t, 6) AS threshold FROM s, q WHERE score > t",
    "counter_deltas": "WITH m AS (SELECT l_suppkey AS device, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT device, month, q AS in_bytes_delta, r AS in_errors_delta, n AS in_packets_delta FROM m QUALIFY row_number() OVER (PARTITION BY device ORDER BY month) > 1",
    "interface_annotate": f"WITH {STATES} SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, oper_status, 100 AS speed_mbps, round(least(i / 1e8 * 100, 100), 6) AS utilization_in, round(CASE WHEN packets = 0 THEN 0 ELSE errors / CAST(packets AS DOUBLE) END, 8) AS error_rate FROM supplier JOIN st ON device = 's' || s_suppkey",
    "utilization_error_rate": f"WITH {STATES} SELECT device, oper_status = 'up' AS is_up, round(least(i / 1e8 * 100, 100), 6) AS utilization_in, round(least(o / 1e8 * 100, 100), 6) AS utilization_out, round(CASE WHEN packets = 0 THEN 0 ELSE errors / CAST(packets AS DOUBLE) END, 8) AS error_rate FROM st",
    "device_summary": f"WITH {STATES} SELECT device, count(*) FILTER (oper_status = 'up') AS up_count, count(*) FILTER (oper_status <> 'up') AS down_count, CAST(sum(errors) AS BIGINT) AS total_errors FROM st GROUP BY 1",
    "metric_trend": f"WITH {METRICS} SELECT user_id, round(util_trend, 6) AS trend, n FROM trend",
    "link_risk": f"""WITH {METRICS}, x AS (SELECT CAST(user_id AS VARCHAR) AS dst, errors AS e, util AS u, error_trend AS t FROM now JOIN trend USING (user_id)),
y AS (SELECT *, (CASE WHEN e > 0.01 THEN 0.3 ELSE 0 END + CASE WHEN e > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN u > 80 THEN 0.2 ELSE 0 END + CASE WHEN u > 95 THEN 0.2 ELSE 0 END)::DOUBLE + CASE WHEN t > 0 THEN least(t * 10, 0.3) ELSE 0 END AS risk,
  CAST(e > 0.01 AS BIGINT) + CAST(e > 0.05 AS BIGINT) + CAST(u > 80 AS BIGINT) + CAST(u > 95 AS BIGINT) + CAST(t > 0 AS BIGINT) AS factors FROM x), z AS (SELECT *, 1 / (1 + exp(-(4 * risk - 2))) AS p FROM y)
SELECT dst, round(risk, 6) AS risk, round(p, 6) AS probability, {_level('p')} AS risk_level, round(CASE WHEN p > 0.1 THEN greatest(24 * (1 - p), 1) END, 6) AS hours, factors FROM z""",
    "node_overload": f"WITH RECURSIVE {SITE}{BETWEEN}, p AS (SELECT n.id, 1 / (1 + exp(-(4 * (CASE WHEN degree > 2 * (SELECT avg(degree) FROM deg) THEN 0.2 ELSE 0 END + CASE WHEN utilization > 70 THEN 0.3 ELSE 0 END + CASE WHEN b > 0.3 THEN 0.2 ELSE 0 END)::DOUBLE - 2))) AS p FROM nodes n JOIN deg ON deg.id = n.id JOIN bt ON bt.id = n.id) SELECT id, round(p, 6) AS probability, {_level('p')} AS risk_level FROM p WHERE p > 0.05",
    "capacity": f"WITH {METRICS}, x AS (SELECT CAST(user_id AS VARCHAR) AS dst, util AS u, (100 - util) / (util_trend * 12) AS h FROM now JOIN trend USING (user_id) WHERE util_trend > 0 AND util > 50) SELECT dst, round(least(u / 100, 0.99), 6) AS probability, {_level('(u / 100)')} AS risk_level, round(h, 4) AS hours FROM x WHERE h < 168",
    "sla_risk": f"WITH {SITE}{SLA} SELECT src, dst, round(p, 6) AS probability, {_level('p')} AS risk_level FROM sla WHERE p > 0.1",
    "prediction_summary": f"""WITH {SITE}{SLA}, l AS (SELECT 1 / (1 + exp(-(4 * (CASE WHEN error_rate > 0.01 THEN 0.3 ELSE 0 END + CASE WHEN error_rate > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN utilization_in > 80 THEN 0.2 ELSE 0 END + CASE WHEN utilization_in > 95 THEN 0.2 ELSE 0 END)::DOUBLE - 2))) AS p FROM edges),
a AS (SELECT {_level('p')} AS r FROM l UNION ALL SELECT {_level('p')} FROM sla WHERE p > 0.1), c AS (SELECT count(*) AS total, count(*) FILTER (r = 'critical') AS critical, count(*) FILTER (r = 'high') AS high FROM a)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM c""",
    "snapshot_diff": f"WITH {DAILY} SELECT seq, kind, count(*) AS edges FROM ed JOIN seqs USING (place) WHERE kind IS NOT NULL AND place > 1 GROUP BY 1, 2",
    "change_magnitude": f"WITH {DAILY} SELECT seq, nodes_added, nodes_removed, edges_added, edges_removed, magnitude, magnitude = 0 AS is_stable FROM mag",
    "temporal_zscore": f"WITH {DAILY} SELECT seq, round(m, 6) AS window_mean, round(s, 6) AS window_std, round(CASE WHEN s > 0 THEN (magnitude - m) / s ELSE 0 END, 6) AS z FROM zs",
    "temporal_events": f"WITH {DAILY} SELECT seq, 'sudden_change' AS event FROM zs WHERE s > 0 AND (magnitude - m) / s > 2 UNION ALL SELECT seq, 'node_disappearance' FROM zs WHERE nodes_removed > 0 UNION ALL SELECT seq, 'new_nodes' FROM zs WHERE nodes_added > 0",
    "evolution_stats": f"""WITH {DAILY}, k AS (SELECT seq, (SELECT count(*) FROM nodes x WHERE x.seq = s.seq) AS n, (SELECT count(*) FROM edges x WHERE x.seq = s.seq) AS m FROM seqs s)
SELECT count(*) AS snapshots, arg_min(n, seq) AS first_nodes, arg_max(n, seq) AS last_nodes, arg_min(m, seq) AS first_edges, arg_max(m, seq) AS last_edges, min(n) AS min_nodes, max(n) AS max_nodes, round(avg(n), 6) AS mean_nodes, round(avg(m), 6) AS mean_edges,
 (SELECT CAST(sum(magnitude) AS BIGINT) FROM mag) AS total_change, (SELECT round(avg(magnitude), 6) FROM mag) AS mean_change, (SELECT max(magnitude) FROM mag) AS max_change, (SELECT count(*) FROM mag WHERE magnitude = 0) AS stable FROM k""",
    "adjacency_tensor": f"WITH {DAILY}, ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT DISTINCT id FROM nodes)), c AS (SELECT CAST(place - 1 AS INTEGER) AS t, x.i AS i, y.i AS j FROM pe JOIN ix x ON x.id = src JOIN ix y ON y.id = dst), b AS (SELECT * FROM c UNION ALL SELECT t, j, i FROM c) SELECT t, count(*) AS cells, CAST(sum(i) AS BIGINT) AS sum_i, CAST(sum(i * j) AS BIGINT) AS sum_ij FROM b GROUP BY 1",
    "snapshot_window": f"WITH {DAILY} SELECT seq, count(*) AS edges FROM pe WHERE place > (SELECT max(place) - 5 FROM seqs) GROUP BY 1",
    "d3_nodes": f"WITH {SITE} SELECT id, row_number() OVER (ORDER BY id) - 1 AS \"index\", type, CASE WHEN type = 'router' THEN 'router' WHEN type = 'switch' THEN 'switch' ELSE 'other' END AS \"group\" FROM nodes",
    "d3_links": f"WITH {SITE}, ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes) SELECT x.i AS source, y.i AS target, protocol, speed_mbps FROM edges JOIN ix x ON x.id = src JOIN ix y ON y.id = dst",
    "mermaid_lines": f"WITH {SITE} SELECT 0 AS part, row_number() OVER (ORDER BY id) - 1 AS place, '    ' || id || CASE type WHEN 'router' THEN '{{' || id || '}}' WHEN 'switch' THEN '[' || id || ']' ELSE '(' || id || ')' END AS line FROM nodes UNION ALL SELECT 1, row_number() OVER (ORDER BY src, dst) - 1, '    ' || src || ' -- \"' || protocol || '\" --- ' || dst FROM edges",
    "device_group": f"WITH {SITE} SELECT CASE WHEN type = 'router' THEN 'router' WHEN type = 'switch' THEN 'switch' ELSE 'other' END AS device_group, count(*) AS devices FROM nodes GROUP BY 1",
    "parse_lldp": f"WITH {LINES}, y AS (SELECT *, device || ':xe-' || k AS p, 's' || supp || '.example.org:p' || part AS q FROM x WHERE qty <> 50) SELECT device AS local_device, 'xe-' || k AS local_port, 's' || supp || '.example.org' AS remote_device, 'p' || part AS remote_port, 'rack ' || qty AS remote_system_description, CASE WHEN f THEN net || '.' || k ELSE '' END AS remote_mgmt_address, CASE WHEN r THEN 'Bridge,Router' WHEN a THEN 'Telephone' ELSE '' END AS capabilities, qty + 60 AS ttl, substr(sha256(least(p, q) || ':' || greatest(p, q)), 1, 16) AS edge_id FROM y",
    "parse_cdp": f"WITH {LINES} SELECT device AS local_device, 'Te1/' || k AS local_port, 's' || supp AS remote_device, 'Te2/' || qty AS remote_port, 'box ' || part AS platform, net || '.' || k AS remote_mgmt_address, 'Router' AS capabilities, 120 AS ttl, 'cdp' AS protocol FROM x",
    "parse_snmp": f"WITH {LINES}, y AS (SELECT *, CASE WHEN r THEN supp ELSE qty END * CAST(1000000 AS BIGINT) AS speed FROM x) SELECT device, k AS if_index, CASE WHEN f THEN 'xe-' || k ELSE 'port ' || k END AS name, 'port ' || k AS description, CASE WHEN a THEN 'down' ELSE 'up' END AS admin_status, CASE WHEN f THEN 'up' ELSE 'testing' END AS oper_status, speed, part * 100 AS in_octets, part * 50 AS out_octets, round(CASE WHEN speed <= 0 THEN 0 ELSE least(part * 150 * 8 / CAST(speed AS DOUBLE), 1) END, 9) AS utilization FROM y",
    "parse_snmp_system": f"WITH {LINES} SELECT device, device || '.example' AS hostname, 'software of ' || device AS sys_descr, '' AS sys_object_id, count(*) * 100 AS sys_uptime, '' AS sys_contact, '' AS sys_location FROM x GROUP BY 1",
    "parse_snmp_neighbors": f"WITH {LINES} SELECT device, 's' || supp AS system_name, 'p' || part AS port_id, '' AS port_desc FROM x",
    "parse_ios_routes": f"WITH {LINES}{IOS} SELECT source_router, network, protocol, next_hop, next_hop_interface, metric, admin_distance FROM routes",
    "parse_ios_routes_compat": f"""WITH {LINES}, c AS (SELECT *, CAST(part % 8 AS INTEGER) AS c, CASE WHEN r THEN NULL ELSE supp % 8 + 17 END AS own FROM x WHERE part % 8 NOT IN (4, 7)),
m AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY device ORDER BY k ROWS UNBOUNDED PRECEDING), 8) AS mask FROM c)
SELECT device AS source_router, net || '.0/' || mask AS network, ['connected', 'S*', 'ospf', 'O IA', '', 'bgp', 'D EX'][c + 1] AS protocol, CASE WHEN c = 0 THEN '' ELSE '10.0.' || (supp % 250) || '.1' END AS next_hop, CASE WHEN c = 0 THEN '' ELSE 'Te1/' || k END AS next_hop_interface, CAST(CASE WHEN c = 0 THEN 0 ELSE part END AS INTEGER) AS metric, CASE WHEN c = 0 THEN 0 ELSE qty + 10 END AS admin_distance FROM m
UNION ALL SELECT DISTINCT device, '10.0.0.0/8', '', '', '', 0, 0 FROM x""",
    "parse_junos": f"WITH {LINES} SELECT device AS source_router, net || '.0/' || (supp % 8 + 17) AS network, ['ospf', 'bgp', 'static'][CAST(part % 3 AS INTEGER) + 1] AS protocol, CASE WHEN f THEN '' ELSE '10.1.' || (supp % 250) || '.1' END AS next_hop, 'ge-0/0/' || k || '.0' AS next_hop_interface, qty AS metric FROM x",
    "protocol_summary": f"WITH {LINES}{IOS} SELECT protocol, count(*) AS routes FROM routes GROUP BY 1",
    "parse_interfaces": f"""WITH {LINES}, h AS (SELECT *, '00a0.' || lpad(lower(to_hex(part % 65536)), 4, '0') || '.' || lpad(lower(to_hex(supp % 65536)), 4, '0') AS mac FROM x)
SELECT device, 'Ethernet1/' || k AS name, CASE WHEN r THEN 'down' ELSE 'up' END AS admin_status, CASE WHEN f THEN 'up' ELSE 'down' END AS oper_status, CAST(supp * 1700 // 1000 AS INTEGER) AS speed_mbps, qty + 1400 AS mtu, net || '.' || k AS ip_address, '24' AS subnet_mask, mac AS mac_address, 'rack of s' || supp || ', row ' || k AS description, part * 7 AS in_packets, part * 5 AS out_packets, CAST(qty AS BIGINT) AS in_errors, supp AS out_errors, CAST(k AS BIGINT) AS crc_errors, CAST(qty % 3 AS BIGINT) AS collisions, CAST(part * 1000 AS DOUBLE) AS input_rate_bps, CAST(part * 300 AS DOUBLE) AS output_rate_bps FROM h""",
    "parse_json_records": f"""WITH {LINES} SELECT 'neighbor' AS kind, device AS local_device, 'e' || k AS port, 's' || supp AS name, 'p' || part AS detail, CAST(CASE WHEN r THEN 120 ELSE qty + 60 END AS BIGINT) AS number FROM x
UNION ALL SELECT 'route', device, '10.1.1.' || k, net || CASE WHEN r THEN '.0/21' ELSE '.0/20' END, CASE WHEN r THEN 'static' ELSE 'ospf' END, CAST(CASE WHEN r THEN qty ELSE qty * 100 END AS BIGINT) FROM x
UNION ALL SELECT 'interface', device, 'e' || k, CASE WHEN r THEN 'up' ELSE 'down' END, CAST(supp AS VARCHAR), CAST(CASE WHEN r THEN qty ELSE part * 100 END AS BIGINT) FROM x""",
    "routing_graph": f"WITH {LINES}{IOS} SELECT source_router AS src, next_hop AS dst, network AS prefix, protocol, metric, next_hop_interface AS interface FROM routes WHERE next_hop <> '' QUALIFY row_number() OVER (PARTITION BY source_router, next_hop ORDER BY k DESC) = 1",
    "routing_graph_nodes": f"WITH {LINES}{IOS} SELECT DISTINCT source_router AS id, 'router' AS type FROM routes UNION SELECT DISTINCT next_hop, 'next_hop' FROM routes WHERE next_hop <> ''",
    "neighbor_graph": f"WITH {LINES} SELECT device AS src, 's' || supp || '.example.org' AS dst, 'xe-' || k AS local_port, 'p' || part AS remote_port, 'lldp' AS protocol, qty + 60 AS ttl FROM x WHERE qty <> 50 QUALIFY row_number() OVER (PARTITION BY device, supp ORDER BY k DESC) = 1",
    "neighbor_graph_nodes": f"WITH {LINES}, e AS (SELECT DISTINCT device, 's' || supp || '.example.org' AS s FROM x WHERE qty <> 50) SELECT device AS id, count(*) AS degree FROM e GROUP BY 1 UNION ALL SELECT s, count(*) FROM e GROUP BY 1",
    "snmp_graph": f"WITH {LINES} SELECT device || '.example' AS src, 's' || supp AS dst, 'p' || part AS remote_port, 'lldp-mib' AS protocol FROM x QUALIFY row_number() OVER (PARTITION BY device, supp ORDER BY '0.' || k || '.1' DESC) = 1",
    "snmp_graph_nodes": f"WITH {LINES} SELECT device || '.example' AS id, 'network_device' AS type, count(*) * 100 AS uptime, count(*) AS interface_count FROM x GROUP BY 1 UNION ALL SELECT DISTINCT 's' || supp, 'network_device', -1, -1 FROM x",
    "node_link_round_trip": f"WITH {SITE} SELECT src, dst, type, protocol, speed_mbps, round(utilization_in, 6) AS utilization_in, round(error_rate, 6) AS error_rate FROM edges JOIN nodes ON id = dst",
    "what_if": f"""WITH RECURSIVE {SITE}, st AS (SELECT unnest(range(0, 5)) AS s),
ng AS (SELECT s, id FROM st, nodes WHERE NOT (s >= 1 AND id = 'n0') AND NOT (s >= 3 AND id = 'r2')),
eg AS (SELECT st.s, src, dst FROM st, edges WHERE NOT (s >= 2 AND src = 'n1' AND dst = 'r1') AND NOT (s >= 1 AND 'n0' IN (src, dst)) AND NOT (s >= 3 AND 'r2' IN (src, dst))),
ag AS (SELECT s, src AS a, dst AS b FROM eg UNION ALL SELECT s, dst, src FROM eg),
reach(s, source, id) AS (SELECT s, id, id FROM ng UNION SELECT reach.s, source, b FROM reach JOIN ag ON ag.s = reach.s AND ag.a = reach.id),
parts AS (SELECT s, count(DISTINCT comp) AS components FROM (SELECT s, source, min(id) AS comp FROM reach GROUP BY 1, 2) GROUP BY 1),
cn AS (SELECT s, count(*) AS n FROM ng GROUP BY 1), ce AS (SELECT s, count(*) AS m FROM eg GROUP BY 1),
alone AS (SELECT ng.s, count(*) FILTER (ag.a IS NULL) AS isolated FROM ng LEFT JOIN ag ON ag.s = ng.s AND ag.a = ng.id GROUP BY 1)
SELECT parts.s AS step, x.n AS before_nodes, y.m AS before_edges, cn.n AS after_nodes, ce.m AS after_edges, components, isolated, components > 1 AS network_partitioned
FROM parts JOIN cn USING (s) JOIN ce USING (s) JOIN alone USING (s) JOIN cn x ON x.s = parts.s - 1 JOIN ce y ON y.s = parts.s - 1""",
    "redundancy_way_round": f"""WITH RECURSIVE {SITE}{WITHOUT},
walk(v, s, id, hop) AS (SELECT a, b, b, 0 FROM arcs UNION SELECT v, s, b, hop + 1 FROM walk JOIN arcs ON id = a WHERE b <> v AND hop < 14),
way AS (SELECT w.v, min(hop) AS way FROM walk w JOIN arcs k ON k.a = w.v AND k.b = w.id WHERE w.id <> w.s GROUP BY 1),
x AS (SELECT d.id, degree, degree * (degree - 1) // 2 AS pairs, (SELECT count(*) FROM meets m WHERE m.v = d.id AND m.s < m.t) AS alt, (SELECT count(*) FROM meets m WHERE m.v = d.id) < degree * degree AS spof FROM deg d)
SELECT id, CAST(coalesce(way, 0) AS BIGINT) AS min_path_length, CASE WHEN degree = 0 THEN 'Isolated node' ELSE CASE WHEN spof THEN 'SPOF' ELSE 'Redundant' END || ' — ' || alt || '/' || pairs || ' neighbor pairs connected without node' END AS details FROM x LEFT JOIN way ON v = id""",
    "node_features_full": f"""WITH RECURSIVE {SITE}{BETWEEN}{CLOSE}{_rounds(20)}, t AS (SELECT x.a AS id, count(*) AS t FROM arcs x JOIN arcs y ON x.a = y.a AND x.b < y.b JOIN arcs z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT n.id, CAST(degree AS DOUBLE) AS degree, round(b, 6) AS betweenness, round(closeness, 6) AS closeness, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / CAST(degree * (degree - 1) AS DOUBLE) ELSE 0 END, 6) AS clustering, round(p20.r, 6) AS pagerank,
CASE WHEN type = 'router' THEN 1.0::DOUBLE ELSE 0 END AS is_router, CASE WHEN cap = 'Bridge' THEN 1.0::DOUBLE ELSE 0 END AS is_switch, 0.0::DOUBLE AS interface_count, 0.0::DOUBLE AS error_rate, round(utilization, 6) AS utilization
FROM nodes n JOIN deg ON deg.id = n.id JOIN bt ON bt.id = n.id JOIN close ON close.id = n.id JOIN p20 ON p20.id = n.id LEFT JOIN t ON t.id = n.id""",
    "pagerank_settled": f"WITH {TRADE}{_settled('ranks', 80)} SELECT id, round(r, 8) AS pagerank FROM ranks",
    "high_centrality_graphs": f"""WITH RECURSIVE {SITE}{BETWEEN}{CLOSE}{_settled('ranks', 80)},
m AS (SELECT 'betweenness' AS metric, id, b AS v FROM bt UNION ALL SELECT 'closeness', id, closeness FROM close UNION ALL SELECT 'degree', id, CAST(degree AS DOUBLE) / 1e4 FROM deg UNION ALL SELECT 'pagerank', id, r FROM ranks),
top AS (SELECT metric, id FROM m QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(v, 12) DESC, id) <= 10)
SELECT top.metric, top.id, count(y.id) AS degree_inside FROM top LEFT JOIN arcs ON a = top.id LEFT JOIN top y ON y.id = b AND y.metric = top.metric GROUP BY 1, 2""",
    "attribute_equals": f"WITH {SITE}, k AS (SELECT id, CASE WHEN type = 'router' THEN 'none' ELSE type END AS type FROM nodes) SELECT x.type, x.id, count(y.id) AS degree FROM k x LEFT JOIN arcs ON a = x.id LEFT JOIN k y ON y.id = b AND y.type = x.type GROUP BY 1, 2",
    "isolates_of_bulk_orders": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45 AND l_returnflag = 'R')",
    "sage_sum": SAGE.format(site=SITE, h=H, how="sum"),
    "sage_max": SAGE.format(site=SITE, h=H, how="max"),
    "gat_forward": f"WITH {SITE}{H}, z AS (SELECT id, 0.5::DOUBLE * x - 0.3::DOUBLE * y AS p, -0.25::DOUBLE * x + 0.2::DOUBLE * y AS q, 0.1::DOUBLE * x + 0.4::DOUBLE * y AS r FROM h), t AS (SELECT id, 0.3::DOUBLE * p - 0.2::DOUBLE * q + 0.1::DOUBLE * r AS t, 0.1::DOUBLE * p + 0.25::DOUBLE * q - 0.3::DOUBLE * r AS o FROM z), k AS (SELECT a, b FROM arcs UNION SELECT id, id FROM nodes), s AS (SELECT a, b, exp(CASE WHEN x.t + y.o > 0 THEN x.t + y.o ELSE 0.2::DOUBLE * (x.t + y.o) END) AS e FROM k JOIN t x ON x.id = a JOIN t y ON y.id = b), w AS (SELECT a, b, e / sum(e) OVER (PARTITION BY a) AS alpha FROM s) SELECT a AS id, round(sum(alpha * p), 6) AS h0, round(sum(alpha * q), 6) AS h1, round(sum(alpha * r), 6) AS h2 FROM w JOIN z ON z.id = b GROUP BY 1",
    "observation_history": f"WITH {SITE} SELECT 3 AS seq, 5.0::DOUBLE AS ts, 'node' AS entity_type, id AS u, '' AS v, 'util' AS metric, round(utilization, 6) AS value FROM nodes UNION ALL SELECT 3, 5.0, 'edge', src, dst, 'errors', round(error_rate, 6) FROM edges UNION ALL SELECT 3, 5.0, 'edge', src, dst, 'util_in', round(utilization_in, 6) FROM edges",
    "prediction_lists": f"""WITH RECURSIVE {SITE}{BETWEEN}{SLA}, every AS (
SELECT 'link' AS kind, src, dst, {LINK} AS p FROM edges
UNION ALL SELECT 'node', n.id, '', {NODE} FROM nodes n JOIN deg ON deg.id = n.id JOIN bt ON bt.id = n.id
UNION ALL SELECT 'sla', src, dst, p FROM sla WHERE p > 0.1
UNION ALL SELECT 'capacity', src, dst, least(u / 100, 0.99) FROM (SELECT src, dst, utilization_in + 40 AS u, utilization_in / 50 AS t FROM edges) WHERE t > 0 AND u > 50 AND (100 - u) / (t * 12) < 168),
x AS (SELECT kind, src, dst, round(p, 6) AS probability, {_level('p')} AS risk_level FROM every)
SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY probability DESC, src, dst) AS INTEGER) AS place FROM x""",
    "prediction_summary_of_all": f"""WITH RECURSIVE {SITE}{BETWEEN}{SLA}, a AS (SELECT {LINK} AS p FROM edges UNION ALL SELECT {NODE} FROM nodes n JOIN deg ON deg.id = n.id JOIN bt ON bt.id = n.id UNION ALL SELECT p FROM sla WHERE p > 0.1),
c AS (SELECT count(*) AS total, count(*) FILTER ({_level('p')} = 'critical') AS critical, count(*) FILTER ({_level('p')} = 'high') AS high FROM a)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM c""",
    "snapshot_attributes": f"WITH {DAILY}, pw AS (SELECT *, CASE WHEN n % 3 > 0 THEN n % 2 END AS w FROM pe), ch AS (SELECT coalesce(b.place, a.place + 1) AS place, CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' WHEN a.n <> b.n OR a.w IS DISTINCT FROM b.w THEN 'modified' END AS kind FROM pw a FULL JOIN pw b ON a.src = b.src AND a.dst = b.dst AND b.place = a.place + 1) SELECT seq, kind, count(*) AS edges FROM ch JOIN seqs USING (place) WHERE kind IS NOT NULL AND place > 1 GROUP BY 1, 2",
    "time_range": "WITH e AS (SELECT event_type, floor(epoch(ts)) AS t FROM events), k AS (SELECT min(t) AS lo, floor((max(t) - min(t)) / 3) AS third FROM e) SELECT event_type, count(*) AS events FROM e, k WHERE t BETWEEN lo + third AND lo + 2 * third GROUP BY 1",
    "d3_scores": f"WITH {SITE}, ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes), z AS (SELECT id, (degree - (SELECT avg(degree) FROM deg)) / (SELECT stddev_pop(degree) FROM deg) AS z FROM deg) SELECT 'node' AS kind, i AS place, CASE WHEN abs(z) > 2 THEN round(0.1::DOUBLE * abs(z), 6) ELSE -1 END AS score FROM ix JOIN z ON z.id = ix.id UNION ALL SELECT 'link', x.i * 1000000 + y.i, CASE WHEN protocol = 'bgp' THEN round(utilization_in / 100, 6) ELSE -1 END FROM edges JOIN ix x ON x.id = src JOIN ix y ON y.id = dst",
    "demo_topology": "SELECT * FROM (VALUES ('core-1', 7::BIGINT), ('core-2', 6), ('dist-1', 4), ('dist-2', 4), ('dist-3', 4), ('dist-4', 4), ('access-1', 1), ('access-2', 1), ('access-3', 1), ('access-4', 1), ('access-5', 1), ('access-6', 1), ('access-7', 1), ('access-8', 1), ('wan-1', 2), ('wan-2', 2), ('fw-1', 1)) AS t(id, degree)",
}

SQL["critical_links"] = f"""WITH b AS ({SQL['edge_betweenness'].replace('round(sum(v) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6)', 'sum(v) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1))')}),
k AS (SELECT * FROM b ORDER BY round(betweenness, 12) DESC, src, dst LIMIT 10), x AS ({SQL['blast_edges']})
SELECT k.src, k.dst, round(betweenness, 6) AS betweenness, is_bridge, indirect, severity FROM k JOIN x ON x.src = k.src AND x.dst = k.dst"""
SQL["impact_lists"] = f"SELECT 'severe' AS list, id FROM ({SQL['blast_radius']}) WHERE severity IN ('critical', 'high') UNION ALL SELECT 'single', id FROM ({SQL['articulation_points']})"
