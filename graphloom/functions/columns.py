"""Column expressions of the domain; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values.
CAPABILITIES = ("Bridge", "Router", "Station", "Telephone", "WLAN", "Repeater")
OSPF = ("ospf", "ospf-inter-area", "ospf-external-type1", "ospf-external-type2")
EIGRP = ("eigrp", "eigrp-external")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edge_id(local_device, local_port, remote_device, remote_port) -> Column:
    """16 hex digits that name a link, the same from either end."""
    a = F.concat_ws(":", col(local_device), col(local_port))
    b = F.concat_ws(":", col(remote_device), col(remote_port))
    return F.substring(F.sha2(F.concat_ws(":", F.array_sort(F.array(a, b))), 256), 1, 16)


def network(prefix, mask) -> Column:
    return F.concat_ws("/", col(prefix), col(mask).cast("string"))


def is_up(admin, oper) -> Column:
    return (col(admin) == "up") & (col(oper) == "up")


def utilization(rate_bps, speed_mbps) -> Column:
    """Percent of the speed, 100 at most; 0 without a speed."""
    rate, speed = F.coalesce(col(rate_bps), F.lit(0.0)), F.coalesce(col(speed_mbps), F.lit(0))
    return F.when(speed <= 0, F.lit(0.0)).otherwise(F.least(rate / (speed * 1e6) * 100, F.lit(100.0)))


def error_rate(in_errors, out_errors, in_packets, out_packets) -> Column:
    zero = F.lit(0)
    errors = F.coalesce(col(in_errors), zero) + F.coalesce(col(out_errors), zero)
    packets = F.coalesce(col(in_packets), zero) + F.coalesce(col(out_packets), zero)
    return F.when(packets == 0, F.lit(0.0)).otherwise(errors / packets)


def counter_fraction(in_octets, out_octets, speed) -> Column:
    """Octets of both directions as bits over the speed, 1 at most: a fraction, unlike utilization()."""
    s = col(speed)
    return F.when(s <= 0, F.lit(0.0)).otherwise(F.least((col(in_octets) + col(out_octets)) * 8 / F.greatest(s, F.lit(1)), F.lit(1.0)))


def capabilities(text) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.filter(F.array(*[F.lit(c) for c in CAPABILITIES]), lambda c: F.contains(low, F.lower(c)))


def device_group(kind, caps) -> Column:
    has = lambda c: F.coalesce(F.array_contains(col(caps), c), F.lit(False))
    return F.when((F.coalesce(col(kind), F.lit("")) == "router") | has("Router"), "router").when((F.coalesce(col(kind), F.lit("")) == "switch") | has("Bridge"), "switch").otherwise("other")


def mermaid_safe(name) -> Column:
    safe = F.translate(col(name), "-./ :", "_____")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("n"), safe)).otherwise(safe)


def severity(affected, total, loss) -> Column:
    ratio = F.when(col(total) == 0, F.lit(0.0)).otherwise(col(affected) / col(total))
    level = F.when((ratio > 0.5) | (col(loss) > 50), "critical").when((ratio > 0.25) | (col(loss) > 25), "high").when((ratio > 0.1) | (col(loss) > 10), "medium").otherwise("low")
    return F.when(col(total) == 0, "low").otherwise(level)


def grade(score) -> Column:
    s = col(score)
    return F.when(s >= 0.9, "A").when(s >= 0.8, "B").when(s >= 0.6, "C").when(s >= 0.4, "D").otherwise("F")


def risk_level(p) -> Column:
    p = col(p)
    return F.when(p >= 0.8, "critical").when(p >= 0.5, "high").when(p >= 0.2, "medium").otherwise("low")


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(col(x), F.lit(-500.0)), F.lit(500.0))))


def register(spark: SparkSession) -> None:
    """SQL functions of the same names, as SQL expressions that the optimizer inlines."""
    make = "CREATE OR REPLACE TEMPORARY FUNCTION {} RETURN {}"
    for head, body in (
        ("edge_id(a STRING, b STRING, c STRING, d STRING) RETURNS STRING", "substr(sha2(array_join(array_sort(array(concat(a, ':', b), concat(c, ':', d))), ':'), 256), 1, 16)"),
        ("risk_level(p DOUBLE) RETURNS STRING", "CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.2 THEN 'medium' ELSE 'low' END"),
        ("grade(s DOUBLE) RETURNS STRING", "CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.6 THEN 'C' WHEN s >= 0.4 THEN 'D' ELSE 'F' END"),
        ("device_group(t STRING, c ARRAY<STRING>) RETURNS STRING", "CASE WHEN t = 'router' OR array_contains(c, 'Router') THEN 'router' WHEN t = 'switch' OR array_contains(c, 'Bridge') THEN 'switch' ELSE 'other' END"),
        ("mermaid_safe(s STRING) RETURNS STRING", "regexp_replace(translate(s, '-./ :', '_____'), '^([0-9])', 'n$1')"),
    ):
        spark.sql(make.format(head, body))
