"""Parsers of device output as DataFrame expressions.

Each takes rows (device, value) with a whole text in value and returns records; nothing leaves the JVM. compat=True
keeps known oddities of earlier tools, which the default mends (see each function).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as C

# Codes, object identifiers and formats of the texts.
ROUTE_CODES = {"C": "connected", "S": "static", "R": "rip", "B": "bgp", "D": "eigrp", "EX": "eigrp-external", "O": "ospf", "IA": "ospf-inter-area", "N1": "ospf-nssa-type1", "N2": "ospf-nssa-type2", "E1": "ospf-external-type1", "E2": "ospf-external-type2", "i": "isis", "L1": "isis-level1", "L2": "isis-level2", "ia": "isis-inter-area", "L": "local"}
SYSTEM_OIDS = {"sys_descr": "1.3.6.1.2.1.1.1", "sys_object_id": "1.3.6.1.2.1.1.2", "sys_uptime": "1.3.6.1.2.1.1.3", "sys_contact": "1.3.6.1.2.1.1.4", "sys_name": "1.3.6.1.2.1.1.5", "sys_location": "1.3.6.1.2.1.1.6"}
INTERFACE_OIDS = {"description": "1.3.6.1.2.1.2.2.1.2", "mtu": "1.3.6.1.2.1.2.2.1.4", "speed": "1.3.6.1.2.1.2.2.1.5", "mac_address": "1.3.6.1.2.1.2.2.1.6", "admin_status": "1.3.6.1.2.1.2.2.1.7", "oper_status": "1.3.6.1.2.1.2.2.1.8", "in_octets": "1.3.6.1.2.1.2.2.1.10", "in_discards": "1.3.6.1.2.1.2.2.1.13", "in_errors": "1.3.6.1.2.1.2.2.1.14", "out_octets": "1.3.6.1.2.1.2.2.1.16", "out_discards": "1.3.6.1.2.1.2.2.1.19", "out_errors": "1.3.6.1.2.1.2.2.1.20", "if_name": "1.3.6.1.2.1.31.1.1.1.1", "high_speed": "1.3.6.1.2.1.31.1.1.1.15"}
LLDP_OIDS = {"port_id": "1.0.8802.1.1.2.1.4.1.1.7", "port_desc": "1.0.8802.1.1.2.1.4.1.1.8", "system_name": "1.0.8802.1.1.2.1.4.1.1.9", "system_desc": "1.0.8802.1.1.2.1.4.1.1.10"}
STATUS = {"1": "up", "2": "down", "3": "testing"}
PORT_NAMES = ("Gi", "Te", "Fa", "Et", "Vl", "Lo", "Po", "Hu")
ADDRESS = r"(\d+\.){3}\d+"


def read_texts(spark: SparkSession, path: str, device: str | None = None) -> DataFrame:
    """Whole text files as rows (device, value); without a device, each file's name up to its first dot names its own."""
    named = F.lit(device) if device is not None else F.substring_index("_metadata.file_name", ".", 1)
    return spark.read.text(path, wholetext=True).select(named.alias("device"), "value")


def from_literal(spark: SparkSession, device: str, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(device).alias("device"), F.lit(text).alias("value"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row, however often they are used; withColumn would repeat them at each use."""
    kept = [F.col(c) for c in rows.columns if c not in columns]
    got = rows.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_once"))
    return got.select(*kept, *[F.col("_once")[k].alias(k) for k in columns])


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark in a text, trimmed; empty without one."""
    return F.trim(F.substr(text, F.length(F.substring_index(text, mark, 1)) + 1 + len(mark)), F.lit(" \t\r"))


def _labelled(blocks: DataFrame, cut: str = "\n") -> DataFrame:
    """blocks with their trimmed lines as parts, and labels: what stands before a line's first colon, in lower case; NULL without one."""
    trimmed = F.transform(F.split("block", cut), lambda x: F.trim(x, F.lit(" \t\r")))
    b = _once(blocks, parts=F.filter(trimmed, lambda x: x != ""))
    label = lambda x: F.when(x.contains(":"), F.lower(F.trim(F.substring_index(x, ":", 1), F.lit(" \t"))))
    b = _once(b, labels=F.transform("parts", label))
    wide = lambda x: functools.reduce(Column.__or__, [x.contains(w) for w in ("  ", "\t", "\x0b", "\f", "\r")])
    one = F.transform("labels", lambda x: F.regexp_replace(x, r"\s+", " "))
    return _once(b, labels=F.when(F.exists("labels", wide), one).otherwise(F.col("labels"))).drop("block")


def _field(*names: str, whole: bool = True) -> Column:
    """What follows the first colon of the first line with one of the labels, or the next line; not whole: or with a label that ends so."""
    fits = lambda x: x.isin(*names) if whole else functools.reduce(Column.__or__, [x.endswith(n) for n in names])
    at = F.array_position(F.transform("labels", fits), True).cast("int")
    bare = lambda x: F.length(F.substring_index(x, ":", 1)) + 1 == F.length(x)
    value = lambda p: F.when(p > 0, F.when(bare(F.get("parts", p - 1)), F.get("parts", p)).otherwise(_after(F.get("parts", p - 1), ":")))
    return F.get(F.transform(F.array(at), value), 0)


def _word(text: Column) -> Column:
    return F.get(F.split(text, r"\s+"), 0)


def _blocks(texts: DataFrame, pattern: str) -> DataFrame:
    return texts.select("device", F.posexplode(F.split("value", pattern)).alias("ordinal", "block"))


_NEIGHBOR = ("local_device", "local_port", "remote_device", "remote_port", "remote_system_description", "remote_capabilities", "remote_mgmt_address", "ttl", "protocol")


def _neighbors(rows: DataFrame) -> DataFrame:
    return rows.select(*_NEIGHBOR, C.edge_id("local_device", "local_port", "remote_device", "remote_port").alias("edge_id"), F.col("ordinal").cast("bigint").alias("ordinal"))


def _neighbor(rows: DataFrame, protocol: str, local: Column, remote: Column, port: Column, about: Column, able: Column, address: Column, ttl: Column) -> DataFrame:
    """Neighbour records of blocks; one without a local port or a remote device is none."""
    none = F.lit("")
    # Ends are looked at twice; the other columns are computed only where they are asked for.
    rows = _once(rows, _local=local, _remote=remote).where("_local is not null and _remote is not null")
    rows = rows.select("device", "ordinal", "_local", "_remote", *[c.alias(n) for n, c in (("_port", port), ("_about", about), ("_able", able), ("_address", address), ("_ttl", ttl))])
    port, about, able, address, ttl = (F.col(c) for c in ("_port", "_about", "_able", "_address", "_ttl"))
    got = rows.select(F.col("device").alias("local_device"), F.col("_local").alias("local_port"), F.col("_remote").alias("remote_device"), F.coalesce(port, F.lit("unknown")).alias("remote_port"), F.coalesce(about, none).alias("remote_system_description"), C.capabilities(able).alias("remote_capabilities"), F.coalesce(address, none).alias("remote_mgmt_address"), F.coalesce(ttl.try_cast("int"), F.lit(120)).alias("ttl"), F.lit(protocol).alias("protocol"), "ordinal")
    return _neighbors(got)


def lldp_neighbors(texts: DataFrame, compat: bool = False) -> DataFrame:
    """Neighbours of detailed LLDP output. A block needs a local port and a system name.

    The remote port is read from a line of its own; with compat, a local port line passes for one.
    """
    b = _labelled(_blocks(texts, r"-{20,}|\n\n(?=Local\s)"))
    any_ = lambda *names: _field(*names, whole=False)
    local = any_("local port id", "local port", "local portid", "local intf", "local intf id", "local intfid")
    return _neighbor(b, "lldp", local, any_("system name", "sysname"), _field("port id", "port description", whole=not compat), any_("system description"), any_("system capabilities"), any_("management address", "management addresses"), F.regexp_substr(any_("time to live"), F.lit(r"^\d+")))


def cdp_neighbors(texts: DataFrame) -> DataFrame:
    """Neighbours of detailed CDP output, where labels may also follow commas: device names end at their first dot."""
    b = _labelled(_blocks(texts, "-{20,}"), r"\r?\n|,\s+(?=[A-Z][^:,\n]*:)")
    any_ = lambda *names: _field(*names, whole=False)
    local = F.nullif(F.rtrim(_word(any_("interface", "local intrfce")), F.lit(",")), F.lit(""))
    about = F.trim(F.substring_index(any_("platform"), ",", 1))
    return _neighbor(b, "cdp", local, F.substring_index(any_("device id"), ".", 1), any_("port id (outgoing port)", "port id(outgoing port)"), about, any_("capabilities"), _word(any_("ip address", "entry address")), F.lit(None).cast("string"))


def _json_rows(texts: DataFrame, *keys: str) -> DataFrame:
    """Elements of a JSON list, or of the first of the keys that an object has, as maps of text."""
    listed = F.get_json_object("value", "$")
    of = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys], F.when(listed.startswith("["), listed))
    texts = _once(texts, of=of)
    items = F.from_json("of", "array<string>")
    return texts.select("device", F.posexplode(items).alias("ordinal", "item"))


def _any(*names: str) -> Column:
    return F.coalesce(*[F.get_json_object("item", f"$.{n}") for n in names])


def json_neighbors(texts: DataFrame) -> DataFrame:
    """Neighbours of structured output: a list, or an object with lldp_neighbors or neighbors."""
    rows = _json_rows(texts, "lldp_neighbors", "neighbors").select(
        F.coalesce(_any("local_device"), F.col("device")).alias("local_device"),
        F.coalesce(_any("local_port", "local_interface"), F.lit("")).alias("local_port"),
        F.coalesce(_any("remote_device", "neighbor", "system_name"), F.lit("")).alias("remote_device"),
        F.coalesce(_any("remote_port", "neighbor_interface"), F.lit("")).alias("remote_port"),
        F.coalesce(_any("system_description"), F.lit("")).alias("remote_system_description"),
        F.coalesce(F.from_json(_any("capabilities"), "array<string>"), F.array().cast("array<string>")).alias("remote_capabilities"),
        F.coalesce(_any("mgmt_address"), F.lit("")).alias("remote_mgmt_address"),
        F.coalesce(_any("ttl").try_cast("int"), F.lit(120)).alias("ttl"),
        F.coalesce(_any("protocol"), F.lit("lldp")).alias("protocol"),
        "ordinal",
    )
    return _neighbors(rows)


def walk_lines(texts: DataFrame) -> DataFrame:
    """(device, line_no, oid, value) of an SNMP walk: the last value of each object identifier.

    A line is an identifier, an equals sign, and a value that may have its type and a colon before it and quotes around.
    """
    lines = texts.select("device", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.col("line").contains("="))
    oid = F.ltrim(F.trim(F.substring_index("line", "=", 1), F.lit(" \t\r")), F.lit("."))
    rows = _once(lines, oid=oid, rest=_after(F.col("line"), "=")).where(F.col("oid").rlike(r"^[\d.]+$"))
    typed = F.substring_index("rest", ":", 1).rlike(r"^\w[\w-]*$") & F.col("rest").contains(":")
    value = F.trim(F.when(typed, _after(F.col("rest"), ":")).otherwise(F.col("rest")), F.lit('"'))
    return _once(rows, value=value).groupBy("device", "oid").agg(F.max("line_no").alias("line_no"), F.max_by("value", "line_no").alias("value"))


def _under(table: dict[str, str]) -> Column:
    """The name whose identifier is the row's, or leads to it; NULL if none."""
    out = F.lit(None).cast("string")
    for name, oid in table.items():
        out = F.when(F.col("oid").startswith(oid + ".") | (F.col("oid") == oid), name).otherwise(out)
    return out


def snmp_device(texts: DataFrame) -> DataFrame:
    """One row a device: the system group; sysName, if there is one, replaces the device's name."""
    rows = texts.select("device").distinct().join(walk_lines(texts).withColumn("name", _under(SYSTEM_OIDS)), "device", "left")
    last = {n: F.max_by("value", F.when(F.col("name") == n, F.col("line_no"))).alias(n) for n in SYSTEM_OIDS}
    got = rows.groupBy("device").agg(*last.values())
    text = [F.coalesce(n, F.lit("")).alias(n) for n in ("sys_descr", "sys_object_id")]
    return got.select("device", F.coalesce("sys_name", "device").alias("hostname"), *text, F.coalesce(F.col("sys_uptime").try_cast("bigint"), F.lit(0)).alias("sys_uptime"), *[F.coalesce(n, F.lit("")).alias(n) for n in ("sys_contact", "sys_location")])


def snmp_interfaces(texts: DataFrame) -> DataFrame:
    """One row an interface that has a description or a name; the later of both speeds counts."""
    rows = _once(walk_lines(texts), name=_under(INTERFACE_OIDS)).where("name is not null").withColumn("if_index", F.substring_index("oid", ".", -1).cast("int"))
    pick = lambda n: F.max_by("value", F.when(F.col("name") == n, F.col("line_no")))
    number = lambda n: F.coalesce(pick(n).try_cast("bigint"), F.lit(0)).alias(n)
    fast = F.when(F.col("name") == "high_speed", F.col("value").try_cast("bigint") * 1000000).when(F.col("name") == "speed", F.col("value").try_cast("bigint"))
    status = lambda n: F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[pick(n)], pick(n), F.lit("unknown")).alias(n)
    got = rows.groupBy("device", "if_index").agg(F.coalesce(pick("if_name"), pick("description")).alias("name"), F.coalesce(pick("description"), F.lit("")).alias("description"), status("admin_status"), status("oper_status"), F.coalesce(F.max_by(fast, F.when(fast.isNotNull(), F.col("line_no"))), F.lit(0)).alias("speed"), number("mtu"), F.coalesce(pick("mac_address"), F.lit("")).alias("mac_address"), *[number(n) for n in ("in_octets", "out_octets", "in_errors", "out_errors", "in_discards", "out_discards")])
    return got.where("name is not null").withColumn("utilization_fraction", C.counter_fraction("in_octets", "out_octets", "speed"))


def snmp_neighbors(texts: DataFrame) -> DataFrame:
    """One row a remote entry that has a system name."""
    rows = _once(walk_lines(texts), name=_under(LLDP_OIDS)).where("name is not null")
    key = F.lit(None).cast("string")
    for name, oid in LLDP_OIDS.items():
        key = F.when(F.col("name") == name, F.substring("oid", len(oid) + 2, 1000)).otherwise(key)
    got = rows.withColumn("key", key).groupBy("device", "key").pivot("name", list(LLDP_OIDS)).agg(F.max_by("value", "line_no"))
    return got.where("system_name is not null").select("device", "key", "system_name", *[F.coalesce(n, F.lit("")).alias(n) for n in ("port_id", "port_desc", "system_desc")])


def snmp_stars(texts: DataFrame) -> DataFrame:
    """One row a device, with what a graph takes of snmp_device(), snmp_interfaces() and snmp_neighbors(), in one pass over the lines.

    interface_count counts snmp_interfaces() of the device; neighbors holds snmp_neighbors()' key, system_name and port_id.
    Only lines under the identifiers of these are parsed, and no more of them than the last of each name is kept.
    """
    system = {n: SYSTEM_OIDS[n] for n in ("sys_descr", "sys_uptime", "sys_name", "sys_location")}
    ports = {n: INTERFACE_OIDS[n] for n in ("description", "if_name")}
    far = {n: LLDP_OIDS[n] for n in ("port_id", "system_name")}
    table = system | ports | far
    # A row without a line stands for each text, so that a device without lines is there.
    split = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.split("value", "\n"), F.array().cast("array<string>")))
    line = F.col("line")
    some = functools.reduce(Column.__or__, [line.contains(x) for x in (SYSTEM_OIDS["sys_descr"][:-1], *ports.values(), *far.values())])
    lines = texts.select("device", F.posexplode(split).alias("line_no", "line")).where(line.isNull() | line.contains("=") & some)
    oid = F.ltrim(F.trim(F.substring_index("line", "=", 1), F.lit(" \t\r")), F.lit("."))
    rows = _once(lines, oid=oid, rest=_after(line, "="))
    rows = _once(rows, name=_under(table)).where(F.col("line").isNull() | F.col("name").isNotNull() & F.col("oid").rlike(r"^[\d.]+$"))
    typed = F.substring_index("rest", ":", 1).rlike(r"^\w[\w-]*$") & F.col("rest").contains(":")
    value = F.trim(F.when(typed, _after(F.col("rest"), ":")).otherwise(F.col("rest")), F.lit('"'))
    kind = F.when(F.col("name").isin(*ports), "port").when(F.col("name").isin(*far), "far").otherwise(F.col("name"))
    key = F.when(F.col("name").isin(*ports), F.substring_index("oid", ".", -1).cast("int").cast("string"))
    for n, x in far.items():
        key = F.when(F.col("name") == n, F.substring("oid", len(x) + 2, 1000)).otherwise(key)
    rows = rows.select("device", "line_no", kind.alias("kind"), key.alias("key"), (F.col("name") == "port_id").alias("second"), value.alias("value"))
    last = lambda second: F.max_by("value", F.when(F.col("second") == second, F.col("line_no")))
    each = rows.groupBy("device", "kind", "key").agg(last(False).alias("value"), last(True).alias("port_id"))
    of = {n: F.max(F.when(F.col("kind") == n, F.col("value"))) for n in system}
    neighbor = F.when((F.col("kind") == "far") & F.col("value").isNotNull() & F.col("device").isNotNull(), F.struct("key", F.col("value").alias("system_name"), F.coalesce("port_id", F.lit("")).alias("port_id")))
    text = [F.coalesce(of[n], F.lit("")).alias(n) for n in ("sys_descr", "sys_location")]
    return each.groupBy("device").agg(F.coalesce(of["sys_name"], F.col("device")).alias("hostname"), *text, F.coalesce(of["sys_uptime"].try_cast("bigint"), F.lit(0)).alias("sys_uptime"), F.count_if(F.col("kind") == "port").cast("int").alias("interface_count"), F.collect_list(neighbor).alias("neighbors"))


def _codes(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROUTE_CODES.items() for x in kv])
    return F.coalesce(table[code], code)


def _tokens(line: Column) -> Column:
    """Words of a line; commas are words of their own."""
    return F.filter(F.split(F.replace(line, F.lit(","), F.lit(" , ")), r"\s+"), lambda x: x != "")


def _drop(words: Column, n: Column | int) -> Column:
    return F.slice(words, F.lit(1) + n, F.greatest(F.size(words), F.lit(1)))


def _number_pair(word: Column, part: int) -> Column:
    """One of the two numbers of a word like [110/20]; NULL of another word."""
    return F.when(word.rlike(r"^\[\d+/\d+\]$"), F.element_at(F.split(F.translate(word, "[]", "  "), "/"), part)).try_cast("int")


def _walked(lines: DataFrame) -> DataFrame:
    """Lines (.., line) with the parts of a route: lead (text before the address), prefix, own_mask, ad, metric, hop, rest (words after a comma)."""
    words = _once(lines, words=_tokens(F.col("line")))
    at = F.array_position(F.transform("words", lambda x: x.rlike(f"^{ADDRESS}(/\\d+)?$")), True).cast("int")
    words = _once(words, place=at).where("place > 0")
    at = F.col("place")
    words = _once(words, **{"address": F.get("words", at - 1), "tail": _drop(F.col("words"), at)})
    words = words.withColumn("lead", F.expr("substring(line, 1, locate(address, line) - 1)"))
    words = _once(words, **{"pair": F.get("tail", F.lit(0)), "tail": F.when(_number_pair(F.get("tail", F.lit(0)), 1).isNotNull(), _drop(F.col("tail"), 1)).otherwise(F.col("tail"))})
    hop = F.when((F.get("tail", F.lit(0)) == "via") & F.get("tail", F.lit(1)).rlike(f"^{ADDRESS}$"), F.get("tail", F.lit(1)))
    words = _once(words, **{"hop": hop, "tail": F.when(hop.isNotNull(), _drop(F.col("tail"), 2)).otherwise(F.col("tail"))})
    rest = F.when(F.get("tail", F.lit(0)) == ",", F.filter(_drop(F.col("tail"), 1), lambda x: x != ","))
    mask = F.element_at(F.split("address", "/"), -1)
    return _once(words, **{"prefix": F.substring_index("address", "/", 1), "own_mask": F.when(F.col("address").contains("/"), mask).try_cast("int"), "ad": _number_pair(F.col("pair"), 1), "metric": _number_pair(F.col("pair"), 2), "rest": rest})


def ios_routes(texts: DataFrame, compat: bool = False) -> DataFrame:
    """Routes of `show ip route` output; a line without a mask takes the one before it, as does one without a code.

    By default summary headers are no routes, sub-codes such as E2 or IA name the protocol, and a star is ignored.
    With compat, codes have capitals only (lines with others are lost), headers pass as routes and codes of two words
    stay as they are.
    """
    lines = texts.select("device", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    lines = _once(lines, line=F.rtrim("line")).where("line <> '' and not startswith(line, 'Codes:') and not startswith(line, 'Gateway')")
    if not compat:
        lines = lines.where("not contains(line, 'variably subnetted') and not contains(line, 'is subnetted')")
    rows = _walked(lines)
    # A code is short and ends before white space; two blanks or more stand for the code before.
    size = F.length(F.rtrim("lead"))
    coded = F.col("lead").rlike(r"^[A-Z*\s]+\s$") & (size <= 5) if compat else F.col("lead").rlike(r"^[A-Za-z][A-Za-z0-9* ]*\s$") & (size <= 8)
    blank = F.trim("lead") == ""
    full = coded | blank & (F.length("lead") > 1)
    rows = _once(rows, full=full).where(F.col("full") | blank & (F.length("lead") == 1))
    code = F.when(F.col("full"), F.trim("lead"))
    rows = rows.withColumn("code", code if compat else F.nullif(code, F.lit("")))
    before = W.partitionBy("device").orderBy("pos")
    # A full line sets the mask and the code that later lines inherit.
    rows = rows.withColumn("set_mask", F.last(F.when(F.col("full"), F.col("own_mask")), True).over(before))
    word = F.last("code", True).over(before)
    mask = F.coalesce("own_mask", "set_mask", F.lit(24))
    if not compat:
        plain = F.trim(F.translate("code", "*", " "))
        word = F.last(F.when(F.col("code").isNotNull(), F.element_at(F.split(plain, r"\s+"), -1)), True).over(before)
    port = F.coalesce(F.get(F.filter("rest", lambda x: F.substring(x, 1, 2).isin(*PORT_NAMES)), 0), F.lit(""))
    return rows.select(F.col("device").alias("source_router"), "prefix", mask.alias("mask_len"), C.network("prefix", mask).alias("network"), _codes(F.coalesce(word, F.lit(""))).alias("protocol"), F.coalesce("hop", F.lit("")).alias("next_hop"), port.alias("next_hop_interface"), F.coalesce("metric", F.lit(0)).alias("metric"), F.coalesce("ad", F.lit(0)).alias("admin_distance"), F.col("pos").cast("bigint").alias("ordinal"))


def junos_routes(texts: DataFrame) -> DataFrame:
    """Routes of Junos `show route` output: a network, its protocol and metric in brackets, the hop and the interface.

    The hop is the word after "to", or the first address; the interface is the word after "via". Either may be missing.
    """
    lines = texts.select("device", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).withColumn("words", _tokens(F.col("line")))
    lines = lines.withColumns({"address": F.get("words", F.lit(0)), "mark": F.split(F.translate(F.get("words", F.lit(1)), "*[]", ""), "/"), "tail": _drop(F.col("words"), 2)})
    rows = lines.where(F.col("address").rlike(f"^{ADDRESS}/\\d+$") & F.get("words", F.lit(1)).rlike(r"^\*?\[\w+/\d+\]$"))
    next_to = lambda mark: F.get(F.filter(F.transform("tail", lambda x, i: F.when(F.get("tail", i - 1) == mark, x)), lambda x: x.isNotNull()), 0)
    hop = F.get(F.filter("tail", lambda x: x.rlike(f"^{ADDRESS}$")), 0)
    prefix, mask = F.substring_index("address", "/", 1), F.substring_index("address", "/", -1)
    return rows.select(F.col("device").alias("source_router"), prefix.alias("prefix"), mask.cast("int").alias("mask_len"), C.network(prefix, mask).alias("network"), F.lower(F.get("mark", F.lit(0))).alias("protocol"), F.coalesce(hop, F.lit("")).alias("next_hop"), F.coalesce(next_to("via"), F.lit("")).alias("next_hop_interface"), F.get("mark", F.lit(1)).cast("int").alias("metric"), F.lit(0).alias("admin_distance"), F.col("pos").cast("bigint").alias("ordinal"))


def json_routes(texts: DataFrame) -> DataFrame:
    """Routes of a JSON list or of an object's routes; a prefix with a slash has its own mask."""
    rows = _json_rows(texts, "routes")
    prefix = F.coalesce(_any("prefix"), F.lit(""))
    own = F.when(F.contains(prefix, F.lit("/")), F.element_at(F.split(prefix, "/"), 2).try_cast("int"))
    mask = F.coalesce(own, _any("mask_len", "prefix_length").try_cast("int"), F.lit(24))
    bare = F.substring_index(prefix, "/", 1)
    return rows.select(F.coalesce(_any("source"), F.col("device")).alias("source_router"), bare.alias("prefix"), mask.alias("mask_len"), C.network(bare, mask).alias("network"), F.coalesce(_any("protocol"), F.lit("")).alias("protocol"), F.coalesce(_any("next_hop", "nexthop"), F.lit("")).alias("next_hop"), F.coalesce(_any("interface"), F.lit("")).alias("next_hop_interface"), F.coalesce(_any("metric").try_cast("int"), F.lit(0)).alias("metric"), F.coalesce(_any("admin_distance", "preference").try_cast("int"), F.lit(0)).alias("admin_distance"), F.col("ordinal").cast("bigint").alias("ordinal"))


def routes(texts: DataFrame, format: str = "ios") -> DataFrame:
    try:
        return {"ios": ios_routes, "junos": junos_routes, "json": json_routes}[format](texts)
    except KeyError:
        raise ValueError(f"unknown routing format: {format}") from None


def _near(before: bool, *marks: str) -> Column:
    """Of a block's words, the first that stands before or after the marks; NULL if they do not occur so."""
    mark = f" {' '.join(marks)} "
    text = F.concat(F.lit("" if before else " "), "joined", F.lit(" "))
    if before:
        word = F.when(F.contains(text, F.lit(mark)), F.substring_index(F.substring_index(text, mark, 1), " ", -1))
    else:
        word = F.substring_index(F.substr(text, F.length(F.substring_index(text, mark, 1)) + 1 + len(mark)), " ", 1)
    return F.nullif(word, F.lit(""))


def ios_interfaces(texts: DataFrame, ts: float | None = None) -> DataFrame:
    """Interface states of `show interfaces` output, a block each. A hardware address is three groups of four hex digits.

    A block begins at a line like "name is up, line protocol is up"; its numbers are found by the words next to them.
    """
    b = texts.select("device", F.posexplode(F.split("value", r"(?m)(?=^\S+ +is +)")).alias("ordinal", "block"))
    b = _once(b, head=_tokens(F.substring_index("block", "\n", 1)), joined=F.trim(F.regexp_replace("block", r"[\s,()]+", " ")))
    admin = (F.get("head", F.lit(1)) == "is") & (F.get("head", F.lit(2)) == "administratively")
    state = F.when(admin, _drop(F.col("head"), 3)).otherwise(_drop(F.col("head"), 2))  # up , line protocol is up
    b = _once(b, state=state, admin=admin)
    both = F.get("state", F.lit(0)).isin("up", "down") & F.get("state", F.lit(5)).isin("up", "down") & (F.array_join(F.slice("state", 2, 4), " ") == ", line protocol is") & (F.get("head", F.lit(1)) == "is")
    number = lambda before, *marks: F.coalesce(_near(before, *marks).try_cast("bigint"), F.lit(0))
    net = F.col("net")
    mac = F.nullif(F.regexp_extract("joined", r"(?:^| )address is ([0-9a-fA-F]{4}(?:\.[0-9a-fA-F]{4}){2})(?: |$)", 1), F.lit(""))
    about = F.get(F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x.startswith("Description: ")), 0)
    b = _once(b.where(both), net=F.split(_near(False, "Internet", "address", "is"), "/"), about=about)
    return b.select(
        "device",
        F.get("head", F.lit(0)).alias("name"),
        F.when(F.col("admin"), "down").otherwise("up").alias("admin_status"),
        F.get("state", F.lit(5)).alias("oper_status"),
        F.floor(number(False, "BW") / 1000).cast("int").alias("speed_mbps"),
        number(False, "MTU").cast("int").alias("mtu"),
        F.coalesce(F.when(F.size(net) == 2, F.get(net, 0)), F.lit("")).alias("ip_address"),
        F.coalesce(F.get(net, 1), F.lit("")).alias("subnet_mask"),
        F.coalesce(mac, F.lit("")).alias("mac_address"),
        F.coalesce(_after(F.col("about"), ":"), F.lit("")).alias("description"),
        *[number(True, *marks).alias(name) for name, marks in (("in_packets", ("packets", "input")), ("out_packets", ("packets", "output")), ("in_errors", ("input", "errors")), ("out_errors", ("output", "errors")), ("crc_errors", ("CRC",)), ("collisions", ("collisions",)))],
        *[number(False, way, "rate").cast("double").alias(f"{way}_rate_bps") for way in ("input", "output")],
        (F.lit(float(ts)) if ts is not None else F.unix_timestamp().cast("double")).alias("ts"),
        F.lit("cli").alias("collection_method"),
    )


def json_interfaces(texts: DataFrame, ts: float | None = None) -> DataFrame:
    """Interface states of a JSON list or of an object's interfaces."""
    rows = _json_rows(texts, "interfaces")
    number = lambda *n: F.coalesce(_any(*n).try_cast("bigint"), F.lit(0))
    text = lambda n, d="": F.coalesce(_any(n), F.lit(d)).alias(n)
    return rows.select("device", F.coalesce(_any("name", "interface"), F.lit("")).alias("name"), text("admin_status", "up"), text("oper_status", "up"), number("speed_mbps", "speed").cast("int").alias("speed_mbps"), number("mtu").cast("int").alias("mtu"), text("ip_address"), text("mac_address"), text("description"), *[number(n).alias(n) for n in ("in_bytes", "out_bytes", "in_packets", "out_packets", "in_errors", "out_errors")], *[F.coalesce(_any(n).try_cast("double"), F.lit(0.0)).alias(n) for n in ("input_rate_bps", "output_rate_bps")], (F.lit(float(ts)) if ts is not None else F.unix_timestamp().cast("double")).alias("ts"), F.lit("json").alias("collection_method"))
