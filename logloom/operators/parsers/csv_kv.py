"""PAN-OS CSV and key=value lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import action, blank, first_of, iso, n_columns, port, strip
from logloom.operators.classify import takes_csv
from logloom.operators.parsers.base import Parser, Work, confidences, parsed

PAIRS = r"""([a-zA-Z0-9_.-]+)=(["']?)([^"',\s]+)\2"""


def _pan(w: Work, line: Column, received: Column, here: Column) -> Column:
    cols = w.keep(2, "pan", F.split(line, ",", -1), here)
    at = lambda i: F.get(cols, F.lit(i))
    src, dst, spt, dpt = at(7), at(8), port(strip(at(24))), port(strip(at(25)))
    proto = F.upper(F.coalesce(F.when(~blank(at(29)), at(29)), F.lit("TCP")))
    act = w.keep(3, "pan_act", action(F.coalesce(at(30), F.lit("allow"))), here)
    blocked = act == "blocked"
    fields = F.transform(cols, lambda v, i: F.struct(F.concat(F.lit("field_"), i.cast("string")).alias("key"), v.alias("value")))
    more = F.array(F.struct(F.lit("ruleName").alias("key"), at(11).alias("value")), F.struct(F.lit("application").alias("key"), at(14).alias("value")))
    return parsed(
        timestamp_text=iso(received), category="network_traffic", type="firewall", action=act,
        severity=F.when(blocked, "high").otherwise("informational"), severity_id=F.when(blocked, 4).otherwise(1),
        message=F.concat(F.lit("Palo Alto PAN-OS "), F.coalesce(at(3), F.lit("TRAFFIC")), F.lit(" Event: "), act, F.lit(" "), proto),
        src_ip=src, src_port=spt, src_user=F.when(~blank(at(12)), at(12)), dst_ip=dst, dst_port=dpt, protocol=proto, direction="egress",
        vendor="Palo Alto Networks", product="PAN-OS", raw_format="CSV", extensions=F.map_from_entries(F.concat(fields, F.filter(more, lambda x: x["value"].isNotNull()))),
        confidence=confidences(("source.ip", 98, ~blank(src)), ("destination.ip", 98, ~blank(dst)), ("source.port", 98, spt.isNotNull()), ("destination.port", 98, dpt.isNotNull()), ("network.protocol", 98, None), ("event.action", 95, None), ("observer.vendor", 99, None)),
    )


def _kv(w: Work, line: Column, received: Column, here: Column) -> Column:
    kv = w.kv(2, "kv", line, PAIRS, 3, lower=True, when=here)
    src, dst = first_of(kv, "src", "src_ip", "source_ip"), first_of(kv, "dst", "dst_ip", "dest_ip")
    spt, dpt = port(strip(first_of(kv, "spt", "src_port", "source_port"))), port(strip(first_of(kv, "dpt", "dst_port", "dest_port")))
    proto = F.upper(F.coalesce(first_of(kv, "proto", "protocol"), F.lit("TCP")))
    act = w.keep(4, "kv_act", action(F.coalesce(first_of(kv, "action", "act", "status"), F.lit("allowed"))), here)
    blocked = act == "blocked"
    return parsed(
        timestamp_text=iso(received), category="network_traffic", type="kv_log", action=act,
        severity=F.when(blocked, "medium").otherwise("informational"), severity_id=F.when(blocked, 3).otherwise(1),
        message=F.concat(F.lit("KV Event: "), act, F.lit(" "), proto), src_ip=src, src_port=spt, src_user=first_of(kv, "user", "usr", "username"), dst_ip=dst, dst_port=dpt,
        protocol=proto, vendor=F.coalesce(first_of(kv, "device", "vendor"), F.lit("Generic-KV")), product="KV-Parser", raw_format="KV", extensions=kv,
        confidence=confidences(("source.ip", 95, src.isNotNull()), ("destination.ip", 95, dst.isNotNull()), ("source.port", 95, spt.isNotNull()), ("destination.port", 95, dpt.isNotNull()), ("event.action", 90, None)),
    )


def parse(w: Work, raw: Column, line: Column, received: Column) -> Column:
    wide = w.keep(1, "wide", n_columns(line) >= 10)
    return F.when(wide, _pan(w, line, received, wide)).otherwise(_kv(w, line, received, ~wide))


CSV_KV = Parser("csv_kv_parser", "CSV/KV", takes_csv, parse)
