"""Syslog: Cisco ASA connections, packet filters, RFC 5424, and anything else with key=value pairs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import action, bsd_time, captured, first_of, iso, matched, nonempty, port
from logloom.operators.classify import takes_syslog
from logloom.operators.parsers.base import Parser, Work, confidences, failed, parsed

_HEAD = r"(?:<\d+>)?(?:([A-Z][a-z]{2})\s+(\d+)\s+(\d{2}:\d{2}:\d{2}))?\s*(?:(\S+)\s+)?"
_QUAD = r"\d+\.\d+\.\d+\.\d+"
# 1-4 month, day, clock, host; 5 code, 6 action, 7 protocol; 8-10 and 11-13 zone, address, port; 14, 15 rule
ASA = (
    _HEAD + r"%(ASA-\d-\d+):\s+(\w+)\s+(\w+)"
    rf"\s+src\s+(?:(\w+):)?({_QUAD})/(\d+)"
    rf"\s+dst\s+(?:(\w+):)?({_QUAD})/(\d+)"
    r'(?:\s+by\s+access-group\s+(?:"([^"]+)"|(\S+)))?.*'
)
# 1-4 as above; 5 verdict, 6 source, 7 destination, 8 protocol, 9, 10 ports
FILTER = (
    _HEAD + r"(?:kernel:\s+)?(DROP|ACCEPT|REJECT|ALLOW|BLOCK)?.*"
    rf"\bSRC=({_QUAD})\b.*\bDST=({_QUAD})\b.*\bPROTO=(\w+)\b(?:.*\bSPT=(\d+)\b)?(?:.*\bDPT=(\d+)\b)?.*"
)
# 1 time, 2 host, 3 application, 4 message
RFC5424 = r"<\d{1,3}>1\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+\S+(?:\s+\[.*?\])?\s+(.*)"
PAIRS = r"""([a-zA-Z0-9_.-]+)=(["']?)([^"'\s]+)\2"""


def _long_port(x: Column) -> Column:
    """A port as captured; null if it doesn't fit 32 bits."""
    return x.try_cast("int")


def _asa(w: Work, line: Column, received: Column, here: Column) -> Column:
    g = w.keep(3, "asa", captured(line, ASA, 15, "i"), here)
    act, proto = w.keep(4, "asa_act", action(g[5]), here), F.upper(g[6])
    loud = act.isin("blocked", "denied")
    rule = F.coalesce(nonempty(g[13]), nonempty(g[14]))
    code = F.create_map(F.lit("vendorCode"), F.concat(F.lit("%"), g[4]))
    event = parsed(
        timestamp_text=bsd_time(g[0], g[1], g[2], received), category="network_traffic", type="firewall", action=act,
        severity=F.when(loud, "high").otherwise("informational"), severity_id=F.when(loud, 4).otherwise(1),
        message=F.concat(F.lit("Cisco ASA firewall traffic: "), act, F.lit(" "), proto, F.lit(" connection")),
        src_ip=g[8], src_port=_long_port(g[9]), src_zone=nonempty(g[7]), dst_ip=g[11], dst_port=_long_port(g[12]), dst_zone=nonempty(g[10]),
        protocol=proto, direction="egress", vendor="Cisco", product="ASA-Firewall", observer_host=F.coalesce(nonempty(g[3]), F.lit("cisco-asa")), raw_format="SYSLOG",
        extensions=F.when(rule.isNull(), code).otherwise(F.map_concat(code, F.create_map(F.lit("ciscoRuleId"), rule))),
        confidence=confidences(("event.action", 98, None), ("network.protocol", 99, None), ("source.ip", 99, None), ("source.port", 99, None), ("destination.ip", 99, None), ("destination.port", 99, None), ("observer.hostname", 95, None)),
    )
    return F.when(_long_port(g[9]).isNull() | _long_port(g[12]).isNull(), failed("Syslog parsing error: port out of range")).otherwise(event)


def _filter(w: Work, line: Column, received: Column, here: Column) -> Column:
    g = w.keep(3, "filter", captured(line, FILTER, 10, "i"), here)
    act = w.keep(4, "filter_act", F.coalesce(action(nonempty(g[4])), F.lit("blocked")), here)
    proto, blocked = F.upper(g[7]), act == "blocked"
    src, dst = nonempty(g[8]), nonempty(g[9])
    event = parsed(
        timestamp_text=bsd_time(g[0], g[1], g[2], received), category="network_traffic", type="firewall", action=act,
        severity=F.when(blocked, "medium").otherwise("informational"), severity_id=F.when(blocked, 3).otherwise(1),
        message=F.concat(F.lit("Linux kernel packet filter: "), act, F.lit(" "), proto),
        src_ip=g[5], src_port=_long_port(src), dst_ip=g[6], dst_port=_long_port(dst), protocol=proto,
        vendor="Linux", product="iptables", observer_host=F.coalesce(nonempty(g[3]), F.lit("linux-fw")), raw_format="SYSLOG", extensions=F.create_map().cast("map<string,string>"),
        confidence=confidences(("event.action", 95, None), ("source.ip", 99, None), ("destination.ip", 99, None), ("network.protocol", 95, None), ("source.port", 98, src.isNotNull()), ("destination.port", 98, dst.isNotNull())),
    )
    over = (src.isNotNull() & _long_port(src).isNull()) | (dst.isNotNull() & _long_port(dst).isNull())
    return F.when(over, failed("Syslog parsing error: port out of range")).otherwise(event)


def _rfc5424(w: Work, line: Column, received: Column, here: Column) -> Column:
    g = w.keep(3, "rfc", captured(line, RFC5424, 4), here)
    kv = w.kv(4, "rfc_kv", g[3], PAIRS, 3, when=here)
    src, dst = first_of(kv, "src", "src_ip", "source_ip"), first_of(kv, "dst", "dst_ip", "dest_ip")
    return parsed(
        timestamp_text=F.when(g[0].contains("T"), g[0]).otherwise(iso(received)), category="network_traffic", type="syslog_rfc5424",
        action=action(F.coalesce(first_of(kv, "action", "act"), F.lit("allowed"))), severity="informational", severity_id=1, message=g[3],
        src_ip=src, src_port=port(first_of(kv, "spt", "src_port")), dst_ip=dst, dst_port=port(first_of(kv, "dpt", "dst_port")),
        protocol=F.upper(F.coalesce(first_of(kv, "proto", "protocol"), F.lit("TCP"))), vendor="GenericSyslog", product=g[2], observer_host=g[1], raw_format="SYSLOG_RFC5424", extensions=kv,
        confidence=confidences(("observer.hostname", 95, None), ("source.ip", 95, src.isNotNull()), ("destination.ip", 95, dst.isNotNull()), ("event.action", 90, None)),
    )


def _other(w: Work, raw: Column, received: Column, here: Column) -> Column:
    kv = w.kv(3, "other_kv", raw, PAIRS, 3, when=here)
    src, dst = first_of(kv, "src", "srcip", "src_ip"), first_of(kv, "dst", "dstip", "dst_ip")
    return parsed(
        timestamp_text=iso(received), category="network_traffic", type="syslog", action=action(F.coalesce(first_of(kv, "action", "act"), F.lit("informational"))),
        severity="informational", severity_id=1, message=raw, src_ip=src, src_port=port(first_of(kv, "spt", "srcport")), dst_ip=dst, dst_port=port(first_of(kv, "dpt", "dstport")),
        protocol=F.upper(F.coalesce(first_of(kv, "proto", "protocol"), F.lit("IP"))), vendor="Syslog", product="Generic", raw_format="SYSLOG", extensions=kv,
        confidence=confidences(("source.ip", 90, src.isNotNull()), ("destination.ip", 90, dst.isNotNull()), ("event.action", 85, None)),
    )


def parse(w: Work, raw: Column, line: Column, received: Column) -> Column:
    # Plain words are looked for first: the patterns try every place of a line that lacks them.
    upper = w.keep(1, "upper", F.upper(line))
    has = lambda *words: reduce(and_, [upper.contains(x) for x in words])
    asa = F.when(has("%ASA-", "SRC", "DST"), matched(line, ASA, "i")).otherwise(False)
    filters = F.when(has("SRC=", "DST=", "PROTO="), matched(line, FILTER, "i")).otherwise(False)
    rfc = F.when(line.rlike(r"\A<\d{1,3}>1\s"), matched(line, RFC5424)).otherwise(False)
    kind = w.keep(2, "kind", F.when(asa, 0).when(filters, 1).when(rfc, 2).otherwise(3))
    return (
        F.when(kind == 0, _asa(w, line, received, kind == 0))
        .when(kind == 1, _filter(w, line, received, kind == 1))
        .when(kind == 2, _rfc5424(w, line, received, kind == 2))
        .otherwise(_other(w, raw, received, kind == 3))
    )


SYSLOG = Parser("syslog_rfc_parser", "SYSLOG", takes_syslog, parse)
