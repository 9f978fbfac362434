"""CEF and LEEF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import action, captured, first_of, integer, iso, matched, nonempty, port, strip, to_map
from logloom.operators.classify import takes_cef
from logloom.operators.parsers.base import Parser, Work, confidences, failed, parsed

CEF = r".*?CEF:\s*(\d+)\|" + r"([^|]*)\|" * 6 + "(.*)"
LEEF = r".*?LEEF:\s*([12]\.\d+)\|" + r"([^|]*)\|" * 4 + "(.*)"
PAIRS = r"([a-zA-Z0-9_.-]+)=((?:\\=|[^= ])*+)"  # possessive: a long value takes no stack
SEVERITIES = ("informational", "low", "medium", "high", "critical")


def severity_id(text: Column) -> Column:
    """1 to 5, from a number or a word."""
    n, low = integer(text), F.lower(text)
    by_number = F.when(n >= 8, 5).when(n >= 6, 4).when(n >= 4, 3).when(n >= 2, 2).otherwise(1)
    by_word = F.when(low.contains("crit"), 5).when(low.contains("high"), 4).when(low.contains("med"), 3).when(low.contains("low"), 2).otherwise(1)
    return F.when(n.isNotNull(), by_number).otherwise(by_word)


def severity_label(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), n)


def epoch_time(text: Column, received: Column) -> Column:
    """Milliseconds of 13 digits or seconds of 10, as ISO text; else ``received``."""
    n = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))
    found = F.when(F.length(text) == 13, F.timestamp_millis(n)).when(F.length(text) == 10, F.timestamp_seconds(n))
    return F.coalesce(iso(found), iso(received))


def _cef(w: Work, line: Column, received: Column, here: Column) -> Column:
    g = w.keep(2, "cef", captured(line, CEF, 8, "s"), here)
    text = strip(g[7])
    keys = w.keep(3, "cef_keys", F.regexp_extract_all(text, F.lit(PAIRS), F.lit(1)), here)
    values = F.transform(F.regexp_extract_all(text, F.lit(PAIRS), F.lit(2)), lambda v: strip(F.replace(v, F.lit("\\="), F.lit("="))))
    ext = w.keep(4, "cef_ext", to_map(keys, w.keep(3, "cef_values", values, here)), here)
    src, dst = first_of(ext, "src", "sourceAddress"), first_of(ext, "dst", "destinationAddress")
    spt, dpt = port(first_of(ext, "spt", "sourcePort")), port(first_of(ext, "dpt", "destinationPort"))
    level = w.keep(3, "cef_level", severity_id(strip(g[6])), here)
    more = F.filter(F.map_entries(ext), lambda e: ~e["key"].isin("deviceEventClassId", "cefVersion"))
    own = F.array(F.struct(F.lit("deviceEventClassId").alias("key"), strip(g[4]).alias("value")), F.struct(F.lit("cefVersion").alias("key"), g[0].alias("value")))
    event = parsed(
        timestamp_text=epoch_time(ext["rt"], received), category="network_traffic", type="ids",
        action=action(F.coalesce(first_of(ext, "act", "action"), F.lit("informational")), blocked=("deny", "denied", "block", "drop")),
        severity=severity_label(level), severity_id=level, message=strip(g[5]),
        src_ip=src, src_port=spt, src_host=first_of(ext, "shost", "dhost"), src_user=first_of(ext, "suser", "duser", "srcUser"), dst_ip=dst, dst_port=dpt,
        protocol=F.upper(F.coalesce(first_of(ext, "proto", "app"), F.lit("TCP"))), direction="ingress",
        vendor=F.coalesce(nonempty(strip(g[1])), F.lit("ArcSight")), product=F.coalesce(nonempty(strip(g[2])), F.lit("CEF")), observer_version=strip(g[3]), raw_format="CEF",
        extensions=F.map_from_entries(F.concat(more, own)),
        confidence=confidences(("source.ip", 99, src.isNotNull()), ("destination.ip", 99, dst.isNotNull()), ("source.port", 99, spt.isNotNull()), ("destination.port", 99, dpt.isNotNull()), ("network.protocol", 98, None), ("event.action", 97, None), ("observer.vendor", 99, None), ("observer.product", 99, None)),
    )
    return event


def _leef(w: Work, line: Column, received: Column, here: Column) -> Column:
    g = w.keep(2, "leef", captured(line, LEEF, 6, "s"), here)
    text = strip(g[5])
    tokens = w.keep(3, "leef_tokens", F.filter(F.when(text.contains("\t"), F.split(text, "\t")).otherwise(F.split(text, r"\^")), lambda t: F.instr(t, "=") > 1), here)
    keys = w.keep(4, "leef_keys", F.transform(tokens, lambda t: strip(F.substring_index(t, "=", 1))), here)
    ext = w.keep(5, "leef_ext", to_map(keys, F.transform(tokens, lambda t: strip(t.substr(F.instr(t, "=") + 1, F.length(t))))), here)
    src, dst = first_of(ext, "src", "srcIP"), first_of(ext, "dst", "dstIP")
    spt, dpt = port(first_of(ext, "srcPort", "spt")), port(first_of(ext, "dstPort", "dpt"))
    more = F.filter(F.map_entries(ext), lambda e: ~e["key"].isin("leefVersion", "eventId"))
    own = F.array(F.struct(F.lit("leefVersion").alias("key"), g[0].alias("value")), F.struct(F.lit("eventId").alias("key"), strip(g[4]).alias("value")))
    event = parsed(
        timestamp_text=iso(received), category="network_traffic", type="security_event", action="allowed", severity="medium", severity_id=3,
        message=F.concat(F.lit("LEEF Event: "), strip(g[4])), src_ip=src, src_port=spt, src_user=first_of(ext, "usrName", "accountName"), dst_ip=dst, dst_port=dpt,
        protocol=F.upper(F.coalesce(ext["proto"], F.lit("TCP"))), vendor=strip(g[1]), product=strip(g[2]), observer_version=strip(g[3]), raw_format="LEEF",
        extensions=F.map_from_entries(F.concat(more, own)),
        confidence=confidences(("source.ip", 99, src.isNotNull()), ("destination.ip", 99, dst.isNotNull()), ("source.port", 99, spt.isNotNull()), ("destination.port", 99, dpt.isNotNull()), ("observer.vendor", 99, None), ("observer.product", 99, None)),
    )
    return event


def parse(w: Work, raw: Column, line: Column, received: Column) -> Column:
    cef, leef = raw.contains("CEF:"), raw.contains("LEEF:")
    kind = F.when(cef, F.when(matched(line, CEF, "s"), 0).otherwise(2)).when(leef, F.when(matched(line, LEEF, "s"), 1).otherwise(3)).otherwise(4)
    kind = w.keep(1, "kind", kind)
    return (
        F.when(kind == 0, _cef(w, line, received, kind == 0))
        .when(kind == 1, _leef(w, line, received, kind == 1))
        .when(kind == 2, failed("Malformed CEF header"))
        .when(kind == 3, failed("Malformed LEEF header"))
        .otherwise(failed("Neither CEF nor LEEF header found"))
    )


CEF_LEEF = Parser("cef_leef_parser", "CEF/LEEF", takes_cef, parse)
