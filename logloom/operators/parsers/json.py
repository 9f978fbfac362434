"""JSON: CloudTrail, Suricata EVE, and anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import MAP, action, blank, integer, iso
from logloom.operators.classify import takes_json
from logloom.operators.parsers.base import Parser, Work, confidences, failed, parsed

_STRICT = {"allowSingleQuotes": "false"}


def root(line: Column) -> Column:
    """The fields of an object, or of an array's first element, as texts; nested values are JSON. Values that are no object
    have no fields; text that is no JSON is null."""
    items = F.from_json(line, "array<string>", _STRICT)
    none = F.create_map().cast(MAP)
    first = F.when(F.size(items) > 0, F.coalesce(F.from_json(F.get_json_object(line, "$[0]"), MAP, _STRICT), none)).otherwise(none)
    return F.when(line.startswith("["), F.when(items.isNotNull(), first)).otherwise(F.from_json(line, MAP, _STRICT))


def _has(m: Column, *keys: str) -> Column:
    found = F.lit(False)
    for k in keys:
        found |= F.map_contains_key(m, F.lit(k))
    return found


def _lossless(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.coalesce(v, F.lit("null")))


def _cloudtrail(m: Column, received: Column) -> Column:
    source, name = F.coalesce(m["eventSource"], F.lit("aws.cloudtrail")), F.coalesce(m["eventName"], F.lit("API-Call"))
    user = F.coalesce(F.get_json_object(m["userIdentity"], "$.userName"), F.get_json_object(m["userIdentity"], "$.principalId"))
    bad = ~blank(m["errorCode"])
    return parsed(
        timestamp_text=F.coalesce(m["eventTime"], iso(received)), category="system_activity", type="cloud_audit",
        action=F.when(bad, "blocked").otherwise("allowed"), severity=F.when(bad, "medium").otherwise("informational"), severity_id=F.when(bad, 3).otherwise(1),
        message=F.concat(F.lit("AWS "), source, F.lit(" - "), name), src_ip=m["sourceIPAddress"], src_user=user, dst_host=source,
        vendor="AWS", product="CloudTrail", observer_version=m["awsRegion"], raw_format="JSON", extensions=_lossless(m),
        confidence=confidences(("source.ip", 98, m["sourceIPAddress"].isNotNull()), ("source.user", 95, user.isNotNull()), ("event.action", 95, None), ("observer.vendor", 99, None)),
    )


def _eve(w: Work, m: Column, received: Column, here: Column) -> Column:
    # What is no number, or none that fits 32 bits, is the default.
    number = lambda x, default: F.coalesce(x.try_cast("double").try_cast("int"), F.lit(default))
    spt, dpt = number(m["src_port"], 0), number(m["dest_port"], 0)
    alert = _has(m, "alert")
    field = lambda k: F.get_json_object(m["alert"], f"$.{k}")
    level = w.keep(3, "eve_severity", number(field("severity"), 3), here)
    level = w.keep(4, "eve_level", F.when(~alert, 1).when(level == 1, 5).when(level == 2, 4).otherwise(3), here)
    plain = F.concat(F.lit("Suricata Event: "), F.coalesce(m["event_type"], F.lit("alert")))
    return parsed(
        timestamp_text=F.coalesce(m["timestamp"], iso(received)), category="network_traffic", type="ids",
        action=F.when(alert & F.lower(F.coalesce(field("action"), F.lit("allowed"))).isin("blocked", "drop"), "blocked").otherwise("allowed"),
        severity=F.when(~alert, "informational").when(level >= 4, "high").otherwise("medium"), severity_id=level, message=F.when(alert, F.coalesce(field("signature"), plain)).otherwise(plain),
        src_ip=m["src_ip"], src_port=F.when(spt > 0, spt), dst_ip=m["dest_ip"], dst_port=F.when(dpt > 0, dpt), protocol=F.upper(F.coalesce(m["proto"], F.lit("TCP"))),
        vendor="Suricata", product="EVE", raw_format="JSON", extensions=_lossless(m),
        confidence=confidences(("source.ip", 99, m["src_ip"].isNotNull()), ("destination.ip", 99, m["dest_ip"].isNotNull()), ("source.port", 99, spt > 0), ("destination.port", 99, dpt > 0), ("network.protocol", 99, None), ("event.action", 96, None)),
    )


def _other(w: Work, m: Column, received: Column, here: Column) -> Column:
    text = lambda *keys: F.coalesce(*[m[k] for k in keys])
    whole = lambda *keys: F.coalesce(*[integer(m[k]) for k in keys])
    src = text("src_ip", "source_ip", "src", "client_ip", "sourceAddress")
    dst = text("dst_ip", "dest_ip", "destination_ip", "dst", "server_ip", "destinationAddress")
    spt, dpt = whole("src_port", "source_port", "spt"), whole("dst_port", "dest_port", "destination_port", "dpt")
    said = text("action", "act", "status", "decision")
    act = w.keep(3, "act", F.coalesce(action(said, blocked=("deny", "block", "drop"), allowed=("allow", "accept", "pass")), F.lit("informational")), here)
    blocked = act == "blocked"
    return parsed(
        timestamp_text=F.coalesce(text("timestamp", "time", "@timestamp", "date"), iso(received)), category="network_traffic", type="generic_json", action=act,
        severity=F.when(blocked, "medium").otherwise("informational"), severity_id=F.when(blocked, 3).otherwise(1),
        message=F.coalesce(text("message", "msg", "log", "description"), F.lit("JSON Security Log")), src_ip=src, src_port=spt, src_user=text("user", "username", "account", "src_user"),
        dst_ip=dst, dst_port=dpt, protocol=F.upper(F.coalesce(text("protocol", "proto", "transport"), F.lit("TCP"))), vendor="Generic", product="JSON", raw_format="JSON", extensions=_lossless(m),
        confidence=confidences(("source.ip", 90, src.isNotNull()), ("destination.ip", 90, dst.isNotNull()), ("source.port", 90, spt.isNotNull()), ("destination.port", 90, dpt.isNotNull()), ("event.action", 85, said.isNotNull())),
    )


def parse(w: Work, raw: Column, line: Column, received: Column) -> Column:
    m = w.keep(1, "root", root(line))
    kind = F.when(m.isNull(), 3).when(_has(m, "eventSource", "awsRegion", "userIdentity"), 0).when(_has(m, "event_type", "flow_id") | (_has(m, "src_ip") & _has(m, "dest_ip")), 1).otherwise(2)
    kind = w.keep(2, "kind", kind)
    return (
        F.when(kind == 3, failed("JSON parse error"))
        .when(kind == 0, _cloudtrail(m, received))
        .when(kind == 1, _eve(w, m, received, kind == 1))
        .otherwise(_other(w, m, received, kind == 2))
    )


JSON = Parser("json_generic_parser", "JSON", takes_json, parse)
