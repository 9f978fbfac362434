"""Parsers made at run time from a pattern with named groups and a mapping of groups to fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import action, captured, integer, iso, nonempty, strip, whole
from logloom.operators.parsers.base import Parser, Work, parsed

_GROUP = re.compile(r"\\Q.*?(?:\\E|\Z)|\\.|\[(?:\\.|[^\]\\])*\]|\(\?<([a-zA-Z][a-zA-Z0-9]*)>|\((?!\?)", re.DOTALL)


@dataclass(frozen=True)
class FieldMapping:
    slot: str
    path: str
    inferred_type: str = "STRING"
    confidence: float | None = None
    sample: str | None = None
    user_overridden: bool = False


@dataclass(frozen=True)
class DynamicParser:
    """What the registry keeps of an approved parser."""

    name: str
    pattern: str
    mappings: tuple[FieldMapping, ...] = field(default=())
    confidence: float = 0.9
    version: str = "1.0"
    format_type: str = "CUSTOM"
    display_name: str | None = None
    template: str | None = None
    active: bool = True


def group_numbers(pattern: str) -> tuple[dict[str, int], int]:
    """The number of each named group, and how many groups there are; quoted parts and classes hold none."""
    names, n = {}, 0
    for m in _GROUP.finditer(pattern):
        if m[0].startswith("("):
            n += 1
            if m[1]:
                names[m[1]] = n
    return names, n


def _after_key(x: Column) -> Column:
    return F.regexp_replace(x, r"^[a-zA-Z0-9_.-]+=", "")


def ip_only(x: Column) -> Column:
    """Without key, port and zone."""
    plain = _after_key(x)
    zone = lambda v: F.regexp_replace(v, r"^[a-zA-Z0-9_-]+:", "")
    return F.when(plain.contains(":") & ~plain.startswith("http"), zone(F.substring_index(plain, ":", 1))).when(plain.contains("/"), zone(F.substring_index(plain, "/", 1))).otherwise(zone(plain))


def port_only(x: Column) -> Column:
    """The number after the last colon, or else slash, or all of it."""
    plain = _after_key(x)
    tail = F.when(plain.contains(":"), F.substring_index(plain, ":", -1)).when(plain.contains("/"), F.substring_index(plain, "/", -1)).otherwise(plain)
    return integer(tail)


@lru_cache(256)
def dynamic(spec: DynamicParser) -> Parser:
    """A parser whose expressions are made from the registry's row. Of mappings to one path the last that has a value wins."""
    names, n = group_numbers(spec.pattern)

    def takes(raw: Column, fmt: Column) -> Column:
        return F.coalesce(strip(raw).rlike(whole(spec.pattern, "i")), F.lit(False))

    def parse(w: Work, raw: Column, line: Column, received: Column) -> Column:
        g = w.keep(1, "groups", captured(line, spec.pattern, n, "i")) if n else F.array()
        slots = []
        for i, m in enumerate(spec.mappings):
            at = names.get(m.slot) or names.get(m.slot.replace("_", ""))
            if at:
                slots.append((m, w.keep(2, f"slot{i}", strip(F.regexp_replace(nonempty(g[at - 1]), r"""[\[\](),"';]""", "")))))

        def last(path: str, make, default: Column) -> Column:
            found = [make(v) for m, v in slots if m.path == path]
            return F.coalesce(*found[::-1], default) if found else default

        none = F.lit(None).cast("string")
        ports = {"source": F.lit(None).cast("int"), "destination": F.lit(None).cast("int")}
        for m, v in slots:
            side, _, kind = m.path.partition(".")
            if side in ports and kind == "port":
                ports[side] = F.coalesce(port_only(v), ports[side])
            elif side in ports and kind == "ip":
                ports[side] = F.coalesce(F.when(v.contains(":") | v.contains("/"), port_only(v)), ports[side])
        act = w.keep(3, "act", last("event.action", lambda v: action(_after_key(v)), F.lit("allowed")))
        proto = last("network.protocol", lambda v: F.upper(_after_key(v)), F.lit("TCP"))
        blocked = act == "blocked"
        canonical = {"source.ip", "destination.ip", "source.port", "destination.port", "network.protocol", "event.action", "source.user", "timestampUtc"}
        entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
        more = [F.when(v.isNotNull(), entry(m.slot, v)) for m, v in slots if m.path not in canonical]
        extensions = F.map_from_entries(F.filter(F.array(*more), lambda x: x.isNotNull())) if more else F.create_map().cast("map<string,string>")
        sure = {}
        for m, v in slots:  # a later value of the same path replaces the confidence of an earlier one
            n100 = round(100 * (spec.confidence if m.confidence is None else m.confidence))
            sure[m.path] = F.when(v.isNotNull(), F.lit(n100)).otherwise(sure.get(m.path, F.lit(None).cast("int")))
        pairs = [F.when(v.isNotNull(), entry(k, v)) for k, v in sure.items()]
        confidence = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())) if pairs else F.create_map().cast("map<string,int>")
        return parsed(
            timestamp_text=last("timestampUtc", lambda v: v, iso(received)), category="network_traffic", type="firewall", action=act,
            severity=F.when(blocked, "high").otherwise("informational"), severity_id=F.when(blocked, 4).otherwise(1),
            message=F.concat(F.lit("Dynamic Log: "), act, F.lit(" "), proto), src_ip=last("source.ip", ip_only, none), src_port=ports["source"], src_user=last("source.user", _after_key, none),
            dst_ip=last("destination.ip", ip_only, none), dst_port=ports["destination"], protocol=proto, direction="egress", vendor="DynamicVendor", product=spec.name,
            raw_format=spec.format_type, extensions=extensions, confidence=confidence,
        )

    return Parser(spec.name, spec.format_type, takes, parse, spec.version, spec.active, spec.confidence if spec.confidence > 0 else 0.90)
