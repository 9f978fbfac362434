"""From raw lines to normalized events: one projection without a shuffle."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import blank, internal, strip, those
from logloom.operators import parser_index, sigma
from logloom.operators.classify import classify
from logloom.operators.enrich import service, technique
from logloom.operators.parser_index import ParserIndex
from logloom.operators.parsers.base import FIELDS, Parser, Work
from logloom.operators.parsers.cef_leef import CEF_LEEF
from logloom.operators.parsers.csv_kv import CSV_KV
from logloom.operators.parsers.json import JSON
from logloom.operators.parsers.syslog import SYSLOG
from logloom.plans.config import Config

#: The order in which native parsers are asked.
NATIVE = (SYSLOG, JSON, CEF_LEEF, CSV_KV)


def raw_hash(raw: Column) -> Column:
    return F.sha2(F.coalesce(raw, F.lit("")), 256)


def average_confidence(confidence: Column) -> Column:
    """The mean of hundredths, rounded half up to three digits; zero without fields. Whole numbers keep ties exact."""
    values = F.map_values(confidence)
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(values)
    return F.when(n > 0, F.floor((total * 20 + n) / (n * 2)).cast("double") / 1000).otherwise(F.lit(0.0))


def confidence_tier(average: Column, high: float = 0.90, medium: float = 0.70) -> Column:
    return F.when(average >= high, "HIGH").when(average >= medium, "MEDIUM").otherwise("LOW")


def valid_ip(ip: Column) -> Column:
    """Four groups of digits, or anything with a colon."""
    return F.coalesce(strip(ip).rlike(r"\A([0-9]{1,3}\.){3}[0-9]{1,3}\z") | ip.contains(":"), F.lit(False))


def validation_errors() -> Column:
    """What is wrong with an event, as an array."""
    missing = [(blank(F.col(c)), F.lit(f"Missing required {n}")) for c, n in (("event_id", "eventId"), ("raw_event_id", "rawEventId"), ("raw_hash", "rawHashSha256"), ("timestamp_text", "timestampUtc"))]
    bad = [
        (F.col(f"{side}.ip").isNotNull() & ~valid_ip(F.col(f"{side}.ip")), F.concat(F.lit(f"Invalid {side} IP format: "), F.col(f"{side}.ip")))
        for side in ("source", "destination")
    ]
    return those("string", *missing, *bad)


def _hex_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


class _Steps(list):
    """A projection in steps, each a function of the DataFrame before it. Its Columns are unresolved, so they serve any table."""

    def add(self, columns: dict[str, Column]) -> None:
        self.append(lambda df: df.withColumns(columns))

    def keep(self, *columns: Column | str) -> None:
        self.append(lambda df: df.select(*columns))


_KNOWN: OrderedDict[tuple, _Steps] = OrderedDict()


def normalize(raw: DataFrame, config: Config = Config(), rules: Sequence[sigma.SigmaRule] = sigma.RULES, dynamic: Sequence[Parser] = (), index: ParserIndex | None = None, lookups: str | None = None) -> DataFrame:
    """``raw`` (raw_message, source, received_at, ingest_seq) to one row for each line, with an ``outcome``: NORMAL, or the code
    and reason for which the line is quarantined.

    Ids follow from the line, its source, time and number, so that a task that runs again gives the same ids. Dynamic parsers are
    asked first, by name, those of ``index`` among them; these are looked up by joins (hits go to ``lookups``), so there may be any number. Times that a line lacks are ``received_at``. Null lines are empty lines. The expressions are made once for
    each set of rules, parsers and settings, so the micro-batches of a stream share them.
    """
    key = (raw.sparkSession.sparkContext.applicationId, config, repr(tuple(rules)), tuple(dynamic), index is not None)
    if key not in _KNOWN:
        _KNOWN[key] = _steps(config, rules, dynamic, index is not None)
        if len(_KNOWN) > 8:
            _KNOWN.popitem(last=False)
    if index is not None:
        raw = index.attach(raw, raw_hash(F.col("raw_message")), lookups)
    for step in _KNOWN[key]:
        raw = step(raw)
    return raw


def renormalize(normalized: DataFrame, dynamic: Sequence[Parser], config: Config = Config(), rules: Sequence[sigma.SigmaRule] = sigma.RULES) -> DataFrame:
    """``normalized``, a written table, as ``normalize`` makes it of the same lines under the same settings and rules, with the dynamic parsers of today. All of them are asked
    of every line; a line that none takes, and none took before, would come out as it is, so it stays. The others are parsed again."""
    raw, fmt = F.col("raw_message"), F.coalesce(F.col("class.format"), F.lit("UNKNOWN"))
    takes = [F.coalesce(p.takes(raw, fmt), F.lit(False)) for p in dynamic if p.active]
    before = F.col("parser_name").isNotNull() & ~F.col("parser_name").isin(*[p.name for p in NATIVE])
    again = F.coalesce(reduce(or_, takes, before), F.lit(False))
    lines = normalized.where(again).select("raw_message", F.col("ingestion_source").alias("source"), "received_at", "ingest_seq")
    return normalized.where(~again).unionByName(normalize(lines, config, rules, dynamic))


def _steps(config: Config, rules: Sequence[sigma.SigmaRule], dynamic: Sequence[Parser], indexed: bool = False) -> _Steps:
    steps = _Steps()
    chosen = sorted((p for p in dynamic if p.active), key=lambda p: p.name)
    parsers = [*chosen, *[p for p in NATIVE if p.active]]
    raw_line, line, received = F.col("raw_message"), F.col("line"), F.col("received_at")
    steps.add({"received_at": received.cast("timestamp"), "raw_hash": raw_hash(raw_line), "line": strip(raw_line)})
    steps.add({"class": classify(raw_line, line)})
    fmt = F.coalesce(F.col("class.format"), F.lit("UNKNOWN"))
    route = F.when(raw_line.isNull(), -1)
    for i, p in enumerate(parsers):
        if indexed and i <= len(chosen):  # before the natives, and before those of a later name
            route = route.when(F.col("approved").isNotNull() & ((F.col("approved.name") < p.name) if i < len(chosen) else F.lit(True)), len(parsers))
        route = route.when(F.coalesce(p.takes(raw_line, fmt), F.lit(False)), i)
    steps.add({"route": route.otherwise(-1), "key": _hex_id(F.col("raw_hash"), F.col("source"), F.unix_micros(received), F.col("ingest_seq"))})
    work, body = Work(), F.lit(None).cast(f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>")
    for i, p in reversed([*enumerate(parsers)]):
        here = F.col("route") == i
        body = F.when(here, p.parse(work.of(f"{i}", here), raw_line, line, received)).otherwise(body)
    if indexed:
        here = F.col("route") == len(parsers)
        body = F.when(here, parser_index.parse(work.of("index", here), raw_line, line, received)).otherwise(body)
    for layer in sorted(work.layers):
        steps.add(work.layers[layer])
    # Filters on parsed fields stay above this projection: moved below it, they would repeat the parsers for every field. The
    # partition's number, which is never negative, is what keeps the optimizer from moving them.
    steps.add({"p": F.when(F.spark_partition_id() >= 0, body), "raw_low": F.lower(raw_line)})
    by_route = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("route") + 1) if parsers else F.lit(None).cast("string")
    in_index = lambda field: F.when(F.col("route") == len(parsers), F.col(f"approved.{field}")) if indexed else F.lit(None).cast("string")
    named = lambda values, field: F.coalesce(in_index(field), F.when((F.col("route") >= 0) & (F.col("route") < len(parsers)), by_route(values)))
    p = lambda k: F.col(f"p.{k}")
    inside = lambda ip: F.when(p("error").isNull() & F.col("p").isNotNull(), internal(ip)) if config.ip_classification else F.lit(None).cast("boolean")
    endpoint = lambda s: F.struct(
        p(f"{s}_ip").alias("ip"), p(f"{s}_port").alias("port"), p(f"{s}_host").alias("hostname"), (p("src_user") if s == "src" else F.lit(None).cast("string")).alias("user"), inside(p(f"{s}_ip")).alias("is_internal"), p(f"{s}_zone").alias("zone")
    )
    transport = service(p("dst_port")) if config.port_services else F.lit(None).cast("string")
    threat = technique(p("dst_port"), F.lower(p("action")), F.col("raw_low")) if config.technique_mapping else F.lit(None).cast("struct<risk_score:int,technique_id:string,technique_name:string,tactic:string,category:string>")
    steps.keep(
        F.concat(F.lit("EVT-"), F.regexp_replace(F.substring("key", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).alias("event_id"),
        F.concat(F.lit("RAW-"), F.substring("raw_hash", 1, 8), F.lit("-"), F.substring("key", 33, 8)).alias("raw_event_id"),
        "raw_hash", "raw_message", F.col("source").alias("ingestion_source"), "received_at", "ingest_seq", "class", "route",
        p("error").alias("parse_error"), p("timestamp_text").alias("timestamp_text"),
        F.coalesce(F.when(p("timestamp_text").contains("T"), F.try_to_timestamp(p("timestamp_text"))), received).alias("timestamp_utc"),
        F.struct(*[p(k).alias(k) for k in ("category", "type", "action", "severity", "severity_id", "message")]).alias("event"),
        endpoint("src").alias("source"), endpoint("dst").alias("destination"),
        F.struct(p("protocol").alias("protocol"), p("direction").alias("direction"), transport.alias("transport")).alias("network"),
        F.struct(p("vendor").alias("vendor"), p("product").alias("product"), p("observer_host").alias("hostname"), p("observer_version").alias("version")).alias("observer"),
        threat.alias("technique"), F.struct(raw_line.alias("message"), p("raw_format").alias("format")).alias("raw"), p("extensions").alias("extensions"), p("confidence").alias("confidence"),
        named([x.name for x in parsers], "name").alias("parser_name"), named([x.version for x in parsers], "version").alias("parser_version"), named([x.format_type for x in parsers], "format_type").alias("format"),
    )
    found = sigma.evaluate(rules) if config.sigma else F.array().cast(f"array<{sigma.MATCH}>")
    if config.sigma:
        steps.add(sigma.fields(rules))
        steps.add(sigma.lowered(rules))
    steps.add({"errors": validation_errors(), "sigma_matches": F.when(F.col("parse_error").isNull() & (F.col("route") >= 0), found), "average_confidence": average_confidence(F.col("confidence"))})
    errors = F.col("errors")
    outcome = (
        F.when(F.col("route") < 0, F.struct(F.lit("UNPARSEABLE_FORMAT").alias("code"), F.lit("No parser takes this line").alias("reason"), F.col("class.format").alias("detected_format")))
        .when(F.col("parse_error").isNotNull(), F.struct(F.lit("PARSER_FAILURE").alias("code"), F.col("parse_error").alias("reason"), F.col("format").alias("detected_format")))
        .when(F.size(errors) > 0, F.struct(F.lit("VALIDATION_FAILED").alias("code"), F.array_join(errors, "; ").alias("reason"), F.col("format").alias("detected_format")))
        .otherwise(F.struct(F.lit("NORMAL").alias("code"), F.lit(None).cast("string").alias("reason"), F.col("format").alias("detected_format")))
    )
    steps.keep(
        "event_id", "raw_event_id", "raw_hash", "raw_message", "ingestion_source", "received_at", "ingest_seq", "class", "timestamp_text", "timestamp_utc",
        "event", "source", "destination", "network", "observer", F.struct("technique.*", "sigma_matches").alias("threat"), "raw", "extensions",
        "format", "parser_name", "parser_version", F.transform_values("confidence", lambda k, v: v / 100).alias("mapping_confidence"), "average_confidence",
        confidence_tier(F.col("average_confidence"), config.high_confidence, config.medium_confidence).alias("confidence_tier"), (F.col("average_confidence") < config.medium_confidence).alias("low_confidence"), outcome.alias("outcome"),
    )
    return steps


def events(normalized: DataFrame) -> DataFrame:
    """The rows that are stored."""
    return normalized.where("outcome.code = 'NORMAL'")


def quarantine(normalized: DataFrame) -> DataFrame:
    """The rows that are not, as dead-letter entries."""
    return normalized.where("outcome.code <> 'NORMAL'").select(
        "raw_event_id", "raw_hash", "raw_message", "ingest_seq", F.col("outcome.code").alias("failure_code"), F.col("outcome.reason").alias("failure_reason"),
        F.col("outcome.detected_format").alias("detected_format"), F.lit(0).alias("retry_count"), F.lit("NEW").alias("status"), F.col("received_at").alias("created_at"),
    )
