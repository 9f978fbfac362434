"""Wire formats: CEF, LEEF, ECS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Canonical fields and their names in the Elastic Common Schema.
ECS = {
    "timestampUtc": "@timestamp", "source.ip": "source.ip", "source.port": "source.port", "source.hostname": "source.domain", "source.user": "source.user.name",
    "destination.ip": "destination.ip", "destination.port": "destination.port", "destination.hostname": "destination.domain",
    "network.protocol": "network.transport", "network.direction": "network.direction", "network.bytesIn": "source.bytes", "network.bytesOut": "destination.bytes",
    "event.action": "event.action", "event.category": "event.category", "event.type": "event.type", "event.severity": "event.severity",
    "observer.vendor": "observer.vendor", "observer.product": "observer.product", "observer.hostname": "observer.hostname",
    "threat.techniqueId": "threat.technique.id", "threat.techniqueName": "threat.technique.name", "threat.tactic": "threat.tactic.name", "threat.riskScore": "threat.indicator.confidence",
    "raw.message": "event.original", "rawHashSha256": "event.hash.sha256",
}
#: The schema's version and the categories of events.
SCHEMA_VERSION = "1.1.0-ocsf"
CATEGORIES = ("network_traffic", "authentication", "system_activity", "security_finding")
VENDOR, PRODUCT, VERSION = "Logloom", "Gateway", "1.0"


def escaped(x: Column) -> Column:
    """Pipes, then backslashes, each with a backslash before: a pipe comes out with two backslashes."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\\"), F.lit("\\\\"))


def _header(vendor: str, product: str) -> list[Column]:
    return [escaped(F.coalesce(F.col(f"observer.{k}"), F.lit(v))) for k, v in (("vendor", vendor), ("product", product), ("version", VERSION))]


def _pairs(sep: str, *pairs: tuple[str, Column]) -> Column:
    """key=value of what there is."""
    return F.concat_ws(sep, *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in pairs])


def to_cef(vendor: str = VENDOR, product: str = PRODUCT) -> Column:
    head = [*_header(vendor, product), escaped(F.coalesce("event.type", F.lit("traffic"))), escaped(F.coalesce("event.message", F.lit("Security Event"))), F.coalesce("event.severity_id", F.lit(1)).cast("string")]
    tail = _pairs(
        " ", ("src", F.col("source.ip")), ("spt", F.col("source.port")), ("suser", F.col("source.user")), ("dst", F.col("destination.ip")), ("dpt", F.col("destination.port")),
        ("proto", F.col("network.protocol")), ("act", F.col("event.action")), ("rawHash", F.col("raw_hash")), ("externalId", F.col("event_id")),
    )
    return F.trim(F.concat(F.lit("CEF:0|"), F.concat_ws("|", *head), F.lit("|"), tail))


def to_leef(vendor: str = VENDOR, product: str = PRODUCT) -> Column:
    head = [*_header(vendor, product), escaped(F.coalesce("event.type", F.lit("SecEvent")))]
    tail = _pairs(
        "\t", ("src", F.col("source.ip")), ("srcPort", F.col("source.port")), ("usrName", F.col("source.user")), ("dst", F.col("destination.ip")), ("dstPort", F.col("destination.port")),
        ("proto", F.col("network.protocol")), ("action", F.col("event.action")), ("eventId", F.col("event_id")),
    )
    return F.trim(F.concat(F.lit("LEEF:1.0|"), F.concat_ws("|", *head), F.lit("|"), tail))


def to_ecs() -> Column:
    """A JSON document; what is null is left out, empty objects of source, destination, network and observer stay."""
    s = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    c = F.col
    threat = s(technique=s(id=c("threat.technique_id"), name=c("threat.technique_name")), tactic=F.when(c("threat.tactic").isNotNull(), s(name=c("threat.tactic"))))
    event = s(
        id=c("event_id"), category=c("event.category"), type=c("event.type"), action=c("event.action"), severity=c("event.severity"), reason=c("event.message"), original=c("raw.message"),
        hash=F.when(c("raw_hash").isNotNull(), s(sha256=c("raw_hash"))),
    )
    document = F.struct(
        c("timestamp_text").alias("@timestamp"), event.alias("event"),
        s(ip=c("source.ip"), port=c("source.port"), domain=c("source.hostname"), user=F.when(c("source.user").isNotNull(), s(name=c("source.user")))).alias("source"),
        s(ip=c("destination.ip"), port=c("destination.port"), domain=c("destination.hostname")).alias("destination"),
        s(transport=c("network.protocol"), direction=c("network.direction")).alias("network"),
        s(vendor=c("observer.vendor"), product=c("observer.product"), hostname=c("observer.hostname")).alias("observer"),
        F.when(c("threat.technique_id").isNotNull(), threat).alias("threat"),
    )
    return F.to_json(document)


def taxonomy(schema: StructType) -> dict:
    """What the normalized table holds: version, categories, the type of every field, and the names in ECS."""

    def fields(kind: StructType, prefix: str = "") -> dict[str, str]:
        found = {}
        for f in kind.fields:
            found |= fields(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, StructType) else {prefix + f.name: f.dataType.simpleString()}
        return found

    return {"schema_version": SCHEMA_VERSION, "categories": list(CATEGORIES), "fields": fields(schema), "ecs_aliases": dict(ECS)}


def exported(events: DataFrame, kind: str, event_ids: list[str] | DataFrame | None = None, vendor: str = VENDOR, product: str = PRODUCT) -> DataFrame:
    """(event_id, wire) of all events, of one id, or of many (a list, or a table with event_id); ids that are not stored give no row."""
    if isinstance(event_ids, DataFrame):
        events = events.join(event_ids.select("event_id").distinct(), "event_id", "left_semi")
    elif event_ids is not None:
        events = events.where(F.col("event_id").isin(event_ids))
    return events.select("event_id", to_wire(kind, vendor, product).alias("wire"))


def write_files(events: DataFrame, path: str, kind: str, vendor: str = VENDOR, product: str = PRODUCT) -> None:
    """One event a line, in text files under ``path``."""
    exported(events, kind, None, vendor, product).select("wire").write.mode("overwrite").text(path)


def to_wire(kind: Column | str, vendor: str = VENDOR, product: str = PRODUCT) -> Column:
    """By name of the format, in any case; unknown names give ECS."""
    name = F.lower(kind if isinstance(kind, Column) else F.lit(kind))
    return F.when(name == "cef", to_cef(vendor, product)).when(name == "leef", to_leef(vendor, product)).otherwise(to_ecs())
