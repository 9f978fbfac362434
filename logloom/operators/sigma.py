"""Sigma rules, compiled to boolean Columns: all rules run in one pass over the events."""

from __future__ import annotations

import importlib
import json
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import has_text, those
from logloom.sources.tables import current, upsert, version

MODIFIERS = ("contains", "startswith", "endswith", "re")


@dataclass(frozen=True)
class Criterion:
    field: str
    modifier: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class SigmaRule:
    id: str
    title: str
    level: str = "medium"
    technique: str | None = None
    tactic: str | None = None
    blocks: dict[str, tuple[Criterion, ...]] = field(default_factory=dict)
    condition: str | None = None
    enabled: bool = True
    logsource: dict = field(default_factory=dict)


def parse_rule(spec: dict) -> SigmaRule:
    """A rule from the mapping that its YAML holds. The last technique tag and the last tactic tag count. A block that is no
    mapping has no criteria, so it never matches."""
    technique = tactic = None
    for tag in map(str, spec.get("tags") or []):
        low = tag.lower()
        if low.startswith("attack.t") and low[8:9].isdigit():
            technique = low.removeprefix("attack.").upper()
        elif low.startswith("attack."):
            tactic = " ".join(w.capitalize() for w in low.removeprefix("attack.").replace("-", "_").split("_"))
    detection = spec.get("detection") or {}
    blocks = {}
    for name, block in detection.items():
        if name == "condition":
            continue
        criteria = []
        for key, value in block.items() if isinstance(block, dict) else ():
            name_of, _, mods = str(key).partition("|")
            mod = next((m for m in MODIFIERS if m in mods.lower()), "exact")
            criteria.append(Criterion(name_of, mod, tuple(str(v) for v in (value if isinstance(value, list) else [value]))))
        blocks[name] = tuple(criteria)
    said = str(detection.get("condition", "selection"))
    return SigmaRule(str(spec["id"]), str(spec["title"]), str(spec.get("level") or "medium").lower(), technique, tactic, blocks, said, logsource=spec.get("logsource") or {})


def load_rules(path: str) -> list[SigmaRule]:
    """Rules from the .json and .yml files of a folder that the driver sees, by name. The latter need PyYAML."""
    files = sorted(p for p in Path(path).iterdir() if p.suffix in (".json", ".yml"))
    read = {".json": json.loads} | ({".yml": importlib.import_module("yaml").safe_load} if any(p.suffix == ".yml" for p in files) else {})
    return [parse_rule(read[p.suffix](p.read_text())) for p in files]


_BLOCKED = ["blocked", "denied", "drop", "failed"]


def _bundled(id: str, title: str, level: str, technique: str, tactic: str, **selection) -> SigmaRule:
    block = {k.replace("__", ".").replace("_has", "|contains"): v for k, v in selection.items()}
    return parse_rule({"id": id, "title": title, "level": level, "tags": [f"attack.{technique}", f"attack.{tactic}"], "detection": {"selection": block, "condition": "selection"}})


#: The bundled rules.
RULES = (
    _bundled("SIGMA-T1046-CISCO-002", "Cisco Firewall Teardown or Scan Signature Event", "medium", "t1046", "discovery", raw__message_has=["%ASA-4-106023", "%ASA-2-106001", "106023"]),
    _bundled("SIGMA-T1046-SCAN-001", "Network Service Discovery and Port Scanning", "medium", "t1046", "discovery", raw__message_has=["scan", "sweep", "probe", "portscan", "ET SCAN"]),
    _bundled("SIGMA-T1048-DNS-001", "DNS Tunneling or Exfiltration Query Burst", "high", "t1048", "exfiltration", destination__port=53, raw__message_has=["txt-query", "large-query", "tunnel", "staging"]),
    _bundled("SIGMA-T1071-C2PORT-001", "Outbound Traffic to Known C2 / Trojan Ports", "critical", "t1071", "command_and_control", destination__port=[4444, 1337, 31337, 6667]),
    _bundled("SIGMA-T1071-IRC-002", "IRC or Botnet Protocol Tunneling", "high", "t1071", "command_and_control", destination__port=[6667, 6697], network__protocol=["TCP"]),
    _bundled("SIGMA-T1110-RDP-002", "RDP Remote Desktop Brute Force Attempt", "high", "t1110", "credential_access", destination__port=3389, event__action=_BLOCKED),
    _bundled("SIGMA-T1110-SSH-001", "SSH Brute Force Authentication Failure", "high", "t1110", "credential_access", destination__port=22, event__action=[*_BLOCKED, "failure"]),
    _bundled("SIGMA-T1552-FTP-002", "Cleartext FTP Unsecured Authentication Protocol", "low", "t1552", "credential_access", destination__port=21),
    _bundled("SIGMA-T1552-TELNET-001", "Cleartext Telnet Management Traffic", "medium", "t1552", "credential_access", destination__port=23),
)

#: Where a canonical field of a rule stands in the event.
CANONICAL = {
    "event.category": "event.category", "event.type": "event.type", "event.action": "event.action", "event.severity": "event.severity", "event.message": "event.message",
    "source.ip": "source.ip", "source.port": "source.port", "source.user": "source.user", "source.hostname": "source.hostname",
    "destination.ip": "destination.ip", "destination.port": "destination.port", "destination.hostname": "destination.hostname",
    "network.protocol": "network.protocol", "network.direction": "network.direction", "network.transport": "network.transport",
    "observer.vendor": "observer.vendor", "observer.product": "observer.product", "raw.message": "raw.message",
}
#: Other names of canonical fields.
ALIASES = {
    "destination.port": ("dst_port", "dpt", "port", "destination_port"), "source.port": ("src_port", "spt", "source_port"),
    "destination.ip": ("dst_ip", "dst", "destination_ip"), "source.ip": ("src_ip", "src", "source_ip"), "event.action": ("action", "act", "status"),
    "network.protocol": ("proto", "protocol", "transport"), "event.category": ("category",), "event.type": ("type",),
    "raw.message": ("msg", "message", "raw", "original"), "observer.vendor": ("vendor",), "observer.product": ("product",), "source.user": ("user", "username", "suser"),
}


def value_of(name: str) -> Column:
    """The event's value of a rule's field: an extension of that name, the canonical field, then an alias of one. Blank values
    count as missing, and keyword fields then fall back to the raw line."""
    name = name.lower()
    plain = name.removeprefix("extensions.")
    tries = [F.col("extensions")[plain if name.startswith("extensions.") else name]]
    if name in CANONICAL:
        tries.append(F.col(CANONICAL[name]).cast("string"))
    alias = next((k for k, v in ALIASES.items() if name in v), None)
    if alias:
        tries.append(F.col(CANONICAL[alias]).cast("string"))
    value = F.coalesce(*tries)
    there = has_text(value)
    if name in ("message", "raw", "keywords", "payload"):
        return F.when(there, value).otherwise(F.coalesce(F.col("raw.message"), F.lit("")))
    return F.when(there, value)


def fields(rules: list[SigmaRule] | tuple[SigmaRule, ...]) -> dict[str, Column]:
    """The columns that ``evaluate`` reads: the value of every field that the rules name, and its lower case."""
    names = sorted({c.field.lower() for r in rules if r.enabled for block in r.blocks.values() for c in block})
    return {f"_value_{n}": value_of(n) for n in names}


def lowered(rules: list[SigmaRule] | tuple[SigmaRule, ...]) -> dict[str, Column]:
    return {k.replace("_value_", "_lower_"): F.lower(F.col(f"`{k}`")) for k in fields(rules)}


def compiles(pattern: str) -> bool:
    """Whether Java, whose patterns rules are in, takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except PySparkException:
        return False
    return True


def bad_patterns(rules: list[SigmaRule] | tuple[SigmaRule, ...]) -> list[tuple[str, str]]:
    """(rule id, pattern) of the values that are no patterns. They match nothing; the rest of their rule counts as it is."""
    given = [(r.id, v) for r in rules for block in r.blocks.values() for c in block if c.modifier == "re" for v in c.values]
    return [(rule, v) for rule, v in given if not compiles(v)]


def matches(criterion: Criterion) -> Column:
    """Any value of the list, without regard to case; a missing field is false, never null."""
    value, low = F.col(f"`_value_{criterion.field.lower()}`"), F.col(f"`_lower_{criterion.field.lower()}`")
    if criterion.modifier == "exact":
        return F.coalesce(low.isin(*[v.lower() for v in criterion.values]), F.lit(False))
    tests = {
        "contains": lambda v: low.contains(v.lower()),
        "startswith": lambda v: low.startswith(v.lower()),
        "endswith": lambda v: low.endswith(v.lower()),
        "re": lambda v: value.rlike(f"(?i){v}") if compiles(v) else F.lit(False),
    }
    return F.coalesce(reduce(or_, [tests[criterion.modifier](v) for v in criterion.values], F.lit(False)), F.lit(False))


def condition(rule: SigmaRule) -> Column:
    """The rule's condition over its blocks. The grammar is flat: "1 of", "all of", one "a and not b", "and", "or", "not", a name."""
    false = F.lit(False)
    blocks = {}
    for name, criteria in rule.blocks.items():
        held = F.lit(bool(criteria))
        for c in criteria:
            held &= matches(c)
        blocks[name] = held

    def join(parts: list[Column], every: bool) -> Column:
        out = parts[0] if parts else false
        for p in parts[1:]:
            out = (out & p) if every else (out | p)
        return out

    def one(token: str) -> Column:
        return blocks.get(token.replace("(", "").replace(")", "").strip(), false)

    text = (rule.condition or "").strip().lower()
    if not text or text.startswith(("1 of selection", "1 of them")) or "any of selection" in text:
        return join([*blocks.values()], False)
    if text.startswith(("all of selection", "all of them")):
        return join([*blocks.values()], True)
    parts = text.split(" and not ")
    if len(parts) == 2:
        return one(parts[0]) & ~one(parts[1])
    if " and " in text:
        return join([one(p) for p in text.split(" and ")], True)
    if " or " in text:
        return join([one(p) for p in text.split(" or ")], False)
    return ~one(text[4:]) if text.startswith("not ") else one(text)


MATCH = "struct<rule_id:string,rule_title:string,severity:string,technique_id:string,tactic:string,matched_details:string>"


def evaluate(rules: list[SigmaRule] | tuple[SigmaRule, ...] = RULES) -> Column:
    """The array of matches of all enabled rules, by rule id, over the columns of ``fields`` and ``lowered``."""
    found = []
    for rule, bad in bad_patterns(rules):
        warnings.warn(f"rule {rule}: {bad!r} is no pattern and matches nothing", stacklevel=2)
    for r in sorted((r for r in rules if r.enabled), key=lambda r: r.id):
        values = (r.id, r.title, r.level, r.technique, r.tactic, f"Matched rule {r.title}")
        names = [x.split(":")[0] for x in MATCH[7:-1].split(",")]
        found.append((condition(r), F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, values, strict=True)])))
    return those(MATCH, *found)


def alerts(normalized: DataFrame) -> DataFrame:
    """One row for each match of each stored event."""
    return normalized.select(
        "event_id", "raw_event_id", F.inline("threat.sigma_matches"), F.col("source.ip").alias("source_ip"), F.col("destination.ip").alias("destination_ip"), F.col("received_at").alias("matched_at")
    )


def rule_text(rule: SigmaRule) -> str:
    return json.dumps(asdict(rule), sort_keys=True)


def rule_from_text(text: str) -> SigmaRule:
    given = json.loads(text)
    blocks = {k: tuple(Criterion(c["field"], c["modifier"], tuple(c["values"])) for c in v) for k, v in given.pop("blocks").items()}
    return SigmaRule(**given, blocks=blocks)


class RuleStore:
    """Rules by id: upsert, toggle, delete. Plans that are built afterwards see the change; ``save`` keeps it in a table, for engines that run
    and for those to come."""

    def __init__(self, rules: tuple[SigmaRule, ...] = RULES):
        self._rules = {r.id: r for r in rules}
        self._versions: dict[str, int] = {}
        self._changed: set[str] = set(self._rules)

    def upsert(self, rule: SigmaRule) -> None:
        self._rules[rule.id] = rule
        self._changed.add(rule.id)

    def toggle(self, rule_id: str, enabled: bool) -> None:
        self.upsert(replace(self._rules[rule_id], enabled=enabled))

    def delete(self, rule_id: str) -> None:
        if self._rules.pop(rule_id, None) is not None:
            self._changed.add(rule_id)

    def rules(self) -> list[SigmaRule]:
        return [r for _, r in sorted(self._rules.items())]

    def save(self, spark: SparkSession, path: str) -> int:
        """Writes a new version (rule_id, version, deleted, body) of each rule that has changed; returns how many. Earlier versions stay."""
        rows = []
        for i in sorted(self._changed):
            self._versions[i] = self._versions.get(i, 0) + 1
            rows.append((i, self._versions[i], i not in self._rules, rule_text(self._rules[i]) if i in self._rules else None))
        self._changed.clear()
        if rows:
            upsert(spark.createDataFrame(rows, "rule_id string, version int, deleted boolean, body string"), path, ["rule_id", "version"], buckets=1)
        return len(rows)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RuleStore:
        """The latest versions of the rules in a table; the bundled rules where there is no table yet."""
        rows, found = current(spark, path), cls()
        if rows is not None:
            found._rules, found._changed = {}, set()
            latest = rows.groupBy("rule_id").agg(F.max_by(F.struct("version", "deleted", "body"), "version").alias("x"))
            for r in latest.select("rule_id", "x.*").collect():  # as many rows as rules, which the driver compiles
                found._versions[r.rule_id] = r.version
                if not r.deleted:
                    found._rules[r.rule_id] = rule_from_text(r.body)
        return found


def stored_rules(spark: SparkSession, path: str) -> Callable[[], list[SigmaRule]]:
    """Asks for the rules in a table; they are read again only when the table has a new version."""
    seen: dict[str, object] = {"version": None, "rules": list(RULES)}

    def ask() -> list[SigmaRule]:
        now = version(spark, path)
        if now != seen["version"]:
            seen.update(version=now, rules=RuleStore.load(spark, path).rules())
        return seen["rules"]

    return ask
