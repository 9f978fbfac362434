"""Offline enrichment: services by port, technique by heuristic rules."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Service names by port.
PORTS = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 43: "WHOIS", 53: "DNS", 67: "DHCP-SERVER", 68: "DHCP-CLIENT", 69: "TFTP",
    80: "HTTP", 88: "KERBEROS", 110: "POP3", 123: "NTP", 135: "MS-RPC", 137: "NETBIOS-NS", 138: "NETBIOS-DGM", 139: "NETBIOS-SSN", 143: "IMAP",
    161: "SNMP", 162: "SNMP-TRAP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 514: "SYSLOG", 587: "SMTP-SUBMISSION", 636: "LDAPS",
    853: "DNS-OVER-TLS", 993: "IMAPS", 995: "POP3S", 1433: "MS-SQL", 1521: "ORACLE-DB", 1812: "RADIUS-AUTH", 1813: "RADIUS-ACCT", 2049: "NFS",
    3306: "MYSQL", 3389: "RDP", 5060: "SIP", 5432: "POSTGRESQL", 5900: "VNC", 5985: "WINRM-HTTP", 5986: "WINRM-HTTPS", 6379: "REDIS",
    8080: "HTTP-PROXY", 8443: "HTTPS-ALT", 9200: "ELASTICSEARCH", 9092: "KAFKA", 27017: "MONGODB",
}


@dataclass(frozen=True)
class TechniqueRule:
    """Holds by port and action (PORT_ACTION), keyword or port (KEYWORD_OR_PORT), or port (PORT, SUSPICIOUS_PORT). A list that is
    missing counts as met, so a KEYWORD_OR_PORT rule without ports holds for every event."""

    id: str
    condition: str
    technique_id: str
    technique_name: str
    tactic: str
    category: str
    risk_score: int
    ports: tuple[int, ...] | None = None
    actions: tuple[str, ...] | None = None
    keywords: tuple[str, ...] | None = None


#: The rules, first match first.
TECHNIQUES = (
    TechniqueRule("RULE-MITRE-001", "PORT_ACTION", "T1110", "Brute Force", "Credential Access", "authentication_brute_force", 75, (22, 3389), ("blocked", "denied", "drop", "failure", "failed")),
    TechniqueRule("RULE-MITRE-002", "KEYWORD_OR_PORT", "T1046", "Network Service Discovery", "Discovery", "port_scanning", 70, keywords=("scan", "sweep", "probe", "portscan", "106023")),
    TechniqueRule("RULE-MITRE-003", "SUSPICIOUS_PORT", "T1071", "Application Layer Protocol", "Command and Control", "c2_traffic", 85, (4444, 1337, 31337, 6667)),
    TechniqueRule("RULE-MITRE-004", "PORT", "T1552", "Unsecured Credentials", "Credential Access", "cleartext_protocol", 60, (21, 23)),
    TechniqueRule("RULE-MITRE-005", "KEYWORD_OR_PORT", "T1048", "Exfiltration Over Alternative Protocol", "Exfiltration", "dns_exfiltration", 80, (53,), keywords=("txt-query", "large-query", "tunnel")),
)


def load_ports(text: str) -> dict[int, str]:
    return {int(k): v for k, v in json.loads(text).items()}


def load_techniques(text: str) -> tuple[TechniqueRule, ...]:
    """Rules from a JSON list with the keys of the public rule files (camel case)."""
    some = lambda x: tuple(x) if x is not None else None
    return tuple(
        TechniqueRule(r["id"], r["conditionType"], r["techniqueId"], r.get("techniqueName"), r.get("tactic"), r.get("category"), r.get("riskScore", 0), some(r.get("destinationPorts")), some(r.get("actions")), some(r.get("keywords")))
        for r in json.loads(text)
    )


def service(port: Column, ports: dict[int, str] = PORTS) -> Column:
    """The service name of a port. The table is a literal of the plan, so no join is needed."""
    names = F.create_map(*[F.lit(x) for k, v in ports.items() for x in (k, v)])
    return F.when(port.isNotNull(), F.try_element_at(names, port))


def _holds(rule: TechniqueRule, port: Column, action: Column, raw: Column) -> Column:
    yes = F.lit(True)
    has = lambda x, words: F.coalesce(reduce(or_, [x.contains(w.lower()) for w in words]), F.lit(False))
    by_port = yes if rule.ports is None else F.coalesce(port.isin(*rule.ports), F.lit(False))
    by_action = yes if rule.actions is None else has(action, rule.actions)
    by_word = yes if rule.keywords is None else has(raw, rule.keywords)
    kind = rule.condition.upper()
    if kind == "PORT_ACTION":
        return by_port & by_action
    return (by_port | by_word) if kind == "KEYWORD_OR_PORT" else (by_port & port.isNotNull())


def technique(port: Column, action: Column, raw: Column, rules: tuple[TechniqueRule, ...] = TECHNIQUES) -> Column:
    """The struct of the first rule that holds, else null. ``action`` and ``raw`` are in lower case."""
    out = None
    for r in rules:
        found = F.struct(
            F.lit(r.risk_score).alias("risk_score"), F.lit(r.technique_id).alias("technique_id"), F.lit(r.technique_name).alias("technique_name"), F.lit(r.tactic).alias("tactic"), F.lit(r.category).alias("category")
        )
        out = F.when(_holds(r, port, action, raw), found) if out is None else out.when(_holds(r, port, action, raw), found)
    return out
