"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """What the gateway's runtime rules set; a run keeps one."""

    ip_classification: bool = True
    port_services: bool = True
    technique_mapping: bool = True
    sigma: bool = True
    medium_confidence: float = 0.70
    high_confidence: float = 0.90
    correlation_minutes: int = 30
    drift_drop: float = 0.15
    drift_success: float = 0.85
    export_vendor: str = "Logloom"
    export_product: str = "Gateway"


#: Keys of the runtime rules that are settings here.
RULE_KEYS = {
    "CONFIDENCE_HIGH_THRESHOLD": ("high_confidence", float),
    "CONFIDENCE_MEDIUM_THRESHOLD": ("medium_confidence", float),
    "ENRICHMENT_RFC1918_ENABLED": ("ip_classification", bool),
    "ENRICHMENT_MITRE_ENABLED": ("technique_mapping", bool),
    "rules.sigma.enabled": ("sigma", bool),
}


def config_from_rules(rows: list[dict]) -> Config:
    """Runtime rules (key, value, enabled) over the defaults; disabled rules and unknown keys count as not given."""
    given = {}
    for r in rows:
        if r.get("enabled", True) and r["key"] in RULE_KEYS:
            name, kind = RULE_KEYS[r["key"]]
            given[name] = str(r["value"]).strip().lower() == "true" if kind is bool else float(r["value"])
    return Config(**given)
