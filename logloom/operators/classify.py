"""Format classification and parser routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import blank, n_columns, strip, whole

#: Formats, their confidence and signature.
FORMATS = {
    "empty": ("UNKNOWN", 0.0, "EMPTY_STRING", "Log payload is empty or blank"),
    "cef": ("CEF", 0.99, "CEF_HEADER_PREFIX", "ArcSight Common Event Format signature detected"),
    "leef": ("LEEF", 0.99, "LEEF_HEADER_PREFIX", "Log Event Extended Format (LEEF) signature detected"),
    "json": ("JSON", 0.98, "JSON_STRUCTURE", "Valid JSON envelope boundary detected"),
    "rfc5424": ("SYSLOG_RFC5424", 0.98, "RFC5424_PRI_VERSION", "Syslog RFC 5424 PRI header with version 1 detected"),
    "rfc3164": ("SYSLOG_RFC3164", 0.95, "RFC3164_PRI_OR_CISCO_FACILITY", "Syslog BSD RFC 3164 or Cisco facility header detected"),
    "bsd": ("SYSLOG_RFC3164", 0.90, "BSD_TIMESTAMP_HEADER", "BSD timestamp prefix detected"),
    "csv": ("CSV", 0.85, "COMMA_DELIMITED_ROW", "Multi-column comma-separated record detected"),
    "unknown": ("UNKNOWN", 0.30, "UNRECOGNIZED_SIGNATURE", "No standard perimeter header signature matched; routing to Inference Engine"),
}
_BSD = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+.*"


def json_envelope(line: Column) -> Column:
    return (line.startswith("{") & line.endswith("}")) | (line.startswith("[") & line.endswith("]"))


def classify(raw: Column, stripped: Column | None = None) -> Column:
    """A struct (format, confidence, signature, details) for a raw line. Tests run in a fixed order; each is on the entire
    stripped line, which may be given as a column that is made already, and ``.`` stops at line ends. A null or blank line is UNKNOWN with confidence zero."""
    line = strip(raw) if stripped is None else stripped
    named = {
        k: F.struct(F.lit(f).alias("format"), F.lit(c).alias("confidence"), F.lit(s).alias("signature"), F.lit(d).alias("details"))
        for k, (f, c, s, d) in FORMATS.items()
    }
    return (
        F.when(blank(raw), named["empty"])
        .when(line.contains("CEF:") & line.rlike(whole(r".*CEF:\s*\d+\|.*")), named["cef"])
        .when(line.contains("LEEF:") & line.rlike(whole(r".*LEEF:\s*[12]\.\d+\|.*")), named["leef"])
        .when(json_envelope(line), named["json"])
        .when(line.rlike(whole(r"<\d{1,3}>1\s+\S+\s+\S+.*")), named["rfc5424"])
        .when(line.rlike(whole(rf"<\d{{1,3}}>{_BSD}")) | (line.contains("%ASA-") & line.rlike(whole(r".*%ASA-\d-\d+:.*"))), named["rfc3164"])
        .when(line.rlike(whole(_BSD)), named["bsd"])
        .when(n_columns(line) >= 5, named["csv"])
        .otherwise(named["unknown"])
    )


def takes_syslog(raw: Column, fmt: Column) -> Column:
    return fmt.startswith("SYSLOG") | raw.contains("%ASA-") | raw.contains("IPTABLES") | raw.contains("kernel:") | raw.startswith("<")


def takes_json(raw: Column, fmt: Column) -> Column:
    return (fmt == "JSON") | json_envelope(strip(raw))


def takes_cef(raw: Column, fmt: Column) -> Column:
    return fmt.isin("CEF", "LEEF") | raw.contains("CEF:") | raw.contains("LEEF:")


def takes_csv(raw: Column, fmt: Column) -> Column:
    return (fmt == "CSV") | (n_columns(raw) >= 5) | (raw.contains("=") & raw.contains("src"))
