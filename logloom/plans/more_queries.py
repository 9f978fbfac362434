"""Queries over further families of lines, and over rules, tokens and status logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import correlate, infer, lineage, search, sigma
from logloom.operators.export import escaped
from logloom.plans.normalize import events, normalize
from logloom.plans.oracle import detected, expected
from logloom.plans.queries import _KNOWN, _batches, _detections, _parsed_columns, normalized, query, seq, stored
from logloom.plans.raw_logs import BASE, lines_table, raw_logs
from logloom.sources.tables import materialised, table

FURTHER = """SELECT event_id, ts, CASE event_id % 5
 WHEN 0 THEN concat('<34>1 2026-01-05T10:32:21Z host', CAST(event_id % 7 AS {S}), ' app', CAST(event_id % 3 AS {S}), ' 77 ID47 [x@1 a="b"] action=', act, ' src_ip=', src, ' dst_ip=', dst, ' src_port=', spt, ' dst_port=', dpt, ' protocol=', proto)
 WHEN 1 THEN concat('<13>gateway event action=', act, ' srcip=', src, ' dstip=', dst, ' srcport=', spt, ' dstport="', dpt, '"')
 WHEN 2 THEN concat('{{"eventTime":"2026-01-05T10:32:21Z","eventSource":"iam.amazonaws.com","eventName":"E","awsRegion":"us-east-1","sourceIPAddress":"', src, '","userIdentity":{{"userName":"', usr, '"}}', CASE WHEN act IN ('deny','drop') THEN ',"errorCode":"Denied"' ELSE '' END, '}}')
 WHEN 3 THEN concat('{{"client_ip":"', src, '","server_ip":"', dst, '","spt":', spt, ',"destination_port":"', dpt, '","decision":"', act, '","username":"', usr, '","transport":"', proto, '"}}')
 ELSE concat('LEEF:2.0|Acme|SIEM|7.4|Login|src=', src, '^dst=', dst, '^srcPort=', spt, '^dstPort=', dpt, '^accountName=', usr) END AS raw_message FROM base"""


def further_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 5424, plain syslog, CloudTrail, plain JSON, and LEEF with carets, in equal parts."""
    return lines_table(spark, sf_dir, f"WITH base AS ({BASE}) {FURTHER}".format(S="STRING"))


def further(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir + "#further")
    if key not in _KNOWN:
        _KNOWN[key] = materialised(normalize(further_logs(spark, sf_dir)), "further")
    return _KNOWN[key]


_BASE = BASE.format(S="VARCHAR")
_TIME = "CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END"


def _of_kind(kind: int, **given: str) -> str:
    """SQL of what lines of a kind should give; texts are SQL, what isn't given is null."""
    blocked = "CASE WHEN act IN ('deny', 'drop') THEN 'blocked' ELSE 'allowed' END"
    values = {
        "action": blocked, "severity": "'informational'", "severity_id": "1", "src_ip": "src", "spt": "CAST(spt AS INTEGER)", "dst_ip": "dst", "dpt": "CAST(dpt AS INTEGER)", "proto": "upper(proto)", "usr": "NULL", "vendor": "NULL",
        "product": "NULL", "version": "NULL", "observer_host": "NULL", "type": "NULL", "direction": "NULL", "time_text": "'2026-01-05T10:32:21Z'",
    } | given
    return f"WITH base AS ({_BASE}) SELECT event_id AS seq, {', '.join(f'{v} AS {k}' for k, v in values.items())} FROM base WHERE event_id % 5 = {kind}"


_MEDIUM = {"severity": "CASE WHEN act IN ('deny', 'drop') THEN 'medium' ELSE 'informational' END", "severity_id": "CASE WHEN act IN ('deny', 'drop') THEN 3 ELSE 1 END"}


@query(_of_kind(0, vendor="'GenericSyslog'", product="concat('app', event_id % 3)", observer_host="concat('host', event_id % 7)", type="'syslog_rfc5424'"))
def prs3_rfc5424(spark, sf_dir):
    return _parsed_columns(further(spark, sf_dir).where("event.type = 'syslog_rfc5424'"))


@query(_of_kind(1, proto="'IP'", vendor="'Syslog'", product="'Generic'", type="'syslog'", time_text=_TIME))
def prs4_plain_syslog(spark, sf_dir):
    return _parsed_columns(further(spark, sf_dir).where("event.type = 'syslog'"))


@query(_of_kind(2, **_MEDIUM, spt="CAST(NULL AS INTEGER)", dst_ip="NULL", dpt="CAST(NULL AS INTEGER)", proto="NULL", usr="usr", vendor="'AWS'", product="'CloudTrail'", version="'us-east-1'", type="'cloud_audit'"))
def prs10_cloudtrail(spark, sf_dir):
    return _parsed_columns(further(spark, sf_dir).where("observer.product = 'CloudTrail'"))


@query(_of_kind(3, **_MEDIUM, action="CASE WHEN act IN ('deny', 'drop') THEN 'blocked' WHEN act = 'permit' THEN 'permit' ELSE 'allowed' END", usr="usr", vendor="'Generic'", product="'JSON'", type="'generic_json'", time_text=_TIME))
def prs12_plain_json(spark, sf_dir):
    return _parsed_columns(further(spark, sf_dir).where("event.type = 'generic_json'"))


@query(_of_kind(4, action="'allowed'", severity="'medium'", severity_id="3", proto="'TCP'", usr="usr", vendor="'Acme'", product="'SIEM'", version="'7.4'", type="'security_event'", time_text=_TIME))
def prs6_leef_carets(spark, sf_dir):
    return _parsed_columns(further(spark, sf_dir).where("event.type = 'security_event'"))


@query("SELECT CASE event_id % 5 WHEN 0 THEN 0.938 WHEN 1 THEN 0.883 WHEN 2 THEN 0.968 WHEN 3 THEN 0.89 ELSE 0.99 END::DOUBLE AS confidence, CASE WHEN event_id % 5 IN (1, 3) THEN 'MEDIUM' ELSE 'HIGH' END AS tier, count(*) AS n FROM events GROUP BY ALL")
def scr2_tiers(spark, sf_dir):
    return further(spark, sf_dir).groupBy(F.col("average_confidence").alias("confidence"), F.col("confidence_tier").alias("tier")).agg(F.count("*").alias("n"))


_CONDITIONS = {
    "a and not b": "dpt IN (22, 23) AND NOT action = 'blocked'", "a or b": "dpt IN (22, 23) OR action = 'blocked'", "a and b": "dpt IN (22, 23) AND action = 'blocked'", "not a": "dpt NOT IN (22, 23)",
    "1 of them": "dpt IN (22, 23) OR action = 'blocked' OR usr LIKE 'u1%' OR src_ip LIKE '%.7'", "all of them": "dpt IN (22, 23) AND action = 'blocked' AND usr LIKE 'u1%' AND src_ip LIKE '%.7'", "c": "usr LIKE 'u1%'", "d": "src_ip LIKE '%.7'",
}


@query(expected(" UNION ALL ".join(f"SELECT '{c}' AS rule_id, count(*) AS n FROM n WHERE coalesce({sql}, false) HAVING count(*) > 0" for c, sql in _CONDITIONS.items())))
def sig5_conditions(spark, sf_dir):
    """Rules of several blocks with every kind of condition and modifier, over the stored events."""
    blocks = {"a": {"dst_port": [22, 23]}, "b": {"event.action": "BLOCKED"}, "c": {"user|startswith": "U1"}, "d": {"source.ip|re": r"\.7$"}}
    rules = [sigma.parse_rule({"id": c, "title": c, "detection": {**blocks, "condition": c}}) for c in _CONDITIONS]
    rows = stored(spark, sf_dir).withColumns(sigma.fields(rules)).withColumns(sigma.lowered(rules))
    return rows.select(F.explode(sigma.evaluate(rules)).alias("m")).groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


@query()
def inf6_all_token_types(spark, sf_dir):
    """The types of all tokens of all lines."""
    return infer.token_types(raw_logs(spark, sf_dir)).groupBy("position", "type", "path", "confidence").agg(F.count("*").alias("n"))


@query()
def inf1_all_first_templates(spark, sf_dir):
    """The first templates of all lines."""
    return raw_logs(spark, sf_dir).groupBy(F.array_join(infer.first_template(infer.tokens(F.col("raw_message"))), " ").alias("template")).agg(F.count("*").alias("n"))


@query()
def fn_all_extensions(spark, sf_dir):
    """All extension keys of each parser, with how many rows and different values each has."""
    rows = normalized(spark, sf_dir).select("parser_name", F.explode("extensions").alias("key", "value"))
    return rows.groupBy("parser_name", "key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query(detected("SELECT incident_key, CASE WHEN tactics >= 3 THEN 'CLOSED' WHEN key_type = 'IP' THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status FROM incidents"))
def cor6_status_log(spark, sf_dir):
    """Incidents under a status log: all of addresses acknowledged, then those of three tactics closed."""
    found = materialised(correlate.incidents(_detections(spark, sf_dir)), "incidents")
    entity = ["key_type", "correlation_key"]  # an incident's key has 32 bits, so of many some are shared
    first = found.where("key_type = 'IP'").select(*entity, F.lit("ACKNOWLEDGED").alias("status"), F.lit(1).alias("at"))
    later = found.where("distinct_tactic_count >= 3").select(*entity, F.lit("CLOSED").alias("status"), F.lit(2).alias("at"))
    return correlate.with_status(found.select("incident_key", *entity, "status"), first.unionByName(later), entity).select("incident_key", "status")


@query(detected("SELECT incident_key, 'OPEN' AS status, events AS event_count FROM incidents"))
def cor3_merge(spark, sf_dir):
    """The same findings twice: the second run updates the incidents of the first and adds none."""
    found = materialised(correlate.incidents(_detections(spark, sf_dir)), "incidents")
    return correlate.merge(found, found).select("incident_key", "status", "event_count")


@query(
    expected("""SELECT batch_number, n, ceil(log2(n))::INTEGER AS levels, n AS verified FROM (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS batch_number, count(*) AS n FROM e GROUP BY ALL)""")
)
def mrk2_proofs_by_batch(spark, sf_dir):
    """A proof for every leaf of every day's batch, held against the batch's root."""
    leaves = materialised(_batches(spark, sf_dir), "leaves")
    nodes = materialised(lineage.tree_nodes(leaves), "nodes")
    proven = lineage.verify(lineage.proofs(leaves, leaves, nodes), lineage.roots(leaves, nodes))
    return proven.groupBy("batch_number").agg(F.count("*").alias("n"), F.max(F.size("proof")).alias("levels"), F.count(F.when(F.col("verified"), 1)).alias("verified"))


@query(expected("SELECT code, count(*) AS n FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY ALL"))
def fil4_between(spark, sf_dir):
    rows = search.between(normalized(spark, sf_dir), "received_at", datetime(2024, 1, 5), datetime(2024, 1, 12))
    return search.status_counts(rows.select(F.col("outcome.code").alias("code")), "code")


@query(r"SELECT event_id AS seq, concat('a\\|b', event_type, '\\') AS escaped FROM events")
def exp4_escaped(spark, sf_dir):
    text = F.concat(F.lit("a|b"), F.col("event_type"), F.lit("\\"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), escaped(text).alias("escaped"))


@query(expected("SELECT seq, event_uid, raw_uid FROM e"))
def ids(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    return rows.select(seq(), F.col("event_id").alias("event_uid"), F.col("raw_event_id").alias("raw_uid"))


@query(expected("SELECT (SELECT count(*) FROM n) AS stored, (SELECT count(*) FROM e WHERE code <> 'NORMAL') AS quarantined"))
def conserved_rows(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    ok = F.col("outcome.code") == "NORMAL"
    both = events(rows).unionByName(rows.where(~ok))
    return both.agg(F.count(F.when(ok, 1)).alias("stored"), F.count(F.when(~ok, 1)).alias("quarantined"))
