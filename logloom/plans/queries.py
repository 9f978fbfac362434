"""The registered queries of the log engine, with their SQL. All run over the log lines that are derived from ``events``."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import address_category, internal
from logloom.operators import correlate, drift, export, infer, lineage, metrics, search, sigma
from logloom.operators.classify import classify
from logloom.operators.parsers.dynamic import DynamicParser, FieldMapping, dynamic
from logloom.plans.normalize import events, normalize, quarantine, raw_hash, renormalize
from logloom.plans.oracle import detected, expected, merkle
from logloom.plans.raw_logs import raw_logs
from logloom.sources.tables import materialised, shared_dir, table
from logloom.streaming import gateway

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_KNOWN: dict[tuple[str, str], DataFrame] = {}


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, normalized and written once for each session and folder; every query reads that table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = materialised(normalize(raw_logs(spark, sf_dir)), "normalized")
    return _KNOWN[key]


def query(sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(normalized(spark, sf_dir))


def _as_of(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def seq():
    return F.col("ingest_seq").alias("seq")


@query(expected("SELECT format, action, severity, count(*) AS n FROM n GROUP BY ALL"))
def flagship_events_by_action(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("format", F.col("event.action").alias("action"), F.col("event.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(expected("SELECT seq, hash AS raw_hash FROM e"))
def lin1_raw_hash(spark, sf_dir):
    return raw_logs(spark, sf_dir).select(seq(), raw_hash(F.col("raw_message")).alias("raw_hash"))


@query(
    expected("""SELECT CASE kind WHEN 0 THEN 'SYSLOG_RFC3164' WHEN 1 THEN 'SYSLOG_RFC3164' WHEN 2 THEN 'CEF' WHEN 3 THEN 'LEEF' WHEN 4 THEN 'JSON' WHEN 5 THEN 'CSV' ELSE 'UNKNOWN' END AS format,
    CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.99 WHEN 3 THEN 0.99 WHEN 4 THEN 0.98 WHEN 5 THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence, count(*) AS n FROM e GROUP BY ALL""")
)
def cls1_classify(spark, sf_dir):
    found = raw_logs(spark, sf_dir).select(classify(F.col("raw_message")).alias("c"))
    return found.groupBy(F.col("c.format").alias("format"), F.col("c.confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query(expected("SELECT parser_name, format, count(*) AS n FROM e GROUP BY ALL"))
def rte1_routes(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("parser_name", "format").agg(F.count("*").alias("n"))


_PARSED = "seq, action, severity, severity_id, src_ip, spt, dst_ip, dpt, proto, usr, vendor, product, version, observer_host, type, direction, time_text"


def _parsed(spark, sf_dir, name: str) -> DataFrame:
    return _parsed_columns(normalized(spark, sf_dir).where(F.col("parser_name") == name))


def _parsed_columns(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.select(
        seq(), c("event.action").alias("action"), c("event.severity").alias("severity"), c("event.severity_id").alias("severity_id"), c("source.ip").alias("src_ip"), c("source.port").alias("spt"),
        c("destination.ip").alias("dst_ip"), c("destination.port").alias("dpt"), c("network.protocol").alias("proto"), c("source.user").alias("usr"), c("observer.vendor").alias("vendor"), c("observer.product").alias("product"),
        c("observer.version").alias("version"), c("observer.hostname").alias("observer_host"), c("event.type").alias("type"), c("network.direction").alias("direction"), c("timestamp_text").alias("time_text"),
    )


@query(expected(f"SELECT {_PARSED} FROM e WHERE kind IN (0, 1)"))
def prs1_syslog(spark, sf_dir):
    return _parsed(spark, sf_dir, "syslog_rfc_parser")


@query(expected(f"SELECT {_PARSED} FROM e WHERE kind IN (2, 3)"))
def prs5_cef_leef(spark, sf_dir):
    return _parsed(spark, sf_dir, "cef_leef_parser")


@query(expected(f"SELECT {_PARSED} FROM e WHERE kind IN (5, 6)"))
def prs7_csv_kv(spark, sf_dir):
    return _parsed(spark, sf_dir, "csv_kv_parser")


@query(expected(f"SELECT {_PARSED} FROM e WHERE kind = 4"))
def prs9_json(spark, sf_dir):
    return _parsed(spark, sf_dir, "json_generic_parser")


@query(
    """WITH a AS (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b, event_id % 7 AS c, user_id % 9 AS d FROM events),
    p AS (SELECT concat(a, '.', b, '.', c, '.', d) AS ip, (a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)) AS inside FROM a)
    SELECT CASE WHEN inside AND ip <> '0.0.0.0' THEN 'PRIVATE_RFC1918' ELSE 'PUBLIC_INTERNET' END AS category, inside AND ip <> '0.0.0.0' AS internal, count(*) AS n FROM p GROUP BY ALL"""
)
def enr1_internal_addresses(spark, sf_dir):
    parts = [F.col("event_id") % 256, F.col("user_id") % 256, F.col("event_id") % 7, F.col("user_id") % 9]
    ips = table(spark, sf_dir, "events").select(F.concat_ws(".", *[p.cast("string") for p in parts]).alias("ip"))
    return ips.groupBy(address_category(F.col("ip")).alias("category"), internal(F.col("ip")).alias("internal")).agg(F.count("*").alias("n"))


@query(expected("""SELECT dpt, CASE dpt WHEN 22 THEN 'SSH' WHEN 3389 THEN 'RDP' WHEN 443 THEN 'HTTPS' WHEN 80 THEN 'HTTP' WHEN 53 THEN 'DNS' WHEN 21 THEN 'FTP' WHEN 23 THEN 'TELNET' WHEN 8080 THEN 'HTTP-PROXY' END AS service, count(*) AS n FROM n GROUP BY ALL"""))
def enr3_services(spark, sf_dir):
    return stored(spark, sf_dir).groupBy(F.col("destination.port").alias("dpt"), F.col("network.transport").alias("service")).agg(F.count("*").alias("n"))


@query(expected("SELECT technique, tactic, CASE technique WHEN 'T1110' THEN 75 ELSE 70 END AS risk, count(*) AS n FROM n GROUP BY ALL"))
def enr4_techniques(spark, sf_dir):
    t = F.col("threat")
    return stored(spark, sf_dir).groupBy(t["technique_id"].alias("technique"), t["tactic"].alias("tactic"), t["risk_score"].alias("risk")).agg(F.count("*").alias("n"))


@query(expected("SELECT seq, rule_id, rule_title, severity, technique_id, tactic FROM matches"))
def sig6_matches(spark, sf_dir):
    return stored(spark, sf_dir).select(seq(), F.inline("threat.sigma_matches")).drop("matched_details")


@query(expected("SELECT severity, count(*) AS n, count(DISTINCT rule_id) AS rules FROM matches WHERE severity IN ('high', 'critical') GROUP BY ALL"))
def sig9_alert_search(spark, sf_dir):
    alerts = sigma.alerts(stored(spark, sf_dir))
    found = search.search_alerts(alerts, severity="HIGH").unionByName(search.search_alerts(alerts, severity="Critical"))
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("rule_id").alias("rules"))


@query(expected("SELECT confidence, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier, confidence < 0.7 AS low, count(*) AS n FROM e GROUP BY ALL"))
def scr1_confidence(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy(F.col("average_confidence").alias("confidence"), F.col("confidence_tier").alias("tier"), F.col("low_confidence").alias("low")).agg(F.count("*").alias("n"))


@query(
    expected("""SELECT seq, code AS failure_code, CASE code WHEN 'UNPARSEABLE_FORMAT' THEN 'No parser takes this line' ELSE 'Invalid source IP format: bad-host' END AS failure_reason,
    CASE code WHEN 'UNPARSEABLE_FORMAT' THEN 'UNKNOWN' ELSE format END AS detected_format, 'NEW' AS status FROM e WHERE code <> 'NORMAL'""")
)
def dlq1_quarantine(spark, sf_dir):
    return quarantine(normalized(spark, sf_dir)).select(seq(), "failure_code", "failure_reason", "detected_format", "status")


@query(expected("SELECT seq, code AS failure_code FROM e WHERE code <> 'NORMAL' ORDER BY ts DESC, seq DESC LIMIT 50"))
def dlq3_recent(spark, sf_dir):
    return search.newest(quarantine(normalized(spark, sf_dir)), "created_at", 50, "ingest_seq").select(seq(), "failure_code")


@query(expected("SELECT CASE WHEN kind = 7 THEN 'RESOLVED_ON_RETRY' ELSE 'RETRIED' END AS status, CAST(1 AS INTEGER) AS retry_count, count(*) AS n FROM e WHERE code <> 'NORMAL' GROUP BY ALL"))
def dlq4_retry(spark, sf_dir):
    """Quarantined lines again, now with a parser for the unknown family."""
    spec = DynamicParser("custom_session", r"^GARBAGE-(?<token0>\d+)\s+(?<token1>\w+)\s+(?<token2>\w+)\s+token$", (FieldMapping("token1", "extensions.kind"), FieldMapping("token2", "event.action")))
    _, log = search.retry(quarantine(normalized(spark, sf_dir)), normalize, dynamic=[dynamic(spec)])
    return log.groupBy("status", "retry_count").agg(F.count("*").alias("n"))


@query(expected("SELECT seq, event_uid, src_ip, dpt FROM n WHERE action = 'blocked' AND severity = 'high' AND format = 'SYSLOG' AND occurred >= make_timestamp(2020, 1, 1, 0, 0, 0.0)"))
def fil1_event_search(spark, sf_dir):
    found = search.search_events(stored(spark, sf_dir), action="BLOCKED", severity="High", fmt="SYSLOG", since=datetime(2020, 1, 1))
    return found.select(seq(), F.col("event_id").alias("event_uid"), F.col("source.ip").alias("src_ip"), F.col("destination.port").alias("dpt"))


@query(expected("SELECT seq, action FROM n ORDER BY occurred DESC, seq DESC LIMIT 25 OFFSET 25"))
def srt3_event_page(spark, sf_dir):
    rows, _ = search.page(stored(spark, sf_dir), "timestamp_utc", 1, 25, "ingest_seq")
    return rows.select(seq(), F.col("event.action").alias("action"))


@query(expected("SELECT seq, raw_uid, hash AS recomputed_hash, true AS verified, CAST(octet_length(encode(raw)) AS BIGINT) AS raw_bytes FROM n"))
def lin2_integrity(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    raw = rows.select("raw_event_id", "ingest_seq", "raw_message", "raw_hash")
    found = lineage.integrity(events(rows), raw)
    return found.select(seq(), F.col("raw_event_id").alias("raw_uid"), "recomputed_hash", "verified", "raw_bytes")


@query(expected("SELECT seq, raw AS stored_message, code FROM n"))
def jon1_event_with_raw(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    return search.with_raw(events(rows), rows.select("raw_event_id", "ingest_seq", "raw_message", "raw_hash")).select(seq(), "stored_message", F.col("outcome.code").alias("code"))


def _batches(spark, sf_dir) -> DataFrame:
    """Leaves of a batch for each day."""
    day = F.date_format("received_at", "yyyyMMdd").cast("long")
    rows = normalized(spark, sf_dir).select(day.alias("batch_number"), "received_at", "ingest_seq", F.col("raw_hash").alias("hash"))
    return lineage.numbered(rows, ["batch_number"], ["received_at", "ingest_seq"], "leaf_index").select("batch_number", "leaf_index", "hash")


@query(merkle("SELECT batch_number, (SELECT count(*) FROM leaves l WHERE l.batch_number = up.batch_number) AS event_count, hash AS merkle_root FROM up WHERE n = 1"))
def mrk1_roots(spark, sf_dir):
    return lineage.roots(_batches(spark, sf_dir))


@query(expected("SELECT count(*) AS leaves, 1 AS batches, count(*) AS verified FROM e"))
def mrk5_seal_and_verify(spark, sf_dir):
    """One batch of everything, and a proof for every leaf, each held against the root."""
    rows = normalized(spark, sf_dir).select("received_at", "ingest_seq", "raw_event_id", "raw_hash")
    leaves = materialised(lineage.seal(rows), "sealed")
    nodes = materialised(lineage.tree_nodes(leaves), "tree")
    proven = lineage.verify(lineage.proofs(leaves, leaves, nodes), lineage.roots(leaves, nodes))
    return proven.agg(F.count("*").alias("leaves"), F.count_distinct("batch_number").cast("int").alias("batches"), F.count(F.when(F.col("verified"), 1)).alias("verified"))


@query(expected("SELECT count(*) AS event_count, true AS verified FROM e"))
def mrk7_audit_bundle(spark, sf_dir):
    rows = normalized(spark, sf_dir).select("received_at", "ingest_seq", "raw_event_id", "raw_hash")
    leaves = materialised(lineage.seal(rows), "sealed")
    bundle = lineage.audit_bundle(lineage.roots(leaves), leaves)
    return bundle.select(F.get_json_object("bundle", "$.event_count").cast("long").alias("event_count"), F.get_json_object("bundle", "$.verified_root_matches_tree").cast("boolean").alias("verified"))


def _detections(spark, sf_dir) -> DataFrame:
    rows = stored(spark, sf_dir)
    return correlate.detections(rows, sigma.alerts(rows), _as_of(spark, sf_dir) - timedelta(days=7))


@query(detected("SELECT key_type, t AS tactic, count(*) AS n, count(DISTINCT seq) AS events FROM found GROUP BY ALL"))
def cor1_detections(spark, sf_dir):
    rows = stored(spark, sf_dir).select("event_id", "ingest_seq")
    found = _detections(spark, sf_dir).join(rows, "event_id")
    return found.groupBy("key_type", correlate.canonical_tactic(F.col("tactic")).alias("tactic")).agg(F.count("*").alias("n"), F.count_distinct("ingest_seq").alias("events"))


@query(
    detected("""SELECT incident_key, key_type, key AS correlation_key, chain, tactics, events AS event_count, detections AS detection_count, CASE s WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM incidents""")
)
def cor2_incidents(spark, sf_dir):
    found = correlate.incidents(_detections(spark, sf_dir))
    return found.select(
        "incident_key", "key_type", "correlation_key", F.array_join("tactic_chain", " > ").alias("chain"), F.col("distinct_tactic_count").cast("long").alias("tactics"), "event_count", "detection_count", "severity",
        F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"),
    )


@query(
    detected("""SELECT f.incident_key, m.seq, list_sort(list(DISTINCT rule_id) FILTER (rule_id IS NOT NULL)) AS rules FROM
    (SELECT DISTINCT i.incident_key, fo.seq FROM incidents i JOIN found fo ON i.key_type = fo.key_type AND i.key = fo.key) f JOIN n m USING (seq) LEFT JOIN matches r ON r.seq = m.seq GROUP BY f.incident_key, m.seq""").replace("list_sort(list(DISTINCT rule_id) FILTER (rule_id IS NOT NULL))", "coalesce(array_to_string(list_sort(list(DISTINCT rule_id) FILTER (rule_id IS NOT NULL)), ','), '')")
)
def jon5_incident_members(spark, sf_dir):
    found = materialised(_detections(spark, sf_dir), "detections")
    rows = stored(spark, sf_dir)
    details = search.incident_details(correlate.members(found, correlate.incidents(found)), rows, sigma.alerts(rows))
    return details.join(rows.select("event_id", "ingest_seq"), "event_id").select("incident_key", seq(), F.coalesce(F.array_join("rule_ids", ","), F.lit("")).alias("rules"))


@query(
    detected("""SELECT i.incident_key, t AS stage, epoch_us(min(occurred)) AS first_us, count(*) AS detections, count(DISTINCT title) AS rules, count(DISTINCT technique_id) AS techniques
    FROM incidents i JOIN found fo ON i.key_type = fo.key_type AND i.key = fo.key GROUP BY ALL""")
)
def agg12_incident_stages(spark, sf_dir):
    found = materialised(_detections(spark, sf_dir), "detections")
    rolled = correlate.stages(correlate.members(found, correlate.incidents(found)))
    return rolled.select("incident_key", "stage", F.unix_micros("first_at").alias("first_us"), "detections", "rules", "techniques")


@query(
    detected("""SELECT incident_key, concat(key, ' triggered ', string_agg(concat('''', title, ''' (', technique_id, ', ', t, ') at ', strftime(occurred, '%Y-%m-%d %H:%M:%SZ')), ', followed by ' ORDER BY occurred, event_uid, title),
    ' — pattern consistent with a multi-stage attack; probable initiating event is the first entry above (heuristic hypothesis, not a proven causal claim).') AS narrative
    FROM incidents i JOIN found fo ON i.key_type = fo.key_type AND i.key = fo.key JOIN (SELECT seq, event_uid FROM n) u ON u.seq = fo.seq GROUP BY incident_key, i.key""").replace("concat(key, ' triggered '", "concat(i.key, ' triggered '")
)
def cor4_narratives(spark, sf_dir):
    found = materialised(_detections(spark, sf_dir), "detections")
    return correlate.narratives(correlate.members(found, correlate.incidents(found))).select("incident_key", "narrative")


def _figures(spark, sf_dir) -> DataFrame:
    rows = normalized(spark, sf_dir)
    known = spark.createDataFrame([(p, "1.0.0", f, 0.95) for p, f in (("syslog_rfc_parser", "SYSLOG"), ("cef_leef_parser", "CEF/LEEF"), ("csv_kv_parser", "CSV/KV"), ("json_generic_parser", "JSON"))], "parser_name string, parser_version string, format string, baseline double")
    return drift.quality(events(rows), quarantine(rows), known, _as_of(spark, sf_dir))


_FIGURES = """recent AS (SELECT parser_name, format, confidence, row_number() OVER (PARTITION BY parser_name ORDER BY ts DESC, seq DESC) AS place FROM n),
 rolled AS (SELECT parser_name, format, sum(round(confidence * 1000)) / count(*) / 1000 AS rolling, count(*) AS total_events FROM recent WHERE place <= 500 GROUP BY ALL),
 failed AS (SELECT CASE code WHEN 'UNPARSEABLE_FORMAT' THEN 'UNKNOWN' ELSE format END AS format, count(*) AS dlq FROM e WHERE code <> 'NORMAL' AND ts > (SELECT max(ts) - INTERVAL 24 HOUR FROM events) GROUP BY ALL),
 figures AS (SELECT parser_name, rolling, greatest(0, 0.95::DOUBLE - rolling) AS dropped, total_events, coalesce(dlq, 0) AS dlq_events, total_events / (total_events + coalesce(dlq, 0)) AS success FROM rolled LEFT JOIN failed USING (format))"""


@query(
    expected("x").removesuffix(" x") + f""", {_FIGURES} SELECT parser_name, round(rolling, 6) AS rolling, round(success, 6) AS success, total_events, dlq_events,
    CASE WHEN (dropped >= 0.15 AND (success < 0.95 OR dlq_events > 0)) OR dlq_events > 0 OR (success < 0.85 AND total_events + dlq_events >= 5) THEN 'DRIFT_ALERT' WHEN dropped >= 0.075 THEN 'WARNING' ELSE 'HEALTHY' END AS health FROM figures"""
)
def drf2_parser_health(spark, sf_dir):
    found = drift.health(_figures(spark, sf_dir))
    return found.select("parser_name", F.round("current_confidence", 6).alias("rolling"), F.round("success_rate", 6).alias("success"), "total_events", "dlq_events", "health")


@query(
    expected("x").removesuffix(" x") + f""", {_FIGURES} SELECT parser_name, total_events, dlq_events, 'OPEN' AS status,
    concat('Parser quality drift detected: Success rate dropped to ', printf('%.1f', success * 100), '% below threshold 85.0% (', dlq_events, ' DLQ quarantined payloads)') AS details FROM figures WHERE dlq_events > 0 AND dropped < 0.15"""
)
def drf1_drift_alerts(spark, sf_dir):
    return drift.drift_alerts(_figures(spark, sf_dir)).select("parser_name", "total_events", "dlq_events", "status", "details")


@query(expected("SELECT parser_name, place, confidence FROM (SELECT parser_name, confidence, row_number() OVER (PARTITION BY parser_name ORDER BY ts DESC, seq DESC) AS place FROM n) WHERE place <= 500"))
def win1_latest_per_parser(spark, sf_dir):
    return drift.latest(stored(spark, sf_dir)).select("parser_name", F.col("place").cast("long").alias("place"), F.col("average_confidence").alias("confidence"))


@query(
    expected("""SELECT format, sum(c) AS n, round(sum(c) / (SELECT count(*) FROM n), 9) AS share FROM (SELECT format, count(*) AS c FROM n GROUP BY ALL UNION ALL SELECT unnest(['SYSLOG', 'CEF', 'LEEF', 'JSON', 'CSV', 'CUSTOM']), 0) GROUP BY ALL""").replace("sum(c) AS n", "CAST(sum(c) AS BIGINT) AS n")
)
def agg8_formats(spark, sf_dir):
    return metrics.by_format(stored(spark, sf_dir)).select("format", "n", F.round("share", 9).alias("share"))


@query(expected("SELECT confidence_tier, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier, count(*) AS c FROM n GROUP BY ALL UNION ALL SELECT unnest(['HIGH', 'MEDIUM', 'LOW']), 0) GROUP BY ALL"))
def agg8_tiers(spark, sf_dir):
    return metrics.by_tier(stored(spark, sf_dir))


@query(expected("SELECT count(*) AS total, count(*) FILTER (code = 'NORMAL') AS stored, count(*) FILTER (code <> 'NORMAL') AS quarantined, (SELECT count(*) FROM matches) AS alerts FROM e"))
def agg8_totals(spark, sf_dir):
    return metrics.totals(normalized(spark, sf_dir))


@query(
    """WITH r AS (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 200), v AS (SELECT list_sort(list(value)) AS v, avg(value) AS a FROM r)
    SELECT len(v) AS n, round(a, 6) AS average, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99 FROM v"""
)
def agg9_latency(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "value", "ts", "event_id").withColumn("average", F.round("average", 6))


@query("SELECT count(*) / 5 AS eps FROM events WHERE ts > (SELECT max(ts) - INTERVAL 5 SECOND FROM events)")
def agg10_events_per_second(spark, sf_dir):
    return metrics.events_per_second(table(spark, sf_dir, "events"), _as_of(spark, sf_dir), at="ts")


@query(
    """WITH w AS (SELECT epoch_us(ts) // 1000000 + k AS end_s FROM events, range(1, 6) r(k)) SELECT CAST(end_s AS BIGINT) AS end_s, count(*) AS n, count(*) / 5 AS eps FROM w GROUP BY end_s"""
)
def str2_sliding_rates(spark, sf_dir):
    found = metrics.rate_over_time(table(spark, sf_dir, "events"), at="ts")
    return found.select(F.unix_seconds("window_end").alias("end_s"), "n", "eps")


@query(expected("SELECT 'NORMAL' AS kind, count(*) AS n FROM n WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events) UNION ALL SELECT code, count(*) FROM e WHERE code <> 'NORMAL' AND ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY code"))
def agg11_counts_since(spark, sf_dir):
    start = _as_of(spark, sf_dir) - timedelta(days=1)
    rows = normalized(spark, sf_dir).where(F.col("received_at") > F.lit(start))
    return search.status_counts(rows.select(F.col("outcome.code").alias("kind")), "kind")


_WIRE = "CASE WHEN usr IS NOT NULL THEN concat('{u}=', usr, '{s}') ELSE '' END"


@query(
    expected(f"""SELECT seq, concat('CEF:0|', vendor, '|', product, '|', coalesce(version, '1.0'), '|', type, '|', message, '|', severity_id, '|src=', src_ip, ' spt=', spt, ' ', {_WIRE.format(u="suser", s=" ")},
    'dst=', dst_ip, ' dpt=', dpt, ' proto=', proto, ' act=', action, ' rawHash=', hash, ' externalId=', event_uid) AS wire FROM n JOIN message USING (seq)""")
)
def exp1_cef(spark, sf_dir):
    return stored(spark, sf_dir).select(seq(), export.to_wire("CEF").alias("wire"))


@query(
    expected(f"""SELECT seq, concat('LEEF:1.0|', vendor, '|', product, '|', coalesce(version, '1.0'), '|', type, '|src=', src_ip, chr(9), 'srcPort=', spt, chr(9), {_WIRE.format(u="usrName", s="', chr(9), '").replace("concat('usrName=', usr, '', chr(9), '')", "concat('usrName=', usr, chr(9))")},
    'dst=', dst_ip, chr(9), 'dstPort=', dpt, chr(9), 'proto=', proto, chr(9), 'action=', action, chr(9), 'eventId=', event_uid) AS wire FROM n""")
)
def exp2_leef(spark, sf_dir):
    return stored(spark, sf_dir).select(seq(), export.to_wire("leef").alias("wire"))


@query(
    expected("""SELECT seq, event_uid AS id, time_text AS at, src_ip, CAST(spt AS VARCHAR) AS spt, usr, proto AS transport, direction, raw AS original, hash AS sha256, technique, tactic, vendor FROM n""")
)
def exp3_ecs(spark, sf_dir):
    at = lambda path, name: F.get_json_object("wire", path).alias(name)
    rows = stored(spark, sf_dir).select(seq(), export.to_wire("ecs").alias("wire"))
    return rows.select(
        "seq", at("$.event.id", "id"), at("$['@timestamp']", "at"), at("$.source.ip", "src_ip"), at("$.source.port", "spt"), at("$.source.user.name", "usr"), at("$.network.transport", "transport"), at("$.network.direction", "direction"),
        at("$.event.original", "original"), at("$.event.hash.sha256", "sha256"), at("$.threat.technique.id", "technique"), at("$.threat.tactic.name", "tactic"), at("$.observer.vendor", "vendor"),
    )


@query()
def inf4_templates(spark, sf_dir):
    """Templates mined from all lines, with how many lines each has."""
    return infer.templates(infer.mine(raw_logs(spark, sf_dir)))


@query()
def inf7_inference(spark, sf_dir):
    """For each line without a parser: template, pattern and confidence."""
    unknown = quarantine(normalized(spark, sf_dir)).where("failure_code = 'UNPARSEABLE_FORMAT'")
    return infer.infer(infer.mine(unknown)).select(F.col("id").alias("seq"), "template", "pattern", "confidence", "tier", "recommended")


@query(expected("SELECT CASE WHEN kind = 7 THEN 'CUSTOM' ELSE format END AS format, CASE WHEN kind = 7 THEN 'NORMAL' ELSE code END AS code, count(*) AS n FROM e GROUP BY ALL"))
def prs13_dynamic_parser(spark, sf_dir):
    """All lines again, with a parser that was inferred from the unknown ones and approved."""
    before = normalized(spark, sf_dir)
    unknown = quarantine(before).where("failure_code = 'UNPARSEABLE_FORMAT'")
    registry = infer.Registry()
    infer.approve_all(infer.infer(infer.mine_first(unknown)), registry)
    rows = renormalize(before, registry.parsers())
    return rows.groupBy("format", F.col("outcome.code").alias("code")).agg(F.count("*").alias("n"))



@query(expected("SELECT code, format, count(*) AS n FROM e GROUP BY ALL"))
def str1_stream_normalize(spark, sf_dir):
    """The lines as a stream of files, through the gateway's fan-out; counts from the tables that it wrote."""
    folder = f"{shared_dir(spark)}/logloom/stream-{uuid.uuid4().hex}"
    lines = raw_logs(spark, sf_dir)
    lines.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/in")
    gateway.run(stream, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    code = lambda df, c: df.select(c.alias("code"), "format")
    stored_ = spark.read.parquet(f"{folder}/out/events")
    failed, every = spark.read.parquet(f"{folder}/out/quarantine"), spark.read.parquet(f"{folder}/out/normalized")
    key = lineage.line_key(failed, every)
    failed = failed.join(every.select(*key, "format"), key)
    both = code(stored_, F.col("outcome.code")).unionByName(code(failed, F.col("failure_code")))
    return both.groupBy("code", "format").agg(F.count("*").alias("n"))
