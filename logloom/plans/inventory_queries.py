"""Queries over what the others don't show: requests and files, hostile numbers, failures, proofs by hash, tampering, settings."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from logloom.operators import correlate, export, lineage, search, sigma
from logloom.operators.parsers.dynamic import ip_only, port_only
from logloom.operators.parsers.json import root
from logloom.plans.config import Config
from logloom.plans.normalize import events, normalize, quarantine
from logloom.plans.oracle import detected, expected, merkle
from logloom.plans.queries import _as_of, _batches, _detections, _figures, normalized, query, seq, stored
from logloom.plans.raw_logs import lines_table, raw_logs
from logloom.sources import lines
from logloom.sources.tables import materialised, shared_dir

_EVE = """SELECT event_id, ts, concat('{{"event_type":"alert","src_ip":"1.1.1.1","dest_ip":"2.2.2.2","src_port":', CASE event_id % 8
 WHEN 0 THEN '99999999999' WHEN 1 THEN '"NaN"' WHEN 2 THEN '1e400' WHEN 3 THEN '-1' WHEN 4 THEN '80.9' WHEN 5 THEN '""' WHEN 6 THEN 'null' ELSE CAST(event_id % 65536 AS {S}) END,
 ',"dest_port":443,"alert":{{"severity":', CASE event_id % 4 WHEN 0 THEN '99999999999' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '"NaN"' END, '}}}}') AS raw_message FROM events"""


@query(
    """SELECT event_id AS seq, 'NORMAL' AS code, CASE event_id % 8 WHEN 4 THEN 80 WHEN 7 THEN CAST(event_id % 65536 AS INTEGER) END AS spt, CAST(CASE event_id % 4 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS INTEGER) AS severity_id FROM events"""
)
def prs11_hostile_numbers(spark, sf_dir):
    """Alerts whose numbers fit no 32 bits, or are none: each is stored, with the default."""
    rows = normalize(lines_table(spark, sf_dir, _EVE.format(S="STRING")))
    return rows.select(seq(), F.col("outcome.code").alias("code"), F.col("source.port").alias("spt"), F.col("event.severity_id").alias("severity_id"))


@query("SELECT event_id AS seq, 'PARSER_FAILURE' AS failure_code, CASE WHEN event_id % 2 = 0 THEN 'Malformed CEF header' ELSE 'Malformed LEEF header' END AS failure_reason FROM events")
def dlq2_parser_failures(spark, sf_dir):
    sql = "SELECT event_id, ts, concat(CASE WHEN event_id % 2 = 0 THEN 'CEF' ELSE 'LEEF' END, ': no header ', CAST(event_id AS STRING)) AS raw_message FROM events"
    return quarantine(normalize(lines_table(spark, sf_dir, sql))).select(seq(), "failure_code", "failure_reason")


_BODY = """CASE event_id % 4 WHEN 0 THEN concat('{"log":"L', event_id, '","source":"S"}') WHEN 1 THEN concat('{"message":"M', event_id, '"}') WHEN 2 THEN concat('{"a":"', event_id, '","b":2}') ELSE concat('line ', event_id) END"""


@query(
    """SELECT CASE event_id % 4 WHEN 0 THEN concat('L', event_id) WHEN 1 THEN concat('M', event_id) WHEN 2 THEN concat('{a=', event_id, ', b=2}') ELSE concat('line ', event_id) END AS raw_message,
    CASE event_id % 4 WHEN 0 THEN 'S' ELSE 'REST_SINGLE' END AS source FROM events"""
)
def src1_requests(spark, sf_dir):
    bodies = raw_logs(spark, sf_dir).withColumnRenamed("ingest_seq", "event_id").select(F.expr(_BODY).alias("body"))
    return lines.from_requests(bodies, source="REST_SINGLE").select("raw_message", "source")


@query("SELECT unnest([concat('a', event_id), concat('{\"k\":', event_id, '}')]) AS raw_message, 'REST_BULK' AS source FROM events")
def src2_bulk(spark, sf_dir):
    body = F.concat(F.lit('["a'), F.col("ingest_seq"), F.lit('"," ",{"k":'), F.col("ingest_seq"), F.lit("}]"))
    listed = F.when(F.col("ingest_seq") % 2 == 0, body).otherwise(F.concat(F.lit('{"logs":'), body, F.lit("}")))
    return lines.from_bulk(raw_logs(spark, sf_dir).select(listed.alias("body"))).select("raw_message", "source")


@query(expected("SELECT raw AS raw_message, 'FILE' AS source, count(*) AS n FROM e GROUP BY ALL"))
def src6_lines_of_files(spark, sf_dir):
    path = f"{shared_dir(spark)}/logloom/lines-{uuid.uuid4().hex}"
    raw_logs(spark, sf_dir).select("raw_message").write.text(path)
    return lines.read_lines(spark, path).groupBy("raw_message", "source").agg(F.count("*").alias("n"))


@query(expected("SELECT count(*) AS n, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS bytes FROM e WHERE seq % 100 <> 0"))
def src5_framed(spark, sf_dir):
    """Every hundredth line is longer than a frame."""
    long = F.concat("raw_message", F.when(F.col("ingest_seq") % 100 == 0, F.repeat(F.lit("y"), 65_536)).otherwise(""))
    kept = lines.framed(raw_logs(spark, sf_dir).select(long.alias("value")))
    return kept.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@query("SELECT event_id AS seq, concat('{\"b\":[', event_id, ',null]}') AS nested, CAST(NULL AS VARCHAR) AS nothing, 'true' AS truth, CAST(3 AS BIGINT) AS keys FROM events")
def fn9_json_values(spark, sf_dir):
    """Nested values keep their text, nulls stay."""
    line = F.concat(F.lit('{"a":{"b":['), F.col("ingest_seq"), F.lit(',null]},"n":null,"t":true}'))
    rows = raw_logs(spark, sf_dir).select(seq(), root(line).alias("m"))
    return rows.select("seq", F.col("m")["a"].alias("nested"), F.col("m")["n"].alias("nothing"), F.col("m")["t"].alias("truth"), F.size("m").cast("long").alias("keys"))


@query("SELECT event_id AS seq, concat('10.0.0.', event_id % 250) AS ip, CAST(event_id % 60000 AS INTEGER) AS port FROM events")
def fn10_address_and_port(spark, sf_dir):
    sign = F.when(F.col("ingest_seq") % 2 == 0, "/").otherwise(":")
    token = F.concat(F.lit("src=10.0.0."), F.col("ingest_seq") % 250, sign, F.col("ingest_seq") % 60_000)
    return raw_logs(spark, sf_dir).select(seq(), ip_only(token).alias("ip"), port_only(token).alias("port"))


@query(
    merkle("""SELECT l.batch_number, l.hash, min(l.i) AS leaf_index, true AS verified FROM leaves l JOIN (SELECT batch_number, max(hash) AS hash FROM leaves GROUP BY ALL) USING (batch_number, hash) GROUP BY ALL
    UNION ALL SELECT DISTINCT batch_number, 'ff', CAST(NULL AS BIGINT), false FROM leaves""")
)
def mrk3_proof_by_hash(spark, sf_dir):
    """Of each batch, the proof of its largest hash, asked for in upper case, and of one that it doesn't hold."""
    leaves = materialised(_batches(spark, sf_dir), "leaves")
    nodes = materialised(lineage.tree_nodes(leaves), "tree")
    wanted = leaves.groupBy("batch_number").agg(F.upper(F.max("hash")).alias("hash"))
    found = lineage.proofs_by_hash(leaves, wanted.unionByName(wanted.withColumn("hash", F.lit("FF"))), nodes)
    return lineage.verify(found, lineage.roots(leaves, nodes)).select("batch_number", "hash", "leaf_index", (F.col("verified") & F.col("leaf_index").isNotNull()).alias("verified"))


@query(expected("SELECT seq, seq % 97 <> 5 AS verified, CASE WHEN seq % 97 = 5 THEN 'Integrity FAILED' ELSE 'Integrity verified' END AS status FROM n"))
def lin2_tampered_lines(spark, sf_dir):
    """Every 97th kept line was changed."""
    rows = normalized(spark, sf_dir)
    raw = rows.select("raw_event_id", "ingest_seq", F.when(F.col("ingest_seq") % 97 == 5, F.concat("raw_message", F.lit(" "))).otherwise(F.col("raw_message")).alias("raw_message"), "raw_hash")
    told = lineage.integrity(events(rows), raw)
    return told.select(seq(), "verified", F.regexp_extract("status_message", r"^(Integrity \w+)", 1).alias("status"))


@query(expected("SELECT seq, row_number() OVER (ORDER BY ts, seq) - 1 AS leaf_index, hash, raw AS stored_line, CASE WHEN code = 'NORMAL' THEN event_uid END AS event_uid FROM e"))
def jon2_leaf_records(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    leaves = lineage.seal(rows.select("received_at", "ingest_seq", "raw_event_id", "raw_hash"))
    found = lineage.leaf_records(leaves, rows)
    return found.select(seq(), "leaf_index", "hash", F.col("raw_message").alias("stored_line"), F.col("event_id").alias("event_uid"))


@query(expected("SELECT CAST(CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS batch_number, count(*) AS event_count, count(DISTINCT hash) AS hashes FROM e GROUP BY ALL"))
def mrk5_second_batch(spark, sf_dir):
    """Half of the lines are sealed already; the next batch holds the other half."""
    rows = normalized(spark, sf_dir).select("received_at", "ingest_seq", "raw_event_id", "raw_hash")
    first = materialised(lineage.seal(rows.where(F.col("ingest_seq") % 2 == 0)), "sealed")
    both = first.unionByName(lineage.seal(rows, first, by=lineage.line_key(rows, first)))
    return both.groupBy("batch_number").agg(F.count("*").alias("event_count"), F.count_distinct("hash").alias("hashes"))


@query(
    expected("""SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS batch_number, count(*) AS event_count, false AS nothing FROM e GROUP BY ALL
    UNION ALL SELECT 99990101, 0, true""")
)
def mrk4_empty_batch(spark, sf_dir):
    """The batches of all days, and one of a day without lines: its root is that of nothing."""
    roots = materialised(lineage.roots(_batches(spark, sf_dir)), "roots")
    days = roots.select("batch_number").unionByName(roots.select(F.lit(99990101).cast("long").alias("batch_number")))
    return lineage.with_empty(roots, days).select("batch_number", "event_count", (F.col("merkle_root") == lineage.EMPTY_ROOT).alias("nothing"))


@query(expected("SELECT count(DISTINCT strftime(ts, '%Y%m%d')) AS batches, count(*) AS events FROM e"))
def agg13_batch_totals(spark, sf_dir):
    return lineage.totals(lineage.roots(_batches(spark, sf_dir)))


@query(
    expected("""SELECT parser_name, array_to_string(list(confidence ORDER BY place DESC), ',') AS history FROM
    (SELECT parser_name, confidence, row_number() OVER (PARTITION BY parser_name ORDER BY ts DESC, seq DESC) AS place FROM n) WHERE place <= 20 GROUP BY ALL""")
)
def win2_history(spark, sf_dir):
    """The last twenty confidences of each parser, the oldest first."""
    return _figures(spark, sf_dir).select("parser_name", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


@query(
    detected("""SELECT CASE k.status WHEN 'CLOSED' THEN concat(i.incident_key, '-1') ELSE i.incident_key END AS incident_key, 'OPEN' AS status, epoch_us(i.first_seen) - CASE WHEN k.status = 'OPEN' THEN 3600000000 ELSE 0 END AS first_us
    FROM incidents i LEFT JOIN (SELECT incident_key, CASE WHEN length(key) % 2 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status FROM incidents WHERE key_type = 'IP') k USING (incident_key)
    UNION ALL SELECT incident_key, 'CLOSED', epoch_us(first_seen) - 3600000000 FROM incidents WHERE key_type = 'IP' AND length(key) % 2 = 0""")
)
def cor3_merge_closed_and_new(spark, sf_dir):
    """On record are the addresses' incidents, an hour older, half of them closed; users' incidents are new."""
    new = materialised(correlate.incidents(_detections(spark, sf_dir)), "new")
    known = new.where("key_type = 'IP'").withColumn("status", F.when(F.length("correlation_key") % 2 == 0, "CLOSED").otherwise("OPEN"))
    known = materialised(known.withColumn("first_seen_at", F.col("first_seen_at") - F.expr("INTERVAL 1 HOUR")), "known")
    return correlate.merge(known, new).select("incident_key", "status", F.unix_micros("first_seen_at").alias("first_us"))


@query(expected("SELECT seq, event_uid FROM n ORDER BY seq DESC LIMIT 1"))
def fil2_event_by_id(spark, sf_dir):
    rows = stored(spark, sf_dir)
    wanted = rows.agg(F.max_by("event_id", "ingest_seq")).first()[0]
    return search.by_id(rows, "event_id", wanted).select(seq(), F.col("event_id").alias("event_uid"))


@query(expected("SELECT code AS failure_code, count(*) AS n FROM e WHERE code <> 'NORMAL' AND ts >= (SELECT max(ts) - INTERVAL 3 DAY FROM events) GROUP BY ALL"))
def fil3_quarantine_by_status_and_time(spark, sf_dir):
    end = _as_of(spark, sf_dir)
    found = search.by_status(search.between(quarantine(normalized(spark, sf_dir)), "created_at", end - timedelta(days=3), end), "NEW")
    return found.groupBy("failure_code").agg(F.count("*").alias("n"))


@query(expected("SELECT seq, CASE seq % 3 WHEN 0 THEN 'CEF:0|' WHEN 1 THEN 'LEEF:1' ELSE '{\"@tim' END AS head FROM n"))
def exp6_formats_by_name(spark, sf_dir):
    kind = F.when(F.col("ingest_seq") % 3 == 0, "Cef").when(F.col("ingest_seq") % 3 == 1, "LEEF").otherwise("ecs_json")
    return stored(spark, sf_dir).select(seq(), F.substring(export.to_wire(kind), 1, 6).alias("head"))


@query(expected("SELECT rule_id, count(*) AS n FROM matches WHERE rule_id NOT IN ('SIGMA-T1046-SCAN-001', 'SIGMA-T1552-FTP-002') GROUP BY ALL UNION ALL SELECT 'MINE', count(*) FROM n WHERE action = 'blocked' AND src_ip LIKE '192.168.1%'"))
def sig8_rule_store(spark, sf_dir):
    """All lines again, with a rule switched off, one deleted and one added."""
    store = sigma.RuleStore()
    store.toggle("SIGMA-T1046-SCAN-001", False)
    store.delete("SIGMA-T1552-FTP-002")
    store.upsert(sigma.parse_rule({"id": "MINE", "title": "t", "detection": {"selection": {"event.action|endswith": "KED", "source.ip|startswith": "192.168.1"}}}))
    rows = events(normalize(raw_logs(spark, sf_dir), rules=store.rules())).select(F.inline("threat.sigma_matches"))
    return rows.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(expected("SELECT CASE WHEN confidence >= 0.98 THEN 'HIGH' WHEN confidence >= 0.95 THEN 'MEDIUM' ELSE 'LOW' END AS tier, confidence < 0.95 AS low, CAST(0 AS BIGINT) AS techniques, CAST(0 AS BIGINT) AS matches, count(*) AS n FROM n GROUP BY ALL"))
def cfg1_settings(spark, sf_dir):
    """All lines again, without rules and techniques, with other thresholds."""
    rows = events(normalize(raw_logs(spark, sf_dir), Config(sigma=False, technique_mapping=False, high_confidence=0.98, medium_confidence=0.95)))
    return rows.groupBy(F.col("confidence_tier").alias("tier"), F.col("low_confidence").alias("low")).agg(
        F.count("threat.technique_id").alias("techniques"), F.coalesce(F.sum(F.size("threat.sigma_matches")), F.lit(0)).cast("long").alias("matches"), F.count("*").alias("n")
    )
