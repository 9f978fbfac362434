"""Queries over what goes on from batch to batch: keyed state of streams, trees and tables that grow, status logs, loaded rules."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import bundles, correlate, drift, enrich, export, infer, lineage, parser_index, rule_index, search, sigma
from logloom.plans.normalize import normalize, quarantine
from logloom.plans.oracle import DETECTIONS, EXPECTED, _WINDOW, detected, expected, merkle
from logloom.plans.queries import ORACLE_SQL, _batches, _detections, normalized, query, seq, stored
from logloom.plans.raw_logs import raw_logs
from logloom.sources import clustered
from logloom.sources.tables import append_ledger, current, materialised, names, put, shared_dir, table, upsert
from logloom.streaming import live


def _place(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/logloom/{tag}-{uuid.uuid4().hex}"


def _streamed(rows: DataFrame, make, tag: str) -> DataFrame:
    """What ``make`` puts out, by micro-batch, of a stream of the rows' files in about three micro-batches."""
    spark, folder = rows.sparkSession, _place(rows.sparkSession, tag)
    rows.write.parquet(f"{folder}/in")
    files = len([n for n in names(spark, f"{folder}/in") if n.startswith("part-")])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 3)).parquet(f"{folder}/in")
    writer = make(stream).writeStream.foreachBatch(lambda part, n: put(part, f"{folder}/out/batch={n}")).outputMode("update")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_NONE = "CAST(NULL AS DOUBLE) AS average, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p95, CAST(NULL AS DOUBLE) AS p99"


@query(
    expected(f"""SELECT 'format' AS kind, format AS name, count(*) AS n, {_NONE} FROM n GROUP BY format
    UNION ALL SELECT 'tier', CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*), {_NONE} FROM n GROUP BY tier
    UNION ALL SELECT 'outcome', CASE WHEN code = 'NORMAL' THEN 'stored' ELSE 'quarantined' END AS o, count(*), {_NONE} FROM e GROUP BY o
    UNION ALL SELECT 'outcome', 'alerts', count(*), {_NONE} FROM matches
    UNION ALL SELECT 'latency', 'latest', len(v), round(a, 6), v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1], v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1], v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1]
      FROM (SELECT list_sort(list(value)) AS v, avg(value) AS a FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 200))""")
)
def str2_running_metrics(spark, sf_dir):
    """Counters and the ring of latest values as keyed state of a stream of all lines."""
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_seq"), "value")
    # Alerts are counted, so of a match its rule is kept, and of an outcome its code: what goes through the join and the stream's files is narrow.
    narrow = {"outcome": F.struct("outcome.code"), "threat": F.struct(F.transform("threat.sigma_matches", lambda m: m["rule_id"]).alias("sigma_matches"))}
    rows = normalized(spark, sf_dir).select("outcome", "format", "confidence_tier", "threat", "received_at", "ingest_seq").withColumns(narrow).join(values, "ingest_seq")
    found = live.latest_metrics(_streamed(rows, lambda s: live.running_metrics(s, "value"), "metrics"))
    return found.withColumn("average", F.round("average", 6))


_DAY = (
    DETECTIONS.replace(f"n.ts > {_WINDOW}", "true").replace(f"ts > {_WINDOW} AND", "")
    .replace(f"occurred >= {_WINDOW}", "occurred >= (SELECT date_trunc('second', max(occurred)) - INTERVAL 1 DAY FROM detected)")
)


@query(
    f"""WITH {EXPECTED}, {_DAY} SELECT incident_key, key_type, key AS correlation_key, chain, events AS event_count, detections AS detection_count, CASE s WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM incidents"""
)
def cor2_running_incidents(spark, sf_dir):
    """The incidents of the last day, as keyed state by entity of a stream of all lines; the watermark ends the window."""
    rows = normalized(spark, sf_dir).select("event_id", "outcome", "threat", "source", "extensions", "event", "received_at", "timestamp_utc")
    found = live.latest_incidents(_streamed(rows, lambda s: live.running_incidents(live.line_detections(s), 24 * 60, event_time=True), "incidents"))
    return found.select(
        "incident_key", "key_type", "correlation_key", F.array_join("tactic_chain", " > ").alias("chain"), "event_count", "detection_count", "severity",
        F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"),
    )


@query(ORACLE_SQL["mrk1_roots"])
def mrk1_grown_roots(spark, sf_dir):
    """The trees of all days, grown in three appends from their frontiers."""
    leaves = materialised(_batches(spark, sf_dir), "leaves")
    sizes = leaves.groupBy("batch_number").agg(F.count("*").alias("n"))
    part = F.floor(F.col("leaf_index") * 3 / F.col("n"))
    rows = leaves.join(sizes, "batch_number").select(F.col("batch_number").alias("tree"), part.alias("part"), "leaf_index", "hash")
    first = rows.groupBy("tree", "part").agg(F.min("leaf_index").alias("first"))
    placed = materialised(rows.join(first, ["tree", "part"]).select("tree", "part", (F.col("leaf_index") - F.col("first")).alias("place"), "hash"), "placed")
    grown = None
    for i in range(3):
        grown = materialised(lineage.frontier(placed.where(F.col("part") == i).drop("part"), grown), "frontier")
    return lineage.frontier_roots(grown).select(F.col("tree").alias("batch_number"), F.col("n").alias("event_count"), "merkle_root")


@query(ORACLE_SQL["mrk1_roots"])
def snk2_ledger(spark, sf_dir):
    """The batches of all days in the ledger, which a repeated run leaves as it is."""
    path, roots = _place(spark, "ledger"), materialised(lineage.roots(_batches(spark, sf_dir)), "roots")
    for _ in range(2):
        append_ledger(roots, path, 1)
    return spark.read.json(path).select("batch_number", "event_count", "merkle_root")


@query(detected("SELECT incident_key, CASE WHEN tactics >= 3 THEN 'CLOSED' ELSE 'OPEN' END AS status, events AS event_count FROM incidents"))
def snk1_incident_record(spark, sf_dir):
    """All incidents in a table of buckets, then those of three tactics again, closed: their buckets alone are written anew."""
    found, path, keys = materialised(correlate.incidents(_detections(spark, sf_dir)), "incidents"), _place(spark, "record"), ["key_type", "correlation_key"]
    upsert(found, path, keys)
    upsert(found.where("distinct_tactic_count >= 3").withColumn("status", F.lit("CLOSED")), path, keys)
    rows = current(spark, path)
    return (found if rows is None else rows).select("incident_key", "status", "event_count")


@query(
    merkle("""SELECT CASE WHEN seq % 2 = 0 THEN event_uid ELSE raw_uid END AS id, row_number() OVER (ORDER BY ts, seq) - 1 AS leaf_index, true AS verified, 'Inclusion proof VERIFIED' AS status_message FROM e
    UNION ALL SELECT 'nowhere', CAST(NULL AS BIGINT), false, 'Event not found: nowhere'""")
)
def mrk6_inclusion(spark, sf_dir):
    """Every line, asked for by the id of its event or of its raw line, in one sealed batch; and an id that is none."""
    rows = normalized(spark, sf_dir).select("event_id", "received_at", "ingest_seq", "raw_event_id", "raw_hash")
    leaves = materialised(lineage.seal(rows.drop("event_id")), "sealed")
    nodes = materialised(lineage.tree_nodes(leaves), "tree")
    wanted = rows.select(F.when(F.col("ingest_seq") % 2 == 0, F.col("event_id")).otherwise(F.col("raw_event_id")).alias("id")).unionByName(spark.createDataFrame([("nowhere",)], "id string"))
    return lineage.inclusion(wanted, rows, leaves, lineage.roots(leaves, nodes), nodes).select("id", "leaf_index", "verified", "status_message")


@query(expected("SELECT seq, CASE WHEN seq % 3 = 0 THEN 'RESOLVED' WHEN seq % 3 = 1 THEN 'RETRIED' ELSE 'NEW' END AS status FROM e WHERE code <> 'NORMAL'"))
def dlq5_status_log(spark, sf_dir):
    """Quarantined lines under a status log: two thirds were tried again, half of these are resolved since."""
    failed = quarantine(normalized(spark, sf_dir))
    entry = lambda rows, status, at: rows.select("raw_event_id", "ingest_seq", F.lit(status).alias("status"), F.lit(at).alias("at"))
    log = entry(failed.where("ingest_seq % 3 < 2"), "RETRIED", 1).unionByName(entry(failed.where("ingest_seq % 3 = 0"), "RESOLVED", 2))
    return correlate.with_status(failed.select("ingest_seq", "raw_event_id", "status"), log, lineage.line_key(failed, log)).select(seq(), "status")


@query(expected("SELECT parser_name, CASE WHEN parser_name = 'json_generic_parser' THEN 0.95 ELSE max(confidence) END AS baseline FROM n GROUP BY parser_name"))
def drf3_baselines(spark, sf_dir):
    """The baselines of all parsers that stored events: the active version's figure, or the default."""
    rows = stored(spark, sf_dir)
    parsers = rows.select("parser_name", "parser_version", "format", F.lit(False).alias("dynamic"), F.lit(0.0).alias("score")).distinct()
    versions = rows.where("parser_name <> 'json_generic_parser'").groupBy("parser_name").agg(F.max("average_confidence").alias("average_confidence")).withColumn("active", F.lit(True))
    return drift.baselines(parsers, versions).select("parser_name", "baseline")


@query(expected("SELECT 'CEF:0|' AS head, count(*) AS n FROM n"))
def snk4_export_files(spark, sf_dir):
    """All stored events as CEF in text files, read back line by line."""
    path = _place(spark, "wire")
    export.write_files(stored(spark, sf_dir), path, "cef")
    return spark.read.text(path).groupBy(F.substring("value", 1, 6).alias("head")).agg(F.count("*").alias("n"))


@query(expected("SELECT seq, technique AS technique_id, tactic FROM n"))
def src8_loaded_techniques(spark, sf_dir):
    """Techniques by rules that are read from their JSON form."""
    text = json.dumps([
        {"id": r.id, "conditionType": r.condition, "techniqueId": r.technique_id, "techniqueName": r.technique_name, "tactic": r.tactic, "category": r.category, "riskScore": r.risk_score, "destinationPorts": r.ports, "actions": r.actions, "keywords": r.keywords}
        for r in enrich.TECHNIQUES
    ])
    found = enrich.technique(F.col("destination.port"), F.lower("event.action"), F.lower("raw_message"), enrich.load_techniques(text))
    return stored(spark, sf_dir).select(seq(), found.alias("t")).select("seq", "t.technique_id", "t.tactic")


@query(expected("SELECT rule_id, count(*) AS n FROM matches WHERE rule_id <> 'SIGMA-T1552-FTP-002' GROUP BY rule_id UNION ALL SELECT 'MINE', count(*) FROM n WHERE dpt = 8080 HAVING count(*) > 0"))
def src7_stored_rules(spark, sf_dir):
    """Rules from a table that one store has written and another changed, over all stored events."""
    path = _place(spark, "rules")
    sigma.RuleStore().save(spark, path)
    store = sigma.RuleStore.load(spark, path)
    store.delete("SIGMA-T1552-FTP-002")
    store.upsert(sigma.parse_rule({"id": "MINE", "title": "t", "detection": {"selection": {"dst_port": 8080}}}))
    store.save(spark, path)
    rules = sigma.stored_rules(spark, path)()
    rows = stored(spark, sf_dir).withColumns(sigma.fields(rules)).withColumns(sigma.lowered(rules))
    return rows.select(F.explode(sigma.evaluate(rules)).alias("m")).groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


@query(ORACLE_SQL["prs13_dynamic_parser"])
def prs13_parser_index(spark, sf_dir):
    """All lines again, with a table of parsers, one for each template of the unknown lines, looked up by its index."""
    unknown = quarantine(normalized(spark, sf_dir)).where("failure_code = 'UNPARSEABLE_FORMAT'")
    parsers = materialised(parser_index.approved(infer.infer(infer.mine_first(unknown))), "approvals")
    rows = normalize(raw_logs(spark, sf_dir), index=parser_index.build(parsers))
    return rows.groupBy("format", F.col("outcome.code").alias("code")).agg(F.count("*").alias("n"))


def _clustered(spark: SparkSession, sf_dir: str) -> str:
    path = _place(spark, "clustered")
    clustered.store(stored(spark, sf_dir), path)
    return path


@query(ORACLE_SQL["fil2_event_by_id"])
def fil2_filtered_lookup(spark, sf_dir):
    """The event of the last line by its id, from a table with Bloom filters of all stored events."""
    path = _clustered(spark, sf_dir)
    rows = clustered.rows_of(spark, path)
    wanted = rows.agg(F.max_by("event_id", "ingest_seq")).first()[0]
    return search.by_id(rows, "event_id", wanted).select(seq(), F.col("event_id").alias("event_uid"))


@query(ORACLE_SQL["fil1_event_search"])
def fil1_clustered_search(spark, sf_dir):
    """The search of all stored events, in a table by ranges of time."""
    found = search.search_events(clustered.rows_of(spark, _clustered(spark, sf_dir)), action="BLOCKED", severity="High", fmt="SYSLOG", since=datetime(2020, 1, 1))
    return found.select(seq(), F.col("event_id").alias("event_uid"), F.col("source.ip").alias("src_ip"), F.col("destination.port").alias("dpt"))


@query(ORACLE_SQL["srt3_event_page"])
def srt3_page_by_key(spark, sf_dir):
    """The second page of all stored events, by the key of the first page's last row."""
    path = _clustered(spark, sf_dir)
    last = clustered.page(spark, path).collect()[-1]
    return clustered.page(spark, path, (last.timestamp_utc, last.ingest_seq)).select(seq(), F.col("event.action").alias("action"))


@query(ORACLE_SQL["sig6_matches"])
def sig6_rule_index(spark, sf_dir):
    """The bundled rules over all stored events, by the index of their values."""
    found = rule_index.build(spark, sigma.RULES).matches(stored(spark, sf_dir))
    return stored(spark, sf_dir).select("event_id", seq()).join(found, "event_id").select("seq", F.inline("sigma_matches")).drop("matched_details")


@query(expected("SELECT seq, concat('ADDRESS-', src_ip) AS rule_id FROM n WHERE action = 'blocked' AND src_ip LIKE '192.168.%'"))
def sig6_thousand_rules(spark, sf_dir):
    """A rule for each address of four networks, over all stored events."""
    address = lambda ip: {"id": f"ADDRESS-{ip}", "title": "t", "detection": {"where": {"source.ip": ip}, "what": {"event.action|startswith": "BLOCK"}, "condition": "where and what"}}
    rules = [sigma.parse_rule(address(f"192.168.{k}.{i}")) for k in range(4) for i in range(1, 251)]
    found = rule_index.build(spark, rules).matches(stored(spark, sf_dir))
    return stored(spark, sf_dir).select("event_id", seq()).join(found, "event_id").select("seq", F.explode("sigma_matches.rule_id").alias("rule_id"))


@query(merkle("SELECT batch_number, (SELECT count(*) FROM leaves l WHERE l.batch_number = up.batch_number) AS leaf_count, hash AS merkle_root, true AS verified FROM up WHERE n = 1"))
def mrk7_chunked_bundles(spark, sf_dir):
    """The batches of all days in chunks, each chunk's leaves led up to the batch's root."""
    leaves = materialised(_batches(spark, sf_dir), "leaves")
    nodes = materialised(lineage.tree_nodes(leaves), "tree")
    roots = lineage.roots(leaves, nodes)
    return bundles.verified(bundles.chunks(leaves, nodes), roots).join(roots.select("batch_number", "merkle_root"), "batch_number")
