import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import bsd_time, internal
from logloom.operators import correlate, drift, export, infer, lineage, metrics
from logloom.sources import lines


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha(row[i] + row[min(i + 1, len(row) - 1)]) for i in range(0, len(row), 2)])
    return levels


@pytest.mark.parametrize(
    "payloads, root",
    [
        (["Log payload number 1", "Log payload number 2"], "97c061f5451265f6f5d71bfe8d58bfc1093b12d0a430e9340edf051e083ae3a3"),
        (["event-alpha", "event-beta", "event-gamma"], "8c8fa692ff7102878b0f9e6e8016abf897723b5e39606afd69a2c015a9512fb5"),
        ([f"event-{i}" for i in range(5)], "04f32e5837ce4ed09f51a970e4d5bac203594786f0530b90dfd24308ac9342d9"),
    ],
)
def test_known_roots(spark, payloads, root):
    leaves = spark.createDataFrame([(1, i, sha(p)) for i, p in enumerate(payloads)], "batch_number long, leaf_index long, hash string")
    assert lineage.roots(leaves).first().merkle_root == root == tree([sha(p) for p in payloads])[-1][0]


def test_trees_and_proofs(spark):
    """Batches of many sizes at once, one of them over several groups of neighbours."""
    sizes = [1, 2, 3, 5, 7, 8, 13, 33, 1025, 2049]
    leaves = spark.createDataFrame([(n, i, sha(f"{n}-{i}")) for n in sizes for i in range(n)], "batch_number long, leaf_index long, hash string")
    nodes = lineage.tree_nodes(leaves).cache()
    want = {n: tree([sha(f"{n}-{i}") for i in range(n)]) for n in sizes}
    assert {r.batch_number: r.merkle_root for r in lineage.roots(leaves, nodes).collect()} == {n: t[-1][0] for n, t in want.items()}
    assert {(r.batch_number, r.level, r["index"]): r.hash for r in nodes.collect()} == {(n, v, i): h for n, t in want.items() for v, row in enumerate(t) for i, h in enumerate(row)}
    found = lineage.verify(lineage.proofs(leaves, leaves, nodes), lineage.roots(leaves, nodes))
    assert found.where("verified").count() == sum(sizes)
    bad = lineage.verify(lineage.proofs(leaves, leaves, nodes).withColumn("hash", F.sha2("hash", 256)), lineage.roots(leaves, nodes))
    assert bad.where("verified").count() == 0


def test_inclusion(spark):
    rows = spark.createDataFrame([("e1", "r1", sha("1")), ("e2", "r2", sha("2")), (None, "r3", sha("3"))], "event_id string, raw_event_id string, raw_hash string")
    raw = rows.where("raw_event_id <> 'r3'").withColumn("received_at", F.current_timestamp()).withColumn("ingest_seq", F.xxhash64("raw_event_id"))
    leaves = lineage.seal(raw)
    assert sorted((r.raw_event_id, r.hash) for r in leaves.collect()) == [("r1", sha("1")), ("r2", sha("2"))]
    wanted = spark.createDataFrame([("e1",), ("r2",), ("r3",), ("x",)], "id string")
    found = {r.id: (r.verified, r.status_message) for r in lineage.inclusion(wanted, rows, leaves, lineage.roots(leaves)).collect()}
    assert found == {"e1": (True, "Inclusion proof VERIFIED"), "r2": (True, "Inclusion proof VERIFIED"), "r3": (False, "Not in a batch yet"), "x": (False, "Event not found: x")}
    more = lineage.seal(rows.withColumn("received_at", F.current_timestamp()).withColumn("ingest_seq", F.lit(0)), leaves)
    assert [(r.batch_number, r.leaf_index, r.raw_event_id) for r in more.collect()] == [(2, 0, "r3")]


def test_integrity(spark):
    raw = spark.createDataFrame([("r1", "é", sha("é")), ("r2", "b", sha("x"))], "raw_event_id string, raw_message string, raw_hash string")
    rows = spark.createDataFrame([("e1", "r1", sha("é").upper(), "p", "1"), ("e2", "r2", sha("b"), "p", "1"), ("e3", "r3", sha("c"), "p", "1")], "event_id string, raw_event_id string, raw_hash string, parser_name string, parser_version string")
    assert {r.event_id: (r.verified, r.raw_bytes) for r in lineage.integrity(rows, raw).collect()} == {"e1": (True, 2), "e2": (False, 1), "e3": (False, None)}


AT = datetime(2026, 1, 1, 12)


def found(spark, *rows):
    data = [("IP", "1.1.1.1", e, t, "T1", tactic, AT - timedelta(minutes=m), s) for e, t, tactic, m, s in rows]
    return spark.createDataFrame(data, "key_type string, key string, event_id string, title string, technique_id string, tactic string, at timestamp, severity string")


def test_incidents(spark):
    three = found(spark, ("c", "C", "command_and_control", 2, "high"), ("a", "A", "Credential Access", 15, "critical"), ("b", "", "Discovery", 10, "low"), ("b", "B", "Discovery", 10, "low"))
    r = correlate.incidents(three).first()
    assert (r.root_event_id, r.severity, r.tactic_chain, r.event_count, r.detection_count) == ("a", "CRITICAL", ["Credential Access", "Discovery", "Command and Control"], 3, 4)
    told = correlate.narratives(correlate.members(three, correlate.incidents(three))).first()
    assert told.member_event_ids == ["a", "b", "c"]
    assert told.narrative.startswith("1.1.1.1 triggered 'A' (T1, Credential Access) at 2026-01-01 11:45:00Z, followed by 'Security Telemetry Event' (T1, Discovery) at ")
    assert told.narrative.endswith(correlate.DISCLAIMER)
    assert correlate.incidents(found(spark, *[(str(i), "x", "Discovery", 1, "high") for i in range(50)])).count() == 0


def test_severity(spark):
    cases = [(1, 2, "LOW"), (2, 2, "MEDIUM"), (3, 2, "HIGH"), (4, 2, "CRITICAL"), (2, 4, "HIGH"), (3, 4, "CRITICAL"), (1, 3, "MEDIUM"), (0, 2, "LOW")]
    df = spark.createDataFrame(cases, "score int, n int, want string")
    assert all(r[0] == r[1] for r in df.select(correlate.incident_severity(F.col("score"), F.col("n")), "want").collect())


def test_merge(spark):
    new = correlate.incidents(found(spark, ("a", "A", "Discovery", 5, "low"), ("b", "B", "Impact", 1, "low")))
    first = new.first()
    older = new.withColumn("first_seen_at", F.lit(AT - timedelta(days=1))).withColumn("status", F.lit("ACKNOWLEDGED"))
    (r,) = correlate.merge(older, new).collect()
    assert (r.incident_key, r.status, r.first_seen_at, r.last_seen_at) == (first.incident_key, "ACKNOWLEDGED", AT - timedelta(days=1), first.last_seen_at)
    rows = correlate.merge(older.withColumn("status", F.lit("CLOSED")), new).collect()
    assert sorted((r.status, r.incident_key) for r in rows) == [("CLOSED", first.incident_key), ("OPEN", first.incident_key + "-1")]


def test_drift(spark):
    def rows(n, c):
        return spark.createDataFrame([("p", AT - timedelta(minutes=i), i, c) for i in range(n)], "parser_name string, received_at timestamp, ingest_seq long, average_confidence double")

    known = spark.createDataFrame([("p", "1", "X", 0.9)], "parser_name string, parser_version string, format string, baseline double")
    failed = spark.createDataFrame([("X", AT)], "detected_format string, created_at timestamp")
    figures = drift.quality(rows(20, 0.78), failed.limit(0), known, AT)
    assert drift.drift_alerts(figures).count() == 0 and drift.health(figures).first().health == "WARNING"
    figures = drift.quality(rows(20, 0.65), failed, known, AT)
    alert = drift.drift_alerts(figures, as_of=AT).first()
    assert alert.details.startswith("Parser quality drift detected: Confidence dropped by 25.0% (baseline: 0.90, rolling: 0.65) with degraded success rate (95.2%)")
    opened = spark.createDataFrame([("p", "OPEN")], "parser_name string, status string")
    assert drift.drift_alerts(figures, opened).count() == 0 and drift.health(figures, opened).first().active_alert
    assert drift.drift_alerts(drift.quality(rows(0, 0.0), failed, known, AT)).count() == 0
    (r,) = drift.quality(rows(600, 0.5), failed, known, AT).collect()
    assert r.total_events == 500 and len(r.history) == 20


def test_inference(spark):
    text = ["SEC-GW-01 2026-08-30T10:32:21Z [DENY] proto=TCP src=192.168.10.50:61000 dst=10.20.30.40:80 user=guest", "SEC-GW-01 2026-08-30T10:32:25Z [ALLOW] proto=UDP src=192.168.10.51:61001 dst=10.20.30.40:80 user=amy", "link up on port eth3 now", "link up on port eth4 now", None, " "]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(text)], "raw_message string, ingest_seq long")
    mined = infer.mine(df)
    assert {r.id: r.template for r in mined.collect()} == {0: "SEC-GW-01 <*> <*> proto=<*> src=<*> dst=<*> user=<*>", 1: "SEC-GW-01 <*> <*> proto=<*> src=<*> dst=<*> user=<*>", 2: "link up on port <*> now", 3: "link up on port <*> now"}
    row = infer.infer(mined).where("id = 0").first()
    assert (row.confidence, row.tier, row.recommended) == (0.917, "HIGH", True)
    registry = infer.Registry()
    registry.approve(infer.synthesize(row, "custom"))
    from logloom.plans.normalize import normalize

    raw = df.where("ingest_seq = 0").withColumn("source", F.lit("T")).withColumn("received_at", F.current_timestamp())
    r = normalize(raw, dynamic=registry.parsers()).first()
    assert (r.parser_name, r.source.ip, r.source.port, r.destination.port, r.event.action, r.source.user, r.average_confidence) == ("custom", "192.168.10.50", 61000, 80, "blocked", "guest", 0.97)
    registry.toggle("custom", False)
    assert registry.parsers() == []


def test_addresses(spark):
    cases = {"10.1.2.3": True, "172.31.0.1": True, "172.32.0.1": False, "100.64.0.1": True, "100.128.0.1": False, "169.254.1.1": True, "127.0.0.1": True, "0.0.0.0": False, "::": False, "::1": True, "fe80::1": True, "2001:db8::1": False, "8.8.8.8": False, "10.0.0.1:80": True, "172.20.x": True, "host": False, "": False, " 192.168.0.1 ": True, "999.1.1.1": False}
    df = spark.createDataFrame([*cases.items(), (None, False)], "ip string, want boolean")
    assert [r.ip for r in df.select("ip", internal(F.col("ip")).alias("got"), "want").collect() if r.got != r.want] == []


def test_times(spark):
    df = spark.createDataFrame([("Feb", "3", "01:02:03"), ("Xyz", "3", "01:02:03"), ("", "", "")], "m string, d string, t string").withColumn("r", F.lit("2026-09-01 00:00:00").cast("timestamp"))
    assert [r[0] for r in df.select(bsd_time(F.col("m"), F.col("d"), F.col("t"), F.col("r"))).collect()] == ["2026-02-03T01:02:03Z", "2026-09-01T00:00:00Z", "2026-09-01T00:00:00Z"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  \ntwo\n")
    (tmp_path / "b.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert [r.raw_message for r in lines.read_lines(spark, str(tmp_path / "a.log")).collect()] == ["one", "two"]
    assert [r.raw_message for r in lines.read_json_array(spark, str(tmp_path / "b.json")).collect()] == ['{"a":1}', '{"a":2}']
    bodies = spark.createDataFrame([('{"log": "x", "source": "S"}',), ('{"message": "y"}',), ("plain",)], "body string")
    assert [(r.raw_message, r.source) for r in lines.from_requests(bodies).collect()] == [("x", "S"), ("y", "REST"), ("plain", "REST")]
    bulk = spark.createDataFrame([('["a", "b", null]',), ('{"logs": ["c"]}',)], "body string")
    assert [r.raw_message for r in lines.from_bulk(bulk).collect()] == ["a", "b", "c"]


def test_taxonomy(spark):
    told = export.taxonomy(spark.range(1).select(F.struct(F.lit("a").alias("ip")).alias("source"), F.lit(1).alias("n")).schema)
    assert told["fields"] == {"source.ip": "string", "n": "int"} and len(told["ecs_aliases"]) == 25


def test_latency(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(300)], "v double, at long")
    r = metrics.latency(df, "v", "at").first()
    assert (r.n, r.p50, r.p95, r.p99) == (200, 200.0, 290.0, 298.0)
    assert metrics.latency(df.limit(0), "v", "at").first().n == 0


def test_events_of_all_parts_of_a_narrative(spark):
    """An event that has detections in several parts is listed once, in the first."""
    rows = [("INC", "k", f"2026-01-05 10:00:0{i}", e, f"t{i}", "T1", "Discovery") for i, e in enumerate("abacba")]
    found = spark.createDataFrame(rows, "incident_key string, key string, at string, event_id string, title string, technique_id string, tactic string").withColumn("at", F.col("at").cast("timestamp"))
    parts = correlate.narratives(found, steps=2).orderBy("part").collect()
    assert [p.member_event_ids for p in parts] == [["a", "b"], ["c"], []] and {p.parts for p in parts} == {3}
    assert "".join(p.narrative for p in parts).count("', ") == 0 and all(f"'t{i}'" in parts[i // 2].narrative for i in range(6))
