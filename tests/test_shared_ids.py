"""Short ids of lines and incidents can be shared, and rows keep apart all the same."""

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from logloom.operators import lineage, search
from logloom.plans import more_queries

AT = datetime(2024, 1, 1)


def lines(spark):
    """Four lines, of which three share an id, and two of these are equal."""
    rows = [(i, f"EVT-{i}", "RAW-a" if i < 3 else "RAW-b", hashlib.sha256(t.encode()).hexdigest(), t, AT) for i, t in enumerate(("x", "x", "y", "z"))]
    return spark.createDataFrame(rows, "ingest_seq long, event_id string, raw_event_id string, raw_hash string, raw_message string, received_at timestamp").withColumn("outcome", F.struct(F.lit("NORMAL").alias("code"))).withColumns({"parser_name": F.lit("p"), "parser_version": F.lit("1")})


def test_records_and_batches(spark):
    rows = lines(spark)
    leaves = lineage.seal(rows)
    records = lineage.leaf_records(leaves, rows).collect()
    assert sorted((r.leaf_index, r.ingest_seq, r.raw_message, r.event_id) for r in records) == [(i, i, t, f"EVT-{i}") for i, t in enumerate("xxyz")]
    first = lineage.seal(rows.where("ingest_seq = 0"))
    assert lineage.seal(rows, first, by=lineage.line_key(rows, first)).count() == 3
    raw = rows.select("raw_event_id", "ingest_seq", "raw_message", "raw_hash")
    assert sorted((r.ingest_seq, r.verified) for r in lineage.integrity(rows, raw).collect()) == [(i, True) for i in range(4)]
    assert sorted((r.ingest_seq, r.stored_message) for r in search.with_raw(rows, raw).collect()) == [*enumerate("xxyz")]


def test_inclusion_of_a_shared_id(spark):
    rows = lines(spark)
    leaves = lineage.seal(rows)
    wanted = spark.createDataFrame([("RAW-a",), ("RAW-a",), ("EVT-3",)], "id string")
    found = lineage.inclusion(wanted, rows, leaves, lineage.roots(leaves)).collect()
    assert sorted((r.id, r.leaf_index, r.verified) for r in found) == [("EVT-3", 3, True), ("RAW-a", 0, True), ("RAW-a", 1, True), ("RAW-a", 2, True)]


def test_incidents_of_one_key(spark, monkeypatch):
    """Two users whose incidents have one key: each has the status of its own entries."""
    seen, i = {}, 0
    while True:
        key = hashlib.sha256(f"USER|u{i}".encode()).hexdigest()[:8]
        if key in seen:
            break
        seen[key], i = i, i + 1
    found = [("USER", f"u{seen[key]}", t, s) for s, t in enumerate(("Discovery", "Credential Access"))] + [("USER", f"u{i}", t, s) for s, t in enumerate(("Discovery", "Credential Access", "Impact"))]
    frame = spark.createDataFrame(found, "key_type string, key string, tactic string, seq int").select("key_type", "key", F.concat("key", "seq").alias("event_id"), F.lit("t").alias("title"), F.lit("T1").alias("technique_id"), "tactic", F.lit(AT).alias("at"), F.lit("low").alias("severity"))
    monkeypatch.setattr(more_queries, "_detections", lambda *_: frame)
    got = [(r.incident_key, r.status) for r in more_queries.cor6_status_log(spark, "").collect()]
    assert sorted(got) == [(f"INC-{key.upper()}", "CLOSED"), (f"INC-{key.upper()}", "OPEN")]
