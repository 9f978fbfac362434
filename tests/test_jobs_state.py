"""Jobs that go on from their last run: what they seal, correlate, measure and watch over many batches, each read once."""

import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.operators import correlate, lineage, sigma
from logloom.operators.parsers.dynamic import DynamicParser, dynamic
from logloom.plans.config import Config
from logloom.plans.normalize import events, normalize
from logloom.sources import tables
from logloom.sources.lines import as_raw, stream_files
from logloom.streaming import gateway, jobs

AT = datetime(2026, 1, 5, 10, 0)


def batch(spark, out, n, lines, parsers=()):
    """Lines (text, minutes after ``AT``) as the gateway's batch n."""
    rows = [(x, "T", 100 * n + i, AT + timedelta(minutes=m)) for i, (x, m) in enumerate(lines)]
    raw = spark.createDataFrame(rows, "raw_message string, source string, ingest_seq long, received_at timestamp")
    gateway.write_batch(normalize(raw, dynamic=parsers), n, out)


def test_sealing_from_the_frontier(spark, tmp_path):
    """A late line is sealed once, one from the future waits; a run that is repeated changes nothing; old batches are not opened again."""
    out = str(tmp_path)
    batch(spark, out, 0, [(f"src=10.0.0.{i} x=y", i) for i in range(5)])
    jobs.seal(spark, out, 1, AT + timedelta(minutes=10))
    batch(spark, out, 1, [("late=1 x=y", -60), ("a=1 b=2", 12), ("future=1 x=y", 300)])
    shutil.move(f"{out}/normalized/batch=0/", f"{out}/aside")  # what is sealed isn't read again
    (tmp_path / "normalized" / "batch=0").mkdir()
    for _ in range(2):
        jobs.seal(spark, out, 2, AT + timedelta(minutes=70))
    jobs.seal(spark, out, 3, AT + timedelta(minutes=130))  # nothing is due
    jobs.seal(spark, out, 4, AT + timedelta(minutes=400))
    leaves = spark.read.parquet(f"{out}/leaves").select("batch_number", "leaf_index", "raw_event_id", "hash")
    assert [r["count"] for r in leaves.groupBy("batch_number").count().orderBy("batch_number").collect()] == [5, 2, 1]
    assert leaves.select("raw_event_id").distinct().count() == 8
    ledger = {r.batchNumber: r for r in spark.read.json(f"{out}/ledger").collect()}
    want = {r.batch_number: (r.event_count, r.merkle_root) for r in lineage.roots(leaves).collect()}
    assert {n: (r.eventCount, r.merkleRoot) for n, r in ledger.items()} == want and {r.recordType for r in ledger.values()} == {"MERKLE_BATCH_PUBLISH"}
    order = leaves.orderBy("batch_number", "leaf_index").select("hash").collect()
    whole = spark.createDataFrame([(1, i, r.hash) for i, r in enumerate(order)], "batch_number long, leaf_index long, hash string")
    last = spark.read.parquet(f"{out}/batches").orderBy(F.desc("run")).first()
    assert (last.ledger_events, last.ledger_root) == tuple(lineage.roots(whole).select("event_count", "merkle_root").first())


def test_correlation_over_runs(spark, tmp_path):
    """At each run the incidents that the batch operator finds in the window; only batches that can hold its lines are read."""
    out, lines = str(tmp_path), ("src=10.0.0.{} dst=10.0.0.9 dpt=22 action=deny", "src=10.0.0.{} dst=10.0.0.9 dpt=4444 action=allow", "src=10.0.0.{} dst=10.0.0.9 dpt=23 x=1")
    for n in range(4):
        batch(spark, out, n, [(x.format(n if n < 3 else 0), 20 * n + i) for i, x in enumerate(lines)] + [(lines[0].format(7), 20 * n - 15)])
        now = AT + timedelta(minutes=20 * n + 5)
        jobs.correlation(spark, out, n + 1, now, Config(correlation_minutes=30))
        rows = jobs.stored(spark, out, "normalized")
        want = correlate.incidents(correlate.detections(events(rows), sigma.alerts(events(rows)), now - timedelta(minutes=30)))
        key = lambda r: (r.correlation_key, r.event_count, r.detection_count, r.severity, r.last_seen_at)
        assert sorted(map(key, jobs.latest(spark, out, "incidents", n + 2).collect())) == sorted(map(key, want.collect()))
    windows = jobs.latest(spark, out, "windows", 99).first()
    assert sorted(x.batch for x in windows.recent) == [2, 3]
    record = {r.correlation_key: r.first_seen_at for r in tables.current(spark, f"{out}/incident_record").collect()}
    assert sorted(record) == ["10.0.0.0", "10.0.0.1", "10.0.0.2"] and record["10.0.0.0"] == AT  # the span on record is the wider
    assert jobs.clear_runs(spark, out, 4, keep=1) == 4 and jobs.latest(spark, out, "incidents", 9).count() == len(want.collect())


def test_drift_of_approved_parsers(spark, tmp_path):
    out = str(tmp_path)
    spec = DynamicParser("inferred", r"GATE (?<a>\S+) (?<b>\S+)", confidence=0.9, format_type="GATE")
    parser = dynamic(spec)
    batch(spark, out, 0, [("GATE x y", i) for i in range(6)] + [("CEF: no header", 1)], (parser,))
    jobs.drift_check(spark, out, 1, AT + timedelta(minutes=30), known=jobs.known_parsers(spark, [parser]))
    assert {r.parser_name for r in spark.read.parquet(f"{out}/drift_alerts/run=1").collect()} <= {"inferred", "cef_leef_parser"}
    known = {r.parser_name: (r.format, r.baseline) for r in jobs.known_parsers(spark, [parser]).collect()}
    assert known["inferred"] == ("GATE", 0.9) and len(known) == 5
    versions = spark.createDataFrame([("inferred", True, 0.5), ("inferred", False, 0.1)], "parser_name string, active boolean, average_confidence double")
    assert {r.parser_name: r.baseline for r in jobs.known_parsers(spark, [parser], versions).collect()}["inferred"] == 0.5


def test_live_tables(spark, tmp_path):
    """The gateway's table as a stream: figures and incidents equal those of all batches; a batch that is written again is not counted again."""
    out = str(tmp_path / "out")
    for n in range(2):
        batch(spark, out, n, [("src=10.0.0.1 dst=10.0.0.9 dpt=22 action=deny", n), ("src=10.0.0.1 dst=10.0.0.9 dpt=4444 action=allow", n), ("hello", n)])
        for query in gateway.live(spark, out, str(tmp_path / "checkpoint"), available_now=True, event_time=True):
            query.awaitTermination(100)
            assert query.exception() is None
        batch(spark, out, n, [("src=10.0.0.1 dst=10.0.0.9 dpt=22 action=deny", n)])
    figures = {(r.kind, r.name): r.n for r in gateway.live_state.latest_metrics(spark.read.parquet(f"{out}/live_metrics")).collect()}
    assert figures["outcome", "stored"] == 4 and figures["outcome", "quarantined"] == 2 and figures["latency", "latest"] == 6
    found = gateway.live_state.latest_incidents(spark.read.parquet(f"{out}/live_incidents")).collect()
    assert [(r.correlation_key, r.event_count) for r in found] == [("10.0.0.1", 4)]


def test_rules_reach_a_running_engine(spark, tmp_path):
    """A rule that another store changes takes part from the next micro-batch on, and outlives the engine; all versions stay."""
    source, out, rules = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "rules")
    source.mkdir()
    asked = sigma.stored_rules(spark, rules)
    assert asked() == list(sigma.RULES)

    def run(n):
        (source / f"{n}.log").write_text("src=10.0.0.1 dst=10.0.0.2 dpt=23 action=deny\n")
        gateway.run(as_raw(stream_files(spark, str(source)), "value", "FILE"), out, str(tmp_path / "checkpoint"), rules=asked, available_now=True).awaitTermination(100)
        return sorted(r.rule_id for r in spark.read.parquet(f"{out}/alerts").where(F.col("batch") == n).collect())

    assert run(0) == ["SIGMA-T1552-TELNET-001"]
    store = sigma.RuleStore()
    assert store.save(spark, rules) == len(sigma.RULES) and store.save(spark, rules) == 0
    store.toggle("SIGMA-T1552-TELNET-001", False)
    store.upsert(sigma.parse_rule({"id": "MINE", "title": "t", "level": "high", "tags": ["attack.t1021"], "detection": {"a": {"dst_port": [23], "source.ip|startswith": "10."}, "condition": "a"}}))
    assert store.save(spark, rules) == 2 and run(1) == ["MINE"]
    other = sigma.RuleStore.load(spark, rules)
    assert other.rules() == store.rules()
    other.delete("MINE")
    other.save(spark, rules)
    assert run(2) == [] and "MINE" not in {r.id for r in sigma.RuleStore.load(spark, rules).rules()}
    assert {r.version for r in tables.current(spark, rules).where("rule_id = 'MINE'").collect()} == {1, 2}


def test_rule_files(tmp_path):
    (tmp_path / "b.json").write_text('{"id": "B", "title": "b", "detection": {"selection": {"dst_port": 1}}}')
    (tmp_path / "a.json").write_text('{"id": "A", "title": "a", "detection": {"selection": {"user|contains": ["x", "y"]}}}')
    (tmp_path / "note.txt").write_text("none")
    found = sigma.load_rules(str(tmp_path))
    assert [r.id for r in found] == ["A", "B"] and [sigma.rule_from_text(sigma.rule_text(r)) for r in found] == found
