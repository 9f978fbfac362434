"""Keyed state of streams against the batch operators, after every micro-batch and over restarts."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.operators import correlate, metrics
from logloom.plans.normalize import events, normalize
from logloom.streaming import live

START = datetime(2026, 1, 5, 10, 0)
LINES = (
    "src={s} dst=10.0.0.2 dpt=22 action=deny user={u}", "src={s} dst=10.0.0.2 dpt=4444 action=allow user={u}", "src={s} dst=10.0.0.2 dpt=23 action=allow scan=1", "hello {s}",
    "CEF:0|a|b|c|d|port scan|9|src={s} dst=10.0.0.9 dpt=80 suser={u}", '{{"event_type":"alert","src_ip":"{s}","dest_ip":"2.2.2.2","dest_port":6667,"proto":"TCP","alert":{{"severity":1}}}}',
)


def normalized_batches(spark, folder, n, seed):
    """Written micro-batches of normalized lines, time going on by about ten minutes each, some lines late; with a latency that some lack."""
    rng, seq = random.Random(seed), 0
    for b in range(n):
        rows = []
        for _ in range(rng.choice([1, 40, 80])):
            seq += 1
            at = START + timedelta(minutes=10 * b + rng.choice([0, 1, 5, 9]) - (25 if rng.random() < 0.2 else 0), microseconds=rng.randrange(10**6))
            rows.append((rng.choice(LINES).format(s=f"10.1.1.{rng.randrange(6)}", u=rng.choice("ab")), "T", at, seq, rng.choice([None, round(rng.random() * 50, 3)])))
        raw = spark.createDataFrame(rows, "raw_message string, source string, received_at timestamp, ingest_seq long, latency double")
        lines = normalize(raw.drop("latency")).join(raw.select("ingest_seq", "latency"), "ingest_seq")
        lines.write.parquet(f"{folder}/{b:03d}")
    return spark.read.parquet(f"{folder}/000").schema


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/live/*")


def feed(spark, folder, b):
    """One file, so one micro-batch."""
    spark.read.parquet(f"{folder}/in/{b:03d}").coalesce(1).write.parquet(f"{folder}/live/{b:03d}")


def run(frame, folder, name):
    def each(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    query = frame.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def test_running_metrics(spark, tmp_path):
    """Every micro-batch is a restart from the checkpoint."""
    folder = str(tmp_path)
    schema = normalized_batches(spark, f"{folder}/in", 4, 3)
    for b in range(4):
        feed(spark, folder, b)
        run(live.running_metrics(stream(spark, folder, schema), "latency"), folder, "metrics")
        got = {(r.kind, r.name): r for r in live.latest_metrics(spark.read.parquet(f"{folder}/metrics")).collect()}
        so_far = spark.read.parquet(f"{folder}/live/*")
        ok = events(so_far)
        for kind, rows in (("format", metrics.by_format(ok)), ("tier", metrics.by_tier(ok))):
            assert {r[0]: r.n for r in rows.collect() if r.n} == {name: r.n for (k, name), r in got.items() if k == kind}
        whole = metrics.totals(so_far).first()
        count = lambda name: got["outcome", name].n if ("outcome", name) in got else 0
        assert (whole.stored, whole.quarantined, whole.alerts) == (count("stored"), count("quarantined"), count("alerts"))
        if ("latency", "latest") not in got:
            continue
        late, want = got["latency", "latest"], metrics.latency(so_far, "latency", "received_at", "ingest_seq").first()
        assert (late.n, late.p50, late.p95, late.p99) == (want.n, want.p50, want.p95, want.p99) and abs(late.average - want.average) < 1e-9
    assert late.n == metrics.RING or so_far.where("latency is not null").count() < metrics.RING


def incident(r):
    return (r.key_type, r.correlation_key, r.incident_key, r.root_event_id, *r.tactic_chain, r.distinct_tactic_count, r.event_count, r.detection_count, r.severity, r.first_seen_at, r.last_seen_at)


def test_running_incidents(spark, tmp_path):
    """At every tick the incidents of the batch operator over all lines, in the window of that tick; late rows are in it, old ones leave it."""
    folder = str(tmp_path)
    schema = normalized_batches(spark, f"{folder}/in", 6, 8)
    seen = []
    for b in range(6):
        feed(spark, folder, b)
        run(live.running_incidents(live.line_detections(stream(spark, folder, schema)), 30, event_time=True), folder, "incidents")
        rows = spark.read.parquet(f"{folder}/live/*")
        found = live.line_detections(rows)
        newest = found.agg(F.max("at")).first()[0].replace(microsecond=0)
        since = newest - timedelta(minutes=30)
        want = correlate.incidents(correlate.detections(events(rows), matches(rows), datetime(2000, 1, 1)).where(F.col("at") >= F.lit(since)))
        got = live.latest_incidents(spark.read.parquet(f"{folder}/incidents"))
        seen.append(sorted(map(incident, got.collect()), key=str))
        assert seen[-1] == sorted(map(incident, want.collect()), key=str)
    assert any(seen) and len({str(s) for s in seen}) > 3


def matches(rows):
    from logloom.operators import sigma

    return sigma.alerts(events(rows))


def test_clock_window(spark, tmp_path):
    """By the clock: detections of now are in the window, those of an hour ago are not."""
    folder, now = str(tmp_path), datetime.now()
    rows = [(x.format(s="10.1.1.1", u="a"), "T", now - timedelta(minutes=m), i) for i, (x, m) in enumerate([(LINES[0], 1), (LINES[1], 2), (LINES[4], 65)])]
    raw = spark.createDataFrame(rows, "raw_message string, source string, received_at timestamp, ingest_seq long")
    normalize(raw).coalesce(1).write.parquet(f"{folder}/live/000")
    schema = spark.read.parquet(f"{folder}/live/000").schema
    frame = live.running_incidents(live.line_detections(stream(spark, folder, schema)))
    # Timers of the clock keep a stream going, so it is stopped here, not at the end of the files.
    query = frame.writeStream.format("memory").queryName("clock").outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + 90
        while time.monotonic() < end and query.exception() is None and spark.table("clock").count() < 2:
            time.sleep(1)
        got = {(r.key_type, r.event_count) for r in spark.table("clock").where("active").collect()}
    finally:
        query.stop()
    assert got == {("IP", 2), ("USER", 2)}
