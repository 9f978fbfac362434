import socket
import time

from pyspark.sql import functions as F

from logloom.plans.normalize import normalize
from logloom.sources.lines import SyslogUdp, as_raw, stream_files
from logloom.streaming import gateway


def test_datagrams(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    spark.dataSource.register(SyslogUdp)
    stream = spark.readStream.format("syslog_udp").option("host", "127.0.0.1").option("port", port).load()
    query = stream.writeStream.format("memory").queryName("datagrams").trigger(processingTime="1 second").start()
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for i in range(240):
                out.sendto(f"line {i}\n".encode(), ("127.0.0.1", port))
                time.sleep(0.25)
                if i % 4 == 0 and spark.table("datagrams").count() > 3:
                    break
        assert query.exception() is None
        assert all(r.value.startswith("line ") for r in spark.table("datagrams").collect()) and spark.table("datagrams").count() > 3
    finally:
        query.stop()


def test_stream_gives_what_batch_gives(spark, tmp_path):
    """Two batches of files; a batch that is run again replaces its rows."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    lines = ["src=10.0.0.1 dst=10.0.0.2 dpt=23 action=deny", "hello", "CEF:0|a|b|c|d|scan|5|src=1.1.1.1"]

    def run():
        raw = as_raw(stream_files(spark, str(source)), "value", "FILE", F.lit("2026-01-01 00:00:00").cast("timestamp"))
        gateway.run(raw, out, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()

    (source / "a.log").write_text("\n".join(lines[:2]) + "\n\n")
    run()
    (source / "b.log").write_text(lines[2] + "\n")
    run()
    raw = spark.createDataFrame([(x, "FILE", i) for i, x in enumerate(lines)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    gateway.write_batch(normalize(raw.where("ingest_seq = 2")), 1, out)
    seen = lambda df: sorted(tuple(r) for r in df.select("raw_message", F.coalesce("format", F.lit("")), "outcome.code").collect())
    assert seen(spark.read.parquet(f"{out}/normalized")) == seen(normalize(raw))
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
    assert sorted(r.rule_id for r in spark.read.parquet(f"{out}/alerts").collect()) == ["SIGMA-T1046-SCAN-001", "SIGMA-T1552-TELNET-001"]


def test_rates(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds(F.col("id") + 1_767_225_600).alias("received_at")).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("received_at timestamp").parquet(str(tmp_path / "rows"))
    query = gateway.rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r.n: r.eps for r in spark.table("rates").collect()}
    assert rows[5] == 1.0 and spark.table("rates").count() == 14


def test_jobs_over_the_tables(spark, tmp_path):
    """Correlation, drift, sealing and metrics over what the gateway wrote, run after run; a run that is repeated changes nothing."""
    from datetime import datetime, timedelta

    from logloom.plans.config import Config
    from logloom.streaming import jobs

    out, at = str(tmp_path / "out"), datetime(2026, 1, 5, 10, 0)
    for job in jobs.JOBS.values():
        job(spark, out, 0, at)  # nothing is written yet
    lines = ["src=10.0.0.1 dst=10.0.0.2 dpt=22 action=deny", "src=10.0.0.1 dst=10.0.0.2 dpt=4444 action=allow", "src=10.0.0.1 dst=10.0.0.2 dpt=23 scan=1", "hello"]

    def batch(n: int, when: datetime, some: list[str]) -> None:
        rows = spark.createDataFrame([(x, "T", i, when) for i, x in enumerate(some)], "raw_message string, source string, ingest_seq long, received_at timestamp")
        gateway.write_batch(normalize(rows), n, out)

    batch(0, at - timedelta(minutes=5), lines)
    later = at + timedelta(minutes=10)
    for run, when in ((1, at), (1, at), (2, later)):
        if run == 2:
            batch(1, at + timedelta(minutes=9), ["src=10.9.9.9 dst=10.0.0.2 dpt=22 action=deny", "src=10.9.9.9 dst=10.0.0.2 dpt=6667 action=allow"])
        for job in jobs.JOBS.values():
            job(spark, out, run, when, Config(correlation_minutes=30))
    found = jobs.latest(spark, out, "incidents", 9)
    assert {r.correlation_key: r.status for r in found.collect()} == {"10.0.0.1": "OPEN", "10.9.9.9": "OPEN"}
    assert [r.correlation_key for r in jobs.latest(spark, out, "incidents", 2).collect()] == ["10.0.0.1"]
    batches = {r.batch_number: r.event_count for r in jobs.stored(spark, out, "batches").collect()}
    assert batches == {1: 4, 2: 2}
    figures = {r.run: (r.total, r.stored, r.quarantined) for r in jobs.stored(spark, out, "metrics").collect()}
    assert figures == {1: (4, 3, 1), 2: (6, 5, 1)}
    # Settings act: a window of five minutes sees the second batch only; no drift where any rate will do.
    jobs.correlation(spark, str(tmp_path / "out"), 0, later, Config(correlation_minutes=5))
    assert [r.correlation_key for r in spark.read.parquet(f"{out}/incidents/run=0").collect()] == ["10.9.9.9"]
    assert jobs.latest(spark, out, "drift_alerts", 9) is None and jobs.stored(spark, out, "drift_alerts").count() == 0
    jobs.export_files(spark, out, str(tmp_path / "wire"), "leef", Config(export_vendor="Own"))
    assert spark.read.text(str(tmp_path / "wire")).count() == 5


def test_ticks(spark, tmp_path):
    from logloom.streaming import jobs

    rows = spark.createDataFrame([("src=10.0.0.1 dpt=22 x=y", "T", 0)], "raw_message string, source string, ingest_seq long").withColumn("received_at", F.lit("2026-01-05 10:00:00").cast("timestamp"))
    gateway.write_batch(normalize(rows), 0, str(tmp_path / "out"))
    (query,) = jobs.start(spark, str(tmp_path / "out"), str(tmp_path / "checkpoint"), names=("metrics",))
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = jobs.latest(spark, str(tmp_path / "out"), "metrics", 1 << 30)
            if got is not None:
                break
        assert query.exception() is None and got.first().total == 1
    finally:
        query.stop()


def test_live_tail(spark, tmp_path):
    from logloom.streaming import jobs

    spark.range(3).select(F.timestamp_seconds(F.col("id")).alias("received_at"), F.col("id").cast("string").alias("raw_message"), F.lit("T").alias("source")).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("received_at timestamp, raw_message string, source string").parquet(str(tmp_path / "rows"))
    query = jobs.live_tail(stream).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.raw_message for r in spark.table("tail").collect()) == ["0", "1", "2"]
