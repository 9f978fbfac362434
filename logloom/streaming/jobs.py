"""What runs beside the stream at intervals, over the tables that the gateway writes: correlation, drift, sealing, metrics.

Each job reads the tables as they are, and writes its result under the number of its run, so that a run that is repeated replaces
what it wrote. The latest run of a table is its state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators import correlate, drift, export, lineage, metrics
from logloom.operators.parsers.base import Parser
from logloom.plans.config import Config
from logloom.plans.normalize import NATIVE
from logloom.sources.tables import append_ledger, materialised, names, put, remove, touching, upsert

#: Seconds between the runs of each job.
EVERY = {"correlation": 120, "drift": 300, "seal": 3600, "metrics": 1}


def stored(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A table of the gateway or of a job, all batches or runs; None where nothing is written yet."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/*=*/part-*")
    found = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files)  # a run that is being written has none yet
    return spark.read.parquet(f"{out}/{name}") if found is not None and len(found) else None


def latest(spark: SparkSession, out: str, name: str, before: int) -> DataFrame | None:
    """What the last run before this one wrote, of those that wrote rows; None where none did."""
    rows = stored(spark, out, name)
    run = rows.where(F.col("run") < before).agg(F.max("run")).first()[0] if rows is not None else None
    return None if run is None else rows.where(F.col("run") == run).drop("run")


def correlation(spark: SparkSession, out: str, run: int, as_of: datetime, config: Config = Config()) -> None:
    """Incidents of the last ``correlation_minutes``, merged into those on record.

    Read are the batches that hold lines of the window, which the last run kept the numbers of, and those that came since. ``incidents`` has what
    a run has found, with what is on record of the same entities; the record of all (``tables.current`` of ``incident_record``) is written anew only
    in the buckets that these touch.
    """
    rows, alerts = stored(spark, out, "events"), stored(spark, out, "alerts")
    if rows is None or alerts is None:
        return
    since, before = as_of - timedelta(minutes=config.correlation_minutes), latest(spark, out, "windows", run)
    last = before.first() if before is not None else None
    wide = last is not None and last.since > since  # a wider window than the last run's needs batches that it has let go
    new, _, high = _since(rows, None if wide else before)
    recent = _recent(new, last.recent if last and not wide else [], since)
    held = F.col("batch").isin(sorted(recent))
    found = materialised(correlate.incidents(correlate.detections(rows.where(held), alerts.where(held), since)), "new-incidents")
    record, keys = f"{out}/incident_record", ["key_type", "correlation_key"]
    known = touching(found, record, keys)
    changed = found if known is None else materialised(correlate.merge(known, found), "changed-incidents")
    put(changed, f"{out}/incidents/run={run}")
    upsert(changed, record, keys)
    put(spark.createDataFrame([(high, since, [*recent.items()])], "seen long, since timestamp, recent array<struct<batch:long,newest:long>>"), f"{out}/windows/run={run}")


def known_parsers(spark: SparkSession, approved: Sequence[Parser] = (), versions: DataFrame | None = None) -> DataFrame:
    """The native parsers and the approved ones, with the baselines that their drift is held against."""
    rows = [(p.name, p.version, p.format_type, dynamic, float(p.baseline)) for dynamic, parsers in ((False, NATIVE), (True, approved)) for p in parsers]
    parsers = spark.createDataFrame(rows, "parser_name string, parser_version string, format string, dynamic boolean, score double")
    none = spark.createDataFrame([], "parser_name string, active boolean, average_confidence double")
    return drift.baselines(parsers, versions if versions is not None else none)


def drift_check(spark: SparkSession, out: str, run: int, as_of: datetime, config: Config = Config(), known: DataFrame | None = None) -> None:
    """New drift alerts of the known parsers (the native ones, where none are given); open ones stay. A run keeps alerts that are open, and new ones."""
    rows, failed = stored(spark, out, "events"), stored(spark, out, "quarantine")
    if rows is None or failed is None:
        return
    known = known if known is not None else known_parsers(spark)
    before = latest(spark, out, "drift_alerts", run)
    new = drift.drift_alerts(drift.quality(rows, failed, known, as_of), before, config.drift_drop, config.drift_success, as_of)
    put(new if before is None else before.unionByName(new), f"{out}/drift_alerts/run={run}")


def _since(rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, int, int]:
    """The rows of batches that came after the last run, which kept the number of the last it had seen; and the numbers of both ends. Other
    batches' folders are not opened."""
    low = -1 if before is None else before.agg(F.max("seen")).first()[0]
    high = rows.agg(F.max("batch")).first()[0]
    return rows.where((F.col("batch") > low) & (F.col("batch") <= high)), low, high


def _recent(new: DataFrame, before: list, since: datetime) -> dict[int, int]:
    """The batches that hold lines received after ``since``, with the time of the newest: of those that the last run kept, and of new ones."""
    found = {r.batch: r.newest for r in new.groupBy("batch").agg(F.max(F.unix_micros("received_at")).alias("newest")).collect()}  # a row a batch
    edge = int(since.timestamp() * 1_000_000)
    return {b: t for b, t in ({x.batch: x.newest for x in before} | found).items() if t > edge}


def seal(spark: SparkSession, out: str, run: int, as_of: datetime, config: Config = Config()) -> None:
    """One Merkle batch of the lines that came before ``as_of`` and that no batch holds; none where there are no such lines.

    Read are the batches of the gateway since the last run, and what that run held back as newer than its ``as_of``: a line is sealed once,
    however late it comes. ``ledger`` has a line for each batch, ``frontier`` the peaks of the one tree of all leaves ever sealed.
    """
    rows = stored(spark, out, "normalized")
    if rows is None:
        return
    before = latest(spark, out, "seals", run)
    new, low, high = _since(rows, before)
    columns = ["received_at", "ingest_seq", "raw_event_id", "raw_hash"]
    held = spark.read.parquet(f"{out}/held/run={before.first().run_number}") if before is not None else None
    raw = materialised(new.select(*columns) if held is None else new.select(*columns).unionByName(held), "raw")
    due = raw.where(F.col("received_at") < F.lit(as_of))
    if high == low and due.isEmpty():
        return
    number = 1 + (0 if before is None else before.first().batch_number)
    leaves = materialised(lineage.seal(due, batch_number=number), "leaves")
    sealed = not leaves.isEmpty()
    if sealed:
        peaks = stored(spark, out, "frontier")
        last = None if peaks is None else peaks.where(F.col("run") < run).agg(F.max("run")).first()[0]
        old = None if last is None else peaks.where(F.col("run") == last).drop("run")
        grown = materialised(lineage.frontier(leaves.select(F.lit(0).cast("long").alias("tree"), F.col("leaf_index").alias("place"), "hash"), old), "frontier")
        whole = lineage.frontier_roots(grown).select(F.col("n").alias("ledger_events"), F.col("merkle_root").alias("ledger_root"))
        span = due.agg(F.min("received_at").alias("period_start"), F.max("received_at").alias("period_end"))
        batch = materialised(lineage.roots(leaves).withColumn("sealed_at", F.lit(as_of)).crossJoin(span).crossJoin(whole), "batch")  # one row each
        put(leaves, f"{out}/leaves/run={run}")
        put(grown, f"{out}/frontier/run={run}")
        put(batch, f"{out}/batches/run={run}")
        append_ledger(ledger_lines(batch), f"{out}/ledger", run)
    put(raw.where(F.col("received_at") >= F.lit(as_of)), f"{out}/held/run={run}")
    put(spark.createDataFrame([(high, number if sealed else number - 1, run)], "seen long, batch_number long, run_number long"), f"{out}/seals/run={run}")


def ledger_lines(batches: DataFrame) -> DataFrame:
    """Sealed batches as the ledger tells of them."""
    return batches.select(
        F.concat(F.lit("BATCH-"), F.lpad(F.col("batch_number").cast("string"), 6, "0")).alias("batchId"), F.col("batch_number").alias("batchNumber"), F.col("period_start").alias("periodStart"), F.col("period_end").alias("periodEnd"),
        F.col("event_count").alias("eventCount"), F.col("merkle_root").alias("merkleRoot"), F.col("sealed_at").alias("createdAt"), F.lit("MERKLE_BATCH_PUBLISH").alias("recordType"),
    )


RATE_S = 5  # trailing seconds of the rate


def measure(spark: SparkSession, out: str, run: int, as_of: datetime, config: Config = Config()) -> None:
    """A row of totals and the rate of the last seconds: the metrics sink.

    Read are the batches since the last run, whose totals are added to that run's, and those that may hold lines of the last seconds."""
    rows = stored(spark, out, "normalized")
    if rows is None:
        return
    before = latest(spark, out, "metrics", run)
    new, _, high = _since(rows, before)
    sums = metrics.totals(new).first()
    last = before.first() if before is not None else None
    counted = ("total", "stored", "quarantined", "alerts")
    totals = [sums[c] + (last[c] if last else 0) for c in counted]
    recent = _recent(new, last.recent if last else [], as_of - timedelta(seconds=RATE_S))
    rate = metrics.events_per_second(rows.where(F.col("batch").isin(sorted(recent))), as_of, RATE_S).first().eps
    fields = ", ".join(f"{c} long" for c in counted)
    put(spark.createDataFrame([(*totals, rate, as_of, high, [*recent.items()])], f"{fields}, eps double, as_of timestamp, seen long, recent array<struct<batch:long,newest:long>>"), f"{out}/metrics/run={run}")


def export_files(spark: SparkSession, out: str, path: str, kind: str, config: Config = Config()) -> None:
    """All stored events in a wire format, to text files; events without vendor or product take those of the settings."""
    rows = stored(spark, out, "events")
    if rows is not None:
        export.write_files(rows, path, kind, config.export_vendor, config.export_product)


KEPT_RUNS = 1000


def clear_runs(spark: SparkSession, out: str, run: int, keep: int = KEPT_RUNS) -> int:
    """Removes what runs before the last ``keep`` have left of tables whose latest run is their state. Leaves, batches and the ledger stay."""
    old = [f"{out}/{t}/{n}" for t in ("incidents", "windows", "drift_alerts", "metrics", "held", "seals", "frontier") for n in names(spark, f"{out}/{t}") if n.startswith("run=") and int(n[4:]) < run - keep]
    for path in old:
        remove(spark, path)
    return len(old)


JOBS: dict[str, Callable] = {"correlation": correlation, "drift": drift_check, "seal": seal, "metrics": measure}


def start(spark: SparkSession, out: str, checkpoint: str, config: Config = Config(), names: tuple[str, ...] = tuple(JOBS), every: dict[str, int] = EVERY, now: Callable[[], datetime] = datetime.now, dynamic: Callable[[], Sequence[Parser]] = tuple) -> list[StreamingQuery]:
    """Starts the named jobs, each as a stream of ticks at its interval. A job that fails ends its own stream only. ``dynamic`` is asked for the
    approved parsers at every drift check."""

    def running(name: str) -> StreamingQuery:
        def tick(_, run: int) -> None:
            given = {"known": known_parsers(spark, dynamic())} if name == "drift" else {}
            JOBS[name](spark, out, run, now(), config, **given)

        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.queryName(f"job-{name}").foreachBatch(tick).option("checkpointLocation", f"{checkpoint}/{name}").trigger(processingTime=f"{every[name]} seconds").start()

    return [running(n) for n in names]


def live_tail(raw: DataFrame, seconds: int = 10) -> DataFrame:
    """The stream's lines as they come: (received_at, raw_message, source) for a sink that shows them. ``seconds`` is the watermark of what follows;
    without state behind it no line is dropped."""
    return raw.withWatermark("received_at", f"{seconds} seconds").select("received_at", "raw_message", "source")
