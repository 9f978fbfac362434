"""A stream of raw lines to tables of events, quarantined lines and alerts; ``jobs`` has what runs over these at intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators import sigma
from logloom.operators.parser_index import ParserIndex
from logloom.operators.parsers.base import Parser
from logloom.plans.config import Config
from logloom.plans.normalize import events, normalize, quarantine
from logloom.sources.tables import exists, put
from logloom.streaming import live as live_state


def write_batch(rows: DataFrame, batch: int, out: str) -> None:
    """One micro-batch to the tables, each under its batch number.

    The normalized rows are written once, and the others read them, so that all tables tell of the same rows. A batch that is run again finds
    its normalized rows and leaves them as they are, so that streams that read this table see each row once; it writes the other tables anew.
    """
    spark = rows.sparkSession
    path = f"{out}/normalized/batch={batch}"
    if not exists(spark, path):
        put(rows, path)
    kept = spark.read.schema(rows.schema).parquet(path)
    put(events(kept), f"{out}/events/batch={batch}")
    put(quarantine(kept), f"{out}/quarantine/batch={batch}")
    put(sigma.alerts(events(kept)), f"{out}/alerts/batch={batch}")


def live(spark: SparkSession, out: str, checkpoint: str, minutes: int = 30, available_now: bool = False, every: str = "10 seconds", event_time: bool = False) -> list[StreamingQuery]:
    """Starts what goes on with the normalized table as its batches come: running metrics to ``live_metrics`` and the incidents of the last
    ``minutes`` to ``live_incidents``, the figures and incidents that each micro-batch has changed. By the clock, incidents run until they are stopped."""
    schema = spark.read.parquet(f"{out}/normalized").drop("batch").schema
    rows = spark.readStream.schema(schema).parquet(f"{out}/normalized/batch=*")
    waited = F.unix_millis(F.current_timestamp()) - F.unix_millis("received_at")
    found = {"live_metrics": live_state.running_metrics(rows.withColumn("latency", waited.cast("double")), "latency"), "live_incidents": live_state.running_incidents(live_state.line_detections(rows), minutes, event_time)}

    def start(name: str, frame: DataFrame) -> StreamingQuery:
        writer = frame.writeStream.foreachBatch(lambda part, n: put(part, f"{out}/{name}/batch={n}")).outputMode("update").option("checkpointLocation", f"{checkpoint}/{name}")
        return (writer.trigger(availableNow=True) if available_now and (event_time or name == "live_metrics") else writer.trigger(processingTime=every)).start()

    return [start(*x) for x in found.items()]


def run(
    raw: DataFrame, out: str, checkpoint: str, config: Config = Config(), rules: Sequence[sigma.SigmaRule] | Callable[[], Sequence[sigma.SigmaRule]] = sigma.RULES, dynamic: Callable[[], Sequence[Parser]] = tuple,
    available_now: bool = False, every: str = "10 seconds", index: Callable[[], ParserIndex | None] = lambda: None,
) -> StreamingQuery:
    """Starts the stream. ``dynamic``, ``index`` (of a table of parsers), and ``rules`` where that is a function (``sigma.stored_rules``), are asked at every micro-batch, so an
    approved parser or a changed rule takes part from the next one on. No line is dropped for being late: there is no event-time state."""

    def each(rows: DataFrame, batch: int) -> None:
        if "ingest_seq" not in rows.columns:
            rows = rows.withColumn("ingest_seq", F.monotonically_increasing_id())
        write_batch(normalize(rows, config, rules() if callable(rules) else rules, dynamic(), index(), f"{out}/lookups"), batch, out)

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def rates(raw: DataFrame, seconds: int = 5, slide: int = 1, late: str = "10 seconds") -> DataFrame:
    """Events per second over sliding windows of ``received_at``; state is dropped once the watermark has passed."""
    windows = raw.withWatermark("received_at", late).groupBy(F.window("received_at", f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.end").alias("window_end"), "n", (F.col("n") / seconds).alias("eps"))
