"""State that goes on from micro-batch to micro-batch: running metrics, and incidents of the last minutes by entity.

Both are keyed state (``transformWithState``) behind sums that each task makes of its own rows, so no key's rows meet in one task, and no
history is read: a micro-batch costs what its own rows cost.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from logloom.operators import correlate
from logloom.operators.metrics import RING

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs Spark's RocksDB state store; streams that have begun keep the store that they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# Running metrics

_COUNTS = pa.schema([("kind", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("latest", pa.list_(pa.struct([("at", pa.int64()), ("seq", pa.int64()), ("value", pa.float64())])))])
_COUNTS_DDL = "kind string, name string, n bigint, latest array<struct<at:bigint,seq:bigint,value:double>>"
METRICS = "kind string, name string, n bigint, average double, p50 double, p95 double, p99 double"


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows, and its latest latencies."""
    counts: Counter = Counter()
    latest: list[tuple] = []
    for batch in batches:
        for name in ("format", "tier", "outcome"):
            for pair in batch.column(name).value_counts().to_pylist():
                counts[name, pair["values"]] += pair["counts"]
        alerts = batch.column("alerts")
        counts["outcome", "alerts"] += pc.sum(alerts.filter(pc.greater(alerts, 0))).as_py() or 0
        timed = batch.filter(pc.is_valid(batch.column("latency")))
        if len(latest) == RING:  # what is older than all of the ring can't enter it
            timed = timed.filter(pc.greater_equal(timed.column("at"), latest[-1][0]))
        latest = heapq.nlargest(RING, [*latest, *zip(*(timed.column(c).to_pylist() for c in ("at", "seq", "latency")), strict=True)])
    rows = [(kind, name, n, None) for (kind, name), n in counts.items() if name is not None]
    if latest:
        rows.append(("latency", "latest", len(latest), [{"at": a, "seq": s, "value": v} for a, s, v in latest]))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _COUNTS.types, strict=True)], schema=_COUNTS)


class _Metrics(StatefulProcessor):
    """A counter that only grows, or the ring of the latest latencies."""

    def init(self, handle) -> None:
        self._n = handle.getValueState("n", "n bigint")
        self._ring = handle.getListState("ring", "at bigint, seq bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, name = key
        if kind == "latency":
            held = [tuple(x) for x in self._ring.get()] if self._ring.exists() else []
            held = heapq.nlargest(RING, [*held, *((x["at"], x["seq"], x["value"]) for r in rows for x in r.latest)])
            self._ring.put(held)
            values = sorted(v for _, _, v in held)
            at = lambda p: values[min(int(len(values) * p), len(values) - 1)]
            yield Row(kind=kind, name=name, n=len(values), average=sum(values) / len(values), p50=at(0.5), p95=at(0.95), p99=at(0.99))
        else:
            n = (self._n.get()[0] if self._n.exists() else 0) + sum(r.n for r in rows)
            self._n.update((n,))
            yield Row(kind=kind, name=name, n=n, average=None, p50=None, p95=None, p99=None)

    def close(self) -> None:
        pass


def running_metrics(normalized: DataFrame, latency: str | None = None) -> DataFrame:
    """A stream of normalized lines to a stream of figures (kind, name, n, average, p50, p95, p99), those that a micro-batch has changed.

    Kinds: ``format`` and ``tier``, stored events by format and confidence tier; ``outcome``: total, stored, quarantined, alerts; ``latency``:
    the latest ``RING`` values of the column ``latency`` by (received_at, ingest_seq), sorted, at floor(n * p). Rows without a value
    don't enter the ring. Use output mode "update".
    """
    keyed_state(normalized.sparkSession)
    ok = F.col("outcome.code") == "NORMAL"
    value = F.col(latency).cast("double") if latency else F.lit(None).cast("double")
    rows = normalized.select(
        F.when(ok, F.col("format")).alias("format"), F.when(ok, F.col("confidence_tier")).alias("tier"), F.when(ok, "stored").otherwise("quarantined").alias("outcome"),
        F.when(ok, F.size("threat.sigma_matches")).alias("alerts"), F.unix_micros("received_at").alias("at"), F.col("ingest_seq").cast("bigint").alias("seq"), value.alias("latency"),
    )
    return rows.mapInArrow(_task_counts, _COUNTS_DDL).groupBy("kind", "name").transformWithState(_Metrics(), METRICS, "Update", "None")


def latest_metrics(rows: DataFrame) -> DataFrame:
    """The figures as they stand, of all that ``running_metrics`` has put out so far, in any number of micro-batches (column ``batch``)."""
    picked = rows.groupBy("kind", "name").agg(F.max_by(F.struct("n", "average", "p50", "p95", "p99"), "batch").alias("x"))
    return picked.select("kind", "name", "x.*")


# Incidents by entity

_PARTS = pa.schema(
    [("key_type", pa.string()), ("key", pa.string()), ("second", pa.timestamp("us", "UTC")), ("tactics", pa.list_(pa.string())), ("first_us", pa.int64()), ("last_us", pa.int64()), ("root", pa.string())]
    + [(c, pa.int64()) for c in ("score", "events", "detections")]
)
_PARTS_DDL = "key_type string, key string, second timestamp, tactics array<string>, first_us bigint, last_us bigint, root string, score bigint, events bigint, detections bigint"
_KEPT = "second bigint, tactics array<string>, first_us bigint, last_us bigint, root string, score bigint, events bigint, detections bigint"
_SUMS = "key_type string, key string, active boolean, since timestamp, tactics array<string>, first_seen_at timestamp, last_seen_at timestamp, root string, score int, event_count bigint, detection_count bigint"


def line_detections(normalized: DataFrame) -> DataFrame:
    """What each stored event adds to its entities (key_type, key, event_id, at, tactics, score, detections), by itself: its rule matches, made when it
    was received, or else its technique, at its own time."""
    stored = normalized.where("outcome.code = 'NORMAL'")
    tactic = lambda t: F.when(t.isNotNull(), correlate.canonical_tactic(t))
    matches = F.col("threat.sigma_matches")
    matched = F.size(matches) > 0
    user = F.coalesce(F.when(~correlate.blank(F.col("source.user")), F.col("source.user")), F.col("extensions")["user"])
    ip = F.when(~correlate.blank(F.col("source.ip")), F.col("source.ip"))
    found = stored.where(matched | F.col("threat.technique_id").isNotNull()).select(
        "event_id", F.when(matched, F.col("received_at")).otherwise(F.col("timestamp_utc")).alias("at"),
        F.array_compact(F.array_distinct(F.when(matched, F.transform(matches, lambda m: tactic(m["tactic"]))).otherwise(F.array(tactic(F.col("threat.tactic")))))).alias("tactics"),
        F.when(matched, F.array_max(F.transform(matches, lambda m: correlate.severity_score(m["severity"])))).otherwise(correlate.severity_score(F.col("event.severity"))).alias("score"),
        F.when(matched, F.size(matches)).otherwise(1).alias("detections"),
        F.array(F.struct(F.lit("IP").alias("key_type"), ip.alias("key")), F.struct(F.lit("USER").alias("key_type"), user.alias("key"))).alias("entities"),
    )
    found = found.select("event_id", "at", "tactics", "score", "detections", F.explode("entities").alias("entity"))
    key = F.col("entity.key")
    return found.where(~correlate.blank(key) & (F.lower(key) != "unknown") & F.col("at").isNotNull()).select("entity.key_type", "entity.key", "event_id", "at", "tactics", "score", "detections")


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Two sums of one second: (tactics, first_us, last_us, root, score, events, detections)."""
    if a is None:
        return b
    first, root = min((a[1], a[3]), (b[1], b[3]))
    return sorted({*a[0], *b[0]}), first, max(a[2], b[2]), root, max(a[4], b[4]), a[5] + b[5], a[6] + b[6]


def _task_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's detections by entity and second."""
    sums: dict[tuple, tuple] = {}

    def out() -> pa.RecordBatch:
        rows = [(k[0], k[1], datetime.fromtimestamp(k[2], timezone.utc), *v) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _PARTS.types, strict=True)], schema=_PARTS)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key_type", "key", "at_us", "tactics", "event_id", "score", "detections")]
        for kind, key, at, tactics, event, score, n in zip(*columns, strict=True):
            name = (kind, key, at // 1_000_000)
            sums[name] = _merged(sums.get(name), (sorted(set(tactics)), at, at, event, score, 1, n))
        if len(sums) >= 50_000:
            yield out()
    if sums:
        yield out()


class _Entity(StatefulProcessor):
    """The sums of an entity's seconds within the window; a timer drops what leaves it."""

    def __init__(self, window_s: int, event_time: bool):
        self._window, self._event_time = window_s, event_time

    def init(self, handle) -> None:
        self._handle = handle
        self._kept = handle.getListState("kept", _KEPT)
        self._told = handle.getValueState("told", "active boolean")

    def _since(self, timers) -> int:
        """The first second of the window: the one after the watermark, whose own rows Spark takes as late, or the clock less the window."""
        return timers.getCurrentWatermarkInMs() // 1000 + 1 if self._event_time else timers.getCurrentProcessingTimeInMs() // 1000 - self._window

    def _step(self, key, new, timers) -> Iterator[Row]:
        since = self._since(timers)
        held = {x[0]: tuple(x[1:]) for x in (self._kept.get() if self._kept.exists() else ()) if x[0] >= since}
        for second, part in new:
            if second >= since:
                held[second] = _merged(held.get(second), part)
        self._kept.put([(s, *held[s]) for s in sorted(held)]) if held else self._kept.clear()
        if held:  # fires when the oldest second lies before the window
            # By event time at a watermark of that second itself: watermarks are whole seconds, and a timer of just that moment would wait for the next.
            self._handle.registerTimer(1000 * min(held) - 1 if self._event_time else 1000 * (min(held) + 1 + self._window))
        whole = None
        for part in held.values():
            whole = _merged(whole, part)
        active = whole is not None and len(whole[0]) >= 2
        told = self._told.exists() and self._told.get()[0]
        if active or told:
            moment = lambda us: datetime.fromtimestamp(us // 1_000_000, timezone.utc) + timedelta(microseconds=us % 1_000_000)
            tactics, first, last, root, score, events, n = whole or ([], 0, 0, "", 0, 0, 0)
            yield Row(key_type=key[0], key=key[1], active=active, since=moment(since * 1_000_000), tactics=tactics, first_seen_at=moment(first), last_seen_at=moment(last), root=root, score=score, event_count=events, detection_count=n)
        self._told.update((active,)) if held else self._told.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(int(r.second.replace(tzinfo=r.second.tzinfo or timezone.utc).timestamp()), (list(r.tactics), r.first_us, r.last_us, r.root, r.score, r.events, r.detections)) for r in rows]
        yield from self._step(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._step(key, [], timerValues)

    def close(self) -> None:
        pass


def running_incidents(detections: DataFrame, minutes: int = 30, event_time: bool = False) -> DataFrame:
    """A stream of ``line_detections`` to a stream of incidents that a micro-batch has changed: the columns of ``correlate.incidents``, ``since``, the
    beginning of the window, and ``active``: false for an entity that is no incident any more. Use output mode "update".

    The window ends at the clock or, by ``event_time``, at the latest detection that earlier micro-batches had; it begins ``minutes`` before, in
    whole seconds. Late rows count as long as they are within it. An entity's state is a sum for each second of the window, however many
    detections it has; an event's detections all have one time.
    """
    keyed_state(detections.sparkSession)
    rows = detections.select("key_type", "key", F.unix_micros("at").alias("at_us"), "tactics", "event_id", F.col("score").cast("bigint").alias("score"), F.col("detections").cast("bigint").alias("detections"))
    parts = rows.mapInArrow(_task_parts, _PARTS_DDL)
    mode = "ProcessingTime"
    if event_time:
        parts, mode = parts.withWatermark("second", f"{60 * minutes + 1} seconds"), "EventTime"
    sums = parts.groupBy("key_type", "key").transformWithState(_Entity(60 * minutes, event_time), _SUMS, "Update", mode)
    return correlate.told(sums.withColumn("root", F.struct(F.col("root").alias("event_id"))), "active", "since")


def latest_incidents(rows: DataFrame) -> DataFrame:
    """The incidents as they stand, of all that ``running_incidents`` has put out so far (column ``batch``)."""
    names = [c for c in rows.columns if c not in ("key_type", "correlation_key", "batch")]
    picked = rows.groupBy("key_type", "correlation_key").agg(F.max_by(F.struct(*names), "batch").alias("x"))
    return picked.select("key_type", "correlation_key", "x.*").where("active").drop("active", "since")
