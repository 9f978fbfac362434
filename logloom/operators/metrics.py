"""Counts, rates and latencies of a run."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Formats and tiers that are always listed.
FORMATS = ("SYSLOG", "CEF", "LEEF", "JSON", "CSV", "CUSTOM")
TIERS = ("HIGH", "MEDIUM", "LOW")
RING = 200  # latest latencies that count


def _zero_filled(counts: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    listed = counts.sparkSession.createDataFrame([(n, 0) for n in names], f"{key} string, n long")
    return counts.unionByName(listed).groupBy(key).agg(F.sum("n").alias("n"))


def by_format(events: DataFrame) -> DataFrame:
    """(format, n, share): events by format, with zeros for the listed formats."""
    counts = _zero_filled(events.groupBy("format").agg(F.count("*").alias("n")), "format", FORMATS)
    # No more rows than formats reach this window.
    whole = F.sum("n").over(Window.partitionBy())
    return counts.select("format", "n", F.when(whole > 0, F.col("n") / whole).otherwise(0.0).alias("share"))


def by_tier(events: DataFrame) -> DataFrame:
    return _zero_filled(events.groupBy("confidence_tier").agg(F.count("*").alias("n")), "confidence_tier", TIERS)


def totals(normalized: DataFrame) -> DataFrame:
    """(total, stored, quarantined, alerts)"""
    ok = F.col("outcome.code") == "NORMAL"
    return normalized.agg(F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("stored"), F.count(F.when(~ok, 1)).alias("quarantined"), F.coalesce(F.sum(F.when(ok, F.size("threat.sigma_matches"))), F.lit(0)).cast("long").alias("alerts"))


def latency(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """(n, average, p50, p95, p99) of the latest ``RING`` values: the sorted values at floor(n * p)."""
    recent = rows.where(F.col(value).isNotNull()).orderBy(*[F.desc(c) for c in order]).limit(RING)
    sorted_ = recent.agg(F.array_sort(F.collect_list(value)).alias("v"), F.avg(value).alias("average"))
    at = lambda p: F.get("v", F.least(F.floor(F.size("v") * p).cast("int"), F.size("v") - 1))
    return sorted_.select(F.size("v").cast("long").alias("n"), "average", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def events_per_second(rows: DataFrame, as_of: datetime, seconds: int = 5, at: str = "received_at") -> DataFrame:
    """(eps): rows of the trailing seconds, divided by them."""
    recent = rows.where((F.col(at) > F.lit(as_of - timedelta(seconds=seconds))) & (F.col(at) <= F.lit(as_of)))
    return recent.agg((F.count("*") / seconds).alias("eps"))


def rate_over_time(rows: DataFrame, seconds: int = 5, slide: int = 1, at: str = "received_at") -> DataFrame:
    """(window_end, n, eps) of every sliding window that has rows."""
    windows = rows.groupBy(F.window(F.col(at).cast("timestamp"), f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.end").alias("window_end"), "n", (F.col("n") / seconds).alias("eps"))
