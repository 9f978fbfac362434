"""Search over stored events, alerts, incidents, batches and quarantined lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.lineage import line_key


def where_given(df: DataFrame, *tests: tuple[object, Column]) -> DataFrame:
    """Only the filters whose argument is given reach the plan, and with it the scan."""
    for value, test in tests:
        if value is not None:
            df = df.where(test)
    return df


def search_events(
    events: DataFrame, source_ip: str | None = None, destination_ip: str | None = None, action: str | None = None, severity: str | None = None, parser: str | None = None,
    fmt: str | None = None, since: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    """Stored events by any of eight filters; action and severity without regard to case, times inclusive."""
    low = lambda x: (x or "").lower()
    return where_given(
        events, (source_ip, F.col("source.ip") == source_ip), (destination_ip, F.col("destination.ip") == destination_ip), (action, F.lower("event.action") == low(action)), (severity, F.lower("event.severity") == low(severity)),
        (parser, F.col("parser_name") == parser), (fmt, F.col("format") == fmt), (since, F.col("timestamp_utc") >= F.lit(since)), (until, F.col("timestamp_utc") <= F.lit(until)),
    )


def search_alerts(alerts: DataFrame, severity: str | None = None, rule_id: str | None = None, technique: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return where_given(
        alerts, (severity, F.lower("severity") == (severity or "").lower()), (rule_id, F.col("rule_id") == rule_id), (technique, F.col("technique_id") == technique),
        (since, F.col("matched_at") >= F.lit(since)), (until, F.col("matched_at") <= F.lit(until)),
    )


def newest(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The first ``n`` rows, newest first; each task keeps n rows at most."""
    return df.orderBy(F.desc(by), *[F.desc(t) for t in ties]).limit(n)


def page(df: DataFrame, by: str, number: int = 0, size: int = 25, *ties: str) -> tuple[DataFrame, int]:
    """(a page of rows, newest first; how many rows there are)"""
    return df.orderBy(F.desc(by), *[F.desc(t) for t in ties]).offset(number * size).limit(size), df.count()


def by_id(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def by_status(df: DataFrame, status: str | None = None, column: str = "status") -> DataFrame:
    return where_given(df, (status, F.col(column) == status))


def between(df: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def since(events: DataFrame, start: datetime, parser: str | None = None) -> DataFrame:
    return where_given(events.where(F.col("received_at") > F.lit(start)), (parser, F.col("parser_name") == parser))


def with_raw(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Each event with its raw line, where that is kept."""
    key = line_key(events, raw)
    kept = raw.select(*key, F.col("raw_message").alias("stored_message"), F.col("raw_hash").alias("stored_hash"))
    return events.join(kept, key, "left")


def incident_details(members: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each distinct member event of each incident, with its fields and its rules. The rules are put together before they are joined."""
    rules = alerts.groupBy("event_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    own = members.groupBy("incident_key", "event_id").agg(F.min("at").alias("first_at"))
    fields = events.select("event_id", F.col("event.action").alias("action"), F.col("source.ip").alias("source_ip"), F.col("destination.ip").alias("destination_ip"), "timestamp_utc")
    return own.join(fields, "event_id", "left").join(rules, "event_id", "left")


def count_since(df: DataFrame, column: str, start: datetime) -> DataFrame:
    return df.where(F.col(column) > F.lit(start)).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def retry(quarantined: DataFrame, normalize, **options) -> tuple[DataFrame, DataFrame]:
    """Quarantined lines through the pipeline again, as new raw events of source DLQ_RETRY: (normalized rows, status log).

    A line that is stored now is RESOLVED_ON_RETRY, others RETRIED; either way its count goes up by one."""
    again = quarantined.select("raw_message", F.lit("DLQ_RETRY").alias("source"), F.col("created_at").alias("received_at"), "ingest_seq")
    rows = normalize(again, **options)
    done = rows.groupBy("raw_hash").agg(F.max((F.col("outcome.code") == "NORMAL").cast("int")).alias("ok"))
    log = quarantined.join(done, "raw_hash", "left").select("raw_event_id", (F.col("retry_count") + 1).alias("retry_count"), F.when(F.col("ok") == 1, "RESOLVED_ON_RETRY").otherwise("RETRIED").alias("status"))
    return rows, log
