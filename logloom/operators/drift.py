"""Parser quality: drift alerts and health."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT = 500  # latest events of a parser that count
HISTORY = 20  # of these, the ones that are shown


def baselines(parsers: DataFrame, versions: DataFrame) -> DataFrame:
    """(parser_name, parser_version, format, baseline): the active version's average, else the parser's own score, else 0.90 or 0.95."""
    active = versions.where("active and average_confidence is not null").groupBy("parser_name").agg(F.max("average_confidence").alias("active_average"))
    own = F.when(F.col("dynamic"), F.when(F.col("score") > 0, F.col("score")).otherwise(0.90)).otherwise(0.95)
    return parsers.join(active, "parser_name", "left").select("parser_name", "parser_version", "format", F.coalesce("active_average", own).alias("baseline"))


def latest(events: DataFrame, n: int = RECENT) -> DataFrame:
    """The latest ``n`` events of each parser. Spark's window group limit keeps n rows a parser in every task before the shuffle,
    so a parser with most of the events costs no more than the others."""
    order = Window.partitionBy("parser_name").orderBy(F.desc("received_at"), F.desc("ingest_seq"))
    return events.select("parser_name", "received_at", "ingest_seq", "average_confidence").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def quality(events: DataFrame, quarantined: DataFrame, known: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Figures of each known parser: rolling confidence, success rate against quarantined lines of its format, drop below the baseline."""
    recent = latest(events)
    confidence = F.coalesce("average_confidence", F.lit(0.8))
    shown = F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("place") <= HISTORY, F.struct("place", F.coalesce("average_confidence", F.lit(0.85)).alias("c")))))), lambda x: x["c"])
    # Thousandths add up exactly, so the mean doesn't depend on the order.
    rolled = recent.groupBy("parser_name").agg((F.sum(F.round(confidence * 1000).cast("long")) / F.count("*") / 1000).alias("rolling"), F.count("*").alias("total_events"), shown.alias("history"))
    failed = quarantined.where(F.col("created_at") > F.lit(as_of - timedelta(hours=hours))).groupBy(F.col("detected_format").alias("format")).agg(F.count("*").alias("dlq"))
    joined = known.join(rolled, "parser_name", "left").join(failed, "format", "left")
    n, dlq = F.coalesce("total_events", F.lit(0)), F.coalesce("dlq", F.lit(0))
    current = F.coalesce("rolling", "baseline")
    return joined.select(
        "parser_name", "parser_version", "format", "baseline", current.alias("current_confidence"), F.greatest(F.lit(0.0), F.col("baseline") - current).alias("confidence_drop"),
        F.when(n + dlq > 0, n / (n + dlq)).otherwise(1.0).alias("success_rate"), n.alias("total_events"), dlq.alias("dlq_events"), F.coalesce("history", F.array().cast("array<double>")).alias("history"),
    )


def _breaches(drop: float, success: float):
    failures = (F.col("dlq_events") > 0) | ((F.col("success_rate") < success) & (F.col("total_events") + F.col("dlq_events") >= 5))
    both = (F.col("confidence_drop") >= drop) & ((F.col("success_rate") < 0.95) | (F.col("dlq_events") > 0))
    return both, failures


def drift_alerts(figures: DataFrame, open_alerts: DataFrame | None = None, drop: float = 0.15, success: float = 0.85, as_of: datetime | None = None) -> DataFrame:
    """New alerts: parsers with events that are in breach and have no open alert."""
    both, failures = _breaches(drop, success)
    found = figures.where((F.col("total_events") > 0) & (both | failures))
    if open_alerts is not None:
        found = found.join(open_alerts.where("status = 'OPEN'").select("parser_name"), "parser_name", "left_anti")
    percent = lambda x: F.format_string("%.1f", x * 100)
    # The texts of the alerts.
    told = F.when(
        both,
        F.concat(F.lit("Confidence dropped by "), percent(F.col("confidence_drop")), F.lit("% (baseline: "), F.format_string("%.2f", "baseline"), F.lit(", rolling: "), F.format_string("%.2f", "current_confidence"), F.lit(") with degraded success rate ("), percent(F.col("success_rate")), F.lit("%)")),
    ).otherwise(F.concat(F.lit("Success rate dropped to "), percent(F.col("success_rate")), F.lit("% below threshold "), percent(F.lit(success)), F.lit("% ("), F.col("dlq_events").cast("string"), F.lit(" DLQ quarantined payloads)")))
    details = F.concat(F.lit("Parser quality drift detected: "), told)
    return found.select("parser_name", "parser_version", "baseline", "current_confidence", "confidence_drop", "success_rate", "total_events", "dlq_events", F.lit("OPEN").alias("status"), F.lit(as_of).cast("timestamp").alias("detected_at"), details.alias("details"))


def health(figures: DataFrame, open_alerts: DataFrame | None = None, drop: float = 0.15, success: float = 0.85) -> DataFrame:
    """The figures with ``health``: DRIFT_ALERT, WARNING from half the drop, HEALTHY; and ``active_alert``."""
    both, failures = _breaches(drop, success)
    if open_alerts is not None:
        opened = open_alerts.where("status = 'OPEN'").select("parser_name").distinct().withColumn("active_alert", F.lit(True))
        figures = figures.join(opened, "parser_name", "left").withColumn("active_alert", F.coalesce("active_alert", F.lit(False)))
    else:
        figures = figures.withColumn("active_alert", F.lit(False))
    state = F.when(F.col("active_alert") | both | failures, "DRIFT_ALERT").when(F.col("confidence_drop") >= drop / 2, "WARNING").otherwise("HEALTHY")
    return figures.withColumn("health", state)
