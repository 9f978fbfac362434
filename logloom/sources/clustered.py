"""Tables for lookups: files by ranges of time, Bloom filters on ids and addresses, and counts by minute for pages by key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.tables import put

#: Columns that point lookups ask for.
IDS = ("event_id", "raw_event_id", "source.ip", "destination.ip")


def store(rows: DataFrame, path: str, at: str = "timestamp_utc", tie: str = "ingest_seq", ids: Sequence[str] = IDS, files: int | None = None, block: int = 64 << 20) -> None:
    """Writes rows whole to a table that lookups read a part of.

    Rows are range-partitioned by time and tie (``files`` partitions, by default Spark's), so a hot minute is split, and sorted within: a search
    between two times opens the row groups (of ``block`` bytes) between them. Random ids are in no order; each row group has a Bloom
    filter of each of ``ids``, sized by its different values. ``minutes`` keeps the rows of each minute. A null time sorts first and is on no page.
    """
    keys = (at, tie)
    ranged = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    options = {"parquet.block.size": str(block), "parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in ids}
    conf, kind = rows.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    usual = conf.get(kind)
    conf.set(kind, "TIMESTAMP_MICROS")  # the usual INT96 has no minimum and maximum that a filter could use
    try:
        put(ranged, f"{path}/rows", options=options)
    finally:
        conf.set(kind, usual)
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    put(written.where(F.col(at).isNotNull()).groupBy(F.date_trunc("minute", at).alias("minute")).agg(F.count("*").alias("n")).orderBy("minute"), f"{path}/minutes")


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The rows, for ``search``'s filters: equality with an id and bounds on time reach the row groups."""
    return spark.read.parquet(f"{path}/rows")


def total(spark: SparkSession, path: str) -> int:
    """How many rows have a time, from the counts."""
    return spark.read.parquet(f"{path}/minutes").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, before: tuple[datetime, object] | None = None, size: int = 25, at: str = "timestamp_utc", tie: str = "ingest_seq") -> DataFrame:
    """The ``size`` newest rows, or those that follow the row with the time and tie ``before``, which is the last of the page before; fewer at the end.

    Of the counts by minute at most ``size`` + 2 are fetched: as each minute has a row, these hold the page, and only row groups of their times
    are read. So each page costs what the first costs, however far back it lies. Rows of equal time and tie stand on one page only if it
    doesn't end between them; a tie that is unique, as a line's number is, avoids that. Ties must not be null.
    """
    counts = spark.read.parquet(f"{path}/minutes")
    if before:
        counts = counts.where(F.col("minute") <= F.date_trunc("minute", F.lit(before[0])))
    start, found = None, 0
    for i, r in enumerate(counts.orderBy(F.desc("minute")).limit(size + 2).collect()):
        start = r.minute
        found += r.n if i or not before else 0  # of the newest minute a part may have been shown
        if found >= size:
            break
    rows = rows_of(spark, path)
    if start is None:
        return rows.limit(0)
    rows = rows.where(F.col(at) >= F.lit(start))
    if before:
        time, key = F.lit(before[0]), F.lit(before[1])
        rows = rows.where((F.col(at) <= time) & ((F.col(at) < time) | (F.col(tie) < key)))
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(size)
