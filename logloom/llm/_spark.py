"""Helpers shared by the corpus operators: the shared folder, written tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master (tests); a cluster
    without the setting is an error, since a machine-local folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-logloom-"))
    return "file://" + _LOCAL[0]


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/logloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost
    executor costs no more than the rereading of files.

    Sums by a key that are joined with rows of that key are written first: Spark splits a partition of a hot key only
    where both sides of the join come straight from a shuffle, which an aggregate below the join would not.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Removes what ``written`` left in the shared folder, once the results that read it are stored. Returns how many tables."""
    paths = [_WRITTEN.pop() for _ in range(len(_WRITTEN))]
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts ``df`` if it has at most ``rows`` rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that no more than their texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 text (split at space and U+0009 to U+000D), in blocks of about ``size``
    bytes, so that a very long text never becomes one list."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] != 32 and not 9 <= data[end] <= 13:
            end += 1
        yield data[at:end].split()
        at = end
