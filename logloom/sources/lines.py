"""Raw lines: (raw_message, source, received_at, ingest_seq), from files, bulk JSON and sockets."""

from __future__ import annotations

import socket

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from logloom.functions.text import blank


def as_raw(df: DataFrame, message: str = "raw_message", source: str = "REST", received: Column | None = None) -> DataFrame:
    """Raw lines of a DataFrame; null and blank ones are dropped. Lines are numbered as they come, which tells equal lines
    apart; those of a stream are numbered by the gateway, in each micro-batch."""
    rows = df.where(~blank(F.col(message)))
    when = received if received is not None else F.current_timestamp()
    rows = rows.select(F.col(message).alias("raw_message"), F.lit(source).alias("source"), when.alias("received_at"))
    return rows if df.isStreaming else rows.withColumn("ingest_seq", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str, source: str = "FILE", received: Column | None = None) -> DataFrame:
    """One event a line."""
    return as_raw(spark.read.text(path), "value", source, received)


def read_json_array(spark: SparkSession, path: str, source: str = "FILE", received: Column | None = None) -> DataFrame:
    """One event for each object of files that hold a JSON array over several lines."""
    whole = spark.read.text(path, wholetext=True)
    return as_raw(whole.select(F.explode(F.from_json("value", "array<string>")).alias("raw_message")), "raw_message", source, received)


def from_requests(df: DataFrame, body: str = "body", source: str = "REST", received: Column | None = None) -> DataFrame:
    """Single requests: an object's ``log`` or ``message`` text, or, as text, the map that it is ({key=value, key=value}); what is no
    object is the line itself. An object may name its ``source``. Null and blank lines are dropped; equal requests stay apart."""
    fields = F.from_json(F.col(body), "map<string,string>")
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    whole = F.when(F.ltrim(F.col(body)).startswith("{"), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
    text = F.coalesce(fields["log"], fields["message"], whole, F.col(body))
    rows = df.select(text.alias("raw_message"), F.coalesce(fields["source"], F.lit(source)).alias("named"))
    when = received if received is not None else F.current_timestamp()
    rows = rows.where(~blank(F.col("raw_message")))
    return rows.select("raw_message", F.col("named").alias("source"), when.alias("received_at"), F.monotonically_increasing_id().alias("ingest_seq"))


def from_bulk(df: DataFrame, body: str = "body", source: str = "REST_BULK", received: Column | None = None) -> DataFrame:
    """Bulk requests: a JSON list, or an object with a list ``logs``."""
    many = F.coalesce(F.from_json(F.col(body), "array<string>"), F.from_json(F.get_json_object(F.col(body), "$.logs"), "array<string>"))
    return as_raw(df.select(F.explode(many).alias("raw_message")), "raw_message", source, received)


class _Datagrams(SimpleDataSourceStreamReader):
    """Reads what has come in since the last call, up to a bound; the driver holds no more than one such batch."""

    def __init__(self, options: dict):
        # Spark makes readers that it never reads from, so the port is bound by the first read.
        self._socket, self._kept = None, {}
        self._at = (options.get("host", "0.0.0.0"), int(options.get("port", 1514)))
        self._wait, self._most = float(options.get("wait", 0.2)), int(options.get("maxPerBatch", 10_000))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        if self._socket is None:
            self._socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self._socket.bind(self._at)
            self._socket.settimeout(self._wait)
        rows = []
        try:
            while len(rows) < self._most:
                rows.append((self._socket.recv(65_536).decode("utf-8", "replace").rstrip("\r\n"),))
        except TimeoutError:
            pass
        end = {"n": start["n"] + len(rows)}
        self._kept[start["n"]] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._kept.get(start["n"], []))

    def commit(self, end: dict) -> None:
        self._kept = {k: v for k, v in self._kept.items() if k >= end["n"]}


class SyslogUdp(DataSource):
    """``spark.readStream.format("syslog_udp")``: one datagram, one line. For trials and small sites; at scale put a collector with
    a replayable log before the engine, since datagrams that are lost with the driver cannot be read again."""

    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Datagrams(self.options)


LONGEST = 65_536  # bytes of a framed line


def framed(lines: DataFrame, column: str = "value", longest: int = LONGEST) -> DataFrame:
    """Lines that a frame can hold; longer ones fail to frame and are left out."""
    return lines.where(F.octet_length(column) <= longest)


def stream_tcp(spark: SparkSession, host: str, port: int = 1514, longest: int = LONGEST) -> DataFrame:
    """Lines from a TCP socket; Spark's socket source, which cannot replay."""
    return framed(spark.readStream.format("socket").option("host", host).option("port", port).load(), longest=longest)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files that come into a folder; replayable."""
    return spark.readStream.text(path)
