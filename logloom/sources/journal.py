"""Syslog listeners on executors, which write a journal, and the stream that reads it.

A listener is a long task of a Spark job: it takes datagrams, or connections and what they send, and appends whole lines to segments of a
journal in a folder that all executors share and can open as files. Lines are on disk before an offset names them, so the stream, which reads
segments in partitions on executors, can read any batch again: what is lost with a driver or an executor is at most what no segment had yet.
"""

from __future__ import annotations

import os
import re
import selectors
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: bytes of a framed line, without its end.
LONGEST = 65_536
SEGMENT = 64 << 20  # bytes after which a listener begins another segment
_STOP = "stop"
_NAME = re.compile(r"(\d{6})-(\d{15})-[0-9a-f]{8}\.lines")


class LineTooLong(ValueError):
    """A connection sent more bytes without a line's end than a frame may hold."""


class LineFramer:
    """Cuts what a connection sends into lines at \\n or \\r\\n, and keeps what has no end yet, never more than a frame's bytes and one piece."""

    def __init__(self, longest: int = LONGEST):
        self._longest, self._rest = longest, b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        """Lines that ``data`` completes. Those before an overlong one are given out before it raises."""
        *lines, rest = (self._rest + data).split(b"\n")
        self._rest = b""
        for line in lines:
            line = line.removesuffix(b"\r")
            if len(line) > self._longest:
                raise LineTooLong(len(line))
            yield line
        if len(rest.removesuffix(b"\r")) > self._longest:
            raise LineTooLong(len(rest))
        self._rest = rest

    def end(self) -> bytes:
        """What came after the last line's end: a connection that is closed does not complete it."""
        rest, self._rest = self._rest, b""
        return rest


class Journal:
    """The segments of one listener. A task that runs again begins a segment of its own."""

    def __init__(self, folder: str, listener: int, most: int = SEGMENT):
        self._folder, self._listener, self._most, self._file = Path(folder), listener, most, None
        self._folder.mkdir(parents=True, exist_ok=True)

    def append(self, lines: list[bytes]) -> None:
        """Whole lines, on disk when this returns. A line's own line ends (a datagram may hold some) become spaces."""
        if not lines:
            return
        if self._file is None or self._file.tell() >= self._most:
            self.close()
            self._file = (self._folder / f"{self._listener:06d}-{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:8]}.lines").open("ab")
        self._file.write(b"".join(line.replace(b"\r", b" ").replace(b"\n", b" ") + b"\n" for line in lines))
        self._file.flush()
        os.fsync(self._file.fileno())

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None


def _socket(kind: int, host: str, port: int) -> socket.socket:
    """Listeners of one machine share a port; the kernel deals connections and datagrams out to them."""
    s = socket.socket(socket.AF_INET, kind)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEPORT, 1)
    s.bind((host, port))
    s.setblocking(False)
    return s


def _take(s: socket.socket, size: int = 65_536) -> bytes | None:
    try:
        return s.recv(size)
    except BlockingIOError:
        return None


def listen_udp(host: str, port: int, journal: Journal, stopped, wait: float = 0.2) -> Iterator[int]:
    """One datagram, one line. Gives out how many lines each round has put on disk."""
    with _socket(socket.SOCK_DGRAM, host, port) as s, selectors.DefaultSelector() as ready:
        s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
        ready.register(s, selectors.EVENT_READ)
        while not stopped():
            lines = []
            if ready.select(wait):
                while len(lines) < 10_000 and (data := _take(s)) is not None:
                    lines.append(data.rstrip(b"\r\n"))
            journal.append(lines)
            yield len(lines)


def listen_tcp(host: str, port: int, journal: Journal, stopped, wait: float = 0.2, longest: int = LONGEST) -> Iterator[int]:
    """Lines of any number of connections at a time. A connection that sends an overlong line is closed; the others go on."""
    with _socket(socket.SOCK_STREAM, host, port) as server, selectors.DefaultSelector() as ready:
        server.listen(128)
        ready.register(server, selectors.EVENT_READ)
        while not stopped():
            lines: list[bytes] = []
            for found, _ in ready.select(wait):
                if found.fileobj is server:
                    connection, _ = server.accept()
                    connection.setblocking(False)
                    ready.register(connection, selectors.EVENT_READ, LineFramer(longest))
                    continue
                try:
                    data = _take(found.fileobj)
                    if data is None:
                        continue
                    lines.extend(found.data.feed(data))
                    closed = not data
                except (LineTooLong, ConnectionError):
                    closed = True
                if closed:
                    ready.unregister(found.fileobj)
                    found.fileobj.close()
            journal.append(lines)
            yield len(lines)
        for found in list(ready.get_map().values()):
            found.fileobj.close()


def _listeners(kind: str, host: str, port: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for listener in batch.column("id").to_pylist():
                journal = Journal(folder, listener)
                stopped = (Path(folder) / _STOP).exists
                try:
                    n = sum((listen_tcp if kind == "tcp" else listen_udp)(host, port, journal, stopped))
                finally:
                    journal.close()
                yield pa.RecordBatch.from_pydict({"listener": [listener], "lines": [n]})

    return run


@dataclass
class Listening:
    """Running listeners: ``stop`` ends them once what they hold is on disk."""

    folder: str
    thread: threading.Thread
    counts: list = field(default_factory=list)
    failed: list = field(default_factory=list)

    def stop(self, wait: float = 30) -> int:
        """How many lines the listeners have written; an error of their job is raised."""
        (Path(self.folder) / _STOP).touch()
        self.thread.join(wait)
        if self.failed:
            raise self.failed[0]
        return sum(self.counts)


def mounted(folder: str) -> str:
    """The journal's folder as a path that Python can open: one that executors have mounted."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"a journal needs a shared folder that is mounted, not {folder}")
    return folder.removeprefix("file://")


def listen(spark: SparkSession, folder: str, kind: str = "tcp", port: int = 1514, host: str = "0.0.0.0", listeners: int = 2) -> Listening:
    """Starts ``listeners`` tasks, each a listener that writes to the journal in ``folder``, which all executors must share and have mounted.

    They hold as many cores until they are stopped. A task that is lost runs again elsewhere; clients connect anew."""
    if kind not in ("tcp", "udp"):
        raise ValueError(f"tcp or udp, not {kind}")
    path = mounted(folder)
    Path(path).mkdir(parents=True, exist_ok=True)
    (Path(path) / _STOP).unlink(missing_ok=True)
    job = spark.range(0, listeners, 1, listeners).mapInArrow(_listeners(kind, host, port, path), "listener bigint, lines bigint")
    running = Listening(path, threading.Thread(daemon=True))

    def work() -> None:
        try:
            running.counts.extend(r.lines for r in job.collect())
        except Exception as e:  # noqa: BLE001  raised by stop
            running.failed.append(e)

    running.thread = threading.Thread(target=work, daemon=True)
    running.thread.start()
    return running


@dataclass
class _Stretch(InputPartition):
    segment: str
    start: int
    end: int


class _JournalReader(DataSourceStreamReader):
    """Offsets name how many bytes of each segment have been given out; partitions are stretches of segments."""

    def __init__(self, options: dict):
        self._folder = Path(mounted(options["path"]))
        self._stretch = int(options.get("stretch", 16 << 20))

    def _segments(self) -> dict[str, int]:
        if not self._folder.is_dir():
            return {}
        return {p.name: p.stat().st_size for p in self._folder.iterdir() if _NAME.fullmatch(p.name)}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._segments()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for name, size in sorted(end.items()):
            found += [_Stretch(name, at, min(at + self._stretch, size)) for at in range(start.get(name, 0), size, self._stretch)]
        return found

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        """Lines that begin within the stretch; the last may end beyond it."""
        with (self._folder / partition.segment).open("rb") as file:
            at = partition.start
            if at:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(0)
            while at < partition.end:
                line = file.readline()
                if not line:
                    return
                at += len(line)
                yield (line[:-1].decode("utf-8", "replace"),)

    def commit(self, end: dict) -> None:
        """Removes segments that are read to their end and that a later one of the same listener follows."""
        last = {}
        for name in sorted(self._segments()):
            last[_NAME.fullmatch(name)[1]] = name
        for name, size in self._segments().items():
            if end.get(name) == size and last[_NAME.fullmatch(name)[1]] != name:
                (self._folder / name).unlink(missing_ok=True)


class LineJournal(DataSource):
    """``spark.readStream.format("line_journal").option("path", folder)``: the lines of a journal, each once."""

    @classmethod
    def name(cls) -> str:
        return "line_journal"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _JournalReader(self.options)


def stream_journal(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that listeners have written to the journal in ``folder``."""
    spark.dataSource.register(LineJournal)
    return spark.readStream.format("line_journal").option("path", folder).load()
