"""Listeners and their journal: frames, clients, restarts; nothing that is journalled is lost or doubled."""

import random
import socket
import threading
import time

import pytest

from logloom.sources import journal


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_frames():
    """Any cuts give the same lines; what has no end is kept, an overlong line fails."""
    rng = random.Random(1)
    text = b"".join(bytes(rng.choice(b"ab\r") for _ in range(rng.randrange(9))) + rng.choice([b"\n", b"\r\n"]) for _ in range(500))
    want = [x.removesuffix(b"\r") for x in text.split(b"\n")[:-1]]
    for _ in range(20):
        framer, got, at = journal.LineFramer(), [], 0
        while at < len(text):
            step = rng.randrange(1, 12)
            got += framer.feed(text[at : at + step])
            at += step
        assert got == want and framer.end() == b""
    framer = journal.LineFramer(10)
    assert list(framer.feed(b"0123456789\r\n01234")) == [b"0123456789"]
    assert list(framer.feed(b"56789\r")) == [] and list(framer.feed(b"\nx")) == [b"0123456789"]
    lines, got = framer.feed(b"y\nz\n01234567890"), []
    with pytest.raises(journal.LineTooLong):
        got += [next(lines), next(lines)]
        next(lines)
    assert got == [b"xy", b"z"]


def connected(port):
    for _ in range(300):
        try:
            return socket.create_connection(("127.0.0.1", port), 5)
        except OSError:
            time.sleep(0.1)
    raise TimeoutError


def rows_of(spark, folder, checkpoint, out):
    query = journal.stream_journal(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination(100)
    return sorted(r.value for r in spark.read.schema("value string").parquet(out).collect())


def on_disk(folder, n):
    for _ in range(300):
        if sum(p.read_bytes().count(b"\n") for p in folder.glob("*.lines")) >= n:
            return
        time.sleep(0.1)
    raise TimeoutError


def test_tcp(spark, tmp_path):
    """Several clients at once, lines in pieces, an overlong line, a stop and a restart of listeners and stream."""
    folder, port, paths = tmp_path / "journal", free_port(socket.SOCK_STREAM), (str(tmp_path / "journal"), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    want = []

    def client(name, n):
        with connected(port) as s:
            data = b"".join(f"{name} line {i} é\r\n".encode() for i in range(n)) + b"without an end"
            for at in range(0, len(data), 7):
                s.sendall(data[at : at + 7])

    listening = journal.listen(spark, str(folder), "tcp", port, "127.0.0.1", 2)
    try:
        clients = [threading.Thread(target=client, args=(f"c{i}", 50)) for i in range(5)]
        for c in clients:
            c.start()
        with connected(port) as s:  # fails alone, after the line before
            s.sendall(b"before\n" + b"x" * (journal.LONGEST + 70_000))
            s.settimeout(10)
            try:
                assert s.recv(1) == b""
            except ConnectionError:
                pass
        for c in clients:
            c.join(60)
        want = sorted([f"c{i} line {j} é" for i in range(5) for j in range(50)] + ["before"])
        on_disk(folder, len(want))
        assert rows_of(spark, *paths) == want
    finally:
        assert listening.stop() == len(want)
    listening = journal.listen(spark, str(folder), "tcp", port, "127.0.0.1", 1)
    try:
        client("again", 3)
        on_disk(folder, 3)
        time.sleep(0.5)
        want = sorted([*want, *(f"again line {j} é" for j in range(3))])
        assert rows_of(spark, *paths) == want and rows_of(spark, *paths) == want
    finally:
        listening.stop()


def test_datagrams(spark, tmp_path):
    """A batch that fails after it was read is read again: nothing journalled is lost or doubled. Read segments go."""
    folder, port = tmp_path / "journal", free_port(socket.SOCK_DGRAM)
    listening = journal.listen(spark, f"file://{folder}", "udp", port, "127.0.0.1", 1)
    sent, seen = set(), []
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for i in range(600):
                out.sendto(f"datagram {i}\nof two lines\n".encode(), ("127.0.0.1", port))
                time.sleep(0.1)
                if i > 50 and i % 10 == 0 and sum(p.stat().st_size for p in folder.glob("*.lines")) > 500:
                    break
    finally:
        written = listening.stop()
    sent = sorted(x.decode() for p in folder.glob("*.lines") for x in p.read_bytes().splitlines())
    assert len(sent) == written > 20 and all(x.endswith(" of two lines") for x in sent)

    def each(fail):
        def run(rows, batch):
            seen.append((batch, sorted(r.value for r in rows.collect())))
            if fail:
                raise RuntimeError("lost before it was committed")

        return run

    def attempt(fail):
        query = journal.stream_journal(spark, str(folder)).writeStream.foreachBatch(each(fail)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(100)
        except Exception:  # noqa: BLE001
            assert fail

    attempt(True)
    attempt(False)
    assert seen[0] == seen[1] == (0, sent)


def test_long_segments_are_read_in_stretches(tmp_path):
    """Stretches of any length give each line once; a segment that another follows goes once it is read."""
    rng = random.Random(2)
    lines = [b"x" * rng.randrange(40) for _ in range(400)]
    log = journal.Journal(str(tmp_path), 3, most=2000)
    for at in range(0, 400, 20):
        log.append(lines[at : at + 20])
        time.sleep(0.002)
    for stretch in (1, 7, 100, 10**6):
        reader = journal._JournalReader({"path": str(tmp_path), "stretch": str(stretch)})
        end = reader.latestOffset()
        got = [v.encode() for p in reader.partitions({}, end) for (v,) in reader.read(p)]
        assert got == lines and len(end) > 2
    half = {name: 0 for name in end}
    reader.commit(half)
    assert reader.latestOffset() == end
    reader.commit(end)
    assert list(reader.latestOffset()) == [max(end)]
    log.close()
    with pytest.raises(ValueError):
        journal.mounted("hdfs://host/x")
