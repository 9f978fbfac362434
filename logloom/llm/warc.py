"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent frames, each of some whole WARC records, then a seek table (a skippable frame
in the public seekable format: sizes of all frames, their number, a magic number). A record is found by bundle, frame and
offset in the frame; reading it touches no other frame. Records whose payload another record has already are
written as revisits without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm._spark import shared_path, text_rows, written

FRAME = 1 << 20  # bytes of records after which a frame is closed
BUNDLE = 1 << 28  # bytes of a file after which a bundle is closed
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "record_id string, page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload binary"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}/{kind}')}>"


def _header(value: object) -> str:
    """A value on one line: percent signs, carriage returns and line feeds are percent-encoded."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """(record id, the bytes of the record). A revisit names the record that it refers to and has no block."""
    kind = "revisit" if revisit else "response"
    name = record_id(page_id, payload_digest, kind)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: text/html"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, payload_digest, 'response')}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = b"" if revisit else payload
    lines.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(frame: bytes) -> Iterator[tuple]:
    """The records of a frame: (page_id, url, record_type, refers_to, payload_digest, payload)."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not at a WARC record")
        head = dict(line.split(": ", 1) for line in lines)
        length = int(head["Content-Length"])
        block = frame[end + 4 : end + 4 + length]
        page, refers, url = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID"), head.get("WARC-Target-URI")
        yield (page and int(page), None if url is None else _unheader(url), head["WARC-Type"], refers and int(refers), head["WARC-Payload-Digest"].removeprefix("sha1:"), block)
        at = end + 4 + length + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame for frames of (compressed, plain) bytes. Sizes have 32 bits in it: a frame is closed at ``FRAME`` bytes, and
    the one record that may reach over that is a value of a row, which Spark holds to 2 GiB."""
    if any(max(f) >= 1 << 32 for f in frames):
        raise ValueError("a frame of 4 GiB or more")
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int]]:
    """(start, compressed bytes) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    body, at, found = file.read(width * count), 0, []
    for i in range(count):
        packed = struct.unpack_from("<I", body, width * i)[0]
        found.append((at, packed))
        at += packed
    return found


class _Bundle:
    """A file being written. Its name is new for each try, so that a task that is run again never meets its own remains;
    only the index, which Spark commits once, says which bundles count."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = file_system(self.path)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file, self.size, self.frames = fs.open_output_stream(path, compression=None), 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[bytes] = []
        self.open_bytes, self.rows, self.index = 0, [], []

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.rows.append((name, page_id, self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= FRAME:
            self.cut()

    def cut(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.file.write(packed)
            self.index += [(name, page, self.path, len(self.frames), self.size, len(packed), at, n) for name, page, at, n in self.rows]
            self.frames.append((len(packed), self.open_bytes))
            self.size += len(packed)
            self.open, self.open_bytes, self.rows = [], 0, []

    def close(self) -> None:
        self.cut()
        self.file.write(seek_table(self.frames))
        self.file.close()

    def taken(self) -> list[tuple]:
        done, self.index = self.index, []
        return done


def _writer(folder: str):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in INDEX.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for part in text_rows(batches):
            for page, url, text, sha, first, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                bundle = bundle or _Bundle(folder)
                bundle.add(page, *record(page, url, (text or "").encode(), sha, first, revisit))
                if bundle.size >= BUNDLE:
                    bundle.close()
                    yield batch_of(bundle.taken())
                    bundle = None
        if bundle:
            bundle.close()
            yield batch_of(bundle.taken())

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` to bundles in ``folder`` and returns their index (``INDEX``).

    Of the rows with equal payloads of at least ``least`` bytes, that with the smallest id is written as response, the others
    as revisits of it; rows of that id and payload that occur again are written as responses again. Rows without an id
    are revisits if a row with one has their payload, else responses. Null html is an empty payload; null urls are
    left out. An empty table gives an empty index and no bundles. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"))
    known = rows.join(written(firsts, "firsts").hint("shuffle_hash"), "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = known.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), base32(F.col("sha")).alias("sha"), "first", revisit.alias("revisit"))
    return written(records.mapInArrow(_writer(folder), INDEX), "warc-index")


def base32(hexadecimal: Column) -> Column:
    """Hex digits, a multiple of five bytes, in base 32: bit string, cut into fives, each by its letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for at in range(0, 40, 10):
        block = F.conv(F.substring(hexadecimal, at + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(letters), F.shiftright(block, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*out)


def _frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            fs, path = file_system(bundle)
            with fs.open_input_file(path) as file:
                frames = read_seek_table(file, file.size())
            columns = [pa.array([bundle] * len(frames)), pa.array([f[0] for f in frames], pa.int64()), pa.array([f[1] for f in frames], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["bundle", "start", "bytes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [c.split()[0] for c in RECORD.split(", ")]
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, path = file_system(bundle)
            with fs.open_input_file(path) as file:
                rows = [*parsed(unpack.decompress(file.read_at(size, start)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(bundles: DataFrame) -> DataFrame:
    """All records (``RECORD``) of the bundles in column ``bundle``: seek tables first, then each frame by itself.

    Bundles that are named repeatedly are read once; other columns are ignored; an empty table gives no rows. Ids and urls that the
    records lack are null, and revisits have an empty payload.
    """
    spark = bundles.sparkSession
    frames = bundles.select("bundle").distinct().mapInArrow(_frames_of, "bundle string, start bigint, bytes bigint")
    spread = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(_read, RECORD)


def read_record(row: dict) -> bytes:
    """The bytes of the one record that a row of the index describes."""
    fs, path = file_system(row["bundle"])
    with fs.open_input_file(path) as file:
        frame = zstandard.ZstdDecompressor().decompress(file.read_at(row["frame_bytes"], row["frame_start"]))
    return frame[row["offset"] : row["offset"] + row["length"]]


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take the payload's size from the response that
    they refer to; the digest of a response is that of the payload as read. Null ids are kept; repeated records give repeated
    rows; a revisit whose response isn't among the records gives none; an empty table gives no rows."""
    sized = records.select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("own_bytes"),
        F.when(F.col("record_type") == "response", base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
    sized = written(sized, "records")
    full = sized.where("record_type = 'response'").groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("d")).agg(F.max("own_bytes").alias("full_bytes"))
    full = written(full, "full")
    responses = sized.where("record_type = 'response'").select("page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    revisits = sized.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("id")) & (F.col("payload_digest") == F.col("d")))
    return responses.unionByName(revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def oracle_sql() -> str:
    """DuckDB SQL for the registered query. Base 32 is spelt out from the hex digits of the digest."""
    digit = "strpos('0123456789abcdef', substr(h, {}, 1)) - 1"
    value = "(" * 9 + f"({digit.format('b * 10 + 1')})" + "".join(f" * 16 + ({digit.format(f'b * 10 + {i}')}))" for i in range(2, 11))
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST({value} AS BIGINT) >> (35 - 5 * k)) & 31 AS INTEGER) + 1, 1)"
    text = f"array_to_string(flatten(list_transform(range(4), lambda b: list_transform(range(8), lambda k: {letter}))), '')"
    return f"""WITH hashed AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
      firsts AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h)
    SELECT page_id, payload_bytes, {text} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM hashed JOIN firsts USING (h)"""
