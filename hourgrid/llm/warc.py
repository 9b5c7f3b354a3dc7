"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a skippable frame that holds the seek
table (compressed and plain size of every frame). The index maps a record identifier to bundle, frame number and
offset within the plain frame, so one record costs one footer read and one frame read.

Executors write bundles under names of their own attempt, and the index that Spark commits names only those of
attempts that succeeded: a task that runs again leaves an unnamed file at most.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import landed, new_folder, read_table

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Equal payloads shorter than this stay responses.
REVISIT_BYTES = 1000
INDEX_SCHEMA = "record_id string, bundle string, frame int, record_offset long, record_length long"
RECORD_SCHEMA = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _urn(record_id: str) -> str:
    return f"<urn:record:{quote(record_id, safe='')}>"


def _id(urn: str) -> str:
    return unquote(urn.removeprefix("<urn:record:").removesuffix(">"))


def build_record(record_id: str, url: str | None, record_type: str, refers_to: str | None, digest: str, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record, checked: a response's digest is computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return {
        "record_id": _id(fields["WARC-Record-ID"]), "url": None if url is None else unquote(url) if "%" in url else url, "record_type": fields["WARC-Type"],
        "refers_to": _id(fields["WARC-Refers-To"]) if revisit else None, "payload_bytes": size, "payload_digest": stated, "payload": None if revisit else payload,
    }


class BundleWriter:
    """One bundle: add() records; close() appends the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.stream, self.frame_bytes, self.frames, self.plain, self.written = stream, frame_bytes, [], bytearray(), 0
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.plain and len(self.plain) + len(record) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), len(self.plain))
        self.plain += record
        return at

    def flush(self) -> None:
        if self.plain:
            packed = self.compressor.compress(bytes(self.plain))
            self.stream.write(packed)
            self.written += len(packed)
            self.frames.append((len(packed), len(self.plain)))
            self.plain = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_TABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Frames of one bundle by number, through its seek table."""

    def __init__(self, handle):
        import zstandard

        self.handle, self.decompressor, self.last = handle, zstandard.ZstdDecompressor(), (-1, b"")
        size = handle.size()
        handle.seek(size - FOOTER_BYTES)
        count, _, magic = struct.unpack("<IBI", handle.read(FOOTER_BYTES))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        handle.seek(size - FOOTER_BYTES - 8 * count)
        sizes = struct.unpack(f"<{2 * count}I", handle.read(8 * count))
        self.at = [0]
        for packed in sizes[::2]:
            self.at.append(self.at[-1] + packed)
        self.plain = sizes[1::2]

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            self.handle.seek(self.at[number])
            packed = self.handle.read(self.at[number + 1] - self.at[number])
            self.last = (number, self.decompressor.decompress(packed, max_output_size=self.plain[number]))
        return self.last[1]


def _write(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("record_offset", pa.int64()), ("record_length", pa.int64())])
    files, root = _filesystem(folder)
    writer, name = None, ""
    for batch in batches:
        rows = []
        for record in batch.to_pylist():
            if writer is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                writer = BundleWriter(files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
            raw = build_record(record["record_id"], record["url"], record["record_type"], record["refers_to"], record["digest"], record["payload"], date)
            frame, offset = writer.add(raw)
            rows.append({"record_id": record["record_id"], "bundle": name, "frame": frame, "record_offset": offset, "record_length": len(raw)})
            if writer.written >= bundle_bytes:
                writer.close()
                writer = None
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if writer is not None:
        writer.close()


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    files, root = _filesystem(folder)
    name, reader = None, None
    for batch in batches:
        out, held = [], 0
        for row in batch.to_pylist():
            if row["bundle"] != name:
                if reader is not None:
                    reader.handle.close()
                name = row["bundle"]
                reader = BundleReader(files.open_input_file(f"{root}/{name}"))
            start = row["record_offset"]
            parsed = parse_record(reader.frame(row["frame"])[start : start + row["record_length"]])
            held += len(parsed["payload"] or b"") if payloads else 0
            out.append(parsed if payloads else parsed | {"payload": None})
            if held > 1 << 24:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if reader is not None:
        reader.handle.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES,
                   frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into bundles under ``folder`` (a shared path) and return the index, landed as Parquet.

    Among rows with equal payloads of at least ``revisit_bytes`` the largest id is the response and the others
    revisit it. Null payloads are empty; a null url leaves the header out; a null id becomes the text ``null`` and
    never wins over another id; rows that repeat id and payload are all written, those with the winning id as
    responses. Other columns are ignored. An empty table writes no bundle and gives an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    first = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(landed(first), "digest", "left")  # landed, so that the rows of a very common payload are split among tasks
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    records = rows.select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("record_id"), "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"), "digest", "payload",
    )
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    index = records.mapInArrow(partial(_write, folder=folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, date=date), INDEX_SCHEMA)
    return landed(index, f"{folder}/index")


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, a frame read for each run of records in it."""
    # The index is small beside the frames it names, so the number of tasks is set, not left to the index's size.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "record_offset")
    return placed.mapInArrow(partial(_read, folder=folder, payloads=payloads), RECORD_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into seekable bundles and read back; one row per page."""
    folder = new_folder(spark, "warc")
    index = write_archives(read_table(spark, sf_dir, "pages"), folder)
    back = read_archives(index, folder, payloads=False)
    return back.select(F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN strlen(payload) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(payload) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
