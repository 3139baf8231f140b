"""WARC records in seekable Zstandard bundles.

Records are WARC/1.1 ``response`` records, or ``revisit`` records that refer to
an earlier response with the same payload. A bundle is a file of independent
Zstandard frames, each holding whole records up to ``frame_bytes``, followed by
the seekable format's seek table: a skippable frame with the compressed and
decompressed size of every frame. The index table maps each record to bundle,
frame, and offset within the decompressed frame, so one record is read by
decompressing one frame.

Bundles are written by the tasks that hold the records, through pyarrow's file
systems, into a shared folder. Each attempt writes under a name of its own, and
only the index rows of attempts that Spark commits name a bundle, so files of
lost attempts are never read.

Defined cases: a null payload counts as empty, a null url is written as an empty
target; a null page_id takes part like any other but sorts last when the
smallest id is chosen; repeated rows that have the smallest id of their
payload are all responses; a very long payload is one frame of its own length; an
empty table gives no rows. Records are named by their page's id in a field of
their own, so repeated rows have distinct record ids. Only id, url and payload
are read, so other columns may have any name.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, store_uri

#: Values fixed by the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_INDEX = "page_id long, bundle string, frame int, offset long, length long"


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, bytes, refers_to): refers_to is null for responses."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("bytes", F.length("body").cast("long"))
    first = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first_id")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "digest", "bytes", refers.alias("refers_to"), F.when(refers.isNull(), F.col("body")).alias("body"))


def _record(page_id, url: str, digest: str, size: int, refers_to, body: bytes | None, date: str) -> bytes:
    kind = "revisit" if refers_to is not None else "response"
    name = "" if page_id is None else str(page_id)
    block = body if body is not None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        # a record's own name: rows may repeat an id
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Page-ID: {name}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if lines[0] != "WARC/1.1" or not rest.endswith(b"\r\n\r\n") or len(rest) - 4 != int(headers["Content-Length"]):
        raise ValueError("not a whole WARC record")
    return headers, rest[:-4]


class BundleWriter:
    """Writes one bundle to an open binary stream."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame number, offset within the frame, and length of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.end_frame()
        at = len(self.frames), self.size, len(record)
        self.held.append(record)
        self.size += len(record)
        return at

    def end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def finish(self) -> None:
        if self.size:
            self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        if struct.unpack("<II", file.read_at(8, at)) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("the seek table does not follow the last frame")

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        if len(data) != plain:
            raise ValueError("frame of another size than in the seek table")
        return data


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28, when: dt.datetime | None = None) -> DataFrame:
    """Write records (the columns of ``revisits``) as bundles, dated ``when`` (now); returns their stored index.

    A task holds one frame at a time and begins a new bundle after ``bundle_bytes``.
    """
    spark = records.sparkSession
    bundles = store_uri(spark, f"{folder}/bundles")
    date = (when or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(bundles)
        store.create_dir(root, recursive=True)
        out = writer = name = None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if writer is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(name, compression=None)
                    writer = BundleWriter(out, frame_bytes)
                rows.append((x["page_id"], name, *writer.add(_record(x["page_id"], x["url"], x["digest"], x["bytes"], x["refers_to"], x["body"], date))))
                if writer.written >= bundle_bytes:
                    writer.finish()
                    out.close()
                    writer = None
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.finish()
            out.close()

    small_batches(records).mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, task_bytes: int = 32 << 20) -> DataFrame:
    """Read every indexed record back: page_id, record_type, payload_digest,
    payload_bytes, refers_to, target_uri, body_digest (null for revisits).

    Index rows are sorted by bundle and frame, so a task opens a bundle once and
    decompresses each frame once, holding one frame. Index rows are small beside
    what they point to, so the tasks are as many as ``task_bytes`` of records ask for.
    """
    bundles = store_uri(index.sparkSession, f"{folder}/bundles")
    parts = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(bundles)
        name = reader = number = data = None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["bundle"] != name:
                    name, number = x["bundle"], None
                    reader = BundleReader(store.open_input_file(name))
                if x["frame"] != number:
                    number = x["frame"]
                    data = reader.frame(number)
                head, body = parse_record(data[x["offset"] : x["offset"] + x["length"]])
                own, back = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page-ID")
                kind = head["WARC-Type"]
                rows.append({
                    "page_id": int(own) if own else None, "record_type": kind, "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(head["WARC-Payload-Length"]),
                    "refers_to": int(back) if back else None, "target_uri": head["WARC-Target-URI"], "body_digest": hashlib.sha256(body).hexdigest() if kind == "response" else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("body_digest", pa.string())])
    ordered = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInArrow(read, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, target_uri string, body_digest string")


def archive(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to; the body read must have the
    recorded digest."""
    folder = new_path(pages.sparkSession, "warc")
    index = write_bundles(revisits(pages, min_bytes), folder)
    back = read_records(index, folder)
    digest = F.when(F.col("body_digest").isNull() | (F.col("body_digest") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload read back differs from its digest")))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
