"""WARC archives: a writer and a splittable reader.

Writing.  Payload digests are aggregated first, so that of the records with equal
payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id is
written as ``response`` and the others as ``revisit`` records that refer to it.
Every task writes one archive of gzip members, a record each, under a name of its
own attempt; only archives named in the stored manifest exist for the reader, so
retried and speculative tasks do no harm.

Reading.  Archives are cut into byte ranges.  A task scans its range for the gzip
magic and takes a place for a member only if the bytes inflate to a WARC header;
it owns the records that start in its range and reads the last one past the end.
A task holds one block of bytes and one record at a time.

Paths go through ``pyarrow.fs``, so local folders and object or HDFS stores work.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostscope.llm import common as C
from hostscope.session import shared_path

LEAST_REVISIT = 100
SPLIT_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # fixed, so that reruns write equal archives
RECORD_ROWS = 256  # payloads handed to Python at once


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return fs, inner


def with_revisits(records: DataFrame) -> DataFrame:
    """Add ``payload_bytes, payload_digest, record_type, refers_to`` to
    ``records(record_id, uri, payload, ...)``; the payload is text, null counts
    as empty.  Equal payloads are equal SHA-256 digests."""
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    described = records.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn(
        "payload_digest", F.sha2(payload, 256))
    repeated = (
        described.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy(F.col("payload_digest").alias("d")).agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("d", "first")
    )
    out = described.join(repeated, F.col("payload_digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("first"))).drop("d", "first")


def _member(record_id, uri, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    # a revisit has no body, but its HTTP header keeps the full length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records(record_id long, uri, payload text)`` as ``*.warc.gz`` under
    ``folder`` and return the stored manifest ``path, bytes, records``."""
    spark = records.sparkSession
    C.python_ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORD_ROWS))

    def write(batches: Iterator[pd.DataFrame]):
        out, path, size, n = None, "", 0, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, inner = _open(path)
                    fs.create_dir(os.path.dirname(inner), recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                text = r.payload if isinstance(r.payload, str) else ""
                uri = r.uri if isinstance(r.uri, str) else None
                key = None if r.record_id is None or r.record_id != r.record_id else r.record_id
                data = _member(key, uri, text.encode("utf-8", "surrogatepass"), r.payload_bytes,
                               r.payload_digest, r.record_type, r.refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    rows = with_revisits(records.select(
        F.col("record_id").cast("long"), F.col("uri").cast("string"), F.col("payload").cast("string")))
    # ids as text: pandas would turn longs with nulls into doubles
    rows = rows.select(F.col("record_id").cast("string"), "uri", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
                       "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("string"))
    return C.stored(rows.mapInPandas(write, "path string, bytes long, records long"), "manifest")


class _Window:
    """A file seen through blocks: bytes from ``at`` on, read as needed."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.data = handle, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.handle.seek(at)
            self.start, self.data = at, self.handle.read(min(max(n, BLOCK_BYTES), self.size - at))
        return self.data[at - self.start : at - self.start + n]


def _is_member(window: _Window, at: int) -> bool:
    """Does a gzip member with a WARC header start here?"""
    try:
        return zlib.decompressobj(31).decompress(window.read(at, 512), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(window: _Window, at: int) -> tuple[bytes, int]:
    """The member that starts at ``at``, and where it ends."""
    z, parts, here = zlib.decompressobj(31), [], at
    while not z.eof:
        data = window.read(here, 64 << 10)
        if not data:
            raise ValueError(f"archive ends inside the record at byte {at}")
        parts.append(z.decompress(data))
        here += len(data) - len(z.unused_data)
    return b"".join(parts), here


def _members(window: _Window, start: int, end: int) -> Iterator[bytes]:
    at = start
    known = False  # the end of a record is the start of the next: no search needed
    while at < end:
        if known or _is_member(window, at):
            if not window.read(at, 3) == MAGIC:
                known = False
                continue
            data, at = _inflate(window, at)
            known = at < end and window.read(at, 3) == MAGIC
            yield data
            continue
        block = window.read(at + 1, BLOCK_BYTES // 2)
        hit = block.find(MAGIC)
        # a magic may lie across the block's end
        at = at + 1 + hit if hit >= 0 else at + 1 + max(len(block) - 2, 1)


def parse_record(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = block[: int(fields.get("content-length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha256:")
    number = lambda x: x.removeprefix("<urn:record:").removesuffix(">") or None
    return {
        "record_id": number(fields.get("warc-record-id", "")), "record_type": kind, "uri": fields.get("warc-target-uri"),
        "refers_to": number(fields.get("warc-refers-to", "")),
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else 0,
        "payload_digest": digest,
        "payload": payload.decode("utf-8", "replace") if kind == "response" else None,
        "damaged": kind == "response" and fields.get("warc-payload-digest") != f"sha256:{digest}",
    }


RECORD = ("record_id string, record_type string, uri string, refers_to string, payload_bytes long, "
          "payload_digest string, payload string, damaged boolean")


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of ``archives(path, bytes)``: ``record_id, record_type, uri,
    refers_to, payload_bytes, payload_digest, payload, damaged``.

    Any byte range split gives each record exactly once.  Digest and length of
    responses are taken from the payload read; those of revisits, which have
    none, from the record's header.  ``damaged``: the stored digest does not fit.
    """
    spark: SparkSession = archives.sparkSession
    C.python_ready(spark)

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"]):
                fs, inner = _open(path)
                held, weight = [], 0
                with fs.open_input_file(inner) as handle:
                    for data in _members(_Window(handle, size), int(start), min(int(start) + split_bytes, size)):
                        record = parse_record(data)
                        if not payloads:
                            record["payload"] = None
                        held.append(record)
                        weight += len(data) if payloads else 256
                        if weight > 4 << 20:
                            yield pd.DataFrame(held)
                            held, weight = [], 0
                if held:
                    yield pd.DataFrame(held)

    ranges = archives.select(
        "path", "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(n), "path", "start").mapInPandas(read, RECORD)


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes`` of the archives under a folder, from file metadata only."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option(
        "recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in the shared folder, read
    them back, and return per page ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``.

    Null html is an empty payload, a null url leaves the target out, a null id
    stays null (such a page revisits an equal page that has an id).  Pages that
    share the smallest id of a payload are all responses.  Repeated rows come
    back as often; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "llm", "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    records = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    manifest = write_archives(records, folder)
    back = read_archives(manifest, payloads=False)
    return back.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))
