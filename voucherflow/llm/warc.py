"""Operator 2: WARC writer and splittable WARC reader.

*Writer.* Every task streams its rows into archives of its own, one gzip member a record. Rows with equal payloads of at
least ``min_bytes`` bytes become one response and revisits of it (identical-payload-digest). A task may run
twice, so a file counts only if the manifest, which Spark commits, lists it.

*Reader.* Archives are cut into byte ranges. A task scans its range for the gzip magic, validates a candidate by decoding it
and looking for a WARC header with a full record, follows the chain of members from there, and owns exactly
the records that start inside its range; the last one may end beyond it. Memory: one range and one record.

Archives lie in the folder given, by any scheme that pyarrow's file systems open; it must be one that all executors share.

Defined cases: a null html is an empty payload; a null url gives no target header; a row with a null page_id
never is the one referred to unless all rows of its payload have none, and then all are responses; rows that repeat the smallest page_id
with the same payload are all responses. An empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, table, written

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"  # archives of equal rows are equal
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(digest[:32])}>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given, with the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict | None:
    """The record in a member's bytes; None if they don't hold a whole one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    return {
        "page_id": page(fields.get("warc-record-id", "")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": page(fields.get("warc-refers-to", "")),
        "payload_bytes": int(said[1]) if revisit and said else len(payload),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _write(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, size = None, "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.record_batch({"path": [path], "bytes": [size]})

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(*row)) + z.flush()
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(pages: DataFrame, folder: str, *, min_bytes: int = 100, archive_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Archive every row below ``folder``; returns the manifest: path, bytes."""
    pages = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    same = pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # a payload shared by many rows is a skewed key here, which AQE splits
    pages = pages.join(same.where("n > 1").select("digest", "first"), "digest", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return written(pages.withColumn("refers_to", refers).mapInArrow(_write(folder, archive_bytes, level), "path string, bytes long"), "warc-manifest")


def _member(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and where it ends; None if it's no gzip, EOFError if the data end before it."""
    z, parts, step = zlib.decompressobj(31), [], 4096
    while True:
        chunk = data[at : at + step]
        if not len(chunk):
            raise EOFError
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            return None
        if len(parts) == 1 and len(parts[0]) >= 7 and not parts[0].startswith(b"WARC/1."):
            return None
        at += len(chunk)
        if z.eof:
            return b"".join(parts), at - len(z.unused_data)
        step = min(2 * step, 1 << 20)


def read_range(source, start: int, end: int, size: int, ahead: int = 1 << 20) -> Iterator[dict]:
    """The records that start in [start, end) of an open file of ``size`` bytes."""
    data = source.read_at(min(end + ahead, size) - start, start)
    at = 0
    while (at := data.find(MAGIC, at)) >= 0 and at < end - start:
        try:
            got = _member(memoryview(data), at)
        except EOFError:
            have = start + len(data)
            if have < size:  # a record longer than what was read ahead
                data += source.read_at(min(max(len(data), ahead), size - have), have)
                continue
            got = None
        if got and (row := parse(got[0])):
            yield row
            at = got[1]
        else:
            at += 1  # these three bytes stood inside a member


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
        for batch in batches:
            for path, start, end, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "end", "bytes")), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for row in read_range(source, start, end, size):
                        rows.append(row)
                        held += row["payload_bytes"]
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema)

    return run


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame, *, range_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives in ``manifest`` (path, bytes), read by byte ranges."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.select("path", "bytes", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(int(n)).mapInArrow(_read(folder), RECORDS)


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_bytes >= 100 AND d.payload_digest = f.payload_digest
"""
