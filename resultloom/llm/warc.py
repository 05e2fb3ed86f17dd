"""WARC archives: written in parallel with identical payloads stored once, and read back by byte ranges.

Writing: every task writes its records to files of its own in a shared folder, each record a gzip member, and returns the files' names and
sizes; only the list of a task's successful attempt is kept, so files of lost or repeated attempts are never read. Equal payloads
of at least ``least`` bytes are found by digest: the row of the largest id is the response, all others are revisits that
refer to it and hold the HTTP header alone. Only digests are grouped; rows meet the few repeated ones by digest.

Reading: files are cut into byte ranges, whatever their records. A task looks for gzip magic in its range and takes a place as a
member's start if the member's first bytes decode to a WARC header and, once decoded, it ends before another member or at the file's end. It
owns the records that start inside its range, and reads the last one beyond it. Payload digests are checked on the way.

Defined results: null payloads are empty; null ids stay null (such a row is a revisit if an equal payload has an id, else a response). Rows
of the same largest id are all responses. Characters that a header line cannot hold are percent-encoded in URLs. An empty table gives no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import few_or_not, shared_path, stored

LEAST_BYTES = 1000
FILE_BYTES, RANGE_BYTES = 256 << 20, 16 << 20
MOST_TASKS = 50_000     # beyond that many ranges a task reads several, one after the other
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_PROBE, _CHUNK = 1 << 12, 1 << 18

RECORD = "path string, offset long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def marked(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is set for revisits."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    large = F.octet_length("payload") >= least
    again = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND last IS NOT NULL")
    # the payloads stay where they are read, unless more of them repeat than may be broadcast
    again = few_or_not(stored(again.select(F.col("digest").alias("key"), "last"), "repeated"))
    # small payloads never match; a key of their own keeps equal ones out of one task
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(again, "key", "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _named(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def member(page_id, url, payload: bytes, digest: str, refers_to, level: int = 6) -> bytes:
    """One record as one gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records of ``marked``; returns ``path, size`` of the files."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        task, out, path, size, files = TaskContext.get(), None, "", 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(5))):
                if out is None:
                    path = f"{top}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(files)}.warc.gz"
                    out, size = system.open_output_stream(path, compression=None), 0   # the members are compressed already
                data = member(*(v.as_py() for v in row))
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    files.append((path, size))
                    out = None
        if out is not None:
            out.close()
            files.append((path, size))
        prefix = folder[:len(folder) - len(top)] if folder.endswith(top) else ""
        yield pa.RecordBatch.from_arrays([pa.array([prefix + p for p, _ in files], pa.string()), pa.array([s for _, s in files], pa.int64())], ["path", "size"])

    return stored(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(put, "path string, size long"), "warc-files")


def member_at(f, offset: int, size: int) -> tuple[bytes, int] | None:
    """Content and end of the member that starts at an offset, if it is a WARC record's."""
    f.seek(offset)
    data = f.read(_PROBE)
    decoder = zlib.decompressobj(31)
    try:
        first = decoder.decompress(data, 16)
        if not first.startswith(b"WARC/"):
            return None
        parts, at = [first], offset + len(data)
        data = decoder.unconsumed_tail
        while True:
            parts.append(decoder.decompress(data))
            if decoder.eof:
                break
            data = f.read(_CHUNK)
            if not data:
                return None
            at += len(data)
    except zlib.error:
        return None
    end = at - len(decoder.unused_data)
    if end < size:
        f.seek(end)
        if f.read(3) != MAGIC:
            return None
    return b"".join(parts), end


def starting_in(f, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records that start in [start, stop)."""
    at = start
    while at < stop:
        f.seek(at)
        window = f.read(min(_CHUNK, stop - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return
        record = member_at(f, at, size)
        if record is None:
            at += 1
        else:
            yield at, record[0]
            at = record[1]


def parsed(content: bytes) -> dict:
    """Fields of a record; the payload's digest is recomputed for responses and must agree."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(x) if (x := fields.get(name, "")[len("<urn:page:"):-1]) else None
    return {"record_type": fields["WARC-Type"], "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "refers_to": number("WARC-Refers-To"),
            "payload_bytes": n, "payload_digest": digest, "payload": None if revisit else payload}


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files (``path, size``), read in byte ranges."""
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    # a stated number of partitions: the ranges' own few bytes would be put together into one task
    n = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), MOST_TASKS))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in range(3))):
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(name) as f:
                    for offset, content in starting_in(f, start, min(start + range_bytes, size), size):
                        rows.append({"path": path, "offset": offset} | parsed(content))
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(fields, kinds))))
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(fields, kinds))))

    return ranges.select("path", "size", "start").mapInArrow(get, RECORD)


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES,
             file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads those back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read(write(marked(pages, id, url, payload, least), folder, file_bytes), range_bytes)
