"""WARC archives: written one gzip member per record, read back by byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, stored
from .tokens import chunks

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at a time, and an archive's size after which a task starts the next.
BLOCK, ARCHIVE = 1 << 20, 256 << 20
RECORD = ("path string, offset bigint, record_type string, record_id string, url string, refers_to string, "
          "payload_digest string, payload_bytes bigint, payload binary")
COLUMNS = [name.split()[0] for name in RECORD.split(", ")]
#: Tasks that read, at most: with more ranges a task scans several.
TASKS = 10_000


def decide(pages: DataFrame, key: str, payload: str, least: int = 100) -> DataFrame:
    """Adds ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to`` to pages with a binary payload.

    Of equal payloads of ``least`` bytes or more the row with the smallest key is the response, all others revisit
    it; rows with that same key are responses as well, and a null key never is the smallest of a group with another.
    Smaller payloads are all responses. A null payload counts as empty.
    """
    body = F.coalesce(F.col(payload), F.lit(b""))
    rows = pages.drop("payload_digest", "payload_bytes", "record_type", "refers_to").withColumn(payload, body).withColumns({
        "payload_digest": F.sha2(F.col(payload), 256), "payload_bytes": F.octet_length(payload).cast("long")})
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min(key).alias("__tidemill_first"), F.count("*").alias("__tidemill_n")).where("__tidemill_n > 1 and __tidemill_first is not null")
    joined = rows.join(shared.drop("__tidemill_n"), "payload_digest", "left")
    again = F.col("__tidemill_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__tidemill_first"))
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"),
                               "refers_to": F.when(again, F.col("__tidemill_first"))}).drop("__tidemill_first")


def record(kind: str, key: int | None, url: str | None, refers: int | None, digest: str, length: int, payload: bytes) -> bytes:
    """One record: WARC headers, then an HTTP response head and, but for a revisit, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, key: str, url: str, payload: str) -> DataFrame:
    """Write the rows of ``decide`` as archives below ``folder``; returns the table of archives (path, bytes, records).

    A task writes under names of its own; only names that a successful task reports are in the table, so files
    of failed or repeated attempts are never read.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, out, path, size, count = [], None, "", 0, 0
        for batch in chunks(batches, payload, 8 << 20):
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder.rstrip('/')}/{name}", 0, 0
                    out = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                member = gzip.compress(record(row["record_type"], row[key], row[url], row["refers_to"], row["payload_digest"],
                                              row["payload_bytes"], row[payload]), 5, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    columns = [key, url, payload, "payload_digest", "payload_bytes", "record_type", "refers_to"]
    return stored(pages.select(*columns).mapInArrow(write, "path string, bytes bigint, records bigint"), "archives")


class _Range:
    """A file as far as a task needs it, read in blocks; places are those in the file."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start, self.held, self.size = file, start, b"", file.size()

    def piece(self, at: int, length: int) -> memoryview:
        """Up to ``length`` bytes from ``at``, none only at the end of the file; what lies before is let go of block by block."""
        if at >= self.start + len(self.held):
            self.held = self.file.read_at(min(BLOCK, max(0, self.size - at)), at)
            self.start = at
        return memoryview(self.held)[at - self.start:at - self.start + length]

    def find(self, at: int, end: int) -> int:
        """The first place of the magic number in [at, end), or ``end``."""
        while at < end:
            block = self.file.read_at(min(BLOCK + len(MAGIC) - 1, self.size - at), at)
            found = block.find(MAGIC)
            if found >= 0:
                return min(at + found, end)
            at += BLOCK
        return end


def _member(data: _Range, offset: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at an offset and where it ends, or None if none that starts a record is there."""
    inflate, parts, at, length = zlib.decompressobj(31), [], offset, 1 << 12
    begun = b""
    while not inflate.eof:
        # Small pieces first: what a short member leaves over is copied.
        piece = data.piece(at, length)
        if not piece:
            return None
        at, length = at + len(piece), min(2 * length, BLOCK)
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error:
            return None
        if len(begun) < 5:
            begun = b"".join(parts)[:5]
            if not b"WARC/".startswith(begun):
                return None
    return (b"".join(parts), at - len(inflate.unused_data)) if begun == b"WARC/" else None


def parse(content: bytes) -> dict | None:
    """The fields of a record, or None if its headers or lengths do not hold together."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    block = rest[:length]
    if not gap or len(block) != length or rest[length:] != b"\r\n\r\n":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}

    def bare(name: str) -> str | None:
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return value or None

    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    response = kind == "response"
    if response and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != int(inner.get("content-length", -1))):
        return None
    url = fields.get("warc-target-uri")
    return {"record_type": kind, "record_id": bare("warc-record-id"), "url": None if url is None else unquote(url), "refers_to": bare("warc-refers-to"),
            "payload_digest": stated, "payload_bytes": int(inner.get("content-length", len(payload))), "payload": payload if response else None}


def _scanned(spark: SparkSession, archives: DataFrame, width: int) -> DataFrame:
    """The records of all ranges, each with the place where it ends."""
    sized = archives.where("bytes > 0")
    count = sized.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / width)), F.lit(0)).cast("long")).first()[0]
    ranges = sized.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(width).cast("long"))).alias("start"))
    # A stated number of partitions is not merged, however few bytes the ranges themselves have; by range all get as many.
    ranges = ranges.repartitionByRange(max(1, -(-count // max(1, count // TASKS))), "path", "start")
    columns = [name.split()[0] for name in (RECORD + ", end bigint").split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"offset": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns], columns)

    def records(address: str, start: int) -> Iterator[dict]:
        fs, path = pafs.FileSystem.from_uri(address)
        with fs.open_input_file(path) as file:
            data, end = _Range(file, start), min(start + width, file.size())
            at, synced = start, start == 0
            while at < end:
                if not synced and (at := data.find(at, end)) == end:
                    break
                member = _member(data, at)
                if member is None:
                    if synced:
                        raise ValueError(f"no record at byte {at} of {address}")
                    at += 1
                    continue
                fields = parse(member[0])
                if fields is None:
                    raise ValueError(f"damaged record at byte {at} of {address}")
                yield {"path": address, "offset": at, "end": member[1], "length": len(member[0]), **fields}
                synced, at = True, member[1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for found in records(row["path"], row["start"]):
                    rows.append(found)
                    held += found["length"]
                    if held >= 4 * BLOCK:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(read, f"{RECORD}, end bigint")


def read_archives(spark: SparkSession, archives: DataFrame, width: int = 16 << 20, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The records of the archives (path, bytes), read by tasks that each scan one range of ``width`` bytes; a stored table of ``columns``.

    A task looks for the gzip magic number from the start of its range, takes a place for a member only if it
    decodes to a record's headers, and owns the records that start in its range; the last may end beyond. From the first
    record on, and from the start of an archive, each record must begin where the one before ends. A record whose check sum,
    lengths or digest fail raises. So does an archive of which the records found do not fill all bytes, or whose number is not that in
    a column ``records`` if there is one: damage that hides a record from the search leaves such a gap. Empty archives give no rows.
    """
    kept = list(dict.fromkeys([*columns, "path", "offset", "end"]))
    found = stored(_scanned(spark, archives, width).select(*kept), "records")
    read = found.groupBy("path").agg(F.sum(F.col("end") - F.col("offset")).alias("filled"), F.count("*").alias("found"))
    whole = F.coalesce("filled", F.lit(0)) == F.col("bytes")
    if "records" in archives.columns:
        whole = whole & (F.coalesce("found", F.lit(0)) == F.col("records"))
    bad = archives.join(read, "path", "left").where(~whole).select("path", "bytes", "filled", "found").limit(5).collect()
    if bad:
        raise ValueError("records are missing: " + "; ".join(f"{r['path']}: {r['found'] or 0} records in {r['filled'] or 0} of {r['bytes']} bytes" for r in bad))
    return found.select(*columns)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", width: int = 16 << 20,
               columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Write one record per page to new archives in the shared folder, and read them back."""
    rows = pages.select(F.col(key), F.col(url).cast("string"), F.col(payload).cast("binary"))
    archives = write_archives(decide(rows, key, payload), scratch_dir(spark, "warc"), key, url, payload)
    return read_archives(spark, archives, width, columns)
