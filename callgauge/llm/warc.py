"""WARC archives: a writer, and a splittable reader.

The writer makes one gzip member a record. Of records with equal payloads of at least
``REVISIT_BYTES`` bytes, the one with the smallest page_id is a response and the others are
revisits of it, which hold the HTTP head but no payload.

The reader deals byte ranges of the archives to tasks. A task looks for the gzip magic from its
range's start on, decodes the head of each candidate member, and takes it only if a WARC head
comes out, the record's length agrees and the member's checksum is right; else the search goes on
a byte later. It owns the records that start inside its range and reads the last of them past the
range's end. Nothing but the archives is needed: no index, no order. Payloads are decoded in
pieces, so a very long record takes bounded memory unless its payload itself is asked for.

Defined results: a null html is an empty payload; a null page_id is kept as null and is the
response only if no equal payload has an id; equal payloads whose smallest page_id occurs twice
have both as responses; a null url writes no target URI; empty tables give no archive and no row;
other columns are not read. A payload that itself holds uncompressed WARC gzip members could
be mistaken for records by a range that starts inside it; UTF-8 text can't hold the magic bytes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import common

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
PIECE = 1 << 18
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    again = (pages.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    found = pages.join(again, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the pages as ``*.warc.gz`` under ``path`` and return the manifest: path, bytes and n_records of
    each archive. The manifest is a table, written by Spark's commit protocol: archives of lost tasks are in none."""
    common.prepare(pages.sparkSession)

    def write(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out, name, at, n = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{path}/{name}", "bytes": at, "n_records": n}])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                if out is None:
                    name, at, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(record(*row, date)) + packer.flush()
                out.write(member)
                at, n = at + len(member), n + 1
                if at >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return common.stored(classify(pages).mapInArrow(write, "path string, bytes long, n_records long"), "warc-manifest")


class _File:
    """A file's bytes from any offset, read in pieces."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.base, self.data = 0, b""

    def at(self, offset: int) -> bytes:
        """Some bytes at ``offset``; none at the end."""
        if not self.base <= offset < self.base + len(self.data):
            self.base, self.data = offset, self.file.read_at(PIECE, offset) if offset < self.size else b""
        return self.data[offset - self.base:]

    def find(self, what: bytes, start: int, end: int) -> int:
        """Where ``what`` next starts in [start, end); -1 if nowhere."""
        while start < end:
            piece = self.at(start)
            if len(piece) < len(what) and start + len(piece) < self.size:
                self.base, self.data = start, self.file.read_at(max(PIECE, len(what)), start)
                piece = self.data
            k = piece.find(what)
            if k >= 0:
                return start + k if start + k < end else -1
            if start + len(piece) >= self.size:
                return -1
            start += max(1, len(piece) - len(what) + 1)
        return -1


class _Member:
    """The decoded bytes of the gzip member at an offset, in pieces; ``end`` is where it ends."""

    def __init__(self, file: _File, offset: int):
        self.file, self.next, self.packed = file, offset, zlib.decompressobj(31)
        self.end = None

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes; none at the end. Raises zlib.error or EOFError on what is no member."""
        while not self.packed.eof:
            tail = self.packed.unconsumed_tail
            if not tail:
                tail = self.file.at(self.next)
                if not tail:
                    raise EOFError
                self.next += len(tail)
            out = self.packed.decompress(tail, most)
            if out:
                return out
        self.end = self.next - len(self.packed.unused_data)
        return b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_record(file: _File, offset: int, with_payload: bool = False) -> dict | None:
    """The record whose gzip member starts at ``offset``; None if there is none. ``next``: the offset after it."""
    member, data = _Member(file, offset), b""

    def until(mark: bytes, most: float) -> bytes:
        """The bytes before ``mark``, which is looked for in ``most`` bytes."""
        nonlocal data
        seen, at = bytearray(data), 0
        while (k := seen.find(mark, at)) < 0:
            at = max(0, len(seen) - len(mark) + 1)
            more = member.read(4096)
            if not more or len(seen) > most:
                raise ValueError
            seen += more
            if not head and seen[:len(VERSION)] != VERSION[:len(seen)]:  # a piece may end after a few bytes
                raise ValueError
        data = bytes(seen[k + len(mark):])
        return bytes(seen[:k])

    head = b""
    try:
        head = until(b"\r\n\r\n", float("inf"))  # a target URI may have any length
        fields = _fields(head)
        left, http = int(fields["content-length"]), {}
        if fields.get("content-type", "").startswith("application/http"):
            http_head = until(b"\r\n\r\n", float("inf"))  # a target URI may have any length
            left -= len(http_head) + 4
            http = _fields(http_head)
        n, digest, kept = 0, hashlib.sha256(), []
        while n < left:
            data = data or member.read(PIECE)
            if not data:
                raise ValueError
            part, data = data[: left - n], data[left - n:]
            digest.update(part)
            n += len(part)
            if with_payload:
                kept.append(part)
        while True:
            more = member.read(PIECE)
            if not more:
                break
            data += more
        if left < 0 or data != b"\r\n\r\n":
            raise ValueError
    except (zlib.error, EOFError, ValueError, KeyError):
        return None
    kind = fields.get("warc-type")
    if kind == "revisit":
        size, told = int(http.get("content-length") or 0), fields.get("warc-payload-digest", "")
    else:
        size, told = n, "sha256:" + digest.hexdigest()
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": size, "payload_digest": told.partition(":")[2], "payload": b"".join(kept) if with_payload and kind != "revisit" else None, "next": member.end}


def read_range(uri: str, start: int, end: int, with_payload: bool = False) -> Iterator[dict]:
    """The records that start in [start, end) of an archive."""
    file = _File(uri)
    at = start
    while (at := file.find(MAGIC, at, end)) >= 0:
        found = read_record(file, at, with_payload)
        if found is None:
            at += 1
        else:
            found["offset"] = at
            yield found
            at = found["next"]


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of ``archives`` (path, bytes), a row each: path, offset, record_type, record_id, refers_to_id,
    target_uri, payload_bytes, payload_digest and, if asked for, payload."""
    spark = archives.sparkSession
    common.prepare(spark)
    splits = (archives.select("path", "bytes").withColumn("start", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")))
              .withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes"))))
    n = splits.count()
    names = ["path", "offset", "record_type", "record_id", "refers_to_id", "target_uri", "payload_bytes", "payload_digest", "payload"][: 9 if with_payload else 8]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for r in read_range(row["path"], row["start"], row["end"], with_payload):
                    rows.append([row["path"], *(r[c] for c in names[1:])])
                    size += r["payload_bytes"] if with_payload else 0
                    if len(rows) == 1024 or size > 8 << 20:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.string())) for c, x in zip(zip(*rows), names)], names=names)

    schema = ", ".join(f"{x} {({'offset': 'long', 'payload_bytes': 'long', 'payload': 'binary'}).get(x, 'string')}" for x in names)
    return splits.repartition(max(n, 1), "path", "start").select("path", "start", "end").mapInArrow(read, schema)


def checked(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records``, stored; raises where an archive gave another number of them than ``manifest`` (path, n_records) says."""
    records = common.stored(records, "warc-records")
    wrong = (manifest.select("path", "n_records").join(records.groupBy("path").agg(F.count("*").alias("n_read")), "path", "left")
             .where("coalesce(n_read, 0) != n_records").select("path", F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_records").limit(5).collect())
    if wrong:
        raise RuntimeError("archives read in part: " + "; ".join(f"{r.n_read} of {r.n_records} records of {r.path}" for r in wrong))
    return records


def _page(col: str):
    """The page id in a record id; null for a page without one."""
    return F.expr(f"try_cast(regexp_extract({col}, '<urn:x-page:(-?[0-9]+)>', 1) as bigint)")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"))
    return checked(read_archives(manifest), manifest).select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to_id").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS t, octet_length(encode(COALESCE(html, ''))) AS n, sha256(COALESCE(html, '')) AS d FROM pages),
f AS (SELECT d, MIN(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING COUNT(*) > 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
