"""WARC 1.1 writer and sequential reader.

Each record is one gzip member. The reader inflates members one after the other with an incremental
decompressor, frames the block by Content-Length, and verifies block and payload digests. Archives go
through ``pyarrow.fs`` to the shared folder, and only those named in the manifest that Spark committed
are read: the files of lost or repeated task attempts are never seen.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import bounded_batches, keep, scratch_dir, table

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of an archive after which the writer begins the next.
ROLL_BYTES = 32 << 20
_READ = 1 << 16
_CRLF = b"\r\n"
_SAFE = {10: "%0A", 13: "%0D"}


class Malformed(ValueError):
    """A record that does not have the form or the digest it states."""


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, ident: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of its response and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(_SAFE)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated members of a gzip stream, one at a time; ``stream`` has ``read(n)``."""
    rest = b""
    while True:
        rest = rest or stream.read(_READ)
        if not rest:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                rest = stream.read(_READ)
                if not rest:
                    raise Malformed("the last member ends early")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    """Headers, type, HTTP header and payload of one record; digests are verified."""
    head, gap, body = member.partition(b"\r\n\r\n")
    lines = head.split(_CRLF)
    if not gap or not lines[0].startswith(b"WARC/"):
        raise Malformed("no WARC header")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise Malformed("no Content-Length") from None
    block = body[:length]
    if len(block) != length or body[length:] != b"\r\n\r\n":
        raise Malformed("the block has another length than stated")
    if fields.get("warc-block-digest", "").removeprefix("sha1:") != hashlib.sha1(block).hexdigest():
        raise Malformed("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    if kind == "response" and digest != hashlib.sha1(payload).hexdigest():
        raise Malformed("payload digest")
    stated = [x.split(b":", 1)[1] for x in http.split(_CRLF) if x.lower().startswith(b"content-length:")]
    return {"fields": fields, "kind": kind, "payload": payload, "digest": digest, "payload_bytes": int(stated[0]) if stated else len(payload)}


def read_archive(uri: str) -> Iterator[dict]:
    """The records of an archive in order, with memory for one record."""
    filesystem, path = _opened(uri)
    with filesystem.open_input_stream(path, compression=None) as stream:
        for member in members(stream):
            yield parse(member)


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and ``response_id``: the largest page_id
    of its payload, for payloads of ``revisit_bytes`` or more that occur again, else null."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    where = scratch_dir(pages.sparkSession)
    large = rows.where(F.col("payload_bytes") >= revisit_bytes)
    # One row for each payload and task is shuffled; only payloads that occur twice are joined.
    again = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    again = keep(again.select("payload_digest", "payload_bytes", "response_id"), where, "again")
    return rows.join(again, ["payload_digest", "payload_bytes"], "left")


def write_archives(planned: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write rows of ``plan_records``; returns (archive string, records long) for each archive."""

    def write(batches):
        import os
        import uuid

        out, sink, path, count, size = [], None, "", 0, 0
        try:
            for batch in batches:
                c = {name: batch.column(name) for name in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "response_id")}
                for i in range(batch.num_rows):
                    if sink is None:
                        path = f"{folder}/{uuid.uuid4().hex}-{os.getpid()}.warc.gz"
                        filesystem, name = _opened(path)
                        filesystem.create_dir(os.path.dirname(name), recursive=True)
                        sink, count, size = filesystem.open_output_stream(name, compression=None), 0, 0
                    page, first = c["page_id"][i].as_py(), c["response_id"][i].as_py()
                    kind = "revisit" if first is not None and page != first else "response"
                    ident = "" if page is None else str(page)
                    data = record(kind, ident, c["url"][i].as_py(), c["payload"][i].as_py(), c["payload_digest"][i].as_py(), c["payload_bytes"][i].as_py(), None if first is None else str(first))
                    sink.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= roll_bytes:
                        sink.close()
                        sink = None
                        out.append((path, count))
        finally:
            if sink is not None:
                sink.close()
                out.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["archive", "records"])

    return planned.mapInArrow(write, "archive string, records long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Read the archives of a manifest; one row for each record."""

    def read(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                for x in read_archive(archive):
                    f, seen = x["fields"], seen + 1
                    rows.append((_page(f["warc-record-id"]), x["payload_bytes"], x["digest"], x["kind"], _page(f["warc-refers-to"]) if "warc-refers-to" in f else None, f.get("warc-target-uri")))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if seen != records:
                    raise Malformed(f"{archive} has {seen} records; {records} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return manifest.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and read the archives back.

    Null html is an empty payload; rows with equal page_id are records of their own (all of a payload's
    largest id are responses); a null page_id stays null and is never a response that others refer to,
    unless all are null: those are all responses.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    where = scratch_dir(spark)
    manifest = keep(write_archives(plan_records(pages), f"{where}/archives"), where, "manifest")
    # An archive is one row; deal them out evenly, so that each is read by a task of its own.
    n = max(1, manifest.count())
    return read_archives(manifest.repartition(n, "archive"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, payload_bytes, max(page_id) as response_id from p where payload_bytes >= 1000 group by 1, 2)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when m.response_id is not null and p.page_id <> m.response_id then 'revisit' else 'response' end as record_type,
  case when m.response_id is not null and p.page_id <> m.response_id then m.response_id end as refers_to
from p left join m on p.payload_digest = m.payload_digest and p.payload_bytes = m.payload_bytes
"""
