"""WARC archives: a writer with revisit records, and a sequential reader.

Each record is a gzip member of its own.  The reader inflates a file piece by piece, frames records
by ``Content-Length``, and checks the block digest and the payload digest of what it reads; it holds
one record at a time.  Archives live in the shared folder and are reached through Arrow's file
systems, so any executor can read what another wrote.  Only files named in the written manifest are
read: leftovers of lost or repeated tasks are not.

Edge cases: a null html is an empty payload; a null page id or url is kept as null; among records
with equal payloads all rows with the smallest page id are responses, so repeated rows stay
responses when they are the smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize, scratch, table

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 64 << 20
CHUNK = 1 << 18


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    sha = digest(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{url}/{sha}")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
        fields.append(("X-Target-Text", quote(url, safe="")))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class Truncated(ValueError):
    """An archive that ends inside a record, or a record that is not framed as it says."""


def members(stream) -> Iterator[bytes]:
    """The inflated bytes of each gzip member of a stream, read piece by piece."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    begun = False
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            if begun:
                raise Truncated("the archive ends inside a member")
            return
        begun = True
        parts.append(inflate.decompress(data))
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(parts)
            inflate, parts, begun = zlib.decompressobj(31), [], False


def parse(raw: bytes) -> dict:
    """Fields, block and payload of one record; raises where framing or a digest disagrees."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        raise Truncated("no record head")
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode().strip().lower()] = v.decode().strip()
    size = int(fields["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise Truncated("the block is not as long as it says")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields.get('warc-record-id')}")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != length or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError(f"payload digest of {fields.get('warc-record-id')}")
    return fields | {"payload": payload, "payload_bytes": length}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}" if uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def write_archives(pages: DataFrame, out: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` rows as archives below ``out``; returns the manifest ``path, records``.

    Payloads of at least ``min_revisit_bytes`` that occur again become revisits of the smallest page id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    again = materialize(rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-again")
    marked = join_hot(rows, again, "sha", "n", how="left").select("page_id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_revisit_bytes), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(out)
        store.create_dir(base, recursive=True)
        sink, path, size, count, done = None, "", 0, 0, []
        for b in batches:
            for p, u, x, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if sink is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(path, compression=None)
                data = record(p, u, x, r)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    sink.close()
                    done.append((os.path.basename(path), count))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((os.path.basename(path), count))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return materialize(marked.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, out: str) -> DataFrame:
    """The records of the archives that ``manifest`` names, payload and all."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]

    def rows(names: Iterator[str]) -> Iterator[tuple]:
        store, base = _open(out)
        for name in names:
            with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for raw in members(stream):
                    x = parse(raw)
                    number = lambda k, x=x: int(x[k]) if k in x else None
                    url = x.get("x-target-text")
                    yield number("x-page-id"), None if url is None else unquote(url), x["warc-type"], number("x-refers-to-page-id"), x["warc-payload-digest"].removeprefix("sha1:"), x["payload_bytes"], x["payload"]

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*part, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for row in rows(n for b in batches for n in b.column("path").to_pylist()):
            part.append(row)
            size += len(row[-1])
            if size > 4 << 20 or len(part) >= 2000:
                yield batch(part)
                part, size = [], 0
        if part:
            yield batch(part)

    spread = max(1, min(4096, manifest.count()))
    return manifest.select("path").repartition(spread, "path").mapInArrow(run, schema)


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record per page, then reads the archives back: what each record says of itself."""
    out = scratch(spark, "warc")
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), out), out)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
