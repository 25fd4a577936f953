"""WARC 1.1 archives: writer and sequential reader.

Writer: one gzip member per record. A record whose payload digest was already
seen (smallest page id first) becomes a `revisit` without a block. Archives are
rolled at a byte bound and listed in a manifest; only archives in the committed
manifest are read, so files of failed task attempts do no harm.

Reader: a stream of bytes goes through zlib member by member; each member is one
record, framed by its Content-Length and checked against its digests. Memory is
one buffer plus one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm._store import arrow_map, cut, new_path, open_path, ship

ARCHIVE_BYTES = 64 << 20
LEVEL = 3
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that breaks framing or fails its digest."""


def b32sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _clean(v: str) -> str:
    return v.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """Record of a page: a response with its payload, or, given the page id it
    refers to, a revisit. Ids go into extension headers as plain integers."""
    digest = b32sha1(payload)
    kind = "response" if refers_to is None else "revisit"
    h = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", NO_DATE)]
    if url is not None:
        h.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        h.append(("WARC-X-Page-ID", str(page_id)))
    h += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-X-Payload-Length", str(len(payload)))]
    if refers_to is None:
        h += [("Content-Type", "text/html; charset=utf-8"), ("WARC-Block-Digest", f"sha1:{digest}")]
        return record(h, payload, level)
    h += [("WARC-Profile", PROFILE), ("WARC-X-Refers-To-Page-ID", str(refers_to)), ("WARC-Block-Digest", f"sha1:{b32sha1(b'')}")]
    return record(h, b"", level)


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """Each gzip member of a stream, decompressed step by step."""
    rest = b""
    while True:
        z, out, begun = zlib.decompressobj(31), [], bool(rest)
        while not z.eof:
            data = rest or stream.read(size)
            rest = b""
            if not data:
                if begun:
                    raise WarcError("the archive ends inside a member")
                return
            begun = True
            out.append(z.decompress(data))
        rest = z.unused_data
        yield b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of a record; verifies version,
    length, end and block digest."""
    head, sep, body = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    n = int(headers.get("content-length", -1))
    if n < 0 or len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise WarcError("content length does not frame the record")
    block = body[:n]
    want = headers.get("warc-block-digest")
    if want and want != f"sha1:{b32sha1(block)}":
        raise WarcError("block digest differs")
    return headers, block


def read_archive(stream) -> Iterator[dict]:
    """Every record: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits)."""
    for m in members(stream):
        h, block = parse(m)
        kind = h.get("warc-type")
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and (b32sha1(block) != digest or len(block) != int(h["warc-x-payload-length"])):
            raise WarcError("payload digest differs")
        num = lambda k: int(h[k]) if k in h else None
        yield {"page_id": num("warc-x-page-id"), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": num("warc-x-refers-to-page-id"),
               "payload_bytes": num("warc-x-payload-length"), "payload_digest": digest, "payload": block if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of pages (page_id, url, html; other columns are
    ignored) below `folder`; returns the committed manifest (path, records).

    Payload: html in UTF-8, null as empty. Among equal payloads the smallest page
    id is the response (null ids come last; rows that repeat that id are
    responses too); the rest revisit it. With null ids only, all are responses."""
    spark = pages.sparkSession
    ship(spark)
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = src.select("page_id", F.sha2("html", 256).alias("k"))
    # Narrow rows only: pre-aggregated, then a join whose hot keys Spark can split.
    first = keys.groupBy("k").agg(F.min("page_id").alias("first_id"))
    again = keys.join(first, "k").where("page_id <> first_id or (page_id is null and first_id is not null)")
    again = again.select(F.col("page_id").alias("r_id"), F.col("k").alias("r_k"), "first_id").distinct()
    d = src.withColumn("k", F.sha2("html", 256))
    d = d.join(again, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("k") == F.col("r_k")), "left")
    d = d.select("page_id", "url", "html", "first_id")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n = None, None, 0, 0
        done: list[tuple[str, int]] = []
        for b in batches:
            for i, u, t, r in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None:
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_path(path, True)
                data = page_record(i, u, t.encode("utf-8", "surrogatepass"), r, level)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return cut(arrow_map(d, write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives in `manifest` (column path), each archive
    read front to back by one task."""
    ship(manifest.sparkSession)
    cols = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in cols])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with open_path(path) as f:
                    for r in read_archive(f):
                        rows.append({c: r[c] for c in cols})
                        size += len(r["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = ", ".join(f"{c} {'long' if kinds.get(c) == pa.int64() else 'binary' if c == 'payload' else 'string'}" for c in cols)
    paths = manifest.select("path")
    return arrow_map(paths.repartition(max(1, paths.count())), read, ddl)  # an archive a task


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write and read back, in the shared folder."""
    return read_archives(write_archives(pages, new_path(spark, "warc")), payloads=False)
