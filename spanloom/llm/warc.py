"""WARC archives: writer with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader inflates step by step, frames records by
``Content-Length``, starts a new member where one ends, and holds every block and payload against its
digest; only one record is in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches
from spanloom.runtime import fresh_path, written

# Fixed values of the public WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"
#: Compressed bytes of an archive; a partition writes as many as it needs.
ARCHIVE = 64 << 20
#: Repeated payloads (some 80 bytes each) that are sent to all tasks at most.
REPEATED = 1 << 18
_READ = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode(), b""]
    return _CRLF.join(lines) + _CRLF + block + _CRLF * 2


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _one_line(s: str) -> str:
    """Header values stay on their line."""
    return " ".join((s or "").split())


def response(key: str, url: str, payload: bytes, digest: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")], block)


def revisit(key: str, url: str, size: int, digest: str, first: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    return record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")], block)


# -- reading --------------------------------------------------------------------------------------


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str]
    payload: bytes
    offset: int  # of its gzip member


class BadArchive(ValueError):
    pass


class _Inflater:
    """Plain bytes of gzip members, one member after another."""

    def __init__(self, f: BinaryIO):
        self.f, self.raw, self.at, self.z, self.plain = f, b"", 0, None, bytearray()

    def _more(self) -> bool:
        """Inflate some more of the current member; False at its end."""
        if self.z is None or self.z.eof:
            return False
        if not self.raw:
            self.raw = self.f.read(_READ)
            if not self.raw:
                raise BadArchive(f"the archive ends within a record at {self.at}")
        had = len(self.raw)
        self.plain += self.z.decompress(self.raw)
        self.raw = self.z.unused_data if self.z.eof else b""
        self.at += had - len(self.raw)
        return True

    def open(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.f.read(_READ)
        if not self.raw:
            return False
        self.z, self.plain = zlib.decompressobj(31), bytearray()
        return True

    def upto(self, mark: bytes) -> bytes:
        seen = 0
        while (k := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark) + 1)
            if not self._more():
                raise BadArchive(f"no end of headers at {self.at}")
        out = bytes(self.plain[: k + len(mark)])
        del self.plain[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise BadArchive(f"a block is shorter than its Content-Length at {self.at}")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def close(self) -> bytes:
        while self._more():
            pass
        return bytes(self.plain)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def read_records(f: BinaryIO) -> Iterator[Record]:
    """Records of an archive in order. Raises BadArchive where framing or a digest is wrong."""
    z = _Inflater(f)
    while True:
        offset = z.at
        if not z.open():
            return
        head = z.upto(_CRLF * 2).split(_CRLF)
        if not head[0].startswith(b"WARC/"):
            raise BadArchive(f"no WARC record at {offset}")
        headers = _fields(head[1:])
        block = z.take(int(headers.get("content-length", "0")))
        if z.close() != _CRLF * 2:
            raise BadArchive(f"the record at {offset} isn't closed")
        if (d := headers.get("warc-block-digest")) and d != f"sha1:{sha1_base32(block)}":
            raise BadArchive(f"block digest differs at {offset}")
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(_CRLF * 2)
            http = _fields(top.split(_CRLF)[1:])
        if headers.get("warc-type") == "response" and (d := headers.get("warc-payload-digest")) and d != f"sha1:{sha1_base32(payload)}":
            raise BadArchive(f"payload digest differs at {offset}")
        yield Record(headers, block, http, payload, offset)


# -- Spark ----------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, *, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key, url, body, size, and ``first``: the smallest id of an equal payload that occurs more than once.

    Equal payloads are those of one SHA-1, one 64-bit hash and one length. Only these and the ids are
    counted, with partial aggregation. The repeated ones go to all tasks if they are few, which is
    counted first; the pages then stay where they are. Beyond ``REPEATED``, the pages are dealt by them.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), body.alias("body"))
    digests = [F.sha1("body").alias("sha"), F.xxhash64("body").alias("hash"), F.length("body").cast("long").alias("size")]
    light = rows.select("key", *digests).where(F.col("size") >= min_revisit_bytes)
    first = light.groupBy("sha", "hash", "size").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(spark, first, "warc-repeated")
    few = first.limit(REPEATED + 1).count() <= REPEATED
    return rows.select("*", *digests).join(F.broadcast(first) if few else first, ["sha", "hash", "size"], "left").drop("sha", "hash")


def write_archives(pages: DataFrame, target: str, *, min_revisit_bytes: int = 0, level: int = 6, archive: int = ARCHIVE, **cols) -> DataFrame:
    """Write a record for each row; the manifest of the archives (path, records, bytes).

    Rows of one id and one payload are all written; the first of them is the response where the id
    is the smallest of its payload (repeated rows: each of them is). Null html counts as empty, a
    null id is written as ``null`` and is never the smallest.
    """
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0
        for b in batches:
            for key, url, body, first in zip(*columns(b, "key", "url", "body", "first"), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest = sha1_base32(body)
                k = "null" if key is None else str(key)
                data = member(response(k, url, body, digest) if first is None or first == key else revisit(k, url, len(body), digest, str(first)), level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive:
                    out.close()
                    out = None
                    yield batch_of(schema, path=[f"{target}/{name}"], n_records=[n], n_bytes=[size])
        if out is not None:
            out.close()
            yield batch_of(schema, path=[f"{target}/{name}"], n_records=[n], n_bytes=[size])

    planned = plan_records(pages, min_revisit_bytes=min_revisit_bytes, **cols)
    return written(pages.sparkSession, map_batches(planned.select("key", "url", "body", "first"), run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, path, offset of every record."""
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def key_of(uri: str | None) -> int | None:
        k = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(k) if k.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in columns(b, "path")[0]:
                fs, name = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with fs.open_input_stream(name, compression=None) as f:
                    for r in read_records(f):
                        kind = r.headers["warc-type"]
                        size = len(r.payload) if kind == "response" else int(r.http.get("content-length", "0"))
                        rows.append((key_of(r.headers.get("warc-record-id")), size, r.headers["warc-payload-digest"].removeprefix("sha1:"), kind, key_of(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri"), r.offset))
                        if len(rows) >= 5000:
                            yield batch_of(schema, **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
                            rows = []
                if rows:
                    yield batch_of(schema, **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return map_batches(manifest.select("path").repartition(n, "path"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, offset long")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc"), **options))
