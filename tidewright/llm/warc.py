"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

An archive is a sequence of gzip members, one record each (plain records are read as well). The reader checks each record:
the member's own checksum, the version line, the length, the blank lines behind the block, the payload's digest. After a
failed check it looks for the next member or version line that starts a valid record, goes on there, and logs the bytes in
between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import remember, shared_dir, small_join, written

MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archive segments are closed beyond so many bytes.
SEGMENT = 4_000_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header with the payload's length, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = (url or "urn:x-unknown").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + page_urn(page_id).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if revisit:
        head += [b"WARC-Refers-To: " + page_urn(refers_to).encode(), b"WARC-Profile: " + PROFILE.encode()]
    return b"\r\n".join(head) + END + block + END


def member(data: bytes) -> bytes:
    return gzip.compress(data, 3, mtime=0)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]

    @property
    def payload_bytes(self) -> int:
        if self.headers["warc-type"] != "revisit":
            return len(self.payload)
        for line in self.block.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                return int(line.partition(b":")[2])
        raise ValueError("a revisit without the payload's length")


def parse(data: bytes, offset: int, exact: bool) -> tuple[Record, int]:
    """The record at the start of ``data`` and its length; ValueError if a check fails. exact: nothing may follow."""
    if not data.startswith(VERSION):
        raise ValueError("no version line")
    cut = data.find(END)
    if cut < 0:
        raise ValueError("no end of the headers")
    headers: dict[str, str] = {}
    for line in data[:cut].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise ValueError("a header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogateescape")
    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
        raise ValueError("no type or length")
    size = int(headers["content-length"])
    end = cut + 4 + size
    if data[end : end + 4] != END:
        raise ValueError("the block does not end where it should")
    if exact and len(data) != end + 4:
        raise ValueError("bytes behind the record")
    r = Record(headers, data[cut + 4 : end], offset)
    want = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and want.startswith("sha1:") and want[5:] != digest(r.payload):
        raise ValueError("wrong payload digest")
    if headers["warc-type"] == "revisit":
        r.payload_bytes  # noqa: B018  the check is that it can be read
    return r, end + 4


@dataclass
class SalvageReader:
    """Iterates over the valid records of an archive; ``gaps``: (offset, length, reason) of what was left out."""

    data: bytes
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def _at(self, pos: int) -> tuple[Record, int]:
        if self.data.startswith(MAGIC, pos):
            d = zlib.decompressobj(31)
            parts, at = [], pos
            try:
                while not d.eof and at < len(self.data):  # in pieces: what follows the member isn't copied
                    piece = self.data[at : at + 65536]
                    parts.append(d.decompress(piece))
                    at += len(piece)
            except zlib.error as e:
                raise ValueError(f"bad member: {e}") from None
            if not d.eof:
                raise ValueError("cut member")
            r, _ = parse(b"".join(parts), pos, exact=True)
            return r, at - len(d.unused_data)
        if self.data.startswith(VERSION, pos):
            cut = self.data.find(END, pos)
            size = 0
            for line in self.data[pos : cut if cut > 0 else pos].split(b"\r\n"):
                if line.lower().startswith(b"content-length:") and line.partition(b":")[2].strip().isdigit():
                    size = int(line.partition(b":")[2])
            r, n = parse(self.data[pos : cut + 8 + size] if cut > 0 else b"", pos, exact=False)
            return r, pos + n
        raise ValueError("neither a member nor a version line")

    def _next(self, pos: int) -> int:
        found = [x for x in (self.data.find(MAGIC, pos), self.data.find(VERSION, pos)) if x >= 0]
        return min(found, default=len(self.data))

    def __iter__(self) -> Iterator[Record]:
        pos, bad, reason = 0, -1, ""
        while pos < len(self.data):
            try:
                r, end = self._at(pos)
            except ValueError as e:
                if bad < 0:
                    bad, reason = pos, str(e)
                pos = self._next(pos + 1)
                continue
            if bad >= 0:
                self.gaps.append((bad, pos - bad, reason))
                bad = -1
            yield r
            pos = end
        if bad >= 0:
            self.gaps.append((bad, len(self.data) - bad, reason))


def write_archives(pages: DataFrame, folder: str, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(path, records, bytes) of the archives that hold the pages, gzip files of about ``segment`` bytes in ``folder``, which all
    executors share. Of records whose payloads are equal and at least ``least`` bytes long, the one with the smallest page_id
    is the response, the others revisit it; shorter ones are all responses.

    Null html is an empty payload. Rows that repeat a page_id and its payload are all what that page is; a null page_id is
    a response only where its group has no other. Files that a lost or repeated task left are in no row.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    p = pages.select("page_id", "url", html.alias("_payload"))
    keyed = p.withColumn("_sha", F.unhex(F.sha2("_payload", 256)))
    many = keyed.filter(F.length("_payload") >= least).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    many = written(many.select("_sha", "_first"), "warc-groups")
    all_ = small_join(keyed, many, "_sha", "left").select("page_id", "url", "_payload", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        task, n, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal n, parts, size
            path = f"{base}/{task:06d}-{n:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
            with store.open_output_stream(path, compression=None) as f:
                for x in parts:
                    f.write(x)
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(parts)], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
            n, parts, size = n + 1, [], 0
            return out

        for b in batches:
            for page_id, url, payload, first in zip(*(b.column(i) for i in range(4)), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                revisit = first is not None and page_id != first
                parts.append(member(record(page_id, url.as_py(), payload.as_py(), first, revisit)))
                size += len(parts[-1])
                if size >= segment:
                    yield close()
        if parts:
            yield close()

    return all_.mapInArrow(run, "path string, records long, bytes long")


def _page(urn: str | None) -> int | None:
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record (kind 'record') and per quarantined gap (kind 'gap': gap_offset, gap_length, reason) of the archives
    named in column path, in file order. Archives are read where they lie, one at a time in a task; an empty one has no rows."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap_offset", pa.int64()), ("gap_length", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    reader = SalvageReader(f.readall())
                rows = []
                for r in reader:
                    h = r.headers
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    bare = digest(r.payload) if h["warc-type"] == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((path, "record", _page(h.get("warc-record-id")), r.payload_bytes, bare, h["warc-type"], _page(h.get("warc-refers-to")) if h["warc-type"] == "revisit" else None, None, None, None))
                rows += [(path, "gap", None, None, None, None, None, *g) for g in reader.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return archives.select("path").mapInArrow(run, ddl)


def salvaged(archives: DataFrame, folder: str) -> DataFrame:
    """read_archives, read once and kept; its gaps are logged, and left in the result."""
    back = written(read_archives(archives, folder), "warc-back")
    gaps = back.filter("kind = 'gap'")
    total, length = gaps.agg(F.count(F.lit(1)), F.sum("gap_length")).first()
    if total:
        some = "; ".join(f"{r.path} {r.gap_offset}+{r.gap_length}: {r.reason}" for r in gaps.orderBy("path", "gap_offset").limit(20).collect())
        logging.getLogger(__name__).warning("%d gaps of %d bytes quarantined, the first: %s", total, length, some)
    return back


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """The pages written as archives in the shared folder and read back. The archives stay; a page that doesn't come back is an
    error, never a missing row."""
    folder = remember(f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    archives = written(write_archives(pages, folder, least), "warc-manifest")
    back = salvaged(archives, folder).filter("kind = 'record'")
    put, got = archives.agg(F.sum("records")).first()[0] or 0, back.count()
    if put != got:
        raise RuntimeError(f"{put} records were written, {got} read back; the gaps are in the log")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
