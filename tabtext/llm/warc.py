"""WARC archives of pages: writer and sequential reader (operator 3).

Writer: every page becomes one WARC/1.1 record in a gzip member of its own.  Among pages with
equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is a ``response`` record and
the others are ``revisit`` records that name it (HTTP headers only, no payload).  Tasks write rolling
archives into the shared folder; the list of archives is a written table, so archives of lost or repeated tasks are
never read.

Reader: a task streams an archive from front to back, decompresses member by member, frames each record by its
``Content-Length`` and checks the framing, the block digest and, for responses, the payload digest while the bytes pass.
It holds one read buffer, and the payload only if asked to.

Defined cases: a null page counts as the empty payload; a null url gives no target header; line ends and blanks in
a url are percent-encoded, and a url may be of any length; repeated rows each get a record, and all rows that share the smallest id are responses; pages
with a null id are revisits of the smallest id of their payload, and responses where no page with that payload has an
id; further columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, in_tasks, written
from .files import opened, read_stream, shared_folder

MIN_BYTES = 0
#: An archive is closed when it holds this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
ID_URN = "urn:page:"
BUFFER = 1 << 16
#: Groups of equal payloads up to this many rows are broadcast (60 bytes each).
MAX_BROADCAST_GROUPS = 500_000


class WarcError(ValueError):
    """A record that breaks the format or fails a digest."""


def b32sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<{ID_URN}{'null' if page_id is None else page_id}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """The bytes of one record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{b32sha1(payload)}", f"WARC-Block-Digest: sha1:{b32sha1(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """Decompressed bytes of a stream of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.plain = stream, b"", None, b""

    def next_member(self) -> bool:
        """Go to the next member; the one before must be used up."""
        if self.z is not None and (self.fill() or self.plain):
            raise WarcError("bytes after the end of a record")
        if not self.raw:
            self.raw = self.stream.read(BUFFER)
        if not self.raw:
            return False
        self.z, self.plain = zlib.decompressobj(31), b""
        return True

    def fill(self) -> bool:
        """Decompress a little more of the member; false at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.raw or self.stream.read(BUFFER)
            if not data:
                raise WarcError("an archive ends inside a record")
            self.raw = b""
            try:
                more = self.z.decompress(data, BUFFER)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            if self.z.eof:
                self.raw = self.z.unused_data
            if more:
                self.plain += more
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, however many; the member ends without it: an error."""
        held = bytearray(self.plain)
        seen = 0
        while (at := held.find(mark, max(0, seen - len(mark)))) < 0:
            seen, self.plain = len(held), b""
            if not self.fill():
                raise WarcError("a record has no end of headers")
            held += self.plain
        self.plain = bytes(held[at + len(mark):])
        return bytes(held[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.fill():
                raise WarcError("a record is shorter than its Content-Length")
            part, self.plain = self.plain[:n], self.plain[n:]
            n -= len(part)
            yield part


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive, in order, each verified."""
    m = Members(stream)
    while m.next_member():
        first, *lines = m.until(b"\r\n\r\n").decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError("a member doesn't start with a WARC header")
        head = _headers(lines)
        block, payload, http, kept = hashlib.sha1(), hashlib.sha1(), b"", []
        in_http = True
        for part in m.exactly(int(head["content-length"])):
            block.update(part)
            if in_http:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, part, in_http = http[:at], http[at + 4:], False
            payload.update(part)
            if with_payload:
                kept.append(part)
        if b"".join(m.exactly(4)) != b"\r\n\r\n":
            raise WarcError("a record isn't followed by two line ends")
        named = head["warc-payload-digest"].removeprefix("sha1:")
        b32 = lambda h: base64.b32encode(h.digest()).decode()
        if b32(block) != head["warc-block-digest"].removeprefix("sha1:"):
            raise WarcError(f"block digest of {head['warc-record-id']}")
        kind = head["warc-type"]
        if kind == "response" and b32(payload) != named:
            raise WarcError(f"payload digest of {head['warc-record-id']}")
        yield {"id": _id(head["warc-record-id"]), "url": head.get("warc-target-uri"), "type": kind, "digest": named,
               "bytes": int(_headers(http.decode().split("\r\n")[1:])["content-length"]),
               "refers_to": _id(head["warc-refers-to"]) if "warc-refers-to" in head else None,
               "payload": b"".join(kept) if with_payload else None}


def _id(urn: str) -> int | None:
    v = urn.strip("<>").removeprefix(ID_URN)
    return None if v == "null" else int(v)


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of ``page_id, url, html``; the written list of them: ``uri, records, bytes``."""
    folder = shared_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         body.alias("payload"), F.when(F.length(body) >= min_bytes, F.unhex(F.sha1(body))).alias("key"))
    ids = written(keyed.select("page_id", "key"), "warc-keys")
    groups = written(ids.filter("key is not null").groupBy("key")
                     .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "warc-groups")
    if groups.count() <= MAX_BROADCAST_GROUPS:
        rows = keyed.join(F.broadcast(groups), "key", "left")
    else:
        rows = attach(keyed, groups, "key", "rows", ids.count())
    rows = rows.select("page_id", "url", "payload", "first_id")

    def task(batches):
        out, uri, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first_id"))):
                page_id, first = page_id.as_py(), first.as_py()
                if out is None:
                    uri = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    store, path = opened(uri)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, n, size = store.open_output_stream(path, compression=None), 0, 0
                data = member(record(page_id, url.as_py(), payload.as_py(), first, first is not None and first != page_id))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield _listed(uri, n, size)
        if out is not None:
            out.close()
            yield _listed(uri, n, size)

    return written(in_tasks(rows, task, "uri string, records long, bytes long"), "warc-archives")


def _listed(uri: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the listed archives (``uri``): ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to`` (and ``payload``; null for a revisit)."""
    names = SCHEMA.names if with_payload else SCHEMA.names[:-1]

    def task(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                with read_stream(uri) as stream:
                    for r in read_records(stream, with_payload):
                        body = r["payload"] if r["type"] == "response" else None
                        rows.append((r["id"], r["url"], r["bytes"], r["digest"], r["type"], r["refers_to"], body))
                        held += len(body or b"")
                        if len(rows) == 4096 or held > 16 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    files = max(1, archives.count())
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + ", payload binary" * with_payload)
    return in_tasks(archives.select("uri").repartition(files), task, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, SCHEMA.field(n).type) for n, c in zip(names, zip(*rows))], names=names)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads the archives back."""
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
