"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader takes compressed bytes in chunks, inflates one member after the other, frames each record by its
content length, and checks that the record fills its member and that block and payload digests hold. It keeps a
chunk and the record's headers (of bounded size) in memory, never a whole record or archive.

Pages with equal payloads (by SHA-1 and size) are stored once, at the largest page_id; the others are revisit records
that carry headers only. Archives lie in the folder that driver and executors share; a task's archives take their
names when complete, and only those that a finished task has reported are read.

Defined results: a null payload is an empty one; rows that repeat a page_id have a record each; a null page_id counts
as the smallest; a null url is left out. A record that breaks the format or a digest raises WarcError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.llm.common import arrow_rows, scratch, written

CHUNK = 1 << 18

#: Most bytes of a record's headers, and of the HTTP headers in its block.
MAX_HEADERS = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that isn't well formed or whose digest doesn't hold."""


def sha1_name(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


# -- writing


def record(kind: str, record_id: str, url: str | None, date: str, payload: bytes, size: int, digest: str, refers: str | None) -> bytes:
    """One record as a gzip member. A revisit's block holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=-._~"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    head += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_name(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return zipped.compress(raw) + zipped.flush()


# -- reading


@dataclass
class Record:
    headers: dict[str, str]
    offset: int  # of its member in the archive
    block_bytes: int = 0
    payload_bytes: int = 0  # in this record
    payload_digest: str = ""  # of the payload in this record
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None  # if asked for

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


class WarcReader:
    """Iterates over an archive's records in order. ``stream`` is anything with ``read(n)``."""

    def __init__(self, stream: BinaryIO, keep_payload: bool = False, chunk: int = CHUNK):
        self.stream, self.keep_payload, self.chunk = stream, keep_payload, chunk
        self.at = 0  # compressed bytes consumed by finished members
        self.raw = b""  # compressed bytes read ahead

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
            if not self.raw:
                return
            yield self._member()

    def _inflated(self, start: int) -> Iterator[bytes]:
        """The member's bytes in bounded pieces; what follows it is left for the next one."""
        inflate, taken, data = zlib.decompressobj(31), 0, self.raw
        while True:
            try:
                out = inflate.decompress(data, self.chunk)
            except zlib.error as e:
                raise WarcError(f"member at {start}: {e}") from e
            if out:
                yield out
            if inflate.eof:
                self.raw = inflate.unused_data
                self.at = start + taken + len(self.raw_taken) - len(self.raw)
                return
            data = inflate.unconsumed_tail
            if not data:
                taken += len(self.raw_taken)
                data = self.raw_taken = self.stream.read(self.chunk)
                if not data:
                    raise WarcError(f"member at {start} is cut off")

    def _member(self) -> Record:
        start = self.at
        self.raw_taken = self.raw
        pieces = self._inflated(start)
        held = b""

        def until(mark: bytes) -> bytes:
            nonlocal held
            while (k := held.find(mark)) < 0:
                if len(held) > MAX_HEADERS:
                    raise WarcError(f"member at {start} has headers without end")
                more = next(pieces, None)
                if more is None:
                    raise WarcError(f"member at {start} ends inside headers")
                held += more
            found, held = held[:k], held[k + len(mark) :]
            return found

        version, _, rest = until(b"\r\n\r\n").decode("utf-8").partition("\r\n")
        if not re.fullmatch(r"WARC/\d+\.\d+", version):
            raise WarcError(f"member at {start} starts with {version[:20]!r}")
        found = Record(_fields(rest), start)
        try:
            length = int(found.headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError(f"member at {start} has no content length") from None
        block_hash, payload_hash, payload = hashlib.sha1(), hashlib.sha1(), []
        is_http = found.headers.get("content-type", "").startswith("application/http")
        left, header, in_header = length, b"", is_http
        while left:
            if not held:
                held = next(pieces, b"")
                if not held:
                    raise WarcError(f"member at {start} is shorter than its content length")
            part, held = held[:left], held[left:]
            left -= len(part)
            block_hash.update(part)
            if in_header:
                header += part
                k = header.find(b"\r\n\r\n")
                if k < 0:
                    if len(header) > MAX_HEADERS:
                        raise WarcError(f"record at {start} has HTTP headers without end")
                    continue
                part, in_header = header[k + 4 :], False
                found.http = _fields(header[:k].decode("latin-1").partition("\r\n")[2])
            payload_hash.update(part)
            found.payload_bytes += len(part)
            if self.keep_payload:
                payload.append(part)
        tail = held
        while len(tail) <= 4 and (more := next(pieces, b"")):
            tail += more
        if tail != b"\r\n\r\n":
            raise WarcError(f"record at {start} doesn't end with its member")
        found.block_bytes, found.payload_digest = length, sha1_name(payload_hash.digest())
        found.payload = b"".join(payload) if self.keep_payload else None
        _check(found, "warc-block-digest", sha1_name(block_hash.digest()))
        if found.kind != "revisit":
            _check(found, "warc-payload-digest", found.payload_digest)
        return found


def _fields(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _check(found: Record, name: str, digest: str) -> None:
    said = found.headers.get(name)
    if said is not None and said != f"sha1:{digest}":
        raise WarcError(f"record at {found.offset}: {name} is {said}, its bytes have sha1:{digest}")


# -- tables


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, is_copy, refers_to: which pages become revisits of which."""
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).alias("size")
    )
    large = keyed.filter(F.col("size") >= min_revisit_bytes)
    copies = large.groupBy("sha", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    # only payloads with copies, which the planner then knows the size of: small ones are broadcast, others joined
    copies = written(copies.filter(F.col("n") > 1).select("sha", "size", "top"), "copies")
    is_copy = F.coalesce(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    return keyed.join(copies, ["sha", "size"], "left").select(
        "page_id", "url", "html", is_copy.alias("is_copy"), F.when(is_copy, F.col("top")).alias("refers_to")
    )


def _name(page_id: int | None) -> str:
    return f"urn:pages:{'none' if page_id is None else page_id}"


def write_archives(
    records: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = 64 << 20
) -> DataFrame:
    """Write planned records as archives below ``folder``; returns the table of finished archives (archive, records)."""
    arrow_rows(records.sparkSession)
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, made, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{top}/{made}.part", f"{top}/{made}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{made}"]), pa.array([n], pa.int64())], schema.names)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    made, size, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{made}.part", compression=None)
                payload = (row["html"] or "").encode("utf-8")
                digest = sha1_name(hashlib.sha1(payload).digest())
                refers = _name(row["refers_to"]) if row["is_copy"] else None
                kind = "revisit" if row["is_copy"] else "response"
                member = record(kind, _name(row["page_id"]), row["url"], date, payload, len(payload), digest, refers)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(records.mapInArrow(run, schema), "archives")


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("archive_offset", T.LongType()),
    ]
)


def read_archives(archives: DataFrame) -> DataFrame:
    """Each record of the archives: what it says of its page, its full payload's size and digest, and where it lies."""
    arrow_rows(archives.sparkSession)
    n = max(1, archives.count())

    def page(name: str | None) -> int | None:
        tail = (name or "").strip("<>").rpartition(":")[2]
        return None if tail in ("", "none") else int(tail)

    def rows(path: str) -> Iterator[tuple]:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_stream(place, compression=None) as stream:
            for r in WarcReader(stream):
                full = r.kind != "revisit"
                size = r.payload_bytes if full else int(r.http["content-length"])
                digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
                yield page(r.headers["warc-record-id"]), size, digest, r.kind, page(r.headers.get("warc-refers-to")), path, r.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 4096:
                        yield _batch(held, types)
                        held = []
                if held:
                    yield _batch(held, types)

    # an archive a task
    return archives.select("archive").repartition(min(n, 100_000)).mapInArrow(run, READ)


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], READ.names)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, min_revisit_bytes), folder))
