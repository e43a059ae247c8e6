"""Web archives: writing WARC files and reading them back one record after another.

An archive is a series of gzip members, one per record.  A reader goes through
it from front to back: bytes are decompressed bit by bit, the record's header
says with Content-Length how much content follows, and the digest of the payload is
checked.  Records are HTTP responses; a payload that an earlier record has is
written as a ``revisit`` without the payload, which refers to that record.

Files are opened through the Arrow file system of the shared folder's address, on the
executors that write or read them.  Every attempt of a writing task has file
names of its own, and readers only open files that a finished attempt reported.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from brooklet.llm.common import land, partitions, pick

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

URN = "urn:page:"  # record ids: this and the page's id, with the characters escaped that a header or an address cannot hold
NO_PAGE = "urn:nopage:"  # a null id

BLOCK = 1 << 18  # bytes read and decompressed at once
ROWS = 500
READ_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("record_offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("verified", pa.bool_()), ("payload", pa.binary()),
    ]
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], content: bytes) -> bytes:
    """One record as a gzip member."""
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in [*headers, ("Content-Length", str(len(content)))])
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(VERSION + b"\r\n" + lines + b"\r\n" + content + b"\r\n\r\n") + member.flush()


def page_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>")]
    if uri:
        headers.append(("WARC-Target-URI", " ".join(uri.split())))
    headers += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", HTTP_TYPE)]
    if refers_to is None:
        return record_bytes(headers, http + payload)
    return record_bytes([*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")], http)


def members(stream, size: int = BLOCK) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, decompressed pieces) of each gzip member of ``stream``; a member that breaks off raises ValueError."""
    rest, offset = stream.read(size), 0
    while rest:
        inflate, used = zlib.decompressobj(31), 0

        def pieces() -> Iterator[bytes]:
            nonlocal rest, used
            while True:
                used += len(rest)
                piece = inflate.decompress(rest, size)
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                used -= len(rest)
                yield piece
                if inflate.eof:
                    return
                rest = rest or stream.read(size)
                if not rest and not inflate.unconsumed_tail:
                    raise ValueError(f"the record at {offset} breaks off")

        found = pieces()
        yield offset, found
        for _ in found:  # what the caller did not read
            pass
        offset += used
        rest = rest or stream.read(size)


class _Framed:
    """Lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes], offset: int) -> None:
        self.pieces, self.offset, self.held = pieces, offset, bytearray()

    def more(self) -> None:
        piece = next(self.pieces, None)
        if piece is None:
            raise ValueError(f"the record at {self.offset} is shorter than it says")
        self.held += piece

    def line(self) -> bytes:
        while (end := self.held.find(b"\r\n")) < 0:
            self.more()
        line = bytes(self.held[:end])
        del self.held[: end + 2]
        return line

    def headers(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            self.more()
        taken = bytes(self.held[:size])
        del self.held[:size]
        return taken


def records(stream) -> Iterator[dict]:
    """The records of an archive, in order; each has been framed by its length and checked against its digest."""
    for offset, pieces in members(stream):
        framed = _Framed(pieces, offset)
        if framed.line() != VERSION:
            raise ValueError(f"no record at {offset}")
        headers = framed.headers()
        content = framed.take(int(headers["content-length"]))
        if framed.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} is longer than it says")
        payload, declared = content, len(content)
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = content.partition(b"\r\n\r\n")
            http = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
            declared = int(http.get(b"content-length", len(payload)))
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        full = headers["warc-type"] != "revisit"
        yield {
            "record_offset": offset,
            "record_id": headers["warc-record-id"].strip("<>"),
            "record_type": headers["warc-type"],
            "target_uri": headers.get("warc-target-uri"),
            "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
            "payload_bytes": declared,
            "payload_digest": digest,
            "verified": len(payload) == declared and payload_digest(payload) == digest if full else None,
            "payload": payload if full else None,
        }


def _write(folder: str, file_bytes: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        attempt, files, out, size, n, name = uuid.uuid4().hex, [], None, 0, 0, ""
        for batch in batches:
            for record_id, url, refers_to, html in zip(*batch.columns):
                if out is None:
                    name = f"pages-{attempt}-{len(files):05}.warc.gz"
                    out, size, n = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                payload = html.as_py().encode()
                data = page_record(record_id.as_py(), url.as_py(), payload, payload_digest(payload), refers_to.as_py())
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    files.append({"path": f"{folder}/{name}", "size": size, "n_records": n})
                    out = None
        if out is not None:
            out.close()
            files.append({"path": f"{folder}/{name}", "size": size, "n_records": n})
        yield pa.RecordBatch.from_pylist(files, pa.schema([("path", pa.string()), ("size", pa.int64()), ("n_records", pa.int64())]))

    return emit


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with system.open_input_stream(place, compression=None) as stream:
                for record in records(stream):
                    rows.append({"path": path, **record})
                    held += len(record["payload"] or b"")
                    if len(rows) >= ROWS or held >= 16 * BLOCK:
                        yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)


def read_warc(archives: DataFrame) -> DataFrame:
    """All records of the files in ``archives`` (path).

    A file is read from front to back by one task, in memory for one record;
    files are dealt out evenly.  A damaged file fails the read; ``verified`` is
    false where a payload differs from its digest, null for revisits, which
    have no payload.
    """
    # A stated number: adaptive execution would put the short rows, and with them all files, into one task.
    spread = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return spread.mapInArrow(_read, from_arrow_schema(READ_SCHEMA))


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = 64 << 20
) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; the result lists the files: path, size, n_records.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest page_id is a response, the others are revisits; smaller ones are
    all responses.  A null html is an empty payload, a null url is left out, a
    null page_id comes after all others; ids may be numbers or any texts.  Rows equal in id and payload are all
    responses or all revisits.  Other columns are not looked at.  An empty table
    writes no file.
    """
    rows = pick(pages, page_id=page_id, url=url, html=html).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("html", 256)), "n_bytes": F.octet_length("html")})
    firsts = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Joined on another form of the key, both sides are shuffled, and Spark splits the tasks of common payloads.
    firsts = firsts.filter("n > 1").select(F.hex("digest").alias("key"), "first")
    rows = rows.join(firsts, F.hex("digest") == F.col("key"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(_urn(F.col("page_id")).alias("record_id"), "url", F.when(again, _urn(F.col("first"))).alias("refers_to"), "html")
    return land(rows.mapInArrow(_write(folder, file_bytes), "path string, size long, n_records long"))


def _urn(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit(URN), F.url_encode(page_id.cast("string"))), F.lit(NO_PAGE))


def page_of(record_id: str, kind: str = "bigint") -> Column:
    """The page_id, of type ``kind``, in a record id; null if it has none."""
    own = F.col(record_id).startswith(URN)
    return F.when(own, F.url_decode(F.substring(F.col(record_id), len(URN) + 1, 1 << 20))).cast(kind)
