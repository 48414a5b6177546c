"""WARC archives of pages, written and read in chunks.

A page's payload (its html in UTF-8) leaves its row in chunks of at most ``CHUNK`` bytes, rows of a record's number and a
chunk's number; nothing behind that step holds a payload whole. Equal payloads (by SHA-256) meet in one exchange, that of
the largest page_id first: it becomes the response, and the others revisits, of which only the header is written. A payload
that more than a 2,048th of all pages share is known beforehand: only its response takes part in the exchange, its revisits
are written where they are.

The archives are WARC 1.1 files that Spark's own text writer makes: a row is a record's header and block, and the line
separator is the two line ends that close a record. A payload of several chunks is a segmented record: a response with
``WARC-Segment-Number: 1`` and ``continuation`` records behind it. They are read as text that is cut at every two line ends
and joined again by ``Content-Length``, so a payload may hold any line ends; a gzip file is never split, so a record's
segments come to one task in order. The table that comes out has a row for each chunk, with the bytes and the SHA-1 of the
payload up to there; a payload's last row has those of all of it, held against the header's.

Defined results: null html counts as empty; of equal payloads under ``min_bytes`` all are responses; of equal ones under one
page_id the least url (null first) is the response; a null page_id is less than any other and reads back as null, as
does what refers to it; an empty table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, stash, trimmed, utf8

#: Bytes of payload in a record.
CHUNK = 1 << 20
#: Bytes of rows that are handed on at once.
BATCH = 4 << 20
DATE = "1970-01-01T00:00:00Z"
# What the format is made of.
VERSION, END = "WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CUT = "key binary, digest string, size long, page_id long, url string, row long, chunk long, last boolean, data string"
READ = "record_id string, chunk long, last boolean, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def pieces_of(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes (four at least) that cut no character; one empty range for no bytes."""
    begin, n = 0, len(data)
    while True:
        end = min(begin + max(limit, 4), n)
        while end < n and data[end] & 0xC0 == 0x80:
            end -= 1
        yield begin, end
        begin = end
        if begin >= n:
            return


def cut(pages: DataFrame, payload: bool = True) -> DataFrame:
    """The chunks of each page's payload, with the payload's SHA-256 (key), SHA-1 (digest) and size; ``payload=False``: a row a page, without data."""

    schema = pa.schema([("key", pa.binary()), ("digest", pa.string()), ("size", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("row", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.string())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            data, offsets = utf8(batch.column("html"))
            held, weight = [], 0
            for page, url, a, b in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                whole = data[a:b]
                key, digest = hashlib.sha256(whole), hashlib.sha1(whole)
                for chunk, (i, j) in enumerate(pieces_of(whole, CHUNK) if payload else [(0, 0)]):
                    held.append((key.digest(), base32(digest.digest()), b - a, page, url, first + row, chunk, j == b - a, whole[i:j].tobytes().decode()))
                    weight += 200 + j - i
                    if weight >= BATCH:
                        yield made(held)
                        held, weight = [], 0
                row += 1
            if held:
                yield made(held)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(trimmed(run), CUT)


def record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    """A record without the line ends that close it."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines += [f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END


def address(url: str | None) -> str | None:
    """The url without anything that could end a header's line."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") or None


def name_of(*parts: object) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, ":".join(map(str, parts)))


def revisit(name: uuid.UUID, key: bytes, digest: str, size: int, page: int | None, url: str | None, of: int | None) -> bytes:
    return record(
        "revisit", name, http(size), WARC_Target_URI=address(url), WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:uuid:{name_of('response', key.hex())}>", WARC_Payload_Digest=f"sha1:{digest}",
        X_Page_ID=page, X_Refers_To_Page_ID=of, Content_Type="application/http;msgtype=response",
    )


def part_of(name: uuid.UUID, chunk: int, last: bool, data: bytes, digest: str, size: int, page: int | None, url: str | None) -> bytes:
    """The record of one chunk of a response."""
    if chunk == 0:
        return record(
            "response", name, http(size) + data, WARC_Target_URI=address(url), WARC_Payload_Digest=f"sha1:{digest}", WARC_Segment_Number=None if last else 1, X_Page_ID=page,
            Content_Type="application/http;msgtype=response",
        )
    return record("continuation", name_of(name, chunk), data, WARC_Segment_Number=chunk + 1, WARC_Segment_Origin_ID=f"<urn:uuid:{name}>", WARC_Segment_Total_Length=len(http(size)) + size if last else None)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as WARC files; equal payloads of at least ``min_bytes`` bytes are written once."""

    def texts(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for row in rows:
            held.append(row)
            weight += len(row)
            if weight >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], names=["value"])
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], names=["value"])

    def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[bytes]:
            known = response = number = top = None
            for key, digest, size, page, url, row, chunk, last, data in rows_of(batches, "key", "digest", "size", "page_id", "url", "row", "chunk", "last", "data"):
                if key != known or size < min_bytes and row != number:
                    known, number, top = key, row, page
                    response = name_of("response", key.hex()) if size >= min_bytes else name_of("response", key.hex(), row)
                if row == number:
                    yield part_of(response, chunk, last, data.encode(), digest, size, page, url)
                elif chunk == 0:
                    yield revisit(name_of("revisit", row), key, digest, size, page, url, top)

        yield from texts(out())

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from texts(revisit(name_of("revisit", row), key, digest, size, page, url, top) for key, digest, size, page, url, row, top in rows_of(batches, "key", "digest", "size", "page_id", "url", "row", "top"))

    bar = max(1000, pages.count() // HOT_KEYS)
    shared = cut(pages, payload=False).where(F.col("size") >= min_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    hot = stash(shared.where(F.col("n") > bar).select("key", "top"), "shared")  # at most HOT_KEYS of them
    chunks, written = cut(pages), None
    if not hot.isEmpty():
        met, answers = F.broadcast(hot), F.col("page_id").eqNullSafe(F.col("top"))
        written = cut(pages, payload=False).join(met, "key").where(~answers).select("key", "digest", "size", "page_id", "url", "row", "top").mapInArrow(trimmed(revisits), "value string")
        chunks = chunks.join(met.withColumn("_hot", F.lit(True)), "key", "left").where(F.col("_hot").isNull() | answers).drop("top", "_hot")
    order = ["key", F.col("page_id").desc_nulls_last(), "url", "row", "chunk"]
    rows = chunks.repartition("key").sortWithinPartitions(*order).mapInArrow(trimmed(records), "value string")
    (rows if written is None else rows.unionByName(written)).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class Reader:
    """Records of one archive, from its text cut at every two line ends."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.held: list[bytes] = []
        self.need = self.have = 0

    def take(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if self.fields is None:
            head = piece.lstrip(b"\r\n")
            if head:
                lines = head.decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record begins with {lines[0][:80]!r}")
                self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.need, self.have, self.held = int(self.fields["content-length"]), 0, []
                if not self.need:
                    yield from self.whole()
            return
        self.held += [piece, END]
        self.have += len(piece) + len(END)
        if self.have >= self.need:  # what lies behind the block is a part of the line ends that close it
            yield from self.whole()

    def whole(self) -> Iterator[tuple[dict[str, str], bytes]]:
        fields, self.fields = self.fields, None
        yield fields, b"".join(self.held)[: self.need]


def number(text: str | None) -> int | None:
    return None if text is None else int(text)


class Payloads:
    """Chunk rows from records in order, with the bytes and the digest of a payload so far."""

    def __init__(self) -> None:
        self.name, self.sha, self.size, self.fields = "", hashlib.sha1(), 0, {}

    def row(self, fields: dict[str, str], block: bytes) -> tuple:
        kind, name = fields["warc-type"], fields["warc-record-id"]
        page = number(self.fields.get("x-page-id") if kind == "continuation" else fields.get("x-page-id"))
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            size = int(re.search(rb"(?mi)^Content-Length: *(\d+)", block)[1])
            return name, 0, True, page, kind, number(fields.get("x-refers-to-page-id")), size, digest, None
        if kind == "response":
            self.name, self.sha, self.size, self.fields, chunk = name, hashlib.sha1(), 0, fields, 0
            block = block.partition(END)[2]
            last = "warc-segment-number" not in fields
        else:
            chunk, last = int(fields["warc-segment-number"]) - 1, "warc-segment-total-length" in fields
            if fields["warc-segment-origin-id"] != self.name:
                raise ValueError(f"{name} doesn't continue {self.name}")
            digest = self.fields["warc-payload-digest"].removeprefix("sha1:")
        self.sha.update(block)
        self.size += len(block)
        now = base32(self.sha.digest())
        if last and now != digest:
            raise ValueError(f"{self.name}: the payload's digest is {now}, not {digest}")
        return self.name, chunk, last, page, "response", None, self.size, now, block


def read_chunks(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The chunks of all archives under path; ``payload=False`` leaves the bytes themselves out."""

    schema = pa.schema([("record_id", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        *columns, payloads = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)), pa.array(payloads, pa.binary()).cast(pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, reader, payloads = None, Reader(), Payloads()
        for batch in batches:
            held, weight = [], 0
            for piece, file in zip(batch.column("value").cast(pa.binary()).to_pylist(), batch.column("file").to_pylist(), strict=True):
                if file != archive:
                    if reader.fields is not None:
                        raise ValueError(f"{archive} ends within a record")
                    archive, reader = file, Reader()
                for fields, block in reader.take(piece):
                    row = payloads.row(fields, block)
                    held.append(row if payload else (*row[:-1], None))
                    weight += 200 + (len(row[-1] or b"") if payload else 0)
                    if weight >= BATCH:
                        yield made(held)
                        held, weight = [], 0
            if held:
                yield made(held)
        if reader.fields is not None:
            raise ValueError(f"{archive} ends within a record")

    lines = spark.read.option("lineSep", END.decode()).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(trimmed(run), READ)


def digests(chunks: DataFrame) -> DataFrame:
    """A row for each page, from the last chunk of its record."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
