"""Token-ID output: fixed-width bit packing with block offsets.

A *shard image* is self-contained: a header, the ids of the documents in it, the offsets of documents and blocks, and the
payload, where every id takes the fewest bits that hold the vocabulary. Ids are packed in blocks of ``BLOCK`` ids; a block
starts on a byte, so that any block can be unpacked by numpy alone, without those before it.

Defined results: null text is an empty text (one end id); null doc_id comes first; rows with equal doc_id keep an order
by text; an empty table gives no images; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, small_side, stash, trimmed, utf8
from .tokens import encoder

MAGIC = b"MLP1"
BLOCK = 4096
HEADER = struct.Struct("<4sBxxxIqq")
IMAGE_IDS = 1 << 20
TEXT_BYTES = 1 << 19


def width(vocabulary: int) -> int:
    """Fewest bits for ids 0 .. vocabulary-1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a stream of ``bits``-bit little-endian fields."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    field = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(field.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    field = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (field.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The bytes of one shard."""
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        HEADER.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids)),
        known.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes(),
        np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<i8").tobytes(),
    ]
    return b"".join(parts + blocks)


class Reader:
    """Random access to a shard image."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard image")
        at = HEADER.size
        known = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        found = np.frombuffer(data, "<i8", self.n_docs, at)
        self.doc_ids = [int(d) if k else None for d, k in zip(found, known, strict=True)]
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<i8", n_blocks + 1, at)
        self.payload = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1 of the shard; touches only the blocks that hold them."""
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], self.bits, n))
        if not out:
            return np.zeros(0, np.uint32)
        first = start - start % self.block
        return np.concatenate(out)[start - first : stop - first]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def text_runs(batches: Iterator[pa.RecordBatch], limit: int = TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes together (one row at least); only they become strings."""
    for batch in batches:
        for i, j in slices(utf8(batch.column("text"))[1], limit):
            part = batch.slice(i, j - i)
            yield part, ["" if t is None else t for t in part.column("text").to_pylist()]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def write_shards(docs: DataFrame, vocabulary_path: str, vocabulary: int, end_id: int) -> DataFrame:
    """Encode every text, in ascending doc_id order, into a stashed table (shard, part, n_docs, n_ids, image).

    One exchange, by ranges of doc_id; a range is cut by rows, so that a hot key can't grow a task. Images are bounded
    by ``IMAGE_IDS`` ids (or one document).
    """
    bits = width(vocabulary)
    schema = "shard int, part int, n_docs long, n_ids long, image binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths, held, total = [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": [len(names)], "n_ids": [len(ids)], "image": pa.array([image(names, n, ids, bits)], pa.binary())}
            )

        for rows, texts in text_runs(batches):
            ids, counts = with_end(*encoder(vocabulary_path).encode(texts), end_id)
            names += rows.column("doc_id").to_pylist()
            lengths.append(counts)
            held.append(ids)
            total += len(ids)
            if total >= IMAGE_IDS:
                yield flush()
                names, lengths, held, total, part = [], [], [], 0, part + 1
        if names:
            yield flush()

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(trimmed(run), schema), "packed")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the images: doc_id, start (ids before it in all), n_tokens, ids_crc32."""
    totals = shards.groupBy("shard", "part").agg(F.sum("n_ids").alias("n"))
    by_shard = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    before = by_shard.select("shard", (F.expr("sum(n) OVER (ORDER BY shard)") - F.col("n")).alias("shard_base"))
    within = totals.select("shard", "part", (F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part)") - F.col("n")).alias("part_base"))
    bases = within.join(before, "shard").select("shard", "part", (F.col("shard_base") + F.col("part_base")).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("image"), strict=True):
                r = Reader(data.as_py())
                crc = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in range(r.n_docs)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(r.doc_ids, pa.int64()), "start": pa.array(r.starts[:-1] + base), "n_tokens": pa.array(np.diff(r.starts)), "ids_crc32": pa.array(crc, pa.int64())}
                )

    return shards.select("shard", "part", "image").join(small_side(bases), ["shard", "part"]).select("base", "image").mapInArrow(trimmed(run), schema)
