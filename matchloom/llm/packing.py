"""Packing: concatenate and cut.

Pass one writes, for each document, its ids and where they start in its partition. Prefix sums over the partitions'
totals turn that into a global offset. Pass two cuts the stream of all ids into windows of ``length`` and returns one
boundary record for each piece of a document in a window; only the last window can hold padding.

Defined results: null text is an empty text (one end id); repeated rows are packed each for itself; an empty table gives
no rows; other columns are ignored. The order of documents in the stream is that of the input's partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitpack import text_runs, with_end
from .common import small_side, stash, trimmed
from .tokens import encoder

LENGTH = 1024


def tokenized(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """A stashed table: doc_id, ids (little-endian unsigned 16- or 32-bit), n, part, start (ids before it in the part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), 0
        for rows, texts in text_runs(batches):
            ids, counts = with_end(*encoder(vocabulary_path).encode(texts), end_id)
            stops = np.cumsum(counts)
            wide = ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
            data = wide.tobytes()
            at = np.concatenate(([0], stops)) * wide.itemsize
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id").cast(pa.int64()),
                    "ids": pa.array([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                    "n": pa.array(counts, pa.int64()),
                    "part": pa.array([part] * len(texts), pa.int32()),
                    "start": pa.array(base + stops - counts, pa.int64()),
                }
            )
            base += int(stops[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stash(rows.mapInArrow(trimmed(run), "doc_id long, ids binary, n long, part int, start long"), "ids")


def pack_sequences(ids: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of ``tokenized`` documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_tokens."""
    totals = ids.groupBy("part").agg(F.sum("n").alias("n"))
    bases = totals.select("part", (F.expr("sum(n) OVER (ORDER BY part)") - F.col("n")).alias("base"))
    placed = ids.join(small_side(bases), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("start")).alias("at"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = batch.column("at").to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(at[row], seq * length)
            stop = np.minimum((at + n)[row], (seq + 1) * length)
            start = begin - at[row]
            crc, r0, wide = np.zeros(len(row), np.int64), -1, b""
            column = batch.column("ids")
            for k, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), (stop - at[row]).tolist(), strict=True)):
                if r != r0:
                    raw = column[r].as_py()
                    r0, wide = r, np.frombuffer(raw, f"<u{len(raw) // int(n[r])}").astype("<u4").tobytes()
                crc[k] = zlib.crc32(wide[4 * a : 4 * b])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(stop - begin), "ids_crc32": pa.array(crc),
                    "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(seq), "offset": pa.array(begin - seq * length),
                }
            )

    return placed.mapInArrow(trimmed(run), schema)
