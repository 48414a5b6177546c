"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import shared_dir, stash, unstash

__all__ = ["shared_dir", "stash", "unstash"]


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to differ from all taken ones."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def own(docs: DataFrame, *but: str) -> list[F.Column]:
    """The columns of docs, whatever their names hold, without those named."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in but]


def small_side(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """df, stashed; marked for broadcast if it has at most ``limit`` (narrow) rows, else left to a shuffled join."""
    kept = stash(df, "side")
    return F.broadcast(kept) if kept.count() <= limit else kept


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` bytes each (one row at least, however long)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: One key may hold this share of all rows before it meets its partner by broadcast, so that there are at most as many of those.
HOT_KEYS = 2048


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """left joined with right (stashed, a row for each key, column ``n``: how many rows of left it meets; n is dropped).

    A key with many of left's ``rows`` would make one task of all of them: such keys, ``HOT_KEYS`` at most, are broadcast.
    All others meet by a merge join at any size: nothing that grows with the input is broadcast because it is still small.
    """
    bar = max(1000, rows // HOT_KEYS)
    hot, rest = right.where(F.col("n") > bar).drop("n"), right.where(F.col("n") <= bar).drop("n")
    if hot.isEmpty():
        return left.join(rest.hint("merge"), on)
    rare = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rare.join(rest.hint("merge"), on).unionByName(left.join(F.broadcast(hot), on))


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within this, rows go to Python workers by Arrow batches that end where they reach ``size`` bytes."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def trimmed(run: Callable) -> Callable:
    """run, for mapInArrow: memory comes from the system's allocator and goes back to it after each task."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trim()

    return out


def map_rows(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(trimmed(run), schema)`` for columns of any names, also such that hold a dot."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(trimmed(renamed), schema)


def trim() -> None:
    """Give freed memory back to the system, which the allocators of a reused Python worker otherwise keep."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def lower_table() -> bytes:
    """A-Z to a-z, every other byte as it is."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
