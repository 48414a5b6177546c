"""Spark data sources: blocks of images as a reader, one JSON array as a writer. ``register`` makes them known to a session.

    spark.read.format("ocr_blocks").option("engine", "module:function").load(["a.png", "b.png"])
    rows.write.format("json_array").mode("overwrite").save("results.json")

Files are opened where the tasks run, through Arrow's file systems, so that a path may name any store that those know.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans.schema import BLOCKS

#: Images that one task reads, where the option ``images`` names no other number; bytes that are copied at once.
IMAGES, PIECE = 16, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Images(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class BlocksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        named = options.get("paths") or options.get("path") or "[]"
        self.paths: list[str] = json.loads(named) if named.lstrip().startswith("[") else [named]
        self.engine, self.images = options["engine"], int(options.get("images", IMAGES))

    def partitions(self) -> list[Images]:
        return [Images(self.paths[k : k + self.images]) for k in range(0, len(self.paths), self.images)] or [Images([])]

    def read(self, partition: Images) -> Iterator[tuple]:
        from .connectors import blocks_of

        if not partition.paths:
            return
        module, _, name = self.engine.partition(":")
        ocr = getattr(importlib.import_module(module), name)()

        def content(path: str) -> bytes:
            store, at = opened(path)
            with store.open_input_stream(at) as file:
                return file.read()

        for path in partition.paths:
            yield from blocks_of(path, lambda path=path: content(path), ocr)


class OcrBlocks(DataSource):
    """Blocks of images, as ``connectors.blocks_of_images`` gives them; one that can't be read gives a row with _error."""

    @classmethod
    def name(cls) -> str:
        return "ocr_blocks"

    def schema(self) -> str:
        return f"{BLOCKS}, _error string"

    def reader(self, schema: StructType) -> BlocksReader:
        return BlocksReader(dict(self.options))


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


#: What an item of a written array ends with, and nothing else in it.
ITEM_END = "\n  }"


def indented(text: str) -> str:
    """An item of an array: a JSON text, two blanks to a level."""
    return json.dumps(json.loads(text), indent=2).replace("\n", "\n  ")


class ArrayWriter(DataSourceWriter):
    """Each task writes its items beside the file; the commit joins the parts in the order of tasks, a piece at a time."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        store, at = opened(f"{self.path}.part-{task.partitionId()}-{task.taskAttemptId()}")
        rows = 0
        with store.open_output_stream(at) as out:
            for row in iterator:
                out.write(f"{',' if rows else ''}\n  {indented(row[0])}".encode())
                rows += 1
        return Part(task.partitionId(), at, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = opened(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with store.open_output_stream(at) as out:
            out.write(b"[")
            empty = True
            for part in parts:
                if part.rows:
                    out.write(b"" if empty else b",")
                    empty = False
                    with store.open_input_stream(part.path) as held:
                        while piece := held.read(PIECE):
                            out.write(piece)
            out.write(b"]" if empty else b"\n]")
        self.abort(parts)

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = opened(self.path)
        for part in messages:
            if part is not None:
                store.delete_file(part.path)


class JsonArray(DataSource):
    """Rows of one column, each a JSON text, as one indented JSON array in one file."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (OcrBlocks, JsonArray):
        spark.dataSource.register(source)
