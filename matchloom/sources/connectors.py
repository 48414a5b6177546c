"""Sources and sinks: JSON ledgers, rows in memory, images through an OCR plug-in; JSON and console results."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import BLOCKS, INVOICE, LEDGER
from .datasources import ITEM_END, register

log = logging.getLogger("matchloom")

# The demo rows (invoice_number, vendor_name, date, amount) and (reference, vendor, date, debit, credit).
MOCK_INVOICES = [
    ("INV-2024-001", "Himalayan Traders Pvt Ltd", "15/01/2024", "45000.00"),
    ("INV-2024-002", "Kathmandu Supplies Co", "20/01/2024", "12500.50"),
    ("INV-2024-003", "Nepal Electronics Ltd", "22/01/2024", "7800.00"),
    ("INV-2024-004", "Everest Goods Inc", "25/01/2024", "33200.00"),
]
MOCK_LEDGER = [
    ("INV-2024-001", "Himalayan Traders Pvt Ltd", "15/01/2024", "45000.00", None),
    ("INV2024002", "Ktm Supplies Company", "21/01/2024", "12500.50", None),
    ("INV-2024-003", "Nepal Electronics", "22/01/2024", "7750.00", None),
    ("REF-9999", "Random Vendor", "01/06/2024", "1.00", None),
]

#: An OCR engine: bytes of an image to [[corners, (text, confidence)] or None, ...], nested once more or not.
Ocr = Callable[[bytes], list]


def in_order(spark: SparkSession, rows: Iterable, schema: str, batch_id: int = 0) -> DataFrame:
    """Rows in memory as one batch, their order kept in ``ordinal``."""
    numbered = [(batch_id, k, *((r.get(f.split()[0]) for f in schema.split(", ")) if isinstance(r, dict) else r)) for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(v if v is None or i < 2 else str(v) for i, v in enumerate(r)) for r in numbered], f"batch_id long, ordinal long, {schema}")


def mock_invoices(spark: SparkSession, rows: Iterable | None = None) -> DataFrame:
    return in_order(spark, rows or MOCK_INVOICES, INVOICE)


def mock_ledger(spark: SparkSession, rows: Iterable | None = None) -> DataFrame:
    return in_order(spark, rows or MOCK_LEDGER, LEDGER)


def read_ledger(spark: SparkSession, path: str, batch_id: int = 0, lines: bool = False) -> DataFrame:
    """A JSON array (with ``lines``: JSON lines, which many tasks can read) of ledger rows as one batch, in the file's order."""
    rows = spark.read.schema(LEDGER).option("multiLine", not lines).json(path)
    return rows.select(F.lit(batch_id).cast("long").alias("batch_id"), F.monotonically_increasing_id().alias("ordinal"), "*")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of an array that ``json_array`` wrote, read by many tasks: each item ends in a brace behind two blanks, and no
    JSON text holds a bare line break, so that the file can be cut there. An item that can't be parsed is an error."""
    pieces = spark.read.option("lineSep", ITEM_END).text(path)
    body = F.regexp_replace("value", r"^[\[,]\n", "")  # in front of the first item a bracket, of others a comma
    items = pieces.select(body.alias("body")).where(~F.trim(F.regexp_replace("body", r"\n", "")).isin("", "]", "[]"))
    return items.select(F.from_json(F.concat("body", F.lit(ITEM_END)), schema, {"mode": "FAILFAST"}).alias("item")).select("item.*")


def is_item(x: object) -> bool:
    """Corners and (text, confidence)."""
    return isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[1], (list, tuple)) and len(x[1]) == 2 and isinstance(x[1][0], str)


def unnested(result: list | None) -> list:
    """The items of the first page, whether or not the engine nests pages."""
    if not result or any(map(is_item, result)):
        return result or []
    return result[0] or []


def default_ocr() -> Ocr:
    """The engine of the ``paddleocr`` package, where it is installed."""
    from paddleocr import PaddleOCR

    engine = PaddleOCR(use_angle_cls=True, lang="en")
    return lambda content: engine.ocr(content, cls=True)


def read_images(spark: SparkSession, paths: list[str], make_ocr: Callable[[], Ocr]) -> DataFrame:
    """Blocks of every image file; see ``blocks_of_images``."""
    return blocks_of_images(spark.read.format("binaryFile").load(paths).select("path", "content").repartition(max(1, len(paths))), make_ocr)


def blocks_of(path: str, content: Callable[[], bytes], ocr: Ocr) -> list[tuple]:
    """Rows of one image's blocks, or the one that tells why there are none."""
    try:
        out = []
        for pos, item in enumerate(unnested(ocr(content()))):
            if item is not None:
                box, (text, confidence) = item
                out.append((path, pos, text, [[float(v) for v in corner] for corner in box], float(confidence), None))
        return out
    except Exception as e:  # one bad image must not end the run
        return [(path, -1, None, None, None, f"{type(e).__name__}: {e}")]


def blocks_of_images(files: DataFrame, make_ocr: Callable[[], Ocr]) -> DataFrame:
    """Blocks of images (path, content); one that can't be read gives a row with _error instead, and the others go on.

    ``make_ocr`` builds the engine once in each Python worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr = make_ocr()
        for frame in frames:
            out = [row for path, content in zip(frame["path"], frame["content"], strict=True) for row in blocks_of(path, lambda content=content: bytes(content), ocr)]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "text", "bbox", "confidence", "_error"])

    return files.mapInPandas(run, f"{BLOCKS}, _error string")


def summary_json(results: DataFrame) -> DataFrame:
    """One JSON text a result, nulls included, without the positions."""
    return results.select(F.to_json(F.struct(*(c for c in results.columns if c not in {"batch_id", "invoice_idx", "ledger_idx"})), {"ignoreNullFields": "false"}).alias("value"))


def write_result_lines(results: DataFrame, path: str) -> None:
    """All fields of all results as JSON lines, in as many compressed files as tasks write them."""
    results.drop("batch_id").write.options(ignoreNullFields="false", compression="gzip").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """All fields of all results, in their order, as one JSON array that tasks write."""
    rows = results.drop("batch_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    register(results.sparkSession)
    rows.write.format("json_array").mode("overwrite").save(path)


def four_places(c: Column) -> Column:
    """c with four decimals, rounded by its binary value: the JVM's formatter rounds its shortest decimal text instead.

    The two differ only where that text ends in a half. There, twice the last place is compared exactly: c is split in
    two halves whose products with 20,000 need no rounding.
    """
    whole = F.rint(c * 20000)
    high = F.lit(134217729.0) * c - (F.lit(134217729.0) * c - c)
    off = (high * 20000 - whole) + (c - high) * 20000
    tie = (F.abs(whole % 2) == 1) & (F.abs(off) < 1e-6)
    even = F.when((whole - 1) % 4 == 0, whole - 1).otherwise(whole + 1)
    return F.format_string("%.4f", F.when(tie, F.when(off < 0, whole - 1).when(off > 0, whole + 1).otherwise(even) / 20000).otherwise(c))


def table_lines(results: DataFrame) -> DataFrame:
    """The four columns of the console table as text: batch_id, invoice_idx, invoice_id, ledger_ref, score, status."""
    return results.select(
        "batch_id", "invoice_idx", F.coalesce("invoice_id", F.lit("N/A")).alias("invoice_id"), F.coalesce("ledger_ref", F.lit("N/A")).alias("ledger_ref"),
        four_places(F.coalesce("score", F.lit(0.0))).alias("score"), F.coalesce("status", F.lit("N/A")).alias("status"),
    )


def console_table(results: DataFrame) -> Iterator[str]:
    """Lines of the console table; widths come from one aggregate, rows stream."""
    lines = table_lines(results).orderBy("batch_id", "invoice_idx")
    names, heads = ["invoice_id", "ledger_ref", "score", "status"], ["Invoice ID", "Ledger Ref", "Score", "Status"]
    longest = lines.agg(*(F.max(F.char_length(c)).alias(c) for c in names)).first()
    if longest[0] is None:
        yield "No results to display."
        return
    wide = [max(12, len(h), longest[c]) for h, c in zip(heads, names, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"

    def row(cells: list[str]) -> str:
        return "| " + " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)) + " |"

    yield from (rule, row(heads), rule)
    for r in lines.toLocalIterator():
        yield row([r[c] for c in names])
    yield rule


def get_logger(name: str, level: str = "INFO") -> logging.Logger:
    logging.basicConfig(level=level, format="%(asctime)s [%(levelname)s] %(name)s: %(message)s")
    out = logging.getLogger(name)
    out.setLevel(level)
    return out


