"""The whole match run: normalize, prune, score, assign, classify."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, matching
from ..sources import connectors
from ..sources.store import stash
from .config import DEFAULT, STATUSES, MatchConfig

log = logging.getLogger("matchloom")


def candidates(invoices: DataFrame, ledger: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """Normalized ledger rows that the date filter of normalized invoices keeps, with their positions among those."""
    return matching.number_rows(matching.filter_candidates(invoices, matching.normalize_ledger(ledger, config), config.max_days), "ledger_idx")


def counted(seen: Observation, name: str) -> int:
    """What a write has counted. A plan that the optimizer knows to be empty has no such count."""
    try:
        return seen.get.get(name, 0)
    except Py4JError:
        return 0


def prepare(invoices: DataFrame, ledger: DataFrame, config: MatchConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Normalized invoices and candidates with their positions, written once, since scores and details both read them.

    The writes count their rows as they go. Rows are dealt raw and parsed where they end up, since parsed fields would
    double what is shuffled.
    """
    n, m, kept = (Observation() for _ in range(3))
    count = F.count("*").alias("n")
    i = stash(matching.normalize_invoices(matching.number_rows(invoices, "invoice_idx"), config).observe(n, count), "invoices")
    log.info("preprocessed %d invoices", counted(n, "n"))
    near = matching.filter_candidates(i, ledger.observe(m, count), config.max_days, lambda rows: matching.normalize_ledger(rows, config))
    e = stash(matching.number_rows(near, "ledger_idx").observe(kept, count), "candidates")
    log.info("preprocessed %d ledger rows; the date window of %d days removed %d", counted(m, "n"), config.max_days, counted(m, "n") - counted(kept, "n"))
    return i, e


def finished(results: DataFrame) -> DataFrame:
    """Results, written once; their statuses are counted on the way and logged."""
    seen = Observation()
    out = stash(results.observe(seen, *matching.by_status()), "results")
    log.info("classification: %s", ", ".join(f"{s}={counted(seen, s)}" for s in STATUSES))
    return out


def match(invoices: DataFrame, ledger: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """Results of every batch of raw invoices and ledger rows (batch_id, ordinal and the raw fields)."""
    i, e = prepare(invoices, ledger, config)
    assigned = matching.assign_rows(i, e, config)
    return matching.match_details(assigned, i, e, config)


def match_mock(spark: SparkSession, invoices: Iterable | None = None, ledger: Iterable | None = None, config: MatchConfig = DEFAULT) -> DataFrame:
    """Rows in memory, the demo rows where none are given."""
    return match(connectors.mock_invoices(spark, invoices), connectors.mock_ledger(spark, ledger), config)


def invoices_of_blocks(blocks: DataFrame, config: MatchConfig = DEFAULT, batch_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(raw invoices of one batch, documents that failed) out of OCR blocks."""
    failed = blocks.where(F.col("_error").isNotNull()).select("doc_id", "_error") if "_error" in blocks.columns else None
    found = extraction.extract_invoices(extraction.reading_order(blocks, config), config)
    bad = found.where(F.col("_error").isNotNull()).select("doc_id", "_error")
    good = found.where(F.col("_error").isNull())
    # documents are ordered by name over all tasks; an ordinal has to grow, but may leave gaps
    numbered = good.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumns({"batch_id": F.lit(batch_id).cast("long"), "ordinal": F.monotonically_increasing_id()})
    return numbered.withColumnRenamed("doc_id", "_source_image").drop("_error"), bad if failed is None else failed.unionByName(bad)


def match_images(spark: SparkSession, paths: list[str], ledger: DataFrame, make_ocr: Callable[[], connectors.Ocr], config: MatchConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(results, failed documents) of images against a raw ledger."""
    invoices, failed = invoices_of_blocks(connectors.read_images(spark, paths, make_ocr), config)
    return match(invoices, ledger, config), failed
