"""Streams: rows are normalized as they come; each micro-batch of invoices is matched against a static ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import matching
from ..plans.config import DEFAULT, MatchConfig
from ..plans.pipeline import match


def normalize_stream(invoices: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """Stateless: the stream with its normalized columns."""
    return matching.normalize_invoices(invoices, config)


def match_stream(invoices: DataFrame, ledger: DataFrame, sink: Callable[[DataFrame, int], None], config: MatchConfig = DEFAULT) -> DataStreamWriter:
    """Assignment is global within a batch, so each micro-batch is a run of its own; ``sink`` gets (results, epoch)."""
    return invoices.writeStream.foreachBatch(lambda rows, epoch: sink(match(rows, ledger, config), epoch))
