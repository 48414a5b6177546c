"""Joins whose sides grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merged(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """The join of both by a merge: a side that is narrow and compresses well looks small enough for a broadcast long
    after its rows have outgrown the driver."""
    return left.join(right.hint("merge"), on, how)
