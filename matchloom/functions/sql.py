"""The engine's scalar functions and its assignment, for SQL text: ``register(spark)`` makes them known to a session.

    SELECT vendor_similarity(a, b) FROM pairs
    SELECT * FROM assign_batch(TABLE(SELECT batch_id, invoice_idx, ledger_idx, score FROM scores) PARTITION BY batch_id ORDER BY (invoice_idx, ledger_idx))

Scalar functions are SQL functions whose bodies Catalyst puts in place of the call, so they cost what the columns cost.
``assign_batch`` is a table function: a partition is one batch, and its rows come in the order that the call names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.assignment import solve_one
from ..plans.config import DEFAULT, MatchConfig
from ..plans.schema import ASSIGNED
from .similarity import jaro_values


def bodies(config: MatchConfig = DEFAULT) -> dict[str, tuple[str, str, str]]:
    """(parameters, result, body) of each function."""
    stop = ", ".join(f"'{w}'" for w in config.stopwords)
    shared = " ".join(f"WHEN char_length(a) >= {k} AND char_length(b) >= {k} AND left(a, {k}) = left(b, {k}) THEN {k}" for k in range(config.prefix_cap, 0, -1))
    return {
        "plain_string": ("t STRING", "STRING", r"trim(regexp_replace(regexp_replace(lower(coalesce(t, '')), r'(?U)[^a-z0-9\s]', ''), r'(?U)\s+', ' '))"),
        "plain_reference": ("t STRING", "STRING", "regexp_replace(upper(coalesce(t, '')), '[^A-Z0-9]', '')"),
        "plain_vendor": ("t STRING", "STRING", f"array_join(filter(split(plain_string(t), ' '), w -> w NOT IN ({stop})), ' ')"),
        "plain_amount": ("t STRING", "DOUBLE", r"try_cast(regexp_replace(regexp_replace(t, '[^0-9.]', ''), r'\.(?=.*\.)', '') AS DOUBLE)"),
        "reference_similarity": ("a STRING, b STRING", "DOUBLE", "CASE WHEN a = '' AND b = '' THEN 1D WHEN a = '' OR b = '' THEN 0D ELSE 1D - levenshtein(a, b) / greatest(char_length(a), char_length(b)) END"),
        "vendor_similarity": ("a STRING, b STRING", "DOUBLE", f"CASE WHEN a = '' AND b = '' THEN 1D WHEN a = '' OR b = '' THEN 0D ELSE jaro(a, b) + (CASE {shared} ELSE 0 END) * {config.prefix_scale}D * (1D - jaro(a, b)) END"),
        "day_similarity": (
            "a DATE, b DATE", "DOUBLE",
            f"CASE WHEN a IS NULL AND b IS NULL THEN 0.5D WHEN a IS NULL OR b IS NULL THEN 0D WHEN a = b THEN 1D WHEN abs(datediff(a, b)) <= {config.date_tolerance_days} THEN 1D - abs(datediff(a, b)) / {2.0 * config.date_tolerance_days}D ELSE 0D END",
        ),
        "amount_similarity": (
            "a DOUBLE, b DOUBLE", "DOUBLE",
            f"CASE WHEN a IS NULL AND b IS NULL THEN 0.5D WHEN a IS NULL OR b IS NULL THEN 0D WHEN a = 0 AND b = 0 THEN 1D WHEN a = 0 OR b = 0 THEN 0D WHEN abs(a - b) / greatest(abs(a), abs(b)) <= {config.amount_tolerance}D THEN 1D ELSE exp(-{config.amount_decay}D * (abs(a - b) / greatest(abs(a), abs(b)))) END",
        ),
        "match_status": ("score DOUBLE", "STRING", f"CASE WHEN score >= {config.auto_match}D THEN 'auto_match' WHEN score >= {config.review}D THEN 'review' ELSE 'unmatched' END"),
    }


@udtf(returnType=ASSIGNED)
class AssignBatch:
    """The assignment of one batch (batch_id, invoice_idx, ledger_idx, score of all its pairs, in order), which has to fit into a task."""

    def __init__(self) -> None:
        self.batch: int | None = None
        self.rows: tuple[array, array, array] = (array("q"), array("q"), array("d"))
        self.at: list[int] | None = None

    def eval(self, row: Row) -> None:
        if self.at is None:
            self.batch, self.at = row["batch_id"], [row.__fields__.index(c) for c in ("invoice_idx", "ledger_idx", "score")]
        values = tuple(row)
        for held, k in zip(self.rows, self.at, strict=True):
            held.append(float("nan") if values[k] is None else values[k])

    def terminate(self) -> Iterator[tuple]:
        if self.at is not None:
            found = solve_one(*(np.array(x) for x in self.rows))
            yield from ((self.batch, *x) for x in zip(*(x.tolist() for x in found), strict=True))


def register(spark: SparkSession, config: MatchConfig = DEFAULT) -> None:
    """Make the functions known to the session, as temporary ones."""
    from pyspark.sql.functions import pandas_udf

    spark.udf.register("jaro", pandas_udf(lambda a, b: pd.Series(jaro_values(a, b)), "double"))
    for name, (parameters, result, body) in bodies(config).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("assign_batch", AssignBatch)
