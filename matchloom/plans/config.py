"""Settings of a match run, and the registry of field metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

# The weights, thresholds, tolerances and words that results are defined by.
WEIGHTS = {"invoice_number": 0.40, "vendor": 0.25, "date": 0.20, "amount": 0.15}
AUTO_MATCH, REVIEW = 0.90, 0.70
STATUSES = ("auto_match", "review", "unmatched")
DATE_TOLERANCE_DAYS = 3
AMOUNT_TOLERANCE = 0.01
AMOUNT_DECAY = 10.0
PREFIX_SCALE, PREFIX_CAP = 0.1, 4
MAX_DAYS = 60
ROW_TOLERANCE = 15.0
MIN_CONFIDENCE = 0.3
VENDOR_STOPWORDS = ("pvt", "ltd", "limited", "private", "inc", "incorporated", "llc", "co", "company", "corp", "corporation", "and", "the")
HEADER_KEYWORDS = ("reference", "ref", "date", "debit", "credit", "amount", "description", "narration")

#: (invoice columns, ledger columns) -> similarity in [0, 1]
Metric = Callable[[dict[str, Column], dict[str, Column]], Column]


@dataclass(frozen=True)
class MatchConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    auto_match: float = AUTO_MATCH
    review: float = REVIEW
    date_tolerance_days: int = DATE_TOLERANCE_DAYS
    amount_tolerance: float = AMOUNT_TOLERANCE
    amount_decay: float = AMOUNT_DECAY
    prefix_scale: float = PREFIX_SCALE
    prefix_cap: int = PREFIX_CAP
    max_days: int = MAX_DAYS
    row_tolerance: float = ROW_TOLERANCE
    min_confidence: float = MIN_CONFIDENCE
    stopwords: tuple[str, ...] = VENDOR_STOPWORDS
    #: Also return invoices that got no ledger row (off: one row for each assigned pair).
    include_unassigned: bool = False
    #: Send a document whose amount carries its currency behind it to the errors, as the original pipeline loses it.
    strict_compat: bool = False
    #: Pairs of one batch that one task may hold as a dense matrix; larger batches are solved from few pairs of each row.
    dense_pairs: int = 4_000_000
    #: Pairs of one batch that one task scores; a batch of more is dealt over several.
    task_pairs: int = 1_000_000
    #: Further metrics by name; a name needs a weight.
    extra_metrics: dict[str, Metric] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1.0) >= 1e-9:
            raise ValueError("weights must sum to 1")


DEFAULT = MatchConfig()
