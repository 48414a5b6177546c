"""Relational operators of a match run: normalize, prune, score, assign, classify, summarize.

A run may hold many independent batches (batch_id); each is one assignment problem. Inputs have batch_id and an ordinal
that gives the order of rows within it; positions in results are dense and count from zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing, similarity, text
from ..plans.config import DEFAULT, STATUSES, MatchConfig
from ..plans.schema import ASSIGNED
from ..sources.store import stash
from .assignment import shapes, solve
from .joins import merged
from .large import PairIndex, PairTable, assign_large


def normalize_invoices(raw: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    return raw.withColumns(
        {
            "normalized_invoice_number": text.normalize_reference(F.col("invoice_number")),
            "normalized_vendor": text.normalize_vendor(F.col("vendor_name"), config.stopwords),
            "parsed_date": parsing.parse_date(F.col("date")),
            "parsed_amount": parsing.parse_amount(F.col("amount")),
        }
    )


def normalize_ledger(raw: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    return raw.withColumns(
        {
            "normalized_reference": text.normalize_reference(F.col("reference")),
            "normalized_vendor": text.normalize_vendor(F.col("vendor"), config.stopwords),
            "parsed_date": parsing.parse_date(F.col("date")),
            "debit_amount": parsing.parse_amount(F.col("debit")),
            "credit_amount": parsing.parse_amount(F.col("credit")),
        }
    )


def filter_candidates(invoices: DataFrame, ledger: DataFrame, max_days: int = DEFAULT.max_days, normalize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ledger rows with a date within max_days of any invoice of their batch, or without a date, or where no invoice has one.

    A raw ledger comes with ``normalize``, which parses its rows where they have met their batch, so that only raw fields are dealt.

    Days are dealt into bins one day wider than max_days: what is near enough to some day of a bin lies between its first
    and its last day, widened. So a batch's invoices shrink to one span for each bin that holds any, and the ledger is
    read once.
    """
    day = F.datediff(F.col("parsed_date"), F.lit("1970-01-01").cast("date"))
    bins = invoices.where(F.col("parsed_date").isNotNull()).groupBy("batch_id", F.floor(day / (max_days + 1)).alias("bin")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    spans = bins.groupBy("batch_id").agg(F.collect_list(F.struct((F.col("first") - max_days).alias("a"), (F.col("last") + max_days).alias("b"))).alias("_spans"))
    rows = merged(ledger, spans, "batch_id", "left")
    if normalize is not None:
        rows = normalize(rows)
    near = F.exists("_spans", lambda s: (s["a"] <= day) & (day <= s["b"]))
    return rows.where(day.isNull() | F.col("_spans").isNull() | near).drop("_spans")


#: Ordinals of a batch that are numbered by one task, as a power of two.
NUMBERED = 20
#: So many cuts at most meet their rows by broadcast.
FEW_CUTS = 100_000


def number_rows(rows: DataFrame, name: str) -> DataFrame:
    """Dense positions in each batch, by ordinal.

    A batch is cut by its ordinals, so that one of any size is numbered by many tasks: rows in a cut are numbered from
    zero, and begin where the counts of the cuts before it end. Those are counted first: as long as few batches have more
    than one cut, rows needn't be dealt once more to meet them.
    """
    (cut, at, before) = ("_cut", "_at", "_before")
    rows = rows.withColumn(cut, F.shiftright("ordinal", NUMBERED))
    sizes = rows.groupBy("batch_id", cut).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("batch_id").orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(before, F.sum("_n").over(ahead)).where(F.col(before).isNotNull()).select("batch_id", cut, before)
    placed = rows.withColumn(at, F.row_number().over(Window.partitionBy("batch_id", cut).orderBy("ordinal")) - 1)
    offsets = stash(offsets, "offsets")
    met = placed.join(F.broadcast(offsets), ["batch_id", cut], "left") if offsets.count() <= FEW_CUTS else merged(placed, offsets, ["batch_id", cut], "left")
    out = met.withColumn(name, (F.col(at) + F.coalesce(before, F.lit(0))).cast("long"))
    return out.select(*(c for c in out.columns if c not in (cut, at, before)))


#: Columns that a pair's score reads.
INVOICE_FIELDS = ("normalized_invoice_number", "normalized_vendor", "parsed_date", "parsed_amount")
LEDGER_FIELDS = ("normalized_reference", "normalized_vendor", "parsed_date", "debit_amount", "credit_amount")


def score_pairs(invoices: DataFrame, ledger: DataFrame, config: MatchConfig = DEFAULT, salts: int = 1, sizes: DataFrame | None = None, sized: bool = False) -> DataFrame:
    """Every pair of a batch with its score.

    A batch's invoices are dealt over ``salts`` tasks; with ``sizes`` (of ``batch_sizes``) over as many as its pairs need.
    ``sized``: pairs also have the sizes of their batch (_n, _m), which come along with its invoices.
    """
    along = ("_n", "_m") if sized else ()
    if sized:
        invoices = merged(invoices, sizes.select("batch_id", *along), "batch_id")
    more_i = [c for c in invoices.columns if c not in (*INVOICE_FIELDS, "batch_id", "invoice_idx", *along)] if config.extra_metrics else []
    more_e = [c for c in ledger.columns if c not in (*LEDGER_FIELDS, "batch_id", "ledger_idx")] if config.extra_metrics else []
    left = invoices.select("batch_id", "invoice_idx", *along, *(F.col(c).alias(f"i_{c}") for c in (*INVOICE_FIELDS, *more_i)))
    right = ledger.select("batch_id", "ledger_idx", *(F.col(c).alias(f"e_{c}") for c in (*LEDGER_FIELDS, *more_e)))
    keys, many = ["batch_id"], F.lit(salts)
    if sizes is not None:
        hot = sizes.where(F.col("_pairs") > config.task_pairs).select("batch_id", F.least("_n", F.ceil(F.col("_pairs") / config.task_pairs)).cast("int").alias("_salts"))
        if not hot.isEmpty():
            left, right = left.join(hot, "batch_id", "left"), right.join(hot, "batch_id", "left")
            many, salts = F.coalesce("_salts", F.lit(1)), 2
    if salts > 1:
        left = left.withColumn("_salt", F.pmod("invoice_idx", many).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
        keys = ["batch_id", "_salt"]
    invoice = {c: F.col(f"i_{c}") for c in (*INVOICE_FIELDS, *more_i)}
    entry = {c: F.col(f"e_{c}") for c in (*LEDGER_FIELDS, *more_e)}
    return merged(left.drop("_salts"), right.drop("_salts"), keys).select("batch_id", "invoice_idx", "ledger_idx", *along, similarity.compute_similarity(invoice, entry, config).alias("score"))


def batch_sizes(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of either side and pairs of each batch: batch_id, _n, _m, _pairs."""
    n = invoices.groupBy("batch_id").agg(F.count("*").alias("_n"))
    return merged(n, ledger.groupBy("batch_id").agg(F.count("*").alias("_m")), "batch_id").select("batch_id", "_n", "_m", (F.col("_n") * F.col("_m")).alias("_pairs"))


def assign(scores: DataFrame, config: MatchConfig = DEFAULT, sizes: DataFrame | None = None) -> DataFrame:
    """The one-to-one assignment of greatest total score in each batch.

    A batch is dense in memory only up to ``dense_pairs``; a larger one never reaches a task whole (``large``). ``sizes``
    (of ``batch_sizes``) spares counting the pairs.
    """
    sized = shapes(scores).withColumn("_pairs", F.col("_n") * F.col("_m")) if sizes is None else sizes
    large = sized.where(F.col("_pairs") > config.dense_pairs)
    if large.isEmpty():
        return assign_dense(scores)
    rest = scores.join(large.select("batch_id"), "batch_id", "left_anti")
    return assign_dense(rest).unionByName(assign_large(PairTable(scores.join(large.select("batch_id"), "batch_id", "left_semi"), large)))


def assign_dense(scores: DataFrame) -> DataFrame:
    """``assign`` for batches that a task can hold: they stream through sorted partitions and are solved one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            if held[0]["batch_id"].iloc[0] == frame["batch_id"].iloc[-1]:
                continue  # still one batch
            whole = pd.concat(held)
            last = whole["batch_id"].iloc[-1]
            yield solve(whole[whole["batch_id"] != last])
            held = [whole[whole["batch_id"] == last]]
        if held:
            yield solve(pd.concat(held))

    return scores.repartition("batch_id").sortWithinPartitions("batch_id", "invoice_idx", "ledger_idx").mapInPandas(run, ASSIGNED)


def assign_rows(invoices: DataFrame, ledger: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """``assign`` from the rows themselves: only the pairs of batches within ``dense_pairs`` are all scored."""
    sizes = batch_sizes(invoices, ledger)
    most = sizes.agg(F.max("_pairs")).first()[0] or 0
    if most <= config.dense_pairs:
        return assign_dense(score_pairs(invoices, ledger, config, sizes=sizes if most > config.task_pairs else None))
    large, kept = sizes.where(F.col("_pairs") > config.dense_pairs), sizes.where(F.col("_pairs") <= config.dense_pairs)
    i, e = (merged(df, kept.select("batch_id"), "batch_id", "left_semi") for df in (invoices, ledger))
    return assign_dense(score_pairs(i, e, config, sizes=kept)).unionByName(assign_large(index_of(invoices, ledger, large, config)))


def index_of(invoices: DataFrame, ledger: DataFrame, sizes: DataFrame, config: MatchConfig = DEFAULT) -> PairIndex:
    """The pairs of the batches of ``sizes``, to be found by days and amounts."""
    fields = lambda df, own, idx: df if config.extra_metrics else df.select("batch_id", idx, *own)
    sizes = stash(sizes, "sizes")
    rows = (fields(invoices, INVOICE_FIELDS, "invoice_idx"), fields(ledger, LEDGER_FIELDS, "ledger_idx"))
    return PairIndex(*(merged(df, sizes.select("batch_id"), "batch_id", "left_semi") for df in rows), sizes, config)


def match_details(assigned: DataFrame, invoices: DataFrame, ledger: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """Assigned pairs with ids, status and the fields that were compared."""
    i = invoices.select(
        "batch_id", "invoice_idx", "invoice_number", F.col("normalized_invoice_number"), F.col("normalized_vendor").alias("i_vendor"), F.col("parsed_date").alias("i_date"), "parsed_amount"
    )
    e = ledger.select("batch_id", "ledger_idx", "reference", "normalized_reference", F.col("normalized_vendor").alias("e_vendor"), F.col("parsed_date").alias("e_date"), "debit_amount")
    pairs = i.join(assigned, ["batch_id", "invoice_idx"], "left" if config.include_unassigned else "inner").join(e, ["batch_id", "ledger_idx"], "left" if config.include_unassigned else "inner")

    def named(c: str, prefix: str, idx: str):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.concat(F.lit(prefix), F.col(idx)))

    def dated(c: str):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("None"))

    detail = F.struct(
        F.col("normalized_invoice_number").alias("invoice_number_norm"), F.col("normalized_reference").alias("ledger_ref_norm"), F.col("i_vendor").alias("invoice_vendor"), F.col("e_vendor").alias("ledger_vendor"),
        dated("i_date").alias("invoice_date"), dated("e_date").alias("ledger_date"), F.col("parsed_amount").alias("invoice_amount"), F.col("debit_amount").alias("ledger_debit"),
    )
    return pairs.select(
        "batch_id", "invoice_idx", "ledger_idx", named("invoice_number", "inv_", "invoice_idx").alias("invoice_id"), named("reference", "led_", "ledger_idx").alias("ledger_ref"),
        F.round("score", 6).alias("score"), similarity.classify(F.col("score"), config).alias("status"), detail.alias("detail"),
    )


def by_status() -> list[F.Column]:
    """How many rows have each status."""
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def status_summary(results: DataFrame) -> DataFrame:
    """Rows of each status, those without any included."""
    counts = results.agg(*by_status())
    return counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES))).alias("x")).select("x.status", "x.n")
