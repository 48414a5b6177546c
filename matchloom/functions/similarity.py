"""Similarities of two fields, as column expressions; Jaro's matching is an Arrow function over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.config import DEFAULT, MatchConfig


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _by_emptiness(a: Column, b: Column, value: Column) -> Column:
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(value)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return _by_emptiness(a, b, 1.0 - levenshtein_distance(a, b) / longest)


def _codes(s: pd.Series, wide: int) -> np.ndarray:
    return np.array(s.to_list(), dtype=f"U{max(wide, 1)}").view(np.uint32).reshape(len(s), -1)


def jaro_values(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro similarity of each pair: a character of a takes the first unused equal one of b within the window."""
    n_a, n_b = a.str.len().to_numpy(np.int64), b.str.len().to_numpy(np.int64)
    same = (a == b).to_numpy(bool)
    out = np.where(same, 1.0, 0.0)
    rows = np.flatnonzero(~same & (n_a > 0) & (n_b > 0))
    # pairs of like lengths go together, so that one long string doesn't widen all
    rows = rows[np.argsort(np.maximum(n_a, n_b)[rows], kind="stable")]
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        la, lb = n_a[part], n_b[part]
        x, y = _codes(a.iloc[part], int(la.max())), _codes(b.iloc[part], int(lb.max()))
        window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        free = np.arange(y.shape[1]) < lb[:, None]
        places = np.arange(y.shape[1])
        hit = np.zeros(x.shape, bool)
        for i in range(x.shape[1]):
            fits = free & (y == x[:, i, None]) & (np.abs(places - i) <= window[:, None]) & (i < la)[:, None]
            first = fits.argmax(axis=1)
            found = fits[np.arange(len(part)), first]
            hit[:, i] = found
            free[np.flatnonzero(found), first[found]] = False
        used = ~free & (places < lb[:, None])
        m = hit.sum(axis=1)
        # the k-th match of a against the k-th used character of b
        row_a, col_a = np.nonzero(hit)
        row_b, col_b = np.nonzero(used)
        swapped = np.bincount(row_a[x[row_a, col_a] != y[row_b, col_b]], minlength=len(part))
        with np.errstate(invalid="ignore", divide="ignore"):
            value = (m / la + m / lb + (m - swapped / 2) / m) / 3.0
        out[part] = np.where(m > 0, value, 0.0)
    return out


@F.pandas_udf(DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch once: vendors are few, and of a batch's pairs most come again."""
    (x, left), (y, right) = (pd.factorize(s) for s in (a, b))
    pairs, which = np.unique(x * len(right) + y, return_inverse=True)
    return pd.Series(jaro_values(pd.Series(left[pairs // len(right)]), pd.Series(right[pairs % len(right)]))[which]) if len(a) else pd.Series(dtype="float64")


def jaro_similarity(a: Column, b: Column) -> Column:
    return _jaro(a, b)


def jaro_winkler(a: Column, b: Column, config: MatchConfig = DEFAULT) -> Column:
    """Jaro raised by the common prefix, however low it is."""
    shared = None
    for k in range(config.prefix_cap, 0, -1):
        whole = (F.char_length(a) >= k) & (F.char_length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        shared = F.when(whole, k) if shared is None else shared.when(whole, k)
    shared = shared.otherwise(0)
    j = jaro_similarity(a, b)
    return _by_emptiness(a, b, j + shared * F.lit(config.prefix_scale) * (1.0 - j))


def _by_absence(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), 0.5).when(a.isNull() | b.isNull(), 0.0).otherwise(value)


def date_similarity(a: Column, b: Column, config: MatchConfig = DEFAULT) -> Column:
    days = F.abs(F.datediff(a, b))
    tolerance = config.date_tolerance_days
    return _by_absence(a, b, F.when(days == 0, 1.0).when(days <= tolerance, 1.0 - days / F.lit(2.0 * tolerance)).otherwise(0.0))


def amount_similarity(a: Column, b: Column, config: MatchConfig = DEFAULT) -> Column:
    relative = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))
    close = F.when(relative <= F.lit(config.amount_tolerance), 1.0).otherwise(F.exp(F.lit(-config.amount_decay) * relative))
    return _by_absence(a, b, F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(close))


def ledger_amount(debit: Column, credit: Column) -> Column:
    """The debit unless it is null or zero, else the credit."""
    return F.when(debit != 0, debit).otherwise(credit)


def field_metrics(config: MatchConfig = DEFAULT) -> dict:
    """The metric of each weighted field; ``config.extra_metrics`` adds to them."""
    return {
        "invoice_number": lambda i, e: levenshtein_similarity(i["normalized_invoice_number"], e["normalized_reference"]),
        "vendor": lambda i, e: jaro_winkler(i["normalized_vendor"], e["normalized_vendor"], config),
        "date": lambda i, e: date_similarity(i["parsed_date"], e["parsed_date"], config),
        "amount": lambda i, e: amount_similarity(i["parsed_amount"], ledger_amount(e["debit_amount"], e["credit_amount"]), config),
    } | config.extra_metrics


def compute_similarity(invoice: dict[str, Column], entry: dict[str, Column], config: MatchConfig = DEFAULT) -> Column:
    """The weighted sum of all fields' similarities, in the order of the weights."""
    metrics = field_metrics(config)
    total = None
    for name, weight in config.weights.items():
        term = F.lit(float(weight)) * metrics[name](invoice, entry)
        total = term if total is None else total + term
    return total


def classify(score: Column, config: MatchConfig = DEFAULT) -> Column:
    return F.when(score >= config.auto_match, "auto_match").when(score >= config.review, "review").otherwise("unmatched")
