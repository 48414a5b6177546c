"""The linear sum assignment problem: a certificate on grouped maxima, and shortest augmenting paths over all pairs or over few.

Batches that no task can hold are in ``large``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stash
from .joins import merged


def shapes(scores: DataFrame) -> DataFrame:
    """batch_id, _n, _m: rows and columns of each batch's matrix."""
    return scores.groupBy("batch_id").agg((F.max("invoice_idx") + 1).alias("_n"), (F.max("ledger_idx") + 1).alias("_m"))


#: A pair by its place on the batch's shorter side (by) and on the longer one (other); flip: ledger rows are the shorter side.
BEST = "batch_id long, flip boolean, by long, other long, score double"


def best_of_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first of the best pairs of each row among those of an Arrow batch; a score that is not a number is the highest, null the lowest."""
    batch_id, inv, led, n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("batch_id", "invoice_idx", "ledger_idx", "_n", "_m"))
    score, flip = batch.column("score"), n > m
    by, other = np.where(flip, led, inv), np.where(flip, inv, led)
    value = score.to_numpy(zero_copy_only=False)
    odd = np.isnan(value)
    rank = np.where(odd, np.where(score.is_null().to_numpy(zero_copy_only=False), 2, 0), 1)
    order = np.lexsort((other, np.where(odd, 0.0, -value), rank, by, batch_id))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(batch_id[order]) != 0) | (np.diff(by[order]) != 0)
    kept = order[first]
    return pa.RecordBatch.from_arrays([*(pa.array(x[kept]) for x in (batch_id, flip, by, other)), score.take(pa.array(kept))], names=["batch_id", "flip", "by", "other", "score"])


def best_pairs(scores: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Each row's best column (of the shorter side), ties to the first, as ``BEST``.

    ``scores`` may have the sizes of its batches as _n and _m. A task keeps the best of each row of an Arrow batch, so that
    of all pairs only those are sorted and dealt.
    """
    if "_n" not in scores.columns:
        scores = merged(scores, (shapes(scores) if sizes is None else sizes).select("batch_id", "_n", "_m"), "batch_id")
    pairs = scores.select("batch_id", "invoice_idx", "ledger_idx", "score", "_n", "_m")
    few = pairs.mapInArrow(lambda batches: (best_of_rows(b) for b in batches if b.num_rows), BEST)
    top = few.groupBy("batch_id", "flip", "by").agg(F.max_by(F.struct("other", "score"), F.struct("score", -F.col("other"))).alias("top"))
    return top.select("batch_id", "flip", "by", "top.*")


def certificate(scores: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The assignment of those batches in which every row's best column is its own, which proves it optimal."""
    best = stash(best_pairs(scores, sizes), "best")
    proof = best.groupBy("batch_id").agg((F.count_distinct("other") == F.count("*")).alias("_ok"))
    places = (F.when(F.col("flip"), F.col(a)).otherwise(F.col(b)).alias(name) for name, a, b in (("invoice_idx", "other", "by"), ("ledger_idx", "by", "other")))
    return merged(best, proof.where("_ok"), "batch_id", "left_semi").select("batch_id", *places, "score")


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each row (rows <= columns) at least total cost, and the dual values of rows and columns.

    Rows enter one at a time along a shortest augmenting path (Jonker & Volgenant 1987, Crouse 2016); ties go to the
    lowest column.
    """
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    col_of = np.full(n, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        came = np.full(m, -1)
        closed = np.zeros(m, bool)
        path_rows, i, low = [], start, 0.0
        while True:
            path_rows.append(i)
            step = low + cost[i] - u[i] - v
            better = ~closed & (step < reach)
            reach[better] = step[better]
            came[better] = i
            open_reach = np.where(closed, np.inf, reach)
            low = open_reach.min()
            ties = np.flatnonzero(open_reach == low)
            unused = ties[row_of[ties] < 0]
            j = int(unused[0]) if len(unused) else int(ties[0])
            closed[j] = True
            if row_of[j] < 0:
                break
            i = int(row_of[j])
        u[start] += low
        for r in path_rows[1:]:
            u[r] += low - reach[col_of[r]]
        v[closed] += reach[closed] - low
        while True:
            i = int(came[j])
            row_of[j] = i
            col_of[i], j = j, col_of[i]
            if i == start:
                break
    return col_of, u, v


def solve_one(inv: np.ndarray, led: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The assignment of one whole batch: invoices, ledger rows and scores; rows sorted by invoice, ledger."""
    n, m = int(inv[-1]) + 1, int(led.max()) + 1
    s = score.reshape(n, m)
    flip = n > m
    t = s.T if flip else s
    col = t.argmax(axis=1)
    if len(set(col.tolist())) < len(col):
        finite = np.where(np.isfinite(t), t, 0.0)  # a score that is not a number can't be preferred
        col = assignment(1.0 - finite)[0]
    rows = np.arange(len(col))
    i, j = (col, rows) if flip else (rows, col)
    order = np.argsort(i)
    return i[order], j[order], s[i[order], j[order]]


def solve(frame: pd.DataFrame) -> pd.DataFrame:
    """Assignments of whole batches; rows sorted by batch, invoice, ledger."""
    batch = frame["batch_id"].to_numpy()
    inv, led, score = (frame[c].to_numpy() for c in ("invoice_idx", "ledger_idx", "score"))
    cut = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1], [True])))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        found = solve_one(inv[a:b], led[a:b], score[a:b])
        out.append((np.full(len(found[0]), batch[a]), *found))
    return pd.DataFrame(dict(zip(("batch_id", "invoice_idx", "ledger_idx", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))).astype({"batch_id": "int64", "invoice_idx": "int64", "ledger_idx": "int64"})


def sparse_assignment(n: int, m: int, edges: list[list[tuple[int, float]]], without: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Like ``assignment``, over the pairs ``edges[row]`` = [(column, cost)]; a row may also stay alone at the cost ``without``.

    Column of each row (m or more: alone), and the prices of rows and columns.
    """
    u, v = np.zeros(n), np.zeros(m + n)
    row_of = np.full(m + n, -1)
    col_of = np.full(n, -1)
    for start in range(n):
        reach: dict[int, float] = {}
        came: dict[int, int] = {}
        closed: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        path_rows, i, low = [], start, 0.0
        while True:
            path_rows.append(i)
            for j, c in (*edges[i], (m + i, without)):
                step = low + c - u[i] - v[j]
                if j not in closed and step < reach.get(j, np.inf):
                    reach[j], came[j] = step, i
                    heapq.heappush(heap, (step, j))
            while True:
                low, j = heapq.heappop(heap)
                if j not in closed and low == reach[j]:
                    break
            closed[j] = low
            if row_of[j] < 0:
                break
            i = int(row_of[j])
        u[start] += low
        for r in path_rows[1:]:
            u[r] += low - closed[int(col_of[r])]
        for c, at in closed.items():
            v[c] += at - low
        while True:
            i = came[j]
            row_of[j] = i
            col_of[i], j = j, col_of[i]
            if i == start:
                break
    return col_of.tolist(), u, v[:m]
