"""Whole runs, the assignment and the date filter."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.operators import assignment, matching
from matchloom.plans import pipeline
from matchloom.plans.config import MatchConfig
from matchloom.sources import connectors


def rows_of(df):
    return [(r["invoice_idx"], r["ledger_idx"], r["score"], r["status"]) for r in df.orderBy("invoice_idx").collect()]


def test_demo_rows(spark):
    assert rows_of(pipeline.match_mock(spark)) == [(0, 0, 1.0, "auto_match"), (1, 1, 0.932292, "auto_match"), (2, 2, 1.0, "auto_match")]


def test_five_row_ledger(spark):
    ledger = [*connectors.MOCK_LEDGER[:3], ("INV-2024-004", "Everest Goods", "25/01/2024", "33200.00", None), ("REF-9999", "Random Vendor XYZ", "01/06/2024", "1.00", None)]
    found = rows_of(pipeline.match_mock(spark, None, ledger))
    assert [r[:2] for r in found] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert sum(r[2] for r in found) == pytest.approx(3.932292)


def test_score_matrix(spark):
    ledger = [*connectors.MOCK_LEDGER[:3], ("INV-2024-004", "Everest Goods", "25/01/2024", "33200.00", None)]
    wanted = [[1.0, 0.486008, 0.506178, 0.478645], [0.497092, 0.932292, 0.619816, 0.473827], [0.506178, 0.649848, 1.0, 0.604733], [0.478645, 0.465796, 0.604732, 1.0]]
    for salts in (1, 3):
        i, e = pipeline.prepare(connectors.mock_invoices(spark), connectors.mock_ledger(spark, ledger))
        got = {(r[1], r[2]): r[3] for r in matching.score_pairs(i, e, salts=salts).collect()}
        assert len(got) == 16
        assert [[got[a, b] for b in range(4)] for a in range(4)] == [pytest.approx(w, abs=1e-6) for w in wanted]


def test_blank_rows_are_for_review(spark):
    found = pipeline.match_mock(spark, [(None, None, None, None)], [(None, None, None, None, None)]).collect()
    assert [(r["score"], r["status"], r["invoice_id"], r["ledger_ref"], r["detail"]["invoice_date"]) for r in found] == [(0.825, "review", "inv_0", "led_0", "None")]


def test_unassigned_invoices_on_request(spark):
    found = pipeline.match_mock(spark, config=MatchConfig(include_unassigned=True)).orderBy("invoice_idx").collect()
    assert [(r["invoice_idx"], r["ledger_idx"]) for r in found] == [(0, 0), (1, 1), (2, 2), (3, None)]


def test_summary_has_all_statuses(spark):
    assert {r["status"]: r["n"] for r in matching.status_summary(pipeline.match_mock(spark)).collect()} == {"auto_match": 3, "review": 0, "unmatched": 0}


def kept_days(spark, invoice_days, ledger_days, max_days=60):
    frame = lambda days, c: spark.createDataFrame([(0, k, d) for k, d in enumerate(days)], "batch_id long, ordinal long, d int").select("batch_id", "ordinal", F.expr("date_add(DATE '2020-01-01', d)").alias("parsed_date"))
    out = matching.filter_candidates(frame(invoice_days, "i"), frame(ledger_days, "l"), max_days)
    return sorted(r["ordinal"] for r in out.collect())


def test_filter_candidates(spark):
    assert kept_days(spark, [None], [0, 500, None]) == [0, 1, 2]
    assert kept_days(spark, [0, 300], [60, 61, 150, 240, 239, None, -60, -61]) == [0, 3, 5, 6]
    r = np.random.default_rng(0)
    for _ in range(3):
        i, e = r.integers(-2000, 2000, 8).tolist(), r.integers(-2200, 2200, 60).tolist()
        assert kept_days(spark, i, e) == [k for k, d in enumerate(e) if min(abs(d - x) for x in i) <= 60]


def test_rows_are_numbered_over_cuts(spark, monkeypatch):
    """Cuts met by broadcast and by a merge."""
    rows = [(b, o) for b in range(3) for o in range(b, 40, b + 2)] + [(7, 1 << 40)]
    table = spark.createDataFrame(rows[::-1], "batch_id long, ordinal long")
    wanted = sorted((b, o, sum(x < o for c, x in rows if c == b)) for b, o in rows)
    monkeypatch.setattr(matching, "NUMBERED", 2)
    for few in (100, 0):
        monkeypatch.setattr(matching, "FEW_CUTS", few)
        assert sorted(tuple(r) for r in matching.number_rows(table, "at").select("batch_id", "ordinal", "at").collect()) == wanted


def test_rows_are_dealt_raw(spark, tmp_path):
    """Parsed fields are no part of any exchange, and results are written compressed."""
    ledger = connectors.mock_ledger(spark)
    near = matching.filter_candidates(matching.normalize_invoices(connectors.mock_invoices(spark)), ledger, 60, matching.normalize_ledger)
    assert near.columns == matching.normalize_ledger(ledger).columns and near.count() == 3
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "normalized_reference" in plan.split("Join")[0] and "normalized_reference" not in plan.split("Join")[1]
    connectors.write_result_lines(pipeline.match_mock(spark), str(tmp_path / "lines"))
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "lines").glob("part-*"))


def test_far_rows_change_nothing(spark):
    base = rows_of(pipeline.match_mock(spark))
    assert rows_of(pipeline.match_mock(spark, None, [*connectors.MOCK_LEDGER, ("INV-2024-004", "Everest Goods", "25/01/2030", "1", None)])) == base


def test_assignment_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(300):
        n, m = sorted(r.integers(1, 6, 2).tolist())
        cost = r.integers(0, 6, (n, m)) / 4 if r.random() < 0.5 else r.random((n, m))
        col, u, v = assignment.assignment(cost)
        assert len(set(col.tolist())) == n
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert cost[np.arange(n), col].sum() == pytest.approx(best)
        assert (u[:, None] + v <= cost + 1e-9).all()
        assert u + v[col] == pytest.approx(cost[np.arange(n), col])


def test_large_assignment_by_its_duals():
    cost = np.random.default_rng(2).random((120, 150))
    col, u, v = assignment.assignment(cost)
    assert (u[:, None] + v <= cost + 1e-9).all() and (v <= 1e-12).all()
    assert u.sum() + v.sum() == pytest.approx(cost[np.arange(120), col].sum())


def frame_of(matrix, batch=0):
    return [(batch, i, j, float(s)) for i, row in enumerate(matrix) for j, s in enumerate(row)]


def test_solve_shapes():
    rows = frame_of([[1, 0.9], [0.9, 0]]) + frame_of([[1], [3], [2]], 1) + frame_of([[1, 2, 3]], 2) + frame_of([[float("nan"), 1], [1, 0]], 3)
    got = assignment.solve(pd.DataFrame(rows, columns=["batch_id", "invoice_idx", "ledger_idx", "score"]))
    assert [tuple(r) for r in got[["batch_id", "invoice_idx", "ledger_idx"]].to_numpy().tolist()] == [(0, 0, 1), (0, 1, 0), (1, 1, 0), (2, 0, 2), (3, 0, 1), (3, 1, 0)]


def test_certificate(spark):
    """Batches wide, tall, with ties, without a certificate and with scores that are no numbers, each over several Arrow batches."""
    nan = float("nan")
    matrices = [[[0.1, 0.9, 0.9], [0.8, 0.2, 0.1]], [[0.5, 0.1], [0.5, 0.7], [0.2, 0.7]], [[1, 0.5], [0.9, 0.5]], [[0.3, nan], [nan, nan]], [[None, 0.0], [0.4, None]], [[0.0]]]
    rows = [(b, i, j, None if x is None else float(x)) for b, m in enumerate(matrices) for i, r in enumerate(m) for j, x in enumerate(r)]
    scores = spark.createDataFrame(rows, "batch_id long, invoice_idx long, ledger_idx long, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = assignment.certificate(scores).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1), (3, 0, 1), (3, 1, 0), (4, 0, 1), (4, 1, 0), (5, 0, 0)}
    assert {tuple(x)[:3] for x in found} == wanted and len(found) == len(wanted)


def test_the_certificate_deals_few_pairs(spark):
    """Of 40 x 50 pairs one a row is sorted and dealt, not all of them."""
    side = lambda name, n: spark.range(n).select(F.lit(0).cast("long").alias("batch_id"), F.col("id").alias(name))
    scores = side("invoice_idx", 40).join(side("ledger_idx", 50), "batch_id").withColumn("score", -F.abs(F.col("invoice_idx") - F.col("ledger_idx")).cast("double")).coalesce(1)
    sized = scores.withColumns({"_n": F.lit(40).cast("long"), "_m": F.lit(50).cast("long")})
    kept = [assignment.best_of_rows(b).num_rows for b in sized.toArrow().combine_chunks().to_batches()]
    assert sum(kept) == 40
    assert sorted(tuple(x)[1:3] for x in assignment.certificate(sized).collect()) == [(k, k) for k in range(40)]


def test_few_pairs_are_solved_as_all(monkeypatch):
    r = np.random.default_rng(4)
    for _ in range(100):
        n, m = sorted(r.integers(1, 8, 2).tolist())
        cost = r.integers(0, 6, (n, m)) / 4 if r.random() < 0.5 else r.random((n, m))
        col, u, v = assignment.sparse_assignment(n, m, [[(j, cost[i, j]) for j in range(m)] for i in range(n)], 100.0)
        assert cost[np.arange(n), col].sum() == pytest.approx(cost[np.arange(n), assignment.assignment(cost)[0]].sum())
        assert (u[:, None] + v <= cost + 1e-9).all()
    col, _, _ = assignment.sparse_assignment(2, 2, [[(0, 0.1)], [(0, 0.3)]], 50.0)
    assert sorted(c < 2 for c in col) == [False, True] and col[0] == 0


def test_large_batches_are_dealt(spark):
    i, e = pipeline.prepare(connectors.mock_invoices(spark), connectors.mock_ledger(spark))
    whole = {tuple(r) for r in matching.score_pairs(i, e).collect()}
    assert {tuple(r) for r in matching.score_pairs(i, e, MatchConfig(task_pairs=5), sizes=matching.batch_sizes(i, e)).collect()} == whole


def test_a_metric_of_ones_own(spark):
    config = MatchConfig(weights={"invoice_number": 0.5, "same": 0.5}, extra_metrics={"same": lambda i, e: F.lit(1.0)})
    i, e = pipeline.prepare(connectors.mock_invoices(spark), connectors.mock_ledger(spark))
    got = {(r[1], r[2]): r[3] for r in matching.score_pairs(i, e, config).collect()}
    assert got[0, 0] == 1.0
    with pytest.raises(ValueError, match="sum to 1"):
        MatchConfig(weights={"vendor": 0.5})


def test_empty_inputs(spark):
    i, e = connectors.mock_invoices(spark), connectors.mock_ledger(spark)
    assert pipeline.match(i.limit(0), e).collect() == []
    assert pipeline.match(i, e.limit(0)).collect() == []
