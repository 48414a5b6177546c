"""Edge tables of the scalar functions."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions import parsing, similarity, text


def values(spark, rows, *columns):
    """Results of the columns over one-row tables (a, b)."""
    df = spark.createDataFrame(rows, "k int, a string, b string")
    return [tuple(r) for r in df.orderBy("k").select(*columns).collect()]


def one(spark, inputs, f):
    return [r[0] for r in values(spark, [(k, a, None) for k, a in enumerate(inputs)], f(F.col("a")))]


def test_normalizers(spark):
    assert one(spark, ["inv-2024/ 001#", None, ""], text.normalize_reference) == ["INV2024001", "", ""]
    assert one(spark, ["  Ab-C,\t d ", None, "a b"], text.normalize_string) == ["abc d", "", "a b"]
    given = ["The A and B Co. Ltd", "Pvt.Ltd", "A & B", "Co Ltd", None, "x x"]
    assert one(spark, given, text.normalize_vendor) == ["a b", "pvtltd", "a b", "", "", "x x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("01/06/2024", "2024-06-01"), ("01/25/2024", "2024-01-25"), ("5/1/2024", "2024-01-05"), ("15 jan 2024", "2024-01-15"), ("Jan 15, 2024", "2024-01-15"), ("2024/01/15", "2024-01-15"),
        ("15.01.2024", "2024-01-15"), ("15/01/75", "1975-01-15"), ("15/01/68", "2068-01-15"), ("31/02/2024", None), ("15-01-24", None), ("2024.01.15", None), ("15 Sept 2024", None), ("15/001/2024", None),
        ("15/01/0000", None), ("", None), (None, None), (" 15  January  2024, ", "2024-01-15"), ("29/02/2023", None), ("29/02/00", "2000-02-29"), ("12/25/99", "1999-12-25"),
    ],
)
def test_parse_date(spark, given, wanted):
    found = one(spark, [given], parsing.parse_date)[0]
    assert found == (datetime.date.fromisoformat(wanted) if wanted else None)


def test_parse_amount(spark):
    given = ["$1,234.50", "-500", "Rs. 500", "Rs. 1,200.50", "1.234,56", "1.234.567,89", ".", "", "0", None]
    assert one(spark, given, parsing.parse_amount) == [1234.5, 500.0, 0.5, 1200.5, 1.23456, 1234.56789, None, None, 0.0, None]


def test_levenshtein_similarity(spark):
    rows = [(0, "", ""), (1, "A", ""), (2, "INV2024001", "INV2024002")]
    assert [r[0] for r in values(spark, rows, similarity.levenshtein_similarity(F.col("a"), F.col("b")))] == [1.0, 0.0, 0.9]


def plain_jaro(a, b):
    """The definition, one pair at a time."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = set(range(len(b)))
    taken = []
    for i, c in enumerate(a):
        j = min((j for j in free if b[j] == c and abs(i - j) <= reach), default=None)
        if j is not None:
            free.discard(j)
            taken.append((i, j))
    if not taken:
        return 0.0
    other = [b[j] for j in sorted(j for _, j in taken)]
    wrong = sum(a[i] != c for (i, _), c in zip(taken, other))
    m = len(taken)
    return (m / len(a) + m / len(b) + (m - wrong / 2) / m) / 3


def test_jaro_against_the_definition():
    import random

    rnd = random.Random(4)
    pairs = [("martha", "marhta"), ("dixon", "dicksonx"), ("kathmandu supplies", "ktm supplies"), ("", ""), ("a", ""), ("é😀x", "é😀")]
    pairs += [("".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 12))), "".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 12)))) for _ in range(3000)]
    a, b = map(pd.Series, zip(*pairs))
    assert similarity.jaro_values(a, b).tolist() == pytest.approx([plain_jaro(*p) for p in pairs])


def test_jaro_winkler(spark):
    rows = [(0, "", ""), (1, "a", ""), (2, "abcd", "axyz"), (3, "martha", "marhta"), (4, "kathmandu supplies", "ktm supplies")]
    found = [r[0] for r in values(spark, rows, similarity.jaro_winkler(F.col("a"), F.col("b")))]
    assert found == pytest.approx([1.0, 0.0, 0.55, 0.961111, 0.8625], abs=1e-6)


def test_dates_and_amounts(spark):
    day = "CAST('2024-01-10' AS DATE)"
    for gap, wanted in ((0, 1.0), (1, 0.833333), (2, 0.666667), (3, 0.5), (4, 0.0), (-3, 0.5)):
        got = spark.range(1).select(similarity.date_similarity(F.expr(day), F.expr(f"date_add({day}, {gap})"))).first()[0]
        assert got == pytest.approx(wanted, abs=1e-6)
    none = F.lit(None).cast("date")
    assert spark.range(1).select(similarity.date_similarity(none, none), similarity.date_similarity(none, F.expr(day))).first()[:] == (0.5, 0.0)
    for a, b, wanted in ((5.0, 5.0, 1.0), (100.0, 99.0, 1.0), (100.0, 90.0, 0.367879), (0.0, 0.0, 1.0), (0.0, 5.0, 0.0), (None, None, 0.5), (None, 5.0, 0.0)):
        got = spark.range(1).select(similarity.amount_similarity(F.lit(a).cast("double"), F.lit(b).cast("double"))).first()[0]
        assert got == pytest.approx(wanted, abs=1e-6)
    for debit, credit, wanted in ((None, 3.0, 3.0), (0.0, 7.0, 7.0), (0.0, None, None), (None, 0.0, 0.0), (4.0, 7.0, 4.0)):
        assert spark.range(1).select(similarity.ledger_amount(F.lit(debit).cast("double"), F.lit(credit).cast("double"))).first()[0] == wanted


def test_classify(spark):
    rows = spark.createDataFrame([(0.9,), (0.8999999,), (0.7,), (0.6999,)], "s double")
    assert [r[0] for r in rows.select(similarity.classify(F.col("s"))).collect()] == ["auto_match", "review", "review", "unmatched"]


def test_a_batch_of_the_table_function_makes_no_frame(monkeypatch):
    """One partition is one small batch: what a data frame costs would be most of its time."""
    import pandas
    from pyspark.sql import Row

    from matchloom.functions import sql

    rows = [Row(score=s, batch_id=7, ledger_idx=j, invoice_idx=i) for i, r in enumerate([[0.9, 0.8], [0.85, 0.1], [0.2, 0.3]]) for j, s in enumerate(r)]
    one, none = sql.AssignBatch.func(), sql.AssignBatch.func()
    monkeypatch.setattr(pandas, "DataFrame", None)
    for row in rows:
        one.eval(row)
    assert list(one.terminate()) == [(7, 0, 1, 0.8), (7, 1, 0, 0.85)] and list(none.terminate()) == []
