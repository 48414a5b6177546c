"""OCR blocks to invoices and ledger rows, connectors and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from matchloom import __main__ as cli
from matchloom.operators import extraction
from matchloom.plans import pipeline, registry, synthetic
from matchloom.plans.config import MatchConfig
from matchloom.plans.schema import BLOCKS
from matchloom.sources import connectors
from matchloom.streaming import matching as streams


def blocks(spark, *rows):
    """rows: (doc, x, y, text) in order of arrival."""
    return spark.createDataFrame([(d, k, t, [[float(x), float(y)]], 0.9) for k, (d, x, y, t) in enumerate(rows)], BLOCKS)


def field(spark, name, *texts):
    docs = extraction.reading_order(blocks(spark, *(("d", 0, 20 * k, t) for k, t in enumerate(texts))))
    return extraction.extract_invoices(docs).first()[name]


def test_field_patterns(spark):
    for given, wanted in (("Invoice No: INV-2024-001", "INV-2024-001"), ("INVOICE", "OICE"), ("Invoice Number: INV-1", "ber"), ("INV-2024-001", "2024-001")):
        assert field(spark, "invoice_number", given) == wanted
    assert field(spark, "amount", "Subtotal 90", "Total: 100.00") == "90"
    assert field(spark, "amount", "100 USD") == "100"
    assert field(spark, "amount", "$ 7.5") == "7.5"
    assert field(spark, "date", "paid 15 January 2024") == "15 January 2024"
    assert field(spark, "amount", "Total:", "55.00") == "55.00"  # only all blocks together say so
    assert field(spark, "date", "nothing") is None


def test_strict_mode_loses_suffix_currency(spark):
    found = extraction.extract_invoices(extraction.reading_order(blocks(spark, ("d", 0, 0, "100 USD"))), MatchConfig(strict_compat=True)).first()
    assert found["_error"]


def test_vendor(spark):
    assert field(spark, "vendor_name", "Sold by -", "Vendor: Acme Ltd") == "Acme Ltd"
    assert field(spark, "vendor_name", "total 5", "Everest Goods Inc") == "Everest Goods Inc"
    assert field(spark, "vendor_name", "total 5", "Abcd") is None


def test_reading_order_and_confidence(spark):
    rows = [("d", 5.0, 15.0, "b"), ("d", 0.0, 25.0, "c"), ("d", 9.0, 4.9, "a"), ("d", 5.0, 15.0, "b2")]
    found = extraction.reading_order(blocks(spark, *rows)).first()["blocks"]
    assert [b["text"] for b in found] == ["a", "c", "b", "b2"]  # 15 and 25 both round to 20
    low = blocks(spark, ("d", 0, 0, "x")).withColumn("confidence", F.lit(0.29))
    assert extraction.reading_order(low).collect() == []


def test_rows_keep_their_anchor(spark):
    tables = extraction.table_rows(extraction.reading_order(blocks(spark, ("d", 9, 0, "b"), ("d", 1, 14, "a"), ("d", 0, 16, "c"))))
    assert tables.first()["rows"] == [["a", "b"], ["c"]] or tables.first()["rows"] == [["b", "a"], ["c"]]


def test_header_columns(spark):
    given = {"Voucher No": "reference", "Party": "vendor", "Dr": "debit", "Cr": "credit", "Total": "amount", "Description": "other", "Reference Date": "reference"}
    rows = spark.createDataFrame([(k,) for k in given], "h string").select("h", extraction.column_by_header(F.col("h")).alias("c")).collect()
    assert {r["h"]: r["c"] for r in rows} == given


def test_ledger_by_header_and_by_position(spark):
    cells = [("t", 100 * k, 0, h) for k, h in enumerate(("Reference", "Party", "Date", "Debit", "Credit"))]
    cells += [("t", 100 * k, 40, c) for k, c in enumerate(("A1", "Acme", "15/01/2024", "5.00"))]
    cells += [("p", 100 * k, 0, c) for k, c in enumerate(("15/01/2024", "ACME Goods", "AB1234", "1,200.00", "5.00"))] + [("p", 0, 40, "alone")]
    out = extraction.extract_ledger(extraction.table_rows(extraction.reading_order(blocks(spark, *cells))))
    assert {tuple(r) for r in out.collect()} == {("t", 1, "A1", "Acme", "15/01/2024", "5.00", None), ("p", 0, "AB1234", "ACME Goods", "15/01/2024", "1,200.00", "5.00")}


def make_ocr():
    """An engine for tests: the image is its blocks, as JSON."""
    return lambda content: json.loads(content)


def test_images(spark, tmp_path):
    page = [[[[0, 0]], ["Invoice No: INV-2024-001", 0.9]], [[[0, 30]], ["Vendor: Himalayan Traders", 0.9]], [[[0, 60]], ["15/01/2024", 0.9]], [[[0, 90]], ["Total: 45000.00", 0.9]], None]
    (tmp_path / "a.png").write_text(json.dumps([page]))
    (tmp_path / "b.png").write_text("not an image")
    results, failed = pipeline.match_images(spark, [str(tmp_path / "a.png"), str(tmp_path / "b.png")], connectors.mock_ledger(spark), make_ocr)
    assert [(r["invoice_id"], r["ledger_ref"], r["status"]) for r in results.collect()] == [("INV-2024-001", "INV-2024-001", "auto_match")]
    assert [r["doc_id"].rsplit("/", 1)[-1] for r in failed.collect()] == ["b.png"]


def test_json_and_table(spark, tmp_path):
    path = tmp_path / "ledger.json"
    names = ("reference", "vendor", "date", "debit", "credit")
    path.write_text(json.dumps([dict(zip(names, r)) for r in connectors.MOCK_LEDGER]))
    results = pipeline.match(connectors.mock_invoices(spark), connectors.read_ledger(spark, str(path))).orderBy("invoice_idx")
    connectors.write_results(results, str(tmp_path / "out.json"))
    written = json.loads((tmp_path / "out.json").read_text())
    assert [r["ledger_ref"] for r in written] == ["INV-2024-001", "INV2024002", "INV-2024-003"] and "invoice_idx" in written[0] and written[0]["detail"]["ledger_debit"] == 45000.0
    assert "invoice_idx" not in json.loads(connectors.summary_json(results).first()[0])
    lines = list(connectors.console_table(results))
    assert len(lines) == 7 and lines[3].startswith("| INV-2024-001 | INV-2024-001 | 1.0000 ")
    assert list(connectors.console_table(results.limit(0))) == ["No results to display."]


def test_result_lines(spark, tmp_path):
    results = pipeline.match(connectors.mock_invoices(spark), connectors.mock_ledger(spark))
    connectors.write_result_lines(results, str(tmp_path / "lines"))
    back = connectors.read_ledger(spark, str(tmp_path / "lines"), lines=True)
    assert back.count() == 3 and "batch_id" not in spark.read.json(str(tmp_path / "lines")).columns


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    import pytest

    from matchloom.sources import store

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(Session())


def test_four_places(spark):
    import random

    r = random.Random(6)
    values = [0.62445, 0.03125, 0.09375, 0.00005, 0.0, 1.0, 0.99995, *(r.randrange(10**5) / 10**5 for _ in range(3000)), *(r.random() for _ in range(500))]
    rows = spark.createDataFrame([(v,) for v in values], "s double").select("s", connectors.four_places(F.col("s")).alias("t")).collect()
    assert [x["t"] for x in rows] == [f"{x['s']:.4f}" for x in rows]


def test_unnested():
    item = [[[0, 0]], ["t", 0.9]]
    assert connectors.unnested([[item]]) == [item] and connectors.unnested([item]) == [item] and connectors.unnested(None) == [] and connectors.unnested([None]) == []


def test_command_line(capsys, tmp_path, spark):
    assert cli.main(["--mock", "--output", str(tmp_path / "o.json")]) == 0
    assert "INV2024002" in capsys.readouterr().out and len(json.loads((tmp_path / "o.json").read_text())) == 3
    assert cli.main(["--image", "x.png", "--ledger", str(tmp_path / "none.json")]) == 1
    (tmp_path / "ledger.json").write_text("[]")
    assert cli.main(["--image", "x.png", "--ledger", str(tmp_path / "ledger.json")]) == 1  # no engine is installed here


def test_the_usual_engine(monkeypatch):
    import sys
    import types

    class Engine:
        def __init__(self, **settings):
            assert settings["lang"] == "en"

        def ocr(self, content, cls):
            return [[[[[0, 0]], (content.decode(), 0.9)]]]

    monkeypatch.setitem(sys.modules, "paddleocr", types.SimpleNamespace(PaddleOCR=Engine))
    assert connectors.unnested(connectors.default_ocr()(b"x")) == [[[[0, 0]], ("x", 0.9)]]


def test_stream(spark, tmp_path):
    rows = connectors.mock_invoices(spark)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = []
    query = streams.match_stream(stream, connectors.mock_ledger(spark), lambda df, epoch: got.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert len(got) == 3
    assert "parsed_date" in streams.normalize_stream(stream).columns


def test_rows_are_walked_some_documents_at_a_time(spark, monkeypatch):
    """A batch of any number of documents becomes objects of Python by pieces, whatever their blocks; results are in order."""
    import pyarrow as pa

    ask = extraction._grouped.func
    sizes, walked = [], extraction._walked
    monkeypatch.setattr(extraction, "WALKED", 3)
    monkeypatch.setattr(extraction, "_walked", lambda *c: sizes.append(len(c[0])) or walked(*c))
    docs = [[(10.0, 5.0, "b"), (12.0, 1.0, "a"), (40.0, None, "d"), (41.0, 0.0, f"c{k}")][: k % 5] for k in range(10)]
    y, x, text = (pa.array([[b[p] for b in d] for d in docs], pa.list_(t)) for p, t in enumerate((pa.float64(), pa.float64(), pa.string())))
    got = ask(y, x, text, pa.array([15.0] * 10)).to_pylist()
    assert max(sizes) == 3 and sum(sizes) == 10
    wanted = [[], [["b"]], [["a", "b"]], [["a", "b"], ["d"]]]
    assert got == [wanted[k % 5] if k % 5 < 4 else [["a", "b"], ["d", f"c{k}"]] for k in range(10)]


def test_texts_behind_a_hit_are_not_looked_at(spark):
    """A text that fails where it is looked at stands behind the one that is found."""
    texts = spark.createDataFrame([(["", "hit", "bad"],), (["", ""],), ([],)], "texts array<string>")
    fails = lambda t: F.when(t == "bad", F.raise_error(F.lit("looked at"))).otherwise(t)
    found = texts.select(extraction._first_hit(F.col("texts"), fails).alias("f"))
    assert [x["f"] for x in found.collect()] == ["hit", None, None]


@pytest.mark.parametrize("sql", [synthetic.INVOICE_BLOCKS, synthetic.LEDGER_BLOCKS])
def test_blocks_are_joined_once(spark, sql):
    """A row of the tables gives all its blocks, the same as the SQL beside it does part by part."""
    sf_dir = "/root/testdata/sf0.001"
    found = synthetic.blocks(spark, sf_dir, sql)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    flat = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = found.select("doc_id", "pos", "text", F.col("bbox")[0][0], F.col("bbox")[0][1], "confidence")
    wanted = synthetic.load(spark, sf_dir, sql).selectExpr("doc_id", "CAST(pos AS INT)", "text", "x", "y", "CAST(confidence AS DOUBLE)")
    assert flat(got) == flat(wanted)


def test_blocks_are_read_off_once(spark):
    """Numbering counts its rows before it reads them, so that rows off blocks have to be written first."""
    assert all(getattr(df, "stash_path", None) for df in registry._of_images(spark, "/root/testdata/sf0.001"))
