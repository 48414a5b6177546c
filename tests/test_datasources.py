"""Images as a source, one JSON array as a sink, counts that writes take on their way."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from matchloom.plans import pipeline, synthetic
from matchloom.sources import connectors, datasources


@pytest.mark.parametrize("images", [1, 3, 100])
def test_images_as_a_source(spark, tmp_path, images):
    """The blocks of real files, as the connector gives them; what can't be read is a row of its own."""
    files = [(r["path"], r["content"]) for r in synthetic.load(spark, "/root/testdata/sf0.001", synthetic.IMAGES).collect()]
    paths = []
    for name, content in files:
        (tmp_path / name).write_text(content)
        paths.append(str(tmp_path / name))
    paths.append(str(tmp_path / "missing"))
    datasources.register(spark)
    found = spark.read.format("ocr_blocks").option("engine", "matchloom.plans.synthetic:json_ocr").option("images", images).load(paths)
    rows = spark.createDataFrame([(str(tmp_path / p), c.encode()) for p, c in files], "path string, content binary")
    wanted = connectors.blocks_of_images(rows, synthetic.json_ocr)
    strip = lambda df: sorted(str((x["doc_id"], x["pos"], x["text"], x["bbox"], x["confidence"], x["_error"])) for x in df.collect())
    lost = found.where(F.col("doc_id") == paths[-1]).collect()
    assert [x["pos"] for x in lost] == [-1] and "FileNotFoundError" in lost[0]["_error"]
    assert strip(found.where(F.col("doc_id") != paths[-1])) == strip(wanted) and found.schema == wanted.schema


@pytest.mark.parametrize("n", [0, 1, 57])
def test_an_array_written_by_tasks(spark, tmp_path, n):
    items = [{"k": k, "text": 'é "\n' * (k % 3), "none": None, "deep": {"a": [1, {"b": k}], "c": []}} for k in range(n)]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(items)], "k int, value string").repartition(5).orderBy("k").select("value")
    datasources.register(spark)
    rows.write.format("json_array").mode("overwrite").save(str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text() == (json.dumps(items, indent=2) if n else "[]")
    assert [p.name for p in tmp_path.iterdir()] == ["out.json"]
    assert "toLocalIterator" not in connectors.write_results.__code__.co_names


def test_counts_are_logged(spark, caplog):
    with caplog.at_level(logging.INFO, "matchloom"):
        out = pipeline.finished(pipeline.match_mock(spark))
    said = [r.getMessage() for r in caplog.records]
    assert "preprocessed 4 invoices" in said and "preprocessed 4 ledger rows; the date window of 60 days removed 1" in said
    assert said[-1] == "classification: auto_match=3, review=0, unmatched=0" and out.count() == 3


@pytest.mark.parametrize("n", [0, 1, 300])
def test_a_written_array_is_read_by_many_tasks(spark, tmp_path, n):
    items = [{"k": k, "text": 'é "\n  }\n,[' * (k % 3), "none": None, "deep": {"a": [1, {"b": k}], "c": []}} for k in range(n)]
    datasources.register(spark)
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(items)], "k int, value string").repartition(3).orderBy("k").select("value")
    rows.write.format("json_array").mode("overwrite").save(str(tmp_path / "out.json"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = connectors.read_array(spark, str(tmp_path / "out.json"), "k long, text string, none string, deep struct<a:array<string>,c:array<string>>")
        assert found.rdd.getNumPartitions() > (10 if n == 300 else 0)
        got = sorted((x["k"], x["text"], x["none"], x["deep"]["a"]) for x in found.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == [(x["k"], x["text"], None, ["1", json.dumps({"b": x["k"]}, separators=(",", ":"))]) for x in items]
