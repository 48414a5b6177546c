"""Every query of the reconciliation engine by name, with the SQL it is held against; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, similarity, sql, text
from ..operators import assignment, extraction, large, matching
from ..sources import connectors, datasources, store
from . import oracles as q
from . import pipeline, synthetic
from .schema import LEDGER

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "match_results"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return synthetic.load(spark, sf_dir, synthetic.INVOICES), synthetic.load(spark, sf_dir, synthetic.LEDGER)


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return pipeline.prepare(*_raw(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.score_pairs(*_prepared(spark, sf_dir))


def _rounded(name: str, value) -> F.Column:
    return F.round(value, 6).alias(name)


@registered(f"WITH {q.RAW} SELECT ordinal, {q.reference('invoice_number')} AS value FROM raw_i UNION ALL SELECT ordinal, {q.reference('reference')} FROM raw_l")
def normalize_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _raw(spark, sf_dir)
    return i.select("ordinal", text.normalize_reference(F.col("invoice_number")).alias("value")).unionByName(e.select("ordinal", text.normalize_reference(F.col("reference")).alias("value")))


@registered(f"WITH {q.RAW} SELECT ordinal, {q.plain('vendor_name')} AS value FROM raw_i UNION ALL SELECT ordinal, {q.plain('vendor')} FROM raw_l")
def normalize_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _raw(spark, sf_dir)
    return i.select("ordinal", text.normalize_string(F.col("vendor_name")).alias("value")).unionByName(e.select("ordinal", text.normalize_string(F.col("vendor")).alias("value")))


@registered(f"WITH {q.RAW} SELECT ordinal, {q.vendor('vendor_name')} AS value FROM raw_i UNION ALL SELECT ordinal, {q.vendor('vendor')} FROM raw_l")
def normalize_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _raw(spark, sf_dir)
    return i.select("ordinal", text.normalize_vendor(F.col("vendor_name")).alias("value")).unionByName(e.select("ordinal", text.normalize_vendor(F.col("vendor")).alias("value")))


@registered(f"WITH t AS ({synthetic.oracle(synthetic.DATES)}) SELECT o_orderkey, text, CAST({q.date('text')} AS STRING) AS value FROM t")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.load(spark, sf_dir, synthetic.DATES).select("o_orderkey", "text", parsing.parse_date(F.col("text")).cast("string").alias("value"))


@registered(f"WITH t AS ({synthetic.oracle(synthetic.DATES)}) SELECT o_orderkey, amount, {q.amount('amount')} AS value FROM t")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.load(spark, sf_dir, synthetic.DATES).select("o_orderkey", "amount", parsing.parse_amount(F.col("amount")).alias("value"))




@registered(
    f"WITH {q.RAW} SELECT batch_id, ordinal, {q.reference('invoice_number')} AS normalized_invoice_number, {q.vendor('vendor_name')} AS normalized_vendor, CAST({q.date('date')} AS STRING) AS parsed_date, {q.amount('amount')} AS parsed_amount FROM raw_i"
)
def normalized_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.normalize_invoices(_raw(spark, sf_dir)[0])
    return rows.select("batch_id", "ordinal", "normalized_invoice_number", "normalized_vendor", F.col("parsed_date").cast("string").alias("parsed_date"), "parsed_amount")


@registered(
    f"WITH {q.RAW} SELECT batch_id, ordinal, {q.reference('reference')} AS normalized_reference, {q.vendor('vendor')} AS normalized_vendor, CAST({q.date('date')} AS STRING) AS parsed_date, {q.amount('debit')} AS debit_amount, {q.amount('credit')} AS credit_amount FROM raw_l"
)
def normalized_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.normalize_ledger(_raw(spark, sf_dir)[1])
    return rows.select("batch_id", "ordinal", "normalized_reference", "normalized_vendor", F.col("parsed_date").cast("string").alias("parsed_date"), "debit_amount", "credit_amount")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice and ledger row of the same order, normalized."""
    i, e = _raw(spark, sf_dir)
    i, e = matching.normalize_invoices(i).alias("i"), matching.normalize_ledger(e).alias("e")
    return i.join(e, "ordinal")


_PAIRS = f"{q.RAW}, p AS (SELECT ordinal, {q.reference('i.invoice_number')} AS ref_a, {q.reference('l.reference')} AS ref_b, {q.vendor('i.vendor_name')} AS a, {q.vendor('l.vendor')} AS b, {q.date('i.date')} AS date_a, {q.date('l.date')} AS date_b, {q.amount('i.amount')} AS amount_a, {q.amount('l.debit')} AS debit, {q.amount('l.credit')} AS credit FROM raw_i i JOIN raw_l l USING (ordinal))"


@registered(f"WITH {_PAIRS} SELECT ordinal, CAST(levenshtein(ref_a, ref_b) AS INT) AS distance, round({q.levenshtein('ref_a', 'ref_b')}, 6) AS similarity FROM p")
def sim_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("normalized_invoice_number"), F.col("normalized_reference")
    return _pairs(spark, sf_dir).select("ordinal", similarity.levenshtein_distance(a, b).alias("distance"), _rounded("similarity", similarity.levenshtein_similarity(a, b)))


@registered(f"WITH {_PAIRS}, {q.jaro_ctes('p')} SELECT ordinal, round(jaro, 6) AS jaro, round(jw, 6) AS jaro_winkler FROM p JOIN jaro USING (a, b)")
def sim_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("i.normalized_vendor"), F.col("e.normalized_vendor")
    return _pairs(spark, sf_dir).select("ordinal", _rounded("jaro", similarity.jaro_similarity(a, b)), _rounded("jaro_winkler", similarity.jaro_winkler(a, b)))


@registered(f"WITH {_PAIRS} SELECT ordinal, round({q.by_date('date_a', 'date_b')}, 6) AS similarity FROM p")
def sim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("ordinal", _rounded("similarity", similarity.date_similarity(F.col("i.parsed_date"), F.col("e.parsed_date"))))


@registered(f"WITH {_PAIRS} SELECT ordinal, {q.pick('debit', 'credit')} AS picked, round({q.by_amount('amount_a', '(' + q.pick('debit', 'credit') + ')')}, 6) AS similarity FROM p")
def sim_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = similarity.ledger_amount(F.col("debit_amount"), F.col("credit_amount"))
    return _pairs(spark, sf_dir).select("ordinal", picked.alias("picked"), _rounded("similarity", similarity.amount_similarity(F.col("parsed_amount"), picked)))


@registered(f"WITH {q.NORMALIZED} SELECT batch_id, ordinal, ledger_idx, CAST(d AS STRING) AS parsed_date FROM led")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _raw(spark, sf_dir)
    return pipeline.candidates(matching.normalize_invoices(i), e).select("batch_id", "ordinal", "ledger_idx", F.col("parsed_date").cast("string").alias("parsed_date"))


@registered(f"WITH {q.NORMALIZED} SELECT (SELECT count(*) FROM led_all) AS n_in, (SELECT count(*) FROM led) AS n_kept, (SELECT count(*) FROM led_all) - (SELECT count(*) FROM led) AS n_removed")
def removed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _raw(spark, sf_dir)
    kept = matching.filter_candidates(matching.normalize_invoices(i), matching.normalize_ledger(e)).agg(F.count("*").alias("n_kept"))
    whole = e.agg(F.count("*").alias("n_in"))
    one = whole.withColumn("k", F.lit(0)).join(kept.withColumn("k", F.lit(0)), "k")
    return one.select("n_in", "n_kept", (F.col("n_in") - F.col("n_kept")).alias("n_removed"))


@registered(f"WITH {q.SCORED} SELECT batch_id, invoice_idx, ledger_idx, round(score, 6) AS score, round(1 - score, 6) AS cost FROM scores")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("batch_id", "invoice_idx", "ledger_idx", _rounded("score", F.col("score")), _rounded("cost", 1 - F.col("score")))


@registered(
    f"""WITH {q.SCORED}, shape AS (SELECT batch_id, max(invoice_idx) + 1 AS n, max(ledger_idx) + 1 AS m FROM scores GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY batch_id, CASE WHEN n <= m THEN invoice_idx ELSE ledger_idx END ORDER BY score DESC, invoice_idx, ledger_idx) AS place FROM scores JOIN shape USING (batch_id)),
proof AS (SELECT batch_id FROM top WHERE place = 1 GROUP BY 1 HAVING count(*) = count(DISTINCT invoice_idx) AND count(*) = count(DISTINCT ledger_idx))
SELECT batch_id, invoice_idx, ledger_idx, round(score, 6) AS score FROM top JOIN proof USING (batch_id) WHERE place = 1"""
)
def assign_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _prepared(spark, sf_dir)
    sizes = store.stash(matching.batch_sizes(i, e), "sizes")
    return assignment.certificate(matching.score_pairs(i, e, sizes=sizes, sized=True)).select("batch_id", "invoice_idx", "ledger_idx", _rounded("score", F.col("score")))


_TOTALS = f"WITH RECURSIVE {q.ASSIGNED} SELECT batch_id, count(*) AS n_pairs, round(sum(score), 6) AS total FROM assigned GROUP BY 1"


@registered(_TOTALS)
def assign_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _prepared(spark, sf_dir)
    assigned = matching.assign_rows(i, e)
    return assigned.groupBy("batch_id").agg(F.count("*").alias("n_pairs"), _rounded("total", F.sum("score")))


@registered(_TOTALS)
def assign_totals_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch solved as those are that no task can hold, out of a table of all pairs."""
    i, e = _prepared(spark, sf_dir)
    assigned = large.assign_large(large.PairTable(matching.score_pairs(i, e), matching.batch_sizes(i, e)))
    return assigned.groupBy("batch_id").agg(F.count("*").alias("n_pairs"), _rounded("total", F.sum("score")))


@registered(_TOTALS)
def assign_totals_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without that table: pairs are found where they can beat their prices."""
    i, e = _prepared(spark, sf_dir)
    assigned = large.assign_large(matching.index_of(i, e, matching.batch_sizes(i, e)))
    return assigned.groupBy("batch_id").agg(F.count("*").alias("n_pairs"), _rounded("total", F.sum("score")))


@registered(_TOTALS)
def assign_totals_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL text, by the assignment as a table function."""
    sql.register(spark)
    return spark.sql(
        """SELECT batch_id, count(*) AS n_pairs, round(sum(score), 6) AS total
        FROM assign_batch(TABLE(SELECT batch_id, invoice_idx, ledger_idx, score FROM {scores}) PARTITION BY batch_id ORDER BY (invoice_idx, ledger_idx)) GROUP BY batch_id""",
        scores=_scores(spark, sf_dir),
    )


def _flat(matched: DataFrame) -> DataFrame:
    return matched.select("batch_id", "invoice_idx", "ledger_idx", "invoice_id", "ledger_ref", "score", "status", "detail.*")


@registered(f"WITH RECURSIVE {q.MATCHED} SELECT * FROM matched")
def match_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pipeline.match(*_raw(spark, sf_dir)))


@registered(f"WITH RECURSIVE {q.matched(synthetic.oracle(synthetic.UNNAMED_INVOICES), synthetic.oracle(synthetic.UNNAMED_LEDGER))} SELECT batch_id, invoice_idx, ledger_idx, invoice_id, ledger_ref, score, status FROM matched")
def id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a number or reference go by their position."""
    out = pipeline.match(synthetic.load(spark, sf_dir, synthetic.UNNAMED_INVOICES), synthetic.load(spark, sf_dir, synthetic.UNNAMED_LEDGER))
    return out.select("batch_id", "invoice_idx", "ledger_idx", "invoice_id", "ledger_ref", "score", "status")


@registered(f"WITH {q.RAW} SELECT reference, vendor, date, debit, credit FROM raw_l")
def json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as JSON and read back."""
    path = store.new_path(spark, "json")
    _raw(spark, sf_dir)[1].select("reference", "vendor", "date", "debit", "credit").write.json(path)
    return connectors.read_ledger(spark, path, lines=True).drop("batch_id", "ordinal")


@registered(f"WITH {q.RAW} SELECT ordinal, reference, vendor, date, debit, credit FROM raw_l")
def json_ledger_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written by tasks as one JSON array and read back in its order."""
    path = f"{store.new_path(spark, 'array')}.json"
    store.make_parent(spark, path)
    fields = ("reference", "vendor", "date", "debit", "credit")
    rows = _raw(spark, sf_dir)[1].orderBy("ordinal")
    datasources.register(spark)
    rows.select(F.to_json(F.struct("ordinal", *fields), {"ignoreNullFields": "false"}).alias("value")).write.format("json_array").mode("overwrite").save(path)
    return connectors.read_array(spark, path, "ordinal long, " + LEDGER)


@registered(f"WITH RECURSIVE {q.MATCHED} SELECT * EXCLUDE (batch_id) FROM matched")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON, without the internal batch_id, and read back."""
    path, out = store.new_path(spark, "json"), pipeline.match(*_raw(spark, sf_dir))
    connectors.write_result_lines(out, path)
    return spark.read.schema(out.drop("batch_id").schema).json(path).select("invoice_idx", "ledger_idx", "invoice_id", "ledger_ref", "score", "status", "detail.*")


@registered(f"WITH RECURSIVE {q.MATCHED} SELECT invoice_id, ledger_ref, round(score, 6) AS score, status, 'invoice_id,ledger_ref,score,status,detail' AS names FROM matched")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text of each result, read field by field: positions are left out."""
    value = F.col("value")
    lines = connectors.summary_json(pipeline.match(*_raw(spark, sf_dir)))
    found = (F.get_json_object(value, f"$.{c}").alias(c) for c in ("invoice_id", "ledger_ref", "score", "status"))
    return lines.select(*found, F.array_join(F.json_object_keys(value), ",").alias("names")).withColumn("score", F.col("score").cast("double"))


@registered(
    f"""WITH pages AS ({synthetic.oracle(synthetic.IMAGES)}), items AS (SELECT 'img' || s_suppkey AS doc_id, s_suppkey % 7 + 0.5::DOUBLE AS x, s_name, unnest([0, 2]) AS pos FROM supplier WHERE s_suppkey % 10 NOT IN (3, 4))
SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN pos = 0 THEN 'Vendor: ' ELSE 'ref ' END || s_name AS text, x, CASE WHEN pos = 0 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END AS y, CASE WHEN pos = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS confidence, false AS failed FROM items
UNION ALL SELECT path, -1, NULL, NULL, NULL, NULL, true FROM pages WHERE content = 'no image'"""
)
def image_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images through an OCR engine: pages unnested, gaps skipped, failures kept apart."""
    files = synthetic.load(spark, sf_dir, synthetic.IMAGES).select("path", F.encode("content", "UTF-8").alias("content"))
    box = F.col("bbox")
    found = connectors.blocks_of_images(files, synthetic.json_ocr)
    return found.select("doc_id", "pos", "text", F.try_element_at(box, F.lit(1))[0].alias("x"), F.try_element_at(box, F.lit(1))[1].alias("y"), "confidence", F.col("_error").isNotNull().alias("failed"))


@registered(f"WITH RECURSIVE {q.MATCHED} SELECT s.status, count(m.status) AS n FROM (SELECT unnest(['auto_match', 'review', 'unmatched']) AS status) s LEFT JOIN matched m USING (status) GROUP BY 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.status_summary(pipeline.match(*_raw(spark, sf_dir)))


@registered(f"WITH RECURSIVE {q.MATCHED} SELECT batch_id, invoice_idx, invoice_id, ledger_ref, format('{{:.4f}}', score) AS score, status FROM matched")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.table_lines(pipeline.match(*_raw(spark, sf_dir)))


@registered(f"WITH {q.blocks(synthetic.INVOICE_BLOCKS)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY band, x, pos) - 1 AS INT) AS place, pos, text FROM b")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extraction.reading_order(synthetic.blocks(spark, sf_dir, synthetic.INVOICE_BLOCKS))
    return docs.select("doc_id", F.posexplode("blocks").alias("place", "b")).select("doc_id", "place", "b.pos", "b.text")


@registered(
    f"WITH {q.INVOICE_TEXTS} SELECT doc_id, {q.found('invoice_number')} AS invoice_number, {q.VENDOR} AS vendor_name, {q.found('date')} AS date, coalesce({q.found('amount')}, {q.found_either('currency_amount')}) AS amount, array_to_string(texts, ' | ') AS _raw_text FROM docs"
)
def extract_invoice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extraction.reading_order(synthetic.blocks(spark, sf_dir, synthetic.INVOICE_BLOCKS))
    return extraction.extract_invoices(docs).drop("_error")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.table_rows(extraction.reading_order(synthetic.blocks(spark, sf_dir, synthetic.LEDGER_BLOCKS)))


@registered(f"WITH {q.TABLE_ROWS} SELECT doc_id, CAST(row_idx AS INT) AS row_idx, array_to_string(cells, '|') AS cells FROM table_rows")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", F.posexplode("rows").alias("row_idx", "cells")).withColumn("cells", F.array_join("cells", "|"))


@registered(f"WITH {q.NAMED} SELECT h.doc_id, CAST(header AS INT) AS header, array_to_string(names, '|') AS names FROM headers h LEFT JOIN names n ON n.doc_id = h.doc_id")
def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.with_header(_tables(spark, sf_dir))
    return found.select("doc_id", "header", F.array_join(F.transform(F.expr("CASE WHEN header IS NOT NULL THEN rows[header] END"), extraction.column_by_header), "|").alias("names"))


@registered(f"WITH {q.NAMED} SELECT * FROM ({q.BY_HEADER}) WHERE coalesce(reference, vendor, date, debit, credit) IS NOT NULL")
def ledger_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_ledger(extraction.with_header(_tables(spark, sf_dir)).where("header IS NOT NULL"))


@registered(f"WITH {q.POSITIONAL} SELECT * FROM ({q.BY_POSITION}) WHERE coalesce(reference, vendor, date, debit, credit) IS NOT NULL")
def ledger_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_ledger(extraction.with_header(_tables(spark, sf_dir)).where("header IS NULL"))


_DEMO = q.matched(q.values(connectors.MOCK_INVOICES, "invoice_number, vendor_name, date, amount"), q.values(connectors.MOCK_LEDGER, "reference, vendor, date, debit, credit"))


@registered(f"WITH RECURSIVE {_DEMO} SELECT * FROM matched")
def match_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pipeline.match_mock(spark))


def _of_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw invoices and ledger rows as they are read off blocks, each document's table being the ledger of its six orders.

    They are written once, since numbering counts its rows before it reads them: blocks are not read off twice.
    """
    found = extraction.extract_invoices(extraction.reading_order(synthetic.blocks(spark, sf_dir, synthetic.INVOICE_BLOCKS)))
    key = F.substring("doc_id", 4, 20).cast("long")
    invoices = found.select(F.floor(key / 6).alias("batch_id"), key.alias("ordinal"), "invoice_number", "vendor_name", "date", "amount")
    ledger = extraction.extract_ledger(_tables(spark, sf_dir)).select(key.alias("batch_id"), F.col("row_idx").cast("long").alias("ordinal"), "reference", "vendor", "date", "debit", "credit")
    return store.stash(invoices, "invoices"), store.stash(ledger, "ledger")


@registered(None)
def images_to_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to invoices and ledger rows to matches."""
    return pipeline.match(*_of_images(spark, sf_dir)).select("batch_id", "invoice_idx", "ledger_idx", "invoice_id", "ledger_ref", "score", "status")


@registered(f"WITH RECURSIVE {q.OF_IMAGES} SELECT batch_id, count(*) AS n_pairs, round(sum(score), 6) AS total FROM assigned GROUP BY 1")
def images_to_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of that run: of several best assignments either may come out, with the same total."""
    assigned = matching.assign_rows(*pipeline.prepare(*_of_images(spark, sf_dir)))
    return assigned.groupBy("batch_id").agg(F.count("*").alias("n_pairs"), _rounded("total", F.sum("score")))
