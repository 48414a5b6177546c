"""Invoices, ledgers and OCR blocks made from the orders and customer tables, in SQL that Spark and DuckDB both accept.

Every order becomes an invoice and a ledger row; six neighbouring orders form a batch. They hold null fields, many date
formats, currency marks, vendor suffixes, references off by one, dates some days or far apart, and zero debits.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

_DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
_MONTH = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_YEAR = "CAST(year(o_orderdate) AS STRING)"
_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_LONG = "CASE month(o_orderdate) " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES, 1)) + " END"
_SHORT = "CASE month(o_orderdate) " + " ".join(f"WHEN {k} THEN '{n[:3]}'" for k, n in enumerate(_NAMES, 1)) + " END"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_PRICE = f"CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')"
_BATCH = "CAST(floor(o_orderkey / 6) AS BIGINT)"
_FROM = "FROM {orders} JOIN {customer} ON o_custkey = c_custkey"

#: A date as text in each accepted format, and in some that are not.
_FORMATS = (
    f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}",
    f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}",
    f"{_DAY} || '.' || {_MONTH} || '.' || {_YEAR}",
    f"{_MONTH} || '/' || {_DAY} || '/' || {_YEAR}",
    f"{_DAY} || '-' || {_MONTH} || '-' || {_YEAR}",
    f"{_YEAR} || '/' || {_MONTH} || '/' || {_DAY}",
    f"{_DAY} || ' ' || {_SHORT} || ' ' || {_YEAR}",
    f"{_DAY} || '  ' || upper({_LONG}) || ' ' || {_YEAR} || ','",
    f"' ' || {_SHORT} || ' ' || {_DAY} || ', ' || {_YEAR} || ' '",
    f"{_LONG} || ' ' || {_DAY} || ', ' || {_YEAR}",
    f"{_SHORT} || ' ' || {_DAY} || ' ' || {_YEAR}",
    f"lower({_LONG}) || ' ' || {_DAY} || ' ' || {_YEAR}",
    f"{_DAY} || '/' || {_MONTH} || '/' || substr({_YEAR}, 3, 2)",
    f"{_MONTH} || '/' || {_DAY} || '/' || substr({_YEAR}, 3, 2)",
    f"{_DAY} || '-' || {_MONTH} || '-' || substr({_YEAR}, 3, 2)",
    f"{_DAY} || ' Sept ' || {_YEAR}",
    "'31/02/1997'",
    "''",
)
DATES = (
    "SELECT o_orderkey, CASE CAST(o_orderkey % 19 AS INT) "
    + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMATS))
    + f" END AS text, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '$' || {_PRICE} WHEN 1 THEN '-' || {_PRICE} WHEN 2 THEN 'Rs. ' || CAST(o_orderkey AS STRING) WHEN 3 THEN '1.234.' || {_PRICE} WHEN 4 THEN '.' WHEN 5 THEN '0' ELSE {_PRICE} || ' USD' END AS amount {_FROM}"
)

INVOICES = f"""SELECT o_orderkey AS ordinal, {_BATCH} AS batch_id,
 'INV-' || {_YEAR} || '-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS invoice_number,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_name || CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Inc.' WHEN 2 THEN '' ELSE ' & Company' END END AS vendor_name,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN {_FORMATS[0]} WHEN o_orderkey % 3 = 1 THEN {_FORMATS[1]} ELSE {_FORMATS[2]} END AS date,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 2 = 0 THEN '$' ELSE '' END || {_PRICE} END AS amount
{_FROM}"""

LEDGER = f"""SELECT o_orderkey AS ordinal, {_BATCH} AS batch_id,
 'INV' || {_YEAR} || lpad(CAST(o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS STRING), 8, '0') AS reference,
 replace(c_name, '#', ' ') || CASE WHEN o_orderkey % 2 = 0 THEN ' Limited' ELSE '' END AS vendor,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) + CASE WHEN o_orderkey % 29 = 0 THEN 20000 ELSE 0 END AS STRING) END AS date,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '0.00' ELSE CAST(CAST(round(o_totalprice) AS BIGINT) + o_orderkey % 3 AS STRING) END AS debit,
 CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) END AS credit
{_FROM}"""

#: The same without some numbers and references, which then go by their positions.
UNNAMED_INVOICES = f"SELECT ordinal, batch_id, CASE WHEN ordinal % 5 = 0 THEN NULL WHEN ordinal % 5 = 1 THEN '' ELSE invoice_number END AS invoice_number, vendor_name, date, amount FROM ({INVOICES}) t"
UNNAMED_LEDGER = f"SELECT ordinal, batch_id, CASE WHEN ordinal % 7 = 0 THEN NULL WHEN ordinal % 7 = 1 THEN '' ELSE reference END AS reference, vendor, date, debit, credit FROM ({LEDGER}) t"

_NUMBER = f"'INV-' || {_YEAR} || '-' || lpad(CAST(o_orderkey AS STRING), 8, '0')"
_TEXTS = (
    (0, "'INVOICE COPY'", "10.0", "4.0"),
    (1, f"CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN {_NUMBER} WHEN 1 THEN 'Invoice Number: ' || {_NUMBER} WHEN 2 THEN ' Inv. # ' || {_NUMBER} ELSE 'Invoice No: ' || {_NUMBER} END", "200.0", "12.0"),
    (2, "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'Vendor: ' || c_name || ' Ltd' WHEN 1 THEN 'Everest Goods Inc' ELSE 'Sold by - ' END", "10.0", "35.0"),
    (3, f"'Date ' || CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN {_FORMATS[0]} WHEN 1 THEN {_FORMATS[8]} ELSE {_FORMATS[1]} END", "10.0", "55.0"),
    (4, f"CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Subtotal 90' WHEN 1 THEN {_PRICE} || ' USD' WHEN 2 THEN '$' || {_PRICE} ELSE 'Grand Total: ' || {_PRICE} END", "200.0", "95.0 + CAST(o_orderkey % 11 AS DOUBLE)"),
    (5, "CASE WHEN o_orderkey % 2 = 0 THEN 'thank you' END", "10.0", "120.0"),
)


#: The parts of each relation of blocks: document, position, text, x, y.
PARTS: dict[str, list[tuple[str, ...]]] = {}
_CONFIDENCE = "CASE WHEN (o_orderkey + {pos}) % 37 = 0 THEN 0.29 ELSE 0.3 + ({pos} % 7) / 10.0 END"


def _blocks(parts) -> str:
    one = "SELECT {doc} AS doc_id, {pos} AS pos, {text} AS text, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, " + _CONFIDENCE + " AS confidence "
    sql = " UNION ALL ".join(one.replace("{doc}", doc).replace("{pos}", pos).replace("{text}", text).replace("{x}", x).replace("{y}", y) + _FROM for doc, pos, text, x, y in parts)
    PARTS[sql] = parts
    return sql


#: Six blocks for each order: an invoice.
INVOICE_BLOCKS = _blocks([("'inv' || CAST(o_orderkey AS STRING)", f"{p}", t, x, y) for p, t, x, y in _TEXTS])

_ROW = "(o_orderkey % 6)"
_CELLS = (
    ("'INV' || " + _YEAR + " || lpad(CAST(o_orderkey AS STRING), 8, '0')", "0.0"),
    ("CASE WHEN o_orderkey % 9 <> 0 THEN replace(c_name, '#', ' ') END", "100.0"),
    (_FORMATS[0], "200.0"),
    ("CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) || '.00'", "300.0"),
    ("CASE WHEN o_orderkey % 4 = 0 THEN '1,234.50' END", "400.0"),
)
_HEADS = ("Reference", "Party", "Date", "Debit", "Credit")
_LEDGER_DOC = f"'led' || CAST({_BATCH} AS STRING)"
#: A table for each batch: a header (but for every fourth) and a row of up to five cells for each order, some pixels off.
LEDGER_BLOCKS = _blocks(
    [(_LEDGER_DOC, f"{k}", f"CASE WHEN o_orderkey % 6 = 0 AND {_BATCH} % 4 <> 0 THEN '{h}' END", f"{100 * k}.0", f"10.0 + {k}") for k, h in enumerate(_HEADS)]
    + [(_LEDGER_DOC, f"CAST(5 + 5 * {_ROW} + {k} AS INT)", t, x, f"50.0 + 30.0 * {_ROW} + ((o_orderkey + {k}) % 5) * 2.5") for k, (t, x) in enumerate(_CELLS)]
)


#: An image for each supplier, as the JSON that ``json_ocr`` reads: nested in a page or not, with a gap, or unreadable.
_ITEM = """'[[[' || CAST(s_suppkey % 7 AS STRING) || '.5, {y}.0]], ["{text} ' || s_name || '", 0.{confidence}]]'"""
_ITEMS = " || ', null, ' || ".join(_ITEM.replace("{y}", y).replace("{text}", t).replace("{confidence}", c) for y, t, c in (("10", "Vendor:", "75"), ("40", "ref", "25")))
IMAGES = f"""SELECT 'img' || CAST(s_suppkey AS STRING) AS path,
 CASE WHEN s_suppkey % 10 = 3 THEN 'no image' WHEN s_suppkey % 10 = 4 THEN 'null' WHEN s_suppkey % 2 = 0 THEN '[[' || {_ITEMS} || ']]' ELSE '[' || {_ITEMS} || ']' END AS content FROM {{supplier}}"""


def json_ocr():
    """An engine for synthetic images: they are its blocks, as JSON."""
    return lambda content: json.loads(content)


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "supplier")}
    return spark.sql(sql, **{t: df for t, df in tables.items() if f"{{{t}}}" in sql})


def oracle(sql: str) -> str:
    """The same relation over the tables by name."""
    return sql.replace("{orders}", "orders").replace("{customer}", "customer").replace("{supplier}", "supplier")


def blocks(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Synthetic blocks in the shape of OCR output; a row of the tables gives all its blocks, so that they are joined once.

    Orders are dealt by the key of that join: a file of few parts would else be few tasks, each with all blocks of its part.
    """
    one = "struct({doc} AS doc_id, CAST({pos} AS INT) AS pos, {text} AS text, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST(" + _CONFIDENCE + " AS DOUBLE) AS confidence)"
    each = ", ".join(one.replace("{doc}", doc).replace("{pos}", pos).replace("{text}", text).replace("{x}", x).replace("{y}", y) for doc, pos, text, x, y in PARTS[sql])
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = spark.sql(f"SELECT inline(array({each})) {_FROM}", orders=orders.repartition("o_custkey"), customer=customer)
    return rows.selectExpr("doc_id", "pos", "text", "array(array(x, y), array(x + 50, y), array(x + 50, y + 8), array(x, y + 8)) AS bbox", "confidence")
