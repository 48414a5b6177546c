"""The engine's functions in SQL text, held against its columns."""

from pyspark.sql import functions as F

from matchloom.functions import parsing, similarity, sql, text
from matchloom.operators import matching
from matchloom.plans import pipeline, registry
from matchloom.sources import connectors


def test_scalar_functions(spark):
    sql.register(spark)
    i, e = registry._raw(spark, "/root/testdata/sf0.001")
    pairs = i.limit(300).join(e.select("ordinal", "reference", "vendor", F.col("date").alias("day"), "debit"), "ordinal")
    odd = spark.createDataFrame([(0, 0, None, "", " The  Co. É ", "x", None, "", "1.2.3"), (1, 0, "", "", "", None, "ab", "", ".")], "ordinal long, batch_id long, invoice_number string, vendor_name string, date string, amount string, reference string, vendor string, debit string").withColumn("day", F.lit(None).cast("string"))
    rows = pairs.unionByName(odd, allowMissingColumns=True)
    rows = rows.withColumns({"d1": parsing.parse_date(F.col("date")), "d2": parsing.parse_date(F.col("day"))})
    rows.createOrReplaceTempView("sql_pairs")
    got = spark.sql(
        "SELECT ordinal, plain_string(date) AS s, plain_reference(invoice_number) AS r, plain_vendor(vendor_name) AS v, plain_amount(debit) AS m, reference_similarity(plain_reference(invoice_number), plain_reference(reference)) AS x,"
        " vendor_similarity(plain_vendor(vendor_name), plain_vendor(vendor)) AS y, day_similarity(d1, d2) AS d, amount_similarity(plain_amount(amount), plain_amount(debit)) AS a, match_status(day_similarity(d1, d2)) AS c FROM sql_pairs"
    )
    ref, vendor = text.normalize_reference, text.normalize_vendor
    day = similarity.date_similarity(F.col("d1"), F.col("d2"))
    wanted = rows.select(
        "ordinal", text.normalize_string(F.col("date")).alias("s"), ref(F.col("invoice_number")).alias("r"), vendor(F.col("vendor_name")).alias("v"), parsing.parse_amount(F.col("debit")).alias("m"),
        similarity.levenshtein_similarity(ref(F.col("invoice_number")), ref(F.col("reference"))).alias("x"), similarity.jaro_winkler(vendor(F.col("vendor_name")), vendor(F.col("vendor"))).alias("y"), day.alias("d"),
        similarity.amount_similarity(parsing.parse_amount(F.col("amount")), parsing.parse_amount(F.col("debit"))).alias("a"), similarity.classify(day).alias("c"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_assignment_as_a_table_function(spark):
    sql.register(spark)
    i, e = pipeline.prepare(connectors.mock_invoices(spark), connectors.mock_ledger(spark))
    scores = matching.score_pairs(i, e)
    scores.createOrReplaceTempView("sql_scores")
    got = spark.sql("SELECT * FROM assign_batch(TABLE(SELECT batch_id, invoice_idx, ledger_idx, score FROM sql_scores) PARTITION BY batch_id ORDER BY (invoice_idx, ledger_idx))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, matching.assign(scores).collect()))
