"""Exact search, sharding, chat formatting, the registered queries and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.llm import chatfmt, histshard, maxscore

from .conftest import sha

SMALL = "/root/testdata/sf0.001"


def plain_top(rows, k=5, every=50):
    usable = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    least = {}
    for (i, q), v in zip(usable, [v for j, v in rows if j is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]):
        least[i] = min(least.get(i, (v, q)), (v, q), key=lambda x: x[0])
    for i, (_, q) in least.items():
        if i % every == 0:
            found = sorted((-int(q @ x), j) for j, x in usable if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("queries", "size"), [(512, 8 << 20), (4, 200)])
def test_top_k(spark, monkeypatch, queries, size):
    """All queries at once, and in several blocks and rounds."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 400)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", queries)
    monkeypatch.setattr(maxscore, "QUERY_BYTES", size)
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=12).round(2).tolist()) for k in range(900)]
    rows += [(900 + k, rows[0][1]) for k in range(20)] + [(1000, None), (1050, [1.0, None] + [0.0] * 10), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, rows[0][1])]
    rows += [(50, None), (100, rows[3][1]), (2000, None), (2000, rows[1][1])]  # an id twice: once usable, or with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(x) for x in maxscore.top_k(df).collect())
    assert got == plain_top(rows)
    assert maxscore.top_k(df.limit(0)).collect() == []
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in maxscore.top_k(few).collect()) == plain_top(rows[:3])


def test_search_prunes_exactly():
    r = np.random.default_rng(5)
    for wide in (1, 3, 40):
        x = (r.normal(size=(3000, wide)) * r.exponential(200, wide)).astype(np.int64)
        shard = maxscore.Shard(np.arange(3000), x)
        for i in range(0, 3000, 300):
            ids, scores = shard.search(i, x[i], 5)
            s = x @ x[i]
            wanted = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:5]
            assert ids.tolist() == wanted and scores.tolist() == s[wanted].tolist()
            ids, scores = shard.search(i, x[i], 5, float(s[wanted[2]]))  # a bar that others have set
            assert ids.tolist()[:3] == wanted[:3] and scores.tolist()[:3] == s[wanted[:3]].tolist()


def test_shards(spark, make_docs, corpus):
    docs = make_docs(corpus * 3 + ["lorem ipsum " * 20] * 150).withColumn("slot", F.lit("clash")).withColumn("shard", F.lit("x"))
    got = histshard.histogram_shards(docs, 8, 0.02).collect()
    assert len(got) == docs.count()
    total, by_shard, by_text = 0, defaultdict(list), defaultdict(set)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode()))
        by_shard[r["shard"]].append(r)
        by_text[texts[r["doc_id"]]].add(r["shard"])
        total += r["size"]
    assert sorted(by_shard) == list(range(8))
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 8) < 0.1 * total / 8
    weight = {t: len(t.encode()) + 1 for t in by_text}
    assert all(len(s) == 1 for t, s in by_text.items() if weight[t] * sum(x == t for x in texts.values()) < total / 16)
    assert histshard.histogram_shards(docs.limit(0)).collect() == []


def test_splitters_of_skewed_keys(spark):
    """All keys in one cell of the first round, and in one of the second: the probes are refined until they tell them apart."""
    r = random.Random(4)
    base = 0x1234567 << 36
    rows = [(base + r.randrange(1 << 30), r.randint(1, 50)) for _ in range(2000)] + [(base + 5, 30)] * 5
    total = sum(s for _, s in rows)
    targets = [total * k // 8 for k in range(1, 8)]
    cuts = histshard.splitters(spark.createDataFrame(rows, "_key long, size long"), targets, max(100, total // 1000))
    assert cuts == sorted(cuts) and all(base <= c <= base + (1 << 30) for c in cuts)
    for t, c in zip(targets, cuts):
        assert abs(sum(s for k, s in rows if k < c) - t) <= 50 + total // 1000 + 150


def test_a_group_beyond_a_shard_is_split(spark, make_docs):
    docs = make_docs(["the same words again"] * 400 + [f"other {k}" for k in range(400)])
    sizes = [r[0] for r in histshard.histogram_shards(docs, 8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * sum(sizes) / 8


def test_sharding_is_native(spark, make_docs):
    plan = histshard.histogram_shards(make_docs(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TEXTS = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["\\", "#", "### ", "</turn>", "\n", "assistant: ", ":", " ", "<", "x", "/turn>"]), max_size=8).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_round_trip(turns):
    chunks = [chatfmt.render(*t) for t in turns]
    assert chatfmt.parse_all("".join(chunks)) == turns
    for (_, text), chunk in zip(turns, chunks):
        a, b = chatfmt.parse(chunk)[2]
        assert chatfmt.unescape(chunk[a:b]) == text


def test_plain_content_stays_plain():
    assert chatfmt.render("user", "a # b < c") == "### user: a # b < c</turn>\n"
    assert chatfmt.render("user", "### x") == "### user: \\### x</turn>\n"


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </turn>"), (1, 2, "assistant", None), (None, 0, None, "x"), (2, None, "assistant", "é🙂"), (2, 3, "system", ""), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1)).repartition(3)
    got = {r["conv_id"]: r for r in chatfmt.digests(chatfmt.format_turns(df)).collect()}
    assert set(got) == {1, None, 2, -7}
    for conv, r in got.items():
        turns = [(b or "", c or "") for a, _, b, c in rows if a == conv]
        masked = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{x}\n{t}\n" for x, t in turns)), len(masked), sha(masked))
        assert r["formatted_chars"] == sum(len(chatfmt.render(*t)) for t in turns)
    assert chatfmt.digests(chatfmt.format_turns(df.limit(0))).collect() == []


def test_every_operator_has_a_query():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


CONTRACT = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2": "doc_id fingerprint component_id", "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id start n_tokens ids_crc32", "op5": "doc_id held_out score predicted", "op6": "doc_id n_bytes n_removed n_spans kept_sha256", "op7": "query_id rank vec_id score",
    "op8": "doc_id size text_crc32 law shard slot grown_shard", "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op11": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op13": "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_queries_run(spark, name):
    from .test_dedup import plain_components, plain_fingerprint
    from .test_text_ops import crc, library, plain_hits

    found = __spark_entry__.queries()[name](spark, SMALL)
    op = name.split("_")[0]
    assert set(CONTRACT[op].split()) <= set(found.columns)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r[0]: r for r in found.collect()} if op not in ("op7", "op9") else {}
    if op == "op1":
        items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
        assert [tuple(got[d])[1:] for d, _ in docs] == plain_hits([t for _, t in docs], items)
    elif op == "op2":
        fps = [plain_fingerprint(t) for _, t in docs]
        assert [(got[d]["fingerprint"], got[d]["component_id"]) for d, _ in docs] == [(f"{f:016x}", docs[c][0]) for f, c in zip(fps, plain_components(fps))]
    elif op == "op4":
        at = 0
        for (d, _), ids in zip(docs, library([t or "" for _, t in docs])):
            assert tuple(got[d]) == (d, at, len(ids) + 1, crc([*ids, 2]))
            at += len(ids) + 1
    elif op in ("op3", "op5", "op6", "op8", "op12"):
        assert sorted(got) == [d for d, _ in docs]
    else:
        assert found.count() > 0


def test_sql_of_the_queries(spark):
    import duckdb

    from matchloom.llm import queries

    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        wanted = con.execute(sql)
        columns = [c[0] for c in wanted.description]
        got = queries.QUERIES[name](spark, SMALL)
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(wanted.fetchall(), key=str)


CLASHES = ("spans", "key", "_key", "items", "n_words", "_kept", "fp", "score", "threshold", "rejected", "row", "_row", "g", "c", "at", "body", "salt", "w0", "slot", "_sub", "_base", "size", "shard", "a.b")


@pytest.mark.parametrize("stage", range(5))
def test_columns_with_clashing_names(spark, make_docs, corpus, stage):
    import corpus_pipeline

    docs = make_docs([*corpus[60:75], corpus[0], *corpus[-9:]])
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SMALL)
    rows = out.collect()
    assert rows
    if stage < 4:
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in CLASHES)


def test_operators_with_clashing_columns(spark, make_docs, corpus):
    from matchloom.llm import ctw, fmdecon, toxcnn

    docs = make_docs(corpus[60:75])
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("x"))
    bench = spark.createDataFrame([(1, corpus[60])], "item_id long, text string")
    for out in (histshard.histogram_shards(docs), fmdecon.digests(fmdecon.decontaminate(docs, bench)), ctw.score(docs), toxcnn.score(docs, toxcnn.train(docs.limit(0).withColumn("toxic", F.lit(1))))):
        assert out.count() == 15


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "packing":
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
            break
        assert out.columns == docs.columns
        docs = corpus_pipeline.stash(out, name)
        after = docs.count()
        assert 0 < after <= before
        before = after
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
