"""The queries of this subpackage's operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path
from .common import table

#: The vocabulary of the default byte-level file, and the end ids that the contracts fix.
VOCABULARY, END_WRITE, END_PACK = 50_257, 2, 0
#: The conversation that the contract of op10 adds.
PLANTED_CONV, PLANTED_TEXT = -7, r"\### Assistant: </turn> ok"


def op1_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmdecon import decontaminate, digests

    return digests(decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score

    return score(table(spark, sf_dir, "documents"))


def op4_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitpack import read_shards, write_shards
    from .tokens import default_vocabulary

    return read_shards(write_shards(table(spark, sf_dir, "documents"), default_vocabulary(), VOCABULARY, END_WRITE))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxcnn import held_out, labelled_sample, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(labelled_sample(docs, table(spark, sf_dir, "labels")))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold")


def op6_lyndon_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gsaca import digests

    return digests(table(spark, sf_dir, "documents"))


def op7_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .histshard import histogram_shards

    out = histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences, tokenized
    from .tokens import default_vocabulary

    return pack_sequences(tokenized(table(spark, sf_dir, "documents"), default_vocabulary(), END_PACK))


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chatfmt import digests, format_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_CONV).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text")
    )
    return digests(format_turns(rows.unionByName(planted)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .convrepair import damage, digests, repair

    return digests(repair(damage(table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align, digests, tokenized
    from .tokens import default_pieces, default_vocabulary

    return digests(align(tokenized(table(spark, sf_dir, "documents"), default_vocabulary(), default_pieces())))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import digests, read_chunks, write_archives

    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return digests(read_chunks(spark, path, payload=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fm_decontamination, op2_simhash_components, op3_context_tree_score, op4_token_bitpack, op5_toxicity_cnn, op6_lyndon_suffix_dedup, op7_maxscore_top_k, op8_histogram_shards, op9_concat_cut_packing, op10_chat_round_trip, op11_conversation_repair, op12_token_alignment, op13_warc_archives)
}

_LOWER = f"translate({{text}}, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
_WORDS = f"regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_ESCAPED = "len(regexp_extract_all({x}, '\\\\|###|</turn>|: '))"

#: DuckDB's SQL for the queries that it can express; the others need its tests (hashes with seeds, tokenizers, models).
ORACLE_SQL: dict[str, str] = {
    "op1_fm_decontamination": f"""WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(text='text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, p.n, i FROM places p JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_maxscore_top_k": """WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT vec_id AS query_id, arg_min(q, embedding) AS a FROM v WHERE vec_id % 50 = 0 GROUP BY 1),
scored AS (SELECT query_id, vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(a), len(q)) + 1), lambda k: a[k] * q[k])), 0) AS BIGINT) AS score FROM asked JOIN v ON vec_id <> query_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_warc_archives": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER w AS place, first_value(page_id) OVER w AS top FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url NULLS FIRST)),
groups AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(sha1(html), CAST(5 * g + 1 AS INT), 5) AS INT)) AS v FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[CAST(1 + k // 4 AS INT)] >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
 CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to FROM groups""",
    "op10_chat_round_trip": f"""WITH turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT {PLANTED_CONV}, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '{PLANTED_TEXT}' FROM range(2) r(k)),
said AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS r, coalesce(text, '') AS t FROM turns),
sized AS (SELECT *, 14 + length(r) + length(t) + CASE WHEN contains(r, chr(92)) OR contains(r, ': ') OR contains(t, chr(92)) OR contains(t, '</turn>') OR contains(t, '###') THEN {_ESCAPED.format(x='r')} + {_ESCAPED.format(x='t')} ELSE 0 END AS n FROM said)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id""",
}
