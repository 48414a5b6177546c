"""Cross-tokenizer alignment against the libraries and a plain count."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from matchloom.llm import alignment
from matchloom.llm.common import BATCH_BYTES, batches_of
from matchloom.llm.queries import QUERIES
from matchloom.llm.tokens import PieceEncoder, byte_alphabet, default_pieces, default_vocabulary


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=default_pieces())


ODD = ["", None, " ", "  ", "\n", "a", "a b", " lead  and trail ", "x▁y", "▁", "<|endoftext|> and <s> </s> <unk> <0x0A>", "tab\tline\r\n\n\nend", "日本語 текст ünï 🙂👍🏽 é", "\x00\x01 nul", "it's we'll don't", "x" * 3000, " nb em", "ﬁ ① Ａ", "a " * 500, "\n" * 50 + "y", "1234567890 3.14 $%&"]


def texts_of(corpus):
    r = random.Random(2)
    mixed = ["".join(r.choice("abe é\n\t .,'<>|▁日ß🙂0") for _ in range(r.randint(1, 60))) for _ in range(150)]
    return ODD + mixed + corpus


def plain(texts, libraries):
    a, b = libraries
    back = {c: k for k, c in byte_alphabet().items()}
    rows, counts = [], Counter()
    for text in texts:
        ends, ids = [], []
        if text:
            whole = (" " + text).encode()
            one = a.encode(" " + text, add_special_tokens=False)
            two = b.encode(text)
            said = [[bytes(back[c] for c in t) for t in one.tokens], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(two, b.encode(text, out_type=str), strict=True)]]
            if all(b"".join(s) == whole for s in said):
                ids = [one.ids, two]
                for s in said:
                    at, own = 0, []
                    for t in s:
                        at += len(t)
                        own.append(at)
                    ends.append(own)
        if not ids:
            rows.append(None)
            continue
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, pairs, low = [], [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[k], ends[k], strict=True) if low < e <= c) for k in (0, 1)))
            pairs.append(tuple(ids[k][ends[k].index(c)] for k in (0, 1)))
            low = c
        counts.update(pairs)
        rows.append((len(ids[0]), len(ids[1]), groups, pairs))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    zeros = (0, 0, 0, 0, 0, 0, "")
    return [zeros if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in rows]


def test_pieces_are_the_librarys(corpus, libraries):
    of = PieceEncoder(default_pieces())
    texts = [t for t in texts_of(corpus) if t and "▁" not in t]
    ids, counts = of.plain([f" {t}" for t in texts])
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == libraries[1].encode(t)
        at += n


@pytest.mark.parametrize(("hot", "size"), [(1 << 17, 1 << 20), (40, 300)])
def test_alignment(make_docs, corpus, libraries, monkeypatch, hot, size):
    """Pairs looked up by broadcast and by a join, texts tokenized together and alone."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "TEXT_BYTES", size)
    texts = texts_of(corpus)
    found = alignment.digests(alignment.align(alignment.tokenized(make_docs(texts), default_vocabulary(), default_pieces())))
    assert {x["doc_id"]: tuple(x)[1:] for x in found.collect()} == dict(enumerate(plain(texts, libraries)))


def test_odd_tables(spark, make_docs, libraries):
    run = lambda docs: alignment.digests(alignment.align(alignment.tokenized(docs, default_vocabulary(), default_pieces())))
    assert run(make_docs([]).limit(0)).collect() == []
    assert [tuple(x) for x in run(make_docs([None])).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]
    same = make_docs(["one text", "one text", "NOID"]).withColumn("doc_id", F.when(F.col("text").isNotNull(), 5)).withColumns({"row": F.lit(1), "a": F.lit("x"), "held": F.lit(2), "cuts": F.lit(0)})
    assert sorted(tuple(x)[1:] for x in run(same).collect()) == sorted(plain(["one text", "one text", None], libraries))


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip([x["doc_id"] for x in rows], plain([x["text"] for x in rows], libraries), strict=True))
    assert {x["doc_id"]: tuple(x)[1:] for x in QUERIES["op12_token_alignment"](spark, sf).collect()} == wanted


def test_arrays_are_compiled(make_docs):
    """No array that the alignment reads or gives may hold nulls, and none of its functions takes a lambda: Spark would interpret it."""
    aligned = alignment.align(alignment.tokenized(make_docs(["one text", None]), default_vocabulary(), default_pieces()))
    assert [f.dataType.containsNull for f in aligned.schema if f.dataType.typeName() == "array"] == [False, False]
    assert "lambda" not in aligned._jdf.queryExecution().optimizedPlan().toString()


def test_spell():
    """Texts with one group, none, and two groups of several tokens, ids of one digit and of six."""
    mark = alignment.MARK
    a = np.array([1 << 20 | 7, 1 << 20 | mark, 1 << 20 | 0, 2 << 20 | 123456, 2 << 20 | mark, 3 << 20 | 5, 3 << 20 | mark])
    b = np.array([1 << 20 | 8, 1 << 20 | mark, 2 << 20 | 10, 2 << 20 | mark, 2 << 20 | 9, 3 << 20 | 0, 3 << 20 | mark])
    text, stops, links = alignment.spell(a, b, np.array([1, 0, 2]))
    assert [text[i:j] for i, j in zip([0, *stops.tolist()], stops.tolist(), strict=False)] == [b"7|8", b"", b"0,123456|10;5|9,0"]
    assert links.tolist() == [7 << 32 | 8, 123456 << 32 | 10, 5 << 32 | 0]


def test_small_batches(spark, make_docs):
    """Marked tokens reach Python in small batches, and the session's own bound stands again behind that."""
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches)
    bound = spark.conf.get(BATCH_BYTES)
    aligned = alignment.align(alignment.tokenized(make_docs(["some words of a text " * 20] * 40).coalesce(1), default_vocabulary(), default_pieces()))
    with batches_of(spark, 20_000):
        assert max(x["bytes"] for x in aligned.mapInArrow(sizes, "bytes long").collect()) < 30_000
    assert spark.conf.get(BATCH_BYTES) == bound
