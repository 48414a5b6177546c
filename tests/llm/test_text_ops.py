"""Decontamination, language model, toxicity and tokens."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from matchloom.llm import bitpack, ctw, fmdecon, packing, toxcnn
from matchloom.llm.tokens import Encoder, default_vocabulary

from .conftest import sha


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(texts, items, window=10):
    windows = {}
    for item, t in items:
        w = bench_words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, of = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    of |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(of), sha(",".join(sorted(of))), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 24, 900])
def test_decontamination(spark, make_docs, corpus, words, monkeypatch, block):
    monkeypatch.setattr(fmdecon, "BLOCK_BYTES", block)
    r = random.Random(9)
    items = [(k, " ".join((t or "").split()[5:40])) for k, t in enumerate(corpus[:20])] + [(100, None), (101, ""), (102, words[0] + " " + words[1]), (103, "DU du, du du"), (103, "e e e"), (None, " ".join((corpus[30] or "").split()[:12]))]
    items += [(200 + k, " ".join(r.choice(words) for _ in range(15))) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(corpus)
    got = {x["doc_id"]: tuple(x)[1:] for x in fmdecon.digests(fmdecon.decontaminate(docs, bench)).collect()}
    assert got == dict(enumerate(plain_hits(corpus, items)))
    cleaned = fmdecon.remove(docs, bench)
    assert cleaned.columns == docs.columns
    for x in cleaned.collect():
        if not got[x["doc_id"]][1]:
            assert x["text"] == corpus[x["doc_id"]]
        else:
            assert len(bench_words(x["text"])) == got[x["doc_id"]][0] - got[x["doc_id"]][1]
    assert fmdecon.decontaminate(docs, bench.limit(0)).where(F.size("spans") > 0).collect() == []
    assert fmdecon.decontaminate(docs.limit(0), bench).collect() == []


def test_fm_search_on_random_words():
    r = random.Random(2)
    for _ in range(200):
        letters = ["aA", "bé", "0z", "c", "D"]
        mk = lambda n: " ".join(r.choice(letters) for _ in range(n))
        items = [(k, r.choice([None, "", mk(r.randint(1, 7))])) for k in range(4)]
        texts = [r.choice([mk(r.randint(0, 30)), "", " .,"]) for _ in range(5)]
        window = r.choice([2, 3, 10])
        got = fmdecon.search_shard([t.encode() for t in texts], fmdecon.Windows(items, window))
        assert [(n, sum(b - a for a, b in s), len(i)) for n, s, i in got] == [x[:3] for x in plain_hits(texts, items, window)]


def test_scores(spark, make_docs, corpus):
    got = {r["doc_id"]: r for r in ctw.score(make_docs(corpus)).collect()}
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t in enumerate(corpus)}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 7 == 2}
    c = Counter(w for k, ws in tokens.items() if k not in held for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(corpus) and held
    for k, ws in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    assert got[corpus.index("")]["score"] == got[corpus.index(None)]["score"]
    assert ctw.score(make_docs(corpus).limit(0)).collect() == []


def small_tree(texts):
    """The model of ctw, built from plain dictionaries."""
    counts = {}
    for t in texts:
        s = [ctw.MARK] * ctw.DEPTH + list(t) + [ctw.MARK]
        for i in range(ctw.DEPTH, len(s)):
            for d in range(ctw.DEPTH + 1):
                context = tuple(s[i - d : i])
                for bit in range(8):
                    node = counts.setdefault((context, (1 << bit) | s[i] >> (8 - bit)), [0, 0])
                    node[s[i] >> (7 - bit) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    own, lw = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        context, prefix = key
        mine = kt(*counts[key])
        if len(context) == ctw.DEPTH:
            lw[key], own[key] = mine, 1.0
        else:
            below = sum(lw[k] for k in counts if len(k[0]) == len(context) + 1 and k[1] == prefix and k[0][1:] == context)
            lw[key] = np.logaddexp(mine, below) - math.log(2)
            own[key] = 1 / (1 + math.exp(min(700, below - mine)))
    return counts, own


def test_tree_against_plain_dictionaries(spark):
    texts = [b"abab", b"abac", b"b", "é".encode()]
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    tree = ctw.gather(ctw.weighted_nodes(ctw.count_training(docs)))
    counts, own = small_tree(texts)

    def plain(text):
        s = [ctw.MARK] * ctw.DEPTH + list(text) + [ctw.MARK]
        out = 0.0
        for i in range(ctw.DEPTH, len(s)):
            for bit in range(8):
                p = None
                for d in range(ctw.DEPTH, -1, -1):
                    key = (tuple(s[i - d : i]), (1 << bit) | s[i] >> (8 - bit))
                    if key in counts:
                        one = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
                        p = one if p is None else own[key] * one + (1 - own[key]) * p
                p = 0.5 if p is None else p
                out += math.log10(p if s[i] >> (7 - bit) & 1 else 1 - p)
        return out

    for t in (b"", b"abab", b"ba", b"zz", "é".encode()):
        got = ctw.Scorer(tree).score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert got == pytest.approx(plain(t), rel=5e-3)
    # a proper distribution over the next byte
    context = [ctw.MARK] * (ctw.DEPTH - 2) + list(b"ab")
    grams = sum(c << 8 * (ctw.DEPTH - k) for k, c in enumerate(context)) + np.arange(256)
    assert (10 ** tree.log10_of(grams)).sum() == pytest.approx(1.0)


def test_scores_are_those_of_exact_nodes(spark, make_docs, monkeypatch):
    monkeypatch.setattr(ctw, "BUCKET_BYTES", 16)  # many buckets
    texts = ["abab", "abac", "b", "é", "", None, "abab", "zzzz abac"] + [f"{k * 7919 % 1000} abab {k}" for k in range(30)]
    got = {r["doc_id"]: r for r in ctw.score(make_docs(texts)).collect()}
    counts, own = small_tree([(texts[k] or "").encode() for k in got if not got[k]["held_out"]])
    assert any(r["held_out"] for r in got.values())
    for k, t in enumerate(texts):
        s = [ctw.MARK] * ctw.DEPTH + list((t or "").encode()) + [ctw.MARK]
        out = 0.0
        for i in range(ctw.DEPTH, len(s)):
            for bit in range(8):
                p = None
                for d in range(ctw.DEPTH, -1, -1):
                    key = (tuple(s[i - d : i]), (1 << bit) | s[i] >> (8 - bit))
                    if key in counts:
                        one = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
                        p = one if p is None else own[key] * one + (1 - own[key]) * p
                p = 0.5 if p is None else p
                out += math.log10(p if s[i] >> (7 - bit) & 1 else 1 - p)
        assert got[k]["score"] == pytest.approx(out, rel=1e-5)


def test_the_sixth_byte_back_counts(spark):
    docs = spark.createDataFrame([(k, ("Xabcde1", "Yabcde2")[k % 2]) for k in range(100)], "doc_id long, text string")
    tree = ctw.gather(ctw.weighted_nodes(ctw.count_training(docs)))
    a, b = (ctw.Scorer(tree).score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"Xabcde1", b"Xabcde2"))
    assert a > b + 1


def test_chunks_and_parts_of_buckets_change_no_score(spark, make_docs, corpus, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in ctw.score(make_docs(corpus)).collect()}
    for name, value in {"CHUNK": 500, "RUN_BYTES": 200, "SOLVED": 20, "HELD": 50, "BUCKET_BYTES": 1000}.items():
        monkeypatch.setattr(ctw, name, value)
    cloudpickle.register_pickle_by_value(ctw)
    try:
        assert {r["doc_id"]: r["score"] for r in ctw.score(make_docs(corpus)).collect()} == pytest.approx(whole, rel=1e-6)
    finally:
        cloudpickle.unregister_pickle_by_value(ctw)


def test_toxicity(spark, make_docs, words):
    r = random.Random(8)
    bad = ["loweic", "loweit", "grumpf"]
    texts, labels = [], []
    for k in range(900):
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            t[r.randrange(len(t))] = r.choice(bad)
        texts.append(" ".join(t))
        labels.append((k, int(toxic)))
    docs = make_docs([*texts, "", None])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxcnn.train(toxcnn.labelled_sample(docs, table))
    got = {x["doc_id"]: x for x in toxcnn.score(docs, model).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k]["score"] >= 0.3) == bool(labels[k][1]) for k in held)
    assert right / len(held) > 0.9
    assert got[900]["score"] == got[901]["score"] and 0 <= got[900]["score"] <= 1
    constant = toxcnn.train(toxcnn.labelled_sample(docs, table.limit(0)))
    assert {x["score"] for x in toxcnn.score(docs, constant).collect()} == {0.0}
    assert toxcnn.score(docs.limit(0), model).collect() == []


def test_batches_score_as_single_texts():
    m = toxcnn.Model()
    ids = [toxcnn.word_ids(t) for t in (b"", b"a", b"a b c d", b"x y")]
    together = m.score(np.concatenate(ids), np.array([len(x) for x in ids]), m.tables())
    assert together == pytest.approx([m.score(x, np.array([len(x)]), m.tables())[0] for x in ids])


def naive_logit(m, ids):
    """The network, one window at a time."""
    x = m.e.astype(float)[ids].sum(axis=1)
    out = m.c
    for w, weight, b, v in zip(toxcnn.WIDTHS, m.w, m.b, m.v):
        values = np.array([sum(x[k + j] @ weight[j].astype(float) for j in range(w)) for k in range(len(ids) - 2)])
        out += float(np.maximum(values.max(axis=0) + b, 0) @ v)
    return out


def test_scores_are_those_of_a_naive_convolution():
    m = toxcnn.Model()
    for text in (b"", b"a", b"a b", b"some words and others in a row", "é à la".encode() * 30):
        ids = toxcnn.word_ids(text)
        assert m.score(ids, np.array([len(ids)]), m.tables())[0] == pytest.approx(1 / (1 + np.exp(-naive_logit(m, ids))), rel=1e-4)


def test_a_step_follows_the_gradient(monkeypatch):
    monkeypatch.setattr(toxcnn, "EPOCHS", 1)
    texts, y = [toxcnn.word_ids(b"good words here now"), toxcnn.word_ids(b"bad words there")], np.array([0.0, 1.0])
    before, after = toxcnn.Model(), toxcnn.Model()
    after.fit(texts, y)

    def loss():
        z = np.array([naive_logit(before, t) for t in texts])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def slope(array, at):
        old, step = array[at], 1e-3
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        return (up - down) / (2 * step)

    r = np.random.default_rng(0)
    cells = [(before.v, after.v, (i, j), 1) for i in range(3) for j in range(0, 8, 3)] + [(before.b, after.b, (i, j), 1) for i in range(3) for j in range(0, 8, 3)]
    cells += [(before.w[k], after.w[k], tuple(r.integers(0, s) for s in before.w[k].shape), 1) for k in range(3) for _ in range(10)]
    used = np.unique(np.concatenate([t.ravel() for t in texts]))
    cells += [(before.e, after.e, (int(r.choice(used[used > 0])), int(r.integers(0, toxcnn.WIDE))), 3) for _ in range(30)]
    seen = 0
    for old, new, at, times in cells:
        g = slope(old, at)
        wanted = -toxcnn.RATE * times * g / np.sqrt(1e-3 + g**2)
        assert new[at] - old[at] == pytest.approx(wanted, abs=2e-3 * toxcnn.RATE * times + 1e-5, rel=0.05)
        seen += abs(g) > 1e-4
    assert seen > 20


def test_thresholds():
    assert toxcnn.best_threshold(np.array([0.9, 0.8, 0.7, 0.6, 0.55, 0.1, 0.2]), np.array([1, 1, 1, 1, 1, 0, 0])) == pytest.approx((0.55 + 0.2) / 2)
    assert toxcnn.best_threshold(np.array([0.9, 0.1]), np.array([1, 0])) == toxcnn.DEFAULT_THRESHOLD


ODD = ["it's 'tis don't we'll 'll  x'd's's 'sab", "a  b", "a \n b", "a\n\nb  ", "''s", "é’s ½ ²3 a1b2", "　x　　y", "I'LL 've'", "z'r", "日本語 テキスト🙂🙂 'm", "\x1c\x1f a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", " "]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_is_the_librarys(corpus):
    r = random.Random(1)
    texts = [*(t or "" for t in corpus), *ODD, *("".join(r.choice(" \n\t'sStrevmlld.,1é½  🙂") for _ in range(r.randint(0, 14))) for _ in range(1500))]
    ids, counts = Encoder(default_vocabulary()).encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library(texts)


def test_all_code_points_and_hashes_that_collide(monkeypatch):
    points = [chr(c) for c in range(0x33480) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[k : k + 50]) for k in range(0, len(points), 50)] + [f"a{c} b" for c in points[:3000]]
    wanted = library(texts)
    ids, counts = Encoder(default_vocabulary()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted
    exact = Encoder.hashes
    monkeypatch.setattr(Encoder, "hashes", lambda self, p, b: exact(self, p, b) % np.uint64(7))
    few = Encoder(default_vocabulary())
    for k in (0, 4000):
        ids, counts = few.encode(texts[k : k + 300])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted[k : k + 300]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bit_packing(spark, make_docs, corpus):
    r = np.random.default_rng(1)
    for bits in (1, 5, 8, 13, 16, 17, 32):
        ids = r.integers(0, 1 << bits, 1000).astype(np.uint32)
        data = bitpack.pack(ids, bits)
        assert len(data) == -(-1000 * bits // 8) and (bitpack.unpack(data, bits, 1000) == ids).all()
    assert bitpack.width(50257) == 16
    shard = bitpack.Reader(bitpack.image([7, None, 9], np.array([3, 0, 9000]), np.arange(9003) % 300, 9))
    assert shard.read(4090, 4100).tolist() == [x % 300 for x in range(4090, 4100)] and shard.document(1).tolist() == [] and shard.doc_ids == [7, None, 9]
    docs = make_docs(corpus).orderBy(F.rand(3))
    got = [tuple(x) for x in bitpack.read_shards(bitpack.write_shards(docs, default_vocabulary(), 50257, 2)).orderBy("doc_id").collect()]
    at, wanted = 0, []
    for k, ids in enumerate(library([t or "" for t in corpus])):
        wanted.append((k, at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    assert got == wanted
    assert bitpack.read_shards(bitpack.write_shards(docs.limit(0), default_vocabulary(), 50257, 2)).collect() == []


def test_packing(spark, make_docs, corpus):
    docs = make_docs(corpus)
    rows = packing.pack_sequences(packing.tokenized(docs.repartition(3), default_vocabulary(), 0), 64).collect()
    ids = [[*x, 0] for x in library([t or "" for t in corpus])]
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for k, own in enumerate(ids):
        at = 0
        for x in sorted(by_doc[k], key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(own) and x["ids_crc32"] == crc(own[at : at + x["length"]])
            at += x["length"]
        assert at == len(own)
    total = sum(map(len, ids))
    assert sorted(by_seq) == list(range(-(-total // 64)))
    for s, pieces in by_seq.items():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at == (64 if s < total // 64 else total % 64)
    assert packing.pack_sequences(packing.tokenized(docs.limit(0), default_vocabulary(), 0)).collect() == []


def test_toxicity_learns_from_all_labelled_rows(spark, make_docs, words, monkeypatch):
    """Over many parts, a rare word of one part is learned; every part is, and thresholds count every row kept out."""
    monkeypatch.setattr(toxcnn, "PART_ROWS", 150)
    r = random.Random(4)
    bad = ["loweic", "grumpf"]
    texts, labels = [], []
    for k in range(1200):
        t = [r.choice(words) for _ in range(r.randint(5, 40))]
        if k % 3 == 0:
            t[r.randrange(len(t))] = bad[k % 2]
        texts.append(" ".join(t))
        labels.append((k, int(k % 3 == 0)))
    docs, table = make_docs(texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    learned, counted = [], []
    deal, count = toxcnn.dealt, toxcnn.thresholds
    monkeypatch.setattr(toxcnn, "dealt", lambda rows, parts: learned.append((rows.count(), parts)) or deal(rows, parts))
    monkeypatch.setattr(toxcnn, "thresholds", lambda rows: counted.append(rows.count()) or count(rows))
    rows = toxcnn.labelled_sample(docs, table)
    assert rows.count() == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(1200))
    got = {x["doc_id"]: x["score"] for x in toxcnn.score(docs, toxcnn.train(rows)).collect()}
    assert learned[0][0] + counted[0] == rows.count() and learned[0][1] > 4
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= 0.3) == bool(labels[k][1]) for k in held) / len(held) > 0.9


def test_thresholds_by_counts(spark):
    r = np.random.default_rng(2)
    scores, labels = r.random(300).round(2), (r.random(300) < 0.4).astype(int)
    rows = spark.createDataFrame([("a" if k % 2 else None, float(x), int(y)) for k, (x, y) in enumerate(zip(scores, labels))], "lang string, score double, toxic int")
    got = toxcnn.thresholds(rows)
    assert got == {lang: pytest.approx(toxcnn.best_threshold(scores[k::2], labels[k::2])) for k, lang in ((1, "a"), (0, None))}
