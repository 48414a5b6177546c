"""SimHash components and suffix-array dedup against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from matchloom.llm import gsaca, simhash

from .conftest import sha


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if bin(x ^ values[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_components(spark, make_docs, corpus):
    docs = make_docs(corpus)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in corpus]
    assert got == {k: (f, c) for k, (f, c) in enumerate(zip(fps, plain_components(fps)))}


def plain_groups(texts, n=5, least=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= least * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_one_of_each_group_stays(spark, make_docs, corpus):
    docs = make_docs(corpus)
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(plain_groups(corpus)))
    assert kept.columns == docs.columns and simhash.keep_one(docs.limit(0)).collect() == []


def test_ids_that_are_missing_or_shared_lose_nothing(spark, words):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(words) for _ in range(40))) for k in (None, None, None, 5, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == sorted(rows, key=str)
    assert simhash.keep_one(docs.unionByName(docs)).count() == 6


def test_repeated_rows_and_missing_ids(spark, make_docs):
    docs = make_docs(["one two three four", "NOID", "one two three four"]).unionByName(make_docs(["one two three four"]))
    assert simhash.near_duplicates(docs).count() == 4
    assert [r["doc_id"] for r in simhash.keep_one(docs).where("text IS NOT NULL").collect()] == [0]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_near_copies_of_five_words(spark, make_docs, words):
    import corpus_pipeline

    r = random.Random(3)
    texts = []
    for _ in range(20):
        w = [r.choice(words) for _ in range(120)]
        changed = [*w[:60], "changed", "twice", *w[62:]]  # Jaccard 110 / 122
        texts += [" ".join(w), " ".join(changed), " ".join([*w[:40], *(r.choice(words) for _ in range(40)), *w[80:]])]
    docs = make_docs(texts)
    kept = sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert kept == [k for k in range(60) if k % 3 != 1]
    assert any(simhash.differing(*simhash.fingerprints([texts[k].encode(), texts[k + 1].encode()])[:, None])[0] > simhash.DIFFER for k in range(0, 60, 3))
    same = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.near_dedup(spark, same, "").count() == 40


def test_wide_signatures():
    import pyarrow as pa

    how = simhash.plan(1000)
    r = np.random.default_rng(1)
    a = r.integers(-(1 << 63), 1 << 63, how.words)
    b = a.copy()
    b[1] ^= 1 << 20  # the second segment
    batch = pa.RecordBatch.from_pydict({"node": [1, 2]} | {f"w{k}": np.array([a[k], b[k]]) for k in range(how.words)})
    out = next(simhash.wide_signatures([batch], how))
    sig = out.column("sig").to_numpy().reshape(-1, 2)
    assert len(sig) == how.segments * how.bits and len(np.unique(sig[:, 0])) == len(sig)
    assert (sig[:, 0] != sig[:, 1]).sum() == how.bits - 1


def test_plan_grows_with_the_texts():
    plans = [simhash.plan(n) for n in (0, 1, 1 << 22, 1 << 23, 1 << 30)]
    assert plans[0] == plans[1] == plans[2] and [p.bits for p in plans[2:]] == [16, 17, 24]
    assert all(64 // p.bits * (p.words - 1) >= p.segments for p in plans)


def altered(r, words, w, n):
    """w with n single words changed, far from each other: each takes five shingles away and brings five."""
    out = list(w)
    for k in r.sample(range(len(w) // 12), n):
        out[12 * k + 6] = "".join(r.choice("xyz") for _ in range(9))
    return out


def test_similar_texts_meet(spark, make_docs, words):
    """Nine of ten pairs of a similarity of 0.80 to 0.85 are found, and pairs below are left alone."""
    r = random.Random(8)
    texts = []
    for k in range(300):
        w = [r.choice(words) for _ in range(r.randint(300, 500))]
        n = int((len(w) - 4) * r.uniform(0.163, 0.199) / 1.83 / 5) if k % 3 else int((len(w) - 4) * 0.29 / 1.7 / 5)
        texts += [" ".join(w), " ".join(altered(r, words, w, n))]
    groups = plain_groups(texts)
    near = [k for k in range(1, len(texts), 2) if groups[k] == k - 1]
    kept = {x["doc_id"] for x in simhash.keep_one(make_docs(texts)).select("doc_id").collect()}
    assert len(near) >= 150 and len([k for k in near if k not in kept]) >= 0.9 * len(near)
    assert kept >= set(range(len(texts))) - set(near)


def test_recall_on_whole_documents(spark):
    """Nine of ten texts with another one of a similarity of 0.8 go, held against all pairs; no group goes whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    ids = {}
    for x in docs.orderBy("doc_id").collect():
        ids.setdefault(simhash.shingle_set((x["text"] or "").encode()).tobytes(), []).append(x["doc_id"])
    sets = [np.frombuffer(k, np.uint64) for k in ids]
    often = Counter(h for s in sets for h in s.tolist())
    seen, root = {}, list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        rare = sorted(sets[k].tolist(), key=lambda h: (often[h], h))[: len(sets[k]) - math.ceil(0.8 * len(sets[k])) + 1]
        for c in {c for h in rare for c in seen.get(h, ())}:
            if simhash.similar(sets[c], sets[k]):
                root[find(c)] = find(k)
        for h in rare:
            seen.setdefault(h, []).append(k)
    groups = {}
    for k, own in enumerate(ids.values()):
        groups.setdefault(find(k), []).extend(own)
    kept = {x["doc_id"] for x in simhash.keep_one(docs).select("doc_id").collect()}
    surplus = len(sets) - len(groups)
    assert surplus >= 30 and len(sets) - len(kept) >= 0.9 * surplus
    assert all(kept & set(g) for g in groups.values())


def test_pairs_of_pairs_stay_apart(spark, make_docs, words):
    """Two pairs of near copies that resemble each other at less than the least similarity are two groups."""
    r = random.Random(4)
    texts = []
    for _ in range(40):
        w = [r.choice(words) for _ in range(600)]
        other = altered(r, words, w, 15)
        texts += [" ".join(w), " ".join([*w, "end"]), " ".join(other), " ".join([*other, "end"])]
    groups = plain_groups(texts)
    assert len(set(groups)) == 80
    kept = simhash.keep_one(make_docs(texts)).select("doc_id").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(groups))


def test_a_chance_neighbour_hides_no_link():
    import pyarrow as pa

    fps = np.array([0, (1 << 16) - 1, (1 << 16) - 2], np.int64)  # the first is within NEAR bits of both
    batch = pa.RecordBatch.from_pydict({"sig": np.zeros(3, np.int64), "node": np.arange(3), "fp": fps})
    (out,) = simhash.meetings([batch])
    assert list(zip(out.column("u").to_pylist(), out.column("v").to_pylist())) == [(0, 1), (0, 2), (1, 2)]


@pytest.mark.parametrize(("run", "block", "pairs"), [(8, 4, 0), (40, 1024, 0), (8192, 1024, 16)])
def test_runs_with_many_pairs(spark, make_docs, words, monkeypatch, run, block, pairs):
    """Families of near copies, some just above and some just below the least similarity to a leader, in runs of any length."""
    for name, value in (("RUN", run), ("BLOCK", block), ("PAIRS", pairs)):
        monkeypatch.setattr(simhash, name, value)
    cloudpickle.register_pickle_by_value(simhash)
    try:
        r = random.Random(6)
        texts = []
        for _ in range(3):
            w = [r.choice(words) for _ in range(400)]
            family = [w]
            for _ in range(30):
                family.append(altered(r, words, r.choice(family), r.randint(1, 6)))
            texts += [" ".join(f) for f in family]
        texts += [" ".join(r.choice(words) for _ in range(30)) for _ in range(20)]
        kept = {x["doc_id"] for x in simhash.keep_one(make_docs(texts)).select("doc_id").collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(simhash)
    wanted = set(plain_groups(texts))
    assert kept >= wanted and len(kept - wanted) <= 2


def test_a_large_group_of_near_copies_is_compared_in_a_few_pairs_a_text(spark, make_docs, words, monkeypatch):
    r = random.Random(9)
    w = [r.choice(words) for _ in range(300)]
    texts = [" ".join(w), *(" ".join(altered(r, words, w, r.randint(1, 3))) for _ in range(300))]
    compared, linked = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda near, rows: compared.append(near.count()) or linked(near, rows))
    kept = [x["doc_id"] for x in simhash.keep_one(make_docs(texts)).select("doc_id").collect()]
    assert kept == [0] and sum(compared) <= 8 * len(texts)


def test_runs_beyond_the_bound_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 3)
    cloudpickle.register_pickle_by_value(simhash)
    try:
        r = random.Random(1)
        base = [r.getrandbits(64) for _ in range(12)]
        values = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for b in base for _ in range(12)})
        signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
        got = {tuple(x) for x in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(simhash)
    roots = plain_components([v & (1 << 64) - 1 for v in signed])
    assert got == {(signed[i], signed[k]) for i, k in enumerate(roots) if i != k}


def test_suffix_array():
    r = random.Random(3)
    for _ in range(800):
        s = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 40))] + [0]
        assert gsaca.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_strings():
    r = random.Random(4)
    for _ in range(120):
        n = r.choice([12, 40, 60])
        letters = r.choice([b"ab", b"abcd ", bytes(range(97, 123))])
        base = [bytes(r.choice(letters) for _ in range(r.randint(n, 3 * n))) for _ in range(3)]
        units = [b"".join(r.choice(base)[r.randint(0, n) :][: r.randint(1, 2 * n)] for _ in range(3)) + bytes(r.choice(letters) for _ in range(n)) for _ in range(r.randint(1, 6))]
        counts = [len(u) - n + 1 for u in units]
        seen = {}
        for u, c in zip(units, counts):
            for i in range(c):
                seen[u[i : i + n]] = seen.get(u[i : i + n], 0) + 1
        assert gsaca.repeated(units, counts, n).tolist() == [seen[u[i : i + n]] > 1 for u, c in zip(units, counts) for i in range(c)]


@pytest.mark.parametrize("kept", [4, 1])
def test_hashes_that_collide_change_nothing(monkeypatch, kept):
    exact = gsaca.Rolling.of
    monkeypatch.setattr(gsaca.Rolling, "of", lambda self, a, b: exact(self, a, b) & np.uint64((1 << kept) - 1 << 64 - kept))
    test_repeated_strings()


def test_the_suffix_array_decides(monkeypatch):
    monkeypatch.setattr(gsaca, "suffix_array", lambda s: [len(s) - 1, *range(len(s) - 1)])
    with pytest.raises(AssertionError):
        test_repeated_strings()


def test_common_prefixes():
    r = random.Random(6)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(48, np.uint8))), 8)
    a, b = np.array([r.randrange(250) for _ in range(400)]), np.array([r.randrange(250) for _ in range(400)])
    limit = np.array([r.randrange(40) for _ in range(400)])
    wanted = [next((k for k in range(n) if data[x + k] != data[y + k]), n) for x, y, n in zip(a.tolist(), b.tolist(), limit.tolist())]
    assert gsaca.common(words, a, b, limit).tolist() == wanted
    low = gsaca.Lowest(a)
    begin = np.array([r.randrange(399) for _ in range(300)])
    end = np.array([r.randint(x + 1, 400) for x in begin])
    assert low.of(begin, end).tolist() == [int(a[x:y].min()) for x, y in zip(begin, end)]


def plain_dedup(texts, n=gsaca.LENGTH):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup(spark, make_docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(gsaca, "HOT", hot)
    cloudpickle.register_pickle_by_value(gsaca)
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in gsaca.digests(make_docs(corpus)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(gsaca)
    assert got == dict(enumerate(plain_dedup(corpus)))


def test_suffix_removal_of_another_length(spark, make_docs, corpus):
    docs = make_docs(corpus)
    out = {r["doc_id"]: r["text"] for r in gsaca.remove(docs, 100).collect()}
    gone = plain_dedup(corpus, 100)
    assert all(len((out[k] or "").encode()) <= gone[k][0] - gone[k][1] for k in range(len(corpus))) and sum(g[1] for g in gone) > sum(g[1] for g in plain_dedup(corpus))
    assert all(sha(out[k] or "") == gone[k][3] for k in range(len(corpus)) if (corpus[k] or "").isascii())


def test_suffix_removal_keeps_columns(spark, make_docs, corpus):
    docs = make_docs(corpus)
    out = {r["doc_id"]: r for r in gsaca.remove(docs).collect()}
    assert len(out) == len(corpus) and gsaca.remove(docs).columns == docs.columns
    assert out[0]["text"] == ("" if len(corpus[0].encode()) >= 400 else corpus[0])
    assert gsaca.digests(docs.limit(0)).collect() == []
