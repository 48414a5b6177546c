"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own: node (context of d bytes, bits of this byte so far)
holds how often a zero and a one followed in the training texts. The Krichevsky-Trofimov estimates of all depths are mixed
by their weights for the training texts, computed from the deepest level upward. A context that
training never saw leaves the estimate to the next shorter one, so each decision stays a proper distribution and so does
the text: it is read from a start mark to an end mark.

Counting and weighting are distributed, and nodes are exact: each is known by its whole context. Texts are read in
chunks, whose distinct grams (a byte and its context) go to buckets by the last ``DEALT`` bytes of the context. A bucket
has all nodes of its contexts, weights them, hands the sums up to the shorter contexts and sends the log probability of
each gram back to the chunks that asked, in the order of the chunk's grams, which the chunk finds again. Only the nodes of contexts shorter than ``DEALT`` bytes are broadcast, of which
there are fewer than 2**24 whatever the corpus; all others stay in the buckets, whose number grows with the texts.
Words are known by a 64-bit hash.

Defined results: null text is an empty text, whose score is that of the end mark; null doc_id is scored and learned from
as one that is not held out; repeated rows count as often as they come; without training texts each bit costs one bit;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_table, shuffle_partitions, slices, stash, trimmed, unstash, utf8

DEPTH = 6
#: Contexts of this many bytes are dealt whole, so that all deeper levels need no exchange.
DEALT = 3
#: Bytes of text whose grams are looked up together, and bytes of all texts for each bucket.
CHUNK = 1 << 24
BUCKET_BYTES = 1 << 22
MARK = 0xFF  # never a byte of UTF-8: start and end of a text
RUN_BYTES = 1 << 19
#: A word of at least this share of all tokens is looked up in a broadcast table, which so has 2**20 rows (16 MB) at most.
HEAD_SHARE = 2**-20
LOWER = lower_table()
GRAM, WORD, TEXTS, TEXT = 0, 1, 2, 3
HELD = 1_500_000
SOLVED = 250_000
HELD_WORDS = 200_000


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (and end mark) with the DEPTH bytes before it, packed, and where each text's start."""
    sizes = np.diff(offsets)
    step = sizes + DEPTH + 1
    stops = np.cumsum(step)
    padded = np.full(int(stops[-1]), MARK, np.uint8)
    begin = stops - step + DEPTH
    places = np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])
    padded[places] = data
    key = np.zeros(len(padded) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        key = key << 8 | padded[k : k + len(key)]
    # drop those that end in a start mark
    keep = np.repeat(begin - DEPTH - np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), sizes + 1) + np.arange(int((sizes + 1).sum()))
    return key[keep], np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))


def word_counts(text: bytes) -> Counter:
    return Counter(text.translate(LOWER).split())


def word_keys(words) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def turned(key: np.ndarray) -> np.ndarray:
    """Grams with the last DEALT bytes of the context in front."""
    old = 8 * (DEPTH - DEALT)
    return (key >> 8 & (1 << 8 * DEALT) - 1) << old + 8 | key >> 8 * DEALT + 8 << 8 | key & 255


def unturned(key: np.ndarray) -> np.ndarray:
    old = 8 * (DEPTH - DEALT)
    return (key >> 8 & (1 << old) - 1) << 8 * DEALT + 8 | key >> old + 8 << 8 | key & 255


def folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    found, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return found, np.bincount(where, np.concatenate([n for _, n in held]), len(found)).astype(np.int64)


def pack_grams(key: np.ndarray, n: np.ndarray) -> bytes:
    import zstandard

    part = (np.diff(key, prepend=0).astype("<i8"), n.astype("<u4"))
    return zstandard.compress(b"".join(x.view(np.uint8).reshape(len(key), -1).T.tobytes() for x in part), 1)


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // 12
    key = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(key), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


COUNTED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("rid", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def distinct(key: np.ndarray) -> np.ndarray:
    """Distinct keys in order, by a sort (np.unique hashes, which is slower for keys that fill no cache)."""
    key = np.sort(key)
    return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key


def pack_rows(rows: pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES + 1)


def by_bucket_order(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted turned grams by bucket, and the bucket of each in that order."""
    with np.errstate(over="ignore"):
        mixed = (key >> 8 * (DEPTH - DEALT) + 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def count_training(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """A stashed table of four kinds of rows: packed grams of a chunk and bucket, words, numbers of texts, and packed runs of texts with their chunk.

    Texts that are held out (column held_out, if there is one) count nothing, so their grams come with the count 0.
    """
    held_out_ = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out_.alias("held_out"), "text")
    buckets = buckets or bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()
        texts = size = base = read = 0
        chunk = None

        def row(kind: int, rows: int, **columns) -> pa.RecordBatch:
            columns |= {"kind": np.full(rows, kind)}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in COUNTED], schema=COUNTED)

        def dealt() -> pa.RecordBatch:
            key, n = folded(held)
            order, bucket = by_bucket_order(key, buckets)
            key, n = key[order], n[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            data = [pack_grams(key[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return row(GRAM, len(data), chunk=np.full(len(data), chunk), bucket=bucket[cut[:-1]], data=data)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(offsets, RUN_BYTES):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                rows_ = batch.slice(i, j - i)
                if chunk is None:
                    chunk = rows_.column("rid")[0].as_py()
                yield row(TEXT, 1, chunk=[chunk], rid=rows_.column("rid")[:1], data=[pack_rows(rows_)])
                key = turned(grams(part, bounds)[0])
                apart = np.repeat(out[i:j], np.diff(bounds) + 1)
                for g, counted in ((key[~apart], 1), (key[apart], 0)):
                    if len(g):
                        g, n = np.unique(g, return_counts=True)
                        held.append((g, n * counted))
                        size += len(g)
                if size > 2 * base + HELD:
                    held = [folded(held)]
                    size = base = len(held[0][0])
                read += len(part)
                if read > CHUNK:
                    yield dealt()
                    held, size, base, read, chunk = [], 0, 0, 0, None
                texts += int((~out[i:j]).sum())
                for k in np.flatnonzero(~out[i:j]).tolist():
                    words.update(part[bounds[k] : bounds[k + 1]].tobytes().translate(LOWER).split())
                if len(words) > HELD_WORDS:
                    yield row(WORD, len(words), key=word_keys(list(words)), n=list(words.values()))
                    words = Counter()
        if held:
            yield dealt()
        if words:
            yield row(WORD, len(words), key=word_keys(list(words)), n=list(words.values()))
        if texts:
            yield row(TEXTS, 1, key=[0], n=[texts])

    fields = "kind int, chunk long, bucket int, data binary, rid long, key long, n long"
    return stash(rows.mapInArrow(trimmed(run), fields), "counts")


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series five steps up; z >= 1/2."""
    s = z + 5.0
    series = (s - 0.5) * np.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s**3) + 1 / (1260 * s**5)
    return series - np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def deepest(key: np.ndarray, n: np.ndarray) -> Level:
    """Nodes of the deepest level from counted grams: node, zeros, ones, log weighted probability, weight of the own
    estimate, and at which of the nodes each bit of each gram (or each node of the next deeper level) is.

    A node is its context << 8 | the bits of the byte so far behind a leading 1.
    """
    context, byte = key >> 8, key & 255
    node = np.concatenate([context << 8 | (1 << bit) | byte >> (8 - bit) for bit in range(8)])
    one = np.concatenate([byte >> (7 - bit) & 1 for bit in range(8)]).astype(bool)
    many = np.tile(n, 8)
    found, where = np.unique(node, return_inverse=True)
    n0 = np.bincount(where, np.where(one, 0, many), len(found))
    n1 = np.bincount(where, np.where(one, many, 0), len(found))
    return found, n0, n1, log_kt(n0, n1), np.ones(len(found)), where


def shorter(depth: int, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, lw: np.ndarray) -> Level:
    """The level of contexts of ``depth`` bytes from the next deeper one."""
    parent = (node >> 8 & (1 << 8 * depth) - 1) << 8 | node & 255
    found, where = np.unique(parent, return_inverse=True)
    n0, n1, below = (np.bincount(where, x, len(found)) for x in (n0, n1, lw))
    kt = log_kt(n0, n1)
    both = np.logaddexp(kt, below)
    return found, n0, n1, both - math.log(2), np.exp(kt - both), where


NODES = "depth int, node long, n0 double, n1 double, lw double, own double"


def subtree(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels from DEPTH to DEALT of whole contexts of DEALT bytes. A gram that was not counted makes nodes without counts, which weigh nothing."""
    levels = [deepest(key, n)]
    for d in range(DEPTH - 1, DEALT - 1, -1):
        levels.append(shorter(d, *levels[-1][:4]))
    return levels


def node_rows(depth: int, level: Level) -> pa.RecordBatch:
    columns = [np.full(len(level[0]), depth, np.int32), *level[:5]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["depth", "node", "n0", "n1", "lw", "own"])


def climb(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Summed nodes of one level (node, n0, n1, below) to that level."""
    for b in batches:
        if len(b):
            node, n0, n1, below = (b.column(c).to_numpy() for c in ("node", "n0", "n1", "below"))
            kt = log_kt(n0, n1)
            both = np.logaddexp(kt, below)
            yield node_rows(depth, (node, n0, n1, both - math.log(2), np.exp(kt - both)))


def by_bucket(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("kind") == GRAM).select("bucket", "chunk", "data").repartition("bucket").sortWithinPartitions("bucket")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, chunks, packed grams) of each bucket; rows are sorted by bucket."""
    now, chunks, data = None, [], []
    for b in batches:
        for bucket, chunk, one in zip(b.column("bucket").to_pylist(), b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
            if bucket != now and chunks:
                yield now, chunks, data
                chunks, data = [], []
            now = bucket
            chunks.append(chunk)
            data.append(one)
    if chunks:
        yield now, chunks, data


def summed(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of packed ones (turned, in order) and their counts."""
    held, size, base = [], 0, 0
    for one in data:
        held.append(unpack_grams(one))
        size += len(held[-1][0])
        if size > 2 * base + HELD:
            held = [folded(held)]
            size = base = len(held[0][0])
    return folded(held)


def whole_contexts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of turned grams of about SOLVED each that share no context of DEALT bytes."""
    suffix = key >> 8 * (DEPTH - DEALT) + 8
    a = 0
    while a < len(key):
        b = len(key) if len(key) - a <= SOLVED else int(np.searchsorted(suffix, suffix[a + SOLVED], side="right"))
        yield a, b
        a = b


def weighted_nodes(counts: DataFrame, below: int = DEPTH + 1) -> DataFrame:
    """All nodes of contexts of fewer than ``below`` bytes."""

    def deep(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
        for _, _, data in buckets_of(batches):
            key, n = summed(data)
            key, n = key[n > 0], n[n > 0]
            for a, b in whole_contexts(key):
                for d, level in zip(range(DEPTH, DEALT - 1, -1), subtree(unturned(key[a:b]), n[a:b]), strict=True):
                    if d < top:
                        yield node_rows(d, level)

    found = stash(by_bucket(counts).mapInArrow(trimmed(partial(deep, top=max(below, DEALT + 1))), NODES), "ctw")
    out = found
    for depth in range(DEALT - 1, -1, -1):
        parent = F.expr(f"shiftleft(shiftright(node, 8) & {(1 << 8 * depth) - 1}L, 8) | (node & 255)")
        low = found.where(F.col("depth") == depth + 1)
        up = low.groupBy(parent.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        found = stash(up.mapInArrow(trimmed(partial(climb, depth=depth)), NODES), "ctw")
        out = out.unionByName(found)
    return out.where(F.col("depth") < below)


def mixed(p: np.ndarray, one: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Probabilities of a one from longer contexts (NaN: none was seen) with those of the next shorter one."""
    return np.where(np.isnan(p), one, np.where(np.isnan(one), p, own * one + (1 - own) * p))


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Probability of a one; NaN for a node that training never saw."""
    return np.where(n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1), np.nan)


def log10_bits(byte: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probabilities of a one at each of its bits (8, n)."""
    p = np.where(np.isnan(p), 0.5, p)
    one = byte >> np.arange(7, -1, -1)[:, None] & 1
    return np.log10(np.where(one, p, 1 - p)).sum(axis=0)


class Tree:
    """Nodes by depth: sorted keys, probability of a one, weight of the node's own estimate."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    def look(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one (NaN: never seen) and own weight."""
        known, one, own = self.levels.get(depth, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
        if not len(known):
            return np.full(len(node), np.nan), np.ones(len(node))
        at = np.minimum(np.searchsorted(known, node), len(known) - 1)
        same = known[at] == node
        return np.where(same, one[at], np.nan), np.where(same, own[at], 1.0)

    arranged = staticmethod(lambda gram: gram)

    def log10_of(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after those before it."""
        byte, context = gram & 255, gram >> 8
        found = np.full((8, len(gram)), np.nan)
        for bit in range(8):
            prefix = (1 << bit) | (byte >> (8 - bit))
            for d in range(DEPTH, -1, -1):
                found[bit] = mixed(found[bit], *self.look(d, (context & ((1 << 8 * d) - 1)) << 8 | prefix))
        return log10_bits(byte, found)


def gather(nodes: DataFrame) -> Tree:
    """The nodes in one tree."""
    rows = nodes.select("depth", "node", "n0", "n1", "own").toArrow()
    depth, node, n0, n1, own = (c.to_numpy() for c in rows.columns)
    order = np.lexsort((node, depth))
    depth, node, own, one = depth[order], node[order], own[order], estimate(n0[order], n1[order])
    cut = np.searchsorted(depth, np.arange(DEPTH + 2))
    return Tree({d: (node[a:b], one[a:b], own[a:b]) for d, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))})


def log10_of_subtree(key: np.ndarray, n: np.ndarray, low: Tree) -> np.ndarray:
    """log10 probability of each gram, given all grams of its context of DEALT bytes and the tree of the shorter contexts."""
    levels = subtree(key, n)
    at = np.arange(len(levels[0][0]))  # the node above each of the deepest
    p = estimate(*levels[0][1:3])
    for level in levels[1:]:
        at = level[5][at]
        p = mixed(p, estimate(*level[1:3])[at], level[4][at])
    top = levels[-1][0]
    for d in range(DEALT - 1, -1, -1):
        one, own = low.look(d, (top >> 8 & (1 << 8 * d) - 1) << 8 | top & 255)
        p = mixed(p, one[at], own[at])
    return log10_bits(key & 255, p[levels[0][5]].reshape(8, -1))


def answers(counts: DataFrame, low: Tree) -> DataFrame:
    """chunk, bucket, value: the log10 probabilities of the chunk's grams of this bucket, four bytes each."""
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks, data in buckets_of(batches):
            key, n = summed(data)
            value = np.concatenate([log10_of_subtree(unturned(key[a:b]), n[a:b], shared.value) for a, b in whole_contexts(key)]).astype("<f4")
            for chunk, one in zip(chunks, data, strict=True):
                found = value[np.searchsorted(key, unpack_grams(one)[0])].tobytes()
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "value": pa.array([found], pa.binary())})

    return by_bucket(counts).mapInArrow(trimmed(run), "chunk long, bucket int, value binary")


class Known:
    """The log probabilities of a chunk's grams: its sorted turned grams, and their answers by bucket."""

    def __init__(self, key: np.ndarray, value: list[bytes], buckets: int):
        self.key, self.value = key, np.empty(len(key), "<f4")
        self.value[by_bucket_order(key, buckets)[0]] = np.concatenate([np.frombuffer(x, "<f4") for x in value])

    arranged = staticmethod(turned)

    def log10_of(self, gram: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.key, gram)].astype(np.float64)


class Scorer:
    """Scores of texts by the log probabilities of their grams."""

    def __init__(self, tree: Tree | Known):
        self.tree = tree

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        key, starts = grams(data, offsets)
        found, where = np.unique(self.tree.arranged(key), return_inverse=True)
        return np.add.reduceat(self.tree.log10_of(found)[where], starts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    buckets = bucket_count(docs)
    counts = count_training(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), buckets)
    words = stash(counts.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "words")
    n_texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, v_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, different = n_words + n_texts, v_words + (n_texts > 0)
    spare = math.log10(total + different + 1)
    # 1 / HEAD_SHARE rows at most, since each has that share of all tokens
    head = words.where(F.col("n") >= F.lit(max(1.0, total * HEAD_SHARE))).toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((head.column("key").to_numpy(), head.column("n").to_numpy()))
    found = answers(counts, gather(weighted_nodes(counts, DEALT)))
    fields = "rid long, doc_id long, held_out boolean, n_bytes long, n_words long, score double, head_n long, head_sum double, tail array<long>, tail_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_key, head_n = shared.value
        head_log = np.log10(head_n + 1.0)
        answered: list[bytes] = []
        texts: list[bytes] = []

        def parts() -> Iterator[tuple[bool, pa.RecordBatch]]:
            """Rows of one chunk and kind each, and whether they are texts."""
            for b in batches:
                chunk, text = b.column("chunk").to_numpy(), b.column("rid").is_valid().to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (text[1:] != text[:-1]), [True]))) if len(b) else [0]
                yield from ((bool(text[x]), b.slice(x, y - x)) for x, y in zip(cut[:-1], cut[1:], strict=True))

        for is_text, batch in parts():
            if is_text:
                texts.extend(batch.column("data").to_pylist())
                continue
            if texts:  # what a chunk asked for comes before its texts
                yield from scored_chunk(texts, answered, head_key, head_n, head_log)
                answered, texts = [], []
            answered.extend(batch.column("value").to_pylist())
        if texts:
            yield from scored_chunk(texts, answered, head_key, head_n, head_log)

    def scored_chunk(texts: list[bytes], answered: list[bytes], head_key: np.ndarray, head_n: np.ndarray, head_log: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0
        for run in texts:
            held.append(distinct(turned(grams(*utf8(unpack_rows(run).column("text")))[0])))
            size += len(held[-1])
            if size > 2 * base + HELD:
                held = [distinct(np.concatenate(held))]
                size = base = len(held[0])
        scorer = Scorer(Known(distinct(np.concatenate(held)), answered, buckets))
        del held
        for run in texts:
            rows_ = unpack_rows(run)
            part, bounds = utf8(rows_.column("text"))
            found = [word_counts(part[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sizes = np.array([len(c) for c in found])
            key = word_keys([w for c in found for w in c])
            n = np.fromiter((x for c in found for x in c.values()), np.int32, len(key))
            doc = np.repeat(np.arange(len(found)), sizes)
            at = np.minimum(np.searchsorted(head_key, key), max(len(head_key) - 1, 0))
            common = head_key[at] == key if len(head_key) else np.zeros(len(key), bool)
            rare = np.concatenate(([0], np.cumsum(np.bincount(doc[~common], minlength=len(found))))).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": rows_.column("rid"), "doc_id": rows_.column("doc_id").cast(pa.int64()), "held_out": rows_.column("held_out"), "n_bytes": pa.array(np.diff(bounds)),
                    "n_words": pa.array(np.bincount(doc, n, len(found)).astype(np.int64)), "score": pa.array(scorer.score(part, bounds)),
                    "head_n": pa.array(np.bincount(doc[common], n[common], len(found)).astype(np.int64)),
                    "head_sum": pa.array(np.bincount(doc[common], n[common] * head_log[at[common]], len(found))) if len(head_key) else pa.array(np.zeros(len(found))),
                    "tail": pa.ListArray.from_arrays(pa.array(rare), pa.array(key[~common])), "tail_n": pa.ListArray.from_arrays(pa.array(rare), pa.array(n[~common])),
                }
            )

    texts = counts.where(F.col("kind") == TEXT).select("chunk", "rid", "data")
    asked = texts.unionByName(found, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("rid").asc_nulls_first(), "bucket")
    scored = stash(asked.mapInArrow(trimmed(run), fields), "scored")
    unstash(counts)
    tail = scored.select("rid", F.inline(F.arrays_zip(F.col("tail").alias("key"), F.col("tail_n").alias("m"))))
    met = tail.join(words, "key").groupBy("rid").agg(F.sum("m").alias("tail_n"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("tail_sum"))
    end_log = math.log10(n_texts + 1)
    known = F.col("head_n") + F.coalesce("t.tail_n", F.lit(0)) + F.lit(int(n_texts > 0))
    base = F.col("head_sum") + F.coalesce("t.tail_sum", F.lit(0.0)) + F.lit(end_log) - (F.col("n_words") + 1) * F.lit(spare)
    return scored.alias("s").join(met.alias("t"), F.col("s.rid") == F.col("t.rid"), "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (F.col("score") * F.lit(-1 / math.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
