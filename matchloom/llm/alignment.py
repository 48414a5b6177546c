"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte of a text.

Both tokenizers run over a blank and the text (the second adds that blank itself) and give the bytes at which the tokens
end, above a mark in the lower bits, and again above the token's id; they are aligned by Spark's array functions. Ends that
both have (``array_intersect``) cut the text: their marks are sorted in among the tokens of a side, and the tokens between
two marks are a group, so that no step searches an array for each token. No array holds nulls and no function takes a
lambda, so Spark compiles all of it. The two tokens that end at a cut are linked; groups are spelled out, and linked ids
put in one number, by numpy. Links are counted by pair over all texts; a text's links look their counts up again: pairs
that hold more than a 2^17th of all links (so at most 2^17 of them) by broadcast, all others by a merge join, before sums
of each text leave the task.

Defined results: a text that is null or empty, or that the tokens of one side don't give back byte for byte (such as one
that holds the mark which stands for a blank), has no tokens: zeros and an empty string. Rows are told apart by a number
of their own, so doc_id may be null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import batches_of, slices, stash, trimmed, unstash, utf8
from .tokens import Encoder, encoder, piece_encoder

#: Bytes of text that are tokenized at once (a longer text alone).
TEXT_BYTES = 1 << 18
#: One pair may hold this share of all links before it is looked up by broadcast, so that there are at most as many of those.
HOT_PAIRS = 1 << 17

#: Bits below an end that hold a token's id; all of them set is the mark of a cut.
ID_BITS = 20
MARK = (1 << ID_BITS) - 1

#: Tokens and marks that are spelled at once (a longer text alone).
SPELL_VALUES = 1 << 17
#: Bytes of tokens and marks that go to Python together (a longer text alone): two of its workers stand behind one core.
SPELL_BATCH = 1 << 22
#: What stands behind a token: between tokens of a side, between the sides, between groups, at the end.
SEPARATORS = (",", "|", ";", "")

#: Numbers without nulls among them, which array functions take as they lie in memory.
LONGS = ArrayType(LongType(), False)
LONGS_ARROW = pa.list_(pa.field("element", pa.int64(), nullable=False))
TOKENS = StructType().add("doc_id", LongType()).add("a_ends", LONGS).add("a", LONGS).add("b_ends", LONGS).add("b", LONGS)
SPELLED = StructType().add("doc_id", LongType()).add("n_a", LongType()).add("n_b", LongType()).add("n_groups", LongType()).add("groups", StringType()).add("links", LONGS)


class Lexicon:
    """The bytes of each id, one after another."""

    def __init__(self, of: Encoder):
        of.entries = entries = of.token_bytes()
        of.reset()  # pieces that it has learnt without a look at them
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        return self.flat[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@cache
def sides(path_a: str, path_b: str) -> tuple[tuple[Encoder, Lexicon], ...]:
    a, b = encoder(path_a), piece_encoder(path_b)
    return (a, Lexicon(a)), (b, Lexicon(b))


def aligned_ids(texts: list[str], path_a: str, path_b: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Ids and the bytes behind them of either side, one text after another; the texts that both sides give back."""
    said = [f" {t}" if t else "" for t in texts]
    whole = np.frombuffer("".join(said).encode(), np.uint8)
    stops = np.cumsum(np.fromiter((len(t.encode()) for t in said), np.int64, len(said)))
    out, good = [], stops > np.concatenate(([0], stops[:-1])) if len(said) else np.zeros(0, bool)
    for of, lexicon in sides(path_a, path_b):
        ids, counts = of.plain(said)
        ends = lexicon.ends(ids)
        last = np.concatenate(([0], ends))[np.cumsum(counts)]
        begins = np.concatenate(([0], last[:-1]))
        if of.lossy:  # some piece didn't give back its bytes, in this batch or one before
            bytes_of = lexicon.joined(ids, ends)
            for k in np.flatnonzero(good).tolist():
                good[k] = np.array_equal(bytes_of[begins[k] : last[k]], whole[stops[k - 1] if k else 0 : stops[k]])
        out.append((ids, ends - np.repeat(begins, counts), counts))
    return [(ids[np.repeat(good, counts)], ends[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, ends, counts in out], good


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values as lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values), type=LONGS_ARROW)


def named(schema: StructType, *arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), schema=pa.schema([pa.field(name, x.type) for name, x in zip(schema.names, arrays, strict=True)]))


def tokenized(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The bytes (of a blank and the text) at which the tokens of both sides end, above marks and above ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(utf8(texts)[1], TEXT_BYTES):
                found, _ = aligned_ids([t or "" for t in texts.slice(i, j - i).to_pylist()], path_a, path_b)
                yield named(TOKENS, batch.column("doc_id").slice(i, j - i), *(lists(ends << ID_BITS | low, counts) for ids, ends, counts in found for low in (MARK, ids)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), TOKENS)


def align(tokens: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b (tokens of either side), n_groups, a and b: the tokens of either side, in order, with a mark behind each group."""
    count = lambda c: F.size(c).cast("long")
    cut = tokens.select("doc_id", count("a_ends").alias("n_a"), count("b_ends").alias("n_b"), "a", "b", F.array_intersect("a_ends", "b_ends").alias("cuts"))
    marked = lambda side: F.sort_array(F.concat(side, "cuts")).alias(side)
    return cut.select("doc_id", "n_a", "n_b", count("cuts").alias("n_groups"), marked("a"), marked("b"))


@cache
def cells(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each id and each separator behind it, zeros behind that, and how long it is."""
    texts = [f"{k}{s}".encode() for k in range(ids) for s in SEPARATORS]
    return np.array(texts, "S8").view(np.uint64), np.fromiter(map(len, texts), np.int32, len(texts))


def spell(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The groups of texts (``align``; counts: of groups of each text) as bytes, where each text stops, and the linked pairs."""
    ids, each, last = [], [], []
    for side in (a & MARK, b & MARK):
        mark = side == MARK
        n = np.diff(np.flatnonzero(mark), prepend=-1) - 1  # of tokens in each group
        ids.append(side[~mark])
        each.append(n)
        last.append(np.cumsum(n) - 1)
    order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    done = np.cumsum(each[0]) + np.cumsum(each[1])  # tokens of either side up to each group's end
    stops = np.cumsum(counts)
    for k, behind in enumerate((done - each[1], done)):
        shape = ids[k] * len(SEPARATORS)
        shape[last[k]] += 1 + k
        if k:
            shape[last[k][stops[counts > 0] - 1]] += 1
        order[np.arange(len(shape)) + np.repeat(behind - last[k] - 1, each[k])] = shape
    texts, sizes = cells(1 << int(order.max(initial=0) // len(SEPARATORS)).bit_length())
    long = np.concatenate(([0], np.cumsum(sizes[order], dtype=np.int64)))
    return texts[order].tobytes().translate(None, b"\0"), long[np.concatenate(([0], done))[stops]], ids[0][last[0]] << 32 | ids[1][last[1]]


def spelled(aligned: DataFrame) -> DataFrame:
    """The counts of ``align``, its groups as text (a1,a2|b1;a3|b2,b3) and the linked pairs, an id of either side in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("a").offsets.to_numpy().astype(np.int64), SPELL_VALUES):
                part = batch.slice(i, j - i)
                counts = part.column("n_groups").to_numpy()
                text, stops, links = spell(*(part.column(side).flatten().to_numpy() for side in "ab"), counts)
                groups = pa.StringArray.from_buffers(j - i, pa.py_buffer(np.concatenate(([0], stops)).astype(np.int32)), pa.py_buffer(text))
                yield named(SPELLED, *(part.column(c) for c in SPELLED.names[:4]), groups, lists(links, counts))

    return aligned.mapInArrow(trimmed(run), SPELLED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """Each linked pair (``links``: arrays of pairs) with its count over all texts and whether that is its b's highest."""
    counts = linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def digests(aligned: DataFrame) -> DataFrame:
    """A row for each text: counts of tokens, groups, links; links whose pair is its b's most frequent; counts summed; the groups' SHA-256."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    with batches_of(aligned.sparkSession, SPELL_BATCH):
        rows = stash(spelled(aligned).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest, "links"), "aligned")
    pairs = stash(pair_counts(rows), "pairs")
    total = rows.agg(F.sum("n_groups")).first()[0] or 0
    bar = total // HOT_PAIRS
    hot, rare = F.broadcast(pairs.where(F.col("n") > bar)), pairs.where(F.col("n") <= bar)
    each = rows.select("row", F.explode("links").alias("pair"))
    met = each.join(hot, "pair").unionByName(each.join(hot.select("pair"), "pair", "left_anti").join(rare.hint("merge"), "pair"))
    sums = stash(met.groupBy("row").agg(F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best")), "sums")
    unstash(pairs)
    out = rows.drop("links").join(sums.hint("merge"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
