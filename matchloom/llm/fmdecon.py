"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole documents. Its words become numbers (those of the benchmark's vocabulary; any other word is a
separator that no window holds), runs too short for a window are closed up, and the suffixes of what remains are sorted
by doubling. Ranks in the Burrows-Wheeler transform come from a wavelet matrix. All windows of all items are searched
backward at once; occurrences are located by walking to sampled suffix positions; their word spans are merged for each
document.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (an item is never split), fetched and searched one
after another, so that neither the driver nor a task holds more than one, however large it grows.

Defined results: null or wordless texts have no words and no hits; an item of fewer than ten words is one window; items
without words have none; a null item_id is named by the empty string, and rows that share an item_id are one item;
repeated documents are each searched; empty tables give no rows or no hits; other columns are kept, those named like an
added one only by ``remove``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, lower_table, map_rows, own, slices, stash, trimmed, utf8

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
SAMPLED = 8
#: A word is a run of lower-case letters, digits and non-ASCII bytes, once A-Z is lower-cased.
TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in lower_table())
WORD = re.compile(rb"[^ ]+")


class Windows:
    """The windows of some items: word numbers, and the items of each distinct window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({"" if item is None else str(item) for item, _ in items})
        place = {n: k for k, n in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            words = (text or "").encode().translate(TABLE).split()
            if words:
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
                wide = min(window, len(numbers))
                found = np.lib.stride_tricks.sliding_window_view(numbers, wide)
                rows[wide].append(found)
                owners[wide].append(np.full(len(found), place["" if item is None else str(item)], np.int32))
        # for each length: distinct windows, and their items from begin[k] to begin[k + 1]
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for wide, parts in rows.items():
            distinct, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel(), np.concatenate(owners[wide]))), axis=1)
            self.groups.append((distinct.astype(np.int64), np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), pairs[1]))
        self.shortest = min(rows, default=0)


class FMIndex:
    """Backward search over a sequence of small integers, 0 being a separator."""

    def __init__(self, sequence: np.ndarray, largest: int):
        # an end symbol below all others makes every suffix distinct
        s = np.append(sequence.astype(np.int64) + 1, 0)
        self.n = n = len(s)
        sa = suffix_order(s)
        bwt = s[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=largest + 3))))
        self.sampled = np.full(n, -1, np.int64)
        at = np.flatnonzero((sa % SAMPLED == 0) | (sa == n - 1))
        self.sampled[at] = sa[at]
        # wavelet matrix: one level for each bit, from the top; ones[k][i]: set bits before i
        self.levels, rest = [], bwt
        for bit in range(int(largest + 1).bit_length() - 1, -1, -1):
            b = (rest >> bit) & 1
            ones = np.concatenate(([0], np.cumsum(b))).astype(np.int32)
            self.levels.append((bit, ones, n - int(ones[-1])))
            rest = np.concatenate((rest[b == 0], rest[b == 1]))
        self.bwt = bwt

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before place ``at`` of the transform."""
        begin, end = np.zeros_like(at), at
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, end - e)
        return end - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each row of patterns."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k] + 1
            lo[alive] = self.first[c] + self.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes of these rows."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            known = self.sampled[at]
            done = known >= 0
            out[open_[done]] = known[done] + steps
            open_, at = open_[~done], at[~done]
            c = self.bwt[at]
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of s, whose last symbol is the unique smallest, by doubling from packed words of symbols."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    per = max(1, 62 // bits)
    padded = np.append(s, np.zeros(per, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(per):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)
    step = per
    while True:
        ordered = key[order]
        new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        rank[order] = np.cumsum(new)
        if new[1:].all():
            return order
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key)
        step *= 2


def search_shard(texts: list[bytes], w: Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: number of words, merged spans [from, to) of hit words, items with occurring windows."""
    get = w.vocabulary.get
    words = [t.translate(TABLE).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    found: list[tuple[int, list, list]] = [(int(n), [], []) for n in sizes]
    # the words of a text and a separator
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers = np.zeros(int(sizes.sum()) + len(words), np.int64)
    for at, ws in zip(starts.tolist(), words, strict=True):
        numbers[at : at + len(ws)] = np.fromiter((get(x, 0) for x in ws), np.int64, len(ws))
    del words
    if not w.groups or not len(numbers):
        return found
    # only runs of known words that can hold a window are indexed; each keeps the separator behind it
    known = numbers > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= w.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return found
    n = end - begin + 1
    places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    sequence = np.append(numbers, 0)[places]
    index = FMIndex(sequence, len(w.vocabulary))
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[int]] = defaultdict(set)
    for patterns, begin, owners in w.groups:
        lo, hi = index.search(patterns)
        hits = np.flatnonzero(hi > lo)
        count = (hi - lo)[hits]
        if not len(hits):
            continue
        rows = np.repeat(lo[hits] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = places[index.locate(rows)]
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, a, k in zip(doc.tolist(), (at - starts[doc]).tolist(), np.repeat(hits, count).tolist(), strict=True):
            spans[d].append((a, a + patterns.shape[1]))
            items[d].update(owners[begin[k] : begin[k + 1]].tolist())
    for d in spans:
        found[d] = (found[d][0], merge(spans[d]), [w.names[k] for k in sorted(items[d])])
    return found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the bytes from the first to the last word of each span."""
    words = [m.span() for m in WORD.finditer(text.translate(TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


def blocks_of(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[object, str | None]]]]:
    """How many blocks of bounded text the items make, and the blocks, each fetched when its turn comes."""
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n))
    return n, ([tuple(r) for r in part.collect()] for part in parts)


ADDED = ("n_words", "spans", "items")
KINDS = (LongType(), ArrayType(ArrayType(IntegerType())), ArrayType(StringType()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, added: tuple[str, ...] = ADDED, finish: Callable | None = None) -> DataFrame:
    """docs with n_words, spans (array of [from, to) word spans, merged) and items (sorted item ids as strings).

    finish: makes the result's columns of those (theirs come last) in the same pass; the result then has docs' schema.
    """
    base = docs.select(*own(docs, *added))
    with_added = StructType([*base.schema.fields, *(StructField(n, t) for n, t in zip(added, KINDS, strict=True))])
    n, blocks = blocks_of(benchmark)
    if n > 1:
        return in_blocks(base, blocks, added, finish, with_added)
    shared = docs.sparkSession.sparkContext.broadcast(next(blocks))  # BLOCK_BYTES at most, and one item at least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(shared.value)
        for batch in batches:
            found = search_batch(batch, w)
            columns, labels = list(batch.columns), list(batch.schema.names)
            if finish is not None:
                yield pa.RecordBatch.from_arrays(finish(columns, labels, [x[1] for x in found]), names=labels)
            else:
                yield pa.RecordBatch.from_arrays([*columns, *as_columns(found)], names=[*labels, *added])

    return map_rows(base, run, base.schema if finish is not None else with_added)


def search_batch(batch: pa.RecordBatch, w: Windows) -> list[tuple[int, list, list]]:
    """(words, merged spans, items) of each text of a batch, a shard at a time."""
    data, offsets = utf8(batch.column("text"))
    return [x for i, j in slices(offsets, SHARD_BYTES) for x in search_shard([data[offsets[d] : offsets[d + 1]].tobytes() for d in range(i, j)], w)]


def as_columns(found: list[tuple[int, list, list]]) -> list[pa.Array]:
    return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.list_(pa.int32()))), pa.array([x[2] for x in found], pa.list_(pa.string()))]


def in_blocks(base: DataFrame, blocks: Iterator[list], added: tuple[str, ...], finish: Callable | None, with_added: StructType) -> DataFrame:
    """``decontaminate`` where the items make several blocks: one job for each, that writes what it finds under the row's number.

    So the driver and a task hold one block at a time, and the texts are only copied once, to number them.
    """
    (row,) = fresh([*base.columns, *added], "row")
    numbered = stash(base.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits: list[DataFrame] = []
    for k, block in enumerate(blocks):
        shared = base.sparkSession.sparkContext.broadcast(block)
        del block

        def run(batches: Iterator[pa.RecordBatch], shared=shared, all_rows=k == 0) -> Iterator[pa.RecordBatch]:
            w = Windows(shared.value)
            for batch in batches:
                found = search_batch(batch, w)
                out = pa.RecordBatch.from_arrays([batch.column("row"), *as_columns(found)], names=["row", *ADDED])
                yield out if all_rows else out.filter(pa.array([bool(x[1]) for x in found], pa.bool_()))

        hits.append(stash(numbered.select(F.col(row).alias("row"), "text").mapInArrow(trimmed(run), "row long, n_words long, spans array<array<int>>, items array<string>"), "hits"))
        shared.unpersist()
    whole = hits[0]
    for more in hits[1:]:
        whole = whole.unionByName(more)
    # of a row there is one entry for each block at most
    merged = whole.groupBy(F.col("row").alias(row)).agg(
        F.max("n_words").alias(added[0]), F.flatten(F.collect_list("spans")).alias(added[1]), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(added[2])
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, n, spans, items = batch.columns
            labels = batch.schema.names[:-3]
            joined = [merge([tuple(x) for x in s]) for s in spans.to_pylist()]
            if finish is not None:
                yield pa.RecordBatch.from_arrays(finish(columns, labels, joined), names=labels)
            else:
                yield pa.RecordBatch.from_arrays([*columns, n, pa.array(joined, pa.list_(pa.list_(pa.int32()))), items], names=[*labels, *added])

    met = numbered.join(merged.hint("merge"), row).select(*own(base), *added)
    return map_rows(met, join, base.schema if finish is not None else with_added)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract of op1 from ``decontaminate``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the benchmark's passages; n_chars, if there, follows the text."""

    def finish(columns: list[pa.Array], names: list[str], spans: list[list[tuple[int, int]]]) -> list[pa.Array]:
        hit = [i for i, s in enumerate(spans) if s]
        if hit:
            at = names.index("text")
            texts = columns[at].to_pylist()
            for i in hit:
                texts[i] = cut(texts[i].encode(), spans[i]).decode()
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                n = columns[at].to_pylist()
                for i in hit:
                    n[i] = len(texts[i])
                columns[at] = pa.array(n, columns[at].type)
        return columns

    return decontaminate(docs, benchmark, tuple(fresh(docs.columns, *ADDED)), finish)
