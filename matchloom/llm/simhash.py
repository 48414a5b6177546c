"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into two halves: of two fingerprints that differ in at most three bits, one half differs in at most
one. So each distinct fingerprint is indexed under 64 signatures, one for each half and each of its bits taken as a
wildcard; fingerprints that meet under a signature are verified. Equal signatures come together by one exchange and a
sort, and stream through numpy in runs.

A run of more than ``RUN`` fingerprints is not compared at all: its members are indexed again by the half that was free,
cut in two in the same way, and so on; after the third cut a run holds 2,048 fingerprints at most. Inside a run only a
spanning forest is emitted. Components then come from alternating star contractions, each a grouped minimum and a join.

``keep_one``, for corpora, takes a similarity rather than a distance. At 0.8 some 15 % of all bits differ, which no cut
into few segments can guarantee to meet; so a set has several fingerprints and many shorter segments, whose one-wildcard
variants meet with a probability that grows with similarity (``plan``). Texts that meet and differ in few enough bits are
compared by their sets, each pair for itself; only such pairs are links. Where many meet, a star around a leader is
compared first; what that leaves apart is compared pair by pair, dealt in blocks, so that no link hides another.

Defined results: null text is an empty text; texts without words have fingerprint zero and are linked like any other;
rows without doc_id take part, and their component is the smallest doc_id there is in it; repeated rows share a
component; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from itertools import repeat
from math import acos, ceil, log, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import fresh, join_hot, lower_table, own, slices, stash, trimmed, unstash, utf8

RUN = 8192
DIFFER = 3
SHINGLE = 3
RUN_BYTES = 1 << 19
#: For ``keep_one``: words of a shingle and the least similarity; the share of texts of that similarity that have to meet.
SIMILAR_SHINGLE, JACCARD, MEET = 5, 0.8, 0.96
#: Bits of a segment up to four million texts; a bit more for each doubling beyond.
SEGMENT, SEGMENT_TEXTS = 16, 22
#: Bits that may differ in the first fingerprint (at a similarity of 0.8, 9.7 do on average, with a deviation of 2.9).
NEAR = 17
#: Members of a run that are compared at once, and pairs for each of them beyond which leaders go first.
BLOCK, PAIRS = 1024, 4
#: Ranges of the hashes whose least one marks a set: sets of high similarity share most of their marks.
BANDS = 8
SALTS = 16
LOWER = lower_table()


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64, seed 42, of each run of ``shingle`` words (of all words where there are fewer)."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return []
    if len(words) < shingle:
        return [xxh64_intdigest(b" ".join(words), 42)]
    return list(map(xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), repeat(42)))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Signed 64-bit fingerprint of each text."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.fromiter((x for one in hashes for x in one), np.uint64, int(sizes.sum()))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of docs."""
    base = docs.select("doc_id", "text")
    schema = StructType([base.schema["doc_id"], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [fingerprints([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]) for i, j in slices(offsets, RUN_BYTES)]
            fp = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return base.mapInArrow(trimmed(run), schema)


def one_wildcard(fp: np.ndarray, at: np.ndarray, wide: int, sig: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the two halves of the ``wide`` bits from bit ``at``: (signature, bit where the free half starts, fp)."""
    half = wide // 2
    value = fp.view(np.uint64)
    out = []
    for side in (0, 1):
        begin = at + side * half
        part = (value >> begin.astype(np.uint64)) & np.uint64((1 << half) - 1)
        for k in range(half):
            key = (part & ~np.uint64(1 << k)) | np.uint64((side << 5 | k) << 32)
            if sig is not None:
                with np.errstate(over="ignore"):
                    key = (sig.view(np.uint64) ^ (key * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(31)
            out.append((key.view(np.int64), at + (1 - side) * half, fp))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which signed fingerprints differ (numpy counts those of the absolute value, so the sign must go first)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among fp."""
    left, right = [], []
    rest = fp
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = differing(rest, x) <= DIFFER
            if near.any():
                found = rest[near]
                left += [int(x)] * len(found)
                right += found.tolist()
                frontier += list(found)
                rest = rest[~near]
    return left, right


EDGE = pa.schema([("sig", pa.int64()), ("at", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])


def links_of_runs(batches: Iterator[pa.RecordBatch], bound: float = RUN) -> Iterator[pa.RecordBatch]:
    """Sorted rows (sig, at, fp) to links (u, v); members of a run beyond the bound come back as (sig, at, fp) for another cut."""

    def rows(sig, at, u, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(at, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=EDGE)

    def hot(sig, at, fp) -> pa.RecordBatch:
        return rows([sig] * len(fp), [at] * len(fp), fp, [None] * len(fp))

    def closed(sig: np.ndarray, at: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        near = differing(a, b) <= DIFFER
        u, v = [a[near]], [b[near]]
        for i in np.flatnonzero(size > 2).tolist():
            part = fp[cut[i] : cut[i + 1]]
            if len(part) > bound:
                yield hot(int(sig[cut[i]]), int(at[cut[i]]), part)
                continue
            x, y = forest(part)
            u.append(np.array(x, np.int64))
            v.append(np.array(y, np.int64))
        u, v = np.concatenate(u), np.concatenate(v)
        if len(u):
            pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1), axis=0)
            yield rows([None] * len(pairs), [None] * len(pairs), pairs[:, 0], pairs[:, 1])

    held: list[tuple[np.ndarray, ...]] = []
    n, spilled = 0, None
    for batch in batches:
        sig, fp = batch.column("sig").to_numpy(), batch.column("fp").to_numpy()
        at = batch.column("at").to_numpy() if "at" in batch.schema.names else np.zeros(len(sig), np.int32)
        if not len(sig):
            continue
        if spilled is not None:  # the run that was too long goes on
            same = sig == spilled
            if same.any():
                yield hot(spilled, int(at[0]), fp[same])
                sig, at, fp = sig[~same], at[~same], fp[~same]
            if not len(sig):
                continue
            spilled = None
        held.append((sig, at, fp))
        n += len(sig)
        if n < 4 * RUN:
            continue
        sig, at, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(sig, sig[-1]))  # rows are sorted by sig
        if last:
            yield from closed(sig[:last], at[:last], fp[:last])
        held, n = [(sig[last:], at[last:], fp[last:])], len(sig) - last
        if n > bound:
            yield hot(int(sig[-1]), int(at[-1]), fp[last:])
            spilled, held, n = sig[-1], [], 0
    if held:
        yield from closed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fps`` (column fp) as all pairs within DIFFER bits do."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for i in range(0, len(fp), 2000):
                part = fp[i : i + 2000]
                s, at, f = one_wildcard(part, np.zeros(len(part), np.int64), 64, None)
                yield pa.RecordBatch.from_pydict({"sig": s, "at": at.astype(np.int32), "fp": f})

    def again(wide: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sig, at, fp = (b.column(c).to_numpy() for c in ("sig", "at", "u"))
                for i in range(0, len(fp), 2000):
                    s, a, f = one_wildcard(fp[i : i + 2000], at[i : i + 2000].astype(np.int64), wide, sig[i : i + 2000])
                    yield pa.RecordBatch.from_pydict({"sig": s, "at": a.astype(np.int32), "fp": f})

        return run

    keyed = fps.mapInArrow(trimmed(first), "sig long, at int, fp long")
    out = []
    for wide in (32, 16, 8, 0):
        bound = RUN if wide else float("inf")  # after the third cut eleven bits are free at most
        found = stash(keyed.repartition("sig").sortWithinPartitions("sig").mapInArrow(trimmed(partial(links_of_runs, bound=bound)), "sig long, at int, u long, v long"), "links")
        out.append(found.where(F.col("v").isNotNull()).select("u", "v"))
        hot = found.where(F.col("v").isNull())
        if not wide or hot.isEmpty():
            break
        keyed = hot.mapInArrow(trimmed(again(wide)), "sig long, at int, fp long")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the smallest node reachable."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        sym = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = sym.join(lowest, "u")
        if large:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    now, mark = stash(edges, "star"), None
    while True:
        after = stash(star(star(now, True), False), "star")
        unstash(now)
        now = after
        # a fixed point of both contractions has every node directly under its root
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(state)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of those linked, itself included) of each row."""
    marked = stash(with_fingerprints(docs), "fp")
    owners = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "owners")
    roots = components(links(owners.select("fp")))
    rooted = owners.join(roots, owners["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = stash(rooted.select("fp", "n", "root").join(lowest, "root").select("fp", "component_id", "n"), "of_fp")
    unstash(owners)
    return join_hot(marked, of_fp, ["fp"], marked.count()).select("doc_id", "fp", "component_id")


class Plan(NamedTuple):
    """Fingerprints of 64 bits a set (the first is not cut), bits of a segment, segments, bits that may differ in all."""

    words: int
    bits: int
    segments: int
    differ: int


def plan(texts: int) -> Plan:
    """How to cut the fingerprints of so many texts.

    A bit differs with a probability p that the angle of two sets of similarity JACCARD gives; segments are as many as let
    MEET of such pairs agree but for one bit in one of them, and 97.5 % of them are within ``differ`` bits in all.
    """
    p = acos(2 * JACCARD / (1 + JACCARD)) / pi
    bits = max(SEGMENT, (texts - 1).bit_length() - SEGMENT_TEXTS + SEGMENT)
    agree = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    segments = ceil(log(1 - MEET) / log(1 - agree))
    words = 1 + ceil(segments / (64 // bits))
    return Plan(words, bits, segments, ceil(64 * words * p + 1.96 * sqrt(64 * words * p * (1 - p))))


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` signed 64-bit fingerprints of one set of shingle hashes: the first of the hashes, the others of hashes of them."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        mixed = np.empty((len(part), words), np.uint64)
        mixed[:, 0] = part
        with np.errstate(over="ignore"):
            for k in range(1, words):
                z = part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                mixed[:, k] = z ^ z >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of SIMILAR_SHINGLE words."""
    return np.unique(np.array(shingle_hashes(text, SIMILAR_SHINGLE), np.uint64))


def bands(h: np.ndarray) -> list[int | None]:
    """Marks of a sorted set of hashes: the least of each of BANDS ranges, none where a range is empty."""
    at = np.searchsorted(h, np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 64) // BANDS))
    return [int(h[k].view(np.int64)) if k < end else None for k, end in zip(at.tolist(), [*at[1:].tolist(), len(h)], strict=True)]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= JACCARD * (len(x) + len(y) - both) - 1e-9


def wide_signatures(batches: Iterator[pa.RecordBatch], how: Plan) -> Iterator[pa.RecordBatch]:
    """(node, w0, w1, ..) to (sig, node, fp: w0): each segment of w1, .. with each of its bits as a wildcard; root goes along."""
    per = 64 // how.bits
    for b in batches:
        words = [b.column(f"w{k}").to_numpy().view(np.uint64) for k in range(how.words)]
        node = b.column("node").to_numpy()
        roots = [b.column("root").to_numpy()] if "root" in b.schema.names else []
        for i in range(0, len(b), 1000):
            sig = []
            for k in range(how.segments):
                part = words[1 + k // per][i : i + 1000] >> np.uint64(k % per * how.bits) & np.uint64((1 << how.bits) - 1)
                sig += [part & ~np.uint64(1 << bit) | np.uint64((k * how.bits + bit) << how.bits) for bit in range(how.bits)]
            fp = words[0][i : i + 1000].view(np.int64)
            yield pa.RecordBatch.from_pydict({"sig": np.concatenate(sig).astype(np.int64), "node": np.tile(node[i : i + 1000], len(sig)), "fp": np.tile(fp, len(sig))} | {"root": np.tile(x[i : i + 1000], len(sig)) for x in roots})


MET = pa.schema([("sig", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def met_pairs(u: list[np.ndarray], v: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    a, b = np.concatenate([*u, np.zeros(0, np.int64)]), np.concatenate([*v, np.zeros(0, np.int64)])
    if len(a):
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=MET)


class Leaders:
    """A run of any length, a block at a time: each row goes to the first leader that it is near to, or leads itself."""

    def __init__(self, sig: int):
        self.sig, self.node, self.fp = sig, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last: int | None = None  # the leader that had rows last
        self.alone: set[int] = set()  # leaders near to no row yet

    def take(self, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows (sig, u, v) that have leaders: v is a row's leader, a leader's v the one before it, or a row of another
        leader where it is near to no others."""
        u, v, rows, whole = [], [], [], (node, fp)

        def claim(lead: int, at: int, node: np.ndarray, fp: np.ndarray) -> np.ndarray:
            near = differing(fp, at) <= NEAR
            if near.any():
                u.append(np.full(int(near.sum()), lead))
                v.append(node[near])
                rows.append((lead, lead if self.last is None else self.last))
                self.last = lead
                self.alone.discard(lead)
            elif lead in self.alone:
                other = whole[0][(differing(whole[1], at) <= NEAR) & (whole[0] != lead)]
                if len(other):
                    rows.append((lead, int(other[0])))
                    self.alone.discard(lead)
            return ~near

        for lead, at in zip(self.node.tolist(), self.fp, strict=True):
            rest = claim(lead, at, node, fp)
            node, fp = node[rest], fp[rest]
        leaders = []
        while len(node):
            lead, at, node, fp = int(node[0]), fp[0], node[1:], fp[1:]
            leaders.append((lead, at))
            self.alone.add(lead)
            rest = claim(lead, at, node, fp)
            node, fp = node[rest], fp[rest]
        if leaders:
            more = np.array(leaders, np.int64)
            self.node, self.fp = np.concatenate((self.node, more[:, 0])), np.concatenate((self.fp, more[:, 1]))
        if rows:
            own = np.array(rows, np.int64)
            columns = [np.concatenate((*x, own[:, k])) for k, x in enumerate((v, u))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), self.sig)), *map(pa.array, columns)], schema=MET)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (sig, node, fp, root) to the pairs (u, v) within NEAR bits, of different roots, that a signature brings
    together; without root each row is its own.

    Of a run that is long, or has many such pairs, no pair comes out, but its members as ``Leaders`` has them.
    """

    def closed(sig: np.ndarray, node: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        size = np.diff(cut)
        u, v = [], []
        for n in np.unique(size[size > 1]).tolist():
            begins = cut[:-1][size == n]
            if n <= 16:  # many runs at once
                for i in range(n):
                    for j in range(i + 1, n):
                        a, b = begins + i, begins + j
                        near = (root[a] != root[b]) & (differing(fp[a], fp[b]) <= NEAR)
                        u.append(node[a[near]])
                        v.append(node[b[near]])
                continue
            for begin in begins.tolist():
                own, f, of = (x[begin : begin + n] for x in (node, fp, root))
                if (of == of[0]).all():
                    continue  # all of them are connected
                if n <= BLOCK:
                    a, b = np.nonzero(np.triu((of[:, None] != of[None, :]) & (differing(f[:, None], f[None, :]) <= NEAR), 1))
                    if len(a) <= PAIRS * n:
                        u.append(own[a])
                        v.append(own[b])
                        continue
                yield from Leaders(int(sig[begin])).take(own, f)
        yield from met_pairs(u, v)

    held: list[tuple[np.ndarray, ...]] = []
    n, leaders = 0, None
    for batch in batches:
        rows = tuple(batch.column(c).to_numpy() for c in ("sig", "node", "fp", "root" if "root" in batch.schema.names else "node"))
        if leaders is not None:  # the run that was too long goes on
            same = rows[0] == leaders.sig
            for i in range(0, int(same.sum()), BLOCK):
                yield from leaders.take(*(x[same][i : i + BLOCK] for x in rows[1:3]))
            rows = tuple(x[~same] for x in rows)
            if not len(rows[0]):
                continue
            leaders = None
        held.append(rows)
        n += len(rows[0])
        if n < 4 * RUN:
            continue
        sig, node, fp, root = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(sig, sig[-1]))  # rows are sorted by sig
        if last:
            yield from closed(sig[:last], node[:last], fp[:last], root[:last])
        held, n = [(sig[last:], node[last:], fp[last:], root[last:])], len(sig) - last
        if n > RUN:
            leaders = Leaders(int(sig[-1]))
            for i in range(last, len(sig), BLOCK):
                yield from leaders.take(node[i : i + BLOCK], fp[i : i + BLOCK])
            held, n = [], 0
    if held:
        yield from closed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def crossings(batches: Iterator[pa.RecordBatch], how: Plan) -> Iterator[pa.RecordBatch]:
    """Sorted rows (family, i, j, left, node, root, text, w0, ..) of blocks to links (u, v) of different roots, u on the left.

    Texts near enough by their bits are compared by their sets, but for those that links of the block connect already.
    """

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        left, node, root = (table.column(c).to_numpy() for c in ("left", "node", "root"))
        bits = np.stack([table.column(f"w{k}").to_numpy() for k in range(how.words)], axis=1)
        text, sets = table.column("text"), {}
        group = np.unique(root, return_inverse=True)[1]  # what is connected, numbered
        right = np.flatnonzero(~left)

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set((text[k].as_py() or "").encode())
            return sets[k]

        u, v = [], []
        for x in np.flatnonzero(left).tolist():
            other = right[group[right] != group[x]]
            apart = differing(bits[other], bits[x])
            for y in other[(apart[:, 0] <= NEAR) & (apart.sum(axis=1, dtype=np.int64) <= how.differ)].tolist():
                if group[x] != group[y] and similar(of(x), of(y)):
                    group[group == group[y]] = group[x]
                    u.append(node[x])
                    v.append(node[y])
            sets.pop(x, None)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("family", "i", "j")], axis=1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:
                continue
            if key is not None and key != tuple(keys[a]):
                yield from block(held)
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from block(held)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of which one stays for each group of near copies: that of the smallest doc_id (null last), then any one.

    Near copies have a Jaccard similarity of JACCARD at least over their sets of SIMILAR_SHINGLE words. Texts that agree in
    a segment but for one bit at most (``plan``), and differ in few enough bits of the first fingerprint (NEAR) and of all,
    are compared by the sets themselves; only a pair that passes is a link. What shares a mark of least hashes (``bands``) is
    compared with one text of that mark before, and what that connects is not brought together again: each text of a
    large group is then compared a few times, and not once for every signature under which it meets another leader. Rows are told apart by their own number, so
    missing and repeated doc_ids lose nothing; texts without words are copies of each other.
    """
    (name,) = fresh(docs.columns, "row")
    numbered = stash(docs.select("*", F.monotonically_increasing_id().alias(name)), "rows")
    rows = numbered.select(F.col(name).alias("row"), "doc_id", "text")
    how = plan(rows.count())
    words, marks = [f"w{k}" for k in range(how.words)], [f"m{k}" for k in range(BANDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i in range(0, len(b), 256):
                digests, found, least = [], [], []
                for x, y in zip(offsets[i : i + 256].tolist(), offsets[i + 1 : i + 257].tolist(), strict=False):
                    h = shingle_set(data[x:y].tobytes())
                    digests.append(blake2b(h.tobytes(), digest_size=16).digest())
                    found.append(wide_fingerprint(h, how.words))
                    least.append(bands(h))
                part, w = b.slice(i, 256), np.array(found, np.int64).reshape(-1, how.words)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(digests, pa.binary()), *(pa.array(w[:, k]) for k in range(how.words)), *(pa.array(x, pa.int64()) for x in zip(*least, strict=True))], names=["row", "doc_id", "digest", *words, *marks])

    fields = StructType([StructField("row", LongType()), docs.schema["doc_id"], StructField("digest", BinaryType()), *(StructField(w, LongType()) for w in (*words, *marks))])
    found = rows.mapInArrow(trimmed(sketch), fields)
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    copies = stash(found.groupBy("digest").agg(F.min("row").alias("node"), F.min(best).alias("best"), *(F.first(w).alias(w) for w in (*words, *marks))).drop("digest"), "copies")

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs within the bits that may differ in all."""
        ends = [copies.select(F.col("node").alias(side), *(F.col(w).alias(f"{side}_{w}") for w in words)) for side in "uv"]
        apart = sum(F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in words)
        return stash(pairs.join(ends[0].hint("merge"), "u").join(ends[1].hint("merge"), "v").where(apart <= how.differ).select("u", "v"), "near")

    marked = copies.select("node", *words, F.posexplode(F.array(*marks)).alias("band", "mark")).where(F.col("mark").isNotNull())
    first = stash(marked.groupBy("band", "mark").agg(F.min_by(F.struct("node", *words), F.xxhash64("node", "band")).alias("lead"), F.count("*").alias("n")).where("n > 1"), "marks")
    apart = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"lead.{w}"))) for w in words)
    met = join_hot(marked, first, ["band", "mark"], len(marks) * copies.count()).where((F.col("node") != F.col("lead.node")) & (apart <= how.differ))
    shared = stash(met.select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct(), "near")
    early = stash(linked(shared, rows), "similar")
    tied = stash(components(early), "tied")
    placed = copies.select("node", *words).join(tied.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    signed = placed.mapInArrow(trimmed(partial(wide_signatures, how=how)), "sig long, node long, fp long, root long")
    met = stash(signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(trimmed(meetings), "sig long, u long, v long"), "met")
    near = close(met.where(F.col("sig").isNull()).select("u", "v").distinct())
    links = stash(early.unionByName(linked(near, rows)), "similar")
    members = met.where(F.col("sig").isNotNull())
    if not members.isEmpty():
        texts = copies.select("node", *words).join(rows.select(F.col("row").alias("node"), "text").hint("merge"), "node")
        links = stash(links.unionByName(crossing_links(members, components(links), texts, how)), "similar")
    rooted = copies.join(components(links).withColumnRenamed("node", "first"), F.col("node") == F.col("first"), "left").select(F.coalesce("root", "node").alias("root"), "best")
    chosen = stash(rooted.groupBy("root").agg(F.min("best")["row"].alias(name)).select(name), "chosen")
    unstash(copies, first, shared, early, tied, met, near, links)
    return numbered.join(chosen.hint("merge"), name, "left_semi").select(*own(docs))


def linked(near: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) of near whose texts in rows (row, text) are similar by their sets.

    The text of a row that is in many pairs goes to SALTS tasks, so that no task has all of them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in batches:
            good = []
            for k, (u, x, y) in enumerate(zip(b.column("u").to_pylist(), b.column("a"), b.column("b"), strict=True)):
                if u != last:
                    last, known = u, shingle_set((x.as_py() or "").encode())
                if similar(known, shingle_set((y.as_py() or "").encode())):
                    good.append(k)
            kept = b.take(pa.array(good, pa.int64()))
            yield kept.select(["u", "v"])

    ends = near.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    texts = stash(rows.select("row", "text").join(ends.hint("merge"), "row"), "texts")
    salt = F.pmod(F.hash("v"), F.lit(SALTS)).alias("salt")
    first = near.select("u", salt).distinct().join(texts.select(F.col("row").alias("u"), F.col("text").alias("a")).hint("merge"), "u")
    second = near.select("u", "v", salt).join(texts.select(F.col("row").alias("v"), F.col("text").alias("b")).hint("merge"), "v")
    return second.join(first.hint("merge"), ["u", "salt"]).select("u", "v", "a", "b").mapInArrow(trimmed(compare), "u long, v long")


def crossing_links(members: DataFrame, roots: DataFrame, texts: DataFrame, how: Plan) -> DataFrame:
    """The links that connect the members (sig, u, v) of long runs further than roots (node, root) does; texts has row, node,
    text and w0, ..

    Members are a family where leaders connect them, so each is there once, in however many runs it is. A family of one
    root has no further link. Of any other those outside its largest component are held against all, in blocks of BLOCK
    rows by BLOCK rows that take the texts along: pairs are looked at where they meet and never become rows.
    """
    ends = members.where("u <> v").select("u", "v").distinct()
    kin = stash(components(ends).select("node", F.col("root").alias("family")), "kin")
    kin = kin.unionByName(kin.select(F.col("family").alias("node"), "family").distinct())
    placed = kin.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("family", "root").agg(F.count("*").alias("n"))
    apart = parts.groupBy("family").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    live = placed.join(apart.hint("merge"), "family").join(texts.hint("merge"), "node")
    live = live.withColumns({"rows": F.ceil(F.col("n") / BLOCK).cast("int"), "columns": F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int")})
    deal = lambda over: F.pmod(F.hash("node"), F.col(over))
    every = lambda over: F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    rest = ["family", "i", "j", "left", "node", "root", "text", *(f"w{k}" for k in range(how.words))]
    left = live.where("root <> main").withColumns({"i": deal("columns"), "left": F.lit(True)}).withColumn("j", every("rows")).select(*rest)
    right = live.withColumns({"j": deal("rows"), "left": F.lit(False)}).withColumn("i", every("columns")).select(*rest)
    dealt = left.unionByName(right).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(trimmed(partial(crossings, how=how)), "u long, v long")
