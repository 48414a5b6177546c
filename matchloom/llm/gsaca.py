"""Suffix-array dedup: remove every byte that a repeated string of ``LENGTH`` bytes covers.

Equal strings are brought together by content: the 32-byte gram of the least hash in a string is its anchor, so equal
strings have equal anchors at equal offsets. Only anchors that occur twice go on. All neighbouring strings of one anchor
form a *unit* (a stretch of text); equal units (by 128 bits of BLAKE2b) are counted, and where one anchor has several
different units, a suffix array over them and the common prefixes of its neighbours tell which of their strings repeat.

The suffix array is built by linear grouping. Suffixes are grouped by their Lyndon prefix: groups are processed in
descending order; the suffixes of a group find their previous smaller neighbour, and the neighbours' groups are split by
how many of the group's suffixes follow them. A second pass emits each group's order by walking the previous-smaller
pointers from each suffix in ascending order; nothing is renamed or sorted again. Its symbols are content-defined
phrases of some 32 bytes, numbered in lexicographic order, so that it orders the suffixes at phrase starts as their bytes
do; every other suffix follows from the bytes before the next phrase start and the rank of what follows. Hashes only
bring bytes together: what they bring is compared.

A hot anchor (one passage in very many documents) is dealt by the bytes its strings share: blocks of 16 strings by their
common core and, where a core still has many different blocks, single strings, which are only counted. Keys that hold
very many rows meet what is known of them by broadcast, so no task gets all of one key.

Defined results: null text is an empty text; repeated rows are copies of each other; null doc_id is a doc_id like any
other; shorter texts than LENGTH stay as they are; an empty table gives no rows; other columns are kept, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, map_rows, own, stash, trimmed, unstash, utf8
from .tokens import ROLL, UNROLL

LENGTH = 400
GRAM = 32
PHRASE_BITS = 5
TRIGGER = 8
#: Occurrences beyond which an anchor's strings are dealt in blocks, and different blocks beyond which a core's are dealt singly.
HOT = 1000
BLOCK = 16
RUN_BYTES = 1 << 19
PIECE = 1 << 19
#: Units that a task remembers, so that equal ones are sent once.
SEEN = 100_000


class Rolling:
    """Hashes of any stretch of a byte array."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling.up) <= n:
            wide = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                Rolling.up = np.cumprod(np.append(one, np.full(wide, ROLL, np.uint64)), dtype=np.uint64)
                Rolling.down = np.cumprod(np.append(one, np.full(wide, UNROLL, np.uint64)), dtype=np.uint64)
        mixed = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[data] * Rolling.up[:n], dtype=np.uint64)))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[end] - self.total[begin]) * Rolling.down[begin]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Units of the texts data[starts[k]:ends[k]], each of ``length`` bytes at least: (text, first string, strings, anchor's place, its hash).

    Places are those in data.
    """
    n, w = len(data), length - GRAM + 1
    roll = Rolling(data)
    at = np.arange(n - GRAM + 1)
    gram = roll.of(at, at + GRAM)
    key = (gram >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    low, span = key, 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[w - span : w - span + n - length + 1])
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    # strings that lie in one text
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - length + 1, -1)
    good = np.cumsum(inside)[: len(place)] > 0
    first = good.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
    begin = np.flatnonzero(first)
    text = np.searchsorted(starts, begin, side="right") - 1
    begin_text = np.concatenate(([True], text[1:] != text[:-1]))
    nxt = np.append(begin[1:], 0)
    last = np.append(begin_text[1:], True)
    stop = np.where(last, (ends - length + 1)[text], nxt)
    return text, begin, stop - begin, place[begin], gram[place[begin]].view(np.int64)


def lyndon_groups(s: list[int]) -> tuple[list[list[int]], list[int]]:
    """Suffixes grouped by Lyndon prefix, groups ascending, and each suffix's previous smaller neighbour (-1: none)."""
    n = len(s)
    rank = {c: k for k, c in enumerate(sorted(set(s)))}
    group = [rank[c] for c in s]
    members: list[list[int]] = [[] for _ in rank]
    for i, g in enumerate(group):
        members[g].append(i)
    k = len(rank)
    lower, upper = list(range(-1, k - 1)), [*range(1, k), -1]
    left = list(range(-1, n - 1))
    done = bytearray(n)
    before = [-1] * n
    out: list[list[int]] = []
    g = k - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in own:
            done[i] = 1
        count: dict[int, int] = {}
        for i in own:
            j = left[i]
            if j >= 0 and done[j]:
                path = [i]
                while j >= 0 and done[j]:
                    path.append(j)
                    j = left[j]
                for x in path:
                    left[x] = j
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p, c in count.items():
            split.setdefault((group[p], c), []).append(p)
        base = above = -1
        for old, c in sorted(split):
            if old != base:
                base = above = old
            new = len(members)
            moved = split[old, c]
            members.append(moved)
            for p in moved:
                group[p] = new
            up = upper[above]
            lower.append(above)
            upper.append(up)
            upper[above] = new
            if up >= 0:
                lower[up] = new
            above = new
        if own:
            out.append(own)
        g = lower[g]
    return out[::-1], before


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of s, whose last symbol is its unique smallest."""
    groups, before = lyndon_groups(s)
    n = len(s)
    slot = [0] * n
    cursor, at = [], 0
    for k, own in enumerate(groups):
        cursor.append(at)
        at += len(own)
        for i in own:
            slot[i] = k
    order = [-1] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    cursor[slot[n - 1]] += 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = slot[j]
            order[cursor[g]] = j
            cursor[g] += 1
            placed[j] = 1
            j = before[j]
    return order


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes, ``limit`` at most, are the same from places a and b on; words: the eight bytes at each place."""
    out = np.zeros(len(a), np.int64)
    live, at = np.flatnonzero(limit > 0), 0
    while len(live):
        x = (words[a[live] + at] ^ words[b[live] + at]).view("<u8").ravel()
        low = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest bit that differs, a power of two
        out[live] += np.where(x == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
        at += 8
        live = live[(x == 0) & (limit[live] > at)]
    return np.minimum(out, limit)


class Lowest:
    """Minimum of any stretch of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            v, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(v[:-step], v[step:]))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Over [begin, end), none of them empty."""
        out = np.zeros(len(begin), np.int64)
        level = np.log2(end - begin).astype(np.int64)
        for k in range(len(self.levels)):
            here = np.flatnonzero(level == k)
            if len(here):
                out[here] = np.minimum(self.levels[k][begin[here]], self.levels[k][end[here] - (1 << k)])
        return out


def repeated(units: list[bytes], strings: list[int], length: int = LENGTH) -> np.ndarray:
    """For the first ``strings[k]`` strings of each unit, one after another: does an equal string start anywhere else in the units?

    The suffix array orders the suffixes at phrase starts, and its neighbours' common prefixes are compared byte by byte.
    A string is the bytes before its first phrase start, its head, and what follows. Strings of equal heads are sorted by
    the rank of what follows: two neighbours are equal if that has a common prefix as long as the rest of the string.
    """
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(data)
    roll = Rolling(data)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(length + 8, np.uint8))), 8)
    # phrase starts: places whose next TRIGGER bytes hash to zero
    flags = np.zeros(n, bool)
    at = np.arange(max(0, n - TRIGGER + 1))
    flags[: len(at)] = (roll.of(at, at + TRIGGER) >> np.uint64(64 - PHRASE_BITS)) == 0
    for e in range(1, TRIGGER):
        flags[np.maximum(ends - e, 0)] = False
    cuts = np.flatnonzero(flags)
    owner = np.searchsorted(ends, cuts, side="right")
    stop = np.minimum(np.append(cuts[1:], n), ends[owner])
    whole = data.tobytes()
    # a phrase reads on over the next trigger, which makes the numbered phrases free of prefixes
    phrases = [whole[a:b] for a, b in zip(cuts.tolist(), np.minimum(stop + TRIGGER, ends[owner]).tolist(), strict=True)]
    number = {p: k for k, p in enumerate(sorted(set(phrases)), len(units) + 1)}
    symbols: list[int] = []
    where: list[int] = []
    by_unit = np.searchsorted(owner, np.arange(len(units) + 1)).tolist()
    places = cuts.tolist()
    for k in range(len(units)):
        a, b = by_unit[k], by_unit[k + 1]
        symbols += map(number.__getitem__, phrases[a:b])
        where += places[a:b]
        symbols.append(len(units) - k)  # a separator of its own
        where.append(-1)
    symbols.append(0)
    where.append(-1)
    order = np.array(where)[np.array(suffix_array(symbols))]
    order = order[order >= 0]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.arange(len(order))
    room = ends[np.searchsorted(ends, order, side="right")] - order
    # shared[r]: common prefix of the suffixes of ranks r and r + 1
    shared = Lowest(common(words, order[:-1], order[1:], np.minimum(np.minimum(room[:-1], room[1:]), length)) if len(order) > 1 else np.zeros(1, np.int64))
    counts = np.array(strings)
    i = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    cut = np.append(cuts, n)[np.searchsorted(cuts, i)]
    none = cut + TRIGGER > i + length  # no phrase start that the string holds whole: it is all head
    cut = np.where(none, i + length, cut)
    size = cut - i
    tail = np.where(none, 0, rank[np.minimum(cut, n)])
    head = roll.of(i, cut) + size.astype(np.uint64)
    while True:
        by = np.lexsort((tail, head))
        x, y = by[:-1], by[1:]
        alike = head[x] == head[y]
        same = alike & (size[x] == size[y])
        told = (same == alike).all()
        ask = np.flatnonzero(same & ~none[x])
        ask = ask[tail[x[ask]] < tail[y[ask]]]
        same[ask] = shared.of(tail[x[ask]], tail[y[ask]]) >= (length - size)[x[ask]]
        pairs = np.flatnonzero(same)
        told = told and (common(words, i[x[pairs]], i[y[pairs]], size[x[pairs]]) == size[x[pairs]]).all()
        if told:
            break
        # two different heads share a hash: number the heads themselves
        heads = [whole[a:b] for a, b in zip(i.tolist(), cut.tolist(), strict=True)]
        numbers = {h: k for k, h in enumerate(set(heads))}
        head = np.fromiter(map(numbers.__getitem__, heads), np.uint64, len(heads))
    out = np.zeros(len(i), bool)
    out[y[pairs]] = True
    out[x[pairs]] = True
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Texts of ``length`` bytes at least in runs of bounded size, long ones in overlapping pieces: (text, begin, end)."""
    text, begin, end, size = [], [], [], 0
    for k in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[k]), int(offsets[k + 1])
        while b - a >= length:
            e = min(b, a + PIECE)
            if size and size + e - a > RUN_BYTES:
                yield text, begin, end
                text, begin, end, size = [], [], [], 0
            text.append(k)
            begin.append(a)
            end.append(e)
            size += e - a
            a = e - length + 1
    if text:
        yield text, begin, end


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, text) to (g, key, at, strings): the units of every text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        keys = batch.column("key").to_numpy()
        for text, begin, end in pieces(offsets, length):
            joined = np.concatenate([data[a:b] for a, b in zip(begin, end, strict=True)])
            size = np.array(end) - np.array(begin)
            stops = np.cumsum(size)
            k, first, count, _, gram = anchors(joined, stops - size, stops, length)
            row = np.array(text)[k]
            at = first - (stops - size)[k] + np.array(begin)[k] - offsets[row]
            yield pa.RecordBatch.from_pydict({"g": gram, "key": keys[row], "at": at.astype(np.int32), "strings": count.astype(np.int32)})


UNIT = pa.schema([("g", pa.int64()), ("c", pa.binary()), ("key", pa.int64()), ("at", pa.int32()), ("strings", pa.int32()), ("body", pa.binary())])


def digest(body: bytes) -> bytes:
    """128 bits of BLAKE2b: what is known by it counts as equal."""
    return hashlib.blake2b(body, digest_size=16).digest()


def _unit_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, text, found: units of repeated anchors) to units (g, c, key, at, strings, body); those of hot anchors in blocks.

    Of the equal units that one task meets, some have no body: one has.
    """
    from xxhash import xxh3_64_intdigest

    seen: set[tuple[int, bytes]] = set()

    def row(g: int, key: int, at: int, strings: int, part: bytes) -> tuple:
        c = digest(part)
        if (g, c) in seen:
            return g, c, key, at, strings, None
        if len(seen) == SEEN:
            seen.clear()
        seen.add((g, c))
        return g, c, key, at, strings, part

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), UNIT, strict=True)], schema=UNIT)

    for batch in batches:
        out: list[tuple] = []
        size = 0
        for key, text, found in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
            body = (text.as_py() or "").encode()
            for unit in found:
                at, n = unit["at"], unit["strings"]
                if unit["n"] <= HOT:
                    part = body[at : at + n - 1 + length]
                    out.append(row(unit["g"], key, at, n, part))
                    size += len(part)
                else:
                    # the anchor is in the unit's first string: the gram of the least hash there. Blocks lie alike around
                    # it, and the bytes that all strings of a block share name it
                    back = int(anchors(np.frombuffer(body[at : at + length], np.uint8), np.array([0]), np.array([length]), length)[3][0])
                    cuts = [0, *range(back % BLOCK or BLOCK, n, BLOCK), n]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if a == b:
                            continue
                        part = body[at + a : at + b - 1 + length]
                        shape = (back - a - 1) // BLOCK
                        core = body[at + back - (shape * BLOCK) - 1 : at + back - (shape + 1) * BLOCK + length]
                        name = xxh3_64_intdigest(core, shape & 0xFFFF)
                        out.append(row(name - (1 << 64) if name >> 63 else name, key, at + a, b - a, part))
                        size += len(part)
                if size > RUN_BYTES:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)


def _array_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Different units (g, c, strings, m: rows of it, body), sorted by g, to the runs of strings that repeat in those that come once: (g, c, runs)."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        flags = repeated([r[4] for r in rows], [r[2] for r in rows], length)
        out, at = [], 0
        for g, c, n, m, _ in rows:
            found = runs(flags[at : at + n]) if m == 1 else []
            if found:
                out.append((g, c, [{"begin": a, "end": b} for a, b in found]))
            at += n
        if out:
            g, c, found = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int64()), "c": pa.array(c, pa.binary()), "runs": pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))})

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "strings", "m", "body")), strict=True):
            if size > RUN_BYTES and held[-1][0] != row[0]:
                yield from solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    yield from solve(held)


def _single_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks (g, c, strings, m, body) to their single strings: (g, c, m, at, h)."""
    for batch in batches:
        for g, c, n, m, body in zip(*(batch.column(x).to_pylist() for x in ("g", "c", "strings", "m", "body")), strict=True):
            h = [digest(body[k : k + length]) for k in range(n)]
            yield pa.RecordBatch.from_pydict({"g": pa.array([g] * n, pa.int64()), "c": pa.array([c] * n, pa.binary()), "m": pa.array([m] * n, pa.int64()), "at": np.arange(n, dtype=np.int32), "h": pa.array(h, pa.binary())})


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans) for the texts that hold repeated strings; docs: key, text. Spans are [from, to) in bytes, not merged."""

    def mapped(df: DataFrame, run, fields: str) -> DataFrame:
        return df.mapInArrow(trimmed(partial(run, length=length)), fields)

    units = stash(mapped(docs, _anchor_rows, "g long, key long, at int, strings int"), "anchors")
    often = stash(units.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "often")
    found = join_hot(units, often.select("g", "n", F.col("n").alias("count")), ["g"], units.count())
    wanted = found.groupBy("key").agg(F.collect_set(F.struct("g", "at", "strings", F.col("count").alias("n"))).alias("found"))
    rows = stash(mapped(docs.join(wanted.hint("merge"), "key").select("key", "text", "found"), _unit_rows, "g long, c binary, key long, at int, strings int, body binary"), "units")
    unstash(units, often)
    kinds = stash(rows.groupBy("g", "c", "strings").agg(F.count("*").alias("n")), "kinds")
    several = stash(kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("kinds > 1"), "several")
    n_rows = rows.count()
    bodies = join_hot(rows.select("g", "c", "strings", "body"), several, ["g"], n_rows)
    bodies = stash(bodies.groupBy("g", "c", "strings", "kinds").agg(F.count("*").alias("m"), F.first("body", ignorenulls=True).alias("body")), "bodies")
    parts = ("g", "c", "strings", "m", "body")
    by_array = mapped(bodies.where(F.col("kinds") <= HOT).select(*parts).repartition("g").sortWithinPartitions("g", "c"), _array_rows, "g long, c binary, runs array<struct<begin:int,end:int>>")
    singles = stash(mapped(bodies.where(F.col("kinds") > HOT).select(*parts), _single_rows, "g long, c binary, m long, at int, h binary"), "singles")
    twice = stash(singles.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    by_count = join_hot(singles.where("m = 1"), twice, ["h"], singles.count()).groupBy("g", "c").agg(F.collect_list(F.struct(F.col("at").alias("begin"), (F.col("at") + 1).alias("end"))).alias("runs"))
    alike = kinds.where("n > 1").select("g", "c", F.array(F.struct(F.lit(0).alias("begin"), F.col("strings").alias("end"))).alias("runs"), "n")
    marks = stash(alike.unionByName(by_array.unionByName(by_count).withColumn("n", F.lit(1).cast("long"))), "marks")
    unstash(kinds, several, bodies, singles, twice)
    spans = join_hot(rows.select("g", "c", "key", "at"), marks, ["g", "c"], n_rows).select("key", "at", F.inline("runs"))
    return spans.groupBy("key").agg(F.collect_set(F.struct((F.col("at") + F.col("begin")).alias("a"), (F.col("at") + F.col("end") - 1 + length).alias("b"))).alias("spans"))


def spans_of(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, str]:
    """docs with a last column of spans (null: none), and its name. Rows of equal doc_id and text share what is found."""
    key, spans = fresh(docs.columns, "key", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("*", F.xxhash64(F.col("doc_id"), text).alias(key))
    found = repeated_spans(docs.select(F.xxhash64(F.col("doc_id"), text).alias("key"), text.alias("text")), length)
    found = found.select(F.col("key").alias(key), F.col("spans").alias(spans))
    return rows.join(found.hint("merge"), key, "left").select(*own(docs), spans), spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the contract of op6."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                body = (text.as_py() or "").encode()
                gone = merged(spans or [])
                rows["n_bytes"].append(len(body))
                rows["n_removed"].append(sum(b - a for a, b in gone))
                rows["n_spans"].append(len(gone))
                rows["kept_sha256"].append(hashlib.sha256(kept(body, gone)).hexdigest())
            yield pa.RecordBatch.from_pydict(rows)

    found, _ = spans_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs without strings of ``length`` bytes that repeat. A cut inside a character drops what is left of it; n_chars, if there, follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            hit = {i: merged(s) for i, s in enumerate(batch.columns[-1].to_pylist()) if s}
            if hit:
                at = names.index("text")
                texts = columns[at].to_pylist()
                for i, gone in hit.items():
                    texts[i] = kept(texts[i].encode(), gone).decode(errors="ignore")
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    n = columns[names.index("n_chars")].to_pylist()
                    for i in hit:
                        n[i] = len(texts[i])
                    columns[names.index("n_chars")] = pa.array(n, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_rows(spans_of(docs, length)[0], run, docs.schema)
