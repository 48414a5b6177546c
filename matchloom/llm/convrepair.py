"""Conversation structure repair: a min-plus scan of 4x4 matrices over the turns of a conversation.

The roles of a whole conversation read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn. A row is
kept (cost 0), given the role that fits (2) or deleted (3), and empty turns are inserted anywhere (2); blank rows and such
that were said before have to go, and a row whose text breaks off costs one more if it stays. Among the cheapest edits the
string of their initials (K, R, D, I) that is least in ASCII wins.

The grammar has four states: start, s, u and a. A row is a matrix of (cost, audit) from state to state, with the closure
over inserts before it; matrices multiply by adding costs and joining audits, and the lesser of (cost, audit) survives. At
equal cost no audit of a cell is the beginning of another (the longer one would hold inserts that cost more), so what is
less stays less whatever comes before or behind: the product is associative, and a conversation is a tree of products.

One range exchange puts the rows in order. A conversation that begins and ends within a task and fits into ``CHUNK`` rows
and ``CHUNK_BYTES`` is finished there. Any other is cut into pieces: texts said in an earlier task are found by a grouping
of their SHA-256, each piece becomes one matrix, the pieces of a task are multiplied, then sixteen neighbouring tasks at a
time, in rounds. The repaired turns of such a conversation are streamed in order by one task, a piece at a time, since its
digest is sequential; that task holds the conversation's audit, a byte an edit, which is a value of the result.

Defined results: null role or text counts as one space (as do null ids in the key of ``damage``); turns are ordered by turn
(null first), then role, then text; rows without conv_id are one conversation; a conversation without rows has zeros and
an empty audit; an empty table gives no rows; other columns are ignored. Equal rows of one turn count as copies of each
other; a (conversation, turn) that holds more than a 2,048th of all rows is summed up before the exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, stash, trimmed

#: Rows and bytes of text that are held at once.
CHUNK, CHUNK_BYTES = 4096, 4 << 20
#: Pieces that one step of the tree multiplies, as a power of two.
FAN = 4
#: Code points of a text that the range exchange looks at.
PREFIX = 64

START, S, U, A = range(4)
BLANK = " \t\n\v\f\r"
LEAF = 8
ROLES = {U: "user", A: "assistant"}

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]


def follow(state: int) -> int:
    """The state that a user or assistant turn leads to."""
    return A if state == U else U


def matrix(cells: dict[tuple[int, int], Cell]) -> Matrix:
    return tuple(tuple(cells.get((i, j)) for j in range(4)) for i in range(4))


def product(left: Matrix, right: Matrix) -> Matrix:
    return tuple(
        tuple(min(((x[0] + y[0], x[1] + y[1]) for x, y in zip(row, column, strict=True) if x is not None and y is not None), default=None) for column in zip(*right, strict=True))
        for row in left
    )


#: No edit, or inserts along the shortest way from state to state.
INSERTS = matrix({(i, i): (0, "") for i in range(4)} | {(i, follow(i)): (2, "I") for i in range(4)} | {(START, A): (4, "II"), (S, A): (4, "II")})


@lru_cache(64)
def of_row(kind: str) -> Matrix:
    """A row's matrix. kind: the role's initial, o for any other; a capital if its text breaks off; d if it has to go."""
    cells: dict[tuple[int, int], Cell] = {(i, i): (3, "D") for i in range(4)}
    more, initial = int(kind.isupper()), kind.lower()
    if initial != "d":
        for i in range(4):
            cells[i, follow(i)] = (more, "K") if initial == "ua"[follow(i) - U] else (2 + more, "R")
        if initial == "s":
            cells[START, S] = (more, "K")
    return product(INSERTS, matrix(cells))


@lru_cache(1 << 14)
def leaf(kinds: str) -> Matrix:
    out = of_row(kinds[0])
    for kind in kinds[1:]:
        out = product(out, of_row(kind))
    return out


def of_rows(kinds: str) -> Matrix:
    """The product of the rows' matrices, as a balanced tree. No rows: the identity, which has no inserts of its own."""
    if not kinds:
        return matrix({(i, i): (0, "") for i in range(4)})
    if len(kinds) <= LEAF:
        return leaf(kinds)
    half = (len(kinds) // 2 + LEAF - 1) // LEAF * LEAF
    return product(of_rows(kinds[:half]), of_rows(kinds[half:]))


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from the start to the start or to an assistant's turn."""
    row = product(whole, INSERTS)[START]
    return min(x for x in (row[START], row[A]) if x is not None)


Row = tuple[int | None, str, str, int]  # turn, role, text, copies


def key_of(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


class Facts:
    """What rows in order say: their kinds (copies behind each row as d), faults, illegal neighbours and turns."""

    def __init__(self, rows: list[Row], repeated: list[bool]):
        kinds: list[str] = []
        blank = duplicate = truncated = illegal = turns = 0
        self.first = self.last = self.low = self.high = None
        for (turn, role, text, n), again in zip(rows, repeated, strict=True):
            initial, said = role[:1], text.rstrip(BLANK)
            kind = initial if initial in ("s", "u", "a") else "o"
            if not said:
                blank += n
                kind = "d"
            elif again:
                duplicate += n
                kind = "d"
            else:
                duplicate += n - 1
                if said[-1] not in ".!?":
                    truncated += 1
                    kind = kind.upper()
            kinds.append(kind + "d" * (n - 1))
            illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
            if self.first is None:
                self.first = initial
            self.last = initial
            if turn is not None and turn != self.high:
                self.low, self.high, turns = (turn if self.low is None else self.low), turn, turns + 1
        self.kinds, self.counts = kinds, [blank, duplicate, truncated, illegal, turns]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.counts[4]


class Repair:
    """Applies an audit to rows that come a few at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.any = hashlib.sha256(), False

    def said(self, out: list[dict], role: str, text: str, edit: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True
        out.append({"role": role, "text": text, "edit": edit})

    def inserts(self, out: list[dict]) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = follow(self.state)
            self.said(out, ROLES[self.state], "", "I")

    def turns(self, rows: list[Row]) -> list[dict]:
        """The turns that stay, and such as are inserted before them."""
        out: list[dict] = []
        for _, role, text, n in rows:
            for _ in range(n):
                self.inserts(out)
                edit = self.audit[self.at]
                self.at += 1
                if edit == "D":
                    continue
                self.state = S if edit == "K" and role[:1] == "s" else follow(self.state)
                self.said(out, role if edit == "K" else ROLES[self.state], text, edit)
        return out

    def rest(self) -> list[dict]:
        out: list[dict] = []
        self.inserts(out)
        return out


TURNS = "array<struct<role:string,text:string,edit:string>>"
REPAIRED = f"conv_id long, part long, chunk long, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns {TURNS}"
ROWS = "array<struct<turn:long,role:string,text:string,n:long>>"
FOUND = f"{REPAIRED}, rows {ROWS}, keys array<binary>"
ELEMENT = "cost array<long>, audit array<string>, counts array<long>, first string, last string, low long, high long"
NAMES = ("blank", "duplicate", "truncated", "illegal")

_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
_ROW = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), *((c, pa.int64()) for c in ("gaps", *NAMES, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", _TURN)]
)
_FOUND = pa.schema([*_REPAIRED, ("rows", _ROW), ("keys", pa.list_(pa.binary()))])
_ELEMENT = [("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())]


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += 1 + sum(len(t["text"]) for t in row.get("turns") or row.get("rows") or ()) * size // CHUNK_BYTES
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with one of five faults in four out of twenty, by their key: conv_id, turn, role, text, n (copies; 0: dropped).

    A dropped row stays as a mark of its conversation, without a turn.
    """
    ids = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.encode(F.concat_ws(":", *ids), "UTF-8")), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kept = kind != 0
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(kept, F.col("turn").cast("long")).alias("turn"), F.when(kept, F.when(kind == 4, "user").otherwise(role)).alias("role"),
        F.when(kept, F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)).alias("text"), F.when(~kept, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in order over all tasks; those of a (conversation, turn) that holds many are summed up first."""
    bar = max(1000, rows.count() // HOT_KEYS)
    by = ["conv_id", "turn", "role", "text"]
    hot = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("rows")).where(F.col("rows") > bar).select(F.struct("conv_id", "turn").alias("key"))
    if not hot.isEmpty():  # at most HOT_KEYS of them
        at = F.struct("conv_id", "turn")
        many = rows.join(F.broadcast(hot), at.eqNullSafe(F.col("key")), "left_semi").groupBy(*by).agg(F.sum("n").alias("n"))
        rows = rows.join(F.broadcast(hot), at.eqNullSafe(F.col("key")), "left_anti").unionByName(many)
    return rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions(*by)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of rows (conv_id, turn, role, text, n copies; n = 0 only names a conversation).

    A stashed table in pieces: the turns of a piece in order, with the edit that each took; what holds for the whole
    conversation (gaps, faults, illegal neighbours, cost, audit, SHA-256 of its ``role:text`` lines) stands in its last.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            held: list[Row] = []
            keys: list[bytes | None] = []
            known: set[bytes] = set()
            conv: object = out
            begins, weight, chunk = False, 0, 0  # chunks are numbered through all of a task's pieces

            def row(ends: bool) -> dict:
                nonlocal begins, chunk
                if begins and ends:
                    facts = Facts(held, [k is None for k in keys])
                    cost, audit = cheapest(of_rows("".join(facts.kinds)))
                    of = Repair(audit)
                    turns = of.turns(held) + of.rest()
                    return {"conv_id": conv, "part": part, "chunk": 0, "last": True, "gaps": facts.gaps(), **dict(zip(NAMES, facts.counts, strict=False)), "cost": cost, "audit": audit, "repaired_sha256": of.hash.hexdigest(), "turns": turns}
                begins, chunk = False, chunk + 1
                return {"conv_id": conv, "part": part, "chunk": chunk, "rows": [dict(zip(("turn", "role", "text", "n"), r, strict=True)) for r in held], "keys": list(keys)}

            for batch in batches:
                for at, turn, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n")), strict=True):
                    if at != conv:
                        if conv is not out:
                            yield row(True)
                        begins, conv = conv is not out, at
                        held, keys, known, weight = [], [], set(), 0
                    elif len(held) >= CHUNK or weight >= CHUNK_BYTES:
                        yield row(False)
                        held, keys, weight = [], [], 0
                    if n:
                        key = key_of(role, text)
                        keys.append(None if key in known else key)
                        known.add(key)
                        held.append((turn, role, text, n))
                        weight += len(text)
            if conv is not out:
                yield row(False)

        yield from batched(out(), _FOUND)

    found = stash(ordered(rows).mapInArrow(trimmed(finish), FOUND), "turns")
    pieces, names = found.where("rows IS NOT NULL"), [f.name for f in _REPAIRED]
    long = _long(pieces)
    return stash(found.where("rows IS NULL").select(*names).unionByName(long.select(*names)), "repaired")


def _long(pieces: DataFrame) -> DataFrame:
    """``repair`` of the conversations that no task holds whole, from their pieces."""
    keys = pieces.select("conv_id", "part", "chunk", F.posexplode("keys").alias("k", "key")).where("key IS NOT NULL")
    firsts = keys.groupBy("conv_id", "key").agg(F.min("part").alias("begun"), F.max("part").alias("seen")).where("begun < seen")
    a, b = keys.alias("a"), firsts.alias("b")
    again = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.part") > F.col("b.begun")))
    late = again.groupBy("a.part", "a.chunk").agg(F.collect_list("k").alias("late"))
    marked = pieces.join(late.hint("merge"), ["part", "chunk"], "left")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, chunk, rows, keys, late in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "chunk", "rows", "keys", "late")), strict=True):
                again = set(late or ())
                facts = Facts([tuple(r.values()) for r in rows], [k is None or i in again for i, k in enumerate(keys)])
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "chunk": chunk, "rows": rows} | element(of_rows("".join(facts.kinds)), facts)], schema=weighed)

    weighed = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("rows", _ROW), *_ELEMENT])
    elements = stash(marked.select("conv_id", "part", "chunk", "rows", "keys", "late").mapInArrow(trimmed(weigh), f"conv_id long, part long, chunk long, rows {ROWS}, {ELEMENT}"), "pieces")

    tree = elements.drop("rows").groupBy("conv_id", "part").applyInArrow(joined, f"conv_id long, part long, chunk long, {ELEMENT}")
    width = (elements.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width >> FAN)
        tree = tree.withColumn("chunk", F.col("part")).withColumn("part", F.shiftright("part", FAN)).groupBy("conv_id", "part").applyInArrow(joined, f"conv_id long, part long, chunk long, {ELEMENT}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            of, whole = None, None
            for batch in batches:
                for x in batch.to_pylist():
                    if x["rows"] is None:  # the whole conversation comes before its pieces
                        if whole:
                            yield end(of, whole)
                        whole, (cost, audit) = x, cheapest(cells(x))
                        of, whole["answer"] = Repair(audit), (cost, audit)
                    else:
                        yield {"conv_id": x["conv_id"], "part": x["part"], "chunk": x["chunk"], "last": False, "turns": of.turns([tuple(r.values()) for r in x["rows"]])}
                        whole["part"], whole["chunk"] = x["part"], x["chunk"] + 1
            if whole:
                yield end(of, whole)

        yield from batched(out(), _REPAIRED)

    def end(of: Repair, whole: dict) -> dict:
        turns = of.rest()
        gaps = 0 if whole["low"] is None else whole["high"] - whole["low"] + 1 - whole["counts"][4]
        return {"conv_id": whole["conv_id"], "part": whole["part"], "chunk": whole["chunk"], "last": True, "gaps": gaps, **dict(zip(NAMES, whole["counts"], strict=False)), "cost": whole["answer"][0], "audit": whole["answer"][1], "repaired_sha256": of.hash.hexdigest(), "turns": turns}

    heads = tree.withColumns({"part": F.lit(-1).cast("long"), "rows": F.lit(None).cast(ROWS)})
    stream = heads.unionByName(elements.select("conv_id", "part", "chunk", "rows"), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return stream.mapInArrow(trimmed(apply), REPAIRED)


def element(whole: Matrix, facts: Facts) -> dict:
    flat = [x for row in whole for x in row]
    return {"cost": [None if x is None else x[0] for x in flat], "audit": [None if x is None else x[1] for x in flat], "counts": facts.counts, "first": facts.first, "last": facts.last, "low": facts.low, "high": facts.high}


def cells(x: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(x["cost"], x["audit"], strict=True)]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def joined(group: pa.Table) -> pa.Table:
    """The element of neighbouring elements (of one conversation and part, in the order of chunk)."""
    rows = sorted(group.to_pylist(), key=lambda x: x["chunk"])
    out, whole = rows[0], cells(rows[0])
    for x in rows[1:]:
        whole = product(whole, cells(x))
        out["counts"] = [a + b for a, b in zip(out["counts"], x["counts"], strict=True)]
        if out["last"] is not None and x["first"] is not None:
            out["counts"][3] += out["last"] + x["first"] not in ("su", "ua", "au")
        out["counts"][4] -= out["high"] is not None and out["high"] == x["low"]
        out["first"], out["last"] = out["first"] if out["first"] is not None else x["first"], out["last"] if x["last"] is None else x["last"]
        out["low"], out["high"] = out["low"] if out["low"] is not None else x["low"], out["high"] if x["high"] is None else x["high"]
    flat = [x for row in whole for x in row]
    out |= {"cost": [None if x is None else x[0] for x in flat], "audit": [None if x is None else x[1] for x in flat]}
    return pa.Table.from_pylist([{k: out[k] for k in ("conv_id", "part", "chunk", "cost", "audit", "counts", "first", "last", "low", "high")}], schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), *_ELEMENT]))


def digests(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``."""
    return repaired.where("last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
