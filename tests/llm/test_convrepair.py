"""Conversation structure repair against a plain search."""

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from matchloom.llm import convrepair
from matchloom.llm.queries import QUERIES

ROW = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def nulls_first(x):
    return [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, sha256) by a search from the end; rows: (turn, role, text) in order."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        said = text.rstrip(" \t\n\v\f\r")
        fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else 3
        seen.add((role, text))
        kinds.append((role[:1], fault))
        if fault < 3:
            counts[fault] += 1
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    best = {}
    for k in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):

            @cache
            def at(state, inserts, k=k):
                ways = [(0, "")] if k == len(rows) and state in ("", "a") else []
                if k < len(rows):
                    initial, fault = kinds[k]
                    cost, rest = best[k + 1, state]
                    ways.append((3 + cost, "D" + rest))
                    if fault >= 2:
                        if initial == NEXT[state] or (state == "" and initial == "s"):
                            cost, rest = best[k + 1, initial]
                            ways.append((cost + (fault == 2), "K" + rest))
                        cost, rest = best[k + 1, NEXT[state]]
                        ways.append((2 + cost + (fault == 2), "R" + rest))
                if inserts < 3:
                    cost, rest = at(NEXT[state], inserts + 1)
                    ways.append((2 + cost, "I" + rest))
                return min(ways, default=(10**9, "~"))

            best[k, state] = at(state, 0)
    cost, audit = best[0, ""]
    lines, state, k = [], "", 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[k][1:]
        k += edit != "I"
        if edit != "D":
            state = role[:1] if edit == "K" else NEXT[state]
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    assert state in ("", "a") and k == len(rows)
    return (*counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    after = {}
    for conv, *row in damaged(rows):
        after.setdefault(conv, []).append(tuple(row))
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(after.get(conv, []), key=nulls_first)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *plain(own))
    return out


def run(spark, rows):
    found = convrepair.digests(convrepair.repair(convrepair.damage(spark.createDataFrame(rows, ROW)))).collect()
    assert len({x["conv_id"] for x in found}) == len(found)
    return {x["conv_id"]: tuple(x)[1:] for x in found}


def made(n, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "and", "", " \t", "Why? ", "ok. \n", "é?", "x " * 50 + ".", None]
    out = []
    for conv in range(n):
        turns = [r.randint(0, 12) if r.random() < 0.3 else k for k in range(r.randint(0, 14))]
        out += [(conv, None if r.random() < 0.05 else t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts) if r.random() < 0.6 else f"t{r.randint(0, 99)}.") for t in turns]
    return out


@pytest.mark.parametrize(("rows", "size"), [(4096, 4 << 20), (3, 4 << 20), (100, 9)])
def test_repair(spark, monkeypatch, rows, size):
    """Whole conversations in a task, and such as are cut into pieces of any size."""
    monkeypatch.setattr(convrepair, "CHUNK", rows)
    monkeypatch.setattr(convrepair, "CHUNK_BYTES", size)
    data = made(120, rows) + [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (-5, 0, "system", "x" * 5000)] + [(-9, t, "user", "same.") for t in range(60)]
    assert run(spark, data) == expected(data)


def test_one_long_conversation(spark, monkeypatch):
    """A conversation over all tasks, equal rows without end, and copies that are summed up before the exchange."""
    monkeypatch.setattr(convrepair, "HOT_KEYS", 4)
    r = random.Random(3)
    data = [(7, t, "user" if t % 2 else "assistant", r.choice(["Again.", f"text {t}.", f"cut {t}"])) for t in range(3000)] + [(7, 55, "user", "copy.")] * 1500 + [(8, 0, "user", "hi.")]
    assert run(spark, data) == expected(data)


def test_turns_come_back(spark):
    data = [(1, 0, "user", "q."), (1, 1, "user", "r."), (1, 2, "system", "s."), (2, 0, "assistant", "a.")]
    rows = spark.createDataFrame([(*d, 1) for d in data], ROW + ", n long")
    found = convrepair.repair(rows).select("conv_id", "part", "chunk", F.posexplode("turns").alias("k", "t")).orderBy("conv_id", "part", "chunk", "k").collect()
    said = {c: [(x["t"]["role"], x["t"]["text"], x["t"]["edit"]) for x in g] for c, g in groupby(found, key=lambda x: x["conv_id"])}
    assert said[1] == [("user", "q.", "K"), ("assistant", "", "I"), ("user", "r.", "K"), ("assistant", "s.", "R")]
    assert said[2] == [("user", "", "I"), ("assistant", "a.", "K")]


def test_products_are_associative():
    r = random.Random(1)
    for _ in range(60):
        kinds = "".join(r.choice("suaoSUAOd") for _ in range(r.randint(1, 40)))
        left = convrepair.of_row(kinds[0])
        for kind in kinds[1:]:
            left = convrepair.product(left, convrepair.of_row(kind))
        cut = r.randint(0, len(kinds))
        assert left == convrepair.of_rows(kinds) == convrepair.product(convrepair.of_rows(kinds[:cut]), convrepair.of_rows(kinds[cut:]))


def test_empty_and_other_columns(spark):
    empty = spark.createDataFrame([], ROW)
    assert convrepair.digests(convrepair.repair(convrepair.damage(empty))).collect() == []
    data = [(1, 0, "user", "a."), (1, 1, "assistant", "b.")]
    more = spark.createDataFrame([(*d, 5, "x", "y") for d in data], ROW + ", n long, part string, `rows` string")
    found = convrepair.digests(convrepair.repair(convrepair.damage(more))).collect()
    assert {x["conv_id"]: tuple(x)[1:] for x in found} == expected(data)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_conversation_repair"](spark, sf)
    assert {x["conv_id"]: tuple(x)[1:] for x in found.collect()} == expected(rows)
