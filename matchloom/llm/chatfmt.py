"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: body</turn>`` and a line end. The parser is deterministic: a backslash takes the next
character as it is, and the first bare ``</turn>`` ends the body. A turn is rendered plainly first and parsed again; if
what comes back is not the turn, the conflicting content is escaped, and the result is parsed again and must be identical.

Defined results: null text and null role count as empty; turns are ordered by turn, then role, then text, null first;
rows without conv_id form one conversation; an empty table gives no rows; other columns are ignored. A conversation of
any length is streamed: the formatted turns are made by any task, and only the digests of one conversation, which are
sequential, are folded by one task with constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

OPEN, CLOSE, END = "### ", ": ", "</turn>\n"
#: What the grammar gives a meaning to: the escape itself, the marks of a turn's start and end, and a role's end.
CONTROL = re.compile(r"\\|###|</turn>|:(?= )")
BODY = re.compile(r"(?:[^\\<]++|\\.|<(?!/turn>))*+", re.S)
ROLE = re.compile(r"(?:[^\\:]++|\\.|:(?! ))*+", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int] | None:
    """(role, text, span of the body, end) of the turn that starts at ``at``; None if none does."""
    if not text.startswith(OPEN, at):
        return None
    role = ROLE.match(text, at + len(OPEN))
    if not text.startswith(CLOSE, role.end()):
        return None
    body = BODY.match(text, role.end() + len(CLOSE))
    if not text.startswith(END, body.end()):
        return None
    return unescape(role[0]), unescape(body[0]), body.span(), body.end() + len(END)


def parse_all(text: str) -> list[tuple[str, str]]:
    """Turns of a whole formatted conversation."""
    out, at = [], 0
    while at < len(text):
        turn = parse(text, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        out.append(turn[:2])
        at = turn[3]
    return out


def render(role: str, text: str) -> str:
    """The formatted turn: plain if it reads back as it is, else escaped."""
    for r, t in ((role, text), (escape(role), escape(text))):
        out = f"{OPEN}{r}{CLOSE}{t}{END}"
        back = parse(out)
        if back is not None and back[:2] == (role, text) and back[3] == len(out) and "###" not in t.replace(r"\###", ""):
            return out
    raise ValueError("the turn does not survive a round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """A stashed table conv_id, turn, role, text_order, chunk, body_start, body_end, learned: a conversation is its chunks in order."""
    schema = "conv_id long, turn long, role string, text string, chunk string, body_start int, body_end int, learned boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            chunks = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            spans = [parse(c)[2] for c in chunks]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"), "text": batch.column("text"), "chunk": pa.array(chunks, pa.string()),
                    "body_start": pa.array([s[0] for s in spans], pa.int32()), "body_end": pa.array([s[1] for s in spans], pa.int32()), "learned": pa.array([r == LEARNED for r in roles], pa.bool_()),
                }
            )

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return stash(rows.mapInArrow(run, schema), "chat")


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from the chunks, one row for each conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        state: list = []

        def row() -> dict:
            return {"conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        done: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "body_start", "body_end", "learned")]
            for conv, chunk, a, b, learned in zip(*columns, strict=True):
                if conv != key or key is run:
                    if state:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_all(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if learned:
                    masked = unescape(chunk[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(chunk)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "chunk", "body_start", "body_end", "learned").mapInArrow(run, schema)
