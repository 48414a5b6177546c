"""Exact top-k search by inner product with MaxScore.

Terms are the dimensions. In a shard, each term's contribution to a query's score lies between two bounds; taken from
its lower bound, every contribution is non-negative, and terms can be sorted by how much they can add. While a query's
k-th best score is out of reach of its weakest terms together, those are non-essential: the essential terms' postings are
traversed for all vectors, and the other terms are probed, strongest first, only for vectors that can still compete. The
shards' best are merged by one window.

Vectors are packed in blocks, dealt over the tasks once and written; so are the queries. Queries go to all tasks in rounds
of at most ``QUERY_BYTES`` (a block at least), by broadcast. A task keeps the best of each query over its shards, and the
k-th best so far is the bar that the next shard starts from.

Defined results: a vector that is null or holds null or non-finite components takes no part; shorter vectors are read as
if zeros followed; an empty vector scores 0; a row of the query's own vec_id is never its candidate; repeated rows are
candidates each and, as queries, count once; of different vectors under one vec_id the least (element by element) is the
query and all are candidates; null vec_id takes no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash, trimmed

SHARD_ROWS, QUERY_ROWS, K, EVERY, SCALE = 16_384, 512, 5, 50, 256
#: Bytes of queries that are sent at once.
QUERY_BYTES = 8 << 20
FIRST, STEP = 256, 8


def usable(vector: str) -> Column:
    """Is the vector there, without null or non-finite components?"""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(column: pa.Array) -> list[np.ndarray]:
    """floor(SCALE * x) of each vector."""
    flat = np.floor(SCALE * column.values.to_numpy()).astype(np.int64)
    offsets = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def stack(vectors: list[np.ndarray]) -> np.ndarray:
    wide = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), wide), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def packed_blocks(rows: DataFrame, size: int, tag: str) -> DataFrame:
    """Stashed blocks of at most ``size`` usable vectors: at (a number of their own), n, wide, ids, data (integers of ``bytes`` bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            m = stack(vectors)
            m = m.astype(np.result_type(*(np.min_scalar_type(x) for x in (-1, m.min(initial=0), m.max(initial=0)))))
            return pa.RecordBatch.from_pydict(
                {"at": [(part << 32) + k], "n": [len(ids)], "wide": [m.shape[1]], "bytes": [m.itemsize], "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "data": pa.array([m.tobytes()], pa.binary())}
            )

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), quantised(batch.column("embedding")), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield flush()
                    ids, vectors, k = [], [], k + 1
        if ids:
            yield flush()

    made = rows.mapInArrow(trimmed(run), "at long, n long, wide long, bytes long, ids binary, data binary")
    return stash(made.repartition(shuffle_partitions(rows.sparkSession), "at"), tag)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Shard:
    """Vectors by term, with each term's bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.terms = np.ascontiguousarray(vectors.T)
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.real = self.terms.astype(np.float64)

    def search(self, query_id: int, q: np.ndarray, k: int, least: float = float("-inf")) -> tuple[np.ndarray, np.ndarray]:
        """The k best other rows: (ids, scores); such as score less than ``least`` may be left out."""
        wide = len(self.terms)
        q = np.concatenate((q, np.zeros(max(0, wide - len(q)), np.int64)))[:wide]
        exact = float(np.abs(q).max() if len(q) else 0) * self.largest * max(wide, 1) < 2**52
        terms, weights = (self.real, q.astype(np.float64)) if exact else (self.terms, q)
        rows = np.flatnonzero(self.ids != query_id)
        if len(rows) <= FIRST:
            s = (weights @ terms[:, rows]).astype(np.int64) if wide else np.zeros(len(rows), np.int64)
            top = best(self.ids[rows], s, k)
            return self.ids[rows[top]], s[top]
        # the bar that the first rows set
        s = weights @ terms[:, rows[:FIRST]]
        bar = max(np.partition(s, FIRST - k)[FIRST - k], least)
        ends = np.stack((weights * self.low, weights * self.high))
        floor, gain = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
        order = np.argsort(gain, kind="stable")
        reach = np.cumsum(gain[order])
        n_weak = int(np.searchsorted(reach, bar - floor.sum(), side="left"))  # their gains together stay below the bar
        weak, strong = order[:n_weak][::-1], order[n_weak:]
        score = weights[strong] @ terms[strong]
        live = rows
        part = score[live]
        ceiling = gain[weak] + floor[weak]
        for at in range(0, n_weak, STEP):
            near = part + ceiling[at:].sum() >= bar
            live, part = live[near], part[near]
            some = weak[at : at + STEP]
            part = part + weights[some] @ terms[np.ix_(some, live)]
            if len(part) > k:
                bar = max(bar, np.partition(part + floor[weak[at + STEP :]].sum(), len(part) - k)[len(part) - k])
        top = best(self.ids[live], part, k)
        return self.ids[live[top]], part[top].astype(np.int64)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best among all other rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("embedding"))
    shards = packed_blocks(rows, SHARD_ROWS, "shards")
    asked = packed_blocks(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), QUERY_ROWS, "queries")
    fields = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(r: dict) -> np.ndarray:
        return np.frombuffer(r["data"], f"<i{r['bytes']}").reshape(r["n"], r["wide"]).astype(np.int64)

    def searched(blocks: list[dict]) -> DataFrame:
        """The best of each task for the queries of some blocks."""
        shared = vectors.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = [(int(i), v) for b in shared.value for i, v in zip(np.frombuffer(b["ids"], np.int64), matrix(b), strict=True)]
            none = np.zeros(0, np.int64)
            top = [(none, none)] * len(queries)
            for batch in batches:
                for at in range(len(batch)):
                    r = batch.slice(at, 1).to_pylist()[0]
                    shard = Shard(np.frombuffer(r["ids"], np.int64), matrix(r))
                    for n, (i, v) in enumerate(queries):
                        ids, scores = top[n]
                        more = shard.search(i, v, k, int(scores[-1]) if len(scores) == k else float("-inf"))
                        ids, scores = np.concatenate((ids, more[0])), np.concatenate((scores, more[1]))
                        first = best(ids, scores, k)
                        top[n] = ids[first], scores[first]
            for n in range(0, len(queries), QUERY_ROWS):
                part = [(queries[m][0], *top[m]) for m in range(n, min(n + QUERY_ROWS, len(queries)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in part], [len(x[1]) for x in part]).astype(np.int64)), pa.array(np.concatenate([x[1] for x in part])), pa.array(np.concatenate([x[2] for x in part]))], schema=fields)

        return shards.select("n", "wide", "bytes", "ids", "data").mapInArrow(trimmed(run), "query_id long, vec_id long, score long")

    sizes = asked.select("at", (F.octet_length("ids") + F.octet_length("data")).alias("size")).orderBy("at").collect()  # a row for each block
    rounds: list[list[int]] = []
    room = 0
    for at, size in sizes:
        if size > room:
            rounds.append([])
            room = QUERY_BYTES
        rounds[-1].append(at)
        room -= size
    found = None
    for ats in rounds:
        blocks = [r.asDict() for r in asked.where(F.col("at").between(ats[0], ats[-1])).select("n", "wide", "bytes", "ids", "data").collect()]
        part = searched(blocks)
        part = part if len(rounds) == 1 else stash(part, "best")  # so that one round's queries are held at a time
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.col("vec_id").alias("score"))
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
