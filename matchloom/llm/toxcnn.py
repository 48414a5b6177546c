"""Toxicity: a convolutional text classifier in numpy.

Words are hashed into a table of embeddings; a word's vector is the sum of those of the whole word and of its first four
and first six bytes, so that inflected forms share what is learned. Filters of three widths run over them, each keeps its maximum over the
whole text, and a logistic layer joins the maxima. The gradient only reaches the windows that hold a maximum, so that
training costs little more than scoring. For scoring, each filter's product with each bucket's embedding is tabulated
once: a window's value is then a sum of table rows.

The model learns from all labelled rows that are not held out. They are dealt over parts of about ``PART_ROWS`` rows or
``PART_BYTES`` of text; in each epoch every part takes the steps of its rows from the same model, and what the parts have
learned is averaged: an embedding by how many of a part's steps reached it, all else by the rows of the part. With one part
these are the steps of ``Model.fit``. A fifth of all labelled rows (by the hash of doc_id, where there are 50 at least) is kept
out of the fit and gives each language its threshold: their scores, rounded to ``PLACES`` decimals, are counted by Spark.

Defined results: null and empty texts get the score of a text of padding alone; without labels of both kinds the score
is the share of label 1 (0 if there are none) everywhere; null language has a threshold of its own; a null doc_id is not
held out and has no label; repeated rows are scored each; an empty table gives no rows; other columns are kept, those
named like an added one only by ``keep_clean``.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import fresh, lower_table, map_rows, own, slices, stash, trimmed, unstash, utf8

PART_ROWS, PART_BYTES = 8_192, 1 << 25
#: Rows that a threshold takes to be kept out of the fit; decimals of the scores that are counted for it; pieces of the averages.
ENOUGH, PLACES, PIECES = 50, 5, 64
BUCKETS, WIDE, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 7, 32, 0.03, 5
DEFAULT_THRESHOLD = 0.3
#: Bytes of text that are scored at a time.
RUN_BYTES = 1 << 19
PAD = 0
#: A word is a run of letters, digits and non-ASCII bytes; case is dropped.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in lower_table())


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(BUCKETS - 1) + 1


def word_ids(text: bytes) -> np.ndarray:
    """Buckets of each word, its first four and its first six bytes; bucket 0 is padding: one row before the text, two after."""
    words = text.translate(TABLE).split()
    out = np.zeros((len(words) + 3, 3), np.int32)
    out[1:-2, 0] = hashed(words)
    out[1:-2, 1] = hashed([b"4" + w[:4] for w in words])
    out[1:-2, 2] = hashed([b"6" + w[:6] for w in words])
    return out


class Model:
    """score(ids, lengths) of texts that lie one after another."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.e = (r.normal(size=(BUCKETS, WIDE)) * 0.1).astype(np.float32)
        self.e[PAD] = 0
        # for each width and place in the window: WIDE x FILTERS
        self.w = [(r.normal(size=(w, WIDE, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.v = (np.abs(r.normal(size=(len(WIDTHS), FILTERS))) * 0.3).astype(np.float32)
        self.c = -2.0
        self.constant: float | None = None

    def tables(self) -> list[np.ndarray]:
        return [self.e @ w.transpose(1, 0, 2).reshape(WIDE, -1) for w in self.w]

    def score(self, ids: np.ndarray, lengths: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        starts = np.cumsum(lengths) - lengths
        # windows start anywhere but on the last two (padding) places of a text
        ends = starts + lengths - 2
        bounds = np.stack((starts, ends), axis=1).ravel()
        logit = np.full(len(lengths), self.c, np.float64)
        for table, w, b, v in zip(tables, WIDTHS, self.b, self.v, strict=True):
            rows = table[ids[:, 0]]
            rows += table[ids[:, 1]]
            rows += table[ids[:, 2]]
            value = rows[: len(ids) - w + 1, :FILTERS].copy()
            for k in range(1, w):
                value += rows[k : len(ids) - w + 1 + k, k * FILTERS : (k + 1) * FILTERS]
            if w < 3:  # so that the last text's end is a place of the array
                value = value[: len(ids) - 2]
            top = np.maximum.reduceat(np.concatenate((value, value[-1:], value[-1:])), bounds, axis=0)[::2]
            logit += np.maximum(top + b, 0) @ v
        return 1 / (1 + np.exp(-logit))

    def params(self) -> list[np.ndarray]:
        return [self.e, *self.w, self.b, self.v]

    def fresh_sums(self) -> list[np.ndarray]:
        """Sums of squared gradients before any step: those of ``params``, then that of c."""
        return [np.zeros(p.shape, np.float32) + np.float32(1e-3) for p in self.params()] + [np.full(1, 1e-3)]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return
        r = np.random.default_rng(SEED)
        seen = self.fresh_sums()
        rows = np.arange(len(texts))
        for epoch in range(EPOCHS):
            r.shuffle(rows)
            self.learn(texts, labels, rows, RATE * (1 - epoch / EPOCHS), seen)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, rate: float, seen: list[np.ndarray]) -> np.ndarray:
        """One epoch over the rows in their order; by how many steps each bucket was reached."""
        params, reached = self.params(), np.zeros(BUCKETS, np.int32)
        for at in range(0, len(rows), BATCH):
            batch = rows[at : at + BATCH]
            grads = [np.zeros_like(p) if k else None for k, p in enumerate(params)]
            touched, touched_by, grad_c = [], [], 0.0
            for i in batch.tolist():
                ids = texts[i]
                x = self.e[ids].sum(axis=1)
                n = len(ids) - 2
                tops, places = [], []
                for w, weight in zip(WIDTHS, self.w, strict=True):
                    value = sum(x[k : k + n] @ weight[k] for k in range(w))
                    place = value.argmax(axis=0)
                    places.append(place)
                    tops.append(value[place, np.arange(FILTERS)])
                hidden = np.maximum(np.stack(tops) + self.b, 0)
                p = 1 / (1 + np.exp(-(float((hidden * self.v).sum()) + self.c)))
                g = (p - labels[i]) / len(batch)
                grad_c += g
                grads[-1] += g * hidden
                back = np.where(hidden > 0, g * self.v, 0).astype(np.float32)
                grads[-2] += back
                for m, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                    for k in range(w):
                        grads[1 + m][k] += x[place + k].T * back[m]
                        touched.append(ids[place + k].ravel())
                        touched_by.append(np.repeat(self.w[m][k].T * back[m][:, None], 3, axis=0))
            cells, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            ge = np.zeros((len(cells), WIDE), np.float32)
            np.add.at(ge, inverse, np.concatenate(touched_by))
            ge[cells == PAD] = 0
            reached[cells] += 1
            seen[0][cells] += ge**2
            self.e[cells] -= rate * 3 * ge / np.sqrt(seen[0][cells])
            for p_, s, gr in zip(params[1:], seen[1:-1], grads[1:], strict=True):
                s += gr**2
                p_ -= rate * gr / np.sqrt(s)
            seen[-1] += grad_c**2
            self.c -= float(rate * grad_c / np.sqrt(seen[-1][0]))
        return reached


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the highest F1, midway in the gap it lies in; the default where labels can't tell."""
    values, at = np.unique(scores, return_inverse=True)
    return threshold_of(values, np.bincount(at, labels, len(values)), np.bincount(at, minlength=len(values)))


def threshold_of(values: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """``best_threshold`` of distinct scores, of so many rows each, so many of which have label 1."""
    if hits.sum() < 5 or hits.sum() == rows.sum():
        return DEFAULT_THRESHOLD
    order = np.argsort(-values)
    s = values[order]
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(rows[order]) + hits.sum())
    k = int(f1.argmax())
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Labelled rows (doc_id, text, toxic) as one row a part: its texts' buckets one after another, their lengths, labels."""

    def run(whole: pa.Table) -> pa.Table:
        whole = whole.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = [word_ids((t.as_py() or "").encode()).astype(np.uint16) for t in whole.column("text")]
        lengths, labels = np.array([len(x) for x in ids], np.int64), whole.column("toxic").to_numpy().astype(np.float64)
        out = (np.concatenate(ids).tobytes(), lengths.tobytes(), labels.tobytes())
        return pa.table([whole.column("part")[:1].cast(pa.int32()), *(pa.array([x], pa.binary()) for x in out)], names=["part", "ids", "lengths", "labels"])

    placed = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text", "toxic")
    return placed.groupBy("part").applyInArrow(run, "part int, ids binary, lengths binary, labels binary")


def pieces(model: Model, seen: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Model and sums in ``PIECES`` pieces and one: (those buckets' embeddings, their sums), then all other parameters and sums."""
    cut = zip(np.array_split(model.e, PIECES), np.array_split(seen[0], PIECES), strict=True)
    rest = np.concatenate([x.ravel().astype(np.float64) for x in (*model.params()[1:], np.array([model.c]), *seen[1:])])
    return [np.concatenate((e, s), axis=1).astype(np.float64) for e, s in cut] + [rest[None]]


def joined(parts: list[np.ndarray], model: Model, seen: list[np.ndarray]) -> None:
    """Put what ``pieces`` gave into the model and its sums."""
    both = np.concatenate(parts[:-1])
    model.e[:], seen[0][:] = both[:, :WIDE], both[:, WIDE:]
    rest, at = parts[-1].ravel(), 0
    for x in (*model.params()[1:], None, *seen[1:]):
        size = 1 if x is None else x.size
        if x is None:
            model.c = float(rest[at])
        else:
            x[:] = rest[at : at + size].reshape(x.shape)
        at += size


def epoch_over(parts: DataFrame, model: Model, seen: list[np.ndarray], epoch: int) -> None:
    """One epoch of all parts, each from the same model; the average of what they learned goes into model and sums."""
    shared = parts.sparkSession.sparkContext.broadcast(pickle.dumps((model, seen)))  # a few MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ids, lengths, labels in zip(*(b.column(k) for k in range(4)), strict=True):
                own_model, own_seen = pickle.loads(shared.value)
                before = pieces(own_model, own_seen)
                n = np.frombuffer(lengths.as_buffer(), np.int64)
                texts = np.split(np.frombuffer(ids.as_buffer(), np.uint16).reshape(-1, 3).astype(np.int32), np.cumsum(n)[:-1])
                rows = np.arange(len(n))
                np.random.default_rng((SEED, epoch, part.as_py())).shuffle(rows)
                reached = own_model.learn(texts, np.frombuffer(labels.as_buffer(), np.float64), rows, RATE * (1 - epoch / EPOCHS), own_seen)
                weights = [*np.array_split(reached.astype(np.float64), PIECES), np.array([float(len(n))])]
                out = [(k, part.as_py(), (w[:, None] * (x - y)).tobytes(), w.tobytes()) for k, (x, y, w) in enumerate(zip(pieces(own_model, own_seen), before, weights, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["piece", "part", "moved", "weight"])

    def added(whole: pa.Table) -> pa.Table:
        whole = whole.sort_by("part")  # sums of floats in one order
        moved, weight = (sum(np.frombuffer(x.as_buffer(), np.float64) for x in whole.column(c)) for c in ("moved", "weight"))
        mean = moved.reshape(len(weight), -1) / np.maximum(weight, 1.0)[:, None]
        return pa.table([whole.column("piece")[:1], pa.array([mean.tobytes()], pa.binary())], names=["piece", "mean"])

    learned = parts.mapInArrow(trimmed(run), "piece int, part int, moved binary, weight binary")
    means = {x["piece"]: np.frombuffer(bytes(x["mean"])) for x in learned.groupBy("piece").applyInArrow(added, "piece int, mean binary").collect()}
    joined([x + means[k].reshape(x.shape) for k, x in enumerate(pieces(model, seen))], model, seen)
    shared.destroy()


def thresholds(scored: DataFrame) -> dict:
    """Each language's threshold by all rows (lang, score, toxic): at most 10^PLACES counts a language."""
    counts = scored.groupBy("lang", F.round("score", PLACES).alias("score")).agg(F.sum("toxic").alias("hits"), F.count("*").alias("rows"))

    def run(whole: pa.Table) -> pa.Table:
        found = threshold_of(*(whole.column(c).to_numpy() for c in ("score", "hits", "rows")))
        return pa.table([whole.column("lang")[:1], pa.array([found])], names=["lang", "threshold"])

    return {x["lang"]: x["threshold"] for x in counts.groupBy("lang").applyInArrow(run, "lang string, threshold double").collect()}


def train(labelled: DataFrame) -> bytes:
    """Fit on all rows (doc_id, text, lang, toxic); the model and the thresholds, pickled."""
    rows = stash(labelled.select("doc_id", "text", "lang", F.col("toxic").cast("int").alias("toxic")), "labelled")
    apart = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("threshold")), F.lit(5)) == 0, F.lit(False))
    n, kept = rows.agg(F.count("*"), F.count_if(apart)).first()
    fit = rows.where(~apart) if n >= ENOUGH else rows
    n, hits, size = fit.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    model, by_lang = Model(), {}
    if hits in (0, n):
        model.constant = hits / n if n else 0.0
    else:
        parts = stash(dealt(fit, max(1, -(-n // PART_ROWS), -(-size // PART_BYTES))), "parts")
        seen = model.fresh_sums()
        for epoch in range(EPOCHS):
            epoch_over(parts, model, seen, epoch)
        unstash(parts)
    if fit is not rows and kept:
        by_lang = thresholds(score(rows.where(apart).select("text", "lang", "toxic"), pickle.dumps((model, {}))))
    unstash(rows)
    return pickle.dumps((model, by_lang))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang").join(known.hint("merge"), "doc_id")


def score(docs: DataFrame, model: bytes, added: tuple[str, str, str] = ("score", "threshold", "rejected")) -> DataFrame:
    """docs with score, threshold (its language's) and rejected, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the input
    base = docs.select(*own(docs, *added))
    schema = StructType([*base.schema.fields, *(StructField(n, t) for n, t in zip(added, (DoubleType(), DoubleType(), BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, by_lang = pickle.loads(shared.value)
        tables = net.tables()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for i, j in slices(offsets, RUN_BYTES):
                ids = [word_ids(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, j)]
                out.append(net.score(np.concatenate(ids), np.array([len(x) for x in ids]), tables))
            s = np.concatenate(out) if out else np.zeros(0)
            t = np.array([by_lang.get(x, DEFAULT_THRESHOLD) for x in batch.column("lang").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(t), pa.array(s >= t)], names=[*batch.schema.names, *added])

    return map_rows(base, run, schema)


def keep_clean(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows below their language's threshold, all columns as they are."""
    added = fresh(docs.columns, "score", "threshold", "rejected")
    return score(docs, model, tuple(added)).where(~F.col(added[2])).select(*own(docs))
