"""Sharding by histogram sort, with DataFrame functions only.

Every row gets a 64-bit key, the hash of its text, so that equal texts have equal keys. Splitters between the shards are
found by counting the exact bytes in 4,096 cells of the key space, then in 4,096 cells of each cell that holds a
splitter, until the cell's bytes are within the tolerance; each round is one aggregation whose result is bounded by
4,096 cells a splitter. Then the rows are exchanged once.

A group of equal texts that outweighs the tolerance can't be cut by its key. There are at most n_shards / tolerance such
groups. They are placed first, whole, largest first, wherever they fit; one that fits nowhere is salted by doc_id.

Defined results: null text counts as empty; repeated rows are kept; an empty table gives no rows; other columns of the
input are kept (size, text_crc32, shard and slot replace columns of their name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, own, shuffle_partitions, stash

BITS = 12


def _cell(level: int):
    return F.shiftright("_key", 64 - BITS * level)


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[int]:
    """For each target the key below which about that many bytes lie; rows: _key, size."""
    found: dict[int, int] = {}
    # target -> (cell that holds it, bytes below the cell)
    inside: dict[int, tuple[int | None, int]] = {k: (None, 0) for k in range(len(targets))}
    for level in range(1, 64 // BITS + 1):
        open_cells = {c for c, _ in inside.values()}
        part = rows if level == 1 else rows.where(_cell(level - 1).isin(sorted(open_cells)))
        counted = part.groupBy(_cell(level).alias("cell")).agg(F.sum("size").alias("bytes")).collect()  # bounded: 4,096 a target
        held = sorted((r["cell"], r["bytes"]) for r in counted)
        after: dict[int, tuple[int | None, int]] = {}
        for k, (parent, below) in inside.items():
            cells = held if parent is None else [x for x in held if x[0] >> BITS == parent]
            shift = 64 - BITS * level
            for cell, size in cells:
                if below + size >= targets[k]:
                    break
                below += size
            else:  # the target lies at the end of the last cell
                found[k] = ((cells[-1][0] + 1) << shift) if cells else -(1 << 63)
                continue
            if size <= tolerance or level == 64 // BITS:
                near_start = targets[k] - below <= below + size - targets[k]
                found[k] = (cell if near_start else cell + 1) << shift
            else:
                after[k] = (cell, below)
        inside = after
        if not inside:
            break
    return [found[k] for k in range(len(targets))]


def place_hot(groups: list[tuple[int, int]], n_shards: int, total: int) -> tuple[dict[int, int], list[int], list[int]]:
    """(key -> shard, keys to be salted, bytes reserved by shard) for groups (key, bytes) that outweigh the tolerance."""
    reserved, shard_of, salted = [0] * n_shards, {}, []
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        k = min(range(n_shards), key=lambda s: (reserved[s], s))
        if (reserved[k] + size) * n_shards <= total:
            reserved[k] += size
            shard_of[key] = k
        else:
            salted.append(key)
    return shard_of, salted, reserved


def histogram_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.005, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in {"size", "text_crc32", "shard", "slot"}]
    key_, sub_, base_ = fresh(kept, "_key", "_sub", "_base")
    added = {"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(F.encode(body, "UTF-8")), key_: F.xxhash64(body)}
    sized = docs.select(*own(docs, *(c for c in docs.columns if c not in kept)), *(v.alias(k) for k, v in added.items()))
    keys = stash(sized.select(F.col(key_).alias("_key"), "size", F.col(f"`{id_col}`").alias("_id")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    bound = max(1, int(total * tolerance / n_shards))
    hot = keys.groupBy("_key").agg(F.sum("size").alias("n")).where(F.col("n") > bound).collect()  # at most n_shards / tolerance
    shard_of, salted, reserved = place_hot([(r["_key"], r["n"]) for r in hot], n_shards, total)

    def keyed(df: DataFrame, key: str, doc) -> DataFrame:
        salt = F.xxhash64(key, doc)
        return df.withColumn(key, F.when(F.col(key).isin(salted), salt).otherwise(F.col(key))) if salted else df

    rest = keyed(keys, "_key", F.col("_id"))
    rest = rest.where(~F.col("_key").isin(list(shard_of))) if shard_of else rest
    share, below, targets = total / n_shards, 0.0, []
    for s in range(n_shards - 1):
        below += share - reserved[s]
        targets.append(round(below))
    cuts = splitters(rest, targets, bound) if total else []
    # the one exchange: each shard in many sub-shards, so that no task holds a whole shard
    n_sub = max(1, 16 * shuffle_partitions(spark) // n_shards)
    ident = F.col(f"`{id_col}`")

    def dealt(df: DataFrame, key: str, doc) -> DataFrame:
        # what decides the sub-shard must be the same on either side
        shard = sum(((F.col(key) >= F.lit(c)).cast("int") for c in cuts if c < 1 << 63), F.lit(0))
        for at in sorted(set(shard_of.values())):
            shard = F.when(F.col(key).isin([k for k, s in shard_of.items() if s == at]), at).otherwise(shard)
        return keyed(df, key, doc).withColumn("shard", shard.cast("int")).withColumn(sub_, F.pmod(F.xxhash64(doc, F.col("size")), F.lit(n_sub)).cast("int"))

    counts = dealt(keys, "_key", F.col("_id")).groupBy("shard", sub_).agg(F.count("*").alias("n"))  # n_shards * n_sub rows at most
    offsets = counts.select("shard", sub_, (F.expr(f"sum(n) OVER (PARTITION BY shard ORDER BY {sub_})") - F.col("n")).alias(base_))
    placed = dealt(sized, key_, ident).join(F.broadcast(offsets), ["shard", sub_])
    rank = F.expr(f"row_number() OVER (PARTITION BY shard, {sub_} ORDER BY {key_}, `{id_col}`)")
    return placed.withColumn("slot", F.col(base_) + rank - 1).drop(sub_, base_, key_)
