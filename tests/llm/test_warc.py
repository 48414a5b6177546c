"""Archives that read back: types, digests, payloads, segments."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.llm import warc
from matchloom.llm.queries import ORACLE_SQL, QUERIES
from matchloom.sources.store import new_path

PAGE = "page_id long, url string, html string"


def plain(pages, min_bytes=0):
    top = {}
    for page, _, html in pages:
        key = (html or "").encode()
        top.setdefault(key, []).append(page)
    out = []
    for key, ids in top.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(key).digest()).decode()
        out += [(i, len(key), digest, "revisit" if k and len(key) >= min_bytes else "response", ids[0] if k and len(key) >= min_bytes else None) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def written(spark, pages, min_bytes=0):
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages, PAGE).repartition(3), path, min_bytes)
    return path


ENDS = ["\r\n", "\r", "\n", "\r\n\r\n", "\r\n\r", "\n\r\n", "WARC/1.1\r\n", "Content-Length: 3\r\n\r\n", "x", "é", "🙂", "\0", "﻿"]


def made(seed):
    r = random.Random(seed)
    odd = ["".join(r.choice(ENDS) for _ in range(r.randint(1, 12))) for _ in range(80)]
    bodies = ["", None, "a", *odd, *odd[:20], "﻿bom", "same " * 40, *["same " * 40] * 6, "\r\n" * 700, "é🙂" * 500]
    pages = [(k, r.choice(["http://a.b/c d", "http://x.y/\r\nX-Page-ID: 99", "", None, "http://é/🙂?q=%20"]), b) for k, b in enumerate(bodies)]
    return pages + [(None, None, "null id"), (None, "u", "null id"), (5, "u", "tie"), (5, "u", "tie"), (5, None, "tie"), (-3, "u", "null id")]


@pytest.mark.parametrize(("chunk", "batch", "least"), [(1 << 20, 4 << 20, 0), (7, 300, 0), (4, 1, 10), (64, 1000, 1 << 30)])
def test_archives(spark, monkeypatch, chunk, batch, least):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    monkeypatch.setattr(warc, "BATCH", batch)
    pages = made(chunk)
    chunks = warc.read_chunks(spark, written(spark, pages, least))
    assert sorted((tuple(x) for x in warc.digests(chunks).collect()), key=str) == plain(pages, least)
    back = {}
    rows = chunks.where("record_type = 'response'").orderBy("record_id", "chunk").collect()
    for x in rows:
        own = back.setdefault(x["record_id"], [])
        assert x["chunk"] == len(own) and len(x["payload"].encode()) <= max(chunk, 4)
        own.append(x["payload"])
        whole = "".join(own).encode()
        assert x["payload_bytes"] == len(whole) and x["payload_digest"] == base64.b32encode(hashlib.sha1(whole).digest()).decode()
    wanted = [p[2] or "" for p in pages]
    assert sorted("".join(p) for p in back.values()) == sorted(wanted if least == 1 << 30 else [w for k, w in enumerate(wanted) if len(w.encode()) < least or w not in wanted[:k]])


def test_shared_by_many(spark, monkeypatch):
    """Revisits of a payload that many pages share are written where they are."""
    monkeypatch.setattr(warc, "HOT_KEYS", 2)
    pages = [(k, "u", "shared") for k in range(1500)] + [(9000, "v", "shared")] * 2 + [(k, "u", f"own {k}") for k in range(2000, 2050)]
    found = warc.digests(warc.read_chunks(spark, written(spark, pages)))
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain(pages)


def test_long_payload_and_line_ends_at_any_place(spark, monkeypatch):
    """Two line ends fall on every place of a reader's buffer."""
    monkeypatch.setattr(warc, "CHUNK", 100_000)
    pages = [(k, None, "y" * (65_536 - 900 + k) + "\r\n\r\n\r\n" * 50 + "\r") for k in range(0, 900, 7)] + [(10_000, None, "z" * 1_000_000)]
    found = warc.digests(warc.read_chunks(spark, written(spark, pages), payload=False))
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain(pages)


def test_files_are_warc(spark):
    path = written(spark, [(1, "http://a/", "hello"), (2, "http://b/", "hello")])
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(Path(path.removeprefix("file:")).glob("*.gz")))
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole.endswith(b"\r\n\r\n")
    assert whole.count(b"WARC/1.1\r\n") == 2 and b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" in whole
    assert b"\r\nX-Page-ID: 1\r\nX-Refers-To-Page-ID: 2\r\n" in whole


def test_damage_is_seen(spark):
    path = written(spark, [(1, "http://a/", "hello there")])
    file = next(f for f in Path(path.removeprefix("file:")).glob("*.gz") if gzip.decompress(f.read_bytes()))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"hello there", b"hellO there")))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="digest"):
        warc.read_chunks(spark, path).collect()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], PAGE)
    path = new_path(spark, "warc")
    warc.write_archives(empty, path)
    assert warc.read_chunks(spark, path).collect() == []
    more = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], PAGE).withColumns({"key": F.lit(1), "row": F.lit(2), "value": F.lit("x"), "top": F.lit(3)})
    path = new_path(spark, "warc")
    warc.write_archives(more, path)
    assert sorted((tuple(x) for x in warc.digests(warc.read_chunks(spark, path)).collect()), key=str) == plain([(1, "u", "a"), (2, "u", "a")])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(x) for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    found = QUERIES["op13_warc_archives"](spark, sf)
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain(pages)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(db.execute(ORACLE_SQL["op13_warc_archives"]).fetchall(), key=str) == plain(pages)
