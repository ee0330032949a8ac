"""Archives: what is written is read back, in segments, with revisits."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridwise.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"


def test_chunks_hide_boundaries():
    for size in (4, 7, 64, 1000):
        data = (TRAP * 3 + "\r\n\r\n").encode()
        parts = [bytes(p) for p in warc.chunks(data, size)]
        assert b"".join(parts) == data and not any(warc.BOUNDARY in p for p in parts)
    assert [bytes(p) for p in warc.chunks(b"")] == [b""]


def test_archives(spark, tmp_path):
    rows = [(1, "http://a", "x" * 50), (2, "http://b\r\nX: y z", "x" * 50), (3, None, None), (4, "u", ""), (5, "u", TRAP), (6, "u", "é" * 333), (7, "u", "x" * 50), (7, "u", "x" * 50), (8, "u", "\r\n\r\n"), (None, "u", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    got = warc.archive(df, path, chunk=64, compression="gzip").collect()
    want = []
    for k, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        want.append((k, len(data), digest(data), top if k is not None and k < top else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("*.gz"))
    assert text.count(b"WARC-Type: continuation") >= 10 and b"X: y z" not in text.replace(b"X:%20y%20z", b"")
    assert text.count(b"Content-Type: text/html") == text.count(b"WARC-Type: response\r\nWARC-Record-ID")
    assert warc.archive(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_many_copies_go_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i % 7}") for i in range(60)], "page_id long, url string, html string")
    few = sorted(map(str, warc.typed(df).collect()))
    monkeypatch.setattr(warc, "FEW", 3)
    assert sorted(map(str, warc.typed(df).collect())) == few


def test_lengths_are_needed():
    for bad in (b"WARC-Type: response\r\n\r\nabc", b"Content-Length: x\r\n\r\nabc", b"Content-Length: 4\r\n\r\nabc", b"Content-Length: 3"):
        with pytest.raises(warc.Damaged):
            warc.parse(b"WARC/1.1\r\n" + bad)


def test_incremental_digests(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij" * 20)], "page_id long, url string, html string")
    rows = warc.chunk_table(df, chunk=64).orderBy("chunk_no").collect()
    data = ("abcdefghij" * 20).encode()
    assert [(r.chunk_no, r.last, r.n_bytes, r.digest) for r in rows] == [(i + 1, i == 3, min(64 * (i + 1), 200), digest(data[: 64 * (i + 1)])) for i in range(4)]


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "z" * 100)], "page_id long, url string, html string")
    warc.write_archives(warc.chunk_table(df, chunk=40), f"file://{tmp_path}/w", "none")
    for p in Path(tmp_path, "w").glob("part*"):
        p.write_bytes(p.read_bytes().replace(b"zzz", b"zzy", 1).replace(b"abc", b"abd"))
    for p in Path(tmp_path, "w").glob(".*crc"):
        p.unlink()
    with pytest.raises(Exception, match="damaged|digest"):
        warc.verify(warc.read_archives(spark, f"file://{tmp_path}/w")).collect()
