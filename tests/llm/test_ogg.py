"""Containers: round trips, damage and the frames."""

from __future__ import annotations

import random

import pytest

from gridwise.llm import ogg


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum():
    rnd = random.Random(1)
    for n in (0, 1, 7, 300):
        d = rnd.randbytes(n)
        assert ogg.crc(d) == slow_crc(d)


@pytest.mark.parametrize(("n", "packet", "streams"), [(576, 576, 2), (576 * 300, 576, 2), (200_000, 70_000, 3), (1020, 255, 1), (130_050, 65_025, 2), (5, 1, 4)])
def test_round_trip(n, packet, streams):
    d = random.Random(n).randbytes(n)
    media = ogg.write(d, packet, streams)
    got, facts = ogg.read(media)
    assert got == d and facts["streams"] == streams and facts["packets"] == -(-n // packet)
    assert facts["seconds"] == round(n / ogg.RATE, 6)
    packets = [p for s in ogg.demultiplex(media).values() for p in s.packets[1:]]
    assert sorted(packets) == sorted(d[i : i + packet] for i in range(0, n, packet))


def test_damage_is_seen():
    media = ogg.write(b"x" * 1152)
    for at in (0, 5, 30, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.Damaged):
            ogg.read(bytes(bad))
    for cut in (media[:-1], media[:40], media[58:]):
        with pytest.raises(ogg.Damaged):
            ogg.read(cut)


def test_frames(spark):
    long = "añ" * 50_000
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, long), (5, "ab")], "doc_id long, text string").selectExpr("*", "'x' AS payload")
    got = {r.doc_id: r for r in ogg.decode_media(ogg.encode_texts(df)).collect()}
    for k, t in ((1, "ab"), (2, ""), (3, ""), (4, long)):
        data = t.encode()
        assert got[k].n_bytes == len(data) and bytes(got[k].payload) == ogg.padded(data) and len(got[k].payload) % 576 == 0 and len(got[k].payload) > 0
    assert got[1].media == got[5].media and got[1].facts == got[5].facts
    both = ogg.encode_texts(df).selectExpr("*", "'old' AS payload", "1 AS facts", "2 AS k")
    again = ogg.decode_media(both)
    assert again.columns == ["doc_id", "n_bytes", "media", "k", "payload", "facts"] and {bytes(r.payload) for r in again.select("payload").collect()} == {bytes(r.payload) for r in got.values()}
    assert ogg.decode_media(ogg.encode_texts(df.limit(0))).count() == 0


def test_query_against_plain_digests(spark):
    import hashlib
    import zlib

    from gridwise.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2_ogg_media(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        media = ogg.write(payload)
        back, facts = ogg.read(media)
        assert back == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};")
