"""Token ids against the tokenizers library, and round trips."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridwise.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Merges(PATH), Tokenizer.from_file(PATH)


def encode(m, parts):
    e = bpe.Encoder(m)
    return list(memoryview(b"".join([*(b for p in parts for b in e.feed(p)), e.finish()])).cast("I"))


def test_any_text_in_any_parts(both):
    m, t = both
    rnd = random.Random(3)
    alphabet = [*"aabbtheing 's'llre  \n\t.!éñ漢😀0123", " ", "\x1c", "\xa0", "²", "<|endoftext|>", "<|endof", "  "]
    for i in range(1500):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50)))
        want = t.encode(s, add_special_tokens=False).ids
        cuts = sorted(rnd.randrange(len(s) + 1) for _ in range(i % 6))
        parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]
        assert encode(m, parts) == want, (s, parts)
        d = bpe.Decoder(m)
        ids = struct.pack(f"<{len(want)}I", *want)
        assert "".join([*(d.feed(ids[k : k + 4]) for k in range(0, len(ids), 4)), d.finish()]) == s == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("s", ["a" * 150_000, " " * 140_000 + "x", "th" * 80_000, "!" * 100_000 + "'s", "\n" * 70_000, "1" * 90_000 + " 2", "é漢" * 40_000, "ab " * 50_000 + "'l" + "l"])
def test_long_runs_in_constant_memory(both, s):
    m, t = both
    e, out, held = bpe.Encoder(m), [], 0
    for at in range(0, len(s), 5000):
        out += e.feed(s[at : at + 5000])
        held = max(held, len(e.held) + len(e.transducer.tail))
    out.append(e.finish())
    assert list(memoryview(b"".join(out)).cast("I")) == t.encode(s, add_special_tokens=False).ids
    assert held < bpe.WINDOW + 5000 + 2 * (m.lookahead + m.longest + 1024)


def test_lookahead_is_enough(both):
    m, _ = both
    rnd = random.Random(5)
    tr = m.transducer()
    for source in ("abetnorsing", "aab", "thequick ", "0123456789", "é"):
        tr.push("".join(rnd.choice(source) for _ in range(20_000)).encode())
        assert tr.lag <= m.lookahead
        tr.finish()


def test_frames(spark, both):
    _, t = both
    texts = [(1, "Hello wörld"), (2, None), (3, ""), (4, "Hello wörld"), (5, "<|endoftext|>x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    for r in bpe.digests(df).collect():
        ids = t.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids
        text = (dict(texts)[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text).hexdigest())
    back = bpe.decode(bpe.encode(df)).collect()
    assert {(r.doc_id, r.decoded) for r in back} == set(texts)
    assert bpe.digests(df.limit(0)).count() == 0
