"""Cuts against a plain regular expression, and texts put together again."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwise.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    text = text or ""
    units = TOKEN.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text(alphabet="aé漢😀 \t\n\x0b\x1c\xa0<PS>"), st.integers(0, 40), st.integers(1, 5), st.integers(1, 7))
def test_checkpoints(text, key, every, block):
    n, form, prefix, middle, out = fim.transformed(str(key), memoryview(text.encode()), 50, 80, 42, every, block)
    assert (n, form, prefix, middle, out.decode()) == brute(key, text)


def test_documents(spark):
    texts = [None, "", " ", "a", " a  b ", "x<P>y", "<S", "a <S b <", "é 漢\xa0字 😀\n\n", "word " * 3000, "w" * 300_000, " " * 5000, "\x1c a \x85 b"]
    rows = [(i * 100 + k, t, "n") for i, t in enumerate(texts) for k in range(12)] + [(7, "same text here", "n")] * 3 + [(None, "no id at all", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    made = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=str)
    want = sorted(((i, *brute("" if i is None else i, t), t or "") for i, t, _ in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    named = fim.fill_in_middle(df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert {(r.doc_id, r.n) for r in named.collect()} == {(None if i is None else f"d{i}", brute("", t)[0]) for i, t, _ in rows}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
