"""Likelihoods against all segmentations listed one by one, and accuracy on held-out texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.llm import langid, queries

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c"]


def listed(lattice, word, theta):
    text = langid.WORD_START + word
    total = np.zeros(theta.shape[1])
    uses = np.zeros_like(theta)

    def walk(at, p, used):
        nonlocal total
        if at == len(text):
            total = total + p
            for u in used:
                uses[u] += p
            return
        for n in range(1, len(text) - at + 1):
            piece = lattice.ids.get(text[at : at + n])
            if piece is None and n == 1:
                piece = lattice.unknown
            if piece is not None:
                walk(at + n, p * theta[piece], [*used, piece])

    walk(0, np.ones(theta.shape[1]), [])
    return total, uses


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    lattice, theta = langid.Lattice(PIECES), rng.random((len(PIECES) + 1, 3)) + 0.01
    words = ["", "a", "abab", "zab", "bbaabz", "c", "ababababab", "é漢a"]
    got = lattice.likelihood(words, theta)
    expected = np.zeros_like(theta)
    counts = rng.integers(1, 5, (len(words), 3)).astype(float)
    for i, w in enumerate(words):
        total, uses = listed(lattice, w, theta)
        assert np.allclose(got[i], np.log(total))
        assert np.allclose(lattice.long(w, theta), np.log(total))
        expected += uses / total * counts[i]
    assert np.allclose(lattice.expected(words, counts, theta), expected)


def test_long_words_do_not_vanish():
    lattice, theta = langid.Lattice(PIECES), np.full((len(PIECES) + 1, 2), 1e-8)
    assert np.isfinite(lattice.likelihood(["z" * 5000, "ab" * 3000], theta)).all()


@pytest.fixture(scope="module")
def predicted(spark):
    return queries.op8_langid_pieces(spark, "/root/testdata/sf0.001").toPandas()


def test_held_out_accuracy(spark, predicted):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas()
    m = predicted.merge(docs, on="doc_id")
    held = m[m.held_out]
    assert len(m) == len(docs) and len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.95
    assert m.score.between(0, 1).all()


def test_corners(spark):
    df = spark.createDataFrame([(1, "the of and", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "", None), (5, "12 !?", "en"), (6, "the the", None), (6, "the the", None)], "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred")
    model = langid.fit(df, rounds=2)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect())
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert langid.fit(df.where(F.lit(False))) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_long_words_are_learned_from(spark, monkeypatch):
    import random

    import numpy as np

    from gridwise.llm import langid

    rnd = random.Random(5)
    lattice = langid.Lattice(["a", "b", "ab", "ba", "aab", "▁", "▁a"])
    theta = np.random.default_rng(5).uniform(0.01, 0.3, (8, 2))
    words = ["".join(rnd.choice("abx") for _ in range(rnd.randint(1, 28))) for _ in range(20)]
    counts = np.random.default_rng(6).uniform(0, 3, (20, 2))
    want = lattice.expected(words, counts, theta)
    for window in (3, 4, 4096):
        monkeypatch.setattr(langid, "WINDOW", window)
        got = np.zeros_like(theta)
        for w, c in zip(words, counts, strict=True):
            lattice.expected_long(w, c, theta, got)
        assert np.allclose(got, want)
    # Two languages without blanks.
    syllables = {"p": ["ko", "ta", "mi"], "q": ["str", "ung", "elz"]}
    text = lambda x: "".join(rnd.choice(syllables[x]) for _ in range(40))
    rows = [(i, text(x), x) for i, x in enumerate("pq" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 30"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert got == {i: x for i, _, x in rows}


def test_many_languages_and_repeated_ids(spark):
    two = lambda i: chr(97 + i // 20) + chr(97 + i % 20)
    rows = [(10 * i + k, f"{two(i)}x{two(i)}y{two(i)} {two(i) * 3}", f"l{i:03}") for i in range(300) for k in range(2)] + [(5, "other words", "l000")] * 50 + [(None, "w1a", "l001")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS row", "3 AS h")
    model = langid.fit(df, rounds=2)
    assert len(model.langs) == 300
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect() if r.doc_id is not None and r.doc_id != 5}
    assert sum(got[d] == x for d, _, x in rows if d in got) >= 0.8 * len(got)
    # At most so many rows are learned from, also where ids are repeated.
    assert langid.fit(df.where("doc_id <= 5"), train_docs=1).langs in (["l000"], ["l001"])
