"""Whitening against numpy over the same integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridwise.llm import whiten

KIND = "vec_id long, embedding array<float>, component string"


def brute(vectors, k):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - t for c, t in zip(r, s, strict=True)] for r in x]
    y = np.array(off, float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return n, [sum(c * c for c in r) for r in off], y @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10))).astype(np.float32)
    good = np.concatenate([good, good[:7]])  # repeated rows
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(good)]
    bad = [(900, None, "x"), (901, [], "x"), (902, [float("nan")] * 10, "x"), (903, [None] * 10, "x"), (904, [float("-inf")] * 10, "x"), (905, [1.0] * 9, "x")]
    got = whiten.report(spark.createDataFrame(rows + bad, KIND)).collect()
    n, deviation, w, explained = brute(good, 8)
    assert len(got) == n * 8 and {r.n for r in got} == {n}
    sign = np.sign(w[0])
    for r in got:
        k = r.component - 1
        if r.vec_id == 0:
            sign[k] = np.sign(w[0, k]) * np.sign(r.whitened)
        assert int(r.deviation) == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
    for r in got:
        assert r.whitened == pytest.approx(sign[r.component - 1] * w[r.vec_id, r.component - 1], abs=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_flat_dimensions_large_sums_and_nothing(spark):
    flat = spark.createDataFrame([(1, [0.5, 2.0, 1.0], ""), (None, [0.5, 4.0, 1.0], ""), (3, [0.5, 6.0, 1.0], "")], KIND)
    got = whiten.report(flat).collect()
    assert len(got) == 9 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert sum(r.explained for r in got if r.vec_id == 1) == pytest.approx(1) and got[0].identity_error < 1e-12
    one = whiten.report(spark.createDataFrame([(1, [0.5, 2.0], "")], KIND)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 2
    far = whiten.report(spark.createDataFrame([(1, [0.0, 1e6], ""), (2, [0.0, -1e6], "")], KIND)).collect()
    assert {int(r.deviation) for r in far} == {(2 * 1024 * 10**6) ** 2}
    huge = whiten.report(spark.createDataFrame([(1, [0.0, 4e6], ""), (2, [0.0, -4e6], "")], KIND)).collect()
    assert {int(r.deviation) for r in huge} == {(2 * 1024 * 4 * 10**6) ** 2}  # beyond 64 bits
    assert whiten.report(flat.limit(0)).count() == 0 and whiten.report(flat.limit(0)).columns == whiten.report(flat).columns
