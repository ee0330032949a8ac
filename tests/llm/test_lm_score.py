"""Scores against SQL and by hand, in one block and in many."""

from __future__ import annotations

import math

import duckdb
import pytest

from gridwise.llm import lm_score


def frames(spark, docs, good):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word")
    return d, spark.createDataFrame([(k, 1) for k in good], "doc_id long, quality int")


DOCS = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 40))) for i in range(150)] + [(200, None), (201, " \t "), (202, "A a\x0bB\nb"), (203, "a\xa0b a")]


@pytest.mark.parametrize(("chars", "fanout"), [(10**9, 1024), (300, 1024), (300, 5)])
def test_against_sql(spark, chars, fanout):
    """In one block, in many, and in many with a step between the blocks and the ranges."""
    d, l = frames(spark, DOCS, [*range(0, 150, 3), 202, 202])
    got = lm_score.score(d, lm_score.target_ids(l), block_chars=chars, fanout=fanout).toPandas()
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    c.register("labels", l.toPandas())
    want = c.sql(lm_score.SQL).df()
    key = lambda df: sorted((int(r.doc_id), int(r.n_tokens), *(None if v != v else round(float(v), 6) for v in (r.ce_target, r.ce_background, r.score))) for r in df.itertuples())
    assert key(got) == key(want)


def test_by_hand(spark):
    d, l = frames(spark, [(1, "a b"), (2, "a a")], [1])
    r = {x.doc_id: x for x in lm_score.score(d, lm_score.target_ids(l)).collect()}
    n_b, n_t, mu, beta = 6, 3, lm_score.MU, lm_score.BETA
    p_b = {"a": 3 / n_b, "b": 1 / n_b, "end": 2 / n_b}
    p_t = {"a": (1 + mu * p_b["a"]) / (n_t + mu), "b": (1 + mu * p_b["b"]) / (n_t + mu), "end": (1 + mu * p_b["end"]) / (n_t + mu)}
    loss = lambda p, steps: sum(-math.log((n + beta * p[w]) / (c + beta)) for w, n, c in steps) / 3
    t, b = loss(p_t, [("a", 1, 1), ("b", 1, 1), ("end", 1, 1)]), loss(p_b, [("a", 2, 2), ("b", 1, 3), ("end", 1, 1)])
    assert (r[1].n_tokens, r[1].ce_target, r[1].ce_background, r[1].score) == (3, round(t, 6), round(b, 6), round(t - b, 6))


def test_corners(spark):
    d, l = frames(spark, [(1, "a b"), (1, "a b"), (None, "a"), (2, None)], [])
    got = lm_score.score(d, lm_score.target_ids(l)).collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.score is None)) for r in got) == ["(1, 3, False)", "(1, 3, False)", "(2, 0, True)", "(None, 2, False)"]
    # A null id with much text is dealt over several blocks; an id with much text keeps its mark.
    d, l = frames(spark, [(None, f"a b{i}") for i in range(40)] + [(5, f"a c{i}") for i in range(40)], [5])
    few, many = (sorted(map(str, lm_score.score(d, lm_score.target_ids(l), block_chars=n).collect())) for n in (10**9, 30))
    assert few == many and len(few) == 80
    assert lm_score.score(d.limit(0), lm_score.target_ids(l)).count() == 0
