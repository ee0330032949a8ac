"""Operators against brute force and in corner cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import chains, dataset, graph, ranking, raster, spatial


@pytest.mark.parametrize("n", [0, 1, 150])
def test_nearest_and_within(spark, n):
    rnd = random.Random(n)
    a = [(i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(80)]
    b = [(i, rnd.uniform(0, 3000), rnd.uniform(-500, 1000)) for i in range(n)]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, x double, y double")
    d = {(i, j): ((x - u) ** 2 + (y - v) ** 2) ** 0.5 for i, x, y in a for j, u, v in b}
    got = {(r.left_id, r.right_id) for r in spatial.within(left, right, 200.0).collect()}
    assert got == {k for k, v in d.items() if v <= 200}
    near = {r.id: (r.near_dist, r.near_id) for r in spatial.nearest(left, right).collect()}
    assert near == {i: min(((round(d[i, j] + 1e-12, 1), j) for j, _, _ in b), default=(None, None)) for i, _, _ in a}


def test_null_places_pair_with_nothing(spark):
    left = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 0.0)], "id long, x double, y double")
    assert [r.left_id for r in spatial.within(left, left, 5.0).collect()] == [2]
    assert {r.id: r.near_id for r in spatial.nearest(left, left).collect()} == {1: None, 2: 2}
    assert [r.id for r in spatial.clear_of(left, left, 5.0).collect()] == [1]


def flood(grow, diagonal):
    seen, out = set(), []
    for s in zip(*np.nonzero(grow), strict=True):
        if s in seen:
            continue
        part, todo = [], [s]
        seen.add(s)
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if (dy or dx) and (diagonal or not (dy and dx)) and 0 <= q[0] < grow.shape[0] and 0 <= q[1] < grow.shape[1] and grow[q] and q not in seen:
                        seen.add(q)
                        todo.append(q)
        out.append(frozenset((int(y), int(x)) for y, x in part))
    return set(out)


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels(diagonal):
    rng = np.random.default_rng(3)
    for share in (0.3, 0.5, 0.65):
        for _ in range(20):
            g = rng.random((9, 13)) < share
            lab = raster.label(g, diagonal)
            got = {frozenset((int(y), int(x)) for y, x in zip(*np.nonzero(lab == k), strict=True)) for k in set(lab[g].tolist())}
            assert got == flood(g, diagonal)


def test_hysteresis_by_hand(spark):
    grid = [[0.1, 0.25, 0.45, 0.1, 0.3], [0.1, 0.1, 0.3, 0.1, 0.1], [0.1, 0.1, 0.1, 0.2, 0.1], [0.5, 0.1, 0.1, 0.1, 0.39]]
    t = spark.createDataFrame([(1, 4, 5, [v for r in grid for v in r])], "id long, h int, w int, px array<double>")
    four = sorted((r.n_pixels, round(r.conf_mean, 4), r.conf_p90) for r in raster.hysteresis(t).collect())
    assert four == [(1, 0.5, 0.5), (3, 0.3333, 0.45)]
    eight = sorted((r.n_pixels, round(r.conf_mean, 3)) for r in raster.hysteresis(t, diagonal=True).collect())
    assert eight == [(1, 0.5), (5, 0.318)]


def test_mosaic_is_one_flood_fill(spark):
    rng = np.random.default_rng(5)
    whole = np.round(rng.random((12, 16)), 3)
    rows = [(ty * 4 + tx, tx, ty, 4, 4, whole[4 * ty : 4 * ty + 4, 4 * tx : 4 * tx + 4].ravel().tolist()) for ty in range(3) for tx in range(4)]
    t = spark.createDataFrame(rows, "id long, tx int, ty int, h int, w int, px array<double>")
    got = sorted((r.n_pixels, r.conf_max, round(r.conf_mean, 9)) for r in raster.mosaic_components(t, 0.5, 0.9).collect())
    parts = [np.array([whole[p] for p in c]) for c in flood(whole >= 0.5, False)]
    assert got == sorted((len(p), p.max(), round(p.mean(), 9)) for p in parts if p.max() >= 0.9)


def test_window_starts(spark):
    got = spark.range(1).select(raster.window_starts(F.lit(500), 224, 104).alias("a"), raster.window_starts(F.lit(200), 224, 104).alias("b")).first()
    assert (got.a, got.b) == ([0, 104, 208, 276], [0])


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    links = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {x: root(x) for x in up}
    assert graph.components(links.limit(0)).count() == 0


def test_measures(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.8, 0), (4, 0.1, 0), (5, None, 1)], "id long, s double, y int")
    assert ranking.auc(df, "s", "y").first().auc == 0.875
    assert ranking.auc(df.where("y = 1"), "s", "y").first().auc is None
    assert ranking.precision_at(df, 2, [F.desc("s"), F.col("id")], "y").first().precision == 1.0
    r = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0)], "id long, v double")
    assert {x.id: x.r_pct for x in ranking.average_ranks(r, "v", "r").collect()} == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}
    assert [x.n for x in ranking.numbered(df, "s", [F.col("id")]).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    c = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (-1, 1)], "t int, p int")
    assert tuple(ranking.confusion(c, "t", "p").first())[:3] == (1, 1, 1)


def test_datasets(spark):
    df = spark.createDataFrame([(i, "a" if i < 600 else "b" if i < 900 else "c" if i < 1000 else None, i * 7919 % 1000) for i in range(1010)], "id long, g string, key long")
    cap = dataset.proportional_cap(df, "g", 500, "key", ["id"], 1000)
    assert {r.g: r["count"] for r in cap.groupBy("g").count().collect()} == {"a": 300, "b": 150, "c": 50}
    n = sorted(r.n for r in dataset.number_in_group(df.where("g = 'a'"), "g", "key", ["id"], 1000).collect())
    assert n == list(range(1, 601))
    a, b = dataset.sample(df, F.col("key"), 20)
    assert a.count() + b.count() == 1010
    s = spark.createDataFrame([("train",)] * 3 + [("val",)], "split string")
    assert dataset.repeat(s, F.when(F.col("split") == "train", 2).otherwise(1)).count() == 7
    u = dataset.union([spark.range(2).toDF("a"), spark.range(3).selectExpr("id AS a", "id AS b")])
    assert u.where("b IS NULL").count() == 2


def test_chain(spark):
    rows = [(1, i, 300.0 * i, 5.0 * (i % 2)) for i in range(10)] + [(1, 100 + i, 137.0 * i * i % 2900, 1500.0 + 911.0 * i % 1400) for i in range(5)]
    got = chains.chains(spark.createDataFrame(rows, "cell long, id long, x double, y double")).collect()
    assert {r.id for r in got if r.chain == 0} == set(range(10))


def test_overlap_add_keeps_a_constant(spark):
    w = spark.range(2).selectExpr("id * 4 AS row0", "0 AS col0").crossJoin(spark.range(64).selectExpr("CAST(id / 8 AS INT) AS row", "CAST(id % 8 AS INT) AS col")).withColumn("k", F.lit(1)).withColumn("p", F.lit(0.7))
    got = raster.overlap_add(w, 8, ["k"]).collect()
    assert len(got) == 96 and all(abs(r.p - 0.7) < 1e-12 for r in got)


def test_chain_among_many_points():
    rng = np.random.default_rng(1)
    found = 0
    for seed in range(10):
        line = np.stack([300.0 * np.arange(8), np.zeros(8)], axis=1)
        others = rng.uniform(-30000, 30000, (150, 2))
        # None in the line's corridor, where one far off would be a hole in the chain.
        others[:, 1] += np.where(others[:, 1] < 0, -100, 100)
        points = np.concatenate([line, others])
        pairs = np.random.default_rng(seed).integers(0, len(points), (4000, 2))
        score, inside, _ = chains.scored(points, pairs[pairs[:, 0] != pairs[:, 1]])
        found += set(range(8)) <= set(np.flatnonzero(inside[score.argmax()]).tolist())
    assert found >= 9


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_distance_joins_are_merged(spark):
    """A side beside its cells has many times the rows that Spark expects from the file; none goes through the driver."""
    p = spark.range(300).selectExpr("id", "CAST(id * 37 % 100 AS DOUBLE) AS x", "CAST(id * 53 % 100 AS DOUBLE) AS y")
    for df in (spatial.within(p, p, 5.0), spatial.marked(p, p, 5.0, "m"), spatial.ring_counts(p, p, 1.0, 5.0), spatial.neighbours(p, 5.0)):
        assert _broadcasts(df) == 0


def test_matches_of_a_candidate_are_shuffled_in_sums(spark):
    """Pairs are there once, so their number by candidate needs no distinct: two shuffles by cell, one by candidate."""
    from gridwise.operators import leads

    p = spark.range(60).selectExpr("id", "CAST(id * 37 % 50 AS DOUBLE) AS x", "CAST(id * 53 % 50 AS DOUBLE) AS y", "0.5D AS score")
    pairs = spatial.within(p.drop("score"), p, 8.0)
    best = leads.best_by_candidate(pairs)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert {r.right_id: r.n_endpoints for r in best.collect()} == {r.right_id: r["count"] for r in pairs.groupBy("right_id").count().collect()}


def test_few_neighbours_leave_dense_cells_out(spark, monkeypatch):
    p = spark.range(420).selectExpr("id", "IF(id < 400, id % 20 * 0.1D, id * 4.0D - 1590) AS x", "IF(id < 400, id DIV 20 * 0.1D, 0.0D) AS y")
    want = {(r.id, r.n_near) for r in spatial.neighbours(p, 10.0).where("n_near <= 3").collect()}
    met, kept = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda left, *a, **k: met.append(left.count()) or kept(left, *a, **k))
    assert {(r.id, r.n_near) for r in spatial.neighbours(p, 10.0, most=3).collect()} == want
    assert want and met[0] < 50
