"""Overlays against a raster of points, and closed forms."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import polygon
from gridwise.operators import overlay

KIND = f"group long, part long, rings {polygon.POLYGON}"


def star(rng, cx, cy, r, n):
    # One angle in each of n sectors, so that no two neighbours are half a turn apart and no sides cross.
    angles = [(k + 0.9 * rng.random()) * 2 * math.pi / n for k in range(n)]
    ring = [(cx + r * (0.3 + rng.random()) * math.cos(a), cy + r * (0.3 + rng.random()) * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


def inside(rings, x, y):
    odd = np.zeros(x.shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def plain(rings):
    return [[(p["x"], p["y"]) for p in r] for r in rings]


@pytest.fixture(scope="module")
def stars():
    rng = random.Random(4)
    rows = []
    for g in range(6):
        for part in range(4 if g < 5 else 12):
            cx, cy = 40 + rng.random() * 30, 40 + rng.random() * 30
            ring = star(rng, cx, cy, 12 + 10 * rng.random(), rng.randrange(5, 11))
            hole = [(cx + dx, cy + dy) for dx, dy in ((0.9, 0), (0, 0.9), (-0.9, 0), (0, -0.9), (0.9, 0))]
            rows.append((g, part, [ring, hole] if part % 2 else [ring]))
    return rows


def check(got, rows, want):
    gx, gy = np.meshgrid(np.linspace(0, 110, 400) + 0.0123, np.linspace(0, 110, 400) + 0.0217)
    for g in sorted({r[0] for r in rows}):
        parts = [inside(r[2], gx, gy) for r in rows if r[0] == g]
        own = [inside(plain(r.rings), gx, gy) for r in got if r.group == g]
        made = np.sum(own, axis=0) if own else np.zeros(gx.shape, int)
        # A point nearer to a side than the coordinates' last place may fall on either side of it.
        assert made.max() <= 1 and (made.astype(bool) != want(parts)).sum() <= 2, g


@pytest.mark.parametrize(("fn", "want"), [(overlay.union, lambda p: np.any(p, axis=0)), (overlay.intersection, lambda p: np.all(p[:2], axis=0)), (overlay.difference, lambda p: p[0] & ~np.any(p[1:], axis=0))])
def test_stars(spark, stars, fn, want):
    rows = [r for r in stars if fn is not overlay.intersection or r[1] < 2]
    df = spark.createDataFrame([(g, k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for g, k, rings in rows], KIND).repartition(3)
    check(fn(df, 7.0).collect(), rows, want)


def box(x, y, w, h):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y))]


def test_shared_sides_corners_and_copies(spark):
    rows = [
        (1, 1, [box(0, 0, 2, 2)]), (1, 2, [box(2, 0, 2, 2)]), (1, 3, [box(0, 2, 4, 1)]),  # share sides: one box
        (2, 1, [box(0, 0, 1, 1)]), (2, 2, [box(1, 1, 1, 1)]),  # share a corner: two boxes
        (3, 1, [box(0, 0, 5, 5)]), (3, 2, [box(0, 0, 5, 5)]), (3, 3, [box(1, 1, 2, 2)]),  # copies, and one within
        (4, 1, [box(0, 0, 3, 1)]), (4, 2, [box(0, 2, 3, 1)]), (4, 3, [box(0, 0, 1, 3)]), (4, 4, [box(2, 0, 1, 3)]),  # a frame
        (5, 1, [box(0, 0, 6, 6), box(1, 1, 4, 4)]), (5, 2, [box(2, 2, 1, 1)]),  # an island in a hole
    ]
    df = spark.createDataFrame(rows, KIND)
    got = overlay.union(df).withColumn("area", polygon.area(F.col("rings"))).collect()
    sizes = {g: sorted((round(r.area, 6), len(r.rings), sum(map(len, r.rings))) for r in got if r.group == g) for g in range(1, 6)}
    assert sizes == {1: [(12.0, 1, 5)], 2: [(1.0, 1, 5), (1.0, 1, 5)], 3: [(25.0, 1, 5)], 4: [(8.0, 2, 10)], 5: [(1.0, 1, 5), (20.0, 2, 10)]}
    two = df.where("part < 3")
    shared = {r.group: round(r.area, 6) for r in overlay.intersection(two).withColumn("area", polygon.area(F.col("rings"))).collect()}
    assert shared == {3: 25.0}
    left = {r.group: round(r.area, 6) for r in overlay.difference(two).withColumn("area", polygon.area(F.col("rings"))).collect()}
    assert left == {1: 4.0, 2: 1.0, 4: 3.0, 5: 20.0}
    assert overlay.union(df.limit(0)).count() == 0


def test_open_sides_are_left_out(spark):
    edges = [(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 0.0, 0.0), (1, 5.0, 5.0, 6.0, 6.0), (1, 6.0, 6.0, 7.0, 6.0)]
    got = overlay.rings(spark.createDataFrame(edges, "group long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert len(got) == 1 and got[0].turned == 1.0 and len(got[0].points) == 4


def test_sides_under_others_are_gone_before_they_meet(spark):
    rnd = random.Random(3)
    rows = [(1, i, [box(rnd.randrange(0, 90), rnd.randrange(0, 90), 10, 10)]) for i in range(1500)] + [(2, 1, [box(0, 0, 10, 10)]), (3, 1, [box(0, 0, 9, 9), box(2, 2, 5, 5)]), (3, 2, [box(3, 3, 1, 1)])]
    df = spark.createDataFrame(rows, KIND)
    touched = overlay.open_sides(df)
    # Of the pile's 6,000 sides few are left, and all of the others.
    left = {r["group"]: r.n for r in touched.groupBy("group").agg(F.count_distinct("side").alias("n")).collect()}
    assert left[1] < 1500 and left[2] == 4 and left[3] == 12
    grid = np.zeros((100, 100), bool)
    for g, _, rings in rows:
        if g == 1:
            x, y = int(min(p["x"] for p in rings[0])), int(min(p["y"] for p in rings[0]))
            grid[x : x + 10, y : y + 10] = True
    got = {r["group"]: r.a for r in overlay.union(df).groupBy("group").agg(F.sum(polygon.area(F.col("rings"))).alias("a")).collect()}
    assert {g: round(a, 6) for g, a in got.items()} == {1: float(grid.sum()), 2: 100.0, 3: 57.0}


@pytest.mark.parametrize("light", (20_000, 15))
def test_pairs_are_overlaid_where_they_meet(spark, stars, monkeypatch, light):
    monkeypatch.setattr(overlay.regions, "LIGHT", light)
    as_ring = lambda rings: [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    kind = f"id long, rings {polygon.POLYGON}"
    a = [(g * 20 + k, as_ring(rings)) for g, k, rings in stars if k % 3 == 0]
    b = [(g * 20 + k, as_ring(rings)) for g, k, rings in stars if k % 3 == 1]
    # A frame cut in two with a hole in one half, an island in a hole, copies, and a shared side only.
    a += [(900, [box(200, 0, 10, 10), box(201, 4, 1, 1)]), (901, [box(300, 0, 6, 6), box(301, 1, 4, 4)]), (902, [box(400, 0, 5, 5)]), (903, [box(500, 0, 2, 2)]), (904, [])]
    b += [(900, [box(204, -1, 2, 20)]), (901, [box(300.5, 0.5, 5, 5)]), (902, [box(400, 0, 5, 5)]), (903, [box(502, 0, 2, 2)])]
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    made = overlay.overlaid(left, right, 20.0)
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda n, p: n + polygon.area(p))
    got = {(r.left_id, r.right_id): (r.s, r.r, r.n, r.m) for r in made.select("left_id", "right_id", total("shared").alias("s"), total("rest").alias("r"), F.size("shared").alias("n"), F.size("rest").alias("m")).collect()}
    two = overlay.paired(overlay.regions.fetched(left, right, 20.0))
    each = [{tuple(r["group"]): (r.a, r.n) for r in f(two, 20.0).groupBy("group").agg(F.sum(polygon.area(F.col("rings"))).alias("a"), F.count("*").alias("n")).collect()} for f in (overlay.intersection, overlay.difference)]
    assert got.keys() == each[0].keys() and len(got) > 20
    for k, (s, r, n, m) in got.items():
        want = (*each[0][k], *each[1].get(k, (0.0, 0)))
        assert abs(s - want[0]) < 1e-3 and abs(r - want[2]) < 1e-3 and (n, m) == (want[1], want[3]), k
    assert got[900, 900][2:] == (1, 2) and got[902, 902][3] == 0 and (903, 903) not in got
    rest = made.where("left_id = 900").select(F.transform("rest", lambda p: F.size(p)).alias("n")).first().n
    assert sorted(rest) == [1, 2]
    if light > 15:
        # Before, pairs with their rings were written, cut and joined.
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_long_ring_takes_work_by_its_corners(spark):
    n = 6000
    at = lambda k: [1000 + 900 * f(2 * math.pi * (k % n) / n) * (1 + k % 2 * 0.01) for f in (math.cos, math.sin)]
    edges = spark.createDataFrame([(1, *at(k), *at(k + 1)) for k in range(n)], "group long, x0 double, y0 double, x1 double, y1 double")
    made = overlay.rings(edges)
    start = time.monotonic()
    ring = made.first()
    # Before, each corner's neighbours were looked up in a ring made anew.
    assert len(ring.points) == n + 1 and time.monotonic() - start < 60
