"""Polygons that meet in cells, against plain versions; no list of pairs with rings is shuffled."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridwise.functions import polygon
from gridwise.operators import regions
from gridwise.operators.graph import components

SCHEMA = f"id long, rings {polygon.POLYGON}"


def _ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def _stars(seed, n, wide, size):
    rnd, out = random.Random(seed), []
    for i in range(n):
        x, y, k, r = rnd.uniform(-wide, wide), rnd.uniform(-wide, wide), rnd.randint(4, 9), rnd.uniform(1, size)
        star = _ring([(x + r * rnd.uniform(0.5, 1) * math.cos(2 * math.pi * j / k), y + r * rnd.uniform(0.5, 1) * math.sin(2 * math.pi * j / k)) for j in range(k)])
        out.append((i, [star, _ring([(x + dx * r / 5, y + dy * r / 5) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))])] if i % 3 == 0 else [star]))
    return out + [(1000, []), (1001, None), (1002, [_ring([(0, 0), (3 * wide, 1), (5, 2 * wide)])])]


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Join")


@pytest.fixture(params=("whole", "blocks", "large"))
def way(request, monkeypatch):
    """All in one block of a cell; crowded cells in blocks; most polygons too large to go with their rings."""
    if request.param == "blocks":
        monkeypatch.setattr(regions, "BLOCK", 3)
        monkeypatch.setattr(regions, "LINK_BLOCK", 4)
    if request.param == "large":
        monkeypatch.setattr(regions, "LIGHT", 12)
    return request.param


@pytest.fixture(scope="module")
def pairs(spark):
    """Two tables and all pairs of them with rings."""
    a, b = (spark.createDataFrame(_stars(seed, n, 60, 20), SCHEMA).repartition(2) for seed, n in ((1, 40), (2, 25)))
    whole = "size(rings) > 0"
    both = a.where(whole).toDF("left_id", "left_rings").crossJoin(b.where(whole).toDF("right_id", "right_rings")).cache()
    return a, b, both


def test_distances_between_polygons(spark, pairs, way):
    a, b, both = pairs
    near = regions.near_polygons(a, b, 4.0, 25.0)
    got = {(r.left_id, r.right_id): r.dist for r in near.collect()}
    want = {(r.left_id, r.right_id): r.dist for r in regions._near_by_sides(a, b, 4.0, 25.0).collect()}
    assert got.keys() == want.keys() and len(got) > 50 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    zero = {(r.left_id, r.right_id) for r in both.where(polygon.intersect(F.col("left_rings"), F.col("right_rings"))).collect()}
    assert {k for k, d in got.items() if d == 0} == zero and len(zero) < len(got)
    if way == "whole":
        # Before, all sides of a cell were joined.
        assert _joins(near) == 0


def test_points_near_polygons_are_marks(spark, pairs, way):
    rnd = random.Random(6)
    p = spark.createDataFrame([(i, rnd.uniform(-70, 70), rnd.uniform(-70, 70)) for i in range(60)] + [(99, None, 1.0)], "id long, x double, y double")
    for radius in (0.0, 3.0):
        near = regions.near(pairs[0], p, radius, 25.0)
        want = {r.polygon_id for r in regions.near_points(pairs[0], p, radius, 25.0).collect()}
        assert {r.left_id for r in near.collect()} == want and 3 < len(want) < 42
        assert way != "whole" or _joins(near) == 0


def test_few_links_join_what_meets(spark, pairs, way, monkeypatch):
    monkeypatch.setattr(regions.cells, "FEW", 5)
    one = pairs[0]
    pile = spark.createDataFrame([(2000 + i, [_ring([(500 + i / 9, 500), (510 + i / 9, 500), (510 + i / 9, 510), (500 + i / 9, 510)])]) for i in range(80)], SCHEMA)
    parts = one.unionByName(pile)
    links = regions.links(parts, 25.0)
    got = {(r.node, r.root) for r in components(links).collect()}
    every = regions._fetched_crossing(parts, parts, 25.0).where("left_id < right_id")
    assert got == {(r.node, r.root) for r in components(every, "left_id", "right_id").collect()} and len({r for _, r in got}) > 1
    if way == "whole":
        # The pile alone has over 3,000 pairs; before, all were links.
        assert links.count() < 700 and every.count() > 3000


def test_points_are_counted_in_cells(spark, pairs, way):
    rnd = random.Random(7)
    p = spark.createDataFrame([(i, rnd.uniform(-70, 70), rnd.uniform(-70, 70)) for i in range(200)] + [(999, None, 1.0)], "id long, x double, y double")
    held = p.where("x IS NOT NULL").withColumnRenamed("id", "p").crossJoin(pairs[0].where("size(rings) > 0")).where(polygon.contains(F.col("rings"), F.col("x"), F.col("y")))
    n = regions.counts_in(p, pairs[0], 25.0)
    want = {(r.id, r.n, r.f) for r in held.groupBy("id").agg(F.count("*").alias("n"), F.min("p").alias("f")).collect()}
    assert {tuple(r) for r in n.collect()} == want and len(want) > 10
    assert {tuple(r) for r in regions.points_in(p, pairs[0], 25.0).collect()} == {(r.p, r.id) for r in held.collect()}
    assert way != "whole" or _joins(n) == 0


def test_marks_list_no_pairs(spark, pairs, way):
    a, b, both = pairs
    hit = both.where(polygon.intersect(F.col("left_rings"), F.col("right_rings"))).select("left_id").distinct()
    found = regions.crossed(a, b, 25.0)
    assert {r.left_id for r in found.collect()} == {r.left_id for r in hit.collect()}
    marked = regions.marked(a, b, 25.0, "hit")
    assert marked.count() == a.count() and marked.where("hit").count() == hit.count()
    if way == "whole":
        # Before, rings were joined to each pair of boxes.
        assert _joins(found) == 0


def test_shared_areas_of_pairs(spark, pairs, way):
    a, b, both = pairs
    shared = regions.overlaps(a, b, 25.0)
    got = {(r.left_id, r.right_id): r.overlap for r in shared.collect()}
    area = both.select("left_id", "right_id", polygon.shared_area(F.col("left_rings"), F.col("right_rings")).alias("s")).where("s > 0")
    want = {(r.left_id, r.right_id): r.s for r in area.collect()}
    assert {k for k in got.keys() ^ want.keys() if max(got.get(k, 0), want.get(k, 0)) > 1e-9} == set()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got.keys() & want.keys()) and len(want) > 50
    assert way != "whole" or _joins(shared) == 0
