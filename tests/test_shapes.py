"""Polygons, outlines, refinement, chains and tile shapes against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import polygon
from gridwise.operators import chains, dataset, ranking, raster, regions, shapes, spatial


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def inside(point, rings):
    odd = False
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if (a["y"] > point[1]) != (b["y"] > point[1]) and point[0] < (b["x"] - a["x"]) * (point[1] - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
    return odd


def star(rnd, cx, cy, size):
    k = rnd.randint(5, 9)
    return [(cx + size * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * i / k), cy + size * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]


def test_polygon_functions(spark):
    square, hole = ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(4, 4), (6, 4), (6, 6), (4, 6)])
    bend = ring([(0, 0), (8, 0), (8, 8), (7, 8), (7, 1), (0, 1)])
    df = spark.createDataFrame([(1, [square, hole]), (2, [bend]), (3, []), (4, None)], f"id long, rings {polygon.POLYGON}")
    at = polygon.interior_point(F.col("rings"))
    got = {r.id: r for r in df.select("id", polygon.area(F.col("rings")).alias("a"), polygon.distance(F.col("rings"), F.lit(5.0), F.lit(5.0)).alias("d"), at.alias("p"), polygon.contains(F.col("rings"), at["x"], at["y"]).alias("i")).collect()}
    assert got[1].a == 96 and got[1].d == 1.0 and got[2].a == 15 and got[2].d == 2.0 and got[1].i and got[2].i
    assert got[3].a == 0 and got[4].a == 0 and got[3].p is None and not got[4].i
    big = spark.createDataFrame([(1, [ring([(60, 20), (61, 20), (61, 21), (60, 21)])])], f"id long, rings {polygon.POLYGON}").select(polygon.geodesic_area(F.col("rings")).alias("a")).first().a
    assert abs(big / 1.1560e10 - 1) < 0.01
    assert polygon.hull_of(np.array([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)], float)).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    assert polygon.thinned(np.array([(0, 0), (1, 0.01), (2, 0), (2, 2)], float), 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]
    lines = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0001}, {"x": 2.00049, "y": 0.0}],)], f"r {polygon.RING}")
    assert [tuple(p) for p in lines.select(polygon.simplify(F.col("r"), 0.03, 3).alias("r")).first().r] == [(0.0, 0.0), (2.0, 0.0)]


def test_joins_of_polygons(spark):
    rnd = random.Random(3)
    shape = lambda n, size: {i: [ring(star(rnd, rnd.uniform(0, 100), rnd.uniform(0, 100), size))] for i in range(n)}
    a, b = shape(40, 9), shape(30, 14)
    frame = lambda s: spark.createDataFrame(list(s.items()), f"id long, rings {polygon.POLYGON}")
    points = {i: (rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(300)}
    p = spark.createDataFrame([(i, *q) for i, q in points.items()] + [(999, None, 1.0)], "id long, x double, y double")
    got = {(r.point_id, r.polygon_id) for r in regions.points_in(p, frame(a), 12.0).collect()}
    assert got == {(i, k) for i, q in points.items() for k, s in a.items() if inside(q, s)} and got

    def touch(s, t):
        def cross(o, p, q):
            return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])

        for e, f in zip(s[0], s[0][1:], strict=False):
            for g, h in zip(t[0], t[0][1:], strict=False):
                if cross(e, f, g) * cross(e, f, h) <= 0 and cross(g, h, e) * cross(g, h, f) <= 0:
                    return True
        return inside((s[0][0]["x"], s[0][0]["y"]), t) or inside((t[0][0]["x"], t[0][0]["y"]), s)

    for size in (5.0, 40.0):
        assert {(r.left_id, r.right_id) for r in regions.crossing(frame(a), frame(b), size).collect()} == {(i, k) for i, s in a.items() for k, t in b.items() if touch(s, t)}
    # Shared areas against a fine raster.
    box = {0: [ring([(20, 20), (70, 25), (60, 75), (25, 60)])]}
    for r in regions.overlaps(frame(a), frame(box), 20.0).collect():
        n = sum(inside((x / 5 + 0.1, y / 5 + 0.1), a[r.left_id]) and inside((x / 5 + 0.1, y / 5 + 0.1), box[0]) for x in range(500) for y in range(500)) if r.left_id % 13 == 0 else None
        assert n is None or abs(r.overlap - n / 25) < 2.0


@pytest.mark.parametrize("seed", range(6))
def test_outlines(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((9, 11)) < 0.6
    lab = raster.label(mask, False)
    for k in np.unique(lab[lab >= 0]):
        row, col = np.nonzero(lab == k)
        rings = shapes.outline(row, col)
        size = [(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2 for r in rings]
        assert size[0] > 0 and all(s < 0 for s in size[1:]) and sum(size) == len(row)
        plain = [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings]
        assert all(inside((c + 0.5, r + 0.5), plain) == (lab[r, c] == k) for r in range(9) for c in range(11))
        for r in rings:
            assert (r[0] == r[-1]).all()
            d = np.diff(r, axis=0)
            assert (d[:-1, 0] * d[1:, 0] + d[:-1, 1] * d[1:, 1] == 0).all() and (d[0] @ d[-1] == 0)


def test_burned_and_zonal(spark):
    tri = [ring([(1.5, 1.5), (6.2, 1.5), (1.5, 6.2)])]
    s = spark.createDataFrame([(0, 1, tri), (0, -1, [ring([(0, 0), (2, 0), (2, 2), (0, 2)])])], f"id long, value int, rings {polygon.POLYGON}")
    g = spark.createDataFrame([(0, 8, 8)], "id long, h int, w int")
    got = {(r.row, r.col): r.value for r in shapes.burned(s, g, 1.0).collect()}
    assert len(got) == 64 and got[1, 1] == 1 and got[0, 0] == -1 and got[6, 1] == 1 and got[7, 7] == 0 and got[3, 3] == 1 and got[4, 4] == 0
    cells = spark.createDataFrame([(r + 0.5, c + 0.5, float(r * 8 + c)) for r in range(8) for c in range(8)], "y double, x double, p double")
    z = shapes.zonal(cells, spark.createDataFrame([(5, tri)], f"id long, rings {polygon.POLYGON}"), 4.0, 1.0).first()
    held = [r * 8 + c for r in range(8) for c in range(8) if inside((c + 0.5, r + 0.5), tri)]
    assert (z.zone_id, z.n, round(z["mean"], 9), round(z["std"], 9)) == (5, len(held), round(np.mean(held), 9), round(np.std(held), 9))


def test_refinement(spark):
    n = 20
    db, inside_, built = np.full((n, n), -15.0), np.zeros((n, n), bool), np.zeros((n, n), bool)
    inside_[4:14, 4:14] = True
    db[5:9, 5:9] = -5.0
    red, nir = np.full((n, n), 500.0), np.full((n, n), 3000.0)
    nir[5:10, 5:10] = 600.0
    weak, roofs, spread = db.copy(), built.copy(), nir.copy()
    weak[5:9, 5:9] = -12.0
    roofs[5:8, 5:9] = True
    spread[5:14:2, 5:14] = 600.0
    pieces = nir.copy()
    pieces[5:10, 5:10] = 3000.0
    pieces[5:7, 5:7] = pieces[8, 5:9] = 600.0
    two = db.copy()
    two[8, 5:9] = -5.0
    far = np.full((n, n), 3000.0)
    far[0, 0] = 600.0
    cases = {
        "refined": {}, "no_signal": {"db": weak}, "village": {"built": roofs}, "no_s2": {"red": None}, "grid_mismatch": {"red": red[:5]}, "no_bare": {"nir": np.full((n, n), 3000.0)},
        "tight": {"nir": np.where(inside_, 600.0, 3000.0)}, "fragmented": {"db": two, "nir": pieces}, "no_bg": {"db": np.full((n, n), np.nan)}, "refine_failed": {"nir": far},
    }
    flat = lambda a, kind=float: None if a is None else [None if x != x else kind(x) for x in a.ravel()]

    def row(name, area=10000.0, vv=True, **k):
        x = {"db": db, "inside": inside_, "built": built, "red": red, "nir": nir} | k
        return (name, n, n, area, 100.0, flat(x["db"]) if vv else None, flat(x["db"] - 3), flat(x["inside"], bool), flat(x["built"], bool), flat(x["red"]), flat(x["nir"]))

    schema = "id string, h int, w int, area_m2 double, pixel_m2 double, vv array<double>, vh array<double>, inside array<boolean>, built array<boolean>, red array<double>, nir array<double>"
    made = shapes.refined(spark.createDataFrame([*(row(name, **k) for name, k in cases.items()), row("unchecked", 50.0), row("no_s1", vv=False)], schema), 1000.0)
    got = {r.id: r for r in made.collect()}
    assert {k: r.status for k, r in got.items()} == {k: k for k in [*cases, "unchecked", "no_s1"]}
    assert got["refined"].refined_area_m2 == 2500.0 and sum(got["refined"].mask) == 25 and all((r.mask is None) == (k != "refined") for k, r in got.items())
    assert {k: r.refined_area_m2 for k, r in got.items() if k not in ("refined", "tight")} == {"no_signal": 0.0, "village": 10000.0, "no_s2": None, "grid_mismatch": 10000.0, "no_bare": 0.0, "fragmented": 10000.0, "no_bg": None, "refine_failed": 10000.0, "unchecked": 50.0, "no_s1": None}
    rings = shapes.outlines_of(made, 10.0).collect()
    assert [(r.id, len(r.rings)) for r in rings] == [("refined", 1)] and {(p.x, p.y) for p in rings[0].rings[0]} == {(50.0, 50.0), (100.0, 50.0), (100.0, 100.0), (50.0, 100.0)}


def test_chains(spark):
    rnd = random.Random(4)
    rows, k = [], 0
    for cell, (dx, dy) in ((1, (250.0, 100.0)), (2, (0.0, 300.0))):
        for i in range(9):
            rows.append((cell, k, i * dx + rnd.uniform(-20, 20), i * dy + rnd.uniform(-20, 20)))
            k += 1
        for _ in range(60):
            rows.append((cell, k, rnd.uniform(0, 12000), rnd.uniform(0, 12000)))
            k += 1
    rows.append((1, 10_000, None, 5.0))
    p = spark.createDataFrame(rows, "cell long, id long, x double, y double")
    got = chains.chains(p, tries=2000).where("chain = 0").collect()
    for cell, first in ((1, 0), (2, 69)):
        assert len({r.id for r in got if r.cell == cell} & set(range(first, first + 9))) >= 7, cell
    assert sorted(map(str, got)) == sorted(map(str, chains.chains(p.repartition(3), tries=2000).where("chain = 0").collect()))
    # The score and the gap rules by hand: seven points 250 m apart.
    line = np.array([(250.0 * i, 0.0) for i in range(7)] + [(250.0, 0.5)])
    s, inside_, _ = chains.scored(line, np.array([[0, 6], [0, 1], [0, 3]]))
    assert s.tolist() == [8 * 1.0, 0.0, 8 * 1.0] and inside_.all()
    assert chains.scored(np.array([(1000.0 * i, 0.0) for i in range(7)]), np.array([[0, 2]]))[0].tolist() == [0.0]
    axis = chains.axes(spark.createDataFrame(got), p).where("cell = 2").first()
    assert axis.n_points >= 7 and axis.span > 1500
    lines = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2400.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    r = chains.against_lines(spark.createDataFrame(got).where("cell = 2"), p, lines).first()
    assert r.on_line >= 7 and r.samples == 13 and r.covered >= 10


def test_tiles_of_other_sizes(spark):
    x = np.arange(12.0).reshape(3, 4)
    t = spark.createDataFrame([(1, 3, 4, x.ravel().tolist())], "id long, h int, w int, px array<double>")
    grid = lambda df: (lambda r: np.array(r.px).reshape(r.h, r.w))(df.first())
    for q in range(4):
        for m in (False, True):
            want = np.rot90(x, q)
            assert (grid(raster.turned(t, q, m)) == (np.fliplr(want) if m else want)).all()
    assert (grid(raster.fitted(t, 2)) == x[0:2, 1:3]).all() and (grid(raster.fitted(t, 6))[:3, :4] == x).all() and grid(raster.fitted(t, 6)).sum() == x.sum()
    assert (grid(raster.resampled(t, 6, 8, "nearest")) == x.repeat(2, 0).repeat(2, 1)).all()
    for mode in ("bilinear", "bicubic"):
        up = grid(raster.resampled(t, 6, 8, mode))
        assert np.allclose(up[2:4, 2:6], up[2:4, 2:6][::-1, ::-1] * -1 + 2 * x.mean()) and np.allclose(grid(raster.resampled(t.withColumn("px", F.transform("px", lambda v: F.lit(2.0))), 5, 7, mode)), 2.0)
    a = (10.0, 0.0, 500.0, 0.0, -10.0, 900.0)
    p = t.select(*raster.map_of(F.lit(2), F.lit(3), a), *raster.pixel_of(F.lit(539.0), F.lit(871.0), a)).first()
    assert tuple(p) == (535.0, 875.0, 2, 3)


def test_ranks_and_guards(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 10)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else 1.0) for i in range(60)], "id long, s double")
    got = {r.id: r.n for r in ranking.numbered(df, "s", [F.col("id")]).collect()}
    want = sorted(range(60), key=lambda i: (i % 5 == 0, i))
    assert [got[i] for i in want] == list(range(60))
    marks = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, t int")
    r = ranking.mann_whitney(marks, "s", "t").first()
    z = (4.5 - 3 - 0.5) / math.sqrt(3 * 2 / 12 * (6 - 6 / 20))
    assert (r.u, round(r.z, 9), round(r.p, 9)) == (4.5, round(z, 9), round(math.erfc(z / math.sqrt(2)) / 2, 9))
    cells = spark.range(100).withColumnRenamed("id", "cell")
    assert dataset.with_layer(cells, cells.where("cell >= 5"), "cell").count() == 95
    with pytest.raises(dataset.MissingLayer):
        dataset.with_layer(cells, cells.where("cell >= 6"), "cell")
    assert dataset.recipe("a:3, b,") == [("a", 3), ("b", 1)]


def test_crowded_cells_and_far_points(spark, monkeypatch):
    """One cell holds most points, and a point lies far from all others."""
    monkeypatch.setattr(spatial, "CROWDED", 50)
    rnd = random.Random(5)
    right = [(i, rnd.uniform(0, 90), rnd.uniform(0, 90)) for i in range(300)] + [(1000 + i, rnd.uniform(0, 3000), rnd.uniform(0, 3000)) for i in range(40)]
    left = [(i, rnd.uniform(0, 90), rnd.uniform(0, 90)) for i in range(30)] + [(500, 4e6, -3e6), (501, -2e6, 10.0), (502, None, 1.0)]
    a, b = (spark.createDataFrame(v, "id long, x double, y double") for v in (left, right))
    dist = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    got = {(r.left_id, r.right_id) for r in spatial.within(a, b, 40.0).collect()}
    assert got == {(p[0], q[0]) for p in left if p[1] is not None for q in right if dist(p, q) <= 40.0}
    near = {r.id: (r.near_dist, r.near_id) for r in spatial.nearest(a, b).collect()}
    assert near[502] == (None, None)
    for p in left[:-1]:
        assert near[p[0]] == min((round(dist(p, q), 1), q[0]) for q in right)
    segments = [(q[0], q[1], q[2], q[1] + rnd.uniform(-200, 200), q[2] + rnd.uniform(-200, 200)) for q in right]
    s = spark.createDataFrame(segments, "id long, x0 double, y0 double, x1 double, y1 double")

    def to_segment(p, q):
        dx, dy = q[3] - q[1], q[4] - q[2]
        t = min(1.0, max(0.0, ((p[1] - q[1]) * dx + (p[2] - q[2]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[1] - q[1] - t * dx, p[2] - q[2] - t * dy)

    near = {r.id: r.near_dist for r in spatial.nearest(a, s).collect()}
    for p in left[:-1]:
        assert abs(near[p[0]] - min(to_segment(p, q) for q in segments)) <= 0.051
