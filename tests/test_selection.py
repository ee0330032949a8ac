"""Quantiles by rounds against sorting, and polygons over a mosaic against a flood fill."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import geo, polygon
from gridwise.operators import raster, selection, shapes


@pytest.mark.parametrize("few", [10_000, 20, 0])
def test_quantiles(spark, few):
    rng = np.random.default_rng(3)
    groups = {
        1: rng.normal(size=900), 2: np.full(300, 2.5), 3: rng.integers(0, 4, 400).astype(float), 4: np.exp(rng.normal(size=500) * 40), 5: np.array([7.0]),
        6: np.concatenate([np.full(200, -1e308), np.full(200, 1e308), [0.0]]), None: rng.normal(size=90),
    }
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in vs] + [(1, None, "x"), (1, float("nan"), "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "g long, v double, lo string").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in selection.quantiles(df, ["g"], "v", shares, few, 16).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s = np.sort(vs)
        for share, q in zip(shares, got[g], strict=True):
            at = share * (len(s) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            want = low + (high - low) * (at - np.floor(at)) if low < high else low
            assert q == want or q == pytest.approx(want, rel=1e-12), (g, share)
    top = {r.g: r for r in selection.with_top_mean(df, ["g"], "v", 0.9, few, 16).collect()}
    for g in (1, 2, 3, 5, None):
        vs = groups[g]
        want = vs[vs >= np.quantile(vs, 0.9)].mean()
        assert (top[g].n, top[g].most) == (len(vs), vs.max()) and top[g].top == pytest.approx(want) and top[g]["mean"] == pytest.approx(vs.mean())
    assert selection.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def flood(grid, low, high):
    h, w = grid.shape
    seen, out = np.zeros(grid.shape, bool), []
    for y0 in range(h):
        for x0 in range(w):
            if grid[y0, x0] >= low and not seen[y0, x0]:
                todo, own = [(y0, x0)], []
                seen[y0, x0] = True
                while todo:
                    y, x = todo.pop()
                    own.append((y, x))
                    for b, a in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= b < h and 0 <= a < w and grid[b, a] >= low and not seen[b, a]:
                            seen[b, a] = True
                            todo.append((b, a))
                if max(grid[p] for p in own) >= high:
                    out.append(set(own))
    return out


def test_mosaic_polygons(spark):
    rng = np.random.default_rng(6)
    grid = rng.random((15, 24)).round(3)
    grid[:, 0] = grid[0] = grid[:, -1] = 0.9  # one region round almost everything
    tiles = [(ty * 10 + tx, tx, ty, 5, 6, [float(v) for v in grid[5 * ty : 5 * ty + 5, 6 * tx : 6 * tx + 6].ravel()]) for ty in range(3) for tx in range(4)]
    df = spark.createDataFrame([*tiles, (99, 9, 9, 5, 6, [0.0] * 30)], "id long, tx int, ty int, h int, w int, px array<double>")
    got = shapes.mosaic_polygons(df, 0.45, 0.8).withColumn("area", polygon.area(F.col("rings"))).withColumn("length", F.aggregate(F.transform("rings", geo.line_length), F.lit(0.0), lambda s, n: s + n)).collect()
    want = flood(grid, 0.45, 0.8)
    assert len(got) == len(want) > 5
    y, x = np.mgrid[0:15, 0:24] + 0.5
    by = {}
    for r in got:
        odd = np.zeros(grid.shape, bool)
        for ring in r.rings:
            assert all(p != q for p, q in zip(ring, ring[1:], strict=False)) and ring[0] == ring[-1]
            for p, q in zip(ring, ring[1:], strict=False):
                odd ^= ((p.y > y) != (q.y > y)) & (x < p.x) & (p.x == q.x)
        cells = frozenset(zip(*(a.tolist() for a in np.nonzero(odd)), strict=True))
        by[cells] = r
        sides = sum((b, a) not in cells for yy, xx in cells for b, a in ((yy + 1, xx), (yy - 1, xx), (yy, xx + 1), (yy, xx - 1)))
        assert r.area == r.n_pixels == len(cells) and r.length == sides
    assert set(by) == set(map(frozenset, want))
    assert raster.mosaic_components(df.limit(0)).count() == 0
