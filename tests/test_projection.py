"""The transverse Mercator grid against the meridian's length and its own inverse, and warping against a loop."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridwise.functions import geo
from gridwise.operators import raster


def test_utm(spark):
    rows = [(lon, lat, int((lon + 180) // 6) + 1) for lon in np.linspace(-179.5, 179.5, 41) for lat in (-79.9, -33.3, -1e-3, 0.0, 12.5, 48.85, 80.0)]
    df = spark.createDataFrame([(float(a), float(b), z) for a, b, z in rows], "lon double, lat double, zone int").withColumn("south", F.col("lat") < 0)
    df = df.withColumn("m", geo.utm_xy(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))).withColumn("b", geo.utm_lonlat(F.col("m.x"), F.col("m.y"), F.col("zone"), F.col("south")))
    for r in df.collect():
        assert abs(r.b.lon - r.lon) < 1e-9 and abs(r.b.lat - r.lat) < 1e-9
        assert 100_000 < r.m.x < 900_000
    # On the central meridian, the way from the equator is the meridian's length, here by a sum over many small steps.
    lat = np.linspace(0, 45, 200_001)
    step = geo.A * (1 - geo.E2) / (1 - geo.E2 * np.sin(np.radians((lat[1:] + lat[:-1]) / 2)) ** 2) ** 1.5 * np.radians(lat[1] - lat[0])
    p = spark.range(1).select(geo.utm_xy(F.lit(3.0), F.lit(45.0), F.lit(31), F.lit(False)).alias("m"), geo.utm_xy(F.lit(3.001), F.lit(45.0), F.lit(31), F.lit(False)).alias("e")).first()
    assert abs(p.m.y - 0.9996 * step.sum()) < 1e-3 and p.m.x == 500_000
    # Close to it, a step to the east is the parallel's length.
    east = 0.9996 * math.radians(0.001) * geo.A * math.cos(math.pi / 4) / math.sqrt(1 - geo.E2 / 2)
    assert abs(p.e.x - 500_000 - east) < 1e-4
    box = spark.range(1).select(geo.utm_bounds(F.lit(400_000.0), F.lit(5_000_000.0), F.lit(600_000.0), F.lit(5_100_000.0), F.lit(31), F.lit(False)).alias("b")).first().b
    assert box.xmin < 1.75 and box.xmax > 4.25 and abs(box.xmin + box.xmax - 6) < 1e-9 and 45.1 < box.ymin < 45.16 and 46.0 < box.ymax < 46.1


def test_warped(spark):
    rng = np.random.default_rng(2)
    source = rng.integers(0, 5, (9, 16)).astype(float)
    tiles = [(tx, ty, [float(v) for v in source[3 * ty : 3 * ty + 3, 4 * tx : 4 * tx + 4].ravel()]) for ty in range(3) for tx in range(4) if (tx, ty) != (2, 1)]
    source[3:6, 8:12] = 0  # a tile that isn't there
    t = spark.createDataFrame(tiles, "tx int, ty int, px array<double>")
    grid = spark.createDataFrame([("a", -1.0, -1.0, 0.75, 8, 9), ("b", 5.0, 3.0, 1.5, 7, 8)], "block string, x0 double, y0 double, step double, h int, w int")
    for how in ("nearest", "bilinear"):
        got = {(r.block, r.row, r.col): r.value for r in raster.warped(t, grid, lambda x, y: (0.9 * x + 0.2 * y, 0.8 * y - 0.1 * x), (3, 4), how).collect()}
        n = 0
        for block, x0, y0, step, h, w in grid.collect():
            for row in range(h):
                for col in range(w):
                    u, v = x0 + (col + 0.5) * step, y0 + (row + 0.5) * step
                    x, y = 0.9 * u + 0.2 * v, 0.8 * v - 0.1 * u
                    at = lambda i, j: source[j, i] if 0 <= j < 9 and 0 <= i < 16 else 0.0
                    if how == "nearest":
                        want = at(math.floor(x), math.floor(y))
                    else:
                        i, j = math.floor(x - 0.5), math.floor(y - 0.5)
                        a, b = x - 0.5 - i, y - 0.5 - j
                        four = [(at(i + dx, j + dy), (a if dx else 1 - a) * (b if dy else 1 - b)) for dx in (0, 1) for dy in (0, 1)]
                        held = [(p, k) for p, k in four if p]
                        want = sum(p * k for p, k in held) / sum(k for _, k in held) if held and sum(k for _, k in held) else 0.0
                    assert abs(got[block, row, col] - want) < 1e-9, (how, block, row, col)
                    n += 1
        assert n == len(got)
