"""Scene search, image stacks with masks, and filling up an index against plain versions."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import catalog

DAY = datetime.date(2024, 1, 1)


def test_scenes_of_areas(spark):
    rnd = random.Random(3)
    box = lambda wide: (x := rnd.randrange(0, 300), y := rnd.randrange(0, 300), x + wide, y + wide)
    items = [(i, DAY + datetime.timedelta(rnd.randrange(20)), rnd.choice([None, 5.0, 20.0, 20.0, 70.0]), *map(float, box(40))) for i in range(300)]
    items.append((900, None, 1.0, 0.0, 0.0, 300.0, 300.0))
    items.append((901, DAY, 1.0, None, 0.0, 300.0, 300.0))
    areas = [(i, *map(float, box(rnd.choice([0, 30])))) for i in range(40)] + [(99, None, 0.0, 1.0, 1.0), (98, 5000.0, 5000.0, 5001.0, 5001.0)]
    a = spark.createDataFrame(areas, "id long, xmin double, ymin double, xmax double, ymax double")
    s = spark.createDataFrame(items, "id long, day date, cloud double, xmin double, ymin double, xmax double, ymax double").withColumn("area", F.lit("clash"))
    window = ("2024-01-04", "2024-01-15")

    def plain(below, most, key):
        out = set()
        for aid, x0, y0, x1, y1 in areas:
            if x0 is None:
                continue
            fits = [i for i in items if None not in i[3:] and i[1] and datetime.date(2024, 1, 4) <= i[1] <= datetime.date(2024, 1, 15) and (below is None or (i[2] is not None and i[2] < below)) and i[3] <= x1 and x0 <= i[5] and i[4] <= y1 and y0 <= i[6]]
            out |= {(aid, n, i[0]) for n, i in enumerate(sorted(fits, key=key)[:most], 1)}
        return out

    got = lambda **k: {(r.area, r.n, r.id) for r in catalog.searched(a, s.drop("area"), 50.0, window, **k).collect()}
    assert got(below=60.0, most=4) == plain(60.0, 4, lambda i: (i[2], i[0]))
    assert got() == plain(None, None, lambda i: (100.0 if i[2] is None else i[2], i[0]))
    assert got(most=3, order=[F.col("day")]) == plain(None, 3, lambda i: (i[1], i[0]))
    assert catalog.searched(a.limit(0), s.drop("area"), 50.0).count() == 0


def test_files_and_bands(spark):
    paths = ["a/b/x.tar.gz", "x.npz", "/data/.hidden", "folder/", None]
    got = [r.f for r in spark.createDataFrame([(p,) for p in paths], "p string").select(catalog.file_of(F.col("p")).alias("f")).collect()]
    assert [(f.folder, f.name, f.stem, f.suffix) for f in got] == [("a/b", "x.tar.gz", "x.tar", ".gz"), ("", "x.npz", "x", ".npz"), ("/data", ".hidden", ".hidden", ""), ("folder", "", "", ""), (None, None, None, None)]
    row = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],), (None,)], "v array<double>").select(catalog.bands(F.col("v"), ["r", "g", "b"], ["b", "r"]).alias("b")).collect()
    assert [r.b for r in row] == [[3.0, 1.0], [None, 1.0], None]
    with pytest.raises(KeyError, match="unknown bands: swir"):
        catalog.band_places(["r"], ["swir"])


def square(a, size):
    y, x = (max((n - size) // 2, 0) for n in a.shape[-2:])
    a = a[..., y : y + size, x : x + size]
    out = np.zeros((*a.shape[:-2], size, size), a.dtype)
    out[..., : a.shape[-2], : a.shape[-1]] = a
    return out


def test_stacks_become_chips(spark):
    rng = np.random.default_rng(5)
    stacks = {f"lat_{10 + i}.5_lon_-{20 + i}.25.npz": rng.integers(-50, 70000, (3, 2, h, w)).astype(float) for i, (h, w) in enumerate(((5, 5), (7, 3), (2, 9)))}
    images = [(f"in/{k}", list(a.shape), a.ravel().tolist()) for k, a in stacks.items()]
    masks = [(f"m/{k}", list(a.shape[2:]), rng.integers(1, 4, a.shape[2] * a.shape[3]).astype(float).tolist()) for k, a in stacks.items()]
    images += [("in/none.npz", [1, 2, 1, 1], [1.0, 2.0]), ("in/odd_lat_1_lon_2.npz", [1, 3, 1, 1], [1.0, 2.0, 3.0]), ("in/lat_3_lon_4.npz", [1, 2, 1, 1], [1.0, 2.0]), ("in/null_lat_1_lon_2.npz", None, None)]
    masks += [("m/none.npz", [1, 1], [3.0]), ("m/odd_lat_1_lon_2.npz", [1, 1], [3.0]), ("m/null_lat_1_lon_2.npz", [1, 1], [3.0]), (None, [1, 1], [3.0])]
    # Another mask of the same name counts less.
    masks.append((f"z/{next(iter(stacks))}", [1, 1], [1.0]))
    schema = "path string, shape array<int>, px array<double>"
    chips, n = catalog.converted(spark.createDataFrame(images, schema).withColumn("mask", F.lit(1)), spark.createDataFrame(masks, schema), ["b1", "b2"], ["b2"], 4, 3)
    assert {r.outcome: r.n for r in n.collect()} == {"converted": 3, "unplaced": 1, "unreadable": 2, "unmatched": 1}
    by_path = {m[0]: m for m in masks}
    for r in chips.collect():
        name = r.path.split("/")[1]
        a, m = stacks[name], by_path[f"m/{name}"]
        image = np.clip(square(np.median(a[:, [1]], axis=0), 4), 0, 65535).astype(int)
        mask = square((np.array(m[2]).reshape(m[1]) == 3).astype(int), 4)
        assert r.image == image.ravel().tolist() and r["mask"] == mask.ravel().tolist()
        assert (r.sub_pixels, r.kind, r.split) == (mask.sum(), "positive" if mask.any() else "background", "train")
        assert r.epsg == 32600 + int((r.lon + 180) // 6) + 1
    empty = spark.createDataFrame([], schema)
    assert catalog.converted(empty, empty, ["b1"], ["b1"], 4, 3)[0].count() == 0


def test_backfill(spark):
    index = spark.createDataFrame([(1, "a", 9), (2, None, 8), (3, None, 7), (None, None, 6), (2, "own", 5)], "id long, s1 string, x int")
    layer = spark.createDataFrame([(2, "c"), (2, "b"), (3, None), (None, "n"), (7, "z")], "id long, s1 string")
    rows, n = catalog.backfilled(index, layer, "id", "s1")
    assert sorted((r.id, r.s1, r.x) for r in rows.collect()) == [(1, "a", 9), (2, "b", 8), (2, "own", 5)]
    assert {r.outcome: r.n for r in n.collect()} == {"existing": 2, "written": 1, "missing": 2}


def test_scenes_behind_enough_covers_are_not_met(spark, monkeypatch):
    """With a limit, areas meet only what can be among their best; all the same the best are those of brute force."""
    import random

    from gridwise.operators import catalog, regions

    rnd = random.Random(3)
    box = lambda lo, hi: (x := rnd.uniform(-50, 50), y := rnd.uniform(-50, 50), x + rnd.uniform(lo, hi), y + rnd.uniform(lo, hi))
    areas, items = [(i, *box(0, 12)) for i in range(40)], [(i, None if i % 9 == 0 else float(rnd.randrange(20)), *box(2, 40)) for i in range(400)]
    edges = "xmin double, ymin double, xmax double, ymax double"
    a, b = spark.createDataFrame(areas, f"id long, {edges}"), spark.createDataFrame(items, f"id long, cloud double, {edges}").selectExpr("*", "DATE '2024-01-01' AS day")
    monkeypatch.setattr(regions, "pairs", None)
    got = {(r.area, r.n): r.id for r in catalog.searched(a, b, 20.0, most=3).collect()}
    want = {}
    for i, x0, y0, x1, y1 in areas:
        best = sorted((100.0 if c is None else c, j) for j, c, u0, v0, u1, v1 in items if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1)[:3]
        want |= {(i, n): j for n, (_, j) in enumerate(best, 1)}
    assert got == want
