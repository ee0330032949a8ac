"""Clipping with completion, rings of ways, draws until a quota is met, and the streaming composite."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridwise.operators import dataset, elements, raster
from gridwise.streaming import streams


def test_clip(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 31)], "id long, x double, y double")
    ways = {10: [2, 3, 20], 11: [21, 22], 12: [23, 24, 99], 13: [5], 14: [28, 29]}
    ways = spark.createDataFrame([(w, p, n) for w, ns in ways.items() for p, n in enumerate(ns)], "way long, pos int, node long")
    members = [(1, "way", 10), (1, "way", 11), (2, "way", 11), (3, "node", 4), (3, "way", 12), (4, "relation", 3), (5, "relation", 4), (5, "way", 14), (6, "way", 14), (1, "way", 77), (3, "node", 88)]
    members = spark.createDataFrame([(r, k, None, i) for r, k, i in members], "relation long, kind string, role string, ref long")
    ids = lambda df: sorted(r[0] for r in df.collect())
    n, w, r = elements.clipped(nodes, ways, members, (2.0, -1.0, 5.0, 1.0))
    # Way 14 comes by relation 5, which is above 4 and 3; relation 2 is touched only by what relation 1 adds, and 6 by what 5 adds.
    assert ids(r) == [1, 3, 4, 5] and ids(w) == [10, 11, 12, 13, 14] and ids(n) == [2, 3, 4, 5, 20, 21, 22, 23, 24, 28, 29]
    n, w, r = elements.clipped(nodes, ways, members, (2.0, -1.0, 5.0, 1.0), spark.createDataFrame([(1,)], "id long"))
    assert ids(r) == [1, 3, 4, 5] and ids(w) == [10, 11, 13] and ids(n) == [2, 3, 4, 5, 20, 21, 22]
    n, w, r = elements.clipped(nodes, ways, members, (100.0, 100.0, 101.0, 101.0))
    assert ids(n) == ids(w) == ids(r) == []


def test_rings(spark):
    nodes = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(20)], "id long, x double, y double")
    ways = {1: [0, 1, 2], 2: [6, 2], 3: [6, 5, 4, 0], 4: [8, 9, 10, 8], 5: [12, 13], 6: [13, 14], 7: [3, 7], 8: [7, 11], 9: [3, 11], 10: [7, 15], 11: [16, 99], 12: [16, 17]}
    ways = spark.createDataFrame([(w, p, n) for w, ns in ways.items() for p, n in enumerate(ns)], "way long, pos int, node long")
    use = [(1, "outer", 1), (1, "outer", 2), (1, "outer", 3), (1, None, 4), (2, "outer", 5), (2, "outer", 6), (3, "outer", 7), (3, "outer", 8), (3, "outer", 9), (3, "outer", 10), (4, "outer", 11), (4, "outer", 12), (4, "outer", 55), (1, "outer", 1)]
    members = spark.createDataFrame([(r, "way", role, w) for r, role, w in use], "relation long, kind string, role string, ref long")
    rings, loose = elements.rings_of(nodes, ways, members)
    got = {(r.relation, r.role, r.ring): [(p.x, p.y) for p in r.points] for r in rings.collect()}
    assert set(got) == {(1, "outer", 1), (1, "", 4)} and got[1, "", 4] in ([(0, 2), (1, 2), (2, 2), (0, 2)], [(1, 2), (2, 2), (0, 2), (1, 2)])
    ring = got[1, "outer", 1]
    assert ring[0] == ring[-1] and len(ring) == 7 and set(ring) == {(x, y) for x in (0, 1, 2) for y in (0, 1)} and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(ring, ring[1:], strict=False))
    assert sorted((r.relation, r.way) for r in loose.collect()) == [(2, 5), (2, 6), (3, 7), (3, 8), (3, 9), (3, 10), (4, 11), (4, 12), (4, 55)]


def test_drawn(spark):
    groups = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0, 20), (2, 0.0, 0.0, 10.0, 10.0, 5), (3, 0.0, 0.0, 100.0, 100.0, 0)], "group long, xmin double, ymin double, xmax double, ymax double, quota int")
    off = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "id long, x double, y double")
    points, state = dataset.drawn(groups, [(off, 15.0)], 200)
    rows = points.collect()
    assert {(r.group, r.got, r.lacking) for r in state.collect()} == {(1, 20, 0), (2, 0, 5), (3, 0, 0)}
    assert len({(r.group, r.k) for r in rows}) == len(rows) == 20 and all(min(r.x**2 + r.y**2, (r.x - 50) ** 2 + (r.y - 50) ** 2) > 225 for r in rows)
    fewer, state = dataset.drawn(groups, [(off, 15.0)], 12)
    left = {r.group: r for r in state.collect()}
    assert sorted((r.k, r.x) for r in fewer.collect()) == sorted((r.k, r.x) for r in rows if r.k < 12) and left[1].got + left[1].lacking == 20 and left[1].lacking >= 8


def test_streaming_composite(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(p, start + timedelta(days=rng.randrange(20), seconds=rng.randrange(86400)), rng.choice([None, rng.randrange(1000)]), rng.random() < 0.8) for p in range(6) for _ in range(60)]
    schema = "pixel int, ts timestamp, value int, ok boolean"
    df = spark.createDataFrame(rows, schema)
    # Two orders: as it comes, and shuffled; lateness covers both. A row far ahead closes all windows.
    end = spark.createDataFrame([(0, start + timedelta(days=400), 1, True)], schema)
    want = None
    for k, order in enumerate((F.col("ts"), F.xxhash64("ts", "value"))):
        source, out = f"file://{tmp_path}/in{k}", f"file://{tmp_path}/out{k}"
        df.orderBy(order).coalesce(1).write.option("maxRecordsPerFile", 40).parquet(source)
        end.write.mode("append").parquet(source)
        s = streams.composite(streams.scenes(spark, source, schema, 3), ["pixel"], 10, late="30 days", clear=F.col("ok"))
        for _ in range(2):
            streams.run_once(s, out, f"file://{tmp_path}/check{k}")
        got = {(r.pixel, r.start): (r.n_days, r.composite) for r in spark.read.parquet(out).collect() if r.start < start + timedelta(days=300)}
        batch = df.withColumn("start", F.window("ts", "10 days")["start"]).withColumn("obs_date", F.to_date("ts"))
        whole = raster.median_composite(batch, ["pixel", "start"], clear=F.col("ok"))
        want = {(r.pixel, r.start): (r.n_days, r.composite) for r in whole.collect() if r.n_days}
        assert got == want and len(want) >= 12


def test_rings_in_rows_match_ranked_ones(spark, monkeypatch):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, float(rng.randrange(50)), float(rng.randrange(50))) for i in range(90)], "id long, x double, y double")
    pos, use = [], []
    for w in range(400):
        # Few nodes for many ways: rings, chains, forks, ways that close on themselves, and nodes that aren't there.
        ns = [rng.randrange(94) for _ in range(rng.randint(1, 4))]
        pos += [(w, k, n) for k, n in enumerate(ns + ns[:1] * (rng.random() < 0.2))]
        use += [(rng.choice([*range(12), None]), rng.choice(["outer", "inner", None]), w) for _ in range(rng.randint(1, 2))]
    for r in range(12, 40):
        m = rng.randint(2, 9)
        for i in range(m):
            a, b = i * 7, (i + 1) % m * 7
            pos += [(r * 100 + i, k, n) for k, n in enumerate((a, b) if rng.random() < 0.5 else (b, a))]
            use += [(r, "outer", r * 100 + i)] if rng.random() < 0.97 else []
    ways = spark.createDataFrame(pos, "way long, pos int, node long")
    members = spark.createDataFrame([(r, "way", role, w) for r, role, w in use], "relation long, kind string, role string, ref long")

    def found():
        rings, loose = elements.rings_of(nodes, ways, members)
        return sorted((r.relation, r.role, r.ring, tuple((p.x, p.y) for p in r.points)) for r in rings.collect()), sorted(map(repr, loose.collect()))

    rows = found()
    ranks = []
    kept = elements.overlay.cycles
    monkeypatch.setattr(elements.overlay, "cycles", lambda way: ranks.append(1) or kept(way))
    assert found() == rows and not ranks and len(rows[0]) > 20 and len(rows[1]) > 20
    monkeypatch.setattr(elements, "FEW", 5)
    assert found() == rows and ranks
    monkeypatch.setattr(elements, "FEW", 0)
    assert found() == rows
