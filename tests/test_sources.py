"""Reading and writing, and the streaming forms."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from gridwise.sources import files, geojson, geotiff
from gridwise.streaming import streams


def test_feature_lines(spark, tmp_path):
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"id":7,"kind":"a"}}'
    line = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"id":8}}'
    (tmp_path / "f.txt").write_text("\n".join(["\x1e" + point, "", point[:30], line, "nonsense"]), encoding="utf-8")
    got = geojson.read_lines(spark, str(tmp_path / "f.txt"), "id long, kind string").orderBy("properties.id").collect()
    assert [(r.geometry_type, r.lon, r.lat, r.properties.id) for r in got] == [("Point", 1.5, 2.5, 7), ("LineString", None, None, 8)]
    (tmp_path / "c.json").write_text(f'{{"type":"FeatureCollection","features":[{point},{line}]}}')
    assert geojson.read_collections(spark, str(tmp_path / "c.json"), "id long").count() == 2


def test_wkb(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 0.0)]
    polygon = struct.pack("<BIII8d", 1, 3, 1, 4, *(v for p in ring for v in p))
    many = struct.pack(">BII", 0, 6, 1) + polygon
    assert files.from_wkb(polygon)["parts"] == [[{"x": x, "y": y} for x, y in ring]]
    assert files.from_wkb(many)["kind"] == "MultiPolygon"
    assert files.from_wkb(polygon[:20]) is None and files.from_wkb(None) is None and files.from_wkb(b"\x01\x63\0\0\0") is None
    spark.createDataFrame([(1, polygon)], "id long, geometry binary").write.parquet(str(tmp_path / "g"))
    r = files.read_geoparquet(spark, str(tmp_path / "g")).first()
    assert (r.xmin, r.ymin, r.xmax, r.ymax) == (0.0, 0.0, 4.0, 2.0)


def test_box_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "named_struct('xmin', id * 1.0D, 'xmax', id + 0.5D, 'ymin', 0.0D, 'ymax', 1.0D) AS bbox").write.parquet(str(tmp_path / "b"))
    df = files.in_box(spark.read.parquet(str(tmp_path / "b")), (2.2, 0.0, 4.1, 1.0))
    assert [r.id for r in df.orderBy("id").collect()] == [2, 3, 4]
    assert "PushedFilters: [IsNotNull(bbox.xmin)" in df._jdf.queryExecution().toString()


def test_stacks(spark, tmp_path):
    a = np.arange(24, dtype=float).reshape(3, 2, 2, 2)
    np.savez(tmp_path / "24.5_67.25.npz", image=a)
    np.savez(tmp_path / "other.npz", image=a)
    (tmp_path / "1_2.npz").write_bytes(b"broken")
    s = files.read_stacks(spark, str(tmp_path))
    r = files.median_of_revisits(s).collect()
    assert [(x.lat, x.lon, x["shape"], x.px) for x in r] == [(24.5, 67.25, [2, 2, 2], np.median(a, axis=0).ravel().tolist())]


def test_elements_and_fallback(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"elements":[{"id":1,"type":"node","lat":1.0,"lon":2.0,"tags":{"power":"tower"}},{"id":2,"type":"way","center":{"lat":3.0,"lon":4.0},"geometry":[{"lat":0,"lon":0},{"lat":1,"lon":1}]}]}')
    got = files.elements(spark, str(tmp_path / "a.json")).orderBy("id").collect()
    assert [(r.id, r.lon, r.lat, len(r.line)) for r in got] == [(1, 2.0, 1.0, 0), (2, 4.0, 3.0, 2)]
    a, b = spark.createDataFrame([(1, "p")], "k int, v string"), spark.createDataFrame([(1, "f"), (2, "f")], "k int, v string")
    assert sorted(map(tuple, files.coalesced(a, b, "k").collect())) == [(1, "p"), (2, "f")]
    pages = spark.createDataFrame([(i, 0.1, 0.1, t) for t, i in enumerate((1, 1, 2))], "id int, lon double, lat double, page int")
    points, full = files.staged_pages(pages, "id", "page", 2.0, 3)
    assert sorted((r.id, r.page) for r in points.collect()) == [(1, 0), (2, 2)] and full.first().n == 3


def test_streams(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id long, ts timestamp, value double"
    spark.sql("SELECT id, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, id * 12) AS ts, CAST(id AS DOUBLE) AS value FROM range(12)").coalesce(1).write.parquet(src)
    d = streams.daily(streams.scenes(spark, src, schema).withColumn("cell", F.lit(1)), ["cell"])
    streams.run_once(d, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("day").collect()
    assert [(r.n, r["mean"]) for r in got][:2] == [(2, 0.5), (2, 2.5)]
    before = spark.read.parquet(str(tmp_path / "out")).count()
    streams.run_once(d, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == before
    twice = streams.scenes(spark, src, schema).withColumn("k", F.col("id") % 3)
    streams.run_once(streams.distinct_issues(twice, "k", late="30 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 3


def test_outages_and_daily_medians(spark, tmp_path):
    calls = spark.sql("SELECT 'a' AS provider, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 100) AS ts, id IN (0, 4, 6) AS ok FROM range(10)")
    got = streams.outages(calls).orderBy("start").collect()
    assert [(r.provider, r.n, r.start.minute, r.end.minute) for r in got] == [("a", 3, 1, 5), ("a", 3, 11, 15)]
    src = str(tmp_path / "in")
    spark.sql("SELECT id, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, id * 6) AS ts, CAST(id * id AS DOUBLE) AS value, 1 AS cell FROM range(8)").coalesce(1).write.parquet(src)
    streams.run_once(streams.scenes(spark, src, "id long, ts timestamp, value double, cell int"), str(tmp_path / "out"), str(tmp_path / "cp"))
    m = streams.daily_median(spark, str(tmp_path / "out"), ["cell"]).orderBy("day").collect()
    assert [(r.n, r["median"]) for r in m] == [(4, 2.5), (4, 30.5)]


def test_polygon_features_and_collections(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 1.5}, {"x": 0.0, "y": 0.0}]
    df = spark.createDataFrame([(i, [ring], "k") for i in range(5)], "id long, rings array<array<struct<x: double, y: double>>>, kind string")
    geojson.write_lines(df, str(tmp_path / "l"), ["kind"], rings="rings", key="id")
    back = geojson.read_lines(spark, str(tmp_path / "l"), "kind string")
    assert [[[p.asDict() for p in r] for r in x.rings] for x in back.select(geojson.rings_of(F.col("coordinates")).alias("rings")).collect()] == [[ring]] * 5
    geojson.write_collection(df.repartition(2), str(tmp_path / "c"), ["kind"], rings="rings")
    import json

    texts = [p.read_text() for p in (tmp_path / "c").glob("part*") if p.stat().st_size]
    assert sum(len(json.loads(t)["features"]) for t in texts) == 5 and json.loads(texts[0])["type"] == "FeatureCollection"
    assert geojson.read_collections(spark, str(tmp_path / "c"), "kind string").count() == 5


def test_geoparquet_is_read_back(spark, tmp_path):
    rows = [(1, "pos", ("Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 0.0)], [(1.0, 0.2), (2.0, 0.2), (2.0, 0.4), (1.0, 0.2)]])), (2, "node", ("Point", [[(3.0, 5.0)]])), (3, "line", ("LineString", [[(0.0, 1.0), (2.0, 3.0)]]))]
    df = spark.createDataFrame(rows, f"id long, role string, geometry {files.SHAPE}")
    files.write_geoparquet(df, str(tmp_path / "g"), by="role")
    got = {r.id: r for r in files.read_geoparquet(spark, str(tmp_path / "g")).collect()}
    assert {k: (r.role, r.geometry.kind, [[tuple(p) for p in part] for part in r.geometry.parts]) for k, r in got.items()} == {k: (role, *shape) for k, role, shape in rows}
    assert got[2].bbox.xmin == got[2].xmin == 3.0 and (tmp_path / "g" / "role=pos").exists()


def test_tables_tags_and_bad_archives(spark, tmp_path):
    (tmp_path / "t.csv").write_text("run_name,region,n\na,x,1\nb,y,oops\n")
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t.csv"), "run_name string, region string, n int").orderBy("run_name").collect()] == [("a", "x", 1), ("b", "y", None)]
    f = spark.createDataFrame([(1, "way", "substation", None), (2, "node", "substation", None), (3, "way", "line", None), (4, "node", None, "village"), (5, "node", None, None)], "id long, kind string, power string, place string")
    layers = {"poly": ["way:power=substation"], "node": ["node:power=substation"], "lines": ["way:power=line"], "settlement": ["place=village", "place=hamlet"]}
    assert [(r.id, r.layer) for r in files.tagged(f, layers).orderBy("id").collect()] == [(1, "poly"), (2, "node"), (3, "lines"), (4, "settlement")]
    log = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, v string")
    for rows in (log, log, spark.createDataFrame([(2, "late"), (3, "c")], "idx long, v string")):
        files.append_new(rows, str(tmp_path / "log"), "idx")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    np.savez(tmp_path / "1.0_2.0.npz", image=np.zeros((1, 1, 1, 1)))
    (tmp_path / "1_2.npz").write_bytes(b"broken")
    assert [r.path.rsplit("/", 1)[1] for r in files.unreadable(spark, str(tmp_path)).collect()] == ["1_2.npz"]


def test_geotiff(spark, tmp_path):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 60000, (2, 7, 5)).astype(np.uint16), rng.integers(1, 60000, (2, 7, 5)).astype(np.uint16)
    b[:, 2, 2] = 0
    for name, px, x0 in (("a", a, 500.0), ("b", b, 530.0)):
        data = geotiff.encode(px, x0, 900.0, 10.0, 10.0, 32642, ["B02", "B03"])
        assert (geotiff.bands(data) == px).all()
        (tmp_path / f"{name}.tif").write_bytes(data)
    (tmp_path / "bad.tif").write_bytes(b"II*\0nothing")
    read = geotiff.read(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert got["bad.tif"].w is None and (got["a.tif"].bands, got["a.tif"].h, got["a.tif"].w, got["a.tif"].epsg, got["a.tif"].x0, got["a.tif"].dy) == (2, 7, 5, 32642, 500.0, -10.0)
    assert got["a.tif"].px == a.ravel().tolist()
    # A window over both, beyond their right edge; where they overlap the first by name counts.
    boxes = spark.createDataFrame([(1, 520.0, 860.0, 590.0, 890.0), (2, 9000.0, 0.0, 9010.0, 10.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    whole = np.zeros((2, 7, 12))
    whole[:, :, 3:8] = b
    whole[:, :, :5] = a
    w = geotiff.windows(read, boxes, 100.0).collect()
    assert {(r.band, r.row, r.col): r.value for r in w} == {(k, i, j): whole[k, 1 + i, 2 + j] for k in range(2) for i in range(3) for j in range(7)} and {r.id for r in w} == {1}
    tile = spark.createDataFrame([(2, 7, 5, 32642, 500.0, 900.0, 10.0, -10.0, a.ravel().astype(int).tolist())], "bands int, h int, w int, epsg int, x0 double, y0 double, dx double, dy double, px array<int>")
    assert (geotiff.bands(bytes(tile.select(geotiff.encoded(tile, ["x", "y"]).alias("f")).first().f)) == a).all()


def test_geotiff_in_tiles():
    import struct
    import zlib

    px = np.arange(40 * 33, dtype=np.float32).reshape(40, 33)
    blocks = []
    for r in range(0, 40, 16):
        for c in range(0, 33, 16):
            t = np.zeros((16, 16), ">f4")
            part = px[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(t.tobytes()))
    own = [(256, 3, (33,)), (257, 3, (40,)), (258, 3, (32,)), (259, 3, (8,)), (322, 3, (16,)), (323, 3, (16,)), (324, 4, None), (325, 4, tuple(map(len, blocks))), (339, 3, (3,))]
    at = 8 + 2 + 12 * len(own) + 4
    first = at + 2 * 4 * len(blocks)
    places = [first + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    head, tail = struct.pack(">2sHIH", b"MM", 42, 8, len(own)), b""
    for tag, kind, v in own:
        v = tuple(places) if v is None else v
        body = struct.pack(f">{len(v)}{'H' if kind == 3 else 'I'}", *v)
        head += struct.pack(">HHI", tag, kind, len(v)) + (struct.pack(">I", at + len(tail)) if len(body) > 4 else body.ljust(4, b"\0"))
        tail += body if len(body) > 4 else b""
    assert (geotiff.bands(head + b"\0" * 4 + tail + b"".join(blocks))[0] == px).all()
