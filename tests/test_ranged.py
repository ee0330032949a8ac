"""Windows read by byte ranges: the same pixels as whole files give, and only the bytes that are needed."""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import functions as F

from gridwise.sources import geotiff


def stripped(path, w, h, rows, written, bits=16):
    """A sparse file of uncompressed strips; only those in ``written`` are filled."""
    strips, size = -(-h // rows), rows * w * bits // 8
    own = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (bits,)), (259, 3, (1,)), (273, 4, None), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, (size,) * strips), (33550, 12, (10.0, 10.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 400_000.0, 4_000_000.0, 0.0)), (34735, 3, (1, 1, 0, 1, 3072, 0, 1, 32631))]
    first = 8 + 2 + 12 * len(own) + 4 + 8 * strips + 200
    head, tail, at = struct.pack("<2sHIH", b"II", 42, 8, len(own)), b"", 8 + 2 + 12 * len(own) + 4
    for tag, kind, v in own:
        v = tuple(first + k * size for k in range(strips)) if v is None else v
        body = struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *v)
        head += struct.pack("<HHI", tag, kind, len(v)) + (struct.pack("<I", at + len(tail)) if len(body) > 4 else body.ljust(4, b"\0"))
        tail += body if len(body) > 4 else b""
    with open(path, "wb") as f:
        f.write(head + b"\0" * 4 + tail)
        for k, px in written.items():
            f.seek(first + k * size)
            f.write(px.astype("<u2").tobytes())
        f.truncate(first + strips * size)


def test_same_as_whole_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name, x0, w in (("a", 500.0, 5), ("b", 530.0, 9)):
        px = rng.integers(0, 60000, (2, 7, w)).astype(np.uint16)
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(px, x0, 900.0, 10.0, 10.0, 32642, ["B02", "B03"]))
    stripped(tmp_path / "c.tif", 12, 20, 4, {k: rng.integers(1, 999, (4, 12)) for k in range(5)})
    (tmp_path / "bad.tif").write_bytes(b"II*\0nothing")
    boxes = spark.createDataFrame([(1, 520.0, 860.0, 590.0, 890.0), (2, 9000.0, 0.0, 9010.0, 10.0), (3, 400_025.0, 3_999_900.0, 400_071.0, 3_999_955.0), (4, 495.0, 825.0, 512.0, 850.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    files = geotiff.catalog(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.w, r.th, r.per, r.blocks and len(r.blocks)) for r in files.collect()} == {"a.tif": (5, 7, 1, 2), "b.tif": (9, 7, 1, 2), "c.tif": (12, 4, 1, 5), "bad.tif": (None,) * 4}
    cells, uncovered, blocks = geotiff.ranged_windows(files, boxes, 100.0)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(cells) == plain(geotiff.windows(geotiff.read(spark, str(tmp_path)), boxes, 100.0)) and plain(uncovered) == [(2,)]
    assert {(r.path.rsplit("/", 1)[1], r.k) for r in blocks.collect()} == {("a.tif", 0), ("a.tif", 1), ("b.tif", 0), ("b.tif", 1), ("c.tif", 1), ("c.tif", 2)}


def test_small_window_of_a_large_file(spark, tmp_path):
    px = np.random.default_rng(1).integers(1, 60000, (16, 20_000))
    stripped(tmp_path / "large.tif", 20_000, 60_000, 16, {3000: px})
    size = os.path.getsize(tmp_path / "large.tif")
    assert size > 1 << 31
    # Ten pixels by five in the strip that is filled.
    x, y = 400_000.0 + 10 * 12_345, 4_000_000.0 - 10 * (3000 * 16 + 4)
    boxes = spark.createDataFrame([(7, x, y - 50, x + 100, y)], "id long, xmin double, ymin double, xmax double, ymax double")
    cells, _, blocks = geotiff.ranged_windows(geotiff.catalog(spark, str(tmp_path)), boxes, 100_000.0)
    assert {(r.row, r.col): r.value for r in cells.collect()} == {(i, j): px[4 + i, 12_345 + j] for i in range(5) for j in range(10)}
    assert blocks.agg(F.sum("size")).first()[0] == 16 * 20_000 * 2 < size / 3000
    b = geotiff.located(geotiff.catalog(spark, str(tmp_path))).first()
    assert b.lon_min < 2.0 and b.lon_max > 3.5 and 36.0 < b.lat_max < 36.2 and 30.6 < b.lat_min < 30.8
