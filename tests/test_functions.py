"""Expressions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwise.functions import geo, grid, scores


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not hasattr(v, "_jc") else v)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("220000", 220000), ("132000;66000", 132000), ("66 kV", 66), ("abc", None), (None, None)])
def test_voltage(spark, text, want):
    assert one(spark, grid.voltage(F.lit(text).cast("string"))) == want


def test_projection(spark):
    assert one(spark, F.round(geo.equal_area_x(F.lit(67.0)), 3)) == 6464580.777
    assert one(spark, F.round(geo.equal_area_y(F.lit(24.0)), 3)) == 2975202.525
    assert one(spark, F.round(geo.equal_area_lat(geo.equal_area_y(F.lit(51.7))), 8)) == 51.7
    assert [one(spark, geo.utm_epsg(F.lit(a), F.lit(b))) for a, b in ((67.0, 24.9), (13.4, 52.5), (151.2, -33.87))] == [32642, 32633, 32756]


def test_cells_and_chips(spark):
    assert one(spark, F.round(grid.snap_origin(F.lit(60.87), 69.3405158324398), 10)) == 60.8405158324
    assert one(spark, grid.cell_name(F.lit(37), F.lit(36))) == "0037_0036"
    assert one(spark, grid.chip_id(F.lit(67.0), F.lit(24.9))) == "d2a926c20ccf"
    box = (67.0, 24.0, 69.5, 26.5)
    assert [one(spark, grid.split(F.lit(a), F.lit(b), box)) for a, b in ((67.0, 24.0), (66.999, 24.5))] == ["val", "train"]


def test_role(spark):
    args = [(25000, None, None, False), (19999, None, None, False), (30000, "village", None, False), (30000, "refined", None, True)]
    got = [one(spark, grid.role(F.lit(a), F.lit(s).cast("string"), F.lit(v).cast("double"), 20000, only)) for a, s, v, only in args]
    assert got == ["pos", "small", "small", "small"]


def test_scores(spark):
    d = lambda v: F.lit(v).cast("double")
    assert [one(spark, scores.line_rank(d(c), d(x))) for c, x in ((0.9, 2000), (0.9, -1), (None, 5))] == [0.6155, 0.45, 0.0]
    assert one(spark, scores.regional_rank(d(0.5), d(1000), d(250))) == 0.1839
    assert [round(one(spark, scores.metal(d(v))), 4) for v in (-13.6, -11.4, None)] == [0.5, 0.8126, 0.5]
    assert [one(spark, scores.isolated(F.lit(n))) for n in (0, 2, 4, 9)] == [0.75, 0.875, 1.0, 1.0]
    assert round(one(spark, scores.penalised(d(0.8), F.lit(True), F.lit(True))), 6) == 0.072
    assert [one(spark, scores.encode_db(d(p))) for p in (0.1, 0.0, 1e-12)] == [20000, 0, 1]
    f = scores.fusions(d(0.8), d(0.6))
    assert {k: round(one(spark, c), 4) for k, c in f.items()} == {"first": 0.8, "second": 0.6, "gated": 0.64, "mean": 0.7, "max": 0.8, "geometric": 0.6928}
    assert {k: one(spark, c) for k, c in scores.fusions(d(0.8), d(None)).items()} == {"second": None} | dict.fromkeys(("first", "gated", "mean", "max", "geometric"), 0.8)


def test_shapes(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(p(0, 0), p(4, 0), p(4, 2), p(0, 2), p(0, 0))
    assert one(spark, geo.ring_area(ring)) == 8
    assert tuple(one(spark, geo.ring_centroid(ring))) == (2.0, 1.0)
    assert [one(spark, geo.in_ring(F.lit(x), F.lit(1.0), ring)) for x in (1.0, 5.0)] == [True, False]
    assert one(spark, geo.line_length(F.array(p(0, 0), p(3, 4), p(3, 10)))) == 11
    assert one(spark, geo.segment_distance(*map(F.lit, (5.0, 3.0, 0.0, 0.0, 10.0, 0.0)))) == 3
    assert len(one(spark, geo.densify(*map(F.lit, (0.0, 0.0, 7000.0, 0.0)), 3000.0))) == 4
    assert [one(spark, geo.bearing_bin(F.lit(x), F.lit(y))) for x, y in ((1.0, 0.0), (0.0, 1.0), (-1.0, 1.0))] == [0, 3, 4]
