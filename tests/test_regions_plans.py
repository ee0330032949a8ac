"""Plans of polygon joins: nothing that grows with the input goes through the driver."""

from pyspark.sql import functions as F

from gridwise.operators import overlay, regions
from gridwise.operators.graph import components


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def _squares(spark, n):
    corners = ((0, 0), (6, 0), (6, 6), (0, 6), (0, 0))
    ring = F.array(*(F.struct((F.col("id") * 3 + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y")) for dx, dy in corners))
    return spark.range(n).select("id", F.array(ring).alias("rings"))


def test_polygon_joins_are_merged(spark):
    q = _squares(spark, 40)
    p = spark.range(40).selectExpr("id", "CAST(id * 3 + 1 AS DOUBLE) AS x", "1.0D AS y")
    for df in (regions.crossing(q, q, 10.0), regions.overlaps(q, q, 10.0), regions.points_in(p, q, 10.0), regions.near_points(q, p, 2.0, 10.0), regions.near_polygons(q, q, 2.0, 10.0), regions.marked(q, q, 10.0, "m"), regions.fill(q, q, 10.0)):
        assert _broadcasts(df) == 0


def test_components_and_overlays_are_merged(spark, monkeypatch):
    from gridwise.operators import graph

    seen = []
    for module in (graph, overlay):
        kept = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, kept=kept: seen.append(_broadcasts(df)) or kept(df, name))
    components(spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")).count()
    parts = _squares(spark, 4).select(F.lit(0).alias("group"), F.col("id").alias("part"), "rings")
    assert overlay.union(parts, 10.0).count() == 1
    assert seen and not any(seen)
