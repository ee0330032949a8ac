"""Radar and optical values, pixel windows, tile shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import geo, grid, scores
from gridwise.operators import raster, shapes
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import PIXELS, ctes, tiles, view

ENTRIES: dict[str, Entry] = {}


@registered(ENTRIES, f"""{ctes("obs")}, v AS (SELECT pixel, CASE WHEN event_id % 5 = 0 THEN -1 ELSE value / 1000 END AS v FROM obs), m AS (SELECT pixel, median(v) FILTER (WHERE v > 0) AS m, count(*) FILTER (WHERE v > 0) AS n FROM v GROUP BY pixel)
SELECT pixel, CASE WHEN m > 0 THEN CAST(least(65535, greatest(1, floor(round((log10(m) * 10 + 50) * 500, 6)))) AS INTEGER) ELSE 0 END AS dn, n FROM m""")
def radar_composite(spark: SparkSession, d: str) -> DataFrame:
    """Median power of each pixel's positive observations, as encoded decibels."""
    o = view(spark, d, "obs").withColumn("value", F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(F.col("value") / 1000))
    return raster.radar_composite(o, ["pixel"]).select("pixel", "dn", "n")


@registered(ENTRIES, f"""{ctes("obs")}, o AS (SELECT DISTINCT obs_date AS day, CAST(day(obs_date) * 10 AS DOUBLE) AS off FROM obs WHERE day(obs_date) % 2 = 0), v AS (SELECT pixel, value + coalesce(off, 1000) AS v FROM obs LEFT JOIN o ON day = obs_date) SELECT pixel, count(v) AS n, round(avg(v), 6) AS mean, min(v) AS least FROM v GROUP BY pixel""")
def day_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Values with their day's offset, 1000 for days without one."""
    o = view(spark, d, "obs").select("pixel", "obs_date", "value")
    off = o.where(F.day("obs_date") % 2 == 0).select(F.col("obs_date").alias("day"), (F.day("obs_date") * 10).cast("double").alias("offset")).distinct()
    return raster.with_offset(o, off).groupBy("pixel").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"))


@registered(ENTRIES, f"""{ctes("obs")}, s AS (SELECT pixel, scl, 10 * log10(avg(value) FILTER (WHERE value > 0)) AS db, count(*) FILTER (WHERE value > 0) AS n FROM obs GROUP BY pixel, scl HAVING count(*) FILTER (WHERE value > 0) >= 4), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY scl) <= 2)
SELECT pixel, round(median(db), 6) AS db, CAST(count(*) AS INTEGER) AS n_scenes, round(1 / (1 + exp(-(median(db) - 20) / CAST(1.5 AS DOUBLE))), 6) AS p FROM t GROUP BY pixel""")
def sampled_power(spark: SparkSession, d: str) -> DataFrame:
    """Mean power of the first two scenes of each pixel that have enough, in decibels; the median of both, and a logistic in it."""
    s = raster.sampled_db(view(spark, d, "obs"), ["pixel"], "scl")
    p = scores.positive_class(F.lit(0.0), (F.col("db") - 20) / 1.5)
    return s.select("pixel", F.round("db", 6).alias("db"), "n_scenes", F.round(p, 6).alias("p"))


@registered(ENTRIES, """WITH b AS (SELECT p_partkey AS id, CAST(p_size * 83 % 4000 AS DOUBLE) AS red, CAST(p_partkey * 37 % 6000 AS DOUBLE) AS nir FROM part) SELECT id, round(CASE WHEN nir + red <> 0 THEN (nir - red) / (nir + red) END, 9) AS plain, round((nir - red) / (nir + red + CAST(1e-6 AS DOUBLE)), 9) AS added, round((nir - red) / greatest(nir + red, CAST(1 AS DOUBLE)), 9) AS one, round((red + nir + 500) / 3, 6) AS bright, round(least(greatest((nir - 1000) / 10000, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)), 9) AS optical, nir / 10000 AS reflectance, round(coalesce(CASE WHEN red > 0 THEN (red / 500 - 50 + 12.5) / CAST(4.25 AS DOUBLE) END, 0), 9) AS z FROM b""")
def band_indices(spark: SparkSession, d: str) -> DataFrame:
    """Vegetation indices with three guards, brightness, reflectances and standardised decibels."""
    from gridwise.plans.domain import table

    b = table(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size * 83 % 4000 AS DOUBLE) AS red", "CAST(p_partkey * 37 % 6000 AS DOUBLE) AS nir")
    red, nir = F.col("red"), F.col("nir")
    return b.select(
        "id", F.round(scores.ndvi(nir, red), 9).alias("plain"), F.round(scores.ndvi(nir, red, "add"), 9).alias("added"), F.round(scores.ndvi(nir, red, "one"), 9).alias("one"), F.round(scores.brightness(red, nir, F.lit(500.0)), 6).alias("bright"),
        F.round(scores.reflectance(nir, 1000.0), 9).alias("optical"), scores.reflectance(nir).alias("reflectance"), F.round(scores.standardised(scores.decode_db(red), -12.5, 4.25), 9).alias("z"),
    )


@registered(ENTRIES, f"""WITH {PIXELS}, q AS (SELECT id, id * 64 + k AS point_id, k // 8 AS r, k % 8 AS c FROM px WHERE p = 1) SELECT point_id, count(*) AS n, round(avg(b.p), 6) AS mean, max(b.p) AS most, min(b.p) AS least FROM q JOIN px b ON q.id = b.id AND abs(b.k // 8 - r) <= 1 AND abs(b.k % 8 - c) <= 1 GROUP BY point_id""")
def pixel_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean, maximum and minimum of the 3 x 3 pixels around the brightest ones."""
    px = raster.pixels(tiles(spark, d))
    points = px.where("p = 1").select((F.col("id") * 64 + F.col("row") * 8 + F.col("col")).alias("point_id"), "id", "row", "col")
    return raster.around(points, px, 1).select("point_id", "n", F.round("mean", 6).alias("mean"), "most", "least")


@registered(ENTRIES, f"""WITH {PIXELS} SELECT id, 0::BIGINT AS r, 'turned' AS kind, round(sum(p * (8 * (7 - k % 8) + k // 8 + 1)), 6) AS v FROM px GROUP BY id UNION ALL SELECT id, 0, 'mirrored', round(sum(p * (8 * (k // 8) + 7 - k % 8 + 1)), 6) FROM px GROUP BY id
UNION ALL SELECT id, 0, 'cut', round(sum(p * (4 * (k // 8 - 2) + k % 8 - 2 + 1)), 6) FROM px WHERE k // 8 BETWEEN 2 AND 5 AND k % 8 BETWEEN 2 AND 5 GROUP BY id UNION ALL SELECT id, 0, 'filled', round(sum(p * (12 * (k // 8) + k % 8 + 1)), 6) FROM px GROUP BY id""")
def tile_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Tiles turned by a quarter, mirrored, cut and filled up: each pixel times its place, summed up."""
    t = raster.spread(tiles(spark, d))
    made = {"turned": raster.turned(t, 1), "mirrored": raster.turned(t, 0, True), "cut": raster.fitted(t, 4), "filled": raster.fitted(t, 12)}
    place = F.aggregate(F.transform("px", lambda p, i: p * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    out = None
    for kind, df in made.items():
        one = df.select("id", F.lit(0).cast("long").alias("r"), F.lit(kind).alias("kind"), F.round(place, 6).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@registered(ENTRIES, f"""WITH RECURSIVE {PIXELS}, g AS (SELECT * FROM px WHERE p >= 0.6), e AS (SELECT a.id, a.k AS a, b.k AS b FROM g a JOIN g b ON a.id = b.id AND abs(a.k // 8 - b.k // 8) + abs(a.k % 8 - b.k % 8) = 1), r(id, k, root) AS (SELECT id, k, k FROM g UNION SELECT r.id, e.b, r.root FROM r JOIN e ON e.id = r.id AND e.a = r.k), l AS (SELECT id, k, min(root) AS label FROM r GROUP BY id, k), n AS (SELECT l.id, l.k, count(e.b) AS n FROM l LEFT JOIN e ON e.id = l.id AND e.a = l.k GROUP BY l.id, l.k)
SELECT l.id, CAST(l.label AS INTEGER) AS label, count(*) AS n_pixels, CAST(count(*) * 100 AS DOUBLE) AS area_m2, CAST(sum(4 - n) * 10 AS DOUBLE) AS outline_m FROM l JOIN n ON n.id = l.id AND n.k = l.k GROUP BY l.id, l.label""")
def component_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Regions of bright pixels as polygons on a grid of 10 m: their area less holes and the length of all rings."""
    from gridwise.functions import polygon

    p = shapes.polygons(raster.hysteresis_pixels(raster.spread(tiles(spark, d)), 0.6), ["id", "label"], 10.0)
    around = F.aggregate(F.transform("rings", geo.line_length), F.lit(0.0), lambda s, v: s + v)
    return p.select("id", "label", "n_pixels", polygon.area(F.col("rings")).alias("area_m2"), around.alias("outline_m"))


@registered(ENTRIES, f"""{ctes("obs", "cand")}, d AS (SELECT event_id, CAST(ts + to_seconds(CAST(floor((60 + event_id % 17) * 240) AS BIGINT)) AS DATE) AS day FROM obs) SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM d GROUP BY day""")
def solar_days(spark: SparkSession, d: str) -> DataFrame:
    """Observations by the date at their place's solar time."""
    o = view(spark, d, "obs").select(scores.solar_day(F.col("ts"), (60 + F.col("event_id") % 17).cast("double")).cast("string").alias("day"))
    return o.groupBy("day").agg(F.count("*").alias("n"))


@registered(ENTRIES, f"""{ctes("lead_boxes")}, m AS (SELECT *, greatest(xmax - xmin, ymax - ymin) * CAST(0.5 AS DOUBLE) + CAST(0.0015 AS DOUBLE) AS m FROM lead_boxes) SELECT id, xmin - m AS xmin, ymin - m AS ymin, xmax + m AS xmax, ymax + m AS ymax FROM m""")
def window_boxes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "lead_boxes").select("id", *grid.window_box(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))
