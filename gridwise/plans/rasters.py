"""Pixel stacks and raster tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import geo, polygon, scores
from gridwise.operators import raster, shapes
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import PIXELS, ctes, table, tiles, view

ENTRIES: dict[str, Entry] = {}


@registered(ENTRIES, f"""{ctes("obs")}, g AS (SELECT pixel, obs_date, value, row_number() OVER (PARTITION BY pixel, obs_date ORDER BY ts, value) AS n FROM obs WHERE scl IN (4, 5, 6, 7) AND value IS NOT NULL), p AS (SELECT DISTINCT pixel FROM obs)
SELECT p.pixel, CAST(coalesce(floor(median(g.value)), 0) AS INTEGER) AS composite, count(g.value) AS n_days FROM p LEFT JOIN g ON p.pixel = g.pixel AND g.n = 1 GROUP BY p.pixel""")
def masked_median_composite(spark: SparkSession, d: str) -> DataFrame:
    return raster.median_composite(view(spark, d, "obs"), ["pixel"], clear=F.col("scl").isin(*raster.CLEAR))


@registered(ENTRIES, f"""{ctes("obs")}, g AS (SELECT pixel, obs_date, value, row_number() OVER (PARTITION BY pixel, obs_date ORDER BY ts, value) AS n FROM obs) SELECT pixel, CAST(floor(median(value)) AS INTEGER) AS composite, count(*) AS n_days FROM g WHERE n = 1 GROUP BY pixel""")
def daily_collapse_median(spark: SparkSession, d: str) -> DataFrame:
    return raster.median_composite(view(spark, d, "obs"), ["pixel"])


@registered(ENTRIES, f"""{ctes("obs")}, e AS (SELECT event_id, CASE WHEN value > 0 THEN CAST(least(65535, greatest(1, floor(round((log10(value) * 10 + 50) * 500, 6)))) AS INTEGER) ELSE 0 END AS dn FROM obs) SELECT event_id, dn, CASE WHEN dn > 0 THEN round(dn / CAST(500 AS DOUBLE) - 50, 4) END AS db FROM e""")
def db_encode_decode(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "obs").select("event_id", scores.encode_db(F.col("value")).alias("dn"))
    return e.select("event_id", "dn", F.round(scores.decode_db(F.col("dn")), 4).alias("db"))


# A mirrored index that counts edge pixels twice, and the 5 x 5 pixels around each pixel.
_MIRROR = "CASE WHEN {0} < 0 THEN -{0} - 1 WHEN {0} > 7 THEN 15 - {0} ELSE {0} END"


@registered(ENTRIES, f"""WITH {PIXELS}, o AS (SELECT a.x AS dy, b.x AS dx FROM (SELECT unnest(range(-2, 3)) AS x) a, (SELECT unnest(range(-2, 3)) AS x) b), n AS (SELECT id, k, p, k // 8 + dy AS r, k % 8 + dx AS c FROM px, o), m AS (SELECT n.id, n.k, n.p, q.p AS around FROM n JOIN px q ON q.id = n.id AND q.k = ({_MIRROR.format("n.r")}) * 8 + ({_MIRROR.format("n.c")}))
SELECT id, CAST(k // 8 AS INTEGER) AS row, CAST(k % 8 AS INTEGER) AS col, round(CASE WHEN p = 0 OR avg((around <> 0)::INT) <= CAST(0.3 AS DOUBLE) THEN -99 ELSE p - avg(CASE WHEN around <> 0 THEN around END) END, 7) + 0.0::DOUBLE AS contrast FROM m GROUP BY id, k, p""")
def focal_contrast_8x8(spark: SparkSession, d: str) -> DataFrame:
    c = raster.contrast(tiles(spark, d), 5)
    return raster.pixels(c.withColumn("px", F.col("contrast"))).select("id", "row", "col", (F.round("p", 7) + 0.0).alias("contrast"))


@registered(ENTRIES, f"""WITH {PIXELS} SELECT a.id, CAST(a.k // 8 AS INTEGER) AS row, CAST(a.k % 8 AS INTEGER) AS col, a.p FROM px a JOIN px b ON a.id = b.id AND abs(a.k // 8 - b.k // 8) <= 1 AND abs(a.k % 8 - b.k % 8) <= 1 WHERE a.p >= 0.7 GROUP BY a.id, a.k, a.p HAVING max(b.p) <= a.p""")
def local_maxima_8x8(spark: SparkSession, d: str) -> DataFrame:
    return raster.local_maxima(tiles(spark, d), 0.7)


def _components(diagonal: bool) -> str:
    near = "abs(a.k // 8 - b.k // 8) <= 1 AND abs(a.k % 8 - b.k % 8) <= 1" if diagonal else "abs(a.k // 8 - b.k // 8) + abs(a.k % 8 - b.k % 8) = 1"
    return f"""WITH RECURSIVE {PIXELS}, g AS (SELECT * FROM px WHERE p >= 0.6), e AS (SELECT a.id, a.k AS a, b.k AS b FROM g a JOIN g b ON a.id = b.id AND a.k <> b.k AND {near}),
r(id, k, root) AS (SELECT id, k, k FROM g UNION SELECT r.id, e.b, r.root FROM r JOIN e ON e.id = r.id AND e.a = r.k),
l AS (SELECT id, k, min(root) AS label FROM r GROUP BY id, k), c AS (SELECT l.id, l.label, g.p FROM l JOIN g USING (id, k)),
q AS (SELECT id, label, count(*) AS n, max(p) AS m, avg(p) AS a, quantile_cont(p, 0.9) AS q FROM c GROUP BY id, label HAVING max(p) >= 0.9)
SELECT q.id, CAST(q.label AS INTEGER) AS label, any_value(n) AS n_pixels, any_value(m) AS conf_max, round(any_value(a), 10) AS conf_mean, round(avg(c.p), 10) AS conf_p90 FROM q JOIN c ON q.id = c.id AND q.label = c.label AND c.p >= q.q GROUP BY q.id, q.label"""


@registered(ENTRIES, _components(False))
def hysteresis_components_8x8(spark: SparkSession, d: str) -> DataFrame:
    c = raster.hysteresis(tiles(spark, d), 0.6, 0.9)
    return c.withColumn("conf_mean", F.round("conf_mean", 10)).withColumn("conf_p90", F.round("conf_p90", 10))


@registered(ENTRIES, _components(True))
def component_stats_p90(spark: SparkSession, d: str) -> DataFrame:
    """The same with pixels that touch at corners."""
    c = raster.hysteresis(tiles(spark, d), 0.6, 0.9, diagonal=True)
    return c.withColumn("conf_mean", F.round("conf_mean", 10)).withColumn("conf_p90", F.round("conf_p90", 10))


# Pixels of the mosaic of all tiles, 100 to a row, and their components by a walk; the component's name is its least tile number and pixel.
_MOSAIC = f"""WITH RECURSIVE {PIXELS}, m AS (SELECT (id % 100) * 8 + k % 8 AS x, (id // 100) * 8 + k // 8 AS y, id * 64 + k AS n, p FROM px WHERE p >= 0.7),
e AS (SELECT a.n AS a, b.n AS b FROM m a JOIN m b ON b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.n, b.n FROM m a JOIN m b ON b.x = a.x AND b.y = a.y + 1), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(n, root) AS (SELECT n, n FROM m UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.n WHERE e2.b > r.root), l AS (SELECT n, min(root) AS component FROM r GROUP BY n), c AS (SELECT * FROM m JOIN l USING (n)),
q AS (SELECT component, quantile_cont(p, 0.9) AS q, max(p) AS most FROM c GROUP BY component),
s AS (SELECT c.component, count(*) AS n_pixels, max(p) AS conf_max, round(avg(p), 10) AS conf_mean, round(avg(p) FILTER (WHERE p >= q), 10) AS conf_p90 FROM c JOIN q USING (component) WHERE most >= 0.9 GROUP BY c.component)"""


def _mosaic(spark: SparkSession, d: str) -> DataFrame:
    return tiles(spark, d).withColumn("tx", F.col("id") % 100).withColumn("ty", F.floor(F.col("id") / 100))


@registered(ENTRIES, f"{_MOSAIC} SELECT * FROM s")
def mosaic_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over the mosaic of all tiles, 100 to a row. The tests hold it against one flood fill over the mosaic."""
    c = raster.mosaic_components(_mosaic(spark, d), 0.7, 0.9)
    return c.withColumn("conf_mean", F.round("conf_mean", 10)).withColumn("conf_p90", F.round("conf_p90", 10))


@registered(ENTRIES, f"""{_MOSAIC}, o AS (SELECT a.component, count(*) AS n FROM c a JOIN c b ON b.component = a.component AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.component),
f AS (SELECT a.component, count(*) AS n FROM c a JOIN c b ON b.component = a.component AND b.x = a.x + 1 AND b.y = a.y JOIN c d ON d.component = a.component AND d.x = a.x AND d.y = a.y + 1 JOIN c g ON g.component = a.component AND g.x = a.x + 1 AND g.y = a.y + 1 GROUP BY a.component)
SELECT s.component, n_pixels, conf_max, CAST(n_pixels AS DOUBLE) AS area, CAST(4 * n_pixels - coalesce(o.n, 0) AS DOUBLE) AS outline, 1 - (n_pixels - coalesce(o.n, 0) // 2 + coalesce(f.n, 0)) AS n_holes FROM s LEFT JOIN o USING (component) LEFT JOIN f USING (component)""")
def mosaic_polygons(spark: SparkSession, d: str) -> DataFrame:
    """The same components as polygons: their area, the length of their outline and their holes follow from the pixels too."""
    c = shapes.mosaic_polygons(_mosaic(spark, d), 0.7, 0.9)
    outline = F.aggregate(F.transform("rings", geo.line_length), F.lit(0.0), lambda s, n: s + n)
    return c.select("component", "n_pixels", "conf_max", polygon.area(F.col("rings")).alias("area"), outline.alias("outline"), (F.size("rings") - 1).cast("long").alias("n_holes"))


# A target grid turned against the mosaic: where a target pixel's centre lies in it.
_ON_MOSAIC = f"""WITH {PIXELS}, m AS (SELECT (id % 100) * 8 + k % 8 AS sx, (id // 100) * 8 + k // 8 AS sy, p FROM px),
b AS (SELECT DISTINCT id % 20 + 100 * (id // 100) AS block, (id % 20) * 40 AS x0, (id // 100) * 8 AS y0 FROM px), t AS (SELECT block, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, x0 + (col + CAST(0.5 AS DOUBLE)) * 2 AS u, y0 + (row + CAST(0.5 AS DOUBLE)) * 2 AS v FROM b, range(0, 4) r(row), range(0, 20) c(col)),
w AS (SELECT block, row, col, CAST(0.96 AS DOUBLE) * u - CAST(0.28 AS DOUBLE) * v + 3 AS x, CAST(0.28 AS DOUBLE) * u + CAST(0.96 AS DOUBLE) * v - 40 AS y FROM t)"""


def _warped(spark: SparkSession, d: str, how: str) -> DataFrame:
    t = _mosaic(spark, d)
    grid = t.selectExpr("id % 20 + 100 * (id DIV 100) AS block", "CAST((id % 20) * 40 AS DOUBLE) AS x0", "CAST((id DIV 100) * 8 AS DOUBLE) AS y0", "2.0D AS step", "4 AS h", "20 AS w").distinct()
    return raster.warped(t, grid, lambda x, y: (0.96 * x - 0.28 * y + 3, 0.28 * x + 0.96 * y - 40), (8, 8), how).withColumn("value", F.round("value", 6))


@registered(ENTRIES, f"""{_ON_MOSAIC} SELECT block, row, col, coalesce(p, 0) AS value FROM w LEFT JOIN m ON sx = floor(x) AND sy = floor(y)""")
def warp_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The mosaic of all tiles on a grid of twice the pixel size that is turned against it, by the nearest pixel."""
    return _warped(spark, d, "nearest")


@registered(ENTRIES, f"""{_ON_MOSAIC}, f AS (SELECT block, row, col, x - CAST(0.5 AS DOUBLE) AS fx, y - CAST(0.5 AS DOUBLE) AS fy FROM w), n AS (SELECT block, row, col, floor(fx) + dx AS nx, floor(fy) + dy AS ny, CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END AS wt FROM f, range(0, 2) a(dx), range(0, 2) b(dy))
SELECT block, row, col, round(coalesce(sum(p * wt) FILTER (WHERE p <> 0) / sum(wt) FILTER (WHERE p <> 0), 0), 6) AS value FROM n LEFT JOIN m ON sx = nx AND sy = ny GROUP BY block, row, col""")
def warp_to_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same between the four nearest pixels."""
    return _warped(spark, d, "bilinear")


_HANN = "(1 - cos({0} * (2 * pi() / 7))) / 2"


@registered(ENTRIES, f"""WITH {PIXELS}, w AS (SELECT id // 2 AS pair, k // 8 AS r, k % 8 AS c, CAST(k // 8 + (id % 2) * 4 AS INTEGER) AS row, CAST(k % 8 AS INTEGER) AS col, p FROM px), x AS (SELECT pair, row, col, p, {_HANN.format("r")} * {_HANN.format("c")} + CAST(0.001 AS DOUBLE) AS wt FROM w)
SELECT pair, row, col, round(sum(p * wt) / sum(wt), 6) AS p FROM x GROUP BY ALL""")
def hann_overlap_add(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tiles as windows that overlap by half."""
    px = raster.pixels(tiles(spark, d))
    w = px.select(F.floor(F.col("id") / 2).alias("pair"), ((F.col("id") % 2) * 4).cast("int").alias("row0"), F.lit(0).alias("col0"), "row", "col", "p")
    return raster.overlap_add(w, 8, ["pair"]).withColumn("p", F.round("p", 6))


@registered(ENTRIES, """WITH s AS (SELECT DISTINCT CAST(p_size * 37 + 100 AS INTEGER) AS size FROM part), w AS (SELECT size, unnest(range(0, greatest(size - 224, 0) + 1, 104)) AS start FROM s UNION SELECT size, greatest(size - 224, 0) FROM s) SELECT size, CAST(start AS INTEGER) AS start FROM w""")
def window_plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select((F.col("p_size") * 37 + 100).cast("int").alias("size")).distinct()
    return s.select("size", F.explode(raster.window_starts(F.col("size"), 224, 104)).alias("start"))


@registered(ENTRIES, f"""WITH {PIXELS}, z AS (SELECT p.id, label, k, p FROM px p JOIN (SELECT vec_id AS id, label FROM embeddings) e USING (id) WHERE k // 8 BETWEEN 2 AND 5 AND k % 8 BETWEEN 1 AND 6) SELECT label, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std FROM z GROUP BY label""")
def zonal_mean_std(spark: SparkSession, d: str) -> DataFrame:
    px = raster.pixels(tiles(spark, d)).where("row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 6")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "label")
    z = raster.zonal(px.join(labels, F.col("id") == F.col("v")), ["label"])
    return z.select("label", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@registered(ENTRIES, f"""{ctes("obs")}, c AS (SELECT pixel, value, event_id FROM obs WHERE value <> 0 AND event_id % 4 <> 0) SELECT pixel, min_by(value, event_id) AS value FROM c GROUP BY pixel""")
def mosaic_first_valid(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "obs").withColumn("value", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")))
    return raster.mosaic_first(c, ["pixel"], "event_id")


@registered(ENTRIES, """WITH s AS (SELECT s_suppkey % 20 AS id, CAST(s_suppkey * 7 % 12 AS INTEGER) AS r0, CAST(s_suppkey * 5 % 12 AS INTEGER) AS c0, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END AS v FROM supplier), g AS (SELECT id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(20)) AS id), (SELECT unnest(range(16)) AS r), (SELECT unnest(range(16)) AS c))
SELECT g.id, g.row, g.col, coalesce(max(v), 0) AS value FROM g LEFT JOIN s ON g.id = s.id AND g.row BETWEEN r0 AND r0 + 3 AND g.col BETWEEN c0 AND c0 + 2 GROUP BY ALL""")
def burn_masks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr("s_suppkey % 20 AS id", "CAST(s_suppkey * 7 % 12 AS INT) AS row0", "CAST(s_suppkey * 5 % 12 AS INT) AS col0", "CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END AS value").selectExpr("*", "row0 + 3 AS row1", "col0 + 2 AS col1")
    return raster.burn(s, spark.range(20).selectExpr("id", "16 AS h", "16 AS w"))


@registered(ENTRIES, f"""{ctes("obs")}, n AS (SELECT pixel, avg((value > 0 AND scl IN (4, 5, 6, 7))::INT) AS share, count(*) AS n FROM obs GROUP BY pixel) SELECT pixel, n, round(share, 6) AS share FROM n WHERE share >= 0.5""")
def valid_fraction_gate(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("value") > 0) & F.col("scl").isin(*raster.CLEAR)
    n = view(spark, d, "obs").groupBy("pixel").agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("share"))
    return n.where("share >= 0.5").select("pixel", "n", F.round("share", 6).alias("share"))
