"""Drawing chips, merging their indexes, and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import grid
from gridwise.operators import dataset, regions
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, view
from gridwise.plans.spatials import _D, _SEG, _T

ENTRIES: dict[str, Entry] = {}


def _u(key: str, seed: int) -> str:
    return f"((({key} * 48271 + {seed * 69621}) % 2147483647) * 16807 % 2147483647) / CAST(2147483647 AS DOUBLE)"


def _moved(lon: str, lat: str, key: str, seed: int, metres: float) -> tuple[str, str]:
    m = f"CAST({metres / 111320.0!r} AS DOUBLE)"
    return f"{lon} + (2 * {_u(key, seed)} - 1) * {m} / cos(radians({lat}))", f"{lat} + (2 * {_u(key, seed + 1)} - 1) * {m}"


_A, _B, _C = _moved("lon", "lat", "id", 42, 900.0), _moved("lon", "lat", "(id * 31 + copy)", 44, 300.0), _moved("lon", "lat", "id", 46, 900.0)


@registered(ENTRIES, f"""{ctes("cand", "subs")}, m AS (SELECT id, {_A[0]} AS lon, {_A[1]} AS lat, CASE WHEN id % 4 = 0 THEN 220000 END AS voltage_v FROM cand), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY round_even(lon / CAST(0.02 AS DOUBLE), 0), round_even(lat / CAST(0.02 AS DOUBLE), 0) ORDER BY id) = 1),
c AS (SELECT id, lon, lat, unnest(range(1, CASE WHEN voltage_v > 0 THEN 4 ELSE 2 END)) AS copy FROM k), p AS (SELECT 'positive' AS kind, id, CASE WHEN copy > 1 THEN {_B[0]} ELSE lon END AS lon, CASE WHEN copy > 1 THEN {_B[1]} ELSE lat END AS lat FROM c), n AS (SELECT count(*) AS n FROM p),
far AS (SELECT id, lon, lat FROM cand WHERE id NOT IN (SELECT a.id FROM cand a, subs b WHERE {_D} <= 1500)), g AS (SELECT 'line_negative' AS kind, id, {_C[0]} AS lon, {_C[1]} AS lat FROM far QUALIFY row_number() OVER (ORDER BY {_u("id", 48)}, id) <= (SELECT CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT) FROM n)),
b AS (SELECT 'background' AS kind, id, 60 + 16 * {_u("id", 50)} AS lon, 23 + 13 * {_u("id", 51)} AS lat FROM (SELECT unnest(range(0, (SELECT greatest(CAST(floor(CAST(0.3 AS DOUBLE) * n) AS BIGINT), 1) FROM n))) AS id))
SELECT kind, id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT * FROM p UNION ALL SELECT * FROM g UNION ALL SELECT * FROM b) WHERE lon BETWEEN 60 AND 76 AND lat BETWEEN 23 AND 36""")
def chip_centres(spark: SparkSession, d: str) -> DataFrame:
    """Positives moved, thinned and repeated, negatives far from substations, and background."""
    c = view(spark, d, "cand")
    labels = c.select("id", "lon", "lat", F.when(F.col("id") % 4 == 0, 220000.0).alias("voltage_v"))
    out = dataset.chip_centres(labels, c.select("id", "lon", "lat", "x", "y"), view(spark, d, "subs").select("id", "x", "y"), (60.0, 23.0, 76.0, 36.0), voltage_weight=3)
    return out.select("kind", "id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@registered(ENTRIES, f"""{ctes("cand", "subs", "lines")}, s AS (SELECT c.id, {_SEG} AS d FROM (SELECT c.id, c.x, c.y, l.id AS lid, {_T} AS t FROM cand c, lines l) c JOIN lines l ON l.id = c.lid), k AS (SELECT * FROM cand WHERE id NOT IN (SELECT a.id FROM cand a, subs b WHERE {_D} <= 1600) AND id NOT IN (SELECT id FROM s WHERE d <= 200)),
g AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY floor(x / 1500), floor(y / 1500) ORDER BY id) = 1), n AS (SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY (id * 48271) % 65536, id) AS n FROM g) SELECT id, status FROM n WHERE n <= CASE status WHEN 'refined' THEN 30 WHEN 'village' THEN 20 ELSE 0 END""")
def settlement_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Points clear of substations and lines, one in each square of 1500 m, at most so many of each class."""
    c = dataset.clear_points(view(spark, d, "cand").select("id", "x", "y", "status"), [(view(spark, d, "subs"), 1600.0), (view(spark, d, "lines"), 200.0)])
    c = dataset.first_of(c, [F.floor(F.col("x") / 1500), F.floor(F.col("y") / 1500)], [F.col("id")]).withColumn("key", (F.col("id") * 48271) % 65536)
    return dataset.capped(c, "status", {"refined": 30, "village": 20}, "key", ["id"], 65536).select("id", "status")


@registered(ENTRIES, f"""{ctes("subs", "nodes")}, g AS (SELECT unnest(range(0, 160 * 130)) AS id), p AS (SELECT id, (id % 160) * 1000 + (2 * {_u("id", 42)} - 1) * 400 AS x, (id // 160) * 1000 + (2 * {_u("id", 43)} - 1) * 400 AS y FROM g)
SELECT a.id, round(x, 4) AS x, round(y, 4) AS y FROM p a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE {_D} <= 1000) AND NOT EXISTS (SELECT 1 FROM subs b WHERE {_D} <= 1500) ORDER BY {_u("id", 1)}, id LIMIT 300""")
def remote_grid_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Points of a shaken grid, a kilometre from buildings and more from substations; 300 of them."""
    g = spark.range(1).select(F.explode(dataset.jittered_grid((0.0, 0.0, 160000.0, 130000.0), 1000.0, 0.4, 42)).alias("p")).select(F.col("p.k").alias("id"), "p.x", "p.y")
    far = dataset.clear_points(g, [(view(spark, d, "nodes").select("id", "x", "y"), 1000.0), (view(spark, d, "subs").select("id", "x", "y"), 1500.0)], 300, grid.uniform(F.col("id"), 1))
    return far.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@registered(ENTRIES, f"""{ctes("chips")}, b AS (SELECT *, n_chars % 3 AS sub_pixels, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS which FROM chips), m AS (SELECT id, which AS aoi, split, sub_pixels, key, unnest(range(1, CASE WHEN split = 'train' AND which = 'a' THEN 4 ELSE 2 END)) AS copy FROM b), z AS (SELECT * FROM m WHERE sub_pixels = 0), t AS (SELECT least(1.0::DOUBLE, 300 / count(*)::DOUBLE) AS f FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY key, id, copy) AS n, count(*) OVER (PARTITION BY aoi) AS c FROM z) SELECT aoi, split, copy::INTEGER AS copy, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT aoi, split, copy, id FROM m WHERE sub_pixels > 0 UNION ALL SELECT aoi, split, copy, id FROM n, t WHERE n <= greatest(1, round_even(c * f, 0))) GROUP BY ALL""")
def merged_index(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes by a recipe, the first three times, with its empty chips cut to about 300 in proportion."""
    c = view(spark, d, "chips").withColumn("sub_pixels", F.col("n_chars") % 3)
    parts = {"a": c.where("lang = 'en'"), "b": c.where("lang <> 'en' OR lang IS NULL")}
    m = dataset.rebalanced(dataset.merged(parts, "a:3, b"), 300, "key", ["id", "copy"], 65536)
    return m.groupBy("aoi", "split", "copy").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@registered(ENTRIES, f"""{ctes("chips")}, v AS (SELECT id, CASE WHEN id % 40 = 0 AND n < 8 THEN 'val' ELSE 'train' END AS split, key FROM (SELECT *, row_number() OVER (PARTITION BY id % 40 = 0 ORDER BY id) AS n FROM chips)), few AS (SELECT count(*) < 8 AS few FROM v WHERE split = 'val')
SELECT CASE WHEN few AND split = 'train' AND key % 100 < 20 THEN 'val' ELSE split END AS split, count(*) AS n, sum(id)::BIGINT AS ids FROM v, few GROUP BY 1""")
def validation_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Seven validation rows are too few, so a fifth of the training rows joins them."""
    seven = view(spark, d, "chips").where("id % 40 = 0").orderBy("id").limit(7).select(F.col("id").alias("v"))
    c = view(spark, d, "chips").join(seven, F.col("id") == F.col("v"), "left").withColumn("split", F.when(F.col("v").isNotNull(), "val").otherwise("train"))
    return dataset.with_validation(c, F.col("key")).groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@registered(ENTRIES, f"""{ctes("cand", "subs", "nodes")}, w AS (SELECT id, CASE WHEN id IN (SELECT id FROM subs) THEN 'linked' WHEN id IN (SELECT id FROM nodes) THEN 'link' ELSE 'missing' END AS status FROM cand) SELECT status, count(*) AS n, min(id) AS first FROM w GROUP BY status""")
def tile_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Wanted tiles that are linked already, can be, or are missing."""
    w = dataset.reused(view(spark, d, "cand").select("id"), view(spark, d, "nodes"), view(spark, d, "subs"), "id")
    return w.groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@registered(ENTRIES, f"""{ctes("cand")}, k AS (SELECT id, lon, lat, confidence FROM cand WHERE status = 'refined'), g AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY round_even(lon / CAST(0.02 AS DOUBLE), 0), round_even(lat / CAST(0.02 AS DOUBLE), 0) ORDER BY confidence DESC, id) = 1) SELECT id, confidence FROM g ORDER BY confidence DESC, id LIMIT 60""")
def hard_negatives_top(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored false finds, one in each square of 0.02 degrees."""
    c = view(spark, d, "cand").where("status = 'refined'").select("id", "lon", "lat", "confidence")
    g = dataset.first_of(c, [grid.round_key(F.col("lon"), F.col("lat"), 0.02)], [-F.col("confidence"), F.col("id")])
    return g.orderBy(F.desc("confidence"), "id").limit(60).select("id", "confidence")


@registered(ENTRIES, f"""{ctes("lines", "subs")}, own AS (SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) AS ix, CAST(floor(y / 10000) AS BIGINT) AS iy FROM subs WHERE area_m2 >= 20000), near AS (SELECT DISTINCT i AS ix, j AS iy FROM range(0, 16) a(i), range(0, 13) b(j), subs WHERE sqrt(pow(greatest(i * 10000 - x, 0, x - (i + 1) * 10000), 2) + pow(greatest(j * 10000 - y, 0, y - (j + 1) * 10000), 2)) <= 8000),
f AS (SELECT * FROM lines WHERE voltage_v >= 132000 OR voltage_v IS NULL), c AS (SELECT id, x0, y0, x1, y1, ix, unnest(range(CAST(floor(least(y0, y1) / 10000) AS BIGINT), CAST(floor(greatest(y0, y1) / 10000) AS BIGINT) + 1)) AS iy FROM (SELECT *, unnest(range(CAST(floor(least(x0, x1) / 10000) AS BIGINT), CAST(floor(greatest(x0, x1) / 10000) AS BIGINT) + 1)) AS ix FROM f)),
t AS (SELECT *, (x1 - x0) * (iy * 10000 - y0) - (y1 - y0) * (ix * 10000 - x0) AS a, (x1 - x0) * (iy * 10000 - y0) - (y1 - y0) * ((ix + 1) * 10000 - x0) AS b, (x1 - x0) * ((iy + 1) * 10000 - y0) - (y1 - y0) * (ix * 10000 - x0) AS c_, (x1 - x0) * ((iy + 1) * 10000 - y0) - (y1 - y0) * ((ix + 1) * 10000 - x0) AS d FROM c), k AS (SELECT ix, iy, round(sum(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))) / 1000, 3) AS km FROM t WHERE least(a, b, c_, d) <= 0 AND greatest(a, b, c_, d) >= 0 GROUP BY ix, iy)
SELECT n.ix, n.iy, printf('%04d_%04d', n.ix, n.iy) AS name, o.ix IS NOT NULL AS has_label, coalesce(km, 0) AS line_km FROM near n LEFT JOIN own o ON n.ix = o.ix AND n.iy = o.iy LEFT JOIN k ON k.ix = n.ix AND k.iy = n.iy ORDER BY has_label DESC, line_km DESC, n.ix, n.iy LIMIT 50""")
def roi_cells_run(spark: SparkSession, d: str) -> DataFrame:
    """Cells near substations with the length of strong and unknown lines, labelled and long ones first."""
    lines = view(spark, d, "lines").where("voltage_v >= 132000 OR voltage_v IS NULL")
    cells = regions.roi_cells(view(spark, d, "subs"), lines, 8000.0, 10000.0, (0, 0, 15, 12), F.col("area_m2") >= 20000)
    cells = cells.withColumn("line_km", F.round("line_km", 3)).orderBy(F.desc("has_label"), F.desc("line_km"), "ix", "iy").limit(50)
    return cells.select("ix", "iy", grid.cell_name(F.col("ix"), F.col("iy")).alias("name"), "has_label", "line_km")
