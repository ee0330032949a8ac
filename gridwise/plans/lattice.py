"""Attributes, lattice cells and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import geo, grid
from gridwise.operators import regions, spatial
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, view

ENTRIES: dict[str, Entry] = {}
_VOLTAGE = "list_max(list_transform(regexp_extract_all(voltage, '(\\d+(?:\\.\\d+)?)', 1), lambda v: CAST(v AS DOUBLE)))"
#: Metres in a plane cell, and the size that stands for a lattice of 0.1 degrees.
CELL_M = 10000.0


@registered(ENTRIES, f"""{ctes("subs")}, v AS (SELECT id, {_VOLTAGE} AS voltage_v FROM subs)
SELECT id, voltage_v, CASE WHEN voltage_v >= 220000 THEN '>=220kV' WHEN voltage_v >= 66000 THEN '66-220kV' ELSE '<66kV/unknown' END AS bucket,
    CASE WHEN voltage_v >= 400000 THEN '400+' WHEN voltage_v >= 220000 THEN '220-400' WHEN voltage_v >= 100000 THEN '100-220' WHEN voltage_v >= 0 THEN '0-100' END AS class FROM v""")
def voltage_parse_bucket(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "subs").select("id", grid.voltage(F.col("voltage")).alias("voltage_v"))
    return v.select("id", "voltage_v", grid.voltage_bucket(F.col("voltage_v")).alias("bucket"), grid.voltage_class(F.col("voltage_v")).alias("class"))


@registered(ENTRIES, f"""{ctes("subs")}, v AS (SELECT *, {_VOLTAGE} AS voltage_v FROM subs)
SELECT id, CASE WHEN area_m2 >= 20000 AND coalesce(status NOT IN ('no_signal', 'village'), true) THEN 'pos' ELSE 'small' END AS role,
    CASE WHEN area_m2 >= 20000 AND coalesce(status NOT IN ('no_signal', 'village'), true) AND voltage_v > 0 THEN 'pos' ELSE 'small' END AS role_voltage_only,
    CASE WHEN area_m2 >= 20000 THEN '20k+' WHEN area_m2 >= 5000 THEN '5k-20k' WHEN area_m2 >= 2000 THEN '2k-5k' WHEN area_m2 >= 1000 THEN '1k-2k' END AS bucket FROM v""")
def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "subs").withColumn("voltage_v", grid.voltage(F.col("voltage")))
    args = (F.col("area_m2"), F.col("status"), F.col("voltage_v"), 20000)
    return s.select("id", grid.role(*args).alias("role"), grid.role(*args, voltage_only=True).alias("role_voltage_only"), grid.area_bucket(F.col("area_m2")).alias("bucket"))


@registered(ENTRIES, f"""{ctes("subs")}, o AS (SELECT CAST(69.3405158324398 AS DOUBLE) + floor((min(lon) - CAST(69.3405158324398 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS lon0, CAST(27.7089663393252 AS DOUBLE) + floor((min(lat) - CAST(27.7089663393252 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS lat0 FROM subs),
c AS (SELECT CAST(floor((lon - lon0) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS ix, CAST(floor((lat - lat0) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS iy, area_m2 FROM subs, o)
SELECT ix, iy, printf('%04d_%04d', ix, iy) AS name, sum(area_m2) AS area_m2, count(*) AS n FROM c GROUP BY ix, iy""")
def cell_index_counts(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "subs")
    o = s.agg(grid.snap_origin(F.min("lon"), 69.3405158324398).alias("lon0"), grid.snap_origin(F.min("lat"), 27.7089663393252).alias("lat0"))
    c = s.crossJoin(F.broadcast(o)).select(grid.cell_index(F.col("lon"), F.col("lon0")).alias("ix"), grid.cell_index(F.col("lat"), F.col("lat0")).alias("iy"), "area_m2")
    return c.groupBy("ix", "iy").agg(F.sum("area_m2").alias("area_m2"), F.count("*").alias("n")).withColumn("name", grid.cell_name(F.col("ix"), F.col("iy")))


@registered(ENTRIES, f"""{ctes("subs")}, c AS (SELECT CAST(floor(x / 10000) AS BIGINT) AS ix, CAST(floor(y / 10000) AS BIGINT) AS iy, sum(area_m2) AS area_m2, count(*) AS n FROM subs WHERE area_m2 >= 20000 GROUP BY 1, 2)
SELECT * FROM c ORDER BY area_m2 DESC, ix, iy LIMIT 20""")
def training_cells_topn(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "subs").where("area_m2 >= 20000")
    c = s.groupBy(F.floor(F.col("x") / CELL_M).alias("ix"), F.floor(F.col("y") / CELL_M).alias("iy")).agg(F.sum("area_m2").alias("area_m2"), F.count("*").alias("n"))
    return c.orderBy(F.desc("area_m2"), "ix", "iy").limit(20)


@registered(ENTRIES, f"""{ctes("lines", "subs")}, cells AS (SELECT i AS ix, j AS iy FROM range(0, 16) a(i), range(0, 13) b(j)),
near AS (SELECT DISTINCT ix, iy FROM cells, subs WHERE sqrt(pow(greatest(ix * 10000 - x, 0, x - (ix + 1) * 10000), 2) + pow(greatest(iy * 10000 - y, 0, y - (iy + 1) * 10000), 2)) <= 8000),
own AS (SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) AS ix, CAST(floor(y / 10000) AS BIGINT) AS iy FROM subs WHERE area_m2 >= 20000)
SELECT n.ix, n.iy, o.ix IS NOT NULL AS has_label FROM near n LEFT JOIN own o ON n.ix = o.ix AND n.iy = o.iy""")
def roi_cells_radius(spark: SparkSession, d: str) -> DataFrame:
    """Cells within 8 km of a substation: each lists the cells around it, and the exact distance to the cell's box decides."""
    s, r = view(spark, d, "subs"), 8000.0
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / CELL_M), F.floor((F.col(c) + r) / CELL_M)))
    gap = lambda c, i: F.greatest(F.col(i) * CELL_M - F.col(c), F.lit(0.0), F.col(c) - (F.col(i) + 1) * CELL_M)
    near = s.withColumn("ix", span("x")).withColumn("iy", span("y"))
    near = near.where((F.sqrt(gap("x", "ix") * gap("x", "ix") + gap("y", "iy") * gap("y", "iy")) <= r) & F.col("ix").between(0, 15) & F.col("iy").between(0, 12)).select("ix", "iy").distinct()
    own = s.where("area_m2 >= 20000").select(F.floor(F.col("x") / CELL_M).alias("ox"), F.floor(F.col("y") / CELL_M).alias("oy")).distinct()
    return near.join(own, (F.col("ix") == F.col("ox")) & (F.col("iy") == F.col("oy")), "left").select("ix", "iy", F.col("ox").isNotNull().alias("has_label"))


@registered(ENTRIES, f"""{ctes("lines")}, c AS (SELECT id, x0, y0, x1, y1, ix, unnest(range(CAST(floor(least(y0, y1) / 10000) AS BIGINT), CAST(floor(greatest(y0, y1) / 10000) AS BIGINT) + 1)) AS iy FROM (SELECT *, unnest(range(CAST(floor(least(x0, x1) / 10000) AS BIGINT), CAST(floor(greatest(x0, x1) / 10000) AS BIGINT) + 1)) AS ix FROM lines)),
t AS (SELECT *, (x1 - x0) * (iy * 10000 - y0) - (y1 - y0) * (ix * 10000 - x0) AS a, (x1 - x0) * (iy * 10000 - y0) - (y1 - y0) * ((ix + 1) * 10000 - x0) AS b, (x1 - x0) * ((iy + 1) * 10000 - y0) - (y1 - y0) * (ix * 10000 - x0) AS c, (x1 - x0) * ((iy + 1) * 10000 - y0) - (y1 - y0) * ((ix + 1) * 10000 - x0) AS d FROM c)
SELECT ix, iy, count(*) AS n_lines, round(sum(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))) / 1000, 3) AS line_km FROM t WHERE least(a, b, c, d) <= 0 AND greatest(a, b, c, d) >= 0 GROUP BY ix, iy""")
def line_km_per_cell(spark: SparkSession, d: str) -> DataFrame:
    """A line counts whole in each cell that it shares a point with."""
    touched = regions.lines_by_cell(view(spark, d, "lines"), CELL_M)
    return touched.groupBy("ix", "iy").agg(F.count("*").alias("n_lines"), F.round(F.sum("length") / 1000, 3).alias("line_km"))


_E2, _E = repr(geo.E2), repr(geo.E)


@registered(ENTRIES, f"""{ctes("cand")}, s AS (SELECT id, lon, lat, sin(radians(lat)) AS s FROM cand)
SELECT id, round(radians(lon) * CAST({geo.A * geo.K0!r} AS DOUBLE), 2) AS x, round((s / (1 - CAST({_E2} AS DOUBLE) * s * s) - ln((1 - CAST({_E} AS DOUBLE) * s) / (1 + CAST({_E} AS DOUBLE) * s)) / (2 * CAST({_E} AS DOUBLE))) * (1 - CAST({_E2} AS DOUBLE)) * CAST({geo.A / (2 * geo.K0)!r} AS DOUBLE), 2) AS y,
    CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS utm, lon AS lon_back, lat AS lat_back FROM s""")
def equal_area_projection(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cand").select("id", "lon", "lat")
    x, y = geo.equal_area_x(F.col("lon")), geo.equal_area_y(F.col("lat"))
    back = (F.round(geo.equal_area_lon(x), 6).alias("lon_back"), F.round(geo.equal_area_lat(y), 6).alias("lat_back"))
    return c.select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("utm"), *back)


_D = "CAST({0!r} AS DOUBLE)".format
_FORWARD = geo.series(geo._FORWARD)
_ETA = " + ".join(["eta", *(f"{_D(c)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(_FORWARD, 1))])
_XI = " + ".join(["xi", *(f"{_D(c)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(_FORWARD, 1))])
_K = _D(geo.UTM_SCALE * geo.RECTIFYING)


@registered(ENTRIES, f"""{ctes("cand")}, p AS (SELECT id, lon, CASE WHEN id % 2 = 0 THEN lat ELSE -lat END AS lat FROM cand), z AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone, sin(radians(lat)) AS s FROM p),
t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS l, sinh(atanh(s) - {_D(geo.E)} * atanh({_D(geo.E)} * s)) AS t FROM z), q AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM t)
SELECT id, zone, round(({_ETA}) * {_K} + 500000, 3) AS x, round(({_XI}) * {_K} + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y, round(lon, 8) AS lon_back, round(lat, 8) AS lat_back FROM q""")
def utm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in their UTM zone, half of them south, and back: 8 places of a degree are a millimetre."""
    c = view(spark, d, "cand").select("id", "lon", F.when(F.col("id") % 2 == 0, F.col("lat")).otherwise(-F.col("lat")).alias("lat"))
    c = c.withColumn("zone", geo.utm_zone(F.col("lon"))).withColumn("south", F.col("lat") < 0)
    c = c.withColumn("m", geo.utm_xy(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))).withColumn("b", geo.utm_lonlat(F.col("m.x"), F.col("m.y"), F.col("zone"), F.col("south")))
    return c.select("id", "zone", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round("b.lon", 8).alias("lon_back"), F.round("b.lat", 8).alias("lat_back"))


@registered(ENTRIES, f"""{ctes("cand")} SELECT id, substr(sha1(printf('%.5f_%.5f', lon, lat)), 1, 12) AS chip_id, CASE WHEN lon BETWEEN 67 AND 69.5 AND lat BETWEEN 24 AND 26.5 THEN 'val' ELSE 'train' END AS split FROM cand""")
def chip_id_sha1(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return view(spark, d, "cand").select("id", grid.chip_id(lon, lat).alias("chip_id"), grid.split(lon, lat, (67.0, 24.0, 69.5, 26.5)).alias("split"))


@registered(ENTRIES, f"""{ctes("cand")} SELECT CASE WHEN lon BETWEEN 67 AND 69.5 AND lat BETWEEN 24 AND 26.5 THEN 'val' ELSE 'train' END AS split, kind, count(*) AS n, min(lon) AS lon_min, max(lon) AS lon_max FROM cand GROUP BY 1, 2""")
def geo_split(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cand").withColumn("split", grid.split(F.col("lon"), F.col("lat"), (67.0, 24.0, 69.5, 26.5)))
    return c.groupBy("split", "kind").agg(F.count("*").alias("n"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


@registered(ENTRIES, f"""{ctes("cand", "subs")}, c AS (SELECT CAST(floor(x / 10000) AS BIGINT) AS ix, CAST(floor(y / 10000) AS BIGINT) AS iy, confidence FROM cand), s AS (SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) AS ix, CAST(floor(y / 10000) AS BIGINT) AS iy FROM subs)
SELECT ix, iy, count(*) AS n, max(confidence) AS best FROM c SEMI JOIN s USING (ix, iy) GROUP BY ix, iy""")
def points_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in cells that have a substation: on a regular lattice, containment is equality of keys."""
    key = lambda df, *more: df.select(F.floor(F.col("x") / CELL_M).alias("ix"), F.floor(F.col("y") / CELL_M).alias("iy"), *more)
    c = key(view(spark, d, "cand"), "confidence").join(key(view(spark, d, "subs")).distinct(), ["ix", "iy"], "left_semi")
    return c.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@registered(ENTRIES, f"""{ctes("lines")}, n AS (SELECT *, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) AS len FROM lines), p AS (SELECT id AS line_id, unnest(range(0, CAST(floor(len / 500) AS BIGINT) + 1)) AS k, x0, y0, x1, y1, len FROM n WHERE len > 0)
SELECT line_id, count(*) AS n, round(sum(x0 + (x1 - x0) * (k * CAST(500 AS DOUBLE) / len) - (y1 - y0) / len * 1000), 2) AS sum_x, round(max(y0 + (y1 - y0) * (k * CAST(500 AS DOUBLE) / len) + (x1 - x0) / len * 1000), 2) AS max_y FROM p GROUP BY line_id""")
def corridor_samples(spark: SparkSession, d: str) -> DataFrame:
    """Points every 500 m along lines, moved 1 km sideways."""
    p = spatial.along_lines(view(spark, d, "lines"), 500.0, 1000.0)
    return p.groupBy("line_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sum_x"), F.round(F.max("y"), 2).alias("max_y"))
