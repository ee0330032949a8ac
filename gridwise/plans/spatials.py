"""Distance joins and what ranks leads by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import grid, polygon, scores
from gridwise.operators import leads, ranking, regions, spatial
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, view

ENTRIES: dict[str, Entry] = {}
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_T = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE WHEN x1 = x0 AND y1 = y0 THEN 0 ELSE ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) END))"
_SEG = "sqrt((x - (x0 + t * (x1 - x0))) * (x - (x0 + t * (x1 - x0))) + (y - (y0 + t * (y1 - y0))) * (y - (y0 + t * (y1 - y0))))"


def _nearest_line(cte: str, left: str, extra: str = "") -> str:
    return f"{cte}{extra}, prs AS (SELECT c.id, l.id AS line, {_SEG} AS d FROM (SELECT c.id, c.x, c.y, l.id AS lid, {_T} AS t FROM {left} c, lines l) c JOIN lines l ON l.id = c.lid), nl AS (SELECT id, min(round(d, 1)) AS near_dist, min_by(line, struct_pack(a := round(d, 1), b := line)) AS near_id FROM prs GROUP BY id)"


def _nearest(name: str, left: str, right: str) -> str:
    return f"{name} AS (SELECT a.id, min(round({_D}, 1)) AS near_dist, min_by(b.id, struct_pack(d := round({_D}, 1), i := b.id)) AS near_id FROM {left} a, {right} b GROUP BY a.id)"


@registered(ENTRIES, f"""{_nearest_line(ctes("cand", "lines"), "cand")}
SELECT c.id, n.near_id, n.near_dist, round(c.confidence * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * exp(-n.near_dist / 2000)), 4) AS rank_score FROM cand c LEFT JOIN nl n USING (id)""")
def nearest_line_prior_rank(spark: SparkSession, d: str) -> DataFrame:
    return leads.with_line_prior(view(spark, d, "cand"), view(spark, d, "lines")).select("id", "near_id", "near_dist", "rank_score")


@registered(ENTRIES, f"""{ctes("cand", "subs", "nodes")}, k AS (SELECT DISTINCT a.id FROM cand a, subs b WHERE {_D} <= 900), n AS (SELECT DISTINCT a.id FROM cand a, nodes b WHERE {_D} <= 300)
SELECT c.id, CASE WHEN k.id IS NOT NULL THEN 'known' ELSE 'new' END AS status, n.id IS NOT NULL AS near_node FROM cand c LEFT JOIN k ON c.id = k.id LEFT JOIN n ON c.id = n.id""")
def known_new_semi(spark: SparkSession, d: str) -> DataFrame:
    c = leads.with_status(view(spark, d, "cand").drop("status"), view(spark, d, "subs"), 900.0)
    return spatial.marked(c, view(spark, d, "nodes"), 300.0, "near_node").select("id", "status", "near_node")


@registered(ENTRIES, f"""{ctes("cand", "subs", "lines")}, near AS (SELECT DISTINCT a.id FROM cand a, subs b WHERE {_D} <= 1600), s AS (SELECT c.id, {_SEG} AS d FROM (SELECT c.id, c.x, c.y, l.id AS lid, {_T} AS t FROM cand c, lines l) c JOIN lines l ON l.id = c.lid)
SELECT id, x, y FROM cand WHERE id NOT IN (SELECT id FROM near) AND id NOT IN (SELECT id FROM s WHERE d <= 500)""")
def clearance_anti(spark: SparkSession, d: str) -> DataFrame:
    clear = spatial.clear_of(view(spark, d, "cand"), view(spark, d, "subs"), 1600.0)
    return spatial.clear_of(clear, view(spark, d, "lines"), 500.0).select("id", "x", "y")


@registered(ENTRIES, f"""{ctes("ends", "subs")}, {_nearest("n", "ends", "subs")} SELECT id, near_dist AS sub_dist_m FROM n WHERE near_dist > 700""")
def endpoint_filter_700m(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.nearest(view(spark, d, "ends"), view(spark, d, "subs"), 4000.0)
    return near.where(F.coalesce("near_dist", F.lit(1e9)) > 700).select("id", F.col("near_dist").alias("sub_dist_m"))


@registered(ENTRIES, f"""{ctes("ends", "cand")} SELECT b.id AS cand_id, max(b.confidence) AS score, round(min({_D}), 1) AS min_dist, count(DISTINCT a.id) AS n_endpoints FROM ends a, cand b WHERE {_D} <= 2500 GROUP BY b.id""")
def endpoint_candidate_matches(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cand").select("id", "x", "y", F.col("confidence").alias("score"))
    return leads.best_by_candidate(spatial.within(view(spark, d, "ends"), c, 2500.0)).withColumnRenamed("right_id", "cand_id")


@registered(ENTRIES, f"""{ctes("cand", "nodes")}, r AS (SELECT a.id, count(*) AS n_ring, min({_D}) AS ring_dist FROM cand a, nodes b WHERE {_D} BETWEEN 150 AND 1000 GROUP BY a.id)
SELECT c.id, coalesce(n_ring, 0) AS n_ring, round(ring_dist, 3) AS ring_dist, CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * least(coalesce(n_ring, 0), 4) / CAST(4 AS DOUBLE) AS prior FROM cand c LEFT JOIN r USING (id)""")
def annulus_counts(spark: SparkSession, d: str) -> DataFrame:
    r = spatial.ring_counts(view(spark, d, "cand"), view(spark, d, "nodes"), 150.0, 1000.0)
    return r.select("id", "n_ring", F.round("ring_dist", 3).alias("ring_dist"), scores.isolated(F.col("n_ring")).alias("prior"))


@registered(ENTRIES, f"""{ctes("nodes")}, n AS (SELECT a.id, count(*) AS k FROM nodes a, nodes b WHERE a.id <> b.id AND {_D} <= 2500 GROUP BY a.id) SELECT a.id, coalesce(k, 0) AS n_near FROM nodes a LEFT JOIN n USING (id) WHERE coalesce(k, 0) <= 3""")
def neighbour_isolation(spark: SparkSession, d: str) -> DataFrame:
    return spatial.neighbours(view(spark, d, "nodes").select("id", "x", "y"), 2500.0, most=3).select("id", "n_near")


@registered(ENTRIES, f"""{ctes("subs", "nodes")}, near AS (SELECT a.id, b.id AS n, b.x, b.y FROM subs a, nodes b WHERE {_D} <= 5000), l AS (SELECT a.id, degrees(atan2(b.y - a.y, b.x - a.x)) AS g FROM near a JOIN near b ON a.id = b.id AND a.n < b.n WHERE {_D} > 1 AND {_D} < 3000)
SELECT s.id, count(DISTINCT floor((CASE WHEN g < 0 THEN g + 180 WHEN g >= 180 THEN g - 180 ELSE g END) / 30)) AS n_bearings, CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * least(count(DISTINCT floor((CASE WHEN g < 0 THEN g + 180 WHEN g >= 180 THEN g - 180 ELSE g END) / 30)), 3) AS factor FROM subs s LEFT JOIN l USING (id) GROUP BY s.id""")
def bearing_bins(spark: SparkSession, d: str) -> DataFrame:
    b = spatial.bearing_counts(view(spark, d, "subs").select("id", "x", "y"), view(spark, d, "nodes").select("id", "x", "y"), 5000.0, 3000.0)
    return b.select("id", "n_bearings", scores.convergence(F.col("n_bearings")).alias("factor"))


@registered(ENTRIES, f"""{_nearest_line(ctes("cand", "lines", "ends"), "cand")}, e AS (SELECT a.id, round(min({_D}), 1) AS endpoint_dist, count(*) AS n FROM cand a, ends b WHERE {_D} < 5000 GROUP BY a.id)
SELECT c.id, e.endpoint_dist, e.n AS n_endpoints, nl.near_dist AS line_dist, c.area_m2 < 20000 AS below_floor, round(c.confidence * exp(-e.endpoint_dist / 2000) * exp(-nl.near_dist / 500), 4) AS rank_score FROM cand c JOIN e USING (id) JOIN nl USING (id)""")
def regional_rank(spark: SparkSession, d: str) -> DataFrame:
    c = leads.with_endpoints(view(spark, d, "cand"), view(spark, d, "ends"), 5000.0).where("n_endpoints > 0")
    c = spatial.nearest(c, view(spark, d, "lines"), 500.0)
    rank = scores.regional_rank(F.col("confidence"), F.col("endpoint_dist"), F.col("near_dist"))
    return c.select("id", "endpoint_dist", "n_endpoints", F.col("near_dist").alias("line_dist"), (F.col("area_m2") < 20000).alias("below_floor"), rank.alias("rank_score"))


@registered(ENTRIES, f"""{ctes("cand")}, v AS (SELECT id, confidence, CASE WHEN id % 7 = 0 THEN NULL ELSE -20 + CAST((id * 31) % 160 AS DOUBLE) / 10 END AS vh FROM cand)
SELECT id, round(coalesce(1 / (1 + exp(-(vh + CAST(13.6 AS DOUBLE)) / CAST(1.5 AS DOUBLE))), 0.5), 4) AS prior, round(confidence * coalesce(1 / (1 + exp(-(vh + CAST(13.6 AS DOUBLE)) / CAST(1.5 AS DOUBLE))), 0.5), 4) AS rank_score_s1 FROM v""")
def metal_prior_rerank(spark: SparkSession, d: str) -> DataFrame:
    vh = F.when(F.col("id") % 7 != 0, F.lit(-20) + ((F.col("id") * 31) % 160).cast("double") / 10)
    c = view(spark, d, "cand").withColumn("prior", scores.metal(vh))
    return c.select("id", F.round("prior", 4).alias("prior"), F.round(F.col("confidence") * F.col("prior"), 4).alias("rank_score_s1"))


@registered(ENTRIES, f"""{ctes("cand", "nodes")}, u AS (SELECT DISTINCT a.id FROM cand a, nodes b WHERE b.segment = 'BUILDING' AND {_D} <= 1200)
SELECT c.id, u.id IS NOT NULL AS flag_urban, c.area_m2 > 30000 AS flag_building, round(c.confidence * CASE WHEN u.id IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 1 END * CASE WHEN c.area_m2 > 30000 THEN CAST(0.3 AS DOUBLE) ELSE 1 END, 4) AS rank_score_final FROM cand c LEFT JOIN u USING (id)""")
def flag_penalty_rank(spark: SparkSession, d: str) -> DataFrame:
    c = spatial.marked(view(spark, d, "cand"), view(spark, d, "nodes").where("segment = 'BUILDING'").select("id", "x", "y"), 1200.0, "flag_urban").withColumn("flag_building", F.col("area_m2") > 30000)
    return c.select("id", "flag_urban", "flag_building", F.round(scores.penalised(F.col("confidence"), F.col("flag_urban"), F.col("flag_building")), 4).alias("rank_score_final"))


@registered(ENTRIES, f"""{ctes("lead_boxes", "boxes")}, p AS (SELECT a.id, greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0) AS o FROM lead_boxes a, boxes b), s AS (SELECT id, sum(o) AS o FROM p GROUP BY id)
SELECT l.id, round(o / ((xmax - xmin) * (ymax - ymin)), 6) AS fill, o / ((xmax - xmin) * (ymax - ymin)) > 0.1 AS flag_building FROM lead_boxes l JOIN s USING (id)""")
def building_fill_boxes(spark: SparkSession, d: str) -> DataFrame:
    f = leads.building_fill(view(spark, d, "lead_boxes"), view(spark, d, "boxes"), 500.0, threshold=0.1)
    return f.select("id", F.round("fill", 6).alias("fill"), "flag_building")


@registered(ENTRIES, f"""{ctes("lines", "nodes")}, n AS (SELECT *, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) AS len FROM lines WHERE voltage_v >= 220000), s AS (SELECT id AS line, k, o, x0 + (x1 - x0) * (k * CAST(500 AS DOUBLE) / len) - (y1 - y0) / len * o AS x, y0 + (y1 - y0) * (k * CAST(500 AS DOUBLE) / len) + (x1 - x0) / len * o AS y FROM (SELECT id, unnest(range(0, CAST(floor(len / 500) AS BIGINT) + 1)) AS k, x0, y0, x1, y1, len FROM n WHERE len > 0), (VALUES (0), (1000)) t(o)),
h AS (SELECT a.line, a.k, a.o, bool_or({_D} <= 900) AS hit FROM s a, nodes b GROUP BY ALL), r AS (SELECT avg(CASE WHEN o = 0 THEN hit::INT END) AS on_line, avg(CASE WHEN o = 1000 THEN hit::INT END) AS control, count(*) AS n FROM h)
SELECT n, round(on_line, 6) AS on_line, round(control, 6) AS control, round(on_line / greatest(control, CAST(0.0001 AS DOUBLE)), 4) AS lift FROM r""")
def corridor_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """How often points along strong lines have a node near, against points beside them."""
    lines, nodes = view(spark, d, "lines").where("voltage_v >= 220000"), view(spark, d, "nodes").select("id", "x", "y")
    at = spatial.along_lines(lines, 500.0).withColumn("o", F.lit(0)).unionByName(spatial.along_lines(lines, 500.0, 1000.0).withColumn("o", F.lit(1)))
    at = spatial.marked(at.withColumn("id", F.concat_ws("-", "line_id", "k", "o")), nodes, 900.0, "hit")
    share = lambda o: F.avg(F.when(F.col("o") == o, F.col("hit").cast("int")))
    r = at.agg(F.count("*").alias("n"), share(0).alias("on_line"), share(1).alias("control"))
    return r.select("n", F.round("on_line", 6).alias("on_line"), F.round("control", 6).alias("control"), F.round(F.col("on_line") / F.greatest("control", F.lit(1e-4)), 4).alias("lift"))


@registered(ENTRIES, f"""{_nearest_line(ctes("nodes", "lines"), "nodes")} SELECT n.id, CASE WHEN near_dist <= 400 THEN CASE WHEN voltage_v >= 400000 THEN '400+' WHEN voltage_v >= 220000 THEN '220-400' WHEN voltage_v >= 100000 THEN '100-220' WHEN voltage_v >= 0 THEN '0-100' END END AS class FROM nl n JOIN lines l ON l.id = n.near_id""")
def tower_voltage_class(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the class of the nearest line, if that is near enough."""
    lines = view(spark, d, "lines")
    n = spatial.nearest(view(spark, d, "nodes").select("id", "x", "y"), lines.drop("voltage_v"), 500.0)
    n = n.hint("merge").join(lines.select(F.col("id").alias("l"), "voltage_v"), F.col("near_id") == F.col("l"))
    return n.select("id", F.when(F.col("near_dist") <= 400, grid.voltage_class(F.col("voltage_v"))).alias("class"))


@registered(ENTRIES, f"""{ctes("cand", "subs")}, l AS (SELECT id, confidence AS rank_score, id % 3 = 0 AS flagged, lon, lat, id % 2 = 0 AS new FROM cand), g AS (SELECT round(floor(round(lon / CAST(0.1 AS DOUBLE), 6)) * CAST(0.1 AS DOUBLE), 1) AS lon0, round(floor(round(lat / CAST(0.1 AS DOUBLE), 6)) * CAST(0.1 AS DOUBLE), 1) AS lat0, count(*) AS n_new, CAST(sum(flagged::INT) AS BIGINT) AS n_flagged, max(rank_score) AS top_score FROM l WHERE new GROUP BY 1, 2),
k AS (SELECT round(floor(round(lon / CAST(0.1 AS DOUBLE), 6)) * CAST(0.1 AS DOUBLE), 1) AS lon0, round(floor(round(lat / CAST(0.1 AS DOUBLE), 6)) * CAST(0.1 AS DOUBLE), 1) AS lat0, count(*) AS n FROM subs GROUP BY 1, 2)
SELECT g.*, coalesce(k.n, 0) AS n_known FROM g LEFT JOIN k ON g.lon0 = k.lon0 AND g.lat0 = k.lat0""")
def atlas_grid_rollup(spark: SparkSession, d: str) -> DataFrame:
    l = view(spark, d, "cand").where("id % 2 = 0").select("lon", "lat", F.col("confidence").alias("rank_score"), (F.col("id") % 3 == 0).alias("flagged"))
    return leads.atlas(l, view(spark, d, "subs"))


@registered(ENTRIES, """WITH p AS (SELECT n_nationkey, n_name, (n_nationkey % 5) * 32000 AS x0, (n_nationkey // 5) * 26000 AS y0 FROM nation), c AS (SELECT CAST((p_partkey * 7919) % 160000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 130000 AS DOUBLE) AS y FROM part)
SELECT n_name AS province, count(c.x) AS n_new, round(count(c.x) / CAST(832 AS DOUBLE) * 1000, 3) AS density FROM p LEFT JOIN c ON c.x >= x0 AND c.x < x0 + 32000 AND c.y >= y0 AND c.y < y0 + 26000 GROUP BY n_name""")
def province_density(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in each province, also those without any; per 1000 square kilometres."""
    p = spark.read.parquet(f"{d}/nation.parquet")
    x, y = (F.col("n_nationkey") % 5) * 32000, F.floor(F.col("n_nationkey") / 5) * 26000
    p = p.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(polygon.box_ring(x, y, x + 32000, y + 26000)).alias("rings"))
    out = leads.densities(p, regions.points_in(view(spark, d, "cand").select("id", "x", "y"), p, 10000.0))
    return out.select(F.col("name").alias("province"), "n_new", F.round("density", 3).alias("density"))


@registered(ENTRIES, f"""{ctes("cand")}, r AS (SELECT id, lon, lat, confidence AS rank_score, row_number() OVER (ORDER BY confidence DESC, id) - 1 AS n FROM cand) SELECT id, printf('aoi-sub-%06d', n) AS candidate_id, rank_score, n::BIGINT AS n FROM r""")
def export_candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    l = view(spark, d, "cand").withColumn("rank_score", F.col("confidence"))
    return leads.exported(l, "aoi", [F.col("id")]).select("id", "candidate_id", "rank_score", F.col("n").cast("long").alias("n"))


@registered(ENTRIES, f"""{ctes("cand")}, r AS (SELECT id, lon, lat, id % 2 = 0 AS new, printf('aoi-sub-%06d', row_number() OVER (ORDER BY confidence DESC, id) - 1) AS candidate_id, confidence AS s FROM cand)
SELECT candidate_id, '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"candidate_id":"' || candidate_id || '","rank_score":' || s || ',"link":"https://map.example/#' || printf('%.5f', lat) || '/' || printf('%.5f', lon) || '"}}}}]}}' AS value FROM r WHERE new""")
def maproulette_ndjson(spark: SparkSession, d: str) -> DataFrame:
    l = view(spark, d, "cand").withColumn("rank_score", F.col("confidence")).withColumn("status", F.when(F.col("id") % 2 == 0, "new").otherwise("known"))
    return leads.tasks(leads.exported(l, "aoi", [F.col("id")]), "https://map.example/#%.5f/%.5f")


@registered(ENTRIES, f"""{ctes("cand")} SELECT * FROM (SELECT id, confidence FROM cand QUALIFY row_number() OVER (ORDER BY confidence DESC, id) > (SELECT count(*) // 2 FROM cand))""")
def bottom_half_pool(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "cand")
    n = ranking.numbered(c, "confidence", [F.col("id")])
    return n.join(F.broadcast(c.agg(F.floor(F.count("*") / 2).alias("half"))), F.col("n") >= F.col("half")).select("id", "confidence")
