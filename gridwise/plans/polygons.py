"""Joins of polygons, and runs composed of them.

The polygons are diamonds, |x - cx| + |y - cy| <= r, some with a diamond hole; turned by 45 degrees they are squares, so
the SQL has closed forms. Their centres are off the integers, so no point lies on a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import polygon
from gridwise.operators import leads, overlay, regions
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, polygons, view
from gridwise.plans.spatials import _D, _SEG, _T, _nearest
from gridwise.session import materialize

ENTRIES: dict[str, Entry] = {}
#: Metres in a cell of these joins.
CELL_M = 4000.0
# Distances of two diamonds' centres along the turned axes; the area that two diamonds without holes share, and whether they meet.
_U, _V = "abs((a.cx + a.cy) - (b.cx + b.cy))", "abs((a.cx - a.cy) - (b.cx - b.cy))"
_MEET = f"greatest({_U}, {_V}) <= a.r + b.r AND greatest({_U}, {_V}) + b.r >= a.hole"


def _shared(r: str) -> str:
    u = f"greatest(least(a.cx + a.cy + {r}, b.cx + b.cy + b.r) - greatest(a.cx + a.cy - {r}, b.cx + b.cy - b.r), 0)"
    v = f"greatest(least(a.cx - a.cy + {r}, b.cx - b.cy + b.r) - greatest(a.cx - a.cy - {r}, b.cx - b.cy - b.r), 0)"
    return f"{u} * {v} / 2"


@registered(ENTRIES, f"""{ctes("diamonds", "sites")}, k AS (SELECT DISTINCT a.id FROM diamonds a, sites b WHERE {_MEET})
SELECT d.id, CASE WHEN k.id IS NULL THEN 'new' ELSE 'known' END AS status, round(2 * r * r - 2 * hole * hole, 3) AS area_m2 FROM diamonds d LEFT JOIN k USING (id)""")
def polygon_known_mark(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose polygon shares a point with a mapped site's; a site within a hole shares none."""
    c = regions.marked(polygons(spark, d, "diamonds"), polygons(spark, d, "sites"), CELL_M, "known")
    return c.select("id", F.when(F.col("known"), "known").otherwise("new").alias("status"), F.round(polygon.area(F.col("rings")), 3).alias("area_m2"))


@registered(ENTRIES, f"""{ctes("diamonds", "nodes")} SELECT b.id AS polygon_id, count(*) AS n, min(a.id) AS first FROM nodes a, diamonds b WHERE abs(a.x - b.cx) + abs(a.y - b.cy) < b.r AND abs(a.x - b.cx) + abs(a.y - b.cy) > b.hole GROUP BY b.id""")
def points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return regions.counts_in(view(spark, d, "nodes").select("id", "x", "y"), polygons(spark, d, "diamonds"), CELL_M)


@registered(ENTRIES, f"""{ctes("diamonds", "sites")}, h AS (SELECT DISTINCT b.id FROM diamonds a, sites b WHERE {_MEET}), t AS (SELECT s.id, 2 * r * r AS area, h.id IS NOT NULL AS hit FROM sites s LEFT JOIN h USING (id))
SELECT CASE WHEN area < 2e6 THEN '<2' WHEN area < 8e6 THEN '2-8' ELSE '8+' END AS bucket, count(*) AS installations, CAST(sum(hit::INT) AS BIGINT) AS detected, round(avg(hit::INT), 6) AS recall FROM t GROUP BY 1""")
def polygon_recall(spark: SparkSession, d: str) -> DataFrame:
    """Sites that any candidate meets, by the size of the site in square kilometres."""
    size = polygon.area(F.col("rings"))
    r = regions.recall(polygons(spark, d, "sites"), polygons(spark, d, "diamonds"), CELL_M, F.when(size < 2e6, "<2").when(size < 8e6, "2-8").otherwise("8+"))
    return r.withColumn("recall", F.round("recall", 6))


@registered(ENTRIES, f"""{ctes("diamonds", "sites")}, s AS (SELECT b.id, sum(o) AS o FROM (SELECT b.id, {_shared("a.r")} - {_shared("a.hole")} AS o FROM diamonds a, sites b WHERE greatest({_U}, {_V}) <= a.r + b.r) b WHERE o > 0 GROUP BY b.id)
SELECT id, round(coalesce(o, 0) / (2 * r * r), 6) AS fill, coalesce(o, 0) / (2 * r * r) > 0.25 AS flag_building FROM sites LEFT JOIN s USING (id)""")
def polygon_overlap_fill(spark: SparkSession, d: str) -> DataFrame:
    """How much of each site the candidates' polygons cover, theirs with holes; overlapping ones count twice."""
    f = regions.fill(polygons(spark, d, "sites"), polygons(spark, d, "diamonds"), CELL_M)
    return f.select("id", F.round("fill", 6).alias("fill"), "flag_building")


_NEAR_NODE = "abs(a.x - b.cx) + abs(a.y - b.cy) < b.r AND abs(a.x - b.cx) + abs(a.y - b.cy) > b.hole"


@registered(ENTRIES, f"""WITH RECURSIVE {ctes("diamonds").removeprefix("WITH ")}, e AS (SELECT a.id AS a, b.id AS b FROM diamonds a, diamonds b WHERE a.id <> b.id AND {_MEET} AND greatest({_U}, {_V}) + a.r >= b.hole),
r(id, part) AS (SELECT id, id FROM diamonds UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.part), l AS (SELECT part, min(id) AS id FROM r GROUP BY part)
SELECT l.id, count(*) AS n_parts, CAST(sum(n_pixels) AS BIGINT) AS n_pixels, max(confidence) AS conf_max, round(sum(n_pixels * confidence) / sum(n_pixels)::DOUBLE, 4) AS conf_mean FROM l JOIN diamonds d ON d.id = l.part GROUP BY l.id""")
def merged_components_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Polygons that meet are merged, with their best score and the mean weighted by pixels."""
    p = polygons(spark, d, "diamonds")
    parts = p.select("id", "n_pixels", F.col("confidence").alias("conf_max"), F.col("confidence").alias("conf_mean"))
    return regions.merged_scores(parts, regions.dissolved(p, CELL_M))


@registered(ENTRIES, f"""{ctes("diamonds", "sites", "lines", "nodes")}, c AS (SELECT *, cx AS x, cy AS y, 2 * r * r - 2 * hole * hole AS area_m2 FROM diamonds WHERE 2 * r * r - 2 * hole * hole >= 500000),
prs AS (SELECT c.id, l.id AS line, {_SEG} AS d FROM (SELECT c.id, c.x, c.y, l.id AS lid, {_T} AS t FROM c, lines l) c JOIN lines l ON l.id = c.lid), nl AS (SELECT id, min(round(d, 1)) AS near_dist, min_by(line, struct_pack(a := round(d, 1), b := line)) AS near_id FROM prs GROUP BY id),
k AS (SELECT a.id FROM diamonds a, sites b WHERE {_MEET} UNION SELECT b.id FROM nodes a, diamonds b WHERE {_NEAR_NODE})
SELECT c.id, round(c.area_m2, 3) AS area_m2, nl.near_dist AS line_dist_m, l.voltage_v, CASE WHEN k.id IS NULL THEN 'new' ELSE 'known' END AS status, round(c.confidence * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * exp(-nl.near_dist / 2000)), 4) AS rank_score
FROM c JOIN nl USING (id) JOIN lines l ON l.id = nl.near_id LEFT JOIN k ON k.id = c.id""")
def postprocess_run(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' polygons above a floor: nearest line with its voltage, known or new, rank. A node counts inside the polygon only."""
    nodes = view(spark, d, "nodes").select("id", "x", "y")
    c = leads.postprocess(polygons(spark, d, "diamonds").select("id", "rings", "confidence"), view(spark, d, "lines"), polygons(spark, d, "sites"), nodes, 500000.0, radius=0.0, size=CELL_M)
    return c.select("id", F.round("area_m2", 3).alias("area_m2"), F.col("near_dist").alias("line_dist_m"), "voltage_v", "status", "rank_score")


_ENDS = f"""{ctes("ends", "subs", "cand")}, {_nearest("n", "ends", "subs")}, e AS (SELECT ends.id, x, y FROM ends JOIN n USING (id) WHERE near_dist > 700), p AS (SELECT a.id AS e, b.id AS c, {_D} AS d FROM e a, cand b WHERE {_D} <= 5000)"""


@registered(ENTRIES, f"""{_ENDS} SELECT c AS id, any_value(k.confidence) AS score, round(min(d), 1) AS min_dist, count(DISTINCT e) AS n_endpoints, min_by(e, struct_pack(d := d, e := e)) AS best_end FROM p JOIN cand k ON k.id = p.c GROUP BY c""")
def endpoint_leads_run(spark: SparkSession, d: str) -> DataFrame:
    """Candidates near line ends that no substation explains, each with its best end."""
    c = view(spark, d, "cand").select("id", "x", "y", F.col("confidence").alias("score"))
    found, _ = leads.endpoint_leads(view(spark, d, "ends"), view(spark, d, "subs"), c)
    return found.select("id", "score", "min_dist", "n_endpoints", "best_end")


@registered(ENTRIES, f"""{_ENDS}, m AS (SELECT e, count(*) AS n FROM p GROUP BY e) SELECT n_candidates, count(*) AS n_ends FROM (SELECT coalesce(m.n, 0) AS n_candidates FROM e LEFT JOIN m ON m.e = e.id) GROUP BY 1""")
def endpoint_match_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates the unexplained line ends have, also none."""
    c = view(spark, d, "cand").select("id", "x", "y", F.col("confidence").alias("score"))
    _, ends = leads.endpoint_leads(view(spark, d, "ends"), view(spark, d, "subs"), c)
    return ends.groupBy("n_candidates").agg(F.count("*").alias("n_ends"))


@registered(ENTRIES, f"""{ctes("diamonds")}, t AS (SELECT ix, iy, ix * 8000 AS xmin, iy * 8000 AS ymin FROM range(0, 21) a(ix), range(0, 17) b(iy))
SELECT DISTINCT ix * 100 + iy AS id FROM t, diamonds d WHERE d.cx - d.r - 1200 < xmin + 8000 AND d.cx + d.r + 1200 > xmin AND d.cy - d.r - 1200 < ymin + 8000 AND d.cy + d.r + 1200 > ymin""")
def tiles_near_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 8 km that the surroundings of a candidate touch."""
    t = spark.range(21 * 17).selectExpr("id % 21 AS ix", "id DIV 21 AS iy").selectExpr("ix * 100 + iy AS id", "CAST(ix * 8000 AS DOUBLE) AS xmin", "CAST(iy * 8000 AS DOUBLE) AS ymin", "CAST(ix * 8000 + 8000 AS DOUBLE) AS xmax", "CAST(iy * 8000 + 8000 AS DOUBLE) AS ymax")
    return regions.tiles_near(t, polygons(spark, d, "diamonds"), 1200.0, CELL_M).select("id")


_DX, _DY = "abs(b.cx - a.cx)", "abs(b.cy - a.cy)"
# From a point to a diamond: to its hole's side from within, 0 inside, to a side, or to a corner.
_TO_POINT = f"""CASE WHEN {_DX} + {_DY} < a.hole THEN (a.hole - {_DX} - {_DY}) / sqrt(CAST(2 AS DOUBLE)) WHEN {_DX} + {_DY} <= a.r THEN 0 WHEN abs({_DX} - {_DY}) <= a.r THEN ({_DX} + {_DY} - a.r) / sqrt(CAST(2 AS DOUBLE))
ELSE sqrt(pow(greatest({_DX}, {_DY}) - a.r, 2) + pow(least({_DX}, {_DY}), 2)) END"""


@registered(ENTRIES, f"""{ctes("diamonds", "sites")}, p AS (SELECT a.id AS polygon_id, b.id AS site_id, {_TO_POINT} AS dist FROM diamonds a, sites b) SELECT polygon_id, site_id, round(dist, 3) AS dist FROM p WHERE dist <= 800""")
def polygon_point_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances of sites' centres to polygons within 800 m: to sides, corners and holes."""
    s = view(spark, d, "sites").select("id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = regions.near_points(polygons(spark, d, "diamonds"), s, 800.0, CELL_M)
    return near.select("polygon_id", F.col("point_id").alias("site_id"), F.round("dist", 3).alias("dist"))


_GAP = "sqrt(pow(greatest({u} - a.r - b.r, 0), 2) + pow(greatest({v} - a.r - b.r, 0), 2))".format(u=_U, v=_V)


@registered(ENTRIES, f"""{ctes("diamonds", "sites")}, p AS (SELECT a.id AS left_id, b.id AS right_id, CASE WHEN greatest({_U}, {_V}) + b.r < a.hole THEN a.hole - b.r - greatest({_U}, {_V}) ELSE {_GAP} END / sqrt(CAST(2 AS DOUBLE)) AS dist FROM diamonds a, sites b) SELECT left_id, right_id, round(dist, 3) AS dist FROM p WHERE dist <= 500""")
def polygon_polygon_distance(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' polygons and sites no farther apart than 500 m, with their distance; 0 if they meet."""
    near = regions.near_polygons(polygons(spark, d, "diamonds"), polygons(spark, d, "sites"), 500.0, CELL_M)
    return near.select("left_id", "right_id", F.round("dist", 3).alias("dist"))


def _common(p: str, q: str) -> str:
    """Area that squares of two radii share."""
    u = f"greatest(least(a.cx + a.cy + {p}, b.cx + b.cy + {q}) - greatest(a.cx + a.cy - {p}, b.cx + b.cy - {q}), 0)"
    v = f"greatest(least(a.cx - a.cy + {p}, b.cx - b.cy + {q}) - greatest(a.cx - a.cy - {p}, b.cx - b.cy - {q}), 0)"
    return f"{u} * {v} / 2"


_YARDS = f"""{ctes("diamonds", "yards")}, p AS (SELECT a.id AS left_id, b.id AS right_id, 2 * a.r * a.r - 2 * a.hole * a.hole AS own, {_common("a.r", "b.r")} - {_common("a.hole", "b.r")} - {_common("a.r", "b.hole")} + {_common("a.hole", "b.hole")} AS shared FROM diamonds a, yards b WHERE greatest({_U}, {_V}) <= a.r + b.r)"""


@registered(ENTRIES, f"""{_YARDS} SELECT left_id, right_id, round(shared, 3) AS shared_m2 FROM p WHERE shared > 1e-3""")
def polygon_intersection_area(spark: SparkSession, d: str) -> DataFrame:
    """Areas that candidates and yards share, holes on both sides."""
    o = regions.overlaps(polygons(spark, d, "diamonds"), polygons(spark, d, "yards"), CELL_M).where("overlap > 1e-3")
    return o.select("left_id", "right_id", F.round("overlap", 3).alias("shared_m2"))


@registered(ENTRIES, f"""{_YARDS} SELECT left_id, right_id, round(shared, 2) AS shared_m2, round(own - shared, 2) AS left_m2 FROM p WHERE shared > 1e-3""")
def polygon_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and yards that share area: their intersection, and what is left of the candidate, as polygons."""
    made = overlay.overlaid(polygons(spark, d, "diamonds"), polygons(spark, d, "yards"), CELL_M)
    size = lambda name: F.aggregate(name, F.lit(0.0), lambda n, p: n + polygon.area(p))
    return made.select("left_id", "right_id", F.round(size("shared"), 2).alias("shared_m2"), F.round(size("rest"), 2).alias("left_m2"))


@registered(ENTRIES, f"""WITH RECURSIVE {ctes("diamonds").removeprefix("WITH ")}, e AS (SELECT a.id AS a, b.id AS b FROM diamonds a, diamonds b WHERE a.id <> b.id AND {_MEET} AND greatest({_U}, {_V}) + a.r >= b.hole),
r(id, part) AS (SELECT id, id FROM diamonds UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.part), l AS (SELECT part, min(id) AS id FROM r GROUP BY part),
s AS (SELECT l.id, cx + cy AS u, cx - cy AS v, r, hole FROM l JOIN diamonds d ON d.id = l.part),
us AS (SELECT id, u, lead(u) OVER (PARTITION BY id ORDER BY u) AS w FROM (SELECT id, u - r AS u FROM s UNION SELECT id, u + r FROM s UNION SELECT id, u - hole FROM s UNION SELECT id, u + hole FROM s)),
vs AS (SELECT id, v, lead(v) OVER (PARTITION BY id ORDER BY v) AS z FROM (SELECT id, v - r AS v FROM s UNION SELECT id, v + r FROM s UNION SELECT id, v - hole FROM s UNION SELECT id, v + hole FROM s)),
c AS (SELECT DISTINCT s.id, us.u, us.w, vs.v, vs.z FROM us JOIN vs USING (id) JOIN s ON s.id = us.id AND s.u - s.r <= us.u AND s.u + s.r >= us.w AND s.v - s.r <= vs.v AND s.v + s.r >= vs.z AND NOT (s.u - s.hole <= us.u AND s.u + s.hole >= us.w AND s.v - s.hole <= vs.v AND s.v + s.hole >= vs.z)),
a AS (SELECT id, sum((w - u) * (z - v)) / 2 AS area FROM c GROUP BY id) SELECT a.id, n AS n_parts, round(area, 2) AS area_m2 FROM a JOIN (SELECT id, count(*) AS n FROM l GROUP BY id) USING (id)""")
def polygon_union(spark: SparkSession, d: str) -> DataFrame:
    """Polygons that meet as one, with its area; what several cover counts once."""
    p = polygons(spark, d, "diamonds")
    groups = materialize(regions.dissolved(p, CELL_M), "groups")
    parts = groups.hint("merge").join(p.select(F.col("id").alias("k"), "rings"), F.col("part") == F.col("k")).select(F.col("id").alias("group"), "part", "rings")
    size = overlay.union(parts, CELL_M).groupBy("group").agg(F.sum(polygon.area(F.col("rings"))).alias("area"))
    n = groups.groupBy("id").agg(F.count("*").alias("n_parts"))
    return n.hint("merge").join(size, F.col("id") == F.col("group")).select("id", "n_parts", F.round("area", 2).alias("area_m2"))
