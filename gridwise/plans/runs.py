"""Runs composed of several operators, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwise.functions import grid, polygon, scores
from gridwise.operators import dataset, leads, ranking, raster, regions, shapes, spatial
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import PIXELS, ctes, polygons, tiles, view
from gridwise.plans.polygons import _MEET, _NEAR_NODE, _U, _V, CELL_M, _shared
from gridwise.plans.spatials import _D, _nearest, _nearest_line
from gridwise.session import materialize

ENTRIES: dict[str, Entry] = {}


@registered(ENTRIES, f"""{ctes("diamonds", "sites", "nodes")}, h AS (SELECT a.id FROM diamonds a, sites b WHERE {_MEET} UNION SELECT b.id FROM nodes a, diamonds b WHERE {_NEAR_NODE}), t AS (SELECT d.id, confidence AS s, (h.id IS NOT NULL)::INT AS truth FROM diamonds d LEFT JOIN h USING (id)),
r AS (SELECT truth, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / CAST(2 AS DOUBLE) AS r, row_number() OVER (ORDER BY s DESC, id) AS n FROM t), f AS (SELECT count(DISTINCT b.id) AS found FROM diamonds a, sites b WHERE {_MEET})
SELECT count(*) AS candidates, CAST(sum(truth) AS BIGINT) AS hits, any_value(found) AS sites_found, round((sum(r * truth) - sum(truth) * (sum(truth) + 1) / CAST(2 AS DOUBLE)) / (sum(truth) * (count(*) - sum(truth))), 6) AS auc, avg(truth) FILTER (WHERE n <= 20) AS p20, avg(truth) FILTER (WHERE n <= 50) AS p50 FROM r, f""")
def field_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Candidates against mapped sites and nodes: hits, sites found, area under the curve, precision at 20 and 50."""
    c, sites = polygons(spark, d, "diamonds").select("id", "rings", "confidence"), polygons(spark, d, "sites")
    t = regions.with_known(c, sites, view(spark, d, "nodes").select("id", "x", "y"), 0.0, CELL_M).withColumn("truth", (F.col("status") == "known").cast("int"))
    t = materialize(t.select("id", "confidence", "truth"), "truth")
    m = ranking.compared(t, {"conf": F.col("confidence")}, "truth", [20, 50], F.col("id")).drop("variant")
    n = t.agg(F.count("*").alias("candidates"), F.sum(F.col("truth").cast("long")).alias("hits"))
    found = regions.marked(sites, c, CELL_M, "found").agg(F.count_if("found").alias("sites_found"))
    return n.crossJoin(found).crossJoin(m)


@registered(ENTRIES, f"""{ctes("diamonds", "sites", "nodes")}, s AS (SELECT b.id, sum(o) AS o FROM (SELECT b.id, {_shared("a.r")} - {_shared("a.hole")} AS o FROM diamonds a, sites b WHERE greatest({_U}, {_V}) <= a.r + b.r) b WHERE o > 0 GROUP BY b.id),
p AS (SELECT id, cx AS x, cy AS y, r FROM sites), u AS (SELECT DISTINCT a.id FROM p a, nodes b WHERE b.segment = 'BUILDING' AND {_D} <= 1200), f AS (SELECT p.id, (p.id * 37 % 101) / CAST(100 AS DOUBLE) AS base, u.id IS NOT NULL AS flag_urban, coalesce(o, 0) / (2 * r * r) > 0.25 AS flag_building FROM p LEFT JOIN s USING (id) LEFT JOIN u ON u.id = p.id)
SELECT id, flag_urban, flag_building, flag_urban OR flag_building AS flagged, round(base * CASE WHEN flag_urban THEN CAST(0.3 AS DOUBLE) ELSE 1 END * CASE WHEN flag_building THEN CAST(0.3 AS DOUBLE) ELSE 1 END, 4) AS score FROM f""")
def lead_flags_run(spark: SparkSession, d: str) -> DataFrame:
    """Leads near settlements or much under buildings count less."""
    f = regions.fill(polygons(spark, d, "sites"), polygons(spark, d, "diamonds"), CELL_M)
    f = f.withColumnsRenamed({"cx": "x", "cy": "y"}).withColumn("base", (F.col("id") * 37 % 101) / 100.0)
    f = leads.flagged(f, view(spark, d, "nodes").where("segment = 'BUILDING'").select("id", "x", "y"), 1200.0, F.col("base"))
    return f.select("id", "flag_urban", "flag_building", "flagged", F.round("score", 4).alias("score"))


@registered(ENTRIES, f"""{_nearest_line(ctes("cand", "lines", "ends", "subs"), "cand")}, {_nearest("ne", "ends", "subs")}, far AS (SELECT e.id, e.x, e.y FROM ends e JOIN ne USING (id) WHERE near_dist > 700), e AS (SELECT a.id, round(min({_D}), 1) AS endpoint_dist, count(*) AS n FROM cand a, far b WHERE {_D} < 5000 GROUP BY a.id)
SELECT c.id, e.endpoint_dist, e.n AS n_endpoints, nl.near_dist AS line_dist, c.area_m2 < 20000 AS below_floor, round(c.confidence * exp(-e.endpoint_dist / 2000) * exp(-nl.near_dist / 500), 4) AS score FROM cand c JOIN e USING (id) JOIN nl USING (id) ORDER BY below_floor, score DESC, id LIMIT 100""")
def regional_run(spark: SparkSession, d: str) -> DataFrame:
    """Candidates near unexplained line ends by how near these and lines are; large ones first, a hundred."""
    ends = leads.unexplained(view(spark, d, "ends"), view(spark, d, "subs"), 700.0)
    c = leads.with_endpoints(view(spark, d, "cand"), ends, 5000.0).where("n_endpoints > 0")
    c = spatial.nearest(c, view(spark, d, "lines").drop("voltage_v"), 500.0)
    c = c.select("id", "endpoint_dist", "n_endpoints", F.col("near_dist").alias("line_dist"), (F.col("area_m2") < 20000).alias("below_floor"), scores.regional_rank(F.col("confidence"), F.col("endpoint_dist"), F.col("near_dist")).alias("score"))
    return c.orderBy("below_floor", F.desc("score"), "id").limit(100)


_BUCKET = "CASE WHEN {0} >= 10000 THEN '10k-20k' WHEN {0} >= 5000 THEN '5k-10k' WHEN {0} >= 2000 THEN '2k-5k' WHEN {0} >= 1000 THEN '1k-2k' END"


@registered(ENTRIES, f"""{ctes("subs", "cand")}, t AS (SELECT s.id, {_BUCKET.format("area_m2")} AS bucket, EXISTS (SELECT 1 FROM cand b WHERE sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) <= 2000) AS hit FROM subs s WHERE area_m2 < 20000), n AS (SELECT unnest(['1k-2k', '2k-5k', '5k-10k', '10k-20k']) AS bucket)
SELECT n.bucket, count(t.id) AS installations, coalesce(CAST(sum(hit::INT) AS BIGINT), 0) AS detected, avg(hit::INT) AS recall FROM n LEFT JOIN t ON t.bucket = n.bucket GROUP BY n.bucket""")
def small_target_audit(spark: SparkSession, d: str) -> DataFrame:
    """Small substations with a candidate near, by size."""
    s = spatial.marked(view(spark, d, "subs").where("area_m2 < 20000"), view(spark, d, "cand").select("id", "x", "y"), 2000.0, "hit")
    a = F.col("area_m2")
    return ranking.recall_by(s, F.when(a >= 10000, "10k-20k").when(a >= 5000, "5k-10k").when(a >= 2000, "2k-5k").when(a >= 1000, "1k-2k"), "hit", ["1k-2k", "2k-5k", "5k-10k", "10k-20k"])


_VOLTAGE = "list_max(list_transform(regexp_extract_all(voltage, '(\\d+(?:\\.\\d+)?)', 1), lambda v: CAST(v AS DOUBLE)))"


@registered(ENTRIES, f"""{ctes("subs", "cand")}, v AS (SELECT *, {_VOLTAGE} AS v FROM subs), t AS (SELECT CASE WHEN v >= 220000 THEN '>=220kV' WHEN v >= 66000 THEN '66-220kV' ELSE '<66kV/unknown' END AS bucket, EXISTS (SELECT 1 FROM cand b WHERE sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) <= 1500) AS hit FROM v s WHERE x BETWEEN 20000 AND 140000 AND y BETWEEN 10000 AND 120000)
SELECT bucket, count(*) AS installations, CAST(sum(hit::INT) AS BIGINT) AS detected, round(avg(hit::INT), 6) AS recall FROM t GROUP BY bucket""")
def corridor_recall(spark: SparkSession, d: str) -> DataFrame:
    """Substations inside a box with a candidate near, by voltage."""
    s = view(spark, d, "subs").where(F.col("x").between(20000, 140000) & F.col("y").between(10000, 120000))
    s = spatial.marked(s, view(spark, d, "cand").select("id", "x", "y"), 1500.0, "hit").withColumn("bucket", grid.voltage_bucket(grid.voltage(F.col("voltage"))))
    return s.groupBy("bucket").agg(F.count("*").alias("installations"), F.sum(F.col("hit").cast("long")).alias("detected"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))


@registered(ENTRIES, f"""{ctes("subs", "nodes")}, big AS (SELECT id, x, y, area_m2, CASE WHEN id % 3 = 0 THEN 'refined' END AS status FROM subs WHERE id % 2 = 0), l AS (SELECT id, CASE WHEN area_m2 >= 20000 AND coalesce(status NOT IN ('no_signal', 'village'), true) THEN 'pos' ELSE 'small' END AS role, area_m2, CASE WHEN refined IS NULL THEN 'plain' ELSE 'refined' END AS origin FROM (SELECT s.id, coalesce(b.area_m2 * CAST(0.5 AS DOUBLE), s.area_m2) AS area_m2, s.status, b.id AS refined FROM subs s LEFT JOIN big b ON b.id = s.id) UNION ALL SELECT id, 'node', 0, 'node' FROM nodes)
SELECT origin, role, count(*) AS n, sum(area_m2) AS area_m2 FROM l GROUP BY ALL""")
def labels_with_refined(spark: SparkSession, d: str) -> DataFrame:
    """Labels of three sources: refined outlines where there are, plain ones else, and nodes."""
    s = view(spark, d, "subs")
    better = s.where("id % 2 = 0").select("id", (F.col("area_m2") * 0.5).alias("area_m2"))
    l = leads.labels(s, better, view(spark, d, "nodes"), 20000.0)
    return l.groupBy("origin", "role").agg(F.count("*").alias("n"), F.sum("area_m2").alias("area_m2"))


@registered(ENTRIES, f"""{ctes("cand", "subs")}, p AS (SELECT n_name AS province, (n_nationkey % 5) * 32000 AS x0, (n_nationkey // 5) * 26000 AS y0 FROM nation), c AS (SELECT p.province, count(c.id) AS n_new FROM p LEFT JOIN cand c ON c.status = 'refined' AND x >= x0 AND x < x0 + 32000 AND y >= y0 AND y < y0 + 26000 GROUP BY 1), k AS (SELECT p.province, count(s.id) AS n_known FROM p LEFT JOIN subs s ON x >= x0 AND x < x0 + 32000 AND y >= y0 AND y < y0 + 26000 GROUP BY 1)
SELECT province, n_new, n_known, row_number() OVER (ORDER BY n_new DESC, province)::INTEGER AS place FROM c JOIN k USING (province)""")
def province_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Provinces by their new leads, with the known ones."""
    p = spark.read.parquet(f"{d}/nation.parquet")
    x, y = (F.col("n_nationkey") % 5) * 32000, F.floor(F.col("n_nationkey") / 5) * 26000
    p = p.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("province"), F.array(polygon.box_ring(x, y, x + 32000, y + 26000)).alias("rings"))
    out = leads.densities(p, regions.points_in(view(spark, d, "cand").where("status = 'refined'").select("id", "x", "y"), p, 10000.0), least_area=1e6)
    known = regions.points_in(view(spark, d, "subs").select("id", "x", "y"), p, 10000.0).groupBy(F.col("polygon_id").alias("k")).agg(F.count("*").alias("n_known"))
    out = out.join(known, F.col("id") == F.col("k"), "left").withColumn("n_known", F.coalesce("n_known", F.lit(0).cast("long")))
    # One row a province.
    return out.select("province", "n_new", "n_known", F.row_number().over(Window.orderBy(F.desc("n_new"), "province")).alias("place"))


@registered(ENTRIES, f"""WITH RECURSIVE {PIXELS}, g AS (SELECT * FROM px WHERE p >= 0.6), e AS (SELECT a.id, a.k AS a, b.k AS b FROM g a JOIN g b ON a.id = b.id AND a.k <> b.k AND abs(a.k // 8 - b.k // 8) <= 1 AND abs(a.k % 8 - b.k % 8) <= 1), r(id, k, root) AS (SELECT id, k, k FROM g UNION SELECT r.id, e.b, r.root FROM r JOIN e ON e.id = r.id AND e.a = r.k), l AS (SELECT id, k, min(root) AS label FROM r GROUP BY id, k), n AS (SELECT id, label, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT id, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM n GROUP BY id),
b AS (SELECT id, round(count(*) FILTER (WHERE p >= 0.6 AND k % 8 < 4) / count(*) FILTER (WHERE p >= 0.6)::DOUBLE, 6) AS left_share, bool_or(p = 1 AND k < 8) AS top_bright, bool_and(p < 1 OR k >= 8) AS top_dark FROM px GROUP BY id) SELECT id, share, coalesce(left_share, 0) AS left_share, top_bright, top_dark FROM b JOIN s USING (id)""")
def piece_shares(spark: SparkSession, d: str) -> DataFrame:
    """The largest bright piece's share of each tile's, the left half's share, and whether any or none of the first row is brightest."""
    t = tiles(spark, d)
    sizes = raster.hysteresis_pixels(t, 0.6, diagonal=True).groupBy("id", "label").agg(F.count("*").alias("n_pixels"))
    own = shapes.dominant_share(sizes, ["id"]).select(F.col("id").alias("i"), F.round("share", 6).alias("share"))
    px = raster.pixels(t)
    bright, left, top = F.col("p") >= 0.6, F.col("col") < 4, (F.col("p") == 1) & (F.col("row") == 0)
    half = shapes.share_of(px, left, bright, "id").select(F.col("id").alias("j"), F.round("share", 6).alias("left_share"))
    edge = px.groupBy("id").agg(F.bool_or(top).alias("top_bright"), F.bool_and(~top).alias("top_dark"))
    return edge.join(own, F.col("id") == F.col("i")).join(half, F.col("id") == F.col("j")).select("id", "share", "left_share", "top_bright", "top_dark")


@registered(ENTRIES, f"""{ctes("nodes")}, g AS (SELECT floor(y / 5000)::BIGINT AS band, x - lag(x) OVER (PARTITION BY floor(y / 5000) ORDER BY x, id) AS gap FROM nodes) SELECT band, count(gap) AS n, median(gap) AS middle, max(gap) AS largest FROM g WHERE gap > 1 GROUP BY band""")
def gaps_in_bands(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between neighbours along bands of 5 km: median and largest, those up to a metre left out."""
    n = view(spark, d, "nodes").withColumn("band", F.floor(F.col("y") / 5000))
    g = n.withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy("band").orderBy("x", "id"))).where("gap > 1")
    return g.groupBy("band").agg(F.count("gap").alias("n"), F.median("gap").alias("middle"), F.max("gap").alias("largest"))


@registered(ENTRIES, f"""{ctes("cand", "subs", "nodes")}, t AS (SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) * 1000 + CAST(floor(y / 10000) AS BIGINT) AS tile FROM cand), h AS (SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) * 1000 + CAST(floor(y / 10000) AS BIGINT) AS tile FROM subs), n AS (SELECT DISTINCT CAST(floor(x / 10000) AS BIGINT) * 1000 + CAST(floor(y / 10000) AS BIGINT) AS tile FROM nodes)
SELECT 'rest' AS pool, * FROM (SELECT tile FROM t EXCEPT SELECT tile FROM h ORDER BY tile LIMIT 30) UNION ALL SELECT 'both', * FROM (SELECT tile FROM h INTERSECT SELECT tile FROM n ORDER BY tile LIMIT 30)""")
def tile_pools(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with candidates and without substations, and those with substations and nodes; thirty of each."""
    tile = lambda name: view(spark, d, name).select((F.floor(F.col("x") / 10000) * 1000 + F.floor(F.col("y") / 10000)).alias("tile"))
    rest, both = dataset.pools(tile("cand"), tile("subs"), 30), dataset.pools(tile("subs"), tile("nodes"), 30, inside=True)
    return rest.select(F.lit("rest").alias("pool"), "tile").unionByName(both.select(F.lit("both").alias("pool"), "tile"))


@registered(ENTRIES, f"""{ctes("chips")}, p AS (SELECT id, source AS tile, split, key, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS prio FROM chips WHERE source IS NOT NULL) SELECT tile, arg_min(split, struct_pack(a := prio, b := key, c := id)) AS split, min(prio)::INTEGER AS prio, count(*) AS n FROM p GROUP BY tile""")
def split_of_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The split of each tile's first chip by priority, key and id."""
    p = view(spark, d, "chips").where("source IS NOT NULL").withColumn("prio", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2))
    return p.groupBy(F.col("source").alias("tile")).agg(F.min_by("split", F.struct("prio", "key", "id")).alias("split"), F.min("prio").alias("prio"), F.count("*").alias("n"))


@registered(ENTRIES, f"""{ctes("diamonds", "sites")}, chips AS (SELECT ix * 1000 + iy AS id, ix * 6000 AS xmin, iy * 6000 AS ymin FROM range(0, 27) a(ix), range(0, 22) b(iy)), c AS (SELECT s.id AS site, CAST(floor(cx / 6000) AS BIGINT) * 1000 + CAST(floor(cy / 6000) AS BIGINT) AS chip, r FROM sites s) SELECT chip, count(*) AS n_sites, max(r) AS largest FROM c JOIN chips ON chips.id = c.chip GROUP BY chip""")
def chips_with_sites(spark: SparkSession, d: str) -> DataFrame:
    """Chips with sites' centres in them: the chip of each point, and how many it has."""
    s = view(spark, d, "sites").select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), "r")
    x, y = F.col("ix") * 6000, F.col("iy") * 6000
    chips = spark.range(27 * 22).selectExpr("id % 27 AS ix", "id DIV 27 AS iy").select((F.col("ix") * 1000 + F.col("iy")).alias("id"), F.array(polygon.box_ring(x, y, x + 6000, y + 6000)).alias("rings"))
    held = regions.points_in(s.select("id", "x", "y"), chips, 6000.0)
    return held.join(s.select(F.col("id").alias("s"), "r"), F.col("point_id") == F.col("s")).groupBy(F.col("polygon_id").alias("chip")).agg(F.count("*").alias("n_sites"), F.max("r").alias("largest"))
