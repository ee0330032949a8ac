"""Assembling training sets, and reading and writing features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import grid
from gridwise.operators import dataset
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, table, view
from gridwise.sources import geojson

ENTRIES: dict[str, Entry] = {}


@registered(ENTRIES, f"""{ctes("chips")} SELECT id, source, lang, n_chars, 'en' AS aoi FROM chips WHERE lang = 'en' UNION ALL SELECT id, source, lang, NULL, 'rest' FROM chips WHERE lang <> 'en'""")
def merge_union_nullfill(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "chips")
    a = c.where("lang = 'en'").select("id", "source", "lang", "n_chars", F.lit("en").alias("aoi"))
    return dataset.union([a, c.where("lang <> 'en'").select("id", "source", "lang", F.lit("rest").alias("aoi"))])


@registered(ENTRIES, f"""{ctes("chips")} SELECT id, split, unnest(range(1, CASE WHEN split = 'train' THEN 4 ELSE 2 END))::INTEGER AS copy FROM chips""")
def repeat_oversample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.repeat(view(spark, d, "chips").select("id", "split"), F.when(F.col("split") == "train", 3).otherwise(1))


@registered(ENTRIES, f"""{ctes("chips")}, t AS (SELECT least(1.0::DOUBLE, 400 / count(*)::DOUBLE) AS f FROM chips WHERE source IS NOT NULL), n AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY key, id) AS n, count(*) OVER (PARTITION BY source) AS c FROM chips WHERE source IS NOT NULL)
SELECT id, source FROM n, t WHERE n <= greatest(1, round_even(c * f, 0))""")
def proportional_negative_cap(spark: SparkSession, d: str) -> DataFrame:
    return dataset.proportional_cap(view(spark, d, "chips"), "source", 400, "key", ["id"], 65536).select("id", "source")


@registered(ENTRIES, f"""{ctes("cand")} SELECT id, confidence FROM (SELECT id, confidence, row_number() OVER (PARTITION BY floor(x / 7500), floor(y / 7500) ORDER BY confidence DESC, id) AS n FROM cand) WHERE n = 1""")
def dedupe_grid_first(spark: SparkSession, d: str) -> DataFrame:
    keys = [F.floor(F.col("x") / 7500), F.floor(F.col("y") / 7500)]
    return dataset.first_of(view(spark, d, "cand").select("id", "x", "y", "confidence"), keys, [-F.col("confidence"), F.col("id")]).select("id", "confidence")


@registered(ENTRIES, f"""{ctes("cand")} SELECT kind, id, n::INTEGER AS n FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id) AS n FROM cand) WHERE n <= CASE kind WHEN 'positive' THEN 40 ELSE 20 END""")
def quota_heads(spark: SparkSession, d: str) -> DataFrame:
    return dataset.heads(view(spark, d, "cand"), "kind", {"positive": 40, "line_negative": 20, "background": 20}, [F.desc("confidence"), F.col("id")]).select("kind", "id", "n")


@registered(ENTRIES, f"""{ctes("chips")} SELECT lang, count(*) FILTER (WHERE key % 100 < 20) AS inside, count(*) FILTER (WHERE key % 100 >= 20) AS outside FROM chips GROUP BY lang""")
def hash_sample_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = dataset.sample(view(spark, d, "chips"), F.col("key"), 20)
    both = a.withColumn("in", F.lit(1)).unionByName(b.withColumn("in", F.lit(0)))
    return both.groupBy("lang").agg(F.count_if(F.col("in") == 1).alias("inside"), F.count_if(F.col("in") == 0).alias("outside"))


@registered(ENTRIES, f"""{ctes("cand", "subs")} SELECT id, kind FROM cand WHERE id NOT IN (SELECT id FROM subs)""")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return dataset.resume(view(spark, d, "cand"), view(spark, d, "subs"), "id").select("id", "kind")


@registered(ENTRIES, f"""{ctes("judged")}, n AS (SELECT 'run' || (id % 7) AS run_name, 'r' || (id % 3) AS region, count(*) AS n FROM judged GROUP BY ALL), f AS (SELECT run_name, region, n * 10 AS n FROM n WHERE run_name IN ('run1', 'run2') UNION ALL SELECT 'new', 'r0', 1)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run_name = n.run_name AND f.region = n.region) UNION ALL SELECT * FROM f""")
def report_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "judged").groupBy(F.concat(F.lit("run"), F.col("id") % 7).alias("run_name"), F.concat(F.lit("r"), F.col("id") % 3).alias("region")).agg(F.count("*").alias("n"))
    fresh = n.where(F.col("run_name").isin("run1", "run2")).withColumn("n", F.col("n") * 10)
    fresh = fresh.unionByName(spark.sql("SELECT 'new' AS run_name, 'r0' AS region, 1L AS n"))
    return dataset.upsert(n, fresh, ["run_name", "region"])


@registered(ENTRIES, f"""{ctes("cand")} SELECT id, lon, lat, kind FROM cand WHERE id % 10 <> 3 AND kind <> 'background'""")
def geojson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Features to text lines, some of them blank, cut short or led by a record separator, and back."""
    c = view(spark, d, "cand").where("kind <> 'background'")
    lines = geojson.to_lines(c, ["id", "kind"])
    damaged = lines.withColumn("value", F.when(F.col("id") % 10 == 3, F.substring("value", 1, 20)).when(F.col("id") % 10 == 4, F.concat(F.lit("\x1e"), "value")).otherwise(F.col("value")))
    damaged = damaged.select("value").unionByName(spark.sql("SELECT '' AS value UNION ALL SELECT '  '"))
    back = geojson.parse(damaged, "id long, kind string")
    return back.select("properties.id", "lon", "lat", "properties.kind")


@registered(ENTRIES, """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type", (F.col("p.k") % 5).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@registered(ENTRIES, f"""{ctes("subs")}, v AS (SELECT id, area_m2, CASE WHEN area_m2 >= 20000 THEN 'pos' ELSE 'small' END AS role FROM subs), u AS (SELECT id, area_m2, role FROM v UNION ALL SELECT c_custkey, 0, 'node' FROM customer) SELECT role, count(*) AS n, sum(area_m2) AS area_m2 FROM u GROUP BY role""")
def unified_labels(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "subs")
    polygons = s.select("id", "area_m2", grid.role(F.col("area_m2"), F.lit(None).cast("string"), F.lit(None), 20000).alias("role"))
    nodes = view(spark, d, "nodes").select("id", F.lit(0.0).alias("area_m2"), F.lit("node").alias("role"))
    return dataset.union([polygons, nodes]).groupBy("role").agg(F.count("*").alias("n"), F.sum("area_m2").alias("area_m2"))


@registered(ENTRIES, """WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view') AND ts >= (SELECT min(ts) FROM events)) SELECT user_id, event_id, value, n::INTEGER AS n FROM i WHERE n <= 3""")
def scene_search_topn(spark: SparkSession, d: str) -> DataFrame:
    """The three least clouded scenes of each cell (value stands for the cloud cover)."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.coalesce("value", F.lit(100.0)), "ts", "event_id"))
    return e.withColumn("n", n).where("n <= 3").select("user_id", "event_id", "value", "n")
