"""Draws until a quota is met, and map elements: nodes are parts, ways are orders, relations are customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions import polygon
from gridwise.operators import dataset, elements
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, table, view
from gridwise.plans.sampling import _u
from gridwise.plans.spatials import _D
from gridwise.session import materialize

ENTRIES: dict[str, Entry] = {}

_DRAWS = f"""{ctes("subs", "nodes")}, g AS (SELECT n_nationkey AS g, (n_nationkey % 5) * 32000 AS xmin, (n_nationkey // 5) * 26000 AS ymin, 15 + n_nationkey % 8 * 5 AS quota FROM nation), n AS (SELECT *, g * 1000003 + k AS key FROM g, range(0, 60) r(k)),
p AS (SELECT g, k, quota, xmin + 32000 * {_u("key", 42)} AS x, ymin + 26000 * {_u("key", 43)} AS y FROM n), c AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM subs b WHERE {_D} <= 1500) AND NOT EXISTS (SELECT 1 FROM nodes b WHERE {_D} <= 700)),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY k) <= quota)"""


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS group", "CAST((n_nationkey % 5) * 32000 AS DOUBLE) AS xmin", "CAST((n_nationkey DIV 5) * 26000 AS DOUBLE) AS ymin", "15 + n_nationkey % 8 * 5 AS quota")
    g = g.withColumn("xmax", F.col("xmin") + 32000).withColumn("ymax", F.col("ymin") + 26000)
    return dataset.drawn(g, [(view(spark, d, "subs").select("id", "x", "y"), 1500.0), (view(spark, d, "nodes").select("id", "x", "y"), 700.0)], 60)


@registered(ENTRIES, f"""{_DRAWS} SELECT g AS "group", k, round(x, 4) AS x, round(y, 4) AS y FROM t""")
def quota_draws(spark: SparkSession, d: str) -> DataFrame:
    """Random points in each province, clear of substations and nodes, until its quota is met or 60 draws are used up."""
    return _drawn(spark, d)[0].select("group", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@registered(ENTRIES, f"""{_DRAWS} SELECT g.g AS "group", count(t.g) AS got, any_value(g.quota) - count(t.g) AS lacking FROM g LEFT JOIN t ON t.g = g.g GROUP BY g.g""")
def quota_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """How many of those points each province got, and lacks."""
    return _drawn(spark, d)[1]


_BOX = (60000.0, 40000.0, 66000.0, 46000.0)


@registered(ENTRIES, f"""WITH RECURSIVE {ctes("cand").removeprefix("WITH ")}, inside AS (SELECT id FROM cand WHERE x BETWEEN {_BOX[0]} AND {_BOX[2]} AND y BETWEEN {_BOX[1]} AND {_BOX[3]}), win AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT id FROM inside)),
m AS (SELECT 1000000000 + o_custkey AS relation, o_orderkey AS ref, 'way' AS kind FROM orders UNION ALL SELECT 2000000000 + c_nationkey, 1000000000 + c_custkey, 'relation' FROM customer UNION ALL SELECT 3000000000 + n_regionkey, 2000000000 + n_nationkey, 'relation' FROM nation),
rel(id) AS (SELECT DISTINCT relation FROM m WHERE kind = 'way' AND ref IN (SELECT id FROM win) UNION SELECT m.relation FROM m JOIN rel ON m.kind = 'relation' AND m.ref = rel.id),
w AS (SELECT id FROM win UNION SELECT ref FROM m JOIN rel ON rel.id = m.relation WHERE kind = 'way' AND ref IN (SELECT l_orderkey FROM lineitem)), n AS (SELECT id FROM inside UNION SELECT l_partkey FROM lineitem JOIN w ON w.id = l_orderkey WHERE l_partkey IN (SELECT id FROM cand))
SELECT 'node' AS kind, count(*) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS ids FROM n UNION ALL SELECT 'way', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM w UNION ALL SELECT 'relation', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM rel""")
def clipped_elements(spark: SparkSession, d: str) -> DataFrame:
    """What a box of 6 km takes, with all of the relations that it touches and those above them."""
    nodes = view(spark, d, "cand").select("id", "x", "y")
    ways = table(spark, d, "lineitem").selectExpr("l_orderkey AS way", "l_linenumber AS pos", "l_partkey AS node")
    members = table(spark, d, "orders").selectExpr("1000000000L + o_custkey AS relation", "'way' AS kind", "'' AS role", "o_orderkey AS ref")
    members = members.unionByName(table(spark, d, "customer").selectExpr("2000000000L + c_nationkey AS relation", "'relation' AS kind", "'' AS role", "1000000000L + c_custkey AS ref"))
    members = members.unionByName(table(spark, d, "nation").selectExpr("3000000000L + n_regionkey AS relation", "'relation' AS kind", "'' AS role", "2000000000L + n_nationkey AS ref"))
    n, w, r = elements.clipped(nodes, ways, members, _BOX)
    total = lambda df, kind: df.toDF("id").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).cast("long").alias("ids"))
    return total(n, "node").unionByName(total(w, "way")).unionByName(total(r, "relation"))


@registered(ENTRIES, """WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m, l_returnflag = 'R' AND l_linenumber = 1 AS gone FROM lineitem),
p AS (SELECT *, CAST((o * 31 + i * i * 17) % 101 AS DOUBLE) AS x, CAST((o * 7 + i * 29) % 103 AS DOUBLE) AS y FROM l), s AS (SELECT a.o, a.gone, a.x * b.y - b.x * a.y AS c FROM p a JOIN p b ON b.o = a.o AND b.i = a.i % a.m + 1)
SELECT o AS relation, NOT bool_or(gone) AS closed, count(*) AS n_ways, CASE WHEN bool_or(gone) THEN 0 ELSE abs(sum(c)) / 2 END AS area FROM s GROUP BY o""")
def rings_of_ways(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a ring of ways, one for each line, some drawn backwards and some missing: closed ones with their area."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_returnflag", "l_partkey")
    all_ = l.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey"))).alias("ls")).withColumn("m", F.size("ls"))
    l = materialize(all_.select("o", "m", F.posexplode("ls").alias("i", "l")).selectExpr("o", "m", "i + 1 AS i", "l.*", "l.l_returnflag = 'R' AND l.l_linenumber = 1 AS gone"), "lines")
    nodes = l.selectExpr("o * 1000 + i AS id", "CAST((o * 31 + i * i * 17) % 101 AS DOUBLE) AS x", "CAST((o * 7 + i * 29) % 103 AS DOUBLE) AS y")
    two = "IF(l_partkey % 2 = 0, array(struct(1 AS pos, o * 1000 + i AS node), struct(2 AS pos, o * 1000 + i % m + 1 AS node)), array(struct(2 AS pos, o * 1000 + i AS node), struct(1 AS pos, o * 1000 + i % m + 1 AS node)))"
    ways = l.where("NOT gone").selectExpr("o * 1000 + i AS way", f"explode({two}) AS p").select("way", "p.pos", "p.node")
    members = l.selectExpr("o AS relation", "'way' AS kind", "'outer' AS role", "o * 1000 + i AS ref")
    rings, loose = elements.rings_of(nodes, ways, members)
    closed = rings.select("relation", F.lit(True).alias("closed"), (F.size("points") - 1).cast("long").alias("n_ways"), polygon.area(F.array("points")).alias("area"))
    return closed.unionByName(loose.groupBy("relation").agg(F.lit(False).alias("closed"), F.count("*").alias("n_ways"), F.lit(0.0).alias("area")))
