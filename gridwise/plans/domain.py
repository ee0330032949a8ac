"""Domain tables derived from the supplied ones, as expressions that Spark SQL and DuckDB read alike.

Coordinates are integers by modular arithmetic, so both engines work with the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions, condition)
VIEWS: dict[str, tuple[str, list[str], str]] = {
    "cand": (
        "part",
        [
            "p_partkey AS id",
            "CAST((p_partkey * 7919) % 160000 AS DOUBLE) AS x",
            "CAST((p_partkey * 104729) % 130000 AS DOUBLE) AS y",
            "CAST((p_partkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence",
            "CAST((p_partkey * 613) % 40000 AS DOUBLE) AS area_m2",
            "CAST(6000 + (p_partkey * 7919) % 1600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon",
            "CAST(2300 + (p_partkey * 104729) % 1300 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat",
            "CASE p_partkey % 5 WHEN 0 THEN 'village' WHEN 1 THEN 'no_signal' WHEN 2 THEN 'tight' ELSE 'refined' END AS status",
            "CASE p_partkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'line_negative' ELSE 'background' END AS kind",
        ],
        "true",
    ),
    "subs": (
        "supplier",
        [
            "s_suppkey AS id",
            "CAST((s_suppkey * 15485863) % 160000 AS DOUBLE) AS x",
            "CAST((s_suppkey * 32452843) % 130000 AS DOUBLE) AS y",
            "CAST((s_suppkey * 911) % 45000 AS DOUBLE) AS area_m2",
            "CASE s_suppkey % 6 WHEN 0 THEN '220000' WHEN 1 THEN '132000;66000' WHEN 2 THEN '66 kV' WHEN 3 THEN 'abc' WHEN 4 THEN '400000.5' ELSE NULL END AS voltage",
            "CASE s_suppkey % 4 WHEN 0 THEN 'village' WHEN 1 THEN 'no_signal' WHEN 2 THEN NULL ELSE 'refined' END AS status",
            "CAST(6000 + (s_suppkey * 15485863) % 1600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon",
            "CAST(2300 + (s_suppkey * 32452843) % 1300 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat",
        ],
        "true",
    ),
    "nodes": ("customer", ["c_custkey AS id", "CAST((c_custkey * 49979687) % 160000 AS DOUBLE) AS x", "CAST((c_custkey * 67867967) % 130000 AS DOUBLE) AS y", "c_mktsegment AS segment"], "true"),
    "lines": (
        "orders",
        [
            "o_orderkey AS id",
            "CAST((o_orderkey * 7907) % 160000 AS DOUBLE) AS x0",
            "CAST((o_orderkey * 6101) % 130000 AS DOUBLE) AS y0",
            "CAST((o_orderkey * 7907) % 160000 + (o_custkey * 37) % 4001 - 2000 AS DOUBLE) AS x1",
            "CAST((o_orderkey * 6101) % 130000 + (o_custkey * 91) % 4001 - 2000 AS DOUBLE) AS y1",
            "CASE o_orderkey % 4 WHEN 0 THEN CAST(66000 AS DOUBLE) WHEN 1 THEN CAST(132000 AS DOUBLE) WHEN 2 THEN CAST(220000 AS DOUBLE) ELSE NULL END AS voltage_v",
        ],
        "true",
    ),
    "ends": ("events", ["event_id AS id", "CAST((event_id * 7321) % 160000 AS DOUBLE) AS x", "CAST((event_id * 8713) % 130000 AS DOUBLE) AS y", "event_type AS class"], "event_type = 'error'"),
    "diamonds": (
        "part",
        [
            "p_partkey AS id",
            "CAST((p_partkey * 7919) % 160000 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS cx",
            "CAST((p_partkey * 104729) % 130000 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS cy",
            "CAST(200 + (p_partkey * 31) % 900 AS DOUBLE) AS r",
            "CASE WHEN p_partkey % 4 = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hole",
            "CAST((p_partkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence",
            "1 + (p_partkey * 17) % 40 AS n_pixels",
        ],
        "true",
    ),
    "sites": (
        "supplier",
        [
            "s_suppkey AS id",
            "CAST((s_suppkey * 15485863) % 160000 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS cx",
            "CAST((s_suppkey * 32452843) % 130000 AS DOUBLE) + CAST(0.75 AS DOUBLE) AS cy",
            "CAST(300 + (s_suppkey * 53) % 2500 AS DOUBLE) AS r",
            "CAST(0 AS DOUBLE) AS hole",
        ],
        "true",
    ),
    "yards": (
        "supplier",
        [
            "s_suppkey AS id",
            "CAST((s_suppkey * 15485863) % 160000 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS cx",
            "CAST((s_suppkey * 32452843) % 130000 AS DOUBLE) + CAST(0.75 AS DOUBLE) AS cy",
            "CAST(300 + (s_suppkey * 53) % 2500 AS DOUBLE) AS r",
            "CASE WHEN s_suppkey % 2 = 0 THEN CAST(100 + (s_suppkey * 53) % 2500 / CAST(2 AS DOUBLE) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hole",
        ],
        "true",
    ),
    "boxes": (
        "part",
        [
            "p_partkey AS id",
            "CAST((p_partkey * 2741) % 30000 AS DOUBLE) AS xmin",
            "CAST((p_partkey * 5527) % 30000 AS DOUBLE) AS ymin",
            "CAST((p_partkey * 2741) % 30000 + 20 + p_size * 3 AS DOUBLE) AS xmax",
            "CAST((p_partkey * 5527) % 30000 + 30 + p_size * 2 AS DOUBLE) AS ymax",
        ],
        "true",
    ),
    "lead_boxes": (
        "supplier",
        ["s_suppkey AS id", "CAST((s_suppkey * 9091) % 30000 AS DOUBLE) AS xmin", "CAST((s_suppkey * 7043) % 30000 AS DOUBLE) AS ymin", "CAST((s_suppkey * 9091) % 30000 + 600 AS DOUBLE) AS xmax", "CAST((s_suppkey * 7043) % 30000 + 500 AS DOUBLE) AS ymax"],
        "true",
    ),
    "obs": (
        "events",
        ["event_id", "user_id % 50 AS pixel", "CAST(ts AS DATE) AS obs_date", "ts", "value", "CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 5 WHEN 'purchase' THEN 6 WHEN 'error' THEN 9 ELSE 8 END AS scl"],
        "true",
    ),
    "judged": ("documents JOIN labels USING (doc_id)", ["doc_id AS id", "CAST(n_chars % 97 AS DOUBLE) AS score", "quality AS truth", "toxic", "n_chars"], "true"),
    "chips": ("documents", ["doc_id AS id", "source", "lang", "n_chars", "CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split", "(doc_id * 48271) % 65536 AS key"], "true"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations", "pages", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions, condition = VIEWS[name]
    first, *rest = table.split(" JOIN ")
    df = spark.read.parquet(f"{sf_dir}/{first}.parquet")
    for r in rest:
        other, key = r.split(" USING ")
        df = df.join(spark.read.parquet(f"{sf_dir}/{other}.parquet"), key.strip("()"))
    return df.where(condition).selectExpr(*expressions)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polygons(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of diamonds (cx, cy, r, hole) with rings: the outer one, and a smaller one inside where hole is above 0."""
    corner = lambda r, dx, dy: f"struct(CAST(cx + {dx} * {r} AS DOUBLE) AS x, CAST(cy + {dy} * {r} AS DOUBLE) AS y)"
    ring = lambda r: f"array({', '.join(corner(r, dx, dy) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)))})"
    # A small file is few tasks; rings are made by more.
    return view(spark, sf_dir, name).repartition("id").selectExpr("*", f"CASE WHEN hole > 0 THEN array({ring('r')}, {ring('hole')}) ELSE array({ring('r')}) END AS rings")


def ctes(*names: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]} WHERE {VIEWS[n][2]})" for n in names)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h, w, px): 8 x 8 tiles, each scaled to 0..1 by its least and largest value, 4 places."""
    # The extremes first, and not once more for each pixel.
    own = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", "array(CAST(array_min(embedding) AS DOUBLE), CAST(array_max(embedding) AS DOUBLE)) AS m")
    return own.selectExpr("id", "8 AS h", "8 AS w", "transform(embedding, v -> round((CAST(v AS DOUBLE) - m[0]) / (m[1] - m[0]), 4)) AS px")


#: Pixels of the same tiles (id, k, p), k from 0.
PIXELS = """
raw AS (SELECT vec_id AS id, unnest(range(64)) AS k, embedding FROM embeddings),
px AS (SELECT id, CAST(k AS BIGINT) AS k, round((CAST(embedding[k + 1] AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) / (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)), 4) AS p FROM raw)
"""
