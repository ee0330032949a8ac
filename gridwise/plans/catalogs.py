"""Scene search, conversion of image stacks, and filling up an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.operators import catalog
from gridwise.plans.base import Entry, registered
from gridwise.plans.domain import ctes, table, view

ENTRIES: dict[str, Entry] = {}

_X, _Y = "(event_id * 7321) % 160000", "(event_id * 8713) % 130000"
_ITEM = ["event_id AS id", "CAST(ts AS DATE) AS day", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS cloud", *(f"CAST({v} AS DOUBLE) AS {c}" for c, v in (("xmin", _X), ("ymin", _Y), ("xmax", f"{_X} + 9000 + event_id % 7 * 500"), ("ymax", f"{_Y} + 8000 + event_id % 5 * 900")))]
_ITEMS = f"items AS (SELECT {', '.join(_ITEM)} FROM events)"
_WINDOW = ("2024-01-05", "2024-01-25")
_MEET = "a.xmin <= i.xmax AND i.xmin <= a.xmax AND a.ymin <= i.ymax AND i.ymin <= a.ymax"
_AREA = "SELECT id, x - 4000 AS xmin, y - 3000 AS ymin, x + 4000 AS xmax, y + 3000 AS ymax FROM subs"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_ITEM)


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "subs").selectExpr("id", "x - 4000 AS xmin", "y - 3000 AS ymin", "x + 4000 AS xmax", "y + 3000 AS ymax")


@registered(ENTRIES, f"""{ctes("subs")}, {_ITEMS}, a AS ({_AREA}) SELECT a.id AS area, i.id AS scene, CAST(i.day AS VARCHAR) AS day, i.cloud, row_number() OVER (PARTITION BY a.id ORDER BY i.cloud, i.id) AS n FROM a JOIN items i ON {_MEET} WHERE i.day BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}' AND i.cloud < 60 QUALIFY n <= 12""")
def scenes_of_areas(spark: SparkSession, d: str) -> DataFrame:
    """The twelve least cloudy scenes of each area in a window of days."""
    s = catalog.searched(_areas(spark, d), _items(spark, d), 10000.0, _WINDOW, 60.0, 12)
    return s.select("area", F.col("id").alias("scene"), F.col("day").cast("string").alias("day"), "cloud", "n")


@registered(ENTRIES, f"""{ctes("subs")}, {_ITEMS}, a AS ({_AREA}) SELECT a.id AS area, i.id AS scene, CAST(i.day AS VARCHAR) AS day, i.cloud, row_number() OVER (PARTITION BY a.id ORDER BY i.day, i.id) AS n FROM a JOIN items i ON {_MEET} WHERE i.day BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}' QUALIFY n <= 16""")
def scenes_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first sixteen scenes of each area in a window, whatever the clouds."""
    s = catalog.searched(_areas(spark, d), _items(spark, d), 10000.0, _WINDOW, most=16, order=[F.col("day")])
    return s.select("area", F.col("id").alias("scene"), F.col("day").cast("string").alias("day"), "cloud", "n")


@registered(ENTRIES, f"""{ctes("cand")}, {_ITEMS}, a AS (SELECT id, x AS xmin, y AS ymin, x AS xmax, y AS ymax FROM cand) SELECT a.id AS point, i.id AS scene, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(i.cloud, 100), i.id) AS n FROM a JOIN items i ON {_MEET} QUALIFY n <= 2""")
def scenes_at_points(spark: SparkSession, d: str) -> DataFrame:
    """The two least cloudy scenes that hold each candidate; an unknown cover comes last."""
    c = view(spark, d, "cand").selectExpr("id", "x AS xmin", "y AS ymin", "x AS xmax", "y AS ymax")
    return catalog.searched(c, _items(spark, d), 10000.0, most=2).select(F.col("area").alias("point"), F.col("id").alias("scene"), "n")


# Stacks of two revisits, two bands and 2 x 8 pixels; chips of 4 x 4, from the middle of each row and filled up below.
_HAVE, _WANTED = ["B1", "B2"], ["B2", "B1"]
_NAME = ("lat_", "(20 + vec_id % 97 / CAST(8 AS DOUBLE))", "_lon_", "(60 + vec_id % 89 / CAST(4 AS DOUBLE))", ".npz")


def _stacks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) = 64")
    name = f"concat('lat_', format_string('%.3f', {_NAME[1]}), '_lon_', format_string('%.3f', {_NAME[3]}), '.npz')"
    # Every seventeenth name holds no place.
    name = f"concat(vec_id, IF(vec_id % 17 = 0, '_nowhere.npz', concat('_', {name})))"
    px = "transform(embedding, v -> round(CAST(v AS DOUBLE) * 1000, 0))"
    images = e.selectExpr(f"concat('stack/', {name}) AS path", f"IF(vec_id % 23 = 0, array(1, 3, 2, 8), array(2, 2, 2, 8)) AS shape", f"{px} AS px")
    masks = e.where("vec_id % 5 <> 0").selectExpr(f"concat('mask/', {name}) AS path", "array(2, 8) AS shape", f"transform(slice({px}, 1, 16), v -> IF(v > 150, 3, 1)) AS px")
    return images, masks.withColumn("px", F.col("px").cast("array<double>"))


_STACK = """s AS (SELECT vec_id, 20 + vec_id % 97 / CAST(8 AS DOUBLE) AS lat, 60 + vec_id % 89 / CAST(4 AS DOUBLE) AS lon, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) * 1000, 0)) AS px, CASE WHEN vec_id % 5 = 0 THEN 'unmatched' WHEN vec_id % 17 = 0 THEN 'unplaced' WHEN vec_id % 23 = 0 THEN 'unreadable' ELSE 'converted' END AS outcome FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64)"""


@registered(ENTRIES, f"""WITH {_STACK}, c AS (SELECT * FROM s WHERE outcome = 'converted'), k AS (SELECT vec_id, any_value(lat) AS lat, any_value(lon) AS lon, sum(CAST(CASE WHEN r < 2 THEN floor(least(greatest((px[32 * 0 + 16 * (1 - b) + 8 * r + 2 + q + 1] + px[32 + 16 * (1 - b) + 8 * r + 2 + q + 1]) / 2, 0), 65535)) ELSE 0 END * (b * 16 + r * 4 + q + 1) AS BIGINT)) AS weighed, CAST(sum(CASE WHEN b = 0 AND r < 2 AND px[8 * r + 2 + q + 1] > 150 THEN 1 ELSE 0 END) AS INTEGER) AS sub_pixels FROM c, range(0, 2) x(b), range(0, 4) y(r), range(0, 4) z(q) GROUP BY vec_id)
SELECT vec_id, substr(sha1(printf('%.5f_%.5f', lon, lat)), 1, 12) AS chip_id, CASE WHEN sub_pixels > 0 THEN 'positive' ELSE 'background' END AS kind, 'train' AS split, sub_pixels, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg, CAST(weighed AS BIGINT) AS weighed FROM k""")
def converted_chips(spark: SparkSession, d: str) -> DataFrame:
    """Image stacks and the masks of the same name as chips: bands by name, medians, the middle squares."""
    chips, _ = catalog.converted(*_stacks(spark, d), _HAVE, _WANTED, 4, 3)
    weighed = F.aggregate(F.transform("image", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    vec = F.split_part(catalog.file_of(F.col("path"))["name"], F.lit("_"), F.lit(1)).cast("long")
    return chips.select(vec.alias("vec_id"), "chip_id", "kind", "split", "sub_pixels", "epsg", weighed.alias("weighed"))


@registered(ENTRIES, f"""WITH {_STACK} SELECT outcome, count(*) AS n FROM s GROUP BY outcome""")
def conversion_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many stacks became chips, and why the others didn't."""
    return catalog.converted(*_stacks(spark, d), _HAVE, _WANTED, 4, 3)[1]


_INDEX = "i AS (SELECT id, CASE WHEN id % 3 = 0 THEN 's1/' || id || '.tif' END AS s1 FROM cand)"


@registered(ENTRIES, f"""{ctes("cand", "nodes")}, {_INDEX}, l AS (SELECT id % 400 AS id, min('new/' || segment) AS f FROM nodes GROUP BY 1) SELECT i.id, coalesce(s1, f) AS s1 FROM i LEFT JOIN l ON l.id = i.id WHERE coalesce(s1, f) IS NOT NULL""")
def layer_backfill(spark: SparkSession, d: str) -> DataFrame:
    """An index whose missing layer is filled up from what is there; rows without one leave it."""
    return catalog.backfilled(*_layers(spark, d), "id", "s1")[0]


@registered(ENTRIES, f"""{ctes("cand", "nodes")}, {_INDEX}, l AS (SELECT DISTINCT id % 400 AS id FROM nodes) SELECT CASE WHEN s1 IS NOT NULL THEN 'existing' WHEN l.id IS NOT NULL THEN 'written' ELSE 'missing' END AS outcome, count(*) AS n FROM i LEFT JOIN l ON l.id = i.id GROUP BY 1""")
def backfill_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows had the layer, found it, or have none."""
    return catalog.backfilled(*_layers(spark, d), "id", "s1")[1]


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    index = view(spark, d, "cand").selectExpr("id", "IF(id % 3 = 0, concat('s1/', id, '.tif'), NULL) AS s1")
    return index, view(spark, d, "nodes").selectExpr("id % 400 AS id", "concat('new/', segment) AS s1")
