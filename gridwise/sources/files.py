"""Raster stacks, geometry in well-known binary, listings and staged catalogs."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = "struct<kind: string, parts: array<array<struct<x: double, y: double>>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(_POINT)))])
# Geometry types of well-known binary.
_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def from_wkb(data: bytes | None) -> dict | None:
    """kind and parts: a point's or line's points are one part, a polygon's rings are its parts, a collection's parts follow each other.

    None for null, cut short or unknown data.
    """

    def points(at: int, order: str, n: int) -> tuple[list[dict], int]:
        xy = struct.unpack_from(f"{order}{2 * n}d", data, at)
        return [{"x": x, "y": y} for x, y in zip(xy[::2], xy[1::2], strict=True)], at + 16 * n

    def shape(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5
        if kind == 1:
            p, at = points(at, order, 1)
            return "Point", [p], at
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        if kind == 2:
            p, at = points(at, order, n)
            return "LineString", [p], at
        parts: list = []
        for _ in range(n):
            if kind == 3:
                (m,) = struct.unpack_from(f"{order}I", data, at)
                p, at = points(at + 4, order, m)
                parts.append(p)
            else:
                _, inner, at = shape(at)
                parts += inner
        return _KINDS[kind], parts, at

    try:
        kind, parts, _ = shape(0)
    except (struct.error, KeyError, IndexError, TypeError):
        return None
    return {"kind": kind, "parts": parts}


def decode_wkb(column: Column) -> Column:
    @F.arrow_udf(SHAPE)
    def decoded(data: pa.Array) -> pa.Array:
        return pa.array(map(from_wkb, data.to_pylist()), type=_SHAPE)

    return decoded(column)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """The table with its geometry column decoded, and its box as xmin, ymin, xmax, ymax."""
    df = spark.read.parquet(path).withColumn(geometry, decode_wkb(F.col(geometry)))
    points = F.flatten(F.col(geometry)["parts"])
    edge = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return df.withColumns({"xmin": edge(F.array_min, "x"), "ymin": edge(F.array_min, "y"), "xmax": edge(F.array_max, "x"), "ymax": edge(F.array_max, "y")})


def in_box(df: DataFrame, box: tuple[float, float, float, float], column: str = "bbox") -> DataFrame:
    """Rows whose bbox struct touches the box; the comparisons reach the Parquet scan."""
    b = F.col(column)
    return df.where((b["xmin"] <= box[2]) & (b["xmax"] >= box[0]) & (b["ymin"] <= box[3]) & (b["ymax"] >= box[1]))


def read_stacks(spark: SparkSession, path: str, names: str = r"([-0-9.]+)_([-0-9.]+)\.npz$", key: str = "image") -> DataFrame:
    """(path, lat, lon, shape, px) from NumPy archives whose names hold the position; files that don't match or can't be read are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)

    @F.arrow_udf("struct<shape: array<int>, px: array<double>>")
    def load(content: pa.Array) -> pa.Array:
        def one(data: bytes) -> dict | None:
            try:
                a = np.load(io.BytesIO(data), allow_pickle=False)[key]
            except (ValueError, KeyError, OSError):
                return None
            return {"shape": list(a.shape), "px": a.astype(float).ravel().tolist()}

        return pa.array(map(one, content.to_pylist()), type=pa.struct([("shape", pa.list_(pa.int32())), ("px", pa.list_(pa.float64()))]))

    rows = files.select("path", F.regexp_extract("path", names, 1).alias("lat"), F.regexp_extract("path", names, 2).alias("lon"), load("content").alias("a")).where("lat != '' AND a IS NOT NULL")
    return rows.select("path", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "a.shape", "a.px")


def median_of_revisits(stacks: DataFrame) -> DataFrame:
    """Stacks (T, C, H, W) with px as the median over T, and the shape (C, H, W)."""
    n = F.col("shape")[1] * F.col("shape")[2] * F.col("shape")[3]
    middle = lambda i: F.array_sort(F.transform(F.sequence(F.lit(0), F.col("shape")[0] - 1), lambda t: F.element_at("px", (t * n + i + 1).cast("int"))))

    def median(i: Column) -> Column:
        s = middle(i)
        k = F.col("shape")[0]
        return (F.element_at(s, F.floor((k + 1) / 2).cast("int")) + F.element_at(s, F.floor(k / 2 + 1).cast("int"))) / 2

    return stacks.withColumn("px", F.transform(F.sequence(F.lit(0), n - 1), median)).withColumn("shape", F.slice("shape", 2, 3))


def staged_pages(pages: DataFrame, key: str, order: str, size: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows, full tiles) of staged answers (lon, lat and more): the first row of each key by order, and tiles with cap rows or more.

    An answer is cut at the cap, so a full tile may lack rows. Repeats of a key are summed up before they are shuffled.
    """
    first = pages.groupBy(key).agg(F.min_by(F.struct(*pages.columns), order).alias("row")).select("row.*")
    full = pages.groupBy(F.floor(F.col("lon") / size).alias("tx"), F.floor(F.col("lat") / size).alias("ty")).agg(F.count("*").alias("n")).where(F.col("n") >= cap)
    return first, full


def wkb_of(kind: str, parts: list) -> bytes:
    """Well-known binary of a point, a line or a polygon, little-endian."""
    code = {name: n for n, name in _KINDS.items()}[kind]
    points = lambda p: b"".join(struct.pack("<2d", q["x"], q["y"]) for q in p)
    head = struct.pack("<BI", 1, code)
    if kind == "Point":
        return head + points(parts[0])
    if kind == "LineString":
        return head + struct.pack("<I", len(parts[0])) + points(parts[0])
    return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + points(p) for p in parts)


def encode_wkb(column: Column) -> Column:
    """Well-known binary of a column of points, lines and polygons (kind, parts); null for null."""

    @F.arrow_udf("binary")
    def encoded(shapes: pa.Array) -> pa.Array:
        return pa.array([None if s is None else wkb_of(s["kind"], s["parts"]) for s in shapes.to_pylist()], pa.binary())

    return encoded(column)


def write_geoparquet(df: DataFrame, path: str, by: str | None = None, geometry: str = "geometry") -> None:
    """df with its geometry (kind, parts) in well-known binary and its box as a struct, in a folder for each value of ``by`` if asked for."""
    points = F.flatten(F.col(geometry)["parts"])
    edge = lambda f, c: f(F.transform(points, lambda p: p[c]))
    box = F.struct(edge(F.array_min, "x").alias("xmin"), edge(F.array_min, "y").alias("ymin"), edge(F.array_max, "x").alias("xmax"), edge(F.array_max, "y").alias("ymax"))
    out = df.withColumn("bbox", box).withColumn(geometry, encode_wkb(F.col(geometry))).write
    (out.partitionBy(by) if by else out).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comma-separated table with a header; fields that don't fit are null."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key isn't in the table at path yet; a run that was ended can be started again."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(key).alias("__done")).distinct()
    except AnalysisException:
        done = None
    new = df if done is None else df.join(done, F.col(key) == F.col("__done"), "left_anti")
    new.write.mode("append").parquet(path)


def unreadable(spark: SparkSession, path: str, key: str = "image") -> DataFrame:
    """(path, length) of NumPy archives that read_stacks leaves out for what they hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)

    @F.arrow_udf("boolean")
    def bad(content: pa.Array) -> pa.Array:
        def one(data: bytes) -> bool:
            try:
                return np.load(io.BytesIO(data), allow_pickle=False)[key].ndim == 0
            except (ValueError, KeyError, OSError):
                return True

        return pa.array([one(c.as_py()) for c in content], pa.bool_())

    return files.where(bad("content")).select("path", "length")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, lon, lat, line, power, voltage, name) from map-query answers: an element's own position or its centre, and its line of points."""
    tags = "struct<power: string, voltage: string, name: string>"
    schema = f"struct<elements: array<struct<id: bigint, type: string, lat: double, lon: double, center: struct<lat: double, lon: double>, geometry: array<struct<lat: double, lon: double>>, tags: {tags}>>>"
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", schema).getField("elements")))
    line = F.transform(F.coalesce("geometry", F.array().cast("array<struct<lat: double, lon: double>>")), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return rows.select("id", F.col("type").alias("kind"), F.coalesce("center.lon", "lon").alias("lon"), F.coalesce("center.lat", "lat").alias("lat"), line.alias("line"), "tags.power", "tags.voltage", "tags.name")


def tagged(features: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """features with layer: the first of ``power=substation`` and so on that a row's tags meet, by kind of shape; others are left out.

    wanted: layer to ``kind:column=value``; several mean any of them.
    """
    layer = None
    for name, rules in wanted.items():
        test = F.lit(False)
        for rule in rules:
            kind, _, tag = rule.rpartition(":")
            column, _, value = tag.partition("=")
            one = F.col(column) == value
            test = test | (one & (F.col("kind") == kind) if kind else one)
        layer = F.when(test, name) if layer is None else layer.when(test, name)
    return features.withColumn("layer", layer).where("layer IS NOT NULL")


def coalesced(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """primary, and the rows of fallback for keys that primary lacks."""
    have = primary.select(F.col(key).alias("__have")).distinct()
    return primary.unionByName(fallback.join(have, F.col(key) == F.col("__have"), "left_anti"), allowMissingColumns=True)
