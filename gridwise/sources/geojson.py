"""Feature collections and feature lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _point(lon: str, lat: str) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def polygon_geometry(rings: Column) -> Column:
    """A polygon's geometry, with closed rings of (x, y)."""
    return F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def to_lines(df: DataFrame, properties: list[str], lon: str = "lon", lat: str = "lat", rings: str | None = None, key: str | None = None) -> DataFrame:
    """df with value: each row as a feature on one line, a point or the polygon in rings; key names the feature's id."""
    shape = _point(lon, lat) if rings is None else polygon_geometry(F.col(rings))
    own = [F.col(key).alias("id")] if key else []
    return df.withColumn("value", F.to_json(F.struct(F.lit("Feature").alias("type"), *own, shape.alias("geometry"), F.struct(*properties).alias("properties"))))


def parse(lines: DataFrame, properties: str) -> DataFrame:
    """(geometry_type, lon, lat, properties, coordinates) from a value column; properties is a DDL schema.

    A leading record separator is dropped; blank and malformed lines go. lon and lat are a point's, null for other shapes,
    whose coordinates stay as JSON text.
    """
    text = F.trim(F.regexp_replace("value", "^\\s*\x1e", ""))
    schema = f"type string, geometry struct<type: string, coordinates: string>, properties struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in properties.split(','))}>, _bad string"
    rows = lines.select(F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("f")).where("f._bad IS NULL AND f.type = 'Feature' AND f.geometry IS NOT NULL")
    xy = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "array<double>"))
    return rows.select(F.col("f.geometry.type").alias("geometry_type"), xy[0].alias("lon"), xy[1].alias("lat"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    return parse(spark.read.text(path), properties)


def read_collections(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Files that hold one feature collection each; a file is one task's work."""
    files = spark.read.text(path, wholetext=True)
    features = files.select(F.explode(F.from_json("value", "features array<string>").getField("features")).alias("value"))
    return parse(features, properties)


def rings_of(coordinates: Column) -> Column:
    """Rings of (x, y) from a polygon's coordinates as JSON text."""
    return F.transform(F.from_json(coordinates, "array<array<array<double>>>"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def write_lines(df: DataFrame, path: str, properties: list[str], **shape: str) -> None:
    """Feature lines; a collection of unknown size isn't put into one row."""
    to_lines(df, properties, **shape).select("value").write.text(path)


def write_collection(df: DataFrame, path: str, properties: list[str], **shape: str) -> None:
    """Collections: each file is one, of the features of one partition, in their order; an empty partition has none.

    Its lines are the collection's head, a feature each with a comma before all but the first, and its end, so no
    collection has to fit into a row.
    """
    lines = to_lines(df, properties, **shape).select("value")

    def files(it):
        first = True
        for b in it:
            rows = ["," * (not first or i > 0) + v for i, v in enumerate(b.column(0).to_pylist())]
            if rows and first:
                rows = ['{"type":"FeatureCollection","features":[', *rows]
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    lines.mapInArrow(files, "value string").write.text(path)
