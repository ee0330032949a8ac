"""Streaming forms of batch operators: daily means and median composites, deduplication, incremental runs and runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def scenes(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files as they come, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily(stream: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", late: str = "2 days", clear: Column | None = None) -> DataFrame:
    """(keys, day, n, mean) of clear observations per day; a day closes once the watermark has passed it."""
    rows = stream.where(F.col(value).isNotNull() & (clear if clear is not None else F.lit(True)))
    w = rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(*keys, F.col("window.start").cast("date").alias("day"), "n", "mean")


def composite(stream: DataFrame, keys: list[str], days: int, value: str = "value", ts: str = "ts", late: str = "2 days", clear: Column | None = None) -> DataFrame:
    """(keys, start, n_days, composite): the median over the days of each window of the first clear observation a day, cut to an integer.

    Two aggregations in a row, days and then windows of so many days, so what is kept for a pixel is one value a day, and
    late observations count until the watermark has passed their day. A window comes out once it has passed the window; the
    order in which rows came makes no difference. The same as raster.median_composite over a window's rows, but for pixels
    that were never clear, which don't come out.
    """
    rows = stream.where(F.col(value).isNotNull() & (clear if clear is not None else F.lit(True)))
    per_day = rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.min_by(value, F.struct(ts, value)).alias("v"))
    whole = per_day.groupBy(F.window("window", f"{days} days"), *keys).agg(F.count("v").alias("n_days"), F.median("v").alias("m"))
    return whole.select(*keys, F.col("window.start").alias("start"), "n_days", F.floor("m").cast("int").alias("composite"))


def distinct_issues(stream: DataFrame, key: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def outages(calls: DataFrame, failures: int = 3) -> DataFrame:
    """(provider, start, end, n) of runs of at least so many failed calls (provider, ts, ok) in a row, from a log that is complete.

    A run's number is how many calls succeeded before it.
    """
    order = Window.partitionBy("provider").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = calls.withColumn("run", F.sum(F.col("ok").cast("int")).over(order)).where("NOT ok")
    return runs.groupBy("provider", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).where(F.col("n") >= failures).drop("run")


def daily_median(spark: SparkSession, done: str, keys: list[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """(keys, day, n, median) over what run_once has written to done; a median isn't added up, so it is taken over whole days."""
    rows = spark.read.parquet(done).where(F.col(value).isNotNull())
    return rows.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.median(value).alias("median"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what has come since the last run and stop; files already seen aren't read again."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return q
