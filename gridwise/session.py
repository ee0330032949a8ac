"""Sessions and the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a session without spark.checkpoint.dir, once one was needed.
_OWN: list[str] = []


def session(master: str = "local[8]", memory: str = "8g", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, spark-submit configures one."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | {k.replace("_", "."): v for k, v in more.items()}
    spark = SparkSession.builder.master(master).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, below a folder of the application's own.

    Where that setting is unset, a local session, as in tests, has a local folder; on a cluster it is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='gridwise-')}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/gridwise/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Delete all that materialize has written for this application; what was read from it can't be read any more."""
    top = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent().getParent()
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
