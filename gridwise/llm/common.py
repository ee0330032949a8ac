"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridwise.session import materialize, scratch

__all__ = ["bounded_batches", "map_columns", "materialize", "scratch"]

#: Rows of an Arrow batch at most, and its bytes, about: a batch ends at either. One text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as texts can be long and a batch is held whole.

    The settings are lowered in the session and stay so, as they are read when a query is run; lower ones are left as they are.
    """
    for key, most in _LIMITS.items():
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, out: pa.Schema) -> DataFrame:
    """mapInArrow with fn on the columns of each batch as Python lists; fn returns columns by name."""
    bounded_batches(df.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = fn(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(batches, schema)
