"""Batches end at a number of bytes."""

from __future__ import annotations

import pyarrow as pa

from gridwise.llm import common


def test_long_texts_come_in_small_batches(spark):
    sizes = pa.schema([("n", pa.int64())])
    long = spark.range(40, numPartitions=1).selectExpr("repeat('x', 4000000) AS text")
    common.bounded_batches(spark)

    def count(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], schema=sizes)

    got = [r.n for r in long.mapInArrow(count, "n long").collect()]
    assert sum(got) == 40 and max(got) * 4_000_000 <= common.BATCH_BYTES + 4_000_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000")
    common.bounded_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
