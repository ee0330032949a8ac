"""Embedding whitening: covariance by Spark's RowMatrix over exactly centred rows, components from it, rows projected on them.

An entry c becomes the integer floor(1024 c) + 100000, so counts and sums are exact and a row can be centred without
rounding: n times the entry less the sum is an integer, which is divided by n once. The Gramian of those rows over n is
the covariance; its eigenvectors are worked out on the driver, as its size is that of one vector squared, and go to every
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Steps of a unit, and what is added so that entries are positive.
STEPS, SHIFT = 1024, 100_000
COMPONENTS = 8


@dataclass(frozen=True)
class Whitening:
    """n rows with the sums of each dimension; unit components by falling variance, as columns, and the covariance's trace.

    A component without variance, up to rounding, has the variance 0.
    """

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): the rows whose vector is usable, as integers.

    Left out are null and empty vectors, those with null, infinite or undefined entries, and those whose length isn't the
    commonest one (the larger of several), as they have no place in one covariance. Written once.
    """
    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    own = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("v")).where((F.size("v") > 0) & F.forall("v", sound))
    x = materialize(own.select("id", F.transform("v", lambda v: F.floor(v * STEPS) + SHIFT).alias("x")), "integers")
    most = x.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return x.where(F.size("x") == (most["length"] if most else 0))


def covariance(rows: DataFrame, vector: Column, n: int) -> np.ndarray:
    """Mean product of each two dimensions of n rows that are centred already."""
    v = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(v, numRows=n).computeGramianMatrix().toArray() / n


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (id, x) by its own statistics over all rows; None for no rows."""
    sums = x.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("k").collect()  # One row a dimension.
    if not sums:
        return None
    n, total = sums[0]["n"], np.array([r["s"] for r in sums], np.int64)
    centred = F.zip_with("x", F.array(*(F.lit(int(s)).cast("long") for s in total)), lambda a, s: (a * n - s).cast("double") / n)
    v = covariance(x, centred, n)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    noise = max(e.max(), 0.0) * len(e) * np.finfo(float).eps
    return Whitening(n, total, u[:, order], np.where(e[order] > noise, e[order], 0.0), float(np.trace(v)))


def whitened(x: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w): each row's exact squared distance from the mean times n squared, and its whitened components.

    A component without variance is null, as nothing can be scaled to one there.
    """
    bounded_batches(x.sparkSession)
    held = x.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        scale = np.sqrt(np.where(m.variances > 0, m.variances, np.nan))
        for b in it:
            if not len(b):
                continue
            off = np.stack(b["x"].to_numpy()).astype(np.int64) * m.n - m.sums
            # Squares that could leave 64 bits are Python's integers.
            wide = off if int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63 else off.astype(object)
            w = (off / m.n) @ m.components / scale
            yield pd.DataFrame({"id": b["id"], "deviation": [str(d) for d in (wide * wide).sum(axis=1)], "w": [[None if np.isnan(c) else float(c) for c in r] for r in w]})

    kind = x.schema["id"].dataType.simpleString()
    made = x.mapInPandas(batches, f"id {kind}, deviation string, w array<double>")
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(w: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the whitened rows' covariance less the identity, over the components that have variance."""
    kept = [k for k, e in enumerate(model.variances) if e > 0]
    if not kept:
        return 0.0
    mean = w.agg(*(F.avg(F.col("w")[k]).alias(f"m{k}") for k in kept)).first()
    centred = F.array(*(F.col("w")[k] - mean[f"m{k}"] for k in kept))
    return float(np.abs(covariance(w, centred, model.n) - np.eye(len(kept))).max())


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable row and component, from 1 by falling variance.

    Rows that ``integers`` leaves out aren't returned; repeated rows count and come out as often as they come in; null keys
    stay. deviation is a decimal. Other columns are dropped, whatever their names. No usable row gives no rows.
    """
    x = integers(vectors, key, vector)
    model = fit(x, components)
    if model is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    w = materialize(whitened(x, model), "whitened")
    share = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.variances]
    rows = w.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select(
        F.col("id").alias(key),
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, share))[F.col("k")].alias("explained"),
        F.lit(identity_error(w, model)).alias("identity_error"),
    )
