"""Ranks over whole tables without a single-task window, and the measures built on them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwise.operators import selection
from gridwise.session import materialize

#: Ranges that a table's scores are cut into.
RANGES = 64


def _cuts(df: DataFrame, score: str) -> Column:
    """Number of the score's range; where the cuts lie changes the work's balance only, not the ranks."""
    marks = sorted(set(df.stat.approxQuantile(score, [i / RANGES for i in range(1, RANGES)], 0.005)))
    return F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col(score))) if marks else F.lit(0)


def score_counts(df: DataFrame, score: str, *sums: Column) -> DataFrame:
    """(score, n, below, sums..., below_<sum>...) for each distinct score; null scores are left out.

    n counts a score's rows, below the rows with a smaller one. Equal scores are counted before they shuffle. Running sums are made
    within a range of scores; the ranges' own totals are RANGES rows at most.
    """
    rows = df.where(F.col(score).isNotNull())
    named = [F.count("*").alias("n"), *sums]
    per = rows.groupBy(score).agg(*named)
    names = [c for c in per.columns if c != score]
    per = per.withColumn("__range", _cuts(rows, score))
    totals = per.groupBy("__range").agg(*(F.sum(c).alias(c) for c in names))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__range").alias("__r"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in names))
    own = Window.partitionBy("__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    label = lambda c: "below" if c == "n" else f"below_{c}"
    out = per.join(F.broadcast(totals), F.col("__range") == F.col("__r"))
    return out.select(score, *names, *((F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"__{c}")).alias(label(c)) for c in names))


def average_ranks(df: DataFrame, score: str, name: str = "avg_rank") -> DataFrame:
    """df with the average rank (from 1, ties share) of score and the share of all rows it stands for; null for a null score."""
    counts = score_counts(df, score)
    total = counts.agg(F.sum("n").alias("__total"))
    counts = counts.crossJoin(F.broadcast(total)).select(F.col(score).alias("__s"), (F.col("below") + (F.col("n") + 1) / 2.0).alias(name), F.col("__total"))
    return df.join(counts, F.col(score) == F.col("__s"), "left").withColumn(f"{name}_pct", F.col(name) / F.col("__total")).drop("__s", "__total")


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row (n_pos, n_neg, auc): the chance that a positive scores above a negative, ties half; null without both."""
    pos, neg = F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) == 0, 1).otherwise(0)).alias("neg")
    c = score_counts(df, score, pos, neg)
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0))
    return c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won")).select("n_pos", "n_neg", F.try_divide(F.col("won"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def precision_at(df: DataFrame, k: int, order: list[Column], truth: str) -> DataFrame:
    """One row (k, hits, precision) over the first k rows by order."""
    top = df.orderBy(*order).limit(k)
    return top.agg(F.lit(k).alias("k"), F.sum(F.col(truth).cast("long")).alias("hits"), F.avg(F.col(truth).cast("double")).alias("precision"))


#: Rows of a range that are numbered in one task, about.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, score: str, ties: list[Column], name: str = "n") -> DataFrame:
    """df with 0, 1, ... by falling score and then ties; null scores come last.

    Rows are cut into ranges of the whole order, ties included, so that equal scores are spread too. The ranges are
    written once; a range's rows are numbered by themselves, and the ranges by the sizes of those before.
    """
    order = [F.col(score).desc_nulls_last(), *ties]
    parts = max(1, math.ceil(df.count() / RANGE_ROWS))
    cut = df.repartitionByRange(parts, *order) if parts > 1 else df.repartition(1)
    rows = materialize(cut.withColumn("__range", F.spark_partition_id() if parts > 1 else F.lit(0)), "ranges")
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__range").alias("__r"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    # One row a range: fewer than one for RANGE_ROWS rows.
    return rows.withColumn("__own", own).join(F.broadcast(sizes), F.col("__range") == F.col("__r")).withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__own", "__r", "__before")


def every_nth(df: DataFrame, n: int, score: str, ties: list[Column]) -> DataFrame:
    """The first row by falling score, and every nth after it."""
    return numbered(df, score, ties, "__n").where(F.col("__n") % n == 0).drop("__n")


def ordinal_auc(df: DataFrame, score: str, truth: str, ties: list[Column]) -> DataFrame:
    """One row (n_pos, n_neg, auc) by plain ranks, where equal scores are ordered by ties: the later of them counts as lower."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isin(0, 1))
    n = numbered(rows, score, ties)
    t = n.agg(F.sum(F.col(truth).cast("long")).alias("n_pos"), F.count("*").alias("__all"), F.sum(F.when(F.col(truth) == 1, F.col("n"))).alias("__sum"))
    negatives = F.col("__all") - F.col("n_pos")
    # A positive at place n of the falling order has all - 1 - n below it.
    below = (F.col("__all") - 1) * F.col("n_pos") - F.col("__sum")
    return t.select("n_pos", negatives.alias("n_neg"), F.try_divide(below - F.col("n_pos") * (F.col("n_pos") - 1) / 2.0, (F.col("n_pos") * negatives).cast("double")).alias("auc"))


def mann_whitney(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row (n_pos, n_neg, u, z, p): the rank sum statistic of the positives, its normal deviate with ties and continuity corrected, and the chance of as much or more."""
    pos, neg = F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) == 0, 1).otherwise(0)).alias("neg")
    c = score_counts(df.where(F.col(truth).isin(0, 1)), score, pos, neg)
    d = lambda x: F.col(x).cast("double")
    t = c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)).alias("u"), F.sum(d("n") * d("n") * d("n") - d("n")).alias("__ties"))
    n = d("n_pos") + d("n_neg")
    sigma = F.sqrt(d("n_pos") * d("n_neg") / 12 * (n + 1 - F.try_divide(F.col("__ties"), n * (n - 1))))
    z = F.try_divide(F.col("u") - d("n_pos") * d("n_neg") / 2 - 0.5, sigma)

    @F.arrow_udf("double")
    def tail(deviate: pa.Array) -> pa.Array:
        return pa.array([None if x is None else math.erfc(x / math.sqrt(2)) / 2 for x in deviate.to_pylist()], pa.float64())

    return t.select("n_pos", "n_neg", "u", z.alias("z"), tail(z).alias("p"))


def quantiles(df: DataFrame, value: str, shares: list[float], *groups: str) -> DataFrame:
    """(groups, q_<percent>...): quantiles with linear interpolation, also the median as 0.5."""
    out = selection.quantiles(df, list(groups), value, shares)
    return out.select(*groups, *(F.col("q")[i].alias(f"q_{round(100 * s)}") for i, s in enumerate(shares)))


def compared(df: DataFrame, variants: dict[str, Column], truth: str, ks: list[int], tie: Column) -> DataFrame:
    """(variant, auc, p<k>...) of several scores of the same rows, 6 and no places; scores are rounded to 9 places, equal ones go by tie."""
    rows = materialize(df.select(F.col(truth).alias("truth"), tie.alias("tie"), *(F.round(c, 9).alias(v) for v, c in variants.items())), "variants")
    out = None
    for v in variants:
        one = auc(rows.withColumn("s", F.col(f"`{v}`")), "s", "truth").select(F.lit(v).alias("variant"), F.round("auc", 6).alias("auc"))
        for k in ks:
            top = rows.orderBy(F.desc(f"`{v}`"), "tie").limit(k).agg(F.avg(F.col("truth").cast("double")).alias(f"p{k}"))
            one = one.crossJoin(top)
        out = one if out is None else out.unionByName(one)
    return out


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row (tp, fp, fn, iou, f1); rows whose truth is -1 don't count."""
    t, p = F.col(truth), F.col(pred)
    n = df.agg(*(F.count_if(c).alias(k) for k, c in (("tp", (t == 1) & (p == 1)), ("fp", (t == 0) & (p == 1)), ("fn", (t == 1) & (p == 0)))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", (tp / F.greatest(tp + fp + fn, F.lit(1)).cast("double")).alias("iou"), (2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)).cast("double")).alias("f1"))


def recall_by(df: DataFrame, bucket: Column, hit: str, buckets: list[str]) -> DataFrame:
    """(bucket, installations, detected, recall) for every bucket named; recall is null where there is none."""
    n = df.select(bucket.alias("__b"), F.col(hit).cast("long").alias("__h")).groupBy("__b").agg(F.count("*").alias("installations"), F.sum("__h").alias("detected"))
    names = df.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    out = names.join(F.broadcast(n), F.col("bucket") == F.col("__b"), "left")
    return out.select("bucket", F.coalesce("installations", F.lit(0)).alias("installations"), F.coalesce("detected", F.lit(0)).alias("detected"), F.try_divide(F.col("detected").cast("double"), F.col("installations").cast("double")).alias("recall"))


def described(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, standard deviation, minimum, exact quartiles and maximum of value in each group."""
    v = F.col(value)
    q = selection.quantiles(df, [group], value, [0.25, 0.5, 0.75]).select(F.col(group).alias("__g"), "q")
    out = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    out = out.join(q, F.col(group).eqNullSafe(F.col("__g")), "left")
    return out.select(group, "n", "mean", "std", "least", *(F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)), "most")
