"""Exact quantiles of groups of any size, without a group's values in one buffer.

A group of few values is sorted whole. In larger ones the value at a rank is found by rounds over all groups at once: the
values between two bounds are counted in buckets of equal width, the bucket with the rank gives the next bounds, its own
least and largest value, until these are equal or few values are left between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwise.session import materialize

#: Values that are sorted at once, buckets of a round, and searched ranks that are sent to every task at most.
FEW, BUCKETS, SENT = 4096, 1024, 200_000


def _interpolated(values: Column, n: Column, share: Column) -> Column:
    """The quantile of sorted values, between its two neighbours."""
    at = share * (n - 1)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def split_by_size(df: DataFrame, keys: list[str], value: str, few: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of groups of at most few values, rows of the others, (keys under __, n) of the others); null and undefined values go.

    Large groups are one for few rows at most, so they are looked up without a shuffle where they are no more than SENT.
    """
    own = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > few)
    large = materialize(sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), "n"), "large")
    sent = F.broadcast(large) if large.count() <= SENT else large
    return own.join(sent, _same(keys, "__"), "left_anti"), own.join(sent, _same(keys, "__"), "left_semi"), large


def _found(rows: DataFrame, large: DataFrame, keys: list[str], value: str, shares: list[float], few: int, buckets: int) -> DataFrame:
    """(keys under __, k, q): the k-th share's quantile in each large group."""
    rows = materialize(rows.select(*keys, F.col(value).cast("double").alias("v")), "values")
    bounds = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = [f"__{k}" for k in keys]
    wanted = F.explode(F.array_distinct(F.flatten(F.transform(F.array(*(F.lit(float(s)) for s in shares)), lambda s: F.array(F.floor(s * (F.col("n") - 1)), F.ceil(s * (F.col("n") - 1)))))))
    todo = large.join(bounds, _same(keys, "__")).select(*names, wanted.alias("rank"), F.lit(0).cast("long").alias("before"), "lo", "hi", F.col("n").alias("left"))
    todo, done = materialize(todo, "ranks"), None
    sent = lambda t: F.broadcast(t) if t.count() <= SENT else t
    while True:
        ready = todo.where(F.col("lo") == F.col("hi")).select(*names, "rank", F.col("lo").alias("v"))
        small = todo.where((F.col("lo") < F.col("hi")) & (F.col("left") <= few))
        near = rows.join(sent(small), _same(keys, "__")).where(F.col("v").between(F.col("lo"), F.col("hi")))
        near = near.groupBy(*names, "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        now = ready.unionByName(near.select(*names, "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("v")))
        done = materialize(now if done is None else done.unionByName(now), "found")
        todo = materialize(todo.where((F.col("lo") < F.col("hi")) & (F.col("left") > few)), "ranks")
        if todo.isEmpty():
            break
        met = rows.join(sent(todo), _same(keys, "__")).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # Halves first, as the difference of two bounds can be too large for a number.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = met.groupBy(*names, "rank", "before", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("left"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most as many rows a rank as there are buckets.
        upto = F.sum("left").over(Window.partitionBy(*names, "rank").orderBy("bucket")) + F.col("before")
        todo = materialize(counted.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("left"))).select(*names, "rank", (F.col("upto") - F.col("left")).alias("before"), "lo", "hi", "left"), "ranks")
    each = F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("k", "s")
    at = F.col("s") * (F.col("n") - 1)
    asked = large.select(*names, "n", each).withColumn("at", at)
    value_at = lambda side: done.select(*(F.col(c).alias(f"{side}{c}") for c in names), F.col("rank").alias(f"{side}r"), F.col("v").alias(f"{side}v"))
    both = asked.join(value_at("a"), _same(names, "a") & (F.floor("at") == F.col("ar"))).join(value_at("b"), _same(names, "b") & (F.ceil("at") == F.col("br")))
    return both.select(*names, "k", (F.col("av") + (F.col("bv") - F.col("av")) * (F.col("at") - F.floor("at"))).alias("q"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(keys, q): an array of the quantiles of each group, interpolated; groups without a value are left out."""
    small, rows, large = split_by_size(df, keys, value, few)
    held = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("vs")).withColumn("n", F.size("vs"))
    out = held.select(*keys, F.transform(F.array(*(F.lit(float(s)) for s in shares)), lambda s: _interpolated(F.col("vs"), F.col("n"), s)).alias("q"))
    if large.isEmpty():
        return out
    found = _found(rows, large, keys, value, shares, few, buckets).groupBy(*(f"__{k}" for k in keys)).agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("q"))
    return out.unionByName(found.select(*(F.col(f"__{k}").alias(k) for k in keys), F.transform("q", lambda x: x["q"]).alias("q")))


def with_top_mean(df: DataFrame, keys: list[str], value: str, share: float, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, most, mean, top): count, largest, mean, and the mean of the values from the share's quantile up.

    Small groups are collected once; the values of large ones are met by their quantile, which is one row a group.
    """
    small, rows, large = split_by_size(df, keys, value, few)
    held = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("vs")).withColumn("n", F.size("vs").cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    held = held.withColumn("q", _interpolated(F.col("vs"), F.col("n"), F.lit(share))).withColumn("above", F.filter("vs", lambda v: v >= F.col("q")))
    out = held.select(*keys, "n", F.array_max("vs").alias("most"), (total(F.col("vs")) / F.col("n")).alias("mean"), (total(F.col("above")) / F.size("above")).alias("top"))
    if large.isEmpty():
        return out
    found = materialize(_found(rows, large, keys, value, [share], few, buckets).drop("k"), "quantiles")
    met = rows.join(F.broadcast(found) if found.count() <= SENT else found, _same(keys, "__"))
    v = F.col(value).cast("double")
    more = met.groupBy(*keys).agg(F.count("*").alias("n"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.avg(F.when(v >= F.col("q"), v)).alias("top"))
    return out.unionByName(more)
