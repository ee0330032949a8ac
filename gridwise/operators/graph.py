"""Connected components of a link table, by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links; root is the smallest node that can be reached.

    Null ends and loops link nothing. Each round ends in the shared folder, so no lineage grows and nothing is collected;
    the rounds needed grow with the logarithm of the largest component.
    """
    edges = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        before = now
        # Large star: larger neighbours move to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy(F.col("x").alias("x_")).agg(F.min("y").alias("least"))
        large = both.hint("merge").join(least, F.col("x") == F.col("x_")).where("y > x").select(F.col("y").alias("x"), F.least("x", "least").alias("y")).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest neighbour.
        least = large.groupBy(F.col("x").alias("x_")).agg(F.min("y").alias("least"))
        moved = large.hint("merge").join(least, F.col("x") == F.col("x_")).where("y > least").select(F.col("y").alias("x"), F.col("least").alias("y"))
        edges = materialize(moved.unionByName(least.select(F.col("x_").alias("x"), F.col("least").alias("y"))).distinct(), "links")
