"""Connected components by alternating large-star and small-star contraction.

Each round is two grouped minima joined back to the edges, so a hub's
neighbours are never gathered in one row; rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.sources.shared import table


def _contract(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: stars, which a further round leaves as they are."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))))
    return ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where(F.col("below") + F.col("above") > 1).isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Edges with a null end and self-loops add nothing; repeated edges count once.
    """
    a, b = F.col(src), F.col(dst)
    now = table(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not settled(now):
        now = table(_contract(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
