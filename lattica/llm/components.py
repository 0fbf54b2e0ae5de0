"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over undirected edges (a, b). A hub's rows meet only in map-side combined minima and in joins that Spark splits by skew."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    swapped = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        pairs = both.unionAll(swapped)
    else:  # towards smaller neighbours only
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Rows (node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Null ends and self-loops are ignored, repeated edges count once, an empty table gives an empty result.
    Nodes without edges are absent: callers fall back to the node itself. Raises if max_rounds do not suffice.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = checkpoint(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = checkpoint(_star(_star(now, True), False))
        # Stars only when no node is both a leaf and a centre; the sums also catch a fixed point.
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or row.n == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (row.n, row.h)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
