"""Core selection: top fractions and cut-off statistics of a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint

#: Rows of a block of a global order; ranks come from the blocks' sizes and a window within each.
BLOCK_ROWS = 250_000


def ordered(rows: DataFrame, *order: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds rank, from 1 in a total order, without sorting all rows in one task: the order is dealt out by ranges, of which there are
    as many as the rows need. Rows that are equal in the first columns are parted by the later ones."""
    parts = max(1, -(-rows.count() // block_rows))
    if parts == 1:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    # Cut points come from a sample, so the blocks are stored before they are counted.
    dealt = checkpoint(rows.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id()))
    sizes = dealt.groupBy("__b").agg(F.count("*").alias("__n"))  # a row a block
    above = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return dealt.withColumn("__k", inside).join(F.broadcast(above), "__b").withColumn("rank", F.col("__k") + F.col("__above")).drop("__b", "__k", "__above")


def ranked(scores: DataFrame, column: str = "score") -> DataFrame:
    """Adds rank, from 1 by falling score, ties by id."""
    return ordered(scores, F.desc(column), F.asc("id"))


def select_core(scores: DataFrame, frac: float = 0.15, auto: bool = False, total: int | None = None) -> DataFrame:
    """id, rank of the int(frac * n) highest scores; auto: int(min(cumulative-mass count, n / 4)). n is `total` or the rows."""
    n = total if total is not None else scores.count()
    size = int(min(cutoffs(scores).first().cumu_mass, 0.25 * n)) if auto else int(frac * n)
    return ranked(scores).where(F.col("rank") <= size).select("id", "rank")


def cutoffs(scores: DataFrame, eps: float = 1 / 400, mass: float = 0.99, win: int = 50, rel_slope: float = 0.01) -> DataFrame:
    """One row of cut-offs on the falling scores v, of which there are n.

    last_nonzero: n less the trailing values <= 0 if the last is 0; above_eps: values > eps; cumu_mass: values whose sum
    first reaches mass * total; knee: the rank farthest below the chord of the min-max scaled curve (Kneedle without its
    sensitivity rule); flat_tail: after the first 5 %, the first place where the moving mean (zero-padded) of the relative
    fall is below rel_slope. Windows lie within blocks of ranks; what they need of the next blocks is dealt to both.
    """
    v = checkpoint(ranked(scores).select("rank", "score"))
    n = v.count()
    skip, size = int(0.05 * n), max(BLOCK_ROWS, 2 * win)
    block = lambda rank: F.floor((rank - 1) / size)
    whole = Window.partitionBy("block").orderBy("rank")
    # A row belongs to its rank's block, and is seen in every block that a row within `win` ranks of it belongs to.
    seen = F.explode(F.sequence(block(F.greatest(F.col("rank") - win, F.lit(1))), block(F.col("rank") + win))).alias("block")
    tail = v.where(F.col("rank") > skip).select("rank", "score", seen)
    fall = F.abs(F.col("score") - F.lag("score").over(whole)) / F.greatest(F.col("score"), F.lit(1e-12))
    moving = F.sum("rel").over(whole.rowsBetween(-(win // 2), win - win // 2 - 1)) / win
    flat = tail.withColumn("rel", F.coalesce(fall, F.lit(0.0))).withColumn("mean", moving).where((F.col("mean") < rel_slope) & (F.col("block") == block(F.col("rank")))).agg(F.min("rank").alias("r"))
    top = v.agg(F.sum("score").alias("total"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    own = v.withColumn("block", block(F.col("rank")))
    sums = own.groupBy("block").agg(F.sum("score").alias("s"))  # a row a block
    sums = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("s"))
    run = own.withColumn("cum", F.sum("score").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.join(F.broadcast(sums), "block").withColumn("cum", F.col("cum") + F.col("s")).crossJoin(F.broadcast(top))  # one row
    share = F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    x, y = (F.col("rank") - 1) / max(n - 1, 1), (F.col("score") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    stats = run.agg(
        F.max(F.when(F.col("score") > 0, F.col("rank"))).alias("positive"),
        F.max_by("score", "rank").alias("last"),
        F.count_if(F.col("score") > eps).alias("above_eps"),
        F.min(F.when(F.col("cum") >= mass * share, F.col("rank"))).cast("long").alias("cumu_mass"),
        F.min_by("rank", F.struct(-(1 - x - y), F.col("rank"))).cast("long").alias("knee"),
    )
    last = F.when(F.col("last") == 0, F.coalesce("positive", F.lit(n))).otherwise(F.lit(n))
    found = stats.crossJoin(F.broadcast(flat))
    return found.select(last.cast("long").alias("last_nonzero"), "above_eps", F.coalesce("cumu_mass", F.lit(n)).cast("long").alias("cumu_mass"), "knee", F.coalesce(F.col("r") - 1 - skip, F.lit(n)).cast("long").alias("flat_tail"))
