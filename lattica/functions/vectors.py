"""Vector arithmetic and the adaptive heat kernel as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1e-12 keeps zero vectors finite."""
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))


def kernel_target(count: Column, threshold: float | None) -> Column:
    """Sum that a row's weights should reach: 1 for one neighbour, 1 + c/2 up to five, then log2(c) or the threshold."""
    late = F.log2(count.cast("double")) if threshold is None else F.lit(float(threshold))
    return F.when(count == 1, 1.0).when(count <= 5, 1 + count / 2).otherwise(late)


def kernel_sigma(distances: Column, target: Column, steps: int = 64, low: float = 1e-8, high: float = 1e5) -> Column:
    """Bisection for the width at which sum(exp(-(d - d_min) / sigma)) meets the target; distances are sorted."""
    rho = F.element_at(distances, 1)

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        total = F.aggregate(distances, F.lit(0.0), lambda s, d: s + F.exp(-(d - rho) / middle))
        return F.struct(F.when(total > target, acc["lo"]).otherwise(middle).alias("lo"), F.when(total > target, middle).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def clip(value: Column, limit: float = 4.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), value))
