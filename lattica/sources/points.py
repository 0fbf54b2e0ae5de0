"""Point tables: validation, Parquet in and out, and a two-component Gaussian generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_points(df: DataFrame, id_col: str = "id", features_col: str = "features", label_col: str | None = None) -> DataFrame:
    """points(id, features[, label]) from any table; rows without id or features are left out."""
    missing = {c for c in (id_col, features_col, label_col) if c and c not in df.columns}
    if missing:
        raise ValueError(f"no such column: {', '.join(sorted(missing))}")
    columns = [F.col(id_col).cast("long").alias("id"), F.col(features_col).cast("array<double>").alias("features")]
    if label_col:
        columns.append(F.col(label_col).cast("int").alias("label"))
    return df.select(*columns).where("id is not null and features is not null")


def read_points(spark: SparkSession, path: str, id_col: str = "id", features_col: str = "features", label_col: str | None = None) -> DataFrame:
    return as_points(spark.read.parquet(path), id_col, features_col, label_col)


def write_results(folder: str, **tables: DataFrame) -> None:
    """Write each named table to folder/name as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def gaussian_pair(spark: SparkSession, n: int, d: int = 10, gamma: float = 0.5, seed: int = 42) -> DataFrame:
    """Two Gaussians of equal weight, means 0 and gamma in each dimension, sharing the covariance A A' / d where A is the
    identity plus 0.2 above the diagonal."""
    normals = F.array(*[F.randn(seed + j) for j in range(d)])
    base = spark.range(n).select("id", (F.rand(seed + d) < 0.5).cast("int").alias("label"), normals.alias("z"))
    mixed = [(F.col("z")[i] + 0.2 * sum((F.col("z")[j] for j in range(i + 1, d)), F.lit(0.0))) / F.sqrt(F.lit(float(d))) + gamma * F.col("label") for i in range(d)]
    return base.select("id", F.array(*mixed).alias("features"), "label")
