"""A seeded example table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def sample_table(spark: SparkSession, rows: int = 120, seed: int = 42) -> DataFrame:
    """rooms, age, distance and a price that depends on them, plus noise."""

    def between(low: float, high: float, offset: int) -> Column:
        return F.rand(seed + offset) * (high - low) + low

    features = spark.range(rows).select(
        F.round(between(3.0, 9.0, 0), 1).alias("rooms"),
        F.round(between(1.0, 50.0, 1), 1).alias("age"),
        F.round(between(1.0, 15.0, 2), 2).alias("distance"),
        (F.randn(seed + 3) * 10.0).alias("noise"),
    )
    price = 50.0 + 25.0 * F.col("rooms") - 0.8 * F.col("age") - 2.0 * F.col("distance") + F.col("noise")
    return features.select("rooms", "age", "distance", F.round(price, 2).alias("price"))
