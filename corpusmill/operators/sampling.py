"""Seeded samples in a hash order that any engine can repeat: exact in size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key))


def random_sample(rows: DataFrame, key: Column, limit: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(mark(seed, key)).limit(limit)


def stratified_sample(rows: DataFrame, key: Column, bucket: str, limit: int, seed: int = 0) -> DataFrame:
    """Buckets in turn, by name, each in its own hash order, until ``limit`` rows are taken."""
    w = Window.partitionBy(bucket).orderBy(mark(seed, key))
    return rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)
