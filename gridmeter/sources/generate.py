"""Generated tables (S11, S12), built from data-derived bounds or short literal lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gen_range(spark: SparkSession, start: int, end_inclusive: int, name: str = "Time_Index",
              constants: dict | None = None) -> DataFrame:
    """One row per integer in [start, end] plus constant columns,
    e.g. the zero-price fuel table. ``spark.range`` splits the range over
    tasks; nothing is built on the driver."""
    df = spark.range(start, end_inclusive + 1).withColumnRenamed("id", name)
    for k, v in (constants or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df


def literal_product(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """Every combination of short literal lists (dates x orientations):
    chained ``explode`` of literal arrays on a single row, no join."""
    df = spark.range(1).select()
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
