"""The step-series aggregation over a file stream (no new operator).

The study reads complete files only; this module runs the same first step
every report starts from - readings -> per-step, per-series sums and means
on a regular grid - as a Structured Streaming query, so meter files can be
folded in as they land. Late readings are accepted up to ``late_minutes``
behind the newest one (watermark); closed steps are appended to the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridmeter.functions.time import Grid, step_index


def read_readings(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the files in ``source`` (explicit schema)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source)


def step_series(readings: DataFrame, ts: str, value: str, by: Sequence[str], grid: Grid,
                late_minutes: int = 30) -> DataFrame:
    """Per (step, series): sum, mean and count of ``value``; steps close once
    the watermark passes their end. Works on batch DataFrames as well."""
    src = readings.withColumn(ts, F.col(ts).cast("timestamp"))
    if readings.isStreaming:
        src = src.withWatermark(ts, f"{late_minutes} minutes")
    w = F.window(F.col(ts), f"{grid.step_minutes} minutes")  # on the watermarked column itself
    agg = src.groupBy(w.alias("step"), *by).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(
        F.col("step.start").cast("timestamp_ntz").alias("ts"),
        step_index(F.col("step.start").cast("timestamp_ntz"), grid).alias("Time_Index"),
        *by, "total", "mean", "n",
    )


def start_step_series(readings: DataFrame, ts: str, value: str, by: Sequence[str], grid: Grid, sink: str,
                      checkpoint: str, late_minutes: int = 30, fmt: str = "parquet",
                      trigger_seconds: int | None = None) -> StreamingQuery:
    """Run ``step_series`` continuously, appending closed steps to ``sink``.
    ``checkpoint`` must be a shared folder (the query's state and progress)."""
    out = step_series(readings, ts, value, by, grid, late_minutes)
    w = out.writeStream.outputMode("append").format(fmt).option("path", sink).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
