"""File-to-report runners for the study's other two workflows.

* load assembly: coarse profiles -> 5-minute grid (T1/T2), then net load
  from the provided load, DG output and the EV day profile (Q6-Q9);
* distributed solar: the interconnection list -> cumulative capacity by
  orientation, projection, summary and angle densities (Q1-Q5).

Inputs are CSV paths (any number of files per path pattern); outputs are
lazy DataFrames, to be written with ``sources.csv.write_csv`` or Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.plans import analysis as A

TS_FORMAT = "M/d/yy H:mm"  # the %D %R files


# --- load assembly ---------------------------------------------------------------

def profile_to_grid(spark: SparkSession, path: str, ts_col: str = "Datetime", ts_format: str = TS_FORMAT,
                    every_minutes: int = 5, tail: str = "hold") -> DataFrame:
    """T1 + T2 on a file: every value column linearly onto the grid; wide
    output (``ts_col`` + the value columns) in time order, as the interpolation
    step writes."""
    from gridmeter.operators.timeseries import interpolate_columns
    from gridmeter.sources.csv import read_time_indexed

    df = read_time_indexed(spark, path, ts_col, ts_format)
    values = [c for c in df.columns if c != ts_col]
    long = interpolate_columns(df, ts_col, values, name="_gm_name", every_minutes=every_minutes, tail=tail)
    return long.groupBy(ts_col).pivot("_gm_name", values).agg(F.first("value")).orderBy(ts_col)


def interpolate_file(spark: SparkSession, source: str, target: str, ts_col: str = "Datetime", ts_format: str = TS_FORMAT,
                     every_minutes: int = 5, tail: str = "hold") -> None:
    """T1 + T2 + K2, file to file: ``profile_to_grid`` of ``source``, written to
    ``target`` in time order, with its times in the format of the source."""
    from gridmeter.sources.csv import write_ordered_csv

    grid = profile_to_grid(spark, source, ts_col, ts_format, every_minutes, tail)
    place = grid.withColumn("_gm_t", F.col(ts_col)).withColumn(ts_col, F.date_format(ts_col, ts_format))
    write_ordered_csv(place, target, ["_gm_t"], keep=grid.columns)


def net_load_from_files(spark: SparkSession, load_path: str, dg_path: str, ev_path: str, year: int | None,
                        ts_format: str = TS_FORMAT, steps_per_hour: float = 12.0,
                        load_col: str = "Load (MW)", day_types: Sequence[str] = ("Weekday", "Weekend")) -> DataFrame:
    """Q6: provided load (Datetime, Load (MW)) <- DG (Datetime, Gen), x the EV
    day profile (Time, Weekday, Weekend) keyed by minutes since its first row
    and the weekday flag (T8)."""
    from gridmeter.operators.timeseries import day_profile_long
    from gridmeter.sources.csv import read_csv_typed

    load = read_csv_typed(spark, load_path, {"Datetime": "timestamp", load_col: "double"}, ts_format).select(
        "Datetime", F.col(load_col).alias("Load")
    )
    dg = read_csv_typed(spark, dg_path, {"Datetime": "timestamp", "Gen": "double"}, ts_format).select("Datetime", "Gen")
    ev = read_csv_typed(spark, ev_path, {"Time": "timestamp", **{d: "double" for d in day_types}}, ts_format)
    prof = day_profile_long(ev, "Time", day_types=day_types, value="EV_load")
    return A.net_load_5min(load, dg, prof, year=year, steps_per_hour=steps_per_hour)


# --- distributed solar --------------------------------------------------------------

def read_dg_sites(spark: SparkSession, path: str, technology: str = "Solar", after: str = "2012-12-31",
                  tie: Sequence[str] = ()) -> DataFrame:
    """The interconnection list with base-R names (S10), typed: approval date,
    azimuth and tilt as tolerant numbers (X9), size in kW; filtered to one
    technology approved after ``after`` (F1). ``_row`` breaks the tie of equal
    dates (D16): the columns ``tie`` (base-R names), by default all columns, so
    the order doesn't depend on how files are split."""
    from gridmeter.functions.time import parse_date
    from gridmeter.sources.csv import mangle_names

    raw = mangle_names(spark.read.option("header", True).csv(path))
    typed = raw.select(
        parse_date(F.trim(F.col("`App.Approved.Date`"))).alias("date"),
        F.trim(F.col("`Technology.Type`")).alias("technology"),
        F.trim(F.col("Azimuth")).try_cast("double").alias("azimuth"),
        F.trim(F.col("Tilt")).try_cast("double").alias("tilt"),
        F.trim(F.col("`System.Size.AC`")).try_cast("double").alias("size_kw"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in (tie or raw.columns)])).alias("_row"),
    )
    return typed.where((F.col("technology") == technology) & (F.col("date") > F.lit(after).cast("date")))


def dg_reports(sites: DataFrame, ratio: float = A.SERVICE_AREA_RATIO, train_after: str = "2017-12-31",
               at: Sequence[str] = ("2018-01-01", "2025-01-01"), label_at: str = "2025-01-01",
               tilt_below: float = 45.0) -> dict[str, DataFrame]:
    """Q1-Q5 for the typed site list of ``read_dg_sites``."""
    from gridmeter.functions.labels import orientation
    from gridmeter.operators.stats import kernel_density

    s = sites.withColumn("Orientation", orientation("azimuth"))
    by_o = A.dg_cumulative(s, "date", "size_kw", "_row", orientation_col="Orientation", ratio=ratio)
    out = {
        "cumulative_by_orientation": by_o.select("date", "Orientation", "capacity_mw"),
        "cumulative_total": A.dg_cumulative(s, "date", "size_kw", "_row", ratio=ratio).select("date", "capacity_mw"),
        "orientation_summary": A.dg_orientation_summary(s, "azimuth", "size_kw", ratio=ratio),
        "azimuth_density": kernel_density(s, "azimuth", adjust=0.05, domain="data"),
        "tilt_density": kernel_density(s.where(F.col("tilt") < tilt_below), "tilt", adjust=1.0, domain="data"),
    }
    out["projection"] = A.dg_projection(by_o, "date", "capacity_mw", "Orientation", train_after, at, label_at)
    return out


def hydro_variability_from_file(spark: SparkSession, path: str, year: int | None, ts_col: str = "Datetime",
                                ts_format: str = TS_FORMAT, name: str = "Hour", value: str = "gen") -> DataFrame:
    """Q8: a daily x time-of-day wide table (after T3) -> long
    ``(Datetime, Hour, gen)`` for one year (F2 as a timestamp range, R1)."""
    from gridmeter.operators.reshape import unpivot_all_but
    from gridmeter.sources.csv import read_time_indexed

    df = read_time_indexed(spark, path, ts_col, ts_format)
    if year is not None:
        lo = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")
        df = df.where((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))
    return unpivot_all_but(df, [ts_col], name, value)


def fleet_from_site_files(spark: SparkSession, path: str, value: str = "gen", site_col: str = "site") -> DataFrame:
    """Q10 (S4 + U1 + G7): per-site series files (two metadata lines, then
    year, month, day, hour, minute, value) read in one scan, the site taken
    from each file name; output the fleet total per timestamp and the number
    of sites reporting."""
    from pyspark.sql import types as T

    from gridmeter.sources.csv import read_skip_meta

    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("year", "month", "day", "hour", "minute")]
                          + [T.StructField(value, T.DoubleType())])
    rows = read_skip_meta(spark, path, schema, site_col=site_col)
    ts = F.make_timestamp_ntz(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("minute"), F.lit(0))
    return rows.groupBy(ts.alias("Datetime")).agg(
        F.sum(value).alias("total"), F.countDistinct(site_col).alias("sites")
    )
