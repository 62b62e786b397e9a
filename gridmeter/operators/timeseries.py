"""Regular grids, linear interpolation and period arithmetic.

Semantics follow ``Series.resample(every).interpolate()`` (pandas 2.x):

* the grid of a series runs from the floor of its first sample to the floor of
  its last sample, at multiples of ``every`` from ``origin``;
* only samples that sit exactly on the grid contribute (off-grid ones are
  dropped by the up-sampling step);
* grid points between two contributing samples are linear in time;
* grid points before the first contributing sample stay null, points after the
  last one hold its value (``tail="hold"``; ``"extend"`` continues the last
  slope, ``"none"`` leaves them null).

Scale: no task holds a whole series. Samples are range-sorted into slices, and
what a slice needs of its neighbours (the last known sample before it, the next
one after it) is carried over as a small table (``windows.neighbours``). Each
segment between two samples expands itself; segments, heads and tails are cut
into ``bucket_steps`` grid steps before they expand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions.time import Grid, index_to_clock, period_index, step_in_period, step_index
from gridmeter.operators.keys import broadcast_small, join_groups
from gridmeter.operators.windows import neighbours, sliced
from gridmeter.session import checkpoint_dir

_GI = "_gm_gi"
_B = "_gm_b"


def _grid(every_minutes: int, origin: str) -> Grid:
    return Grid(step_minutes=every_minutes, base=origin)


def _reduced(df: DataFrame, ts: str, value: str, keys: list[str], g: Grid) -> DataFrame:
    """The input reduced to one row per (series, grid step).

    ``value`` is the mean of the samples sitting exactly on that grid point
    (null when none does: off-grid samples only mark the step, for the grid
    bounds). A partial aggregate, so a hot grid point is combined in every task.
    """
    gi = step_index(ts, g, one_based=False)
    on = index_to_clock(gi, g, one_based=False) == F.col(ts).cast("timestamp_ntz")
    v = F.col(value).cast("double")
    return df.groupBy(*keys, gi.alias(_GI)).agg(F.avg(F.when(on, v)).alias(value))


def _per_step(df: DataFrame, ts: str, value: str, keys: list[str], g: Grid) -> DataFrame:
    """``_reduced``, checkpointed to the shared folder: every later branch reads
    this table instead of re-reading (and re-aggregating) the input."""
    checkpoint_dir(df.sparkSession)
    return _reduced(df, ts, value, keys, g).checkpoint(eager=True)


def _series_bounds(per_step: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: first and last grid step covered by any sample."""
    return per_step.groupBy(*keys).agg(F.min(_GI).alias("_gm_start"), F.max(_GI).alias("_gm_end"))


def resample_grid(
    df: DataFrame,
    ts: str,
    value: str,
    by: Sequence[str] = (),
    every_minutes: int = 5,
    origin: str = "1970-01-01 00:00:00",
    bucket_steps: int = 288,
) -> DataFrame:
    """One row per grid point of each series; on-grid samples keep their
    value, every other grid point is null. Output ``(*by, ts, value)``."""
    g = _grid(every_minutes, origin)
    keys = list(by)
    per_step = _per_step(df, ts, value, keys, g)
    bounds = _series_bounds(per_step, keys)
    # two-step explode: buckets first, then steps, so no single row expands a
    # whole multi-year series inside one task
    buckets = bounds.select(
        *keys, "_gm_start", "_gm_end",
        F.explode(F.sequence(F.floor(F.col("_gm_start") / bucket_steps).cast("long"),
                             F.floor(F.col("_gm_end") / bucket_steps).cast("long"))).alias(_B),
    )
    lo = F.greatest(F.col("_gm_start"), F.col(_B) * bucket_steps)
    hi = F.least(F.col("_gm_end"), F.col(_B) * bucket_steps + bucket_steps - 1)
    grid = buckets.repartition(*keys, _B).select(*keys, F.explode(F.sequence(lo, hi)).alias(_GI))
    # several samples at one grid point: their mean (pandas would refuse them)
    samples = per_step.where(F.col(value).isNotNull())
    out = grid.join(samples, [*keys, _GI], "left")
    return out.select(*keys, index_to_clock(F.col(_GI), g, one_based=False).alias(ts), F.col(value))


def interpolate_linear(
    df: DataFrame,
    ts: str,
    value: str,
    by: Sequence[str] = (),
    every_minutes: int = 5,
    origin: str = "1970-01-01 00:00:00",
    tail: str = "hold",
    bucket_steps: int = 288,
) -> DataFrame:
    """Linear interpolation of ``value`` onto the grid, per series.

    Output ``(*by, ts, value)`` with one row per grid point. ``tail`` decides
    the points after the last on-grid sample (see module doc).
    """
    if tail not in ("hold", "extend", "none"):
        raise ValueError("tail must be 'hold', 'extend' or 'none'")
    g = _grid(every_minutes, origin)
    keys = list(by)
    # several samples at one grid point: their mean (pandas would refuse them)
    steps = sliced(_reduced(df, ts, value, keys, g), [*keys, _GI])
    known = F.col(value).isNotNull()
    here = F.when(known, F.col(_GI))
    # per series: its grid's ends, and its first and last sample
    series = steps.groupBy(*keys).agg(
        F.min(_GI).alias("_gm_start"), F.max(_GI).alias("_gm_end"), F.min(here).alias("_gm_first"),
        F.max(here).alias("_gm_last"), F.max_by(value, here).alias("_gm_v"),
    )
    seg = neighbours(steps.where(known), _GI, [_GI, value], keys)
    # a piece of the grid, ``_gm_lo`` to ``_gm_hi``: value + slope * (steps from ``_gm_at``) / ``_gm_n``
    after = F.col("_gm_after")
    interior = seg.where(after.isNotNull()).select(
        *keys, F.col(_GI).alias("_gm_at"), F.col(_GI).alias("_gm_lo"), (after[_GI] - 1).alias("_gm_hi"),
        F.col(value).alias("_gm_v"), (after[value] - F.col(value)).alias("_gm_dv"), (after[_GI] - F.col(_GI)).alias("_gm_n"),
    )
    if tail == "extend":
        # the last segment's slope needs the sample before the last one
        ends, before = seg.where(after.isNull()), F.col("_gm_before")
        ends = ends.select(*keys, (F.col(value) - before[value]).alias("_gm_dv"), (F.col(_GI) - before[_GI]).alias("_gm_n"))
        tails = join_groups(series, ends, keys, ["_gm_dv", "_gm_n"])
        slope, n = F.coalesce("_gm_dv", F.lit(0.0)), F.coalesce("_gm_n", F.lit(1))
    else:
        tails, n = series, F.lit(1)
        slope = F.lit(0.0) if tail == "hold" else F.lit(None).cast("double")
    tails = tails.where("_gm_last is not null").select(
        *keys, F.col("_gm_last").alias("_gm_at"), F.col("_gm_last").alias("_gm_lo"), F.col("_gm_end").alias("_gm_hi"),
        "_gm_v", slope.cast("double").alias("_gm_dv"), n.cast("long").alias("_gm_n"),
    )
    # grid points before the first on-grid sample stay null; so does a series without one
    head_end = F.coalesce(F.col("_gm_first") - 1, F.col("_gm_end"))
    none = F.lit(None).cast("double")
    heads = series.where(head_end >= F.col("_gm_start")).select(
        *keys, F.col("_gm_start").alias("_gm_at"), F.col("_gm_start").alias("_gm_lo"), head_end.alias("_gm_hi"),
        none.alias("_gm_v"), none.alias("_gm_dv"), F.lit(1).cast("long").alias("_gm_n"),
    )
    # a head or tail may be most of a series: its cuts are dealt out before they expand
    outer = _cut(tails.unionByName(heads), bucket_steps).repartition(*keys, "_gm_lo")
    grid = _cut(interior, bucket_steps).unionByName(outer)
    grid = grid.select("*", F.explode(F.sequence("_gm_lo", "_gm_hi")).alias(_GI))
    k = F.col(_GI) - F.col("_gm_at")
    at = F.when(k == 0, F.col("_gm_v")).otherwise(F.col("_gm_v") + F.col("_gm_dv") * k / F.col("_gm_n"))
    return grid.select(*keys, index_to_clock(F.col(_GI), g, one_based=False).alias(ts), at.alias(value))


def _cut(pieces: DataFrame, steps: int) -> DataFrame:
    """Pieces of a grid cut into such of at most ``steps`` steps."""
    cuts = pieces.select("*", F.explode(F.sequence("_gm_lo", "_gm_hi", F.lit(steps).cast("long"))).alias("_gm_cut"))
    return cuts.withColumns({"_gm_lo": F.col("_gm_cut"), "_gm_hi": F.least(F.col("_gm_hi"), F.col("_gm_cut") + (steps - 1))}).drop("_gm_cut")


def interpolate_columns(
    df: DataFrame,
    ts: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    name: str = "name",
    **kw,
) -> DataFrame:
    """T2 for several value columns at once, returned long: ``(*by, name, ts, value)``.

    Each column is its own series (pandas interpolates column by column).
    """
    long = df.unpivot([*by, ts], list(values), name, "value")
    return interpolate_linear(long, ts, "value", by=[*by, name], **kw)


def interpolate_month_to_day(
    df: DataFrame, ts: str, values: Sequence[str], name: str = "Hour", value_name: str = "gen", tail: str = "hold"
) -> DataFrame:
    """Month rows x time-of-day columns -> daily rows, long
    ``(ts, name, value_name)``: daily linear interpolation, then unpivot."""
    out = interpolate_columns(df, ts, values, name=name, every_minutes=24 * 60, tail=tail, bucket_steps=31)
    return out.withColumnRenamed("value", value_name)


# --- T4 / T5 / T6 periods ----------------------------------------------------

def assign_period(df: DataFrame, index: str, steps: int, out: str = "Period_Index") -> DataFrame:
    """T4: 1-based step -> 1-based period of ``steps`` steps (fixes D5)."""
    return df.withColumn(out, period_index(index, steps))


def split_period_index(
    df: DataFrame, index: str, steps: int, period: str = "Rep_Period", step: str = "Step"
) -> DataFrame:
    """T5: index -> (period number, 0-based step within the period)."""
    return df.withColumn(period, period_index(index, steps)).withColumn(step, step_in_period(index, steps))


def slice_period(df: DataFrame, index: str, period: int, steps: int) -> DataFrame:
    """O3: all ``steps`` rows of one period, ``(p-1)*steps+1 .. p*steps`` (fixes D4)."""
    lo = (period - 1) * steps + 1
    return df.where(F.col(index).between(lo, lo + steps - 1))


# most periods of a map that is broadcast
MAP_ROWS = 100_000


def expand_period_map(
    reduced: DataFrame,
    period_map: DataFrame,
    steps: int,
    rep_index: str = "Rep_Period_Index",
    step: str = "Step",
    period: str = "Period_Index",
    out_index: str = "Time_Index",
) -> DataFrame:
    """Put a reduced series (rep period index, step, values) back onto every
    period of the year. A map of up to ``MAP_ROWS`` periods (counted) is
    broadcast; the reduced series is the big side."""
    m = broadcast_small(period_map.select(period, rep_index), MAP_ROWS)
    out = reduced.join(m, rep_index, "inner")
    return out.withColumn(out_index, (F.col(period) - 1) * steps + F.col(step) + 1)


# --- T8 day profiles ---------------------------------------------------------

def day_profile_long(
    df: DataFrame, ts: str, day_types: Sequence[str] = ("Weekday", "Weekend"), value: str = "EV_load",
    weekday_label: str = "Weekday", minutes: str = "Time", flag: str = "Weekday",
) -> DataFrame:
    """A day profile with one column per day type -> long rows keyed by
    (minutes since the first row, weekday flag). ``minutes`` is counted from
    the earliest timestamp (W4), taken as a scalar subquery."""
    t0 = df.select(F.min(ts)).scalar()  # scalar subquery, one value
    m = F.timestamp_diff("MINUTE", t0, F.col(ts)).cast("int").alias(minutes)
    with_min = df.select(m, *[c for c in day_types])  # the time column may share the output's name
    long = with_min.unpivot([minutes], list(day_types), "_gm_day", value)
    return long.select(minutes, (F.col("_gm_day") == weekday_label).alias(flag), value)
