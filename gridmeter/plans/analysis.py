"""End-user analyses (Q1-Q23) over DataFrames named by role, not by file.

Each function takes the study's inputs as DataFrames (already read with the
``sources`` readers, or derived from other tables) and returns the data behind
one chart or table of the study. Parameters the scripts hard-coded (ratios,
periods, dates) are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.functions.time import Grid, index_to_clock, time_of_day
from gridmeter.operators.aggregates import day_hour_profile, month_hour_profile
from gridmeter.operators.joins import left_join_chain


def _clocked(load: DataFrame, others: Sequence[DataFrame], grid: Grid, index: str = "Time_Index") -> DataFrame:
    """J5 + X6: step series left-joined on the step index, with their clock."""
    j = left_join_chain(load, others, [index])
    return j.withColumn("clock", index_to_clock(index, grid))


def demand_price_summary(
    load: DataFrame, price: DataFrame, scarcity: DataFrame, grid: Grid, by_day: bool = False,
    load_col: str = "Load", price_col: str = "price", scarcity_col: str = "shdw",
) -> DataFrame:
    """Demand, hourly price and scarcity price by (month | day, hour).

    Price per step is scaled to per-hour once (fixes D7)."""
    j = _clocked(load, [price, scarcity], grid)
    aggs = [
        F.sum(load_col).alias("demand"),
        (F.avg(price_col) * F.lit(grid.steps_per_hour)).alias("price"),
        F.sum(scarcity_col).alias("scarcity"),
    ]
    prof = day_hour_profile if by_day else month_hour_profile
    return prof(j, "clock", aggs)


def scarcity_cost_total(load: DataFrame, scarcity: DataFrame, load_col: str = "Load", scarcity_col: str = "shdw") -> DataFrame:
    """Sum over steps of scarcity price x load (one row)."""
    j = left_join_chain(load, [scarcity], ["Time_Index"])
    return j.agg(F.sum(F.col(scarcity_col) * F.col(load_col)).alias("scarcity_cost"))


def scarcity_by_day_time(
    load: DataFrame, scarcity: DataFrame, grid: Grid, month: int, scarcity_col: str = "shdw"
) -> DataFrame:
    """Q21: one month's scarcity price by (day, time of day) (F9 + X5)."""
    j = _clocked(load, [scarcity], grid).where(F.month("clock") == month)
    return j.select(
        F.dayofmonth("clock").alias("day"), time_of_day("clock").alias("time"), F.col(scarcity_col).alias("price")
    )


def curtailment_by_month_hour(
    curtail: DataFrame, grid: Grid, wind: Sequence[str], solar: Sequence[str], by_day: bool = False
) -> DataFrame:
    """Curtailed energy (MWh) in total, of wind and of solar by
    (month | day, hour); one aggregate instead of three copies."""
    c = curtail.withColumn("clock", index_to_clock("Time_Index", grid))
    e = 1.0 / grid.steps_per_hour
    v = F.col("value")
    aggs = [
        (F.sum(v) * e).alias("total"),
        (F.sum(F.when(F.col("Resource").isin(list(wind)), v)) * e).alias("wind"),
        (F.sum(F.when(F.col("Resource").isin(list(solar)), v)) * e).alias("solar"),
    ]
    prof = day_hour_profile if by_day else month_hour_profile
    return prof(c, "clock", aggs)


# --- distributed solar ---------------------------------------------------------

# Fixed value of the study: share of the utility's distributed solar that lies
# in the study's service area.
SERVICE_AREA_RATIO = 0.01924


def dg_cumulative(
    sites: DataFrame, date: str, size_kw: str, tie: str, orientation_col: str | None = None,
    ratio: float = SERVICE_AREA_RATIO, out: str = "capacity_mw",
) -> DataFrame:
    """Q1 / Q2 (W1 / W2): cumulative installed MW in approval-date order,
    per orientation (Q1) or in total (Q2): ``ratio * cumsum(size) / 1000``."""
    from gridmeter.operators.windows import cumsum

    by = [orientation_col] if orientation_col else []
    c = cumsum(sites, size_kw, order=[date, tie], by=by, out="_gm_cum")
    return c.withColumn(out, F.lit(ratio) * F.col("_gm_cum") / F.lit(1000.0)).drop("_gm_cum")


def dg_projection(
    cumulative: DataFrame, date: str, value: str, orientation_col: str, train_after: str, at: Sequence[str],
    label_at: str, unit: str = "MW",
) -> DataFrame:
    """Q3 (M1 + M2 + O5 + X11): a line per orientation fitted on the cumulative
    capacity after ``train_after`` (F10), evaluated at the dates ``at``; the
    rows at ``label_at`` carry a text label."""
    from gridmeter.functions.labels import concat_label
    from gridmeter.functions.time import days_since_epoch
    from gridmeter.operators.stats import grouped_linear_fit, predict_linear

    train = cumulative.where(F.col(date) > F.lit(train_after).cast("date"))
    coef = grouped_linear_fit(train, value, days_since_epoch(date), by=[orientation_col])
    pts = predict_linear(coef, list(at), x_name=date, x_expr=lambda c: days_since_epoch(c.cast("date")), out=value)
    pts = pts.withColumn(date, F.col(date).cast("date"))
    return pts.select(
        orientation_col, date, value,
        F.when(F.col(date) == F.lit(label_at).cast("date"), concat_label(value, unit)).alias("label"),
    )


def dg_orientation_summary(sites: DataFrame, azimuth: str, size_kw: str, ratio: float = SERVICE_AREA_RATIO) -> DataFrame:
    """Q4 (X8 + G3): installed MW by orientation."""
    from gridmeter.functions.labels import orientation

    return sites.groupBy(orientation(azimuth).alias("Orientation")).agg(
        (F.lit(ratio) * F.sum(size_kw) / F.lit(1000.0)).alias("area_MW_ac")
    )


# --- load assembly -------------------------------------------------------------

# Fixed value of the study: the utility's 2022 annual sales, MWh.
UTILITY_ANNUAL_SALES_MWH = 21300 * 1000


def net_load_5min(
    load: DataFrame, dg: DataFrame, ev_profile: DataFrame, year: int | None, steps_per_hour: float,
    annual_sales: float = UTILITY_ANNUAL_SALES_MWH, subtract_dg: bool = False,
) -> DataFrame:
    """Q6 (F2 + J1 + J2 + P10): load (Datetime, Load) <- DG (Datetime, Gen), x EV
    day profile (Time, Weekday, EV_load) on (minute of day, weekday).

    The EV share ratio is the load's annual energy over the utility's sales
    (fixes D8: the script summed a renamed column). The year filter is a
    timestamp range, so it reaches the scan.
    """
    from gridmeter.operators.joins import join_day_profile

    if year is not None:
        lo = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")
        load = load.where((F.col("Datetime") >= lo) & (F.col("Datetime") < hi))
    energy = load.select(F.sum("Load") / F.lit(float(steps_per_hour))).scalar()
    ratio = energy / F.lit(float(annual_sales))
    j = join_day_profile(load.join(dg, "Datetime", "left"), "Datetime", ev_profile)
    ev = ratio * F.col("EV_load") / F.lit(1000.0)
    net = F.col("Load") + ev
    if subtract_dg:
        net = net - F.coalesce(F.col("Gen"), F.lit(0.0))
    return j.select("Datetime", "Load", "Gen", ev.alias("EV_load"), net.alias("net_load"))


def fuels_table(index_max: DataFrame, col: str = "max_index") -> DataFrame:
    """Q7 (S11): zero-price fuel table over steps 0..max: ``(Time_Index, None)``.

    Only the bound comes to the driver (one number); ``spark.range`` then
    spreads the rows over tasks instead of exploding them from one row."""
    from gridmeter.sources.generate import gen_range

    hi = index_max.select(F.col(col).cast("long")).first()[0]
    return gen_range(index_max.sparkSession, 0, int(hi or 0), constants={"None": 0.0})
