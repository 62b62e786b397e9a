"""A planning-run case folder -> the study's reports.

Layout (as the optimizer writes it; names are parameters):

  <case>/Load_data.csv                     Time_Index, Load_MW_z1
  <case>/TDR_Results/Period_map.csv        Period_Index, Rep_Period, Rep_Period_Index
  <case>/<results>/prices.csv              wide: Zone label, one column per zone
  <case>/<results>/ReserveMargin_w.csv     wide: Constraint label, CapRes_1
  <case>/<results>/power.csv, charge.csv, curtail.csv, storage.csv   wide by resource
  <case>/<results>/capacity.csv, NetRevenue.csv                      report tables

Wide files are read by their ``tN`` labels, so 0, 1 or 2 metadata rows are
all fine. Every report is a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.functions.time import Grid
from gridmeter.plans import analysis as A
from gridmeter.sources.csv import read_csv_typed
from gridmeter.sources.results import scan_result_report, scan_solver_wide


@dataclass
class Case:
    load: DataFrame  # (Time_Index, Load)
    price: DataFrame  # (Time_Index, price)
    scarcity: DataFrame  # (Time_Index, shdw)
    power: DataFrame  # (Time_Index, Resource, value)
    charge: DataFrame
    curtail: DataFrame
    storage: DataFrame
    capacity: DataFrame  # report table, with its Total row
    net_revenue: DataFrame
    period_map: DataFrame | None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of its own file system."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_case(spark: SparkSession, case_dir: str, results: str = "Results", zone: str = "1",
              reserve_col: str = "CapRes_1", load_col: str = "Load_MW_z1") -> Case:
    r = f"{case_dir.rstrip('/')}/{results}"

    def wide(name: str, col_name: str = "Resource") -> DataFrame:
        return scan_solver_wide(spark, f"{r}/{name}", name=col_name)

    load = read_csv_typed(spark, f"{case_dir}/Load_data.csv", {"Time_Index": "long", load_col: "double"}).select(
        "Time_Index", F.col(load_col).alias("Load")
    )
    price = wide("prices.csv", "Zone").where(F.col("Zone") == zone).select("Time_Index", F.col("value").alias("price"))
    scarcity = wide("ReserveMargin_w.csv", "Constraint").where(F.col("Constraint") == reserve_col).select(
        "Time_Index", F.col("value").alias("shdw")
    )
    # the Total column of a wide file is a report, not a resource
    res = {n: wide(f"{n}.csv").where(F.col("Resource") != "Total") for n in ("power", "charge", "curtail", "storage")}
    pm_path = f"{case_dir}/TDR_Results/Period_map.csv"
    pmap = (
        read_csv_typed(spark, pm_path, {"Period_Index": "long", "Rep_Period": "long", "Rep_Period_Index": "long"})
        if path_exists(spark, pm_path) else None
    )
    return Case(load, price, scarcity, res["power"], res["charge"], res["curtail"], res["storage"],
                scan_result_report(spark, f"{r}/capacity.csv"), scan_result_report(spark, f"{r}/NetRevenue.csv"), pmap)


def representative_of(period_map: DataFrame, bin_: int) -> DataFrame:
    """the representative period of a bin of the period map (one row)."""
    return period_map.where((F.col("Rep_Period_Index") == bin_) & (F.col("Period_Index") == F.col("Rep_Period"))).select("Rep_Period")


def over_horizon(series: DataFrame, period_map: DataFrame, steps: int) -> DataFrame:
    """A step series of a reduced run on every step of the horizon."""
    from gridmeter.functions.time import step_in_period
    from gridmeter.operators.timeseries import expand_period_map

    bins = (F.floor((F.col("Time_Index") - 1) / steps) + 1).cast("long")
    parts = series.select(bins.alias("Rep_Period_Index"), step_in_period("Time_Index", steps).alias("Step"), *[c for c in series.columns if c != "Time_Index"])
    return expand_period_map(parts, period_map, steps).select(*series.columns)


def reports(case: Case, grid: Grid, show_period: int = 1, month: int = 7,
            wind: tuple[str, ...] = ("wind",), solar: tuple[str, ...] = ("solar",),
            battery: tuple[str, ...] = ("battery",), pumped: tuple[str, ...] = ("pumped_hydro",),
            levels: tuple[str, ...] = (), reduced: bool | None = None) -> dict[str, DataFrame]:
    """The study's report tables (Q11-Q22) for one case.

    ``reduced``: whether the results stand on the reduced index of the period
    map (default: whether there is a map). Then ``show_period`` is a bin, whose
    rows are read and whose representative period gives the clock shown, and
    step series are put back on every period before they meet the year's load.
    ``levels``: the order of resources in the capacity report."""
    from gridmeter.functions.labels import sign_by_membership
    from gridmeter.functions.numeric import per_hour
    from gridmeter.functions.time import index_to_clock, step_in_period
    from gridmeter.operators.aggregates import order_levels, ranks_of, semi_join_built, sum_filtered
    from gridmeter.operators.joins import right_join_keep_all
    from gridmeter.operators.reshape import net_of_charge
    from gridmeter.operators.timeseries import assign_period, slice_period

    steps = grid.steps_per_period
    reduced = case.period_map is not None if reduced is None else reduced
    if reduced:
        rep = representative_of(case.period_map, show_period).scalar()
        shown = index_to_clock((rep - 1) * steps + step_in_period("Time_Index", steps) + 1, grid)
        price, scarcity, curtail = (over_horizon(d, case.period_map, steps) for d in (case.price, case.scarcity, case.curtail))
    else:
        shown = index_to_clock("Time_Index", grid)
        price, scarcity, curtail = case.price, case.scarcity, case.curtail
    clock = shown.alias("clock")
    cap = case.capacity.where(F.col("Resource") != "Total")  # D2
    out: dict[str, DataFrame] = {}
    built = cap.where(F.col("EndCap") > 0)
    names = list(levels) or ranks_of(cap, "Resource")
    measures = [c for c in ("StartCap", "RetCap", "NewCap", "EndCap") if c in cap.columns]
    # Q12: end capacity, its three parts, and energy capacity, in the chart's order
    out["installed_capacity"] = order_levels(built.select("Resource", "EndCap"), "Resource", names).orderBy("level")
    out["capacity_changes"] = order_levels(built.unpivot(["Resource"], measures, "Measure", "MW"), "Resource", names).orderBy("level", "Measure")
    out["energy_capacity"] = order_levels(cap.where(F.col("EndEnergyCap") > 0).select("Resource", "EndEnergyCap"), "Resource", names).orderBy("level")
    out["storage_energy_totals"] = sum_filtered(cap, "EndEnergyCap", {
        "total": F.lit(True), "battery": F.col("Resource").isin(list(battery)),
        "pumped_hydro": F.col("Resource").isin(list(pumped)),
    })
    week = lambda d: slice_period(d, "Time_Index", show_period, steps)
    out["dispatch_week"] = semi_join_built(
        net_of_charge(week(case.power), week(case.charge), ["Time_Index", "Resource"]), cap, "Resource"
    ).select("Time_Index", clock, "Resource", "net")
    out["price_week"] = week(case.price).select(
        "Time_Index", clock, per_hour("price", grid.steps_per_hour).alias("price")
    )
    total_e = cap.select(F.sum("EndEnergyCap")).scalar()
    st = week(case.storage)
    out["state_of_charge_week"] = st.join(
        st.groupBy("Time_Index").agg(F.sum("value").alias("_s")), "Time_Index"
    ).select("Time_Index", clock, "Resource", "value", F.try_divide(F.col("_s"), total_e).alias("total_soc"))
    out["scarcity_week"] = week(case.scarcity).select("Time_Index", clock, "shdw")
    net = case.net_revenue.where(F.col("Resource") != "Total")
    groups = net.select(
        "Resource",
        (F.col("Inv_cost_MW") + F.col("Inv_cost_MWh")).alias("Investment"),
        (F.col("Fixed_OM_cost_MW") + F.col("Fixed_OM_cost_MWh") + F.col("Var_OM_cost_out") + F.col("Var_OM_cost_in")).alias("OM"),
        F.col("Charge_cost").alias("Charge"),
        F.col("EnergyRevenue").alias("Energy"),
        (F.col("ReserveMarginRevenue") if "ReserveMarginRevenue" in net.columns else F.lit(0.0)).alias("RA"),
    )
    long = groups.unpivot(["Resource"], ["Investment", "OM", "Charge", "Energy", "RA"], "Category", "value")
    out["cost_revenue_breakdown"] = semi_join_built(
        long.withColumn("value_MM", sign_by_membership("Category", ["Energy", "RA"]) * F.col("value") / F.lit(1e6)), cap, "Resource"
    ).select("Resource", "Category", "value_MM")
    out["demand_price_summary"] = A.demand_price_summary(case.load, price, scarcity, grid)
    out["scarcity_cost_total"] = A.scarcity_cost_total(case.load, scarcity)
    out["july_scarcity"] = A.scarcity_by_day_time(case.load, scarcity, grid, month=month)
    out["curtailment_by_month_hour"] = A.curtailment_by_month_hour(curtail, grid, wind, solar)
    if case.period_map is not None:
        # the study joins first and then takes the hourly steps: a period without one disappears
        j = right_join_keep_all(assign_period(case.load, "Time_Index", steps), case.period_map, "Period_Index")
        j = j.where(F.pmod("Time_Index", F.lit(int(grid.steps_per_hour))) == 0)
        reps = case.period_map.select(F.col("Rep_Period").alias("_rp")).distinct()
        j = j.join(reps, j["Period_Index"] == reps["_rp"], "left")
        out["representative_periods"] = j.select(
            "Time_Index", "Period_Index", "Rep_Period", "Rep_Period_Index", F.col("_rp").isNotNull().alias("Representative"),
            index_to_clock("Time_Index", grid).alias("clock"), "Load",
        )
    return out
