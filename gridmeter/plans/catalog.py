"""Registered queries: every analysis run on the driver's test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame that reads the
whole tables (no id subsets, no row caps). Doubles are rounded only at the
very end, for comparison with the SQL oracle in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.plans import analysis as A
from gridmeter.plans.tables import (
    EVENT_GRID,
    SOLAR_TYPE,
    WIND_TYPE,
    events,
    fixed_period_map,
    step_readings,
    load_series,
    price_series,
    resource_series,
    scarcity_series,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _r(col: str, digits: int = 4):
    return F.round(F.col(col), digits).alias(col)


@register("demand_price_summary")
def q_demand_price_summary(spark: SparkSession, sf: str) -> DataFrame:
    ev = step_readings(spark, sf)
    out = A.demand_price_summary(load_series(ev), price_series(ev), scarcity_series(ev), EVENT_GRID, by_day=True)
    return out.select("day", "hour", _r("demand"), _r("price"), _r("scarcity"))


@register("scarcity_cost_total")
def q_scarcity_cost_total(spark: SparkSession, sf: str) -> DataFrame:
    ev = step_readings(spark, sf)
    return A.scarcity_cost_total(load_series(ev), scarcity_series(ev)).select(_r("scarcity_cost", 2))


@register("july_scarcity")
def q_july_scarcity(spark: SparkSession, sf: str) -> DataFrame:
    ev = step_readings(spark, sf)
    out = A.scarcity_by_day_time(load_series(ev), scarcity_series(ev), EVENT_GRID, month=1)
    return out.select("day", "time", _r("price"))


@register("curtailment_by_month_hour")
def q_curtailment(spark: SparkSession, sf: str) -> DataFrame:
    ev = step_readings(spark, sf)
    out = A.curtailment_by_month_hour(resource_series(ev), EVENT_GRID, [WIND_TYPE], [SOLAR_TYPE], by_day=True)
    return out.select("day", "hour", _r("total"), _r("wind"), _r("solar"))


# --- distributed solar stand-ins: orders are installations ----------------------
# approval date = o_orderdate, size (kW, exact in cents) = o_totalprice,
# orientation = o_orderstatus, tie-break = o_orderkey

def _sites(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_orderstatus", "o_orderdate",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size_cents"),
    )


@register("cumsum_grouped")
def q_cumsum_grouped(spark: SparkSession, sf: str) -> DataFrame:
    c = A.dg_cumulative(_sites(spark, sf), "o_orderdate", "size_cents", "o_orderkey", orientation_col="o_orderstatus")
    return c.select("o_orderkey", "o_orderstatus", "o_orderdate", _r("capacity_mw", 6))


@register("cumsum_global")
def q_cumsum_global(spark: SparkSession, sf: str) -> DataFrame:
    c = A.dg_cumulative(_sites(spark, sf), "o_orderdate", "size_cents", "o_orderkey")
    return c.select("o_orderkey", "o_orderdate", _r("capacity_mw", 6))


def _dg_fit_input(spark, sf):
    return A.dg_cumulative(_sites(spark, sf), "o_orderdate", "size_cents", "o_orderkey", orientation_col="o_orderstatus")


@register("grouped_linear_fit")
def q_grouped_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import days_since_epoch
    from gridmeter.operators.stats import grouped_linear_fit

    train = _dg_fit_input(spark, sf).where(F.col("o_orderdate") > F.lit("1998-12-31").cast("date"))
    coef = grouped_linear_fit(train, "capacity_mw", days_since_epoch("o_orderdate"), by=["o_orderstatus"])
    return coef.select("o_orderstatus", _r("slope", 6), _r("intercept", 3), "n")


@register("predict_linear")
def q_predict_linear(spark: SparkSession, sf: str) -> DataFrame:
    p = A.dg_projection(_dg_fit_input(spark, sf), "o_orderdate", "capacity_mw", "o_orderstatus",
                        train_after="1998-12-31", at=["1999-01-01", "2003-01-01"], label_at="2003-01-01")
    return p.select("o_orderstatus", "o_orderdate", _r("capacity_mw", 3), "label")


@register("orientation_summary")
def q_orientation_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(
        (F.col("c_acctbal") / F.lit(20.0)).alias("azimuth"), F.abs("c_acctbal").alias("size_kw")
    )
    return A.dg_orientation_summary(c, "azimuth", "size_kw").select("Orientation", _r("area_MW_ac", 6))


# --- interval profiles ----------------------------------------------------------

def _hourly_by_type(spark, sf):
    from gridmeter.functions.time import floor_time

    ev = table(spark, sf, "events")
    return ev.groupBy("event_type", floor_time("ts", "hour").alias("ts")).agg(F.avg("value").alias("value"))


@register("interpolate_linear")
def q_interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.timeseries import interpolate_linear

    out = interpolate_linear(_hourly_by_type(spark, sf), "ts", "value", by=["event_type"], every_minutes=5)
    # interpolated 2-decimal means land on exact decimal halves: round half up
    # by the same IEEE steps as the SQL side so ties break identically
    return out.select("event_type", "ts", _half_up("value", 7))


@register("resample_grid")
def q_resample_grid(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.timeseries import resample_grid

    out = resample_grid(_hourly_by_type(spark, sf), "ts", "value", by=["event_type"], every_minutes=5)
    return out.select("event_type", "ts", _r("value"))


def _ev_profile(ev: DataFrame) -> DataFrame:
    """EV day profile (Time = minute of day, Weekday flag, EV_load = mean per-step
    charging of that minute and day type)."""
    from gridmeter.functions.time import index_to_clock, minute_of_day, weekday_flag
    from gridmeter.plans.tables import EV_TYPE, typed_series

    s = typed_series(ev, EV_TYPE, "ev").withColumn("clock", index_to_clock("Time_Index", EVENT_GRID))
    return s.groupBy(minute_of_day("clock").alias("Time"), weekday_flag("clock").alias("Weekday")).agg(
        F.avg("ev").alias("EV_load")
    )


@register("net_load_5min")
def q_net_load(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import index_to_clock
    from gridmeter.plans.tables import DG_TYPE, typed_series

    ev = step_readings(spark, sf)
    load = load_series(ev).select(index_to_clock("Time_Index", EVENT_GRID).alias("Datetime"), "Load")
    dg = typed_series(ev, DG_TYPE, "Gen").select(index_to_clock("Time_Index", EVENT_GRID).alias("Datetime"), "Gen")
    out = A.net_load_5min(load, dg, _ev_profile(ev), year=2024, steps_per_hour=EVENT_GRID.steps_per_hour)
    return out.select("Datetime", _r("Load"), _r("Gen"), _r("EV_load", 10), _r("net_load", 6))


@register("fuels_table")
def q_fuels_table(spark: SparkSession, sf: str) -> DataFrame:
    ev = step_readings(spark, sf)
    return A.fuels_table(ev.agg(F.max("Time_Index").alias("max_index")))


@register("assign_period")
def q_assign_period(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import index_to_clock
    from gridmeter.operators.timeseries import assign_period, split_period_index

    ev = events(spark, sf).select("event_id", "Time_Index")
    ev = assign_period(ev, "Time_Index", EVENT_GRID.steps_per_period)
    ev = split_period_index(ev, "Time_Index", EVENT_GRID.steps_per_period, period="Rep_Period", step="Step")
    return ev.withColumn("clock", index_to_clock("Time_Index", EVENT_GRID))


@register("slice_period")
def q_slice_period(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.timeseries import slice_period

    ev = step_readings(spark, sf)
    return slice_period(load_series(ev), "Time_Index", period=3, steps=EVENT_GRID.steps_per_period).select(
        "Time_Index", _r("Load")
    )


@register("filter_modulo")
def q_filter_modulo(spark: SparkSession, sf: str) -> DataFrame:
    ev = step_readings(spark, sf)
    steps_per_hour = int(EVENT_GRID.steps_per_hour)
    return load_series(ev).where(F.pmod("Time_Index", F.lit(steps_per_hour)) == 0).select("Time_Index", _r("Load"))


# --- joins ------------------------------------------------------------------------

@register("right_join_natural")
def q_right_join_natural(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.joins import right_join_keep_all

    sup = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n_suppliers"), F.sum("s_acctbal").alias("acctbal")
    )
    out = right_join_keep_all(sup, table(spark, sf, "nation"), "n_nationkey")
    return out.select("n_nationkey", "n_name", "n_suppliers", _r("acctbal", 2))


@register("semi_join_built")
def q_semi_join_built(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.aggregates import semi_join_built

    built = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("EndCap")
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return semi_join_built(part, built, "p_partkey")


@register("left_join_suffix")
def q_left_join_suffix(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.reshape import net_of_charge
    from gridmeter.plans.tables import charge_series

    ev = step_readings(spark, sf)
    out = net_of_charge(resource_series(ev), charge_series(ev), ["Time_Index", "Resource"])
    return out.select("Time_Index", "Resource", _r("value"), _r("value_c"), _r("net"))


# --- reshape ------------------------------------------------------------------------

@register("unpivot_all_but")
def q_unpivot_all_but(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.reshape import unpivot_all_but

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             "l_discount", "l_tax")
    return unpivot_all_but(li, ["l_orderkey", "l_linenumber"], "name", "value")


@register("pivot_wider")
def q_pivot_wider(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.reshape import pivot_wider

    li = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return pivot_wider(li, ["l_returnflag"], "l_linestatus", "qty", names=_names(table(spark, sf, "lineitem"), "l_linestatus"))


# --- fleets and curves ------------------------------------------------------------

@register("fleet_sum")
def q_fleet_sum(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.aggregates import fleet_sum

    return fleet_sum(table(spark, sf, "events"), "ts", "value", unit="minute").select("ts", _r("total"))


@register("fleet_generation")
def q_fleet_generation(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import floor_time
    from gridmeter.operators.reshape import union_sources

    ev = table(spark, sf, "events")
    pv = ev.where(F.col("event_type") == SOLAR_TYPE).select("ts", "value")
    wind = ev.where(F.col("event_type") == WIND_TYPE).select("ts", "value")
    both = union_sources([pv, wind], label="fleet", labels=["pv", "wind"])
    out = both.groupBy("fleet", floor_time("ts", "hour").alias("ts")).agg(F.sum("value").alias("total"))
    return out.select("fleet", "ts", _r("total"))


@register("power_curve")
def q_power_curve(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.curves import power_curve

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("speed"))
    return power_curve(li, "speed").select("l_orderkey", "l_linenumber", "speed", _r("kw"))


# --- statistics -----------------------------------------------------------------

@register("kernel_density")
def q_kernel_density(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.stats import kernel_density

    d = kernel_density(table(spark, sf, "customer"), "c_acctbal", adjust=1.0, n=512)
    return d.select("i", _r("x", 6), _r("density", 12))


@register("ecdf")
def q_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.stats import ecdf

    e = ecdf(table(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"])
    return e.select("o_orderpriority", "o_totalprice", "n_at", _r("ecdf", 10))


# --- settlement on the derived result set ---------------------------------------

def _sys(spark, sf):
    from gridmeter.plans.system import build

    return build(spark, sf)


def _names(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The values of a column that become column names; more than ``most`` raise an error."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


@register("period_weights")
def q_period_weights(spark: SparkSession, sf: str) -> DataFrame:
    s = _sys(spark, sf)
    return s.weights.select("Rep_Period", "Rep_Period_Index", "n_members", _r("weight", 9))


@register("step_weights")
def q_step_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _sys(spark, sf).step_w.select("Time_Index", _r("weight", 9))


def _sums(s) -> DataFrame:
    """Every weighted sum of the settlement, one pass over the step table."""
    from gridmeter.operators.settlement import settlement_sums
    from gridmeter.plans.system import KEY, settlement_terms

    return settlement_sums(s.steps, settlement_terms(), KEY)


@register("annual_sum")
def q_annual_sum(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.settlement import annual_sum
    from gridmeter.plans.system import KEY

    s = _sys(spark, sf)
    return annual_sum(s.values, s.horizon, KEY).select(*KEY, _r("AnnualSum", 2))


def _settled(s, quantity: str) -> DataFrame:
    from gridmeter.operators.settlement import settle
    from gridmeter.plans.system import KEY

    return settle(s.values.select("Time_Index", *KEY, quantity), s.price, s.horizon, KEY, value=quantity).select(*KEY, _r("AnnualSum", 2))


@register("charging_cost")
def q_charging_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _settled(_sys(spark, sf), "charge")


@register("energy_revenue")
def q_energy_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return _settled(_sys(spark, sf), "value")


@register("unpriced_steps")
def q_unpriced_steps(spark: SparkSession, sf: str) -> DataFrame:
    """How many steps of each resource have no price in their zone."""
    from gridmeter.operators.settlement import unmatched_steps
    from gridmeter.plans.system import KEY

    return unmatched_steps(_sys(spark, sf).steps, ["price", "shdw", "weight"], KEY)


@register("capacity_factor")
def q_capacity_factor(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.settlement import capacity_factor
    from gridmeter.plans.system import KEY, WEIGHT_TOTAL

    s = _sys(spark, sf)
    energy = _sums(s).select(*KEY, F.col("Energy").alias("AnnualSum"))
    cf = capacity_factor(energy, s.capacity, WEIGHT_TOTAL, storage=s.storage, key=KEY)
    return cf.select(*KEY, _r("AnnualSum", 2), _r("Capacity", 4), _r("CapacityFactor", 8))


def _net_revenue(s):
    from gridmeter.operators.settlement import cost_components, net_revenue
    from gridmeter.plans.system import KEY
    from gridmeter.session import checkpoint_dir

    checkpoint_dir(s.steps.sparkSession)
    sums = _sums(s).checkpoint(eager=True)  # one row per resource and zone, read by every report below
    part = lambda c: sums.select(*KEY, c.alias("AnnualSum"))
    comps = cost_components(s.generators, s.capacity, part(F.col("Energy")), part(F.col("Charge")), key=KEY)
    named = {c: part(F.col(c)) for c in ("EnergyRevenue", "Charge_cost", "SubsidyRevenue", "ReserveMarginRevenue", "RegSubsidyRevenue", "Fuel_cost")}
    return net_revenue(comps, {**named, "ESRRevenue": part(F.col("ESR_1") + F.col("ESR_2"))}, key=KEY)


@register("net_revenue")
def q_net_revenue(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.settlement import COST_PARTS, REVENUE_PARTS

    n = _net_revenue(_sys(spark, sf))
    return n.select("Resource", "Zone", *[_r(c, 2) for c in COST_PARTS + REVENUE_PARTS + ["Revenue", "Cost", "Profit"]])


@register("cost_rollup")
def q_cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.settlement import cost_rollup, unserved_energy_cost

    s = _sys(spark, sf)
    nse = _nse(s)
    out = cost_rollup(_net_revenue(s), extra={"cNSE": unserved_energy_cost(nse, s.horizon, _penalty())})
    return out.select("Costs", _r("Total", 2))


def _penalty():
    from gridmeter.plans.system import NSE_PENALTY

    return NSE_PENALTY


def _nse(s):
    from gridmeter.plans.system import NSE_ABOVE

    load = s.power.groupBy("Time_Index").agg(F.sum("value").alias("Load"))
    return load.select("Time_Index", F.greatest(F.col("Load") - F.lit(NSE_ABOVE), F.lit(0.0)).alias("value"))


@register("unserved_energy_cost")
def q_unserved_energy_cost(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.settlement import unserved_energy_cost

    s = _sys(spark, sf)
    return unserved_energy_cost(_nse(s), s.horizon, _penalty()).select(_r("value", 2))


@register("installed_capacity")
def q_installed_capacity(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.aggregates import order_levels, rollup_total

    s = _sys(spark, sf)
    measures = ["StartCap", "RetCap", "NewCap", "EndCap", "StartEnergyCap", "RetEnergyCap", "NewEnergyCap",
                "EndEnergyCap"]
    zones = F.array_join(F.sort_array(F.collect_set("Zone")), "+").alias("Zone")
    both = s.capacity.groupBy("Resource").agg(zones, *[F.sum(m).alias(m) for m in measures])
    t = rollup_total(both, "Resource", measures, extra={"Zone": "n/a"})
    t = order_levels(t, "Resource", ["view", "click", "signup", "purchase", "error"], rank="level")
    return t.select("Resource", "Zone", "level", *[_r(m, 4) for m in measures])


@register("storage_energy_totals")
def q_storage_energy_totals(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.aggregates import sum_filtered

    s = _sys(spark, sf)
    cap = s.capacity.where(F.col("Resource") != "Total")  # D2: never sum the Total row
    out = sum_filtered(cap, "EndEnergyCap", {
        "total": F.lit(True),
        "battery": F.col("Resource") == "purchase",
        "pumped_hydro": F.col("Resource") == "error",
    })
    return out.select(_r("total", 4), _r("battery", 4), _r("pumped_hydro", 4))


@register("cost_revenue_breakdown")
def q_cost_revenue_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.labels import sign_by_membership
    from gridmeter.operators.aggregates import semi_join_built

    s = _sys(spark, sf)
    n = _net_revenue(s)
    groups = n.select(
        "Resource", "Zone",
        (F.col("Inv_cost_MW") + F.col("Inv_cost_MWh")).alias("Investment"),
        (F.col("Fixed_OM_cost_MW") + F.col("Fixed_OM_cost_MWh") + F.col("Var_OM_cost_out") + F.col("Var_OM_cost_in")).alias("OM"),
        F.col("Charge_cost").alias("Charge"),
        F.col("EnergyRevenue").alias("Energy"),
        F.col("ReserveMarginRevenue").alias("RA"),
    )
    long = groups.unpivot(["Resource", "Zone"], ["Investment", "OM", "Charge", "Energy", "RA"], "Category", "value")
    signed = long.withColumn("value_MM", sign_by_membership("Category", ["Energy", "RA"]) * F.col("value") / F.lit(1e6))
    built = semi_join_built(signed, s.capacity, ["Resource", "Zone"], cap_col="EndCap")
    return built.select("Resource", "Zone", "Category", _r("value_MM", 6))


# --- typical periods ------------------------------------------------------------

@register("expand_period_map")
def q_expand_period_map(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import step_in_period
    from gridmeter.operators.timeseries import expand_period_map

    s = _sys(spark, sf)
    steps = EVENT_GRID.steps_per_period
    red_load = s.red_power.groupBy("Time_Index").agg(F.sum("value").alias("Load")).select(
        (F.floor((F.col("Time_Index") - 1) / steps) + 1).cast("long").alias("Rep_Period_Index"),
        step_in_period("Time_Index", steps).alias("Step"), "Load",
    )
    out = expand_period_map(red_load, s.period_map, steps)
    return out.select("Period_Index", "Step", "Time_Index", _r("Load"))


@register("extreme_periods")
def q_extreme_periods(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.periods import ExtremeRule, extreme_periods

    ev = step_readings(spark, sf)
    long = resource_series(ev).unionByName(
        load_series(ev).select("Time_Index", F.lit("Load").alias("Resource"), F.col("Load").alias("value"))
    )
    rules = [
        ExtremeRule("load_system_absolute_max", "Load", "Absolute", "Max"),
        ExtremeRule("pv_integral_min", SOLAR_TYPE, "Integral", "Min"),
        ExtremeRule("wind_integral_min", WIND_TYPE, "Integral", "Min"),
    ]
    return extreme_periods(long, "Time_Index", "Resource", "value", EVENT_GRID.steps_per_period, rules)


@register("scale_features")
def q_scale_features(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.periods import scale_features

    from gridmeter.session import checkpoint_dir

    checkpoint_dir(spark)
    h = _hourly_by_type(spark, sf).checkpoint(eager=True)  # read twice: statistics, then scaling
    mm = scale_features(h, "value", ["event_type"], methods={"z": "S", "minmax": "N"})
    return mm.select("event_type", "ts", _r("value", 6), _r("z", 8), _r("minmax", 8))


@register("representative_periods")
def q_representative_periods(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import index_to_clock
    from gridmeter.operators.joins import right_join_keep_all
    from gridmeter.operators.timeseries import assign_period

    ev = step_readings(spark, sf)
    steps = EVENT_GRID.steps_per_period
    pmap = fixed_period_map(load_series(ev), steps)
    j = right_join_keep_all(assign_period(load_series(ev), "Time_Index", steps), pmap, "Period_Index")
    per_hour = int(EVENT_GRID.steps_per_hour)
    j = j.where(F.pmod("Time_Index", F.lit(per_hour)) == 0)  # hourly sample of what the join kept
    reps = pmap.select(F.col("Rep_Period").alias("_gm_rp")).distinct()
    # A period is representative when it is listed as some bin's Rep_Period
    j = j.join(reps, j["Period_Index"] == reps["_gm_rp"], "left")
    return j.select(
        "Time_Index", "Period_Index", "Rep_Period", "Rep_Period_Index",
        F.col("_gm_rp").isNotNull().alias("Representative"),
        index_to_clock("Time_Index", EVENT_GRID).alias("clock"), _r("Load"),
    )


# --- weekly views (period 3 = the third day) --------------------------------------

SHOW_PERIOD = 3


def _week(df, steps=EVENT_GRID.steps_per_period):
    from gridmeter.operators.timeseries import slice_period

    return slice_period(df, "Time_Index", SHOW_PERIOD, steps)


@register("bin_week")
def q_bin_week(spark: SparkSession, sf: str) -> DataFrame:
    """Q15 for a reduced run (F7, P5): the rows of a bin on the reduced index,
    under the clock of its representative period."""
    from gridmeter.functions.time import index_to_clock, step_in_period
    from gridmeter.operators.periods import reduced_series
    from gridmeter.plans.study import representative_of

    steps = EVENT_GRID.steps_per_period
    st = step_readings(spark, sf)
    # bins in reverse order of the days, so that a bin's number is not its day's
    pmap = fixed_period_map(load_series(st), steps).withColumn("Rep_Period_Index", F.lit(8) - F.col("Rep_Period"))
    price = _week(reduced_series(price_series(st), pmap, steps).select("Time_Index", "price"))
    rep = representative_of(pmap, SHOW_PERIOD).scalar()
    clock = index_to_clock((rep - 1) * steps + step_in_period("Time_Index", steps) + 1, EVENT_GRID)
    return price.select("Time_Index", clock.alias("clock"), _r("price"))


@register("reduced_scarcity_total")
def q_reduced_scarcity_total(spark: SparkSession, sf: str) -> DataFrame:
    """Q20 for a reduced run (T6): scarcity of the representatives on every
    period of the horizon, times the horizon's load."""
    from gridmeter.operators.periods import reduced_series
    from gridmeter.plans.analysis import scarcity_cost_total
    from gridmeter.plans.study import over_horizon

    steps = EVENT_GRID.steps_per_period
    st = step_readings(spark, sf)
    pmap = fixed_period_map(load_series(st), steps)
    short = reduced_series(scarcity_series(st), pmap, steps).select("Time_Index", "shdw")
    return scarcity_cost_total(load_series(st), over_horizon(short, pmap, steps)).select(_r("scarcity_cost", 2))


@register("price_week")
def q_price_week(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.numeric import per_hour
    from gridmeter.functions.time import index_to_clock

    p = _week(price_series(step_readings(spark, sf)))
    return p.select("Time_Index", index_to_clock("Time_Index", EVENT_GRID).alias("clock"),
                    F.round(per_hour("price", EVENT_GRID.steps_per_hour), 4).alias("price"))


@register("price_range")
def q_price_range(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.numeric import per_hour
    from gridmeter.operators.aggregates import min_max_range

    p = _week(price_series(step_readings(spark, sf))).select(per_hour("price", EVENT_GRID.steps_per_hour).alias("price"))
    return min_max_range(p, "price").select(_r("lo"), _r("hi"))


@register("scarcity_week")
def q_scarcity_week(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.functions.time import index_to_clock

    s = _week(scarcity_series(step_readings(spark, sf)))
    return s.select("Time_Index", index_to_clock("Time_Index", EVENT_GRID).alias("clock"), _r("shdw"))


@register("dispatch_week")
def q_dispatch_week(spark: SparkSession, sf: str) -> DataFrame:
    from gridmeter.operators.aggregates import semi_join_built
    from gridmeter.operators.reshape import net_of_charge

    s = _sys(spark, sf)
    net = net_of_charge(_week(s.power), _week(s.charge), ["Time_Index", "Resource"])
    net = semi_join_built(net, s.capacity, "Resource")
    return net.select("Time_Index", "Resource", _r("net"))


@register("state_of_charge_week")
def q_state_of_charge_week(spark: SparkSession, sf: str) -> DataFrame:
    s = _sys(spark, sf)
    stor = _week(s.power).join(s.storage.select("Resource").distinct(), "Resource", "left_semi")
    total_cap = s.capacity.join(s.storage, ["Resource", "Zone"], "left_semi").select(F.sum("EndEnergyCap")).scalar()
    total = stor.groupBy("Time_Index").agg(F.sum("value").alias("_gm_s"))
    out = stor.join(total, "Time_Index", "inner")
    return out.select("Time_Index", "Resource", _r("value"), F.round(F.try_divide(F.col("_gm_s"), total_cap), 8).alias("total_soc"))


def _half_up(col: str, digits: int):
    """Round half up as floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in
    any engine, so exact ties round the same way on both sides of the check."""
    scale = float(10 ** digits)
    return (F.floor(F.col(col) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).alias(col)


@register("hydro_variability")
def q_hydro_variability(spark: SparkSession, sf: str) -> DataFrame:
    """Q8 (T3): month rows x profile columns -> daily rows, long. Stand-in:
    monthly mean order value per priority as the month x time-of-day table."""
    from gridmeter.functions.time import floor_time
    from gridmeter.operators.timeseries import interpolate_month_to_day

    o = table(spark, sf, "orders")
    prios = _names(o, "o_orderpriority")
    wide = o.groupBy(floor_time("o_orderdate", "month").alias("Datetime")).pivot("o_orderpriority", prios).agg(
        F.avg("o_totalprice")
    )
    out = interpolate_month_to_day(wide, "Datetime", prios, name="Hour", value_name="gen")
    return out.select("Hour", "Datetime", _half_up("gen", 4))


@register("net_demand_vs_scarcity")
def q_net_demand_vs_scarcity(spark: SparkSession, sf: str) -> DataFrame:
    """Q23 (J8): scarcity x availability x demand on the step index;
    availability = mean of the wind and solar shares of load."""
    from gridmeter.operators.joins import inner_join_chain
    from gridmeter.plans.tables import typed_series

    ev = step_readings(spark, sf)
    load = load_series(ev)
    shares = inner_join_chain(typed_series(ev, WIND_TYPE, "w"), [typed_series(ev, SOLAR_TYPE, "s"), load], ["Time_Index"])
    avail = shares.select("Time_Index", ((F.try_divide("w", "Load") + F.try_divide("s", "Load")) / 2).alias("avail"))
    j = inner_join_chain(scarcity_series(ev), [avail, load], ["Time_Index"])
    return j.select("Time_Index", _r("shdw"), _r("avail", 8),
                    F.round(F.col("Load") * (F.lit(1.0) - F.col("avail")), 6).alias("net_load"))


@register("scalar_functions")
def q_scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """X1-X17 on every order: parse, date parts, weekday flag, minute and time
    of day, significant digits, log1p, labels, tolerant numeric casts."""
    import gridmeter.functions as X

    o = table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "M/d/yy H:mm")
    return o.select(
        "o_orderkey",
        X.parse_timestamp(text, "M/d/yy H:mm").alias("parsed"),
        F.year("o_orderdate").alias("yr"),
        X.month_abbr("o_orderdate").alias("mon"),
        F.dayofmonth("o_orderdate").alias("dom"),
        F.dayofweek("o_orderdate").alias("dow"),
        X.weekday_flag("o_orderdate").alias("weekday"),
        X.minute_of_day("o_orderdate").alias("mod"),
        X.time_of_day("o_orderdate").alias("tod"),
        X.signif("o_totalprice", 2).alias("signif2"),
        F.round(X.log1p("o_totalprice"), 10).alias("log1p"),
        X.concat_label(F.col("o_totalprice") / F.lit(1000.0), "k").alias("label"),
        X.try_numeric(F.substring("o_orderpriority", 1, 1)).alias("prio_num"),
        X.try_numeric("o_orderpriority").alias("prio_bad"),
        X.orientation(F.col("o_totalprice") / F.lit(1000.0)).alias("orientation"),
    )


@register("rollup_zone_pivot")
def q_rollup_zone_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Rows x (Total, one column per zone). Stand-in: extended price by
    return flag (row) and line status (zone), summed exactly in decimal."""
    from gridmeter.operators.aggregates import rollup_zone_pivot

    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("decimal(18,2)").alias("v")
    )
    zones = _names(li, "l_linestatus")
    out = rollup_zone_pivot(li, "l_returnflag", "l_linestatus", "v", zones)
    return out.select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in ("Total", *zones)])


PROFILES = ["Load", SOLAR_TYPE, WIND_TYPE]


def _hourly_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(H, event_type, value): hourly sums per resource, and of all as ``Load``."""
    from gridmeter.functions.time import Grid, step_index
    from gridmeter.session import checkpoint_dir

    hourly = Grid(step_minutes=60, base=EVENT_GRID.base, steps_per_period=24)
    ev = table(spark, sf, "events").withColumn("H", step_index("ts", hourly))
    checkpoint_dir(spark)
    # the raw table is read once; every branch reads this
    per = ev.groupBy("H", "event_type").agg(F.sum("value").alias("value")).checkpoint(eager=True)
    return per.unionByName(per.groupBy("H").agg(F.sum("value").alias("value")).withColumn("event_type", F.lit("Load")))


def _scaled_features(long: DataFrame) -> DataFrame:
    """M5 of standardised (M6) load, PV and wind: one vector of hours per day."""
    from gridmeter.operators.periods import period_features, scale_features

    return period_features(scale_features(long, "value", ["event_type"], method="S", out="z"), "H", "event_type", "z", 24, PROFILES)


@register("period_features")
def q_period_features(spark: SparkSession, sf: str) -> DataFrame:
    """M5: the vector of each day, one row per position."""
    feats = _scaled_features(_hourly_profiles(spark, sf))
    return feats.select("Period_Index", F.posexplode("features").alias("pos", "value")).select("Period_Index", "pos", _r("value", 8))


@register("pick_representative")
def q_pick_representative(spark: SparkSession, sf: str) -> DataFrame:
    """M10 on a given assignment (every fourth day together): the member nearest
    the mean of its cluster."""
    from gridmeter.operators.periods import number_representatives, pick_representative

    feats = _scaled_features(_hourly_profiles(spark, sf)).withColumn("cluster", F.pmod("Period_Index", F.lit(4)).cast("int"))
    means = feats.select("cluster", F.posexplode("features").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("v"))
    centres = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("center"))
    return number_representatives(pick_representative(feats, centres).select("Period_Index", "Rep_Period"))


def _clustered(spark: SparkSession, sf: str, **options) -> DataFrame:
    """Hourly (load, PV, wind) vectors per day, scaled per profile,
    extreme days kept apart, k-means of many restarts for the rest."""
    from gridmeter.operators.periods import ExtremeRule, cluster_periods, extreme_periods

    long = _hourly_profiles(spark, sf)
    ext = extreme_periods(long, "H", "event_type", "value", 24, [
        ExtremeRule("load_max", "Load", "Absolute", "Max"),
        ExtremeRule("pv_min", SOLAR_TYPE, "Integral", "Min"),
        ExtremeRule("wind_min", WIND_TYPE, "Integral", "Min"),
    ])
    return cluster_periods(_scaled_features(long), extremes=ext, threshold=0.1, seed=11, max_iter=20, **options)


@register("cluster_periods")
def q_cluster_periods(spark: SparkSession, sf: str) -> DataFrame:
    """250 restarts of each number of clusters, as the settings have it;
    k counts the extreme days too."""
    return _clustered(spark, sf, k_min=5, k_max=7, repeats=250)


@register("cluster_periods_inserted")
def q_cluster_periods_inserted(spark: SparkSession, sf: str) -> DataFrame:
    """M9 by insertion: restarts of the least k, then the farthest day of all
    becomes a cluster of its own, up to the threshold."""
    return _clustered(spark, sf, k_min=4, k_max=15, repeats=250, iterate="insert")


@register("solver_wide_roundtrip")
def q_solver_wide_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + K1: per-step output by resource written as a wide result file (a
    ``Zone`` and an ``AnnualSum`` row above ``t1..tN``) into the shared
    checkpoint folder, then read back by label into long form."""
    import uuid

    from gridmeter.session import checkpoint_dir
    from gridmeter.sources.csv import write_csv
    from gridmeter.sources.results import scan_solver_wide

    res = resource_series(step_readings(spark, sf))
    types = _names(res, "Resource")
    wide = res.groupBy("Time_Index").pivot("Resource", types).agg(F.first("value"))
    steps = wide.select(F.concat(F.lit("t"), F.col("Time_Index").cast("string")).alias("Resource"),
                        *[F.col(t).cast("string").alias(t) for t in types])
    zone = spark.range(1).select(F.lit("Zone").alias("Resource"), *[F.lit("1").alias(t) for t in types])
    annual = res.groupBy().pivot("Resource", types).agg(F.sum("value")).select(
        F.lit("AnnualSum").alias("Resource"), *[F.col(t).cast("string").alias(t) for t in types])
    path = f"{checkpoint_dir(spark).rstrip('/')}/solver_wide_{uuid.uuid4().hex}"
    write_csv(zone.unionByName(annual).unionByName(steps), path)
    long = scan_solver_wide(spark, path, name="Resource")
    return long.where(F.col("value").isNotNull()).select("Time_Index", "Resource", _r("value"))


def _customer_angles(spark, sf):
    c = table(spark, sf, "customer")
    return c.select((F.col("c_acctbal") / F.lit(20.0)).alias("azimuth"),
                    (F.abs(F.col("c_acctbal")) / F.lit(100.0)).alias("tilt"))


@register("dg_azimuth_density")
def q_dg_azimuth_density(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: density of azimuth with a narrow bandwidth (adjust 0.05), over the data."""
    from gridmeter.operators.stats import kernel_density

    d = kernel_density(_customer_angles(spark, sf), "azimuth", adjust=0.05, domain="data")
    return d.select("i", _r("x", 6), _r("density", 12))


@register("dg_tilt_density")
def q_dg_tilt_density(spark: SparkSession, sf: str) -> DataFrame:
    """Q5 + F8: density of tilt below 45 degrees (adjust 1), over the data."""
    from gridmeter.operators.stats import kernel_density

    t = _customer_angles(spark, sf).where(F.col("tilt") < 45)
    d = kernel_density(t, "tilt", adjust=1.0, domain="data")
    return d.select("i", _r("x", 6), _r("density", 12))


@register("step_total")
def q_step_total(spark: SparkSession, sf: str) -> DataFrame:
    """B2: the ``Total`` column of a result table: sum over resources per step."""
    from gridmeter.operators.settlement import step_total

    return step_total(resource_series(step_readings(spark, sf))).select("Time_Index", _r("Total"))


@register("multi_constraint_revenue")
def q_multi_constraint_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue under several constraints, AnnualSum = sum of the
    constraint columns. Stand-in constraints: weekday steps and weekend steps."""
    from gridmeter.operators.reshape import row_total

    j = row_total(_sums(_sys(spark, sf)), ["ESR_1", "ESR_2"], out="AnnualSum")
    return j.select("Resource", "Zone", _r("ESR_1", 2), _r("ESR_2", 2), _r("AnnualSum", 2))


@register("grouped_density")
def q_grouped_density(spark: SparkSession, sf: str) -> DataFrame:
    """M4: a density curve per group on the range of all (event value per event type)."""
    from gridmeter.operators.stats import kernel_density

    d = kernel_density(table(spark, sf, "events"), "value", by=["event_type"], domain="all")
    return d.select("event_type", "i", _r("x", 6), _r("density", 12))


@register("density_ridges")
def q_density_ridges(spark: SparkSession, sf: str) -> DataFrame:
    """M4: price per month with one bandwidth, ECDF and tail probability. Stand-in:
    order value by month of the year."""
    from gridmeter.functions.time import month_abbr
    from gridmeter.operators.stats import density_ridges

    o = table(spark, sf, "orders").select(month_abbr("o_orderdate").alias("month"), (F.col("o_totalprice") / F.lit(1000.0)).alias("price"))
    d = density_ridges(o, "price", by=["month"])
    return d.select("month", "i", _r("x", 6), _r("density", 12), _r("ndensity", 8), _r("ecdf", 8), _r("tail", 8))


@register("density_ridges_hour")
def q_density_ridges_hour(spark: SparkSession, sf: str) -> DataFrame:
    """M4 with a given bandwidth of 1: mean price per step by hour of the day."""
    from gridmeter.functions.time import index_to_clock
    from gridmeter.operators.stats import density_ridges

    p = price_series(step_readings(spark, sf)).select(F.hour(index_to_clock("Time_Index", EVENT_GRID)).alias("hour"), F.round("price", 6).alias("price"))
    d = density_ridges(p, "price", by=["hour"], bandwidth=1.0)
    return d.select("hour", "i", _r("x", 6), _r("density", 10), _r("ecdf", 8), _r("tail", 8))


@register("offset_from_first")
def q_offset_from_first(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes since each series' first reading (``Time - Time[1]``)."""
    from gridmeter.operators.windows import offset_from_first

    ev = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return offset_from_first(ev, "ts", by=["event_type"], unit="MINUTE", out="minutes").select(
        "event_id", "event_type", "minutes"
    )


@register("matrix_to_rows")
def q_matrix_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Array columns -> one row per position (``posexplode(arrays_zip)``);
    the stored vectors stand in for the curve arrays."""
    from gridmeter.operators.reshape import matrix_to_rows

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return matrix_to_rows(e, ["embedding"], index="pos").select("vec_id", "pos", F.col("embedding").alias("value"))


@register("ev_profile_long")
def q_ev_profile_long(spark: SparkSession, sf: str) -> DataFrame:
    """T8 + R4: a wide day profile (time of day x {Weekday, Weekend}) turned
    into long rows keyed by (minutes since the first row, weekday flag).
    The profile is the mean charging per 5-minute step by day type."""
    from gridmeter.functions.time import index_to_clock, minute_of_day, weekday_flag
    from gridmeter.operators.timeseries import day_profile_long
    from gridmeter.plans.tables import EV_TYPE, typed_series

    s = typed_series(step_readings(spark, sf), EV_TYPE, "ev").withColumn("clock", index_to_clock("Time_Index", EVENT_GRID))
    s = s.withColumn("day", F.when(weekday_flag("clock"), "Weekday").otherwise("Weekend"))
    # per-step sums of 2-decimal readings are exact decimals; their mean over days
    # often ends on an exact half at the 4th decimal, so sum exactly and round
    # half up by the same IEEE steps as the SQL side
    exact_mean = F.sum(F.col("ev").cast("decimal(30,2)")).cast("double") / F.count("ev")
    wide = s.groupBy(minute_of_day("clock").alias("m")).pivot("day", ["Weekday", "Weekend"]).agg(exact_mean)
    wide = wide.select(F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("Time"),
                       "Weekday", "Weekend")
    out = day_profile_long(wide, "Time", value="EV_load")
    return out.where(F.col("EV_load").isNotNull()).select("Time", "Weekday", _half_up("EV_load", 4))


# --- file readers, over files written from the test tables ------------------------

def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from gridmeter.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


@register("run_tree")
def q_run_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Two run folders (one with blanks in its name) whose files have
    different resources, read as one long table."""
    from gridmeter.sources.csv import write_csv
    from gridmeter.sources.results import scan_run_tree

    path, res = _scratch(spark, "run_tree"), resource_series(step_readings(spark, sf))
    found = _names(res, "Resource")  # the first two, and all but the first
    for sim, types in (("sim 1 - a", found[:2]), ("sim2", found[1:])):
        wide = res.groupBy("Time_Index").pivot("Resource", types).agg(F.first("value"))
        label = F.concat(F.lit("t"), F.col("Time_Index").cast("string")).alias("Resource")
        write_csv(wide.select(label, *[F.col(t).cast("string") for t in types]), f"{path}/{sim}/Results_1")
    long = scan_run_tree(spark, path, "*.csv").where(F.col("value").isNotNull())
    return long.select("sim", "run", "Time_Index", F.col("name").alias("Resource"), _r("value"))


@register("csv_roundtrip")
def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV and read back with declared types."""
    from gridmeter.sources.csv import read_csv_typed, write_csv

    path = _scratch(spark, "csv_roundtrip")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("o_orderdate"), F.col("o_totalprice").cast("string"),
        F.when(F.col("o_orderstatus") == "P", "-").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    write_csv(o, path)
    types = {"o_orderkey": "long", "o_orderdate": "timestamp", "o_totalprice": "double"}
    return read_csv_typed(spark, path, types, ts_format="M/d/yyyy H:mm")


@register("result_report")
def q_result_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report table with text keys and ``-`` for nulls."""
    from gridmeter.sources.csv import write_csv
    from gridmeter.sources.results import scan_result_report

    path = _scratch(spark, "result_report")
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("most"))
    text = c.select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("Resource"), F.col("n").cast("string").alias(" Count "),
                    F.when(F.col("most") < 9900, "-").otherwise(F.col("most").cast("string")).alias("Most"))
    write_csv(text, path)
    return scan_result_report(spark, path)


@register("site_files")
def q_site_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per site with numeric metadata lines above the data; the
    site comes from the path."""
    from pyspark.sql import types as T

    from gridmeter.sources.csv import read_skip_meta

    path = _scratch(spark, "site_files")
    n = table(spark, sf, "supplier").select(F.concat(F.lit("site "), F.col("s_nationkey").cast("string")).alias("site"), "s_suppkey", "s_acctbal")
    data = n.select("site", F.concat_ws(",", F.lit("2012"), F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")).alias("value"))
    meta = n.select("site").distinct().select("site", F.explode(F.array(F.lit("Source,Location ID"), F.lit("123456,32.7"))).alias("value"))
    meta.unionByName(data).write.partitionBy("site").text(path)
    schema = T.StructType([T.StructField("Year", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("balance", T.DoubleType())])
    return read_skip_meta(spark, f"{path}/*/*.txt", schema, site_from_path=r"site=([^/]+)/")


@register("azimuth_labels")
def q_azimuth_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Orientation of every row, null azimuths included."""
    from gridmeter.functions.labels import orientation

    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 20.0).alias("azimuth"))
    return c.select("c_custkey", orientation("azimuth").alias("Orientation"))


@register("month_hour_profile")
def q_month_hour_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by month and hour of day."""
    from gridmeter.operators.aggregates import month_hour_profile

    o = table(spark, sf, "orders")
    out = month_hour_profile(o, "o_orderdate", [F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")])
    return out


@register("two_arrays_to_rows")
def q_two_arrays_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrays of a row zipped by position."""
    from gridmeter.operators.reshape import matrix_to_rows

    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("mirror"))
    return matrix_to_rows(e, ["embedding", "mirror"], index="pos").select("vec_id", "pos", "embedding", "mirror")


@register("curve_lookup")
def q_curve_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """T7 with a table of curves. Stand-in: every part is a turbine type, whose knots
    are stretched by its key and whose outputs scale with its price; quantities are
    wind speeds."""
    from gridmeter.operators.curves import CURVE_KW, CURVE_SPEEDS, curve_lookup
    from gridmeter.operators.reshape import matrix_to_rows

    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    base = part.withColumns({"speed": F.array(*[F.lit(float(x)) for x in CURVE_SPEEDS]), "kw": F.array(*[F.lit(float(y)) for y in CURVE_KW])})
    knots = matrix_to_rows(base, ["speed", "kw"]).select(
        F.col("p_partkey").alias("l_partkey"),
        (F.col("speed") * (F.lit(0.8) + (F.col("p_partkey") % 5) * F.lit(0.1))).alias("speed"),
        (F.col("kw") * F.col("p_retailprice") / F.lit(1000.0)).alias("kw"),
    )
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"))
    return curve_lookup(li, knots, ["l_partkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", _half_up("kw", 4))


@register("order_levels")
def q_order_levels(spark: SparkSession, sf: str) -> DataFrame:
    """As many names as there are orders, ranked in the order of the alphabet."""
    from gridmeter.operators.aggregates import order_levels, ranks_of

    o = table(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), "o_totalprice")
    return order_levels(o, "name", ranks_of(o, "name"), rank="level")


@register("capacity_changes")
def q_capacity_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: start, retired and new capacity of built resources, in the chart's order."""
    from gridmeter.operators.aggregates import order_levels

    cap = _sys(spark, sf).capacity.where(F.col("EndCap") > 0)
    parts = cap.unpivot(["Resource", "Zone"], ["StartCap", "RetCap", "NewCap"], "Measure", "MW")
    ordered = order_levels(parts, "Resource", ["view", "click", "signup", "purchase", "error"], rank="level")
    return ordered.select("Resource", "Zone", "Measure", _r("MW", 4), "level")


@register("energy_capacity")
def q_energy_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: energy capacity of resources that have one, last level first."""
    from gridmeter.operators.aggregates import order_levels

    cap = _sys(spark, sf).capacity.where(F.col("EndEnergyCap") > 0).groupBy("Resource").agg(F.sum("EndEnergyCap").alias("EndEnergyCap"))
    return order_levels(cap, "Resource", ["purchase", "error"], rank="level", reverse=True).select("Resource", _r("EndEnergyCap", 4), "level")


@register("extreme_periods_zone")
def q_extreme_periods_zone(spark: SparkSession, sf: str) -> DataFrame:
    """M7 as the settings have it: the load's peak over all zones, and for each zone
    the periods with the least sun and wind."""
    from gridmeter.operators.periods import ExtremeRule, extreme_periods

    long = _sys(spark, sf).values.select("Time_Index", "Zone", "Resource", "value")
    load = long.groupBy("Time_Index", "Zone").agg(F.sum("value").alias("value")).withColumn("Resource", F.lit("Load"))
    rules = [
        ExtremeRule("load_absolute_max", "Load", "Absolute", "Max"),
        ExtremeRule("pv_integral_min", SOLAR_TYPE, "Integral", "Min", scope="Zone"),
        ExtremeRule("wind_integral_min", WIND_TYPE, "Integral", "Min", scope="Zone"),
    ]
    out = extreme_periods(long.unionByName(load), "Time_Index", "Resource", "value", EVENT_GRID.steps_per_period, rules, zone="Zone")
    return out.select("rule", "Zone", "Period_Index")


@register("literal_scenarios")
def q_literal_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of given statuses and dates, with the value of the
    orders of that status up to that date (none: null)."""
    from gridmeter.sources.generate import literal_product

    points = literal_product(spark, o_orderstatus=["F", "O", "P", "none"], until=["1995-01-01", "1999-01-01"])
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    both = points.join(o, "o_orderstatus", "left").where("o_orderdate is null or o_orderdate <= cast(until as date)")
    sums = both.groupBy("o_orderstatus", "until").agg(F.sum("v").cast("double").alias("total"))
    return points.join(sums, ["o_orderstatus", "until"], "left")


@register("date_text_compare")
def q_date_text_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as text, compared as text."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("approved"))
    return o.where(F.col("approved") > F.lit("1996-12-31"))


@register("ordered_roundtrip")
def q_ordered_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K2: orders written in the order of date and key, and read back with each
    row's place in that order."""
    from gridmeter.sources.csv import read_ordered_csv, write_ordered_csv

    path = _scratch(spark, "ordered")
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    write_ordered_csv(o, path, ["o_orderdate", "o_orderkey"])
    return read_ordered_csv(spark, path, {"o_orderkey": "long", "o_totalprice": "double"}).select("row", "o_orderkey", "o_totalprice")


@register("profile_file_to_grid")
def q_profile_file_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    """An hourly profile file, put on the 5-minute grid and written
    in time order; the file read back."""
    from gridmeter.plans.workflows import TS_FORMAT, interpolate_file
    from gridmeter.sources.csv import read_ordered_csv, write_csv

    path = _scratch(spark, "profile")
    h = _hourly_by_type(spark, sf)
    types = _names(h, "event_type")
    wide = h.groupBy("ts").pivot("event_type", types).agg(F.first("value"))
    write_csv(wide.select(F.date_format("ts", TS_FORMAT).alias("Datetime"), *types), f"{path}/hourly")
    interpolate_file(spark, f"{path}/hourly", f"{path}/grid")
    back = read_ordered_csv(spark, f"{path}/grid", {"Datetime": "timestamp", **{t: "double" for t in types}}, TS_FORMAT)
    return back.select("row", "Datetime", *[_half_up(t, 7) for t in types])


@register("net_load_files")
def q_net_load_files(spark: SparkSession, sf: str) -> DataFrame:
    """Q6 from files: provided load, DG output and the wide EV day profile, written
    from the readings."""
    from gridmeter.functions.time import index_to_clock
    from gridmeter.plans.tables import DG_TYPE, typed_series
    from gridmeter.plans.workflows import TS_FORMAT, net_load_from_files
    from gridmeter.sources.csv import write_csv

    path, st = _scratch(spark, "net_load"), step_readings(spark, sf)
    stamp = F.date_format(index_to_clock("Time_Index", EVENT_GRID), TS_FORMAT)
    write_csv(load_series(st).select(stamp.alias("Datetime"), F.col("Load").alias("Load (MW)")), f"{path}/load")
    write_csv(typed_series(st, DG_TYPE, "Gen").select(stamp.alias("Datetime"), "Gen"), f"{path}/dg")
    wide = _ev_profile(st).groupBy("Time").pivot("Weekday", [True, False]).agg(F.first("EV_load"))
    # a minute that one day type lacks is empty there: its steps keep their load, with no EV load
    clock = F.date_format(F.timestamp_add("MINUTE", F.col("Time"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), TS_FORMAT)
    write_csv(wide.select(clock.alias("Time"), F.col("true").alias("Weekday"), F.col("false").alias("Weekend")), f"{path}/ev")
    out = net_load_from_files(spark, f"{path}/load", f"{path}/dg", f"{path}/ev", year=2024)
    return out.select("Datetime", _r("Load"), _r("Gen"), _r("EV_load", 10), _r("net_load", 6))


@register("site_list")
def q_site_list(spark: SparkSession, sf: str) -> DataFrame:
    """S3: a site list whose header names have blanks and brackets, by position."""
    from gridmeter.sources.csv import read_by_position, write_csv

    path = _scratch(spark, "sites")
    s = table(spark, sf, "supplier")
    write_csv(s.select(F.col("s_name").alias("PV Generator Name"), F.col("s_suppkey").cast("string").alias(" Capacity (kW) "),
                       F.round(F.col("s_acctbal") / 100, 4).alias("Lat"), F.lit("n/a").alias("Lon")), path)
    return read_by_position(spark, path, {0: ("site", "string"), 1: ("capacity_kw", "int"), 2: ("lat", "double"), 3: ("lon", "double")})


@register("side_by_side")
def q_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """One file with a weekday and a weekend table beside each other, split
    by an empty column, as one long table."""
    from gridmeter.functions.time import index_to_clock, minute_of_day, weekday_flag
    from gridmeter.plans.tables import EV_TYPE, typed_series
    from gridmeter.sources.csv import read_side_by_side, write_csv

    path = _scratch(spark, "side_by_side")
    c = typed_series(step_readings(spark, sf), EV_TYPE, "ev").withColumn("clock", index_to_clock("Time_Index", EVENT_GRID))
    exact_mean = F.sum(F.col("ev").cast("decimal(30,2)")).cast("double") / F.count("ev")
    prof = c.withColumn("flag", weekday_flag("clock")).groupBy(minute_of_day("clock").alias("Time")).pivot("flag", [True, False]).agg(exact_mean)
    write_csv(prof.select(F.col("Time").alias("Time"), F.col("true").alias("total"), F.lit(None).cast("string").alias(" "),
                          F.col("Time").alias("Time "), F.col("false").alias("total ")), path)
    blocks = [("Weekday", {0: ("Time", "int"), 1: ("total", "double")}), ("Weekend", {3: ("Time", "int"), 4: ("total", "double")})]
    long = read_side_by_side(spark, path, blocks, label="day").where("total is not null")
    return long.select("Time", _half_up("total", 4), "day")


@register("dg_sites_file")
def q_dg_sites_file(spark: SparkSession, sf: str) -> DataFrame:
    """An interconnection list with base-R names; azimuths that are no
    numbers become null."""
    from gridmeter.plans.workflows import read_dg_sites
    from gridmeter.sources.csv import write_csv

    path = _scratch(spark, "dg_sites")
    o = table(spark, sf, "orders")
    write_csv(o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("App Approved Date"), F.when(F.col("o_orderstatus") == "F", "Solar").otherwise("Wind").alias("Technology Type"),
        F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise((F.col("o_orderkey") % 360).cast("string")).alias("Azimuth"),
        (F.col("o_orderkey") % 60).cast("string").alias("Tilt"), F.col("o_totalprice").cast("string").alias("System Size AC"), F.col("o_orderkey").alias("2nd key"),
    ), path)
    out = read_dg_sites(spark, path, after="1994-12-31", tie=["X2nd.key"])
    return out.select(F.get_json_object("_row", "$['X2nd.key']").cast("long").alias("o_orderkey"), "date", "azimuth", "tilt", "size_kw")


@register("templates")
def q_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON template per nation, with different keys and ragged arrays, as rows."""
    from gridmeter.sources.results import scan_templates

    path = _scratch(spark, "templates")
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.sort_array(F.collect_list("s_suppkey")).alias("keys"), F.max("s_acctbal").alias("most"), F.count(F.lit(1)).alias("n"))
    even = F.col("s_nationkey") % 2 == 0
    pairs = F.transform("keys", lambda k: F.slice("keys", 1, (k % 3 + 1).cast("int")))
    text = F.to_json(F.struct(
        F.lit(2).alias("number_inputs"), F.col("s_nationkey").alias("nation"), F.when(even, F.col("most")).alias("most"),
        F.when(~even, F.col("keys")).alias("keys"), F.when(even, pairs).alias("rows"), F.when(even, F.lit("even")).alias("kind"),
    ))  # null fields are left out: templates have unequal keys
    s.select(F.col("s_nationkey").cast("string").alias("nation"), text.alias("value")).write.partitionBy("nation").text(path)
    rows = scan_templates(spark, f"{path}/*/*.txt")
    nation = F.regexp_extract("file", r"nation=([^/]+)/", 1).cast("int")
    return rows.select(nation.alias("nation"), "key", "i", "j", "number", F.when(F.col("number").isNull(), F.col("text")).alias("text"))


def _write_case(spark: SparkSession, sf: str, path: str) -> None:
    """A case folder of a reduced run: the horizon's load, and result files on the
    reduced index of the period map (every day stands for one of the first seven)."""
    from gridmeter.operators.periods import reduced_series
    from gridmeter.plans.tables import charge_series
    from gridmeter.sources.csv import write_csv

    st, steps = step_readings(spark, sf), EVENT_GRID.steps_per_period
    pmap = fixed_period_map(load_series(st), steps)
    short = lambda d: reduced_series(d, pmap, steps)
    label = F.concat(F.lit("t"), F.col("Time_Index").cast("string"))
    types = _names(st, "event_type")

    def wide(long: DataFrame, name: str) -> None:
        w = short(long).groupBy("Time_Index").pivot("Resource", types).agg(F.first("value"))
        write_csv(w.select(label.alias("Resource"), *types), f"{path}/Results/{name}.csv")

    write_csv(load_series(st).select("Time_Index", F.col("Load").alias("Load_MW_z1")), f"{path}/Load_data.csv")
    write_csv(pmap, f"{path}/TDR_Results/Period_map.csv")
    write_csv(short(price_series(st)).select(label.alias("Zone"), F.col("price").alias("1")), f"{path}/Results/prices.csv")
    write_csv(short(scarcity_series(st)).select(label.alias("Constraint"), F.col("shdw").alias("CapRes_1")), f"{path}/Results/ReserveMargin_w.csv")
    for name in ("power", "curtail", "storage"):
        wide(resource_series(st), name)
    wide(charge_series(st), "charge")
    s = _sys(spark, sf)
    cap = s.capacity.groupBy("Resource").agg(*[F.sum(c).alias(c) for c in s.capacity.columns if c not in ("Resource", "Zone")])
    write_csv(cap.withColumn("Zone", F.lit("1")), f"{path}/Results/capacity.csv")
    net = _net_revenue(s)
    write_csv(net.groupBy("Resource").agg(*[F.sum(c).alias(c) for c in net.columns if c not in ("Resource", "Zone", "no_capacity")]), f"{path}/Results/NetRevenue.csv")


def _case_report(spark: SparkSession, sf: str, name: str, **options) -> DataFrame:
    from gridmeter.plans.study import read_case, reports

    path = _scratch(spark, "case")
    _write_case(spark, sf, path)
    return reports(read_case(spark, path), EVENT_GRID, show_period=SHOW_PERIOD, **options)[name]


@register("case_demand_price")
def q_case_demand_price(spark: SparkSession, sf: str) -> DataFrame:
    """Q19 from a case folder's files, of a reduced run put back on the horizon."""
    out = _case_report(spark, sf, "demand_price_summary")
    return out.select("month", "hour", _r("demand"), _r("price"), _r("scarcity"))


@register("case_curtailment")
def q_case_curtailment(spark: SparkSession, sf: str) -> DataFrame:
    """Q22 from a case folder's files, of a reduced run put back on the horizon."""
    out = _case_report(spark, sf, "curtailment_by_month_hour", wind=(WIND_TYPE,), solar=(SOLAR_TYPE,))
    return out.select("month", "hour", _r("total"), _r("wind"), _r("solar"))


@register("case_dispatch_week")
def q_case_dispatch_week(spark: SparkSession, sf: str) -> DataFrame:
    """Q14 from a case folder's files: a bin under its representative's clock."""
    out = _case_report(spark, sf, "dispatch_week").where("net is not null")  # a wide file has a cell for every resource and step
    return out.select("Time_Index", "clock", "Resource", _r("net"))
