"""A planning-run result set derived from the test tables (stand-in for the
optimizer's output folders), so the settlement reports run on real data.

Resources are the event types, in two zones (users with even and odd ids). Per
5-minute step, resource and zone: output = sum of values, charging = sum of
values below ``CHARGE_BELOW``; the price of a zone is the mean of its
``purchase`` values, the reserve price the sum of all ``error`` values. The
settlement covers every step of the horizon, each with the same weight, 8760
hours together. For the reports of reduced runs a rule maps every day onto one
of the first seven (the representatives).
Capacity: start = mean step output, end = peak over all steps. Unit costs and
rates are parameters (one set for generators, one for storage).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.operators.periods import period_weights, reduced_series, step_weights
from gridmeter.operators.settlement import capacity_balance, step_table
from gridmeter.plans.tables import EVENT_GRID, PRICE_TYPE, SCARCITY_TYPE, fixed_period_map, zone_readings

# Fixed values of the stand-in system.
WEIGHT_TOTAL = 8760.0  # hours represented by the weighted steps
STORAGE = {"purchase": "battery", "error": "pumped_hydro"}
STORAGE_HOURS = 4.0  # energy capacity = power capacity x hours
UNIT_COSTS = {  # generator value, storage value
    "Inv_Cost_per_MWyr": (85000.0, 60000.0),
    "Inv_Cost_per_MWhyr": (0.0, 20000.0),
    "Fixed_OM_Cost_per_MWyr": (12000.0, 8000.0),
    "Fixed_OM_Cost_per_MWhyr": (0.0, 5000.0),
    "Var_OM_Cost_per_MWh": (2.0, 0.5),
    "Var_OM_Cost_per_MWh_In": (0.0, 0.5),
}
NSE_ABOVE = 150.0  # load above this per step is unserved
NSE_PENALTY = 50000.0


RESERVE_DERATE = 0.9
ESR_SHARE = 0.05  # of the energy price, on weekdays (first constraint) and weekends (second)
SUBSIDY = {"view": 3.0, "click": 3.0}  # per MWh
REG_SUBSIDY = {"signup": 1.5}
FUEL = {"signup": 1.2}

KEY = ["Resource", "Zone"]


def _is_storage(col: str = "Resource"):
    return F.col(col).isin(list(STORAGE))


def rate(rates: dict[str, float], col: str = "Resource"):
    """A resource's rate, 0 where none is given."""
    out = F.lit(0.0)
    for name, value in rates.items():
        out = F.when(F.col(col) == name, F.lit(value)).otherwise(out)
    return out


def horizon_weights(series: DataFrame, steps: int, total: float = WEIGHT_TOTAL) -> DataFrame:
    """(Time_Index, weight): every step of every day that the series has, with
    equal weights that sum to ``total``."""
    days = series.select(F.floor((F.col("Time_Index") - 1) / steps).cast("long").alias("d")).distinct()
    n = days.agg(F.count(F.lit(1))).scalar()
    return days.select(F.explode(F.sequence(F.col("d") * steps + 1, (F.col("d") + 1) * steps)).alias("Time_Index")).select(
        "Time_Index", (F.lit(float(total)) / (n * F.lit(steps))).alias("weight")
    )


class System:
    """The result set over the per-step table ``st`` (checkpointed once). Each table
    is made when it is first asked for, so a report of capacities plans no prices."""

    def __init__(self, st: DataFrame, per_day: int):
        self.st, self.per_day = st, per_day

    @cached_property
    def values(self) -> DataFrame:
        """(Time_Index, Zone, Resource, value, charge)"""
        return self.st.select("Time_Index", "Zone", F.col("event_type").alias("Resource"), "value", "charge")

    @cached_property
    def price(self) -> DataFrame:
        """(Time_Index, Zone, price)"""
        return self.st.where(F.col("event_type") == PRICE_TYPE).select("Time_Index", "Zone", (F.col("value") / F.col("n")).alias("price"))

    @cached_property
    def reserve(self) -> DataFrame:
        return self.st.where(F.col("event_type") == SCARCITY_TYPE).groupBy("Time_Index").agg(F.sum("value").alias("shdw"))

    @cached_property
    def horizon(self) -> DataFrame:
        """(Time_Index, weight) of the whole horizon."""
        return horizon_weights(self.st, self.per_day)

    @cached_property
    def steps(self) -> DataFrame:
        """(Time_Index, Zone, Resource, value, charge, price, shdw, weight), full horizon."""
        return step_table(self.values, [self.price, self.reserve], self.horizon)

    @cached_property
    def power(self) -> DataFrame:
        """(Time_Index, Resource, value) over all zones"""
        return self.values.groupBy("Time_Index", "Resource").agg(F.sum("value").alias("value"))

    @cached_property
    def charge(self) -> DataFrame:
        return self.values.where(F.col("charge").isNotNull()).groupBy("Time_Index", "Resource").agg(F.sum("charge").alias("value"))

    @cached_property
    def period_map(self) -> DataFrame:
        return fixed_period_map(self.st, self.per_day)

    @cached_property
    def weights(self) -> DataFrame:
        """Per representative."""
        return period_weights(self.period_map, self.per_day, WEIGHT_TOTAL)

    @cached_property
    def step_w(self) -> DataFrame:
        """(Time_Index, weight) on the reduced index"""
        return step_weights(self.weights, self.per_day)

    @cached_property
    def red_power(self) -> DataFrame:
        return reduced_series(self.power, self.period_map, self.per_day).select("Time_Index", "Resource", "value")

    @cached_property
    def capacity(self) -> DataFrame:
        """Per (Resource, Zone)."""
        peaks = self.values.groupBy(*KEY).agg(F.avg("value").alias("StartCap"), F.max("value").alias("_gm_end"))
        stor = F.when(_is_storage(), F.lit(STORAGE_HOURS)).otherwise(F.lit(0.0))
        retired = F.greatest(F.col("StartCap") - F.col("_gm_end"), F.lit(0.0))
        built = F.greatest(F.col("_gm_end") - F.col("StartCap"), F.lit(0.0))
        return capacity_balance(peaks.select(
            *KEY, "StartCap", retired.alias("RetCap"), built.alias("NewCap"),
            (F.col("StartCap") * stor).alias("StartEnergyCap"), (retired * stor).alias("RetEnergyCap"), (built * stor).alias("NewEnergyCap"),
        ))

    @cached_property
    def generators(self) -> DataFrame:
        return self.capacity.select(
            *KEY,
            *[F.when(_is_storage(), F.lit(s)).otherwise(F.lit(g)).alias(k) for k, (g, s) in UNIT_COSTS.items()],
            _is_storage().cast("int").alias("STOR"),
        )

    @cached_property
    def storage(self) -> DataFrame:
        return self.generators.where(F.col("STOR") == 1).select(*KEY)


def build(spark: SparkSession, sf: str) -> System:
    return System(zone_readings(spark, sf), EVENT_GRID.steps_per_period)  # raw readings read once


def settlement_terms() -> dict:
    """What the settlement sums up per step, as columns of ``System.steps``."""
    from gridmeter.functions.time import index_to_clock, weekday_flag

    value, charge, price = F.col("value"), F.col("charge"), F.col("price")
    weekday = weekday_flag(index_to_clock("Time_Index", EVENT_GRID))
    esr = F.lit(ESR_SHARE) * price * value
    return {
        "Energy": value,
        "Charge": charge,
        "EnergyRevenue": price * value,
        "Charge_cost": price * charge,
        "SubsidyRevenue": rate(SUBSIDY) * value,
        "ReserveMarginRevenue": F.lit(RESERVE_DERATE) * F.col("shdw") * value,
        "ESR_1": F.when(weekday, esr),
        "ESR_2": F.when(~weekday, esr),
        "RegSubsidyRevenue": rate(REG_SUBSIDY) * value,
        "Fuel_cost": rate(FUEL) * value,
    }
