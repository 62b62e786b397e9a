"""Settlement reports (B1-B15): weighted annual sums, revenues, costs, capacity.

Time series join their step weights (one row per step of the study horizon)
and collapse to one row per resource with partial aggregation; per-resource
tables then join on (Resource, Zone) - a few hundred rows each. Prices are
keyed by step, or by (step, zone). ``step_table`` joins quantities, prices and
weights once; ``settlement_sums`` takes every sum from it in one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmeter.operators.keys import require_unique

Key = str | Sequence[str]


def _keys(key: Key) -> list[str]:
    """Result tables are keyed by resource, or by (resource, zone)."""
    return [key] if isinstance(key, str) else list(key)


def _price_keys(values: DataFrame, prices: DataFrame, index: str, zone: str) -> list[str]:
    if zone in prices.columns and zone not in values.columns:
        raise ValueError(f"prices are keyed by {zone!r}, the quantities are not")
    return [index, zone] if zone in prices.columns else [index]


def step_table(values: DataFrame, prices: Sequence[DataFrame], weights: DataFrame, index: str = "Time_Index",
               zone: str = "Zone") -> DataFrame:
    """Quantities with the prices and the weight of their step. Each price table
    is keyed by step, or by step and zone, without repeats; a quantity without
    a price or weight keeps its row, with null there (see ``unmatched_steps``)."""
    out = values
    for p in prices:
        keys = _price_keys(values, p, index, zone)
        out = out.join(require_unique(p, keys, "a price table"), keys, "left")
    return out.join(require_unique(weights, [index], "the weight table"), index, "left")


def settlement_sums(steps: DataFrame, terms: Mapping[str, Column], by: Sequence[str], weight: str = "weight") -> DataFrame:
    """The sum of weight x term for every term, in one pass. A
    null term or weight counts as 0."""
    w = F.col(weight)
    return steps.groupBy(*by).agg(*[F.coalesce(F.sum(w * t), F.lit(0.0)).alias(name) for name, t in terms.items()])


def unmatched_steps(steps: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per resource, how many rows have no price or weight: ``no_<column>``."""
    return steps.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns])


def annual_sum(values: DataFrame, weights: DataFrame, by: Sequence[str] = ("Resource",), index: str = "Time_Index",
               value: str = "value", out: str = "AnnualSum") -> DataFrame:
    """B1: sum over steps of weight x value, per resource."""
    return settlement_sums(step_table(values, [], weights, index), {out: F.col(value)}, by)


def step_total(values: DataFrame, index: str = "Time_Index", value: str = "value", out: str = "Total") -> DataFrame:
    """B2: the ``Total`` column: sum over resources at each step."""
    return values.groupBy(index).agg(F.sum(value).alias(out))


def settle(values: DataFrame, prices: DataFrame, weights: DataFrame, by: Sequence[str] = ("Resource",),
           index: str = "Time_Index", value: str = "value", price: str = "price", out: str = "AnnualSum",
           zone: str = "Zone") -> DataFrame:
    """Sum of weight x price x quantity (charging cost, energy revenue).
    Prices that have a ``zone`` column settle the quantities of their zone."""
    steps = step_table(values, [prices], weights, index, zone)
    return settlement_sums(steps, {out: F.col(price) * F.col(value)}, by)


def capacity_balance(cap: DataFrame) -> DataFrame:
    """End = Start + New - Ret for power, energy and charge capacity."""
    out = cap
    for kind in ("Cap", "EnergyCap", "ChargeCap"):
        if f"Start{kind}" in cap.columns:
            out = out.withColumn(
                f"End{kind}", F.col(f"Start{kind}") + F.col(f"New{kind}") - F.col(f"Ret{kind}")
            )
    return out


def capacity_factor(energy: DataFrame, capacity: DataFrame, hours: float, storage: DataFrame | None = None,
                    key: Key = "Resource") -> DataFrame:
    """AnnualSum / (Capacity x hours); 0 for storage and for zero capacity,
    null for a resource without a capacity row."""
    k = _keys(key)
    j = energy.join(capacity.select(*k, F.col("EndCap").alias("Capacity")), k, "left")
    if storage is not None:
        j = j.join(storage.select(*k, F.lit(True).alias("_gm_stor")), k, "left")
        is_stor = F.coalesce(F.col("_gm_stor"), F.lit(False))
    else:
        is_stor = F.lit(False)
    cf = F.when(F.col("Capacity").isNull(), None).when(is_stor | (F.col("Capacity") <= 0), F.lit(0.0)).otherwise(
        F.col("AnnualSum") / (F.col("Capacity") * F.lit(float(hours)))
    )
    return j.select(*k, "AnnualSum", "Capacity", cf.alias("CapacityFactor"))


COST_PARTS = ["Inv_cost_MW", "Inv_cost_MWh", "Fixed_OM_cost_MW", "Fixed_OM_cost_MWh", "Var_OM_cost_out",
              "Var_OM_cost_in", "Fuel_cost", "Start_cost", "Charge_cost", "EmissionsCost"]
REVENUE_PARTS = ["EnergyRevenue", "SubsidyRevenue", "ReserveMarginRevenue", "ESRRevenue", "RegSubsidyRevenue"]


def cost_components(generators: DataFrame, capacity: DataFrame, energy: DataFrame, charge: DataFrame | None = None,
                    key: Key = "Resource") -> DataFrame:
    """Investment, fixed and variable O&M cost per resource.

    generators: unit costs (Inv_Cost_per_MWyr, Inv_Cost_per_MWhyr,
    Fixed_OM_Cost_per_MWyr, Fixed_OM_Cost_per_MWhyr, Var_OM_Cost_per_MWh,
    Var_OM_Cost_per_MWh_In); capacity: NewCap, EndCap, NewEnergyCap,
    EndEnergyCap; energy / charge: AnnualSum. A generator without a capacity
    row is kept (``no_capacity``) and missing capacities count as 0, as for
    resources that have no energy capacity.
    """
    k = _keys(key)
    capacity = require_unique(capacity, k, "the capacity table").withColumn("_gm_cap", F.lit(True))
    j = generators.join(capacity, k, "left").join(energy.select(*k, F.col("AnnualSum").alias("_gm_out")), k, "left")
    if charge is not None:
        j = j.join(charge.select(*k, F.col("AnnualSum").alias("_gm_in")), k, "left")
    else:
        j = j.withColumn("_gm_in", F.lit(0.0))
    z = F.lit(0.0)

    def part(cost: str, amount: str) -> Column:
        return F.col(cost) * F.coalesce(F.col(amount), z)

    return j.select(
        *k,
        F.col("_gm_cap").isNull().alias("no_capacity"),
        part("Inv_Cost_per_MWyr", "NewCap").alias("Inv_cost_MW"),
        part("Inv_Cost_per_MWhyr", "NewEnergyCap").alias("Inv_cost_MWh"),
        part("Fixed_OM_Cost_per_MWyr", "EndCap").alias("Fixed_OM_cost_MW"),
        part("Fixed_OM_Cost_per_MWhyr", "EndEnergyCap").alias("Fixed_OM_cost_MWh"),
        (F.col("Var_OM_Cost_per_MWh") * F.coalesce(F.col("_gm_out"), z)).alias("Var_OM_cost_out"),
        (F.col("Var_OM_Cost_per_MWh_In") * F.coalesce(F.col("_gm_in"), z)).alias("Var_OM_cost_in"),
    )


def net_revenue(components: DataFrame, revenues: dict[str, DataFrame], key: Key = "Resource") -> DataFrame:
    """Join every revenue / cost table onto the components (left
    joins on the resource key; a missing table or row counts as 0), then
    Revenue = sum of revenue parts, Cost = sum of cost parts, Profit = Revenue - Cost."""
    k = _keys(key)
    out = components
    for name, tbl in revenues.items():
        out = out.join(tbl.select(*k, F.col("AnnualSum").alias(name)), k, "left")
    for c in COST_PARTS + REVENUE_PARTS:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0))) if c in out.columns else out.withColumn(c, F.lit(0.0))
    rev = sum((F.col(c) for c in REVENUE_PARTS[1:]), F.col(REVENUE_PARTS[0]))
    cost = sum((F.col(c) for c in COST_PARTS[1:]), F.col(COST_PARTS[0]))
    return out.withColumn("Revenue", rev).withColumn("Cost", cost).withColumn("Profit", F.col("Revenue") - F.col("Cost"))


def cost_rollup(net: DataFrame, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """System cost rows ``(Costs, Total)``: cFix = investment + fixed
    O&M, cVar = variable O&M + fuel, extra rows (e.g. cNSE) as given, cTotal =
    their sum. Charge and emissions costs are not part of it."""
    agg = net.agg(
        F.sum(F.col("Inv_cost_MW") + F.col("Inv_cost_MWh") + F.col("Fixed_OM_cost_MW") + F.col("Fixed_OM_cost_MWh")).alias("cFix"),
        F.sum(F.col("Var_OM_cost_out") + F.col("Var_OM_cost_in") + F.col("Fuel_cost")).alias("cVar"),
        F.sum("Start_cost").alias("cStart"),
    )
    names = ["cFix", "cVar", "cStart"]
    for name, tbl in (extra or {}).items():
        agg = agg.withColumn(name, tbl.select(F.first("value")).scalar())
        names.append(name)
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    agg = agg.withColumn("cTotal", total)
    return agg.unpivot([], ["cTotal", *names], "Costs", "Total")


def unserved_energy_cost(nse: DataFrame, weights: DataFrame, penalty: float, index: str = "Time_Index",
                         value: str = "value") -> DataFrame:
    """Penalty x sum of weight x unserved energy (one row ``value``)."""
    j = nse.join(weights, index, "inner")
    return j.agg((F.lit(float(penalty)) * F.sum(F.col("weight") * F.col(value))).alias("value"))
