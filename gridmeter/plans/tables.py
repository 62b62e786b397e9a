"""Readers for the driver's test tables and the interval series derived from them.

The study's inputs (load, price, reserve price, resource output) are not in
the test tables, so ``events`` stands in for the interval data: every event is
a metered reading at its timestamp, ``value`` its size and ``event_type`` the
resource or quantity it belongs to. The mapping is fixed here, once:

  demand / load    all events                 (sum per step)
  energy price     ``purchase`` events        (mean per step)
  reserve price    ``error`` events           (sum per step)
  EV charging      ``click`` events           (day profile)
  DG generation    ``signup`` events          (sum per step)
  wind, solar      ``click``, ``view`` events (curtailment)

Steps are 5 minutes from 2024-01-01 (the events month); a period is a day
(288 steps).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.functions.time import Grid, step_index

EVENT_GRID = Grid(step_minutes=5, base="2024-01-01 00:00:00", steps_per_period=288)

# Fixed values of the stand-in mapping (see module doc).
PRICE_TYPE = "purchase"
SCARCITY_TYPE = "error"
EV_TYPE = "click"
DG_TYPE = "signup"
WIND_TYPE = "click"
SOLAR_TYPE = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, grid: Grid = EVENT_GRID) -> DataFrame:
    """``events`` with its 1-based 5-minute step number ``Time_Index``."""
    return table(spark, sf_dir, "events").withColumn("Time_Index", step_index("ts", grid))


# Fixed values of the stand-in: events below this value count as charging.
CHARGE_BELOW = 10.0


def step_readings(spark: SparkSession, sf_dir: str, grid: Grid = EVENT_GRID) -> DataFrame:
    """The raw readings aggregated once per (step, event type): ``value``
    (sum), ``charge`` (sum of readings below ``CHARGE_BELOW``) and ``n``.

    Every per-step series of the stand-in derives from this table, so a query
    reads the raw table once however many series it joins (Spark has no
    multi-query optimisation: branches pruned to different columns would each
    rescan). The table has one row per step and series, not per reading; it
    is checkpointed to the shared folder, which cuts the lineage to the raw
    scan. (Measured against ``persist``: the in-memory relation made the
    many-branch settlement plans ~1.5-2x slower; the checkpoint costs about
    the same as no materialisation at sf0.1 and saves the rescans at scale.)
    """
    from gridmeter.session import checkpoint_dir

    agg = step_aggregate(events(spark, sf_dir, grid))
    checkpoint_dir(spark)
    return agg.checkpoint(eager=True)


def zone_readings(spark: SparkSession, sf_dir: str, grid: Grid = EVENT_GRID) -> DataFrame:
    """``step_readings`` per zone (users with even ids: zone 1, odd: zone 2; no
    id: zone 1), checkpointed like it."""
    from gridmeter.session import checkpoint_dir

    zone = (F.coalesce(F.pmod("user_id", F.lit(2)), F.lit(0)) + 1).cast("string")
    agg = step_aggregate(events(spark, sf_dir, grid).withColumn("Zone", zone), ["Zone"])
    checkpoint_dir(spark)
    return agg.checkpoint(eager=True)


def step_aggregate(ev: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (step, event type, further keys): value sum, charging sum, reading count."""
    return ev.groupBy("Time_Index", "event_type", *by).agg(
        F.sum("value").alias("value"),
        F.sum(F.when(F.col("value") < CHARGE_BELOW, F.col("value"))).alias("charge"),
        F.count(F.lit(1)).alias("n"),
    )


def load_series(st: DataFrame) -> DataFrame:
    """(Time_Index, Load): demand per step."""
    return st.groupBy("Time_Index").agg(F.sum("value").alias("Load"))


def price_series(st: DataFrame) -> DataFrame:
    """(Time_Index, price): energy price per step (mean ``purchase`` value)."""
    return st.where(F.col("event_type") == PRICE_TYPE).select("Time_Index", (F.col("value") / F.col("n")).alias("price"))


def scarcity_series(st: DataFrame) -> DataFrame:
    """(Time_Index, shdw): reserve (scarcity) price per step."""
    return st.where(F.col("event_type") == SCARCITY_TYPE).select("Time_Index", F.col("value").alias("shdw"))


def resource_series(st: DataFrame) -> DataFrame:
    """(Time_Index, Resource, value): output per step and resource (long form)."""
    return st.select("Time_Index", F.col("event_type").alias("Resource"), "value")


def charge_series(st: DataFrame) -> DataFrame:
    """(Time_Index, Resource, value): charging per step and resource."""
    return st.where(F.col("charge").isNotNull()).select(
        "Time_Index", F.col("event_type").alias("Resource"), F.col("charge").alias("value")
    )


def typed_series(st: DataFrame, event_type: str, name: str) -> DataFrame:
    """(Time_Index, <name>): per-step sum of one event type."""
    return st.where(F.col("event_type") == event_type).select("Time_Index", F.col("value").alias(name))


def fixed_period_map(series: DataFrame, steps: int = 288, reps: int = 7) -> DataFrame:
    """Period map by rule: every day present in a step series (anything with
    ``Time_Index``) maps onto one of the first ``reps`` days
    (``(day - 1) mod reps + 1``), which are the representatives."""
    days = series.select(F.floor((F.col("Time_Index") - 1) / steps).cast("long").alias("d")).distinct()
    rep = F.pmod(F.col("d"), F.lit(reps)) + 1
    return days.select((F.col("d") + 1).alias("Period_Index"), rep.alias("Rep_Period"), rep.alias("Rep_Period_Index"))
