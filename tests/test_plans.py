"""Plan checks: pushdown, pruning, bounded broadcasts."""

from pyspark.sql import functions as F

from gridmeter.plans.catalog import REGISTRY

from conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    from gridmeter.plans.tables import events, step_aggregate

    # the raw scan behind every per-step series reads three of six columns
    p = _plan(step_aggregate(events(spark, SF)))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p
    # the flagship's three series come from the checkpointed step table
    assert "Scan parquet" not in _plan(REGISTRY["demand_price_summary"](spark, SF))


def test_filters_reach_the_scan(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    from gridmeter.functions.time import ts_literal

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    q = ev.where((F.col("ts") >= ts_literal("2024-01-05 00:00:00")) & (F.col("event_type") == "purchase"))
    p = _plan(q.select("value"))
    assert "PushedFilters" in p and "EqualTo(event_type,purchase)" in p and "GreaterThanOrEqual(ts" in p


def test_day_profile_join_is_broadcast(spark):
    p = _plan(REGISTRY["net_load_5min"](spark, SF))
    assert "BroadcastHashJoin" in p


def test_power_curve_has_no_join(spark):
    p = _plan(REGISTRY["power_curve"](spark, SF))
    assert "Join" not in p and "Exchange" not in p


def test_no_keyless_joins_anywhere(spark):
    bad = {}
    for name, q in sorted(REGISTRY.items()):
        p = _plan(q(spark, SF))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in p]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_hot_group_keys_do_not_move_the_input(spark):
    """With the automatic broadcast off, no exchange is keyed by the group."""
    from gridmeter.operators.periods import scale_features
    from gridmeter.operators.windows import offset_from_first

    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "ts", "value")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (offset_from_first(ev, "ts", by=["event_type"]), scale_features(ev, "value", ["event_type"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(event_type" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_day_profile_with_repeated_keys_is_refused(spark):
    import pytest

    from gridmeter.operators.joins import join_day_profile

    series = spark.range(3).selectExpr("timestamp_ntz'2024-01-01 00:00:00' as t")
    profile = spark.createDataFrame([(0, True, 1.0), (0, True, 2.0)], "Time int, Weekday boolean, v double")
    with pytest.raises(Exception, match="several rows"):
        join_day_profile(series, "t", profile).collect()


def _jobs(spark, build) -> int:
    """Jobs that building a plan starts."""
    spark.sparkContext.setJobGroup("building", "a plan is built")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))


def test_settlement_plans_are_built_without_jobs(spark):
    from gridmeter.plans import catalog as C
    from gridmeter.plans.system import KEY, build

    s = build(spark, SF)
    assert _jobs(spark, lambda: (s.steps, s.capacity, s.generators, s.storage, s.weights, C._sums(s))) == 0
    from gridmeter.operators.settlement import annual_sum, cost_components, settle

    part = s.values.select(*KEY, F.col("value").alias("AnnualSum"))
    assert _jobs(spark, lambda: (annual_sum(s.values, s.horizon, KEY), settle(s.values, s.price, s.horizon, KEY), cost_components(s.generators, s.capacity, part, key=KEY))) == 0


def test_curve_table_lookup_is_an_equi_join(spark):
    q = REGISTRY["curve_lookup"](spark, SF)
    q.collect()
    plan = _plan(q)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan


def test_interpolation_has_no_window_over_a_series(spark):
    import re

    q = REGISTRY["interpolate_linear"](spark, SF)
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    # over rows only inside a slice; along a series only over the slices' edges
    assert windows and all("_gm_pid" in w for w in windows)
