import datetime as dt
import math

from pyspark.sql import functions as F

import gridmeter.functions as X
from gridmeter.functions.time import Grid


def test_orientation_boundaries(spark):
    rows = [(135.0,), (135.01,), (225.0,), (225.01,), (None,), (float("nan"),), (0.0,), (-10.0,)]
    df = spark.createDataFrame(rows, "az double")
    got = [r[0] for r in df.select(X.orientation("az")).collect()]
    assert got == ["East", "South", "South", "West", "South", "South", "East", "East"]


def test_try_numeric_and_orientation_of_text(spark):
    df = spark.createDataFrame([("135",), ("N/A",), ("",), ("225.01",), ("4.47e6",), ("-0.0",)], "t string")
    out = df.select(X.try_numeric("t").alias("v")).collect()
    assert [r.v for r in out][:3] == [135.0, None, None]
    assert out[3].v == 225.01 and out[4].v == 4.47e6 and out[5].v == 0.0
    o = df.select(X.orientation(X.try_numeric("t"))).collect()
    assert [r[0] for r in o][:4] == ["East", "South", "South", "West"]


def test_weekday_flag_and_minutes(spark):
    ts = [dt.datetime(2022, 1, 2, 0, 0), dt.datetime(2022, 1, 1, 23, 55), dt.datetime(2022, 1, 3, 0, 0)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    out = df.select(X.weekday_flag("ts").alias("w"), X.minute_of_day("ts").alias("m"), F.dayofweek("ts").alias("d"),
                    X.time_of_day("ts").alias("t")).collect()
    assert [r.w for r in out] == [False, False, True]  # Sunday, Saturday, Monday
    assert [r.m for r in out] == [0, 23 * 60 + 55, 0]
    assert out[0].d == 1  # Sunday = 1, as R's wday
    assert out[1].t == "23:55:00"


def test_step_index_roundtrip_and_periods(spark):
    g = Grid()
    idx = [1, 2016, 2017, 105120]
    df = spark.createDataFrame([(i,) for i in idx], "i long")
    out = df.select(
        "i", X.index_to_clock("i", g).alias("c"), X.period_index("i", 2016).alias("p"),
        X.step_in_period("i", 2016).alias("s"),
    ).select("i", "c", "p", "s", X.step_index("c", g).alias("back")).collect()
    assert [r.back for r in out] == idx
    assert [r.p for r in out] == [1, 1, 2, 53]
    assert [r.s for r in out] == [0, 2015, 0, 287]  # 105120 = 52 * 2016 + 288
    assert out[0].c == dt.datetime(2025, 1, 1, 0, 0)
    assert out[3].c == dt.datetime(2025, 12, 31, 23, 55)


def test_signif(spark):
    vals = [1234.5, 0.000123456, -98765.0, 0.0, None, 155500.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(X.signif("x", 2)).collect()]
    assert got[0] == 1200.0 and math.isclose(got[1], 0.00012) and got[2] == -99000.0
    assert got[3] == 0.0 and got[4] is None and got[5] == 160000.0


def test_parse_two_digit_year_pivot(spark):
    df = spark.createDataFrame([("1/2/22 0:05",), ("12/31/98 23:55",), ("7/4/69 1:00",), ("bad",)], "t string")
    got = [r[0] for r in df.select(X.parse_timestamp("t", "M/d/yy H:mm")).collect()]
    assert got[0] == dt.datetime(2022, 1, 2, 0, 5)
    assert got[1] == dt.datetime(1998, 12, 31, 23, 55)
    assert got[2] == dt.datetime(1969, 7, 4, 1, 0)
    assert got[3] is None


def test_labels_and_signs(spark):
    df = spark.createDataFrame([(12.345, "EnergyRevenue"), (3.0, "Inv")], "v double, c string")
    out = df.select(X.concat_label("v", "MW").alias("l"), X.sign_by_membership("c", ["EnergyRevenue"]).alias("s")).collect()
    assert out[0].l == "12.35 MW" and out[1].l == "3.0 MW"
    assert [r.s for r in out] == [1.0, -1.0]


def test_power_curve_brute_force(spark):
    import numpy as np

    from gridmeter.operators.curves import CURVE_KW, CURVE_SPEEDS, FARM_KW, TURBINES, power_curve

    speeds = [None, 0.0, 0.5, 1.0, 3.5, 4.0, 12.3, 18.0, 26.9, 27.0, 29.99, 30.0, 30.01, 55.0]
    df = spark.createDataFrame([(s,) for s in speeds], "s double")
    got = [r.kw for r in power_curve(df, "s").collect()]
    for s, g in zip(speeds, got):
        if s is None:
            assert g is None
            continue
        one = 0.0 if (s < CURVE_SPEEDS[0] or s > CURVE_SPEEDS[-1]) else float(np.interp(s, CURVE_SPEEDS, CURVE_KW))
        assert g == min(one * TURBINES, FARM_KW), (s, g)
