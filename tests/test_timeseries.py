import datetime as dt

import numpy as np
import pandas as pd
import pytest

from gridmeter.operators.timeseries import (
    expand_period_map, interpolate_columns, interpolate_linear, resample_grid, split_period_index,
)

T0 = dt.datetime(2022, 1, 1)


def _series():
    # 15-minute knots with a gap of several missing values, an off-grid sample,
    # a null value and a last sample on the grid
    pts = [(0, 1.0), (15, 4.0), (30, None), (90, 10.0), (97, 55.0), (105, 7.0), (195, 2.0)]
    return [(T0 + dt.timedelta(minutes=m), v) for m, v in pts]


def _pandas(pts, every="5min"):
    s = pd.Series([v if v is not None else np.nan for _, v in pts], index=pd.DatetimeIndex([t for t, _ in pts]))
    return s.resample(every).interpolate()


@pytest.mark.parametrize("bucket_steps", [288, 4, 1])
def test_interpolate_matches_pandas(spark, bucket_steps):
    pts = _series()
    df = spark.createDataFrame(pts, "ts timestamp_ntz, v double")
    got = interpolate_linear(df, "ts", "v", every_minutes=5, bucket_steps=bucket_steps).orderBy("ts").toPandas()
    exp = _pandas(pts)
    assert list(got["ts"]) == list(exp.index)
    assert np.allclose(got["v"].to_numpy(dtype=float), exp.to_numpy(), equal_nan=True)


def test_interpolate_leading_gap_and_tails(spark):
    # first sample off the grid -> leading null; last sample off grid -> tail
    pts = [(T0 + dt.timedelta(minutes=2), 5.0), (T0 + dt.timedelta(minutes=10), 1.0),
           (T0 + dt.timedelta(minutes=20), 3.0), (T0 + dt.timedelta(minutes=33), 9.0)]
    df = spark.createDataFrame(pts, "ts timestamp_ntz, v double")
    hold = interpolate_linear(df, "ts", "v", tail="hold").orderBy("ts").toPandas()
    exp = _pandas(pts)
    assert np.allclose(hold["v"].to_numpy(dtype=float), exp.to_numpy(), equal_nan=True)
    ext = interpolate_linear(df, "ts", "v", tail="extend").orderBy("ts").toPandas()
    # grid ends at floor(33 min) = 30; slope of the last segment is 1.0 per step
    assert list(ext["v"].iloc[-2:]) == [pytest.approx(4.0), pytest.approx(5.0)]
    none = interpolate_linear(df, "ts", "v", tail="none").orderBy("ts").toPandas()
    assert np.isnan(none["v"].iloc[-1])


def test_interpolate_passes_through_knots_per_series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in ["a", "b"]:
        for h in range(48):
            if rng.random() < 0.7:
                rows.append((s, T0 + dt.timedelta(hours=h), float(rng.normal())))
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double")
    got = interpolate_linear(df, "ts", "v", by=["s"], every_minutes=15, bucket_steps=16).toPandas()
    got = got.set_index(["s", "ts"])["v"]
    for s, t, v in rows:
        assert got.loc[(s, t)] == pytest.approx(v)
    assert got.index.is_unique


def test_resample_grid_nulls_between_samples(spark):
    pts = _series()
    df = spark.createDataFrame(pts, "ts timestamp_ntz, v double")
    got = resample_grid(df, "ts", "v", every_minutes=5, bucket_steps=5).orderBy("ts").toPandas()
    assert len(got) == 40  # 0..195 minutes every 5
    assert got["v"].iloc[0] == 1.0 and np.isnan(got["v"].iloc[1])
    assert np.isnan(got.set_index("ts").loc[T0 + dt.timedelta(minutes=95), "v"])  # off-grid sample ignored


def test_interpolate_columns_ev_profile(spark):
    # 15-minute day profile with two day-type columns -> 5-minute, "extend" tail
    rows = [(T0 + dt.timedelta(minutes=15 * i), float(i), float(2 * i)) for i in range(4)]
    df = spark.createDataFrame(rows, "Time timestamp_ntz, Weekday double, Weekend double")
    out = interpolate_columns(df, "Time", ["Weekday", "Weekend"], name="day", every_minutes=5, tail="extend").toPandas()
    wk = out[out.day == "Weekday"].sort_values("Time")["value"].to_numpy()
    assert np.allclose(wk, np.arange(10) / 3.0)


def test_split_and_expand_period_map(spark):
    reduced = spark.createDataFrame([(1, s, float(s)) for s in range(3)] + [(2, s, 10.0 + s) for s in range(3)],
                                    "Rep_Period_Index int, Step long, v double")
    pmap = spark.createDataFrame([(1, 1, 1), (2, 3, 2), (3, 1, 1), (4, 3, 2)],
                                 "Period_Index int, Rep_Period int, Rep_Period_Index int")
    out = expand_period_map(reduced, pmap, steps=3).orderBy("Time_Index").toPandas()
    assert list(out["Time_Index"]) == list(range(1, 13))
    assert list(out["v"]) == [0, 1, 2, 10, 11, 12, 0, 1, 2, 10, 11, 12]
    idx = spark.createDataFrame([(2016,), (2017,)], "i long")
    r = split_period_index(idx, "i", 2016).collect()
    assert [(x.Rep_Period, x.Step) for x in r] == [(1, 2015), (2, 0)]


def test_day_profile_long_minutes_and_flags(spark):
    from gridmeter.operators.timeseries import day_profile_long

    rows = [(T0 + dt.timedelta(minutes=5 * i), float(i), float(10 * i)) for i in range(3)]
    df = spark.createDataFrame(rows, "Time timestamp_ntz, Weekday double, Weekend double")
    out = sorted((r.Time, r.Weekday, r.EV_load) for r in day_profile_long(df, "Time").collect())
    assert out == [(0, False, 0.0), (0, True, 0.0), (5, False, 10.0), (5, True, 1.0), (10, False, 20.0), (10, True, 2.0)]


def test_interpolate_duplicate_points_use_their_mean(spark):
    rows = [(T0, 0.0), (T0 + dt.timedelta(minutes=10), 4.0), (T0 + dt.timedelta(minutes=10), 8.0)] + \
           [(T0 + dt.timedelta(minutes=20), 0.0)] * 50  # a hot grid point
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = interpolate_linear(df, "ts", "v", every_minutes=5).orderBy("ts").toPandas()
    assert list(got["v"]) == [0.0, 3.0, 6.0, 3.0, 0.0]


@pytest.mark.parametrize("bucket_steps", [1, 2, 288])
def test_extend_tail_slope_across_buckets(spark, bucket_steps):
    # samples at 0, 10, 20 min; grid runs to the off-grid 31 min sample's floor (30)
    pts = [(T0, 0.0), (T0 + dt.timedelta(minutes=10), 2.0), (T0 + dt.timedelta(minutes=20), 6.0),
           (T0 + dt.timedelta(minutes=31), 100.0)]
    df = spark.createDataFrame(pts, "ts timestamp_ntz, v double")
    out = interpolate_linear(df, "ts", "v", tail="extend", bucket_steps=bucket_steps).orderBy("ts").toPandas()
    # last segment 2 -> 6 over two steps: slope 2 per step, continued for 25 and 30
    assert list(out["v"]) == [0.0, 1.0, 2.0, 4.0, 6.0, 8.0, 10.0]


@pytest.mark.parametrize("tail", ["hold", "extend", "none"])
def test_one_long_series_over_many_slices(spark, tail):
    """A gap, a head and a tail of many buckets; one series in all slices."""
    rng = np.random.default_rng(8)
    at = sorted(rng.choice(4000, 300, replace=False).tolist())
    at = [m for m in at if not 1000 < m < 2500]
    pts = [(T0 + dt.timedelta(minutes=5 * m), float(rng.normal())) for m in at]
    pts = [(T0 + dt.timedelta(minutes=-5 * 700 + 1), 9.0), *pts, (T0 + dt.timedelta(minutes=5 * 5000 + 1), 9.0)]
    df = spark.createDataFrame(pts, "ts timestamp_ntz, v double").repartition(16)
    got = interpolate_linear(df, "ts", "v", tail=tail, bucket_steps=50).orderBy("ts").toPandas()
    exp = _pandas(pts)
    assert list(got["ts"]) == list(exp.index)
    known = slice(0, 700 + at[-1] + 1)
    got_v, exp_v = got["v"].to_numpy(dtype=float), exp.to_numpy()
    assert np.allclose(got_v[known], exp_v[known], equal_nan=True)
    rest, last = got_v[known.stop :], got_v[known.stop - 1]
    if tail == "none":
        assert np.isnan(rest).all()
    else:
        slope = (pts[-2][1] - pts[-3][1]) / (at[-1] - at[-2]) if tail == "extend" else 0.0
        assert np.allclose(rest, last + slope * np.arange(1, len(rest) + 1))
