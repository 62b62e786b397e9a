"""Property tests on random inputs, checked against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridmeter.operators.timeseries import interpolate_linear
from gridmeter.operators.windows import cumsum

T0 = dt.datetime(2023, 3, 1)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(0, 400), st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False))),
             min_size=1, max_size=40, unique_by=lambda t: t[0]),
    st.sampled_from([1, 3, 12, 288]),
)
def test_interpolation_equals_pandas(spark, pts, bucket_steps):
    rows = [(T0 + dt.timedelta(minutes=m), v) for m, v in sorted(pts)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = interpolate_linear(df, "ts", "v", every_minutes=5, bucket_steps=bucket_steps).orderBy("ts").toPandas()
    s = pd.Series([np.nan if v is None else v for _, v in rows], index=pd.DatetimeIndex([t for t, _ in rows]))
    exp = s.resample("5min").interpolate()
    assert list(got["ts"]) == list(exp.index)
    assert np.allclose(got["v"].to_numpy(dtype=float), exp.to_numpy(), equal_nan=True, rtol=1e-9, atol=1e-9)


@SETTINGS
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", "hot", "hot", "hot"]), st.integers(0, 20), st.integers(-100, 100)),
             min_size=1, max_size=200),
    st.integers(1, 9),
)
def test_cumsum_ends_at_group_total(spark, rows, parts):
    data = [(i, g, d, v) for i, (g, d, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, d int, v long")
    got = cumsum(df, "v", order=["d", "id"], by=["g"], out="c", partitions=parts).toPandas()
    pdf = pd.DataFrame(data, columns=["id", "g", "d", "v"]).sort_values(["d", "id"])
    pdf["exp"] = pdf.groupby("g")["v"].cumsum()
    m = got.merge(pdf[["id", "exp"]], on="id")
    assert len(m) == len(data) and (m["c"] == m["exp"]).all()
