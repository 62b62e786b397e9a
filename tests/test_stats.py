import numpy as np
import pytest

from gridmeter.operators.stats import density_ridges, ecdf, exact_quantiles, grouped_linear_fit, kernel_density, predict_linear


def test_exact_quantiles_type7(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=1001) * 10, 2)
    x[:200] = 3.0  # heavy ties
    g = np.where(np.arange(x.size) % 3 == 0, "a", "b")
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, x)], "g string, x double")
    got = {r.g: (r.q_0, r.q_1, r.q_2) for r in exact_quantiles(df, "x", [0.25, 0.5, 0.9], by=["g"]).collect()}
    for k in ["a", "b"]:
        exp = np.percentile(x[g == k], [25, 50, 90])  # numpy default = type 7
        assert np.allclose(got[k], exp)
    glob = exact_quantiles(df, "x", [0.75]).collect()[0]
    assert glob.q_0 == pytest.approx(np.percentile(x, 75))


def test_kernel_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    d = kernel_density(df, "x", n=512).orderBy("i").toPandas()
    area = np.trapezoid(d["density"], d["x"])
    assert area == pytest.approx(1.0, abs=2e-3)
    # peak near 0 for a standard normal
    assert abs(d.loc[d["density"].idxmax(), "x"]) < 0.3


def test_linear_fit_and_predict(spark):
    rows = [("E", float(x), 2.0 * x + 1.0) for x in range(10)] + [("W", float(x), -x + 5.0) for x in range(10)]
    df = spark.createDataFrame(rows, "o string, x double, y double")
    coef = grouped_linear_fit(df, "y", "x", by=["o"])
    got = {r.o: (r.slope, r.intercept) for r in coef.collect()}
    assert got["E"] == pytest.approx((2.0, 1.0)) and got["W"] == pytest.approx((-1.0, 5.0))
    pred = {(r.o, r.x): r.fit for r in predict_linear(coef, [20.0]).collect()}
    assert pred[("E", 20.0)] == pytest.approx(41.0)


def test_ecdf_matches_cume_dist(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.x: r.ecdf for r in ecdf(df, "x").collect()}
    assert got == {1.0: 1 / 7, 2.0: 3 / 7, 3.0: 4 / 7, 5.0: 1.0}


def test_kernel_density_approx_bandwidth_close_to_exact(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2.0, size=3000)], "x double")
    exact = kernel_density(df, "x", n=256).orderBy("i").toPandas()
    approx = kernel_density(df, "x", n=256, approx_accuracy=100000).orderBy("i").toPandas()
    assert np.allclose(exact["density"], approx["density"], rtol=0.05, atol=1e-3)


def test_density_leaves_out_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    d = kernel_density(df, "x", by=["g"], n=64)
    assert {r.g for r in d.select("g").distinct().collect()} == {"b"}


def _nrd0(x, adjust=1.0):
    q1, q3 = np.percentile(x, [25, 75])
    sd = x.std(ddof=1)
    spread = min(sd, (q3 - q1) / 1.34) or sd or abs(x[0]) or 1.0
    return 0.9 * adjust * spread * len(x) ** -0.2


def _r_density(x, bw, lo_x, hi_x, n):
    """The definition of R's ``density`` before 4.4, with sums instead of FFT."""
    m = 512 if n <= 512 else 1 << int(np.ceil(np.log2(n)))
    lo, up = lo_x - 4 * bw, hi_x + 4 * bw
    y, step = np.zeros(m), (up - lo) / (m - 1)
    for v in x:
        at = (v - lo) / step
        j = int(np.floor(at))
        if 0 <= j < m:
            y[j] += (1 - (at - j)) / len(x)
        if 0 <= j + 1 < m:
            y[j + 1] += (at - j) / len(x)
    apart = 2 * (up - lo) / (2 * m - 1)
    d = np.abs(np.arange(m)[:, None] - np.arange(m)[None, :]) * apart
    conv = (np.exp(-0.5 * (d / bw) ** 2) / (bw * np.sqrt(2 * np.pi))) @ y
    at = np.linspace(lo_x, hi_x, n)
    return at, np.interp(at, np.linspace(lo, up, m), conv)


@pytest.mark.parametrize("n", [512, 100, 700])
@pytest.mark.parametrize("domain", ["cut", "data", "all"])
def test_density_equals_its_definition(spark, n, domain):
    rng = np.random.default_rng(4)
    groups = {"a": rng.gamma(2.0, 3.0, 400), "b": np.round(rng.normal(20, 2, 300), 1), None: rng.uniform(-5, 5, 50)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, x double")
    got = kernel_density(df, "x", by=["g"], n=n, domain=domain, adjust=0.5).orderBy("i").toPandas()
    every = np.concatenate(list(groups.values()))
    for g, x in groups.items():
        bw = _nrd0(x, 0.5)
        ends = {"cut": (x.min() - 3 * bw, x.max() + 3 * bw), "data": (x.min(), x.max()), "all": (every.min(), every.max())}[domain]
        at, d = _r_density(x, bw, *ends, n)
        mine = got[got.g.isna()] if g is None else got[got.g == g]
        assert np.allclose(mine["x"], at) and np.allclose(mine["density"], d, rtol=1e-9, atol=1e-14)


def test_ridges_share_bandwidth_and_range(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0, 1, 200), "b": rng.normal(4, 3, 100), "two": np.array([1.0, 9.0]), "one": np.array([30.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, x double")
    got = density_ridges(df, "x", by=["g"]).orderBy("i").toPandas()
    assert set(got.g) == {"a", "b"}  # two values have no curve, but a bandwidth; one has neither
    bw = np.mean([_nrd0(groups[g]) for g in ("a", "b", "two")])
    every = np.concatenate(list(groups.values()))
    for g in ("a", "b"):
        at, d = _r_density(groups[g], bw, every.min() - 3 * bw, every.max() + 3 * bw, 512)
        mine = got[got.g == g]
        assert np.allclose(mine["x"], at) and np.allclose(mine["density"], d, rtol=1e-9, atol=1e-14)
        share = np.append(0, np.cumsum(d[:-1] * np.diff(at)))
        assert np.allclose(mine["ecdf"], share) and np.allclose(mine["tail"], 0.5 - abs(0.5 - share)) and mine["ndensity"].max() == 1.0
    given = density_ridges(df, "x", by=["g"], bandwidth=1.0).toPandas()
    assert given["x"].min() == pytest.approx(every.min() - 3) and given["x"].max() == pytest.approx(33.0)
