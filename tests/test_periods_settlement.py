import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeter.operators.periods import period_weights, reduced_series, step_weights
from gridmeter.plans.system import WEIGHT_TOTAL, build

from conftest import SF


def test_weights_sum_to_total(spark):
    pmap = spark.createDataFrame([(p, 1 + (p - 1) % 3, 1 + (p - 1) % 3) for p in range(1, 11)],
                                 "Period_Index long, Rep_Period long, Rep_Period_Index long")
    w = period_weights(pmap, steps=24, total=8760.0)
    tot = w.select(F.sum(F.col("weight") * 24)).first()[0]
    assert tot == pytest.approx(8760.0)
    sw = step_weights(w, 24)
    assert sw.count() == 3 * 24 and sw.select(F.sum("weight")).first()[0] == pytest.approx(8760.0)


def test_reduced_series_reindexes(spark):
    pmap = spark.createDataFrame([(1, 2, 1), (2, 2, 1), (3, 3, 2)], "Period_Index long, Rep_Period long, Rep_Period_Index long")
    s = spark.createDataFrame([(i, float(i)) for i in range(1, 13)], "Time_Index long, v double")  # 3 periods of 4
    out = sorted((r.Time_Index, r.v) for r in reduced_series(s, pmap, 4).collect())
    assert out == [(1, 5.0), (2, 6.0), (3, 7.0), (4, 8.0), (5, 9.0), (6, 10.0), (7, 11.0), (8, 12.0)]


def test_settlement_identities(spark):
    from gridmeter.plans import catalog as C

    s = build(spark, SF)
    assert s.step_w.select(F.sum("weight")).first()[0] == pytest.approx(WEIGHT_TOTAL)
    used = s.steps.select("Time_Index", "weight").distinct()
    assert used.where("weight is null").isEmpty() and used.select(F.max("Time_Index")).first()[0] > 29 * 288
    net = C._net_revenue(s).toPandas()
    parts = net[["Inv_cost_MW", "Inv_cost_MWh", "Fixed_OM_cost_MW", "Fixed_OM_cost_MWh", "Var_OM_cost_out",
                 "Var_OM_cost_in", "Fuel_cost", "Start_cost", "Charge_cost", "EmissionsCost"]].sum(axis=1)
    assert (parts - net.Cost).abs().max() < 1e-6
    assert ((net.Profit - (net.Revenue - net.Cost)).abs() < 1e-6).all()
    cap = s.capacity.toPandas()
    assert ((cap.EndCap - (cap.StartCap + cap.NewCap - cap.RetCap)).abs() < 1e-9).all()
    inst = C.REGISTRY["installed_capacity"](spark, SF).toPandas().set_index("Resource")
    assert inst.loc["Total", "Zone"] == "n/a"
    assert inst.loc["Total", "EndCap"] == pytest.approx(inst.drop("Total")["EndCap"].sum(), abs=1e-3)
    rollup = C.REGISTRY["cost_rollup"](spark, SF).toPandas().set_index("Costs")["Total"]
    assert rollup["cTotal"] == pytest.approx(rollup[["cFix", "cVar", "cStart", "cNSE"]].sum(), abs=0.05)


def test_cluster_periods_map_is_complete(spark):
    from gridmeter.plans import catalog as C

    m = C.REGISTRY["cluster_periods"](spark, SF).toPandas()
    assert m.Period_Index.is_unique and len(m) == 30
    reps = m.drop_duplicates("Rep_Period").sort_values("Rep_Period")
    # representatives numbered 1..K in period order, each represents itself
    assert list(reps.Rep_Period_Index) == list(range(1, len(reps) + 1))
    assert set(reps.Rep_Period) <= set(m.Period_Index)
    self_map = m.set_index("Period_Index").loc[reps.Rep_Period, "Rep_Period"]
    assert (self_map.to_numpy() == reps.Rep_Period.to_numpy()).all()


def test_cluster_periods_grows_k_until_threshold(spark):
    from gridmeter.operators.periods import cluster_periods

    # 12 periods in three tight groups around 0, 10 and 20; one member of each
    # group sits exactly on the group mean, so it must be the representative
    centers = {0: 0.0, 1: 10.0, 2: 20.0}
    offs = [-0.1, 0.0, 0.1, 0.0]
    rows, exact = [], {}
    p = 1
    for g, c in centers.items():
        for j, o in enumerate(offs):
            vec = [c + o, c - o, c]
            if j == 1:
                exact[g] = p
            rows.append((p, vec))
            p += 1
    feats = spark.createDataFrame(rows, "Period_Index int, features array<double>")
    # possible error of three standardised features: 4 * sqrt(3); 0.1 of it is 0.69
    m = cluster_periods(feats, k_min=1, k_max=6, threshold=0.1, repeats=2, seed=3).toPandas()
    assert m.Period_Index.is_unique and len(m) == 12
    assert m.Rep_Period.nunique() == 3  # k grew 1 -> 3 and stopped at the threshold
    for g, rep in exact.items():
        members = m[m.Period_Index.between(4 * g + 1, 4 * g + 4)]
        assert set(members.Rep_Period) == {rep}
    assert sorted(m.Rep_Period_Index.unique()) == [1, 2, 3]


def _lloyd(x, labels, k, rounds):
    """Plain k-means on vectors."""
    for _ in range(rounds):
        means = [x[labels == c].mean(axis=0) if (labels == c).any() else np.full(x.shape[1], np.inf) for c in range(k)]
        new = np.array([int(np.argmin(np.round([((v - m) ** 2).sum() for m in means], 9))) for v in x])
        if (new == labels).all():
            break
        labels = new
    return labels


def _described(x, labels):
    """Cost, representative of every row and the worst distance to it."""
    reps, cost = np.zeros(len(x), int), 0.0
    for c in set(labels.tolist()):
        at = np.flatnonzero(labels == c)
        near = ((x[at] - x[at].mean(axis=0)) ** 2).sum(axis=1)
        reps[at], cost = at[near.round(9).argmin()], cost + near.sum()
    return cost, reps, ((x - x[reps]) ** 2).sum(axis=1)


def _brute_map(x, names, k_min, k_max, limit, repeats, seed, insert):
    best = None
    for k in range(k_min, k_max + 1):
        if insert and best:
            cost, reps, far = best
            if len(set(reps)) < k - 1:
                break
            labels = np.unique(reps, return_inverse=True)[1].copy()
            labels[far.round(9).argmax()] = k - 1
            best = _described(x, _lloyd(x, labels, k, 50))
        else:
            fits = []
            for r in range(repeats):
                first, weight = [], np.ones(len(x))
                while len(first) < k:
                    u = [(int(hashlib.md5(f"{seed}-{r}-{len(first)}-{p}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for p in names]
                    times = [-math.log(a) / w if w > 0 else math.inf for a, w in zip(u, weight, strict=True)]
                    first.append(int(np.argmin(times)))
                    weight = np.min([((x - x[c]) ** 2).sum(axis=1) for c in first], axis=0).round(9)
                labels = np.array([int(np.argmin([((v - x[c]) ** 2).sum() for c in first])) for v in x])
                cost, reps, far = _described(x, _lloyd(x, labels, k, 50))
                fits.append((cost, r, reps, far))
            cost, _, reps, far = min(fits, key=lambda f: (round(f[0], 9), f[1]))
            best = (cost, reps, far)
        if best[2].max() <= limit:
            break
    return {names[i]: names[j] for i, j in enumerate(best[1])}


@pytest.mark.parametrize("iterate", ["cluster", "insert"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_a_plain_loop(spark, iterate, seed):
    from gridmeter.operators.periods import SPREAD, cluster_periods

    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.6, (9, 5)) for c in (0.0, 2.0, 5.0, 9.0)])
    names = [3 * i + 2 for i in range(len(x))]
    feats = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "Period_Index int, features array<double>")
    threshold = 0.15
    limit = (threshold * SPREAD["S"]) ** 2 * 5
    got = cluster_periods(feats, k_min=2, k_max=9, threshold=threshold, repeats=7, seed=seed, iterate=iterate).collect()
    expected = _brute_map(x, names, 2, 9, limit, 7, seed, iterate == "insert")
    assert {r.Period_Index: r.Rep_Period for r in got} == expected


def test_many_restarts_on_wide_vectors_are_quick(spark):
    """250 restarts of 12 numbers of clusters on a year of days, 6,048 features each."""
    import time

    from gridmeter.operators.periods import cluster_periods

    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 6048))
    x = base[rng.integers(0, 9, 365)] + rng.normal(size=(365, 6048))
    feats = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "Period_Index int, features array<double>").checkpoint()
    began = time.time()
    m = cluster_periods(feats, k_min=4, k_max=15, threshold=0.1, repeats=250, seed=1).collect()
    assert len(m) == 365 and time.time() - began < 60
    assert len({r.Rep_Period for r in m}) == 15


def test_pair_distances_of_blocks(spark):
    from gridmeter.operators.periods import pair_distances

    x = np.random.default_rng(3).normal(1e4, 1.0, (11, 70))
    feats = spark.createDataFrame([(50 - i, v.tolist()) for i, v in enumerate(x)], "Period_Index long, features array<double>")
    order, d = pair_distances(feats, block=16)
    assert order == sorted(order)
    y = x[::-1]
    np.testing.assert_allclose(d, ((y[:, None] - y[None]) ** 2).sum(axis=2), rtol=1e-10, atol=1e-9)


def test_settlement_by_resource_and_zone(spark):
    from gridmeter.operators.settlement import cost_components, net_revenue

    gens = spark.createDataFrame([("g", "1", 10.0, 0.0, 1.0, 0.0, 2.0, 0.0), ("g", "2", 20.0, 0.0, 1.0, 0.0, 2.0, 0.0)],
                                 "Resource string, Zone string, Inv_Cost_per_MWyr double, Inv_Cost_per_MWhyr double, "
                                 "Fixed_OM_Cost_per_MWyr double, Fixed_OM_Cost_per_MWhyr double, "
                                 "Var_OM_Cost_per_MWh double, Var_OM_Cost_per_MWh_In double")
    cap = spark.createDataFrame([("g", "1", 1.0, 3.0, 0.0, 0.0), ("g", "2", 2.0, 5.0, 0.0, 0.0)],
                                "Resource string, Zone string, NewCap double, EndCap double, NewEnergyCap double, EndEnergyCap double")
    energy = spark.createDataFrame([("g", "1", 100.0), ("g", "2", 10.0)], "Resource string, Zone string, AnnualSum double")
    rev = spark.createDataFrame([("g", "1", 1000.0)], "Resource string, Zone string, AnnualSum double")
    comps = cost_components(gens, cap, energy, key=["Resource", "Zone"])
    out = {r.Zone: r for r in net_revenue(comps, {"EnergyRevenue": rev}, key=["Resource", "Zone"]).collect()}
    assert out["1"].Cost == 10.0 + 3.0 + 200.0 and out["1"].Profit == 1000.0 - 213.0
    assert out["2"].Cost == 40.0 + 5.0 + 20.0 and out["2"].Revenue == 0.0


def test_settle_uses_the_zone_price(spark):
    from gridmeter.operators.settlement import settle

    values = spark.createDataFrame([(1, "a", "1", 10.0), (1, "b", "2", 10.0)], "Time_Index long, Resource string, Zone string, value double")
    prices = spark.createDataFrame([(1, "1", 5.0), (1, "2", 50.0)], "Time_Index long, Zone string, price double")
    weights = spark.createDataFrame([(1, 1.0)], "Time_Index long, weight double")
    out = {r.Resource: r.AnnualSum for r in settle(values, prices, weights).collect()}
    assert out == {"a": 50.0, "b": 500.0}
    with pytest.raises(Exception, match="several rows"):  # when the query runs: building it starts no job
        settle(values, prices.drop("Zone"), weights).collect()
    with pytest.raises(ValueError, match="keyed by"):
        settle(values.drop("Zone"), prices, weights)


def test_settlement_keeps_generators_without_capacity_and_unpriced_steps(spark):
    from gridmeter.operators.settlement import cost_components, settle, step_table, unmatched_steps

    gens = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                 "Resource string, Inv_Cost_per_MWyr double, Inv_Cost_per_MWhyr double, Fixed_OM_Cost_per_MWyr double, "
                                 "Fixed_OM_Cost_per_MWhyr double, Var_OM_Cost_per_MWh double, Var_OM_Cost_per_MWh_In double")
    cap = spark.createDataFrame([("a", 2.0, 3.0, None, None)], "Resource string, NewCap double, EndCap double, NewEnergyCap double, EndEnergyCap double")
    energy = spark.createDataFrame([("a", 7.0)], "Resource string, AnnualSum double")
    out = {r.Resource: r for r in cost_components(gens, cap, energy).collect()}
    assert out["a"].Inv_cost_MWh == 0.0 and out["a"].Fixed_OM_cost_MW == 3.0 and not out["a"].no_capacity
    assert out["b"].no_capacity and out["b"].Inv_cost_MW == 0.0
    values = spark.createDataFrame([(1, "a", 10.0), (2, "a", 10.0)], "Time_Index long, Resource string, value double")
    prices = spark.createDataFrame([(1, 5.0)], "Time_Index long, price double")
    weights = spark.createDataFrame([(1, 1.0), (2, 1.0)], "Time_Index long, weight double")
    assert settle(values, prices, weights).first().AnnualSum == 50.0
    assert unmatched_steps(step_table(values, [prices], weights), ["price", "weight"], ["Resource"]).first().asDict() == {"Resource": "a", "no_price": 1, "no_weight": 0}


def test_cluster_periods_counts_extremes_and_survives_only_extremes(spark):
    from gridmeter.operators.periods import cluster_periods

    feats = spark.createDataFrame([(p, [float(p % 5), float(p)]) for p in range(1, 11)], "Period_Index int, features array<double>")
    ext = spark.createDataFrame([(2,), (9,), (10,)], "Period_Index int")
    m = cluster_periods(feats, k_min=4, k_max=5, extremes=ext, repeats=2).toPandas()
    assert len(m) == 10 and m.Rep_Period.nunique() == 5
    assert {2, 9, 10} <= set(m[m.Period_Index == m.Rep_Period].Period_Index)
    every = cluster_periods(feats, k_min=1, k_max=3, extremes=feats.select("Period_Index")).toPandas()
    assert (every.Period_Index == every.Rep_Period).all() and sorted(every.Rep_Period_Index) == list(range(1, 11))


def test_period_features_fill_gaps_and_load_weight(spark):
    from gridmeter.operators.periods import period_features, scale_features

    df = spark.createDataFrame([(1, "a", 1.0), (3, "a", 2.0), (4, "b", 5.0)], "i long, p string, v double")
    out = {r.Period_Index: r.features for r in period_features(df, "i", "p", "v", 2, ["a", "b"]).collect()}
    assert out == {1: [1.0, 0.0, 0.0, 0.0], 2: [2.0, 0.0, 0.0, 5.0]}
    s = scale_features(df.where("p = 'a'"), "v", ["p"], method="N", weights={"a": 3.0})
    assert sorted(r.scaled for r in s.collect()) == [0.0, 3.0]
