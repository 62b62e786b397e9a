"""Whitening against numpy on whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from gridmeter.llm.whitening import op12_whitening, quantised, whiten


def brute(x, weights, most=16):
    """Distinct vectors, their weights, and the whitened components, up to sign."""
    x, w = np.array(x, float), np.array(weights, float)
    a = x - (x * w[:, None]).sum(0) / w.sum()
    v = (a * w[:, None]).T @ a / w.sum()
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    return a @ c / np.sqrt(e), e / np.trace(v)


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    usable = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    distinct = sorted(set(usable.values()))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    y, shares = brute(distinct, [1] * n)
    at = {x: k for k, x in enumerate(distinct)}
    got = op12_whitening(spark, SF).collect()
    assert len(got) == 16 * len(usable)
    sign = {}
    for r in got:
        k, x = at[usable[r.vec_id]], usable[r.vec_id]
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        expected = y[k, r.component - 1]
        if abs(expected) > 1e-6:
            sign.setdefault(r.component, np.sign(expected * r.whitened))
        assert abs(r.whitened * sign.get(r.component, 1) - expected) < 1e-8
        assert abs(r.explained - shares[r.component - 1]) < 1e-10 and r.identity_error < 1e-9
    assert {r.component for r in got} == set(range(1, 17))


@pytest.mark.parametrize("weights", ["one", "count"])
def test_repeated_vectors(spark, weights):
    r = np.random.default_rng(3)
    vectors = r.integers(-50, 50, (40, 5)).tolist()
    rows = [(i, vectors[i % 40] if i < 100 else vectors[7]) for i in range(150)] + [(None, vectors[0]), (None, None), (5, [1, None, 2, 3, 4]), (5, vectors[1]), (5, vectors[1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("deviation", F.lit(1)).withColumn("_key", F.lit(1))
    out, fit = whiten(df, df["v"], weights=weights, most=3)
    usable = [(i, tuple(v)) for i, v in rows if v is not None and None not in v]
    distinct = sorted(set(v for _, v in usable))
    count = [sum(v == d for _, v in usable) for d in distinct]
    y, shares = brute(distinct, count if weights == "count" else [1] * len(distinct), 3)
    got = out.collect()
    assert len(got) == len(usable) and fit.n == (len(usable) if weights == "count" else len(distinct))
    np.testing.assert_allclose(fit.explained, shares, rtol=1e-12)
    assert fit.identity_error < 1e-12
    values = lambda rows: sorted((i, *np.round(np.abs(v), 9)) for i, v in rows)
    at = {d: k for k, d in enumerate(distinct)}
    assert values((x.vec_id or -1, x.whitened) for x in got) == values((i or -1, y[at[v]]) for i, v in usable)


def test_exact_where_64_bits_and_floats_are_not_enough(spark):
    big = 1 << 40
    rows = [(0, [big, 3]), (1, [big + 1, 5]), (2, [big + 3, -4])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    out, fit = whiten(df, df["v"])
    assert fit.sums == [3 * big + 4, 4]
    assert {r.vec_id: r.deviation for r in out.collect()} == {0: 16 + 25, 1: 1 + 121, 2: 25 + 256}
    assert fit.identity_error < 1e-12


def test_flat_directions_and_few_rows(spark):
    df = spark.createDataFrame([(i, [i, 2 * i, 7]) for i in range(5)], "vec_id long, v array<long>")
    out, fit = whiten(df, df["v"])
    assert fit.explained[0] == pytest.approx(1.0) and fit.explained[1:] == [0.0, 0.0] and fit.identity_error < 1e-12
    assert all(r.whitened[1] is None and r.whitened[2] is None for r in out.collect())
    one = df.where("vec_id = 1")
    out, fit = whiten(one, one["v"])
    assert [tuple(r) for r in out.collect()] == [(1, 0, [None] * 3)] and fit.explained == [None] * 3 and fit.identity_error is None


def test_empty_and_unequal(spark):
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    out, fit = whiten(none, none["v"])
    assert out.count() == 0 and out.columns == ["vec_id", "deviation", "whitened"] and fit.n == 0
    bare = spark.createDataFrame([(1, []), (2, None)], "vec_id long, v array<long>")
    assert [tuple(r) for r in whiten(bare, bare["v"])[0].collect()] == [(1, 0, [])]
    mixed = spark.createDataFrame([(1, [1]), (2, [1, 2])], "vec_id long, v array<long>")
    with pytest.raises(ValueError):
        whiten(mixed, mixed["v"])


def test_unusable_rows_and_empty_table_in_the_query(spark, tmp_path):
    rows = [(1, [0.5, float("nan")]), (2, None), (3, [0.5, None]), (4, [float("inf"), 0.0]), (5, [-0.001, 0.02]), (6, [0.5, -0.5]), (None, [0.5, -0.5])]
    for name, part in (("a", rows), ("b", [])):
        spark.createDataFrame(part, "vec_id long, embedding array<float>").withColumn("n", F.lit(0)).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    got = op12_whitening(spark, f"{tmp_path}/a").collect()
    assert sorted({r.vec_id or 0 for r in got}) == [0, 5, 6] and len(got) == 6 and {r.n for r in got} == {2}
    assert op12_whitening(spark, f"{tmp_path}/b").collect() == []
    x = spark.createDataFrame([([-0.001, 0.02],)], "v array<float>").select(quantised(F.col("v"))).first()[0]
    assert x == [999_999, 1_000_001]
