import datetime as dt
import random

import numpy as np
import pandas as pd

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmeter.operators.windows import cumsum, index_from_label, neighbours, offset_from_first, sliced


def _fixture(n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot group holding well over a third of the rows; many equal dates
        g = "hot" if rnd.random() < 0.45 else rnd.choice(["a", "b", "c", None])
        d = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 40))
        v = None if rnd.random() < 0.03 else rnd.randint(-50, 500)
        rows.append((i, g, d, v))
    return rows


def test_cumsum_grouped_matches_pandas_with_hot_group(spark):
    rows = _fixture()
    df = spark.createDataFrame(rows, "id long, g string, d date, v long")
    got = cumsum(df, "v", order=["d", "id"], by=["g"], out="c", partitions=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "g", "d", "v"]).sort_values(["d", "id"])
    pdf["exp"] = pdf.assign(v=pdf.v.fillna(0)).groupby(pdf.g.fillna("<null>"), sort=False)["v"].cumsum()
    m = got.merge(pdf[["id", "exp"]], on="id")
    assert len(m) == len(rows)
    assert (m["c"].astype("int64") == m["exp"].astype("int64")).all()


def test_cumsum_global_double(spark):
    rows = [(i, float(i % 7) * 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = cumsum(df, "v", order=["id"], out="c", partitions=5).orderBy("id").toPandas()
    assert np.allclose(got["c"].to_numpy(), np.cumsum([r[1] for r in rows]))
    # property: the running sum ends at the total
    assert abs(got["c"].iloc[-1] - sum(r[1] for r in rows)) < 1e-9


def test_cumsum_plan_windows_only_the_offsets(spark):
    df = spark.createDataFrame(_fixture(300), "id long, g string, d date, v long")
    plan = cumsum(df, "v", order=["d", "id"], by=["g"], partitions=4)._jdf.queryExecution().executedPlan().toString()
    # the rows are never windowed by group: the only window runs over the
    # per-task totals, and their offsets reach the rows by broadcast
    assert plan.count("Window") >= 1
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_offset_from_first(spark):
    ts = [dt.datetime(2022, 1, 1, 0, 0) + dt.timedelta(minutes=5 * i) for i in range(5)]
    df = spark.createDataFrame([(t, "x" if i < 3 else "y") for i, t in enumerate(ts)], "t timestamp_ntz, k string")
    out = offset_from_first(df, "t", out="m").orderBy("t").collect()
    assert [r.m for r in out] == [0, 5, 10, 15, 20]
    outg = offset_from_first(df, "t", by=["k"], out="m").orderBy("t").collect()
    assert [r.m for r in outg] == [0, 5, 10, 0, 5]


def test_index_from_label_shuffled_metadata(spark):
    df = spark.createDataFrame([("t10", 1.0), ("Zone", 9.0), ("t2", 2.0), ("AnnualSum", 3.0), ("t1", 4.0)], "l string, v double")
    got = sorted((r.Time_Index, r.v) for r in index_from_label(df, "l").collect())
    assert got == [(1, 4.0), (2, 2.0), (10, 1.0)]


def test_cumsum_carries_across_arrow_batches(spark):
    rows = _fixture(2500, seed=9)
    df = spark.createDataFrame(rows, "id long, g string, d date, v long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # many batches per task
    try:
        got = cumsum(df, "v", order=["d", "id"], by=["g"], out="c", partitions=3).toPandas()
        glob = cumsum(df, "v", order=["d", "id"], out="c", partitions=3).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pdf = pd.DataFrame(rows, columns=["id", "g", "d", "v"]).sort_values(["d", "id"])
    pdf["exp"] = pdf.assign(v=pdf.v.fillna(0)).groupby(pdf.g.fillna("<null>"), sort=False)["v"].cumsum()
    pdf["gexp"] = pdf.v.fillna(0).cumsum()
    m = got.merge(pdf[["id", "exp"]], on="id")
    assert (m["c"].astype("int64") == m["exp"].astype("int64")).all()
    mg = glob.merge(pdf[["id", "gexp"]], on="id")
    assert (mg["c"].astype("int64") == mg["gexp"].astype("int64")).all()


def test_cumsum_task_count_follows_aqe_initial_partitions(spark):
    from gridmeter.session import shuffle_partitions

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert shuffle_partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(key, "37")
    try:
        assert shuffle_partitions(spark) == 37
        rows = [(i, "g", i % 5) for i in range(500)]
        df = spark.createDataFrame(rows, "id long, g string, v long")
        out = cumsum(df, "v", ["id"], by=["g"], out="cs").toPandas().sort_values("id")
        assert out["cs"].tolist() == np.cumsum([r[2] for r in rows]).tolist()
    finally:
        spark.conf.unset(key)


def test_cumsum_keeps_wide_integers_and_decimals(spark):
    from decimal import Decimal

    big = 9007199254740993
    df = spark.createDataFrame([(1, big, big, Decimal("0.10")), (2, None, big, Decimal("0.20"))], "t int, v long, other long, d decimal(10,2)")
    out = {r.t: (r.s, r.other) for r in cumsum(df, "v", ["t"], out="s").collect()}
    assert out == {1: (big, big), 2: (big, big)}
    assert [r.s for r in cumsum(df, "d", ["t"], out="s").orderBy("t").collect()] == [Decimal("0.10"), Decimal("0.30")]


def test_attach_salted_gives_the_same_rows(spark):
    from gridmeter.operators.keys import attach

    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(30)], "i int, g string")
    means = df.groupBy("g").avg("i").withColumnRenamed("avg(i)", "m")
    one = sorted(map(tuple, attach(df, means, ["g"], ["m"]).collect()), key=str)
    assert len(one) == 30 and one == sorted(map(tuple, attach(df, means, ["g"], ["m"], broadcast_groups=0, salts=4).collect()), key=str)


def test_neighbours_equal_lag_and_lead_over_whole_groups(spark):
    rows = _fixture(2000)
    df = spark.createDataFrame(rows, "id long, g string, d date, v long")
    for by in ([], ["g"]):
        got = neighbours(sliced(df, [*by, "id"], 9), "id", ["id", "v"], by)
        w = Window.partitionBy(*by).orderBy("id")
        here = F.struct("id", "v")
        exp = df.select("id", F.lag(here).over(w).alias("b"), F.lead(here).over(w).alias("a"))
        j = got.join(exp, "id")
        assert j.count() == len(rows)
        assert j.where(~(F.col("_gm_before").eqNullSafe(F.col("b")) & F.col("_gm_after").eqNullSafe(F.col("a")))).isEmpty()


def test_neighbours_of_groups_that_start_and_end_at_slice_borders(spark):
    df = spark.createDataFrame([(g, i) for g in "abcdefg" for i in range(1 if g in "bf" else 5)], "g string, i long")
    got = neighbours(sliced(df, ["g", "i"], 30), "i", ["i"], ["g"]).collect()
    for r in got:
        last = 0 if r.g in "bf" else 4
        assert (r._gm_before and r._gm_before.i) == (r.i - 1 if r.i else None)
        assert (r._gm_after and r._gm_after.i) == (r.i + 1 if r.i < last else None)
