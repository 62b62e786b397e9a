"""Curves held in a table, ordered categories of any number, files in order, unequal files."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeter.operators.aggregates import order_levels, ranks_of
from gridmeter.operators.curves import curve_lookup
from gridmeter.operators.keys import attach
from gridmeter.sources.csv import read_ordered_csv, write_csv, write_ordered_csv
from gridmeter.sources.results import scan_run_tree, scan_solver_wide, scan_templates


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
@pytest.mark.parametrize("width", [0.7, 5.0])
def test_curve_lookup_equals_interpolation(spark, broadcast_rows, width):
    rng = np.random.default_rng(2)
    curves = {t: sorted(zip(np.round(rng.choice(400, n, replace=False) / 10 - 5, 1).tolist(), rng.normal(size=n).tolist())) for t, n in (("a", 9), ("b", 1), (None, 4), ("hot", 30))}
    knots = [(t, x, y) for t, c in curves.items() for x, y in c]
    types = ["a", "b", None, "hot", "hot", "hot", "unknown"]
    rows = [(i, types[i % 7], None if i % 31 == 0 else (knots[i % len(knots)][1] if i % 5 == 0 else float(rng.uniform(-8, 45)))) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, type string, v double")
    table = spark.createDataFrame(knots, "type string, speed double, kw double")
    got = {r.id: r.kw for r in curve_lookup(df, table, ["type"], "v", width=width, broadcast_rows=broadcast_rows, share=4).collect()}
    assert len(got) == len(rows)
    for i, t, v in rows:
        c = curves.get(t) if t != "unknown" else None
        if c is None or v is None:
            assert got[i] is None
        else:
            xs, ys = zip(*c)
            exp = float(np.interp(v, xs, ys)) if xs[0] <= v <= xs[-1] else 0.0
            assert got[i] == pytest.approx(exp, abs=1e-9)


def test_many_pieces_are_not_broadcast_by_a_guess(spark):
    """Exploded rows aren't in Spark's guess of a size: joins with more pieces or
    types than ``broadcast_rows`` must not depend on it."""
    parts = spark.range(2000).select(F.col("id").alias("type"), F.array(*[F.lit(float(x)) for x in range(30)]).alias("x"))
    table = parts.select("type", F.posexplode("x").alias("kw", "speed"))
    df = spark.range(4000).select((F.col("id") % 2100).alias("type"), (F.col("id") % 35).cast("double").alias("v"))
    out = curve_lookup(df, table, ["type"], "v", broadcast_rows=1000, share=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # known types and pieces; broadcast are only the hot types and what belongs to them
    assert sum("SortMergeJoin" in line and "LeftOuter" in line for line in plan.splitlines()) == 2
    got = out.collect()
    assert len(got) == 4000
    assert all(r.kw == (None if r.type >= 2000 else r.v if r.v <= 29 else 0.0) for r in got)
    big = attach(df, parts.select("type", F.lit(1).alias("one")), ["type"], ["one"], how="left", broadcast_groups=1000)
    assert "BroadcastHashJoin" not in big._jdf.queryExecution().executedPlan().toString() and big.where("one = 1").count() == df.where("type < 2000").count()


def test_order_levels_of_a_hundred_thousand_names(spark):
    names = [f"n{i:06d}" for i in range(100_000)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(names[7],), ("none",), (None,), (names[99_999],), (names[7],)], "name string")
    got = [(r.name, r.level) for r in order_levels(df, "name", names).collect()]
    assert sorted(got, key=str) == sorted([(names[7], 8), ("none", None), (None, None), (names[99_999], 100_000), (names[7], 8)], key=str)
    assert {r.level for r in order_levels(df, "name", names, reverse=True).collect()} == {99_993, 1, None}
    every = spark.createDataFrame([(n,) for n in names + names[:10]], "name string")
    ranked = order_levels(every, "name", ranks_of(every, "name"))
    assert ranked.count() == 100_010
    assert ranked.where(F.col("level") != F.substring("name", 2, 6).cast("int") + 1).isEmpty()


def test_ordered_files_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("t")).repartition(13)
    write_ordered_csv(df, path, ["k"], partitions=6)
    back = read_ordered_csv(spark, path, {"k": "long"})
    assert back.count() == 20_000 and back.where("k != row").isEmpty()
    m = spark.read.parquet(f"{path}/_manifest").orderBy("place").collect()
    assert len(m) == 6 and [r.start for r in m] == [sum(x.rows for x in m[:i]) for i in range(6)]
    # files cut into many splits, read in any order
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert read_ordered_csv(spark, path, {"k": "long"}).where("k != row").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = spark.read.option("header", True).csv(path)  # the folder is an ordinary CSV table
    assert plain.count() == 20_000
    os.remove(next(tmp_path.joinpath("out").glob("part-00002*.csv")))
    with pytest.raises(Exception, match="rows are missing"):
        read_ordered_csv(spark, path, {"k": "long"}).collect()


def test_ordered_empty_table(spark, tmp_path):
    write_ordered_csv(spark.range(0).select(F.col("id").alias("k")), str(tmp_path / "e"), ["k"])
    assert spark.read.parquet(f"{tmp_path}/e/_manifest").count() <= 1


def test_many_layouts_are_one_scan(spark, tmp_path):
    """600 files of 200 layouts; the plan doesn't grow with them."""
    r = random.Random(3)
    expected = {}
    for f in range(600):
        layout = random.Random(f % 200)
        names = [f"res {n}" for n in layout.sample(range(1000), layout.randint(1, 6))]
        folder = tmp_path / f"sim {f // 2}" / f"Results_{f % 2}"
        folder.mkdir(parents=True)
        lines = [",".join(["Resource", *names]), ",".join(["Zone", *["1"] * len(names)])]
        for t in (2, 1):
            values = [round(r.random(), 6) for _ in names]
            lines.append(",".join([f"t{t}", *map(str, values)]))
            expected |= {(f"sim {f // 2}", f"Results_{f % 2}", t, n): v for n, v in zip(names, values)}
        (folder / "power.csv").write_text("\n".join(lines) + "\n")
    df = scan_run_tree(spark, str(tmp_path), "power.csv")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") <= 2 and "Union" not in plan
    assert {(x.sim, x.run, x.Time_Index, x.name): x.value for x in df.collect()} == expected


def test_wide_files_with_quotes_bom_and_short_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Resource,"big, ""one""",b,,B\nZone,1,1,1,1\nt1,1.5,2\nt2,"3",-,5,6,7\nt3,x,1,2,3\n', encoding="utf-8")
    got = {(r.Time_Index, r.name): r.value for r in scan_solver_wide(spark, str(tmp_path / "a.csv")).collect()}
    big = 'big, "one"'
    assert got[(1, big)] == 1.5 and got[(1, "b2")] == 2.0 and got[(1, "_c3")] is None and got[(1, "B4")] is None
    assert got[(2, big)] == 3.0 and got[(2, "b2")] is None and got[(2, "_c3")] == 5.0 and got[(2, "B4")] == 6.0
    assert got[(3, big)] is None and len(got) == 12


def test_wide_file_of_many_splits(spark, tmp_path):
    lines = ["Resource,a,b"] + [f"t{i},{i},{-i}" for i in range(1, 3001)]
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = scan_solver_wide(spark, str(tmp_path / "w.csv"))
        assert got.count() == 6000 and got.where("abs(value) != Time_Index").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_templates_of_unequal_keys(spark, tmp_path):
    a = {"number_inputs": 3, "speeds": [1, 2.5], "dist": [[1, 2], [3], []], "cap": 139500, "name": "x", "none": None, "yes": True}
    b = {"speeds": 7, "deep": [[[1]]], "extra": ["p", "q"]}
    for n, o in (("a b", a), ("c+d", b)):
        (tmp_path / f"{n}.json").write_text(json.dumps(o))
    rows = scan_templates(spark, str(tmp_path / "*.json")).collect()
    got = {(os.path.basename(r.file), r.key, r.i, r.j): (r.number, r.text) for r in rows}
    assert got == {
        ("a b.json", "speeds", 0, None): (1.0, "1"), ("a b.json", "speeds", 1, None): (2.5, "2.5"),
        ("a b.json", "dist", 0, 0): (1.0, "1"), ("a b.json", "dist", 0, 1): (2.0, "2"), ("a b.json", "dist", 1, 0): (3.0, "3"),
        ("a b.json", "cap", None, None): (139500.0, "139500"), ("a b.json", "name", None, None): (None, "x"),
        ("a b.json", "none", None, None): (None, None), ("a b.json", "yes", None, None): (None, "true"),
        ("c+d.json", "speeds", None, None): (7.0, "7"), ("c+d.json", "deep", 0, 0): (None, "[1]"),
        ("c+d.json", "extra", 0, None): (None, "p"), ("c+d.json", "extra", 1, None): (None, "q"),
    }


def test_single_file_reports_still_write(spark, tmp_path):
    write_csv(spark.range(3).toDF("k"), str(tmp_path / "r"), single_file=True)
    assert len(list((tmp_path / "r").glob("part-*.csv"))) == 1
