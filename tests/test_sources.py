import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from gridmeter.sources.csv import (
    mangle_names, read_by_position, read_csv_typed, read_side_by_side, read_skip_meta, read_time_indexed, write_csv,
)
from gridmeter.sources.generate import gen_range, literal_product
from gridmeter.sources.results import scan_json_template, scan_result_report, scan_run_tree, scan_solver_meta, scan_solver_wide


def _write(d, name, text, bom=False):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(text)
    return p


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="gm-src-")


def test_typed_csv_with_bom_and_null_spellings(spark, tmp):
    p = _write(tmp, "ev.csv", "Datetime,Load (MW),Zone\n1/2/22 0:05,4.47e6,1\n1/2/22 0:10,-,n/a\n1/2/22 0:15,-0.0,\n", bom=True)
    df = read_csv_typed(spark, p, {"Datetime": "timestamp", "Load (MW)": "double", "Zone": "int"}, ts_format="M/d/yy H:mm")
    rows = df.orderBy("Datetime").collect()
    assert df.columns == ["Datetime", "Load (MW)", "Zone"]  # BOM stripped
    assert rows[0]["Datetime"] == dt.datetime(2022, 1, 2, 0, 5) and rows[0]["Load (MW)"] == 4.47e6
    assert rows[1]["Load (MW)"] is None and rows[1]["Zone"] is None
    assert rows[2]["Load (MW)"] == 0.0 and rows[2]["Zone"] is None


def test_positional_and_mangled_names(spark, tmp):
    p = _write(tmp, "sites.csv", "PV Generator Name, Capacity (kW) ,Lat,Lon\nA,1000,32.7,-117.1\nB,2000,32.8,-116.9\n")
    df = read_by_position(spark, p, {1: ("capacity_kw", "int"), 2: ("lat", "double"), 0: ("name", "string")})
    assert df.columns == ["name", "capacity_kw", "lat"]
    assert [r.capacity_kw for r in df.orderBy("name").collect()] == [1000, 2000]
    raw = spark.read.option("header", True).csv(p)
    assert mangle_names(raw).columns == ["PV.Generator.Name", "Capacity..kW.", "Lat", "Lon"]


def test_side_by_side_blocks(spark, tmp):
    p = _write(tmp, "ev.csv", "Time,home,total,,Time,home,total\n0:00,1,3,,0:00,2,5\n0:15,4,6,,0:15,7,9\n")
    df = read_side_by_side(spark, p, [
        ("Weekday", {0: ("Time", "string"), 1: ("home", "double"), 2: ("total", "double")}),
        ("Weekend", {4: ("Time", "string"), 5: ("home", "double"), 6: ("total", "double")}),
    ], label="day")
    got = sorted((r.day, r.Time, r.total) for r in df.collect())
    assert got == [("Weekday", "0:00", 3.0), ("Weekday", "0:15", 6.0), ("Weekend", "0:00", 5.0), ("Weekend", "0:15", 9.0)]


def test_skip_meta_weather_files(spark, tmp):
    for site in ["s1", "s2"]:
        _write(tmp, f"w/{site}.csv", "Source,Location ID\nNSRDB,123\n2012,1,1,0,0,5.5\n2012,1,1,0,30,6.0\n")
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ["year", "month", "day", "hour", "minute"]]
                          + [T.StructField("ghi", T.DoubleType())])
    df = read_skip_meta(spark, os.path.join(tmp, "w", "*.csv"), schema)
    assert df.count() == 4 and sorted({r.site for r in df.collect()}) == ["s1", "s2"]


def test_solver_wide_labels_not_positions(spark, tmp):
    # 2 metadata rows in charge, 0 in prices, labels out of order
    _write(tmp, "sim1/Results_1/charge.csv", "Resource,battery,phs,Total\nZone,1,1,0\nAnnualSum,3,4,7\nt2,1,2,3\nt1,2,2,4\nt10,0,0,0\n")
    _write(tmp, "sim1/Results_2/charge.csv", "Resource,battery,phs,Total\nZone,1,1,0\nAnnualSum,1,1,2\nt1,1,1,2\n")
    one = scan_solver_wide(spark, os.path.join(tmp, "sim1/Results_1/charge.csv"), name="Resource")
    got = sorted((r.Time_Index, r.Resource, r.value) for r in one.collect())
    assert got[:3] == [(1, "Total", 4.0), (1, "battery", 2.0), (1, "phs", 2.0)]
    assert {r.Time_Index for r in one.collect()} == {1, 2, 10}
    tree = scan_run_tree(spark, tmp, "charge.csv", name="Resource")
    assert sorted({(r.sim, r.run) for r in tree.collect()}) == [("sim1", "Results_1"), ("sim1", "Results_2")]
    meta = {r.name: r.value for r in scan_solver_meta(spark, os.path.join(tmp, "sim1/Results_1/charge.csv"), "AnnualSum").collect()}
    assert meta == {"battery": "3", "phs": "4", "Total": "7"}


def test_result_report_nulls(spark, tmp):
    p = _write(tmp, "costs.csv", "Costs,Total,Zone1\ncTotal,4.476431487162121e6,-\ncFix,1.0,n/a\n")
    rows = {r.Costs: r for r in scan_result_report(spark, p).collect()}
    assert rows["cTotal"].Total == pytest.approx(4476431.487162121) and rows["cTotal"].Zone1 is None


def test_json_template_and_generators(spark, tmp):
    p = _write(tmp, "t.json", json.dumps({"number_inputs": 3, "speeds": [1, 2, 3], "power": [0, 5, 9],
                                          "dist": [[1, 2], [3, 4]], "cap": 139500}))
    t = scan_json_template(spark, p)
    assert "number_inputs" not in t.columns and t.first().cap == 139500
    from gridmeter.operators.reshape import matrix_to_rows

    rows = matrix_to_rows(t.select("speeds", "power"), ["speeds", "power"]).collect()
    assert [(r.pos, r.speeds, r.power) for r in rows] == [(0, 1, 0), (1, 2, 5), (2, 3, 9)]
    assert gen_range(spark, 0, 105120, constants={"None": 0.0}).count() == 105121
    lp = literal_product(spark, date=["2018-01-01", "2025-01-01"], orientation=["East", "South", "West"])
    assert lp.count() == 6


def test_write_csv_roundtrip(spark, tmp):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "Time_Index long, v double")
    out = os.path.join(tmp, "out")
    write_csv(df, out, single_file=True)
    back = read_csv_typed(spark, out, {"Time_Index": "long", "v": "double"})
    assert sorted((r.Time_Index, r.v) for r in back.collect()) == [(1, 2.5), (2, None)]


def test_time_indexed_and_row_total(spark, tmp):
    from gridmeter.operators.reshape import row_total

    p = _write(tmp, "dg.csv", "Datetime,Gen,Other\n1/1/22 0:00,1.5,2\n1/1/22 0:30,,3\n")
    df = read_time_indexed(spark, p, "Datetime", "M/d/yy H:mm")
    assert df.columns == ["Datetime", "Gen", "Other"]
    tot = sorted((r.Datetime, r.total) for r in row_total(df, ["Gen", "Other"]).collect())
    assert tot == [(dt.datetime(2022, 1, 1, 0, 0), 3.5), (dt.datetime(2022, 1, 1, 0, 30), 3.0)]


def test_run_tree_as_partitioned_parquet_prunes_runs(spark, tmp):
    from gridmeter.sources.csv import write_parquet

    _write(tmp, "simA/Results_1/charge.csv", "Resource,battery\nZone,1\nt1,1\nt2,2\n")
    _write(tmp, "simA/Results_2/charge.csv", "Resource,battery\nZone,1\nt1,5\n")
    long = scan_run_tree(spark, tmp, "charge.csv", name="Resource")
    out = os.path.join(tmp, "charge_pq")
    write_parquet(long, out, partition_by=["sim", "run"])
    back = spark.read.parquet(out).where("run = 'Results_2'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    assert [(r.Time_Index, r.value) for r in back.collect()] == [(1, 5.0)]


def test_duplicate_and_unnamed_headers(spark, tmp):
    p = _write(tmp, "gen.csv", ",Resource,LDS,Zone,LDS\n0,battery,1,1,0\n1,solar,0,1,0\n")
    df = read_csv_typed(spark, p, {"Zone": "int"})
    # Spark suffixes repeated names with their position and names an empty header _c0
    assert df.columns == ["_c0", "Resource", "LDS2", "Zone", "LDS4"]
    assert [r.Zone for r in df.collect()] == [1, 1]


def test_run_tree_with_unequal_headers_and_spaces(spark, tmp):
    _write(tmp, "sim 1 - a/Results_1/power.csv", "Resource,wind,solar,Total\nZone,1,1,0\nt1,5,6,11\nt2,7,8,15\n")
    _write(tmp, "sim+2/Results_1/power.csv", "Resource,geo,wind,solar,Total\nZone,1,1,1,0\nt1,5,11,21,37\n")
    df = scan_run_tree(spark, tmp, "power.csv")
    got = {(r.sim, r.Time_Index, r.name): r.value for r in df.collect()}
    assert got == {
        ("sim 1 - a", 1, "wind"): 5.0, ("sim 1 - a", 1, "solar"): 6.0, ("sim 1 - a", 1, "Total"): 11.0,
        ("sim 1 - a", 2, "wind"): 7.0, ("sim 1 - a", 2, "solar"): 8.0, ("sim 1 - a", 2, "Total"): 15.0,
        ("sim+2", 1, "geo"): 5.0, ("sim+2", 1, "wind"): 11.0, ("sim+2", 1, "solar"): 21.0, ("sim+2", 1, "Total"): 37.0,
    }


def test_names_like_base_r(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["2022 load", "a b", "a.b", ".5x"])
    assert mangle_names(df).columns == ["X2022.load", "a.b", "a.b.1", "X.5x"]


def test_skip_meta_drops_numeric_metadata_and_decodes_site(spark, tmp):
    _write(tmp, "m/site one.csv", "Source,Location ID\n123456,32.7\n2012,5.5\n2012,6.0\n")
    schema = T.StructType([T.StructField("Year", T.IntegerType()), T.StructField("ghi", T.DoubleType())])
    rows = read_skip_meta(spark, tmp + "/m/*.csv", schema).collect()
    assert sorted((r.Year, r.ghi, r.site) for r in rows) == [(2012, 5.5, "site one"), (2012, 6.0, "site one")]
