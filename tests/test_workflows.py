"""The load-assembly and distributed-solar workflows on small re-created files."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from gridmeter.plans.analysis import SERVICE_AREA_RATIO, UTILITY_ANNUAL_SALES_MWH
from gridmeter.plans.workflows import dg_reports, net_load_from_files, profile_to_grid, read_dg_sites


def _w(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


@pytest.fixture(scope="module")
def tmp():
    return tempfile.mkdtemp(prefix="gm-wf-")


def test_profile_to_grid_matches_pandas(spark, tmp):
    rows = [(dt.datetime(2022, 1, 1) + dt.timedelta(minutes=15 * i), float(i * i), float(10 - i)) for i in range(8)]
    text = "Datetime,Weekday,Weekend\n" + "".join(
        f"{t.month}/{t.day}/{t.strftime('%y')} {t.hour}:{t.minute:02d},{a},{b}\n" for t, a, b in rows)
    got = profile_to_grid(spark, _w(tmp, "ev15.csv", text)).toPandas().set_index("Datetime")
    exp = pd.DataFrame({"Weekday": [r[1] for r in rows], "Weekend": [r[2] for r in rows]},
                       index=pd.DatetimeIndex([r[0] for r in rows])).resample("5min").interpolate()
    assert list(got.index) == list(exp.index)
    assert np.allclose(got[["Weekday", "Weekend"]].to_numpy(), exp.to_numpy())


def test_net_load_from_files(spark, tmp):
    # Sunday 2022-01-02 and Monday 2022-01-03, two 5-minute steps each; one 2021 row is filtered out
    load = _w(tmp, "load.csv", "Datetime,Load (MW)\n12/31/21 23:55,999\n1/2/22 0:00,100\n1/2/22 0:05,110\n"
                               "1/3/22 0:00,120\n1/3/22 0:05,130\n")
    dg = _w(tmp, "dg.csv", "Datetime,Gen\n1/2/22 0:00,5\n1/3/22 0:05,7\n")
    ev = _w(tmp, "ev.csv", "Time,Weekday,Weekend\n1/1/22 0:00,1000,2000\n1/1/22 0:05,3000,4000\n")
    out = {r.Datetime: r for r in net_load_from_files(spark, load, dg, ev, year=2022).collect()}
    ratio = (460 / 12.0) / UTILITY_ANNUAL_SALES_MWH
    sun0, mon5 = out[dt.datetime(2022, 1, 2, 0, 0)], out[dt.datetime(2022, 1, 3, 0, 5)]
    assert sun0.Gen == 5.0 and sun0.EV_load == pytest.approx(ratio * 2000 / 1000)  # weekend profile
    assert mon5.net_load == pytest.approx(130 + ratio * 3000 / 1000)  # weekday profile
    assert len(out) == 4 and out[dt.datetime(2022, 1, 2, 0, 5)].Gen is None


def test_dg_reports(spark, tmp):
    text = (
        "App Approved Date,Technology Type,Azimuth,Tilt,System Size AC\n"
        "2012-06-01,Solar,180,20,999\n"          # before the cut-off
        "2016-01-01,Solar,135,20,10\n"           # East (boundary)
        "2016-01-01,Solar,135.01,50,20\n"        # South, same date: file order breaks the tie
        "2017-06-01,Wind,200,10,500\n"           # not solar
        "2018-03-01,Solar,225,30,30\n"           # South (boundary)
        "2019-03-01,Solar,225.01,10,40\n"        # West
        "2020-03-01,Solar,N/A,15,50\n"           # unparseable -> South
        "2021-03-01,Solar,,15,60\n"              # missing -> South
        "2022-03-01,Solar,90,15,70\n"            # East
    )
    sites = read_dg_sites(spark, _w(tmp, "sites.csv", text))
    out = dg_reports(sites)
    summ = {r.Orientation: r.area_MW_ac for r in out["orientation_summary"].collect()}
    k = SERVICE_AREA_RATIO / 1000
    assert summ["East"] == pytest.approx(k * 80) and summ["South"] == pytest.approx(k * 160)
    assert summ["West"] == pytest.approx(k * 40)
    tot = out["cumulative_total"].orderBy("capacity_mw").collect()
    assert [round(r.capacity_mw / k) for r in tot] == [10, 30, 60, 100, 150, 210, 280]
    proj = {(r.Orientation, str(r.date)): r for r in out["projection"].collect()}
    assert len(proj) == 6
    # South has three approvals after 2017 (a line); East and West one each (no line, like R's NA)
    assert proj[("South", "2025-01-01")].label.endswith(" MW") and proj[("South", "2018-01-01")].label is None
    assert proj[("East", "2025-01-01")].capacity_mw is None and proj[("East", "2025-01-01")].label is None
    assert out["tilt_density"].count() == 512


def test_hydro_and_fleet(spark, tmp):
    from gridmeter.plans.workflows import fleet_from_site_files, hydro_variability_from_file

    h = _w(tmp, "hydro.csv", "Datetime,0:00,0:05\n12/31/21 0:00,9,9\n1/1/22 0:00,1,2\n1/2/22 0:00,3,4\n")
    got = sorted((r.Datetime.day, r.Hour, r.gen) for r in hydro_variability_from_file(spark, h, 2022).collect())
    assert got == [(1, "0:00", 1.0), (1, "0:05", 2.0), (2, "0:00", 3.0), (2, "0:05", 4.0)]
    os.makedirs(os.path.join(tmp, "sites"), exist_ok=True)
    for site, base in (("a", 1.0), ("b", 10.0)):
        _w(tmp, f"sites/{site}.csv", "Source,Location ID\nNSRDB,1\n"
           + "".join(f"2022,1,1,0,{m},{base + m}\n" for m in (0, 30)))
    _w(tmp, "sites/c.csv", "Source,Location ID\nNSRDB,1\n2022,1,1,0,30,100\n")
    f = {r.Datetime.minute: (r.total, r.sites) for r in fleet_from_site_files(spark, os.path.join(tmp, "sites", "*.csv")).collect()}
    assert f == {0: (1.0 + 10.0, 2), 30: (31.0 + 40.0 + 100.0, 3)}
