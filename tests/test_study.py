"""A small planning-run case folder (shapes from FIXTURES.md) through the readers and reports."""

import os
import tempfile

import pytest

from gridmeter.functions.time import Grid
from gridmeter.plans.study import read_case, reports

N = 24  # two periods of 12 five-minute steps


def _w(d, name, text):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def case_dir():
    d = tempfile.mkdtemp(prefix="gm-case-")
    _w(d, "Load_data.csv", "Time_Index,Load_MW_z1\n" + "".join(f"{i},{100 + i}\n" for i in range(1, N + 1)))
    # both periods are represented by the second; results stand on the reduced index, 12 steps
    _w(d, "TDR_Results/Period_map.csv", "Period_Index,Rep_Period,Rep_Period_Index\n1,2,1\n2,2,1\n")
    R = 12
    _w(d, "Results/prices.csv", "Zone,1\n" + "".join(f"t{i},{0.5 + 0.01 * i}\n" for i in range(1, R + 1)))
    _w(d, "Results/ReserveMargin_w.csv", "Constraint,CapRes_1\n" + "".join(f"t{i},{10 if i == 5 else 0}\n" for i in range(1, R + 1)))
    head = "Resource,battery,solar,wind,Total\nZone,1,1,1,0\nAnnualSum,0,0,0,0\n"
    _w(d, "Results/power.csv", head + "".join(f"t{i},1,2,3,6\n" for i in range(R, 0, -1)))  # labels out of order
    _w(d, "Results/charge.csv", head + "".join(f"t{i},0.5,0,0,0.5\n" for i in range(1, R + 1)))
    _w(d, "Results/curtail.csv", head + "".join(f"t{i},0,0.2,0.1,0.3\n" for i in range(1, R + 1)))
    _w(d, "Results/storage.csv", "Resource,battery\nZone,1\n" + "".join(f"t{i},4\n" for i in range(1, R + 1)))
    _w(d, "Results/capacity.csv",
       "Resource,Zone,StartCap,RetCap,NewCap,EndCap,StartEnergyCap,RetEnergyCap,NewEnergyCap,EndEnergyCap\n"
       "battery,1,0,0,5,5,0,0,20,20\nsolar,1,0,0,10,10,0,0,0,0\nwind,1,0,0,0,0,0,0,0,0\nTotal,n/a,0,0,15,15,0,0,20,20\n")
    _w(d, "Results/NetRevenue.csv",
       "region,Resource,zone,Cluster,R_ID,Inv_cost_MW,Inv_cost_MWh,Fixed_OM_cost_MW,Fixed_OM_cost_MWh,Var_OM_cost_out,"
       "Var_OM_cost_in,Fuel_cost,Charge_cost,EnergyRevenue,ReserveMarginRevenue\n"
       "r,battery,1,1,1,1e6,2e6,0,0,0,0,5e6,3e6,7e6,2e6\nr,solar,1,1,2,4e6,0,1e6,0,0,0,0,0,6e6,-\n"
       "r,wind,1,1,3,0,0,0,0,0,0,0,0,0,0\n")
    return d


@pytest.fixture(scope="module")
def out(spark, case_dir):
    return reports(read_case(spark, case_dir), Grid(step_minutes=5, base="2025-07-01 00:00:00", steps_per_period=12))


def test_weekly_views(out):
    p = out["price_week"].orderBy("Time_Index").collect()
    assert len(p) == 12 and p[0].price == pytest.approx(12 * 0.51)
    assert str(p[0].clock) == "2025-07-01 01:00:00"  # the bin's rows under its representative's clock
    d = {(r.Time_Index, r.Resource): r.net for r in out["dispatch_week"].collect()}
    assert set(r for _, r in d) == {"battery", "solar"}  # wind has no built capacity (J6)
    assert d[(1, "battery")] == pytest.approx(0.5) and d[(12, "solar")] == 2.0
    soc = out["state_of_charge_week"].collect()
    assert len(soc) == 12 and soc[0].total_soc == pytest.approx(4 / 20)  # Total row excluded (D2)


def test_totals_and_costs(out):
    s = out["storage_energy_totals"].first()
    assert (s.total, s.battery, s.pumped_hydro) == (20.0, 20.0, None)
    # the reduced scarcity price holds in both periods
    assert out["scarcity_cost_total"].first().scarcity_cost == pytest.approx(10 * 105 + 10 * 117)
    c = {(r.Resource, r.Category): r.value_MM for r in out["cost_revenue_breakdown"].collect()}
    assert c[("battery", "Investment")] == pytest.approx(-3.0) and c[("battery", "Energy")] == pytest.approx(7.0)
    assert c[("battery", "RA")] == pytest.approx(2.0) and ("battery", "Fuel") not in c
    assert c[("solar", "RA")] is None  # '-' is a null, not a zero
    assert [(r.Resource, r.level) for r in out["installed_capacity"].collect()] == [("battery", 1), ("solar", 2)]
    assert {(r.Resource, r.Measure): r.MW for r in out["capacity_changes"].collect()}[("solar", "NewCap")] == 10.0
    assert [(r.Resource, r.EndEnergyCap) for r in out["energy_capacity"].collect()] == [("battery", 20.0)]
    assert not any(r == "wind" for r, _ in c)


def test_calendar_reports(out):
    cur = {(r.month, r.hour): r for r in out["curtailment_by_month_hour"].collect()}
    assert cur[(7, 0)].total == pytest.approx(0.3) and cur[(7, 1)].wind == pytest.approx(0.1)
    dps = {(r.month, r.hour): r for r in out["demand_price_summary"].collect()}
    assert dps[(7, 0)].demand == sum(100 + i for i in range(1, 13))
    assert dps[(7, 0)].price == pytest.approx(12 * sum(0.5 + 0.01 * i for i in range(1, 13)) / 12)
    j = out["july_scarcity"].where("price > 0").collect()
    assert sorted((r.day, r.time) for r in j) == [(1, "00:20:00"), (1, "01:20:00")]
    rp = {r.Time_Index: r for r in out["representative_periods"].collect()}
    assert set(rp) == {12, 24} and rp[12].Period_Index == 1 and not rp[12].Representative and rp[24].Representative
