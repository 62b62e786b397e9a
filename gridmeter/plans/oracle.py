"""DuckDB SQL for every registered query, over the same parquet tables.

Written independently of the Spark code from the query definitions; the
driver runs both and compares row count, schema and values.
"""

from __future__ import annotations

# Shared CTEs: 5-minute step number of every event and the derived series
# (same stand-in mapping as ``tables.py``).
_EV = """
ev AS (
  SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 300000000 + 1 AS Time_Index
  FROM events
),
load AS (SELECT Time_Index, sum(value) AS Load FROM ev GROUP BY Time_Index),
price AS (SELECT Time_Index, avg(value) AS price FROM ev WHERE event_type = 'purchase' GROUP BY Time_Index),
scar AS (SELECT Time_Index, sum(value) AS shdw FROM ev WHERE event_type = 'error' GROUP BY Time_Index),
res AS (SELECT Time_Index, event_type AS Resource, sum(value) AS value FROM ev GROUP BY Time_Index, event_type)
"""

_CLOCK = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(5 * (Time_Index - 1) AS BIGINT)))"

SQL: dict[str, str] = {}

SQL["demand_price_summary"] = f"""
WITH {_EV},
j AS (
  SELECT l.Time_Index, Load, price, shdw, {_CLOCK.replace('Time_Index', 'l.Time_Index')} AS clock
  FROM load l LEFT JOIN price p ON p.Time_Index = l.Time_Index LEFT JOIN scar s ON s.Time_Index = l.Time_Index
)
SELECT CAST(day(clock) AS INTEGER) AS day, CAST(hour(clock) AS INTEGER) AS hour,
       round(sum(Load), 4) AS demand, round(avg(price) * 12.0, 4) AS price, round(sum(shdw), 4) AS scarcity
FROM j GROUP BY 1, 2
"""

SQL["scarcity_cost_total"] = f"""
WITH {_EV}
SELECT round(sum(shdw * Load), 2) AS scarcity_cost
FROM load l LEFT JOIN scar s ON s.Time_Index = l.Time_Index
"""

SQL["july_scarcity"] = f"""
WITH {_EV},
j AS (SELECT l.Time_Index, shdw, {_CLOCK.replace('Time_Index', 'l.Time_Index')} AS clock
      FROM load l LEFT JOIN scar s ON s.Time_Index = l.Time_Index)
SELECT CAST(day(clock) AS INTEGER) AS day, strftime(clock, '%H:%M:%S') AS time, round(shdw, 4) AS price
FROM j WHERE month(clock) = 1
"""

SQL["curtailment_by_month_hour"] = f"""
WITH {_EV},
c AS (SELECT *, {_CLOCK} AS clock FROM res)
SELECT CAST(day(clock) AS INTEGER) AS day, CAST(hour(clock) AS INTEGER) AS hour,
       round(sum(value) * (1.0 / 12.0), 4) AS total,
       round(sum(value) FILTER (WHERE Resource IN ('click')) * (1.0 / 12.0), 4) AS wind,
       round(sum(value) FILTER (WHERE Resource IN ('view')) * (1.0 / 12.0), 4) AS solar
FROM c GROUP BY 1, 2
"""

# --- distributed solar stand-ins ------------------------------------------------
_SITES = """
sites AS (SELECT o_orderkey, o_orderstatus, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS size_cents
          FROM orders)
"""

SQL["cumsum_grouped"] = f"""
WITH {_SITES}
SELECT o_orderkey, o_orderstatus, o_orderdate,
       round(CAST(0.01924 AS DOUBLE) * CAST(sum(size_cents) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000.0, 6) AS capacity_mw
FROM sites
"""

SQL["cumsum_global"] = f"""
WITH {_SITES}
SELECT o_orderkey, o_orderdate,
       round(CAST(0.01924 AS DOUBLE) * CAST(sum(size_cents) OVER (ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000.0, 6) AS capacity_mw
FROM sites
"""

_DG_CUM = f"""
{_SITES},
cum AS (
  SELECT o_orderstatus, o_orderdate,
         CAST(0.01924 AS DOUBLE) * CAST(sum(size_cents) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000.0 AS capacity_mw
  FROM sites
),
coef AS (
  SELECT o_orderstatus,
         regr_slope(capacity_mw, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS slope,
         regr_intercept(capacity_mw, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS intercept,
         regr_count(capacity_mw, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS n
  FROM cum WHERE o_orderdate > DATE '1998-12-31' GROUP BY o_orderstatus
)
"""

SQL["grouped_linear_fit"] = f"""
WITH {_DG_CUM}
SELECT o_orderstatus, round(slope, 6) AS slope, round(intercept, 3) AS intercept, CAST(n AS BIGINT) AS n FROM coef
"""

SQL["predict_linear"] = f"""
WITH {_DG_CUM},
pts AS (
  SELECT o_orderstatus, d AS o_orderdate,
         intercept + slope * date_diff('day', DATE '1970-01-01', d) AS capacity_mw
  FROM coef, (VALUES (DATE '1999-01-01'), (DATE '2003-01-01')) v(d)
)
SELECT o_orderstatus, o_orderdate, round(capacity_mw, 3) AS capacity_mw,
       CASE WHEN o_orderdate = DATE '2003-01-01' THEN CAST(round(capacity_mw, 2) AS VARCHAR) || ' MW' END AS label
FROM pts
"""

SQL["orientation_summary"] = """
WITH c AS (SELECT c_acctbal / 20.0 AS azimuth, abs(c_acctbal) AS size_kw FROM customer)
SELECT CASE WHEN azimuth IS NULL OR isnan(azimuth) THEN 'South'
            WHEN azimuth > 225 THEN 'West' WHEN azimuth > 135 THEN 'South' ELSE 'East' END AS Orientation,
       round(CAST(0.01924 AS DOUBLE) * sum(size_kw) / 1000.0, 6) AS area_MW_ac
FROM c GROUP BY 1
"""

# --- interval profiles ----------------------------------------------------------
_HOURLY = """
h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2)
"""

SQL["interpolate_linear"] = f"""
WITH {_HOURLY},
s AS (SELECT event_type, ts, v, lead(ts) OVER w AS ts1, lead(v) OVER w AS v1
      FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
seg AS (SELECT *, date_diff('minute', ts, ts1) // 5 AS n FROM s WHERE ts1 IS NOT NULL),
k AS (SELECT event_type, ts, v, v1, n, unnest(range(0, n)) AS k FROM seg)
SELECT event_type, ts + to_minutes(CAST(5 * k AS BIGINT)) AS ts,
       floor((v + (v1 - v) * k / n) * 10000000.0 + 0.5) / 10000000.0 AS value FROM k
UNION ALL
SELECT event_type, ts, floor(v * 10000000.0 + 0.5) / 10000000.0 AS value FROM s WHERE ts1 IS NULL
"""

SQL["resample_grid"] = f"""
WITH {_HOURLY},
b AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 5 MINUTE)) AS ts FROM b)
SELECT g.event_type, g.ts, round(h.v, 4) AS value FROM g LEFT JOIN h ON h.event_type = g.event_type AND h.ts = g.ts
"""

SQL["net_load_5min"] = f"""
WITH {_EV},
ld AS (SELECT {_CLOCK} AS Datetime, Load FROM load),
dg AS (SELECT {_CLOCK} AS Datetime, sum(value) AS Gen FROM ev WHERE event_type = 'signup' GROUP BY Time_Index),
evs AS (SELECT {_CLOCK} AS clock, sum(value) AS e FROM ev WHERE event_type = 'click' GROUP BY Time_Index),
prof AS (SELECT CAST(hour(clock) * 60 + minute(clock) AS INTEGER) AS Time,
                dayofweek(clock) + 1 BETWEEN 2 AND 6 AS Weekday, avg(e) AS EV_load
         FROM evs GROUP BY 1, 2),
ly AS (SELECT * FROM ld WHERE Datetime >= TIMESTAMP '2024-01-01 00:00:00' AND Datetime < TIMESTAMP '2025-01-01 00:00:00'),
ratio AS (SELECT (sum(Load) / 12.0) / CAST(21300000 AS DOUBLE) AS r FROM ly),
j AS (
  SELECT ly.Datetime, ly.Load, dg.Gen, prof.EV_load
  FROM ly LEFT JOIN dg ON dg.Datetime = ly.Datetime
  JOIN prof ON prof.Time = CAST(hour(ly.Datetime) * 60 + minute(ly.Datetime) AS INTEGER)
           AND prof.Weekday = (dayofweek(ly.Datetime) + 1 BETWEEN 2 AND 6)
)
SELECT Datetime, round(Load, 4) AS Load, round(Gen, 4) AS Gen,
       round(r * EV_load / 1000.0, 10) AS EV_load, round(Load + r * EV_load / 1000.0, 6) AS net_load
FROM j, ratio
"""

SQL["fuels_table"] = f"""
WITH {_EV}
SELECT range AS Time_Index, CAST(0.0 AS DOUBLE) AS "None" FROM range(0, (SELECT max(Time_Index) FROM ev) + 1)
"""

SQL["assign_period"] = f"""
WITH {_EV}
SELECT event_id, Time_Index, (Time_Index - 1) // 288 + 1 AS Period_Index, (Time_Index - 1) // 288 + 1 AS Rep_Period,
       (Time_Index - 1) % 288 AS Step, {_CLOCK} AS clock
FROM ev
"""

SQL["slice_period"] = f"""
WITH {_EV}
SELECT Time_Index, round(Load, 4) AS Load FROM load WHERE Time_Index BETWEEN 577 AND 864
"""

SQL["filter_modulo"] = f"""
WITH {_EV}
SELECT Time_Index, round(Load, 4) AS Load FROM load WHERE Time_Index % 12 = 0
"""

# --- joins ----------------------------------------------------------------------
SQL["right_join_natural"] = """
WITH sup AS (SELECT s_nationkey AS n_nationkey, count(*) AS n_suppliers, sum(s_acctbal) AS acctbal
             FROM supplier GROUP BY 1)
SELECT n.n_nationkey, n.n_name, sup.n_suppliers, round(sup.acctbal, 2) AS acctbal
FROM sup RIGHT JOIN nation n ON n.n_nationkey = sup.n_nationkey
"""

SQL["semi_join_built"] = """
SELECT p_partkey, p_name, p_retailprice FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 0)
"""

SQL["left_join_suffix"] = f"""
WITH {_EV},
chg AS (SELECT Time_Index, event_type AS Resource, sum(value) AS value_c FROM ev WHERE value < 10.0 GROUP BY 1, 2)
SELECT r.Time_Index, r.Resource, round(r.value, 4) AS value, round(c.value_c, 4) AS value_c,
       round(r.value - coalesce(c.value_c, 0.0), 4) AS net
FROM res r LEFT JOIN chg c ON c.Time_Index = r.Time_Index AND c.Resource = r.Resource
"""

# --- reshape ----------------------------------------------------------------------
SQL["unpivot_all_but"] = """
SELECT l_orderkey, l_linenumber, name, value FROM (
  UNPIVOT (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity,
                  CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount,
                  CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)
"""

SQL["pivot_wider"] = """
WITH q AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, first(qty) FILTER (WHERE l_linestatus = 'F') AS "F",
       first(qty) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM q GROUP BY 1
"""

# --- fleets and curves ----------------------------------------------------------
SQL["fleet_sum"] = """
SELECT date_trunc('minute', ts) AS ts, round(sum(value), 4) AS total FROM events GROUP BY 1
"""

SQL["fleet_generation"] = """
WITH u AS (SELECT 'pv' AS fleet, ts, value FROM events WHERE event_type = 'view'
           UNION ALL SELECT 'wind', ts, value FROM events WHERE event_type = 'click')
SELECT fleet, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS total FROM u GROUP BY 1, 2
"""

SQL["power_curve"] = """
WITH k(x, y) AS (VALUES (1,0),(2,0),(3,0),(4,222),(5,444),(6,777),(7,1206),(8,1857),(9,2603),(10,3460),
  (11,4158),(12,4412),(13,4500),(14,4500),(15,4500),(16,4500),(17,4500),(18,4500),(19,4380),(20,4238),
  (21,4063),(22,3873),(23,3666),(24,3444),(25,3285),(26,3047),(27,2857),(28,0),(29,0),(30,0)),
seg AS (SELECT CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0,
               CAST(lead(x) OVER (ORDER BY x) AS DOUBLE) AS x1, CAST(lead(y) OVER (ORDER BY x) AS DOUBLE) AS y1 FROM k),
li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS speed FROM lineitem),
j AS (
  SELECT li.*, CASE WHEN speed = 30.0 THEN 0.0
                    WHEN seg.x0 IS NOT NULL THEN seg.y0 + (seg.y1 - seg.y0) * (speed - seg.x0) / (seg.x1 - seg.x0)
                    ELSE 0.0 END AS one
  FROM li LEFT JOIN seg ON speed >= seg.x0 AND speed < seg.x1
)
SELECT l_orderkey, l_linenumber, speed, round(least(one * 31.0, 139500.0), 4) AS kw FROM j
"""

# --- statistics -------------------------------------------------------------------
_NRD0 = """0.9::DOUBLE * {adjust}::DOUBLE * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
             WHEN sd > 0 THEN sd WHEN abs(lo) > 0 THEN abs(lo) ELSE 1.0 END) * pow(CAST(n AS DOUBLE), -0.2)"""


def _curve_sql(source: str, params: str, measures: str, group: str = "g", n: int = 512) -> str:
    """Density curves from the definition of R's ``density`` (before 4.4): mass of
    the values (``source``: g, v) split between the points of a 512-point grid that
    reaches four bandwidths beyond the ends ``f`` and ``t``; at each grid point the
    sum over all others of mass x normal density, where the kernel's points lie
    2 (up - lo) / 1023 apart; linear between grid points. ``params`` are CTEs that
    end in p0 (g, n, bw, f, t); ``measures`` are the output columns of z (g, i, x, y)."""
    return f"""
WITH x AS (SELECT g, CAST(v AS DOUBLE) AS v FROM ({source}) WHERE v IS NOT NULL),
st AS (SELECT g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
              quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY g),
{params},
p AS (SELECT *, f - 4 * bw AS lo, t + 4 * bw AS up FROM p0),
mass AS (SELECT x.g, (v - lo) / ((up - lo) / 511) AS pos FROM x JOIN p ON p.g IS NOT DISTINCT FROM x.g),
b AS (SELECT g, CAST(floor(pos) AS INTEGER) AS j, 1.0 - (pos - floor(pos)) AS w FROM mass
      UNION ALL SELECT g, CAST(floor(pos) AS INTEGER) + 1, pos - floor(pos) FROM mass),
bins AS (SELECT g, j, sum(w) AS w FROM b GROUP BY g, j),
gr AS (SELECT CAST(range AS INTEGER) AS i FROM range(0, 512)),
c AS (SELECT bins.g, i, sum(w / n * exp(-0.5 * pow(abs(i - j) * (2 * (up - lo) / 1023) / bw, 2)) / (bw * sqrt(2 * pi()))) AS y
      FROM bins JOIN p ON p.g IS NOT DISTINCT FROM bins.g, gr GROUP BY 1, 2),
pt AS (SELECT g, i, f + i * ((t - f) / {n - 1}) AS x, lo, (up - lo) / 511 AS d FROM p, (SELECT CAST(range AS INTEGER) AS i FROM range(0, {n}))),
z AS (SELECT pt.g, pt.i, pt.x, c0.y + (c1.y - c0.y) * ((pt.x - (lo + c0.i * d)) / d) AS y
      FROM pt JOIN c c0 ON c0.g IS NOT DISTINCT FROM pt.g AND c0.i = CAST(least(floor((pt.x - lo) / d), 510) AS INTEGER)
      JOIN c c1 ON c1.g IS NOT DISTINCT FROM pt.g AND c1.i = c0.i + 1)
SELECT {measures.replace("$g", f"g AS {group}")} FROM z
"""


_PLAIN = "i, round(x, 6) AS x, round(y, 12) AS density"


def _density_sql(source: str, adjust: float, reach: float) -> str:
    """One curve, its points from ``reach`` bandwidths beyond the values on both sides."""
    own = f"bw0 AS (SELECT *, {_NRD0.format(adjust=adjust)} AS bw FROM st), p0 AS (SELECT g, n, bw, lo - {reach} * bw AS f, hi + {reach} * bw AS t FROM bw0)"
    return _curve_sql(f"SELECT 0 AS g, v FROM ({source})", own, _PLAIN)


SQL["kernel_density"] = _density_sql("SELECT c_acctbal AS v FROM customer", 1.0, 3.0)
SQL["dg_azimuth_density"] = _density_sql("SELECT c_acctbal / 20.0 AS v FROM customer", 0.05, 0.0)
SQL["dg_tilt_density"] = _density_sql("SELECT abs(c_acctbal) / 100.0 AS v FROM customer WHERE abs(c_acctbal) / 100.0 < 45", 1.0, 0.0)
SQL["grouped_density"] = _curve_sql(
    "SELECT event_type AS g, value AS v FROM events",
    f"p0 AS (SELECT g, n, {_NRD0.format(adjust=1.0)} AS bw, min(lo) OVER () AS f, max(hi) OVER () AS t FROM st)",
    "$g, " + _PLAIN, "event_type",
)

# the integral up to a point: left sums over the points before it
_RIDGE = """r AS (SELECT *, coalesce(sum(y * (x1 - x)) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS e
     FROM (SELECT *, lead(x) OVER (PARTITION BY g ORDER BY i) AS x1, max(y) OVER (PARTITION BY g) AS top FROM z))"""


def _ridge_sql(source: str, bandwidth: str, measures: str, group: str) -> str:
    """Curves with one bandwidth, three bandwidths beyond the values of all groups."""
    joint = f"""own AS (SELECT *, {_NRD0.format(adjust=1.0)} AS bw FROM st WHERE n > 1),
j AS (SELECT {bandwidth} AS bw), r0 AS (SELECT min(lo) AS lo, max(hi) AS hi FROM st),
p0 AS (SELECT g, n, bw, r0.lo - 3 * bw AS f, r0.hi + 3 * bw AS t FROM (SELECT g, n FROM st WHERE n > 2), j, r0)"""
    sql = _curve_sql(source, joint, "", group)
    return sql.replace("\nSELECT  FROM z\n", f",\n{_RIDGE}\nSELECT g AS {group}, {measures} FROM r\n")


SQL["density_ridges"] = _ridge_sql(
    "SELECT strftime(o_orderdate, '%b') AS g, o_totalprice / 1000.0 AS v FROM orders", "(SELECT avg(bw) FROM own)",
    "i, round(x, 6) AS x, round(y, 12) AS density, round(y / top, 8) AS ndensity, round(e, 8) AS ecdf, round(0.5 - abs(0.5 - e), 8) AS tail", "month",
)
SQL["density_ridges_hour"] = _ridge_sql(
    f"SELECT CAST(hour({_CLOCK}) AS INTEGER) AS g, round(price, 6) AS v FROM (SELECT date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 300000000 + 1 AS Time_Index, avg(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY 1)",
    "1.0::DOUBLE", "i, round(x, 6) AS x, round(y, 10) AS density, round(e, 8) AS ecdf, round(0.5 - abs(0.5 - e), 8) AS tail", "hour",
)

SQL["ecdf"] = """
WITH c AS (SELECT o_orderpriority, o_totalprice, count(*) AS n_at FROM orders
           WHERE o_totalprice IS NOT NULL GROUP BY 1, 2)
SELECT o_orderpriority, o_totalprice, n_at,
       round(CAST(sum(n_at) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / CAST(sum(n_at) OVER (PARTITION BY o_orderpriority) AS DOUBLE), 10) AS ecdf
FROM c
"""

# --- the derived planning-run result set (same rules as plans/system.py) ---------
_SYS = f"""{_EV},
zev AS (SELECT *, CAST(coalesce(user_id, 0) % 2 + 1 AS VARCHAR) AS Zone FROM ev),
zres AS (SELECT Time_Index, Zone, event_type AS Resource, sum(value) AS value,
                sum(value) FILTER (WHERE value < 10.0) AS charge FROM zev GROUP BY 1, 2, 3),
zprice AS (SELECT Time_Index, Zone, avg(value) AS price FROM zev WHERE event_type = 'purchase' GROUP BY 1, 2),
chg AS (SELECT Time_Index, event_type AS Resource, sum(value) AS value FROM ev WHERE value < 10.0 GROUP BY 1, 2),
days AS (SELECT DISTINCT (Time_Index - 1) // 288 AS d FROM ev),
pmap AS (SELECT d + 1 AS Period_Index, d % 7 + 1 AS Rep_Period, d % 7 + 1 AS Rep_Period_Index FROM days),
reps AS (SELECT DISTINCT Rep_Period, Rep_Period_Index FROM pmap),
weights AS (SELECT Rep_Period, Rep_Period_Index, count(*) AS n_members,
                   (CAST(count(*) AS DOUBLE) * 8760.0) / CAST((SELECT count(*) FROM pmap) * 288 AS DOUBLE) AS weight
            FROM pmap GROUP BY 1, 2),
sw AS (SELECT (Rep_Period_Index - 1) * 288 + s AS Time_Index, weight FROM weights CROSS JOIN range(1, 289) t(s)),
red_power AS (SELECT (m.Rep_Period_Index - 1) * 288 + (p.Time_Index - 1) % 288 + 1 AS Time_Index, p.Resource, p.value
              FROM res p JOIN reps m ON (p.Time_Index - 1) // 288 + 1 = m.Rep_Period),
hw AS (SELECT 8760.0::DOUBLE / ((SELECT count(*) FROM days) * 288) AS w),
zsteps AS (
  SELECT r.*, p.price, s.shdw, hw.w,
         dayofweek(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(5 * (r.Time_Index - 1) AS BIGINT))) + 1
           BETWEEN 2 AND 6 AS weekday
  FROM zres r CROSS JOIN hw LEFT JOIN zprice p ON p.Time_Index = r.Time_Index AND p.Zone = r.Zone
       LEFT JOIN scar s ON s.Time_Index = r.Time_Index
),
sums AS (
  SELECT Resource, Zone, coalesce(sum(w * value), 0.0) AS Energy, coalesce(sum(w * charge), 0.0) AS Charge,
         coalesce(sum(w * (price * value)), 0.0) AS EnergyRevenue, coalesce(sum(w * (price * charge)), 0.0) AS Charge_cost,
         coalesce(sum(w * ((CASE WHEN Resource IN ('view', 'click') THEN 3.0 ELSE 0.0 END)::DOUBLE * value)), 0.0) AS SubsidyRevenue,
         coalesce(sum(w * (0.9::DOUBLE * shdw * value)), 0.0) AS ReserveMarginRevenue,
         coalesce(sum(w * (0.05::DOUBLE * price * value)) FILTER (WHERE weekday), 0.0) AS ESR_1,
         coalesce(sum(w * (0.05::DOUBLE * price * value)) FILTER (WHERE NOT weekday), 0.0) AS ESR_2,
         coalesce(sum(w * ((CASE WHEN Resource = 'signup' THEN 1.5 ELSE 0.0 END)::DOUBLE * value)), 0.0) AS RegSubsidyRevenue,
         coalesce(sum(w * ((CASE WHEN Resource = 'signup' THEN 1.2 ELSE 0.0 END)::DOUBLE * value)), 0.0) AS Fuel_cost
  FROM zsteps GROUP BY 1, 2
),
peaks AS (SELECT Resource, Zone, avg(value) AS StartCap, max(value) AS e FROM zres GROUP BY 1, 2),
cap0 AS (SELECT Resource, Zone, StartCap, greatest(StartCap - e, 0.0) AS RetCap, greatest(e - StartCap, 0.0) AS NewCap,
                CASE WHEN Resource IN ('purchase', 'error') THEN 4.0 ELSE 0.0 END AS h
         FROM peaks),
cap1 AS (SELECT Resource, Zone, StartCap, RetCap, NewCap, StartCap * h AS StartEnergyCap, RetCap * h AS RetEnergyCap,
                NewCap * h AS NewEnergyCap FROM cap0),
cap AS (SELECT *, StartCap + NewCap - RetCap AS EndCap, StartEnergyCap + NewEnergyCap - RetEnergyCap AS EndEnergyCap FROM cap1),
gens AS (SELECT Resource, Zone,
                CASE WHEN st THEN 60000.0 ELSE 85000.0 END AS Inv_Cost_per_MWyr,
                CASE WHEN st THEN 20000.0 ELSE 0.0 END AS Inv_Cost_per_MWhyr,
                CASE WHEN st THEN 8000.0 ELSE 12000.0 END AS Fixed_OM_Cost_per_MWyr,
                CASE WHEN st THEN 5000.0 ELSE 0.0 END AS Fixed_OM_Cost_per_MWhyr,
                CASE WHEN st THEN 0.5 ELSE 2.0 END AS Var_OM_Cost_per_MWh,
                CASE WHEN st THEN 0.5 ELSE 0.0 END AS Var_OM_Cost_per_MWh_In
         FROM (SELECT Resource, Zone, Resource IN ('purchase', 'error') AS st FROM cap)),
net0 AS (
  SELECT g.Resource, g.Zone,
         CAST(Inv_Cost_per_MWyr AS DOUBLE) * NewCap AS Inv_cost_MW,
         CAST(Inv_Cost_per_MWhyr AS DOUBLE) * NewEnergyCap AS Inv_cost_MWh,
         CAST(Fixed_OM_Cost_per_MWyr AS DOUBLE) * EndCap AS Fixed_OM_cost_MW,
         CAST(Fixed_OM_Cost_per_MWhyr AS DOUBLE) * EndEnergyCap AS Fixed_OM_cost_MWh,
         CAST(Var_OM_Cost_per_MWh AS DOUBLE) * Energy AS Var_OM_cost_out,
         CAST(Var_OM_Cost_per_MWh_In AS DOUBLE) * Charge AS Var_OM_cost_in,
         Fuel_cost, 0.0::DOUBLE AS Start_cost, Charge_cost, 0.0::DOUBLE AS EmissionsCost, EnergyRevenue, SubsidyRevenue,
         ReserveMarginRevenue, ESR_1 + ESR_2 AS ESRRevenue, RegSubsidyRevenue
  FROM gens g JOIN cap USING (Resource, Zone) JOIN sums USING (Resource, Zone)
),
net AS (
  SELECT *, EnergyRevenue + SubsidyRevenue + ReserveMarginRevenue + ESRRevenue + RegSubsidyRevenue AS Revenue,
         Inv_cost_MW + Inv_cost_MWh + Fixed_OM_cost_MW + Fixed_OM_cost_MWh + Var_OM_cost_out + Var_OM_cost_in
           + Fuel_cost + Start_cost + Charge_cost + EmissionsCost AS Cost
  FROM net0
),
nse AS (SELECT Time_Index, greatest(Load - 150.0, 0.0) AS value FROM load),
cnse AS (SELECT 50000.0 * sum(w * value) AS value FROM nse CROSS JOIN hw)
"""

SQL["period_weights"] = f"WITH {_SYS} SELECT Rep_Period, Rep_Period_Index, n_members, round(weight, 9) AS weight FROM weights"
SQL["step_weights"] = f"WITH {_SYS} SELECT Time_Index, round(weight, 9) AS weight FROM sw"
SQL["annual_sum"] = f"WITH {_SYS} SELECT Resource, Zone, round(Energy, 2) AS AnnualSum FROM sums"
SQL["charging_cost"] = f"WITH {_SYS} SELECT Resource, Zone, round(Charge_cost, 2) AS AnnualSum FROM sums"
SQL["energy_revenue"] = f"WITH {_SYS} SELECT Resource, Zone, round(EnergyRevenue, 2) AS AnnualSum FROM sums"
SQL["unpriced_steps"] = f"""WITH {_SYS}
SELECT Resource, Zone, count(*) FILTER (WHERE price IS NULL) AS no_price, count(*) FILTER (WHERE shdw IS NULL) AS no_shdw,
       count(*) FILTER (WHERE w IS NULL) AS no_weight FROM zsteps GROUP BY 1, 2
"""

SQL["capacity_factor"] = f"""WITH {_SYS}
SELECT e.Resource, e.Zone, round(e.Energy, 2) AS AnnualSum, round(cap.EndCap, 4) AS Capacity,
       round(CASE WHEN e.Resource IN ('purchase', 'error') OR cap.EndCap <= 0 THEN 0.0
                  ELSE e.Energy / (cap.EndCap * 8760.0) END, 8) AS CapacityFactor
FROM sums e JOIN cap USING (Resource, Zone)
"""

_NET_COLS = ["Inv_cost_MW", "Inv_cost_MWh", "Fixed_OM_cost_MW", "Fixed_OM_cost_MWh", "Var_OM_cost_out", "Var_OM_cost_in",
             "Fuel_cost", "Start_cost", "Charge_cost", "EmissionsCost", "EnergyRevenue", "SubsidyRevenue",
             "ReserveMarginRevenue", "ESRRevenue", "RegSubsidyRevenue", "Revenue", "Cost"]
SQL["net_revenue"] = (
    f"WITH {_SYS} SELECT Resource, Zone, "
    + ", ".join(f"round({c}, 2) AS {c}" for c in _NET_COLS)
    + ", round(Revenue - Cost, 2) AS Profit FROM net"
)

SQL["cost_rollup"] = f"""WITH {_SYS},
agg AS (SELECT sum(Inv_cost_MW + Inv_cost_MWh + Fixed_OM_cost_MW + Fixed_OM_cost_MWh) AS cFix,
               sum(Var_OM_cost_out + Var_OM_cost_in + Fuel_cost) AS cVar, sum(Start_cost) AS cStart,
               (SELECT value FROM cnse) AS cNSE FROM net)
SELECT Costs, round(Total, 2) AS Total FROM (
  SELECT 'cTotal' AS Costs, cFix + cVar + cStart + cNSE AS Total FROM agg
  UNION ALL SELECT 'cFix', cFix FROM agg UNION ALL SELECT 'cVar', cVar FROM agg
  UNION ALL SELECT 'cStart', cStart FROM agg UNION ALL SELECT 'cNSE', cNSE FROM agg)
"""

SQL["unserved_energy_cost"] = f"WITH {_SYS} SELECT round(value, 2) AS value FROM cnse"

_CAP_MEASURES = ["StartCap", "RetCap", "NewCap", "EndCap", "StartEnergyCap", "RetEnergyCap", "NewEnergyCap", "EndEnergyCap"]
SQL["installed_capacity"] = f"""WITH {_SYS},
t AS (
  SELECT Resource, string_agg(Zone, '+' ORDER BY Zone) AS Zone, {", ".join(f"sum({m}) AS {m}" for m in _CAP_MEASURES)} FROM cap GROUP BY 1
  UNION ALL SELECT 'Total', 'n/a', {", ".join(f"sum({m})" for m in _CAP_MEASURES)} FROM cap
)
SELECT Resource, Zone,
       CASE Resource WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4
                     WHEN 'error' THEN 5 END AS level,
       {", ".join(f"round({m}, 4) AS {m}" for m in _CAP_MEASURES)}
FROM t
"""

SQL["storage_energy_totals"] = f"""WITH {_SYS}
SELECT round(sum(EndEnergyCap), 4) AS total,
       round(sum(EndEnergyCap) FILTER (WHERE Resource = 'purchase'), 4) AS battery,
       round(sum(EndEnergyCap) FILTER (WHERE Resource = 'error'), 4) AS pumped_hydro
FROM cap WHERE Resource <> 'Total'
"""

SQL["cost_revenue_breakdown"] = f"""WITH {_SYS},
g AS (SELECT Resource, Zone, Inv_cost_MW + Inv_cost_MWh AS Investment,
             Fixed_OM_cost_MW + Fixed_OM_cost_MWh + Var_OM_cost_out + Var_OM_cost_in AS OM,
             Charge_cost AS Charge, EnergyRevenue AS Energy, ReserveMarginRevenue AS RA FROM net),
l AS (UNPIVOT g ON Investment, OM, Charge, Energy, RA INTO NAME Category VALUE value)
SELECT Resource, Zone, Category,
       round((CASE WHEN Category IN ('Energy', 'RA') THEN 1.0 ELSE -1.0 END) * value / 1e6, 6) AS value_MM
FROM l WHERE (Resource, Zone) IN (SELECT (Resource, Zone) FROM cap WHERE EndCap > 0)
"""

SQL["expand_period_map"] = f"""WITH {_SYS},
rl AS (SELECT (Time_Index - 1) // 288 + 1 AS Rep_Period_Index, (Time_Index - 1) % 288 AS Step, sum(value) AS Load
       FROM red_power GROUP BY Time_Index)
SELECT m.Period_Index, rl.Step, (m.Period_Index - 1) * 288 + rl.Step + 1 AS Time_Index, round(rl.Load, 4) AS Load
FROM rl JOIN pmap m USING (Rep_Period_Index)
"""

SQL["extreme_periods"] = f"""WITH {_EV},
pl AS (SELECT (Time_Index - 1) // 288 + 1 AS Period_Index, max(Load) AS v FROM load GROUP BY 1),
pv AS (SELECT (Time_Index - 1) // 288 + 1 AS Period_Index, sum(value) AS v FROM res WHERE Resource = 'view' GROUP BY 1),
wd AS (SELECT (Time_Index - 1) // 288 + 1 AS Period_Index, sum(value) AS v FROM res WHERE Resource = 'click' GROUP BY 1)
SELECT 'load_system_absolute_max' AS rule, (SELECT Period_Index FROM pl ORDER BY v DESC, Period_Index LIMIT 1) AS Period_Index
UNION ALL SELECT 'pv_integral_min', (SELECT Period_Index FROM pv ORDER BY v, Period_Index LIMIT 1)
UNION ALL SELECT 'wind_integral_min', (SELECT Period_Index FROM wd ORDER BY v, Period_Index LIMIT 1)
"""

SQL["scale_features"] = f"""WITH {_HOURLY},
st AS (SELECT event_type, avg(v) AS mu, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM h GROUP BY 1)
SELECT h.event_type, h.ts, round(h.v, 6) AS value,
       round(CASE WHEN sd > 0 THEN (h.v - mu) / sd ELSE 0.0 END, 8) AS z,
       round(CASE WHEN hi - lo > 0 THEN (h.v - lo) / (hi - lo) ELSE 0.0 END, 8) AS minmax
FROM h JOIN st USING (event_type)
"""

SQL["representative_periods"] = f"""WITH {_SYS},
j AS (SELECT l.Time_Index, l.Load, m.* FROM load l RIGHT JOIN pmap m ON m.Period_Index = (l.Time_Index - 1) // 288 + 1)
SELECT Time_Index, Period_Index, Rep_Period, Rep_Period_Index,
       Period_Index IN (SELECT Rep_Period FROM pmap) AS Representative, {_CLOCK} AS clock, round(Load, 4) AS Load
FROM j WHERE Time_Index % 12 = 0
"""
SQL["bin_week"] = f"""WITH {_SYS},
rp AS (SELECT Rep_Period FROM pmap WHERE 8 - Rep_Period = 3 AND Period_Index = Rep_Period),
p AS (SELECT 2 * 288 + (Time_Index - 1) % 288 + 1 AS Time_Index, price,
             {_CLOCK} AS clock FROM price WHERE (Time_Index - 1) // 288 + 1 = (SELECT Rep_Period FROM rp))
SELECT Time_Index, clock, round(price, 4) AS price FROM p
"""
SQL["reduced_scarcity_total"] = f"""WITH {_SYS},
x AS (SELECT (m.Period_Index - 1) * 288 + (s.Time_Index - 1) % 288 + 1 AS Time_Index, shdw
      FROM scar s JOIN pmap m ON m.Rep_Period = (s.Time_Index - 1) // 288 + 1)
SELECT round(sum(shdw * Load), 2) AS scarcity_cost FROM load LEFT JOIN x USING (Time_Index)
"""

SQL["price_week"] = f"""WITH {_EV}
SELECT Time_Index, {_CLOCK} AS clock, round(price * 12.0, 4) AS price FROM price WHERE Time_Index BETWEEN 577 AND 864
"""
SQL["price_range"] = f"""WITH {_EV}
SELECT round(min(price * 12.0), 4) AS lo, round(max(price * 12.0), 4) AS hi FROM price WHERE Time_Index BETWEEN 577 AND 864
"""
SQL["scarcity_week"] = f"""WITH {_EV}
SELECT Time_Index, {_CLOCK} AS clock, round(shdw, 4) AS shdw FROM scar WHERE Time_Index BETWEEN 577 AND 864
"""
SQL["dispatch_week"] = f"""WITH {_SYS}
SELECT r.Time_Index, r.Resource, round(r.value - coalesce(c.value, 0.0), 4) AS net
FROM res r LEFT JOIN chg c ON c.Time_Index = r.Time_Index AND c.Resource = r.Resource
WHERE r.Time_Index BETWEEN 577 AND 864 AND r.Resource IN (SELECT Resource FROM cap WHERE EndCap > 0)
"""
SQL["state_of_charge_week"] = f"""WITH {_SYS},
s AS (SELECT * FROM res WHERE Time_Index BETWEEN 577 AND 864 AND Resource IN ('purchase', 'error')),
tot AS (SELECT Time_Index, sum(value) AS t FROM s GROUP BY 1)
SELECT s.Time_Index, s.Resource, round(s.value, 4) AS value,
       round(tot.t / (SELECT sum(EndEnergyCap) FROM cap WHERE Resource IN ('purchase', 'error')), 8) AS total_soc
FROM s JOIN tot USING (Time_Index)
"""

SQL["hydro_variability"] = """
WITH m AS (SELECT o_orderpriority AS Hour, date_trunc('month', o_orderdate) AS Datetime, avg(o_totalprice) AS v
           FROM orders GROUP BY 1, 2),
s AS (SELECT Hour, Datetime, v, lead(Datetime) OVER w AS d1, lead(v) OVER w AS v1
      FROM m WINDOW w AS (PARTITION BY Hour ORDER BY Datetime)),
seg AS (SELECT *, date_diff('day', Datetime, d1) AS n FROM s WHERE d1 IS NOT NULL),
k AS (SELECT Hour, Datetime, v, v1, n, unnest(range(0, n)) AS k FROM seg),
b AS (SELECT min(Datetime) AS lo, max(Datetime) AS hi FROM m),
f AS (SELECT Hour, min(Datetime) AS first FROM m GROUP BY 1),
tl AS (SELECT Hour, Datetime, v, unnest(range(0, date_diff('day', Datetime, hi) + 1)) AS k FROM s, b WHERE d1 IS NULL),
hd AS (SELECT Hour, unnest(range(0, date_diff('day', lo, first))) AS k, lo FROM f, b),
o AS (SELECT Hour, Datetime + to_days(CAST(k AS INTEGER)) AS Datetime, v + (v1 - v) * k / n AS gen FROM k
      UNION ALL SELECT Hour, Datetime + to_days(CAST(k AS INTEGER)), v FROM tl
      UNION ALL SELECT Hour, lo + to_days(CAST(k AS INTEGER)), NULL FROM hd)
SELECT Hour, Datetime, floor(gen * 10000.0 + 0.5) / 10000.0 AS gen FROM o
"""

SQL["net_demand_vs_scarcity"] = f"""WITH {_EV},
w AS (SELECT Time_Index, sum(value) AS w FROM ev WHERE event_type = 'click' GROUP BY 1),
s AS (SELECT Time_Index, sum(value) AS s FROM ev WHERE event_type = 'view' GROUP BY 1),
av AS (SELECT Time_Index, (w / Load + s / Load) / 2 AS avail FROM w JOIN s USING (Time_Index) JOIN load USING (Time_Index))
SELECT Time_Index, round(shdw, 4) AS shdw, round(avail, 8) AS avail, round(Load * (1.0 - avail), 6) AS net_load
FROM scar JOIN av USING (Time_Index) JOIN load USING (Time_Index)
"""

SQL["scalar_functions"] = """
WITH o AS (SELECT *, floor(log10(abs(o_totalprice))) - 2 + 1 AS k FROM orders)
SELECT o_orderkey,
       strptime(strftime(o_orderdate, '%-m/%-d/%y %-H:%M'), '%m/%d/%y %H:%M') AS parsed,
       CAST(year(o_orderdate) AS INTEGER) AS yr, strftime(o_orderdate, '%b') AS mon,
       CAST(day(o_orderdate) AS INTEGER) AS dom, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
       dayofweek(o_orderdate) + 1 BETWEEN 2 AND 6 AS weekday,
       CAST(hour(o_orderdate) * 60 + minute(o_orderdate) AS INTEGER) AS mod,
       strftime(o_orderdate, '%H:%M:%S') AS tod,
       CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice = 0 THEN 0.0
            WHEN k >= 0 THEN round(o_totalprice / pow(10.0, abs(k))) * pow(10.0, abs(k))
            ELSE round(o_totalprice * pow(10.0, abs(k))) / pow(10.0, abs(k)) END AS signif2,
       round(ln(1 + o_totalprice), 10) AS log1p,
       CAST(round(o_totalprice / 1000.0, 2) AS VARCHAR) || ' k' AS label,
       TRY_CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS prio_num,
       TRY_CAST(o_orderpriority AS DOUBLE) AS prio_bad,
       CASE WHEN o_totalprice / 1000.0 > 225 THEN 'West' WHEN o_totalprice / 1000.0 > 135 THEN 'South'
            ELSE 'East' END AS orientation
FROM o
"""

SQL["rollup_zone_pivot"] = """
WITH li AS (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DECIMAL(18, 2)) AS v FROM lineitem)
SELECT l_returnflag, CAST(sum(v) AS DOUBLE) AS Total,
       CAST(sum(v) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS "F",
       CAST(sum(v) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS "O"
FROM li GROUP BY 1
"""

SQL["solver_wide_roundtrip"] = f"WITH {_EV} SELECT Time_Index, Resource, round(value, 4) AS value FROM res"

SQL["step_total"] = f"WITH {_EV} SELECT Time_Index, round(sum(value), 4) AS Total FROM res GROUP BY 1"

SQL["multi_constraint_revenue"] = f"""WITH {_SYS}
SELECT Resource, Zone, round(ESR_1, 2) AS ESR_1, round(ESR_2, 2) AS ESR_2, round(ESR_1 + ESR_2, 2) AS AnnualSum FROM sums
"""

SQL["offset_from_first"] = """
SELECT event_id, event_type,
       (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type))) // 60000000 AS minutes
FROM events
"""

SQL["matrix_to_rows"] = """
SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, embedding[pos] AS value
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
"""

SQL["ev_profile_long"] = f"""WITH {_EV},
evs AS (SELECT {_CLOCK} AS clock, sum(value) AS e FROM ev WHERE event_type = 'click' GROUP BY Time_Index),
d AS (SELECT CAST(hour(clock) * 60 + minute(clock) AS INTEGER) AS m,
             dayofweek(clock) + 1 BETWEEN 2 AND 6 AS Weekday,
             CAST(sum(CAST(e AS DECIMAL(30, 2))) AS DOUBLE) / count(e) AS EV_load FROM evs GROUP BY 1, 2),
t0 AS (SELECT min(m) AS m0 FROM d)
SELECT CAST(m - m0 AS INTEGER) AS Time, Weekday, floor(EV_load * 10000.0 + 0.5) / 10000.0 AS EV_load FROM d, t0
"""


# --- file readers ---------------------------------------------------------------
SQL["run_tree"] = f"""WITH {_EV},
n AS (SELECT *, dense_rank() OVER (ORDER BY Resource) AS i FROM res)
SELECT 'sim 1 - a' AS sim, 'Results_1' AS run, Time_Index, Resource, round(value, 4) AS value FROM n WHERE i <= 2
UNION ALL SELECT 'sim2', 'Results_1', Time_Index, Resource, round(value, 4) FROM n WHERE i >= 2
"""
SQL["csv_roundtrip"] = """
SELECT o_orderkey, date_trunc('minute', o_orderdate) AS o_orderdate, o_totalprice,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders
"""
SQL["result_report"] = """
SELECT 'r' || c_nationkey AS "Resource", CAST(count(*) AS DOUBLE) AS "Count",
       CASE WHEN max(c_acctbal) < 9900 THEN NULL ELSE max(c_acctbal) END AS "Most"
FROM customer GROUP BY c_nationkey
"""
SQL["site_files"] = """
SELECT 2012 AS "Year", s_suppkey AS key, s_acctbal AS balance, 'site ' || s_nationkey AS site FROM supplier
"""
SQL["azimuth_labels"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 20.0 END AS a FROM customer)
SELECT c_custkey, CASE WHEN a IS NULL THEN 'South' WHEN a > 225 THEN 'West' WHEN a > 135 THEN 'South' ELSE 'East' END AS Orientation
FROM c
"""
SQL["month_hour_profile"] = """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(hour(o_orderdate) AS INTEGER) AS hour, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders GROUP BY 1, 2
"""
SQL["two_arrays_to_rows"] = """
SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, embedding[pos] AS embedding, embedding[len(embedding) + 1 - pos] AS mirror
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
"""


# --- typical periods ----------------------------------------------------------------
_FEATURES = """
ho AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS h, event_type AS g, sum(value) AS v
       FROM events GROUP BY 1, 2),
lo AS (SELECT h, g, v FROM ho UNION ALL SELECT h, 'Load', sum(v) FROM ho GROUP BY h),
fst AS (SELECT g, avg(v) AS mu, stddev_samp(v) AS sd FROM lo GROUP BY g),
fz AS (SELECT h // 24 + 1 AS p, (CASE g WHEN 'Load' THEN 0 WHEN 'view' THEN 24 ELSE 48 END) + h % 24 AS pos,
              CASE WHEN sd > 0 THEN (v - mu) / sd ELSE 0.0 END AS z
       FROM lo JOIN fst USING (g) WHERE g IN ('Load', 'view', 'click')),
feat AS (SELECT d.p, r.pos, coalesce(fz.z, 0.0) AS z FROM (SELECT DISTINCT p FROM fz) d
         CROSS JOIN (SELECT range AS pos FROM range(0, 72)) r LEFT JOIN fz ON fz.p = d.p AND fz.pos = r.pos)
"""

SQL["period_features"] = f"""WITH {_FEATURES}
SELECT p AS Period_Index, CAST(pos AS INTEGER) AS pos, round(z, 8) AS value FROM feat
"""

SQL["pick_representative"] = f"""WITH {_FEATURES},
c AS (SELECT p % 4 AS c, pos, avg(z) AS m FROM feat GROUP BY 1, 2),
d AS (SELECT feat.p, feat.p % 4 AS c, sum((z - m) * (z - m)) AS d FROM feat JOIN c ON c.c = feat.p % 4 AND c.pos = feat.pos GROUP BY 1, 2),
r AS (SELECT c, arg_min(p, struct_pack(d := round(d, 9), p := p)) AS rep FROM d GROUP BY c),
n AS (SELECT rep, row_number() OVER (ORDER BY rep) AS i FROM r)
SELECT d.p AS Period_Index, r.rep AS Rep_Period, CAST(n.i AS INTEGER) AS Rep_Period_Index FROM d JOIN r USING (c) JOIN n USING (rep)
"""

# extreme days, the others, and the distances of their pairs
_POOL = f"""{_FEATURES},
pday AS (SELECT h // 24 + 1 AS p, g, max(v) AS top, sum(v) AS total FROM lo GROUP BY 1, 2),
ext AS (SELECT DISTINCT p FROM (
  SELECT arg_min(p, struct_pack(v := -top, p := p)) AS p FROM pday WHERE g = 'Load'
  UNION ALL SELECT arg_min(p, struct_pack(v := total, p := p)) FROM pday WHERE g = 'view'
  UNION ALL SELECT arg_min(p, struct_pack(v := total, p := p)) FROM pday WHERE g = 'click')),
pool AS (SELECT * FROM feat WHERE p NOT IN (SELECT p FROM ext)),
pairs AS (SELECT a.p, b.p AS q, sum((a.z - b.z) * (a.z - b.z)) AS d FROM pool a JOIN pool b USING (pos) GROUP BY 1, 2)"""

# the map of the days ``mem`` (p, rep) and the extreme ones, representatives numbered
_MAP = """m AS (SELECT p, rep FROM mem UNION ALL SELECT p, p FROM ext),
num AS (SELECT rep, row_number() OVER (ORDER BY rep) AS i FROM (SELECT DISTINCT rep FROM m))
SELECT p AS Period_Index, rep AS Rep_Period, CAST(i AS INTEGER) AS Rep_Period_Index FROM m JOIN num USING (rep)"""

# Lloyd's rounds as a recursion over (k, restart, day, cluster); distances to means
# follow from the distances of pairs
SQL["cluster_periods"] = f"""WITH RECURSIVE {_POOL},
ks AS (SELECT range - (SELECT count(*) FROM ext) AS k FROM range(5, 8)),
-- k-means++: a race of exponential times, weighted by the distance to the nearest centre before
race AS (
  SELECT 0 AS j, r, p, 1.0::DOUBLE AS w, p = arg_min(p, -ln((('0x' || substr(md5('11-' || r || '-0-' || p), 1, 13))::UBIGINT + 0.5) / pow(2.0, 52))) OVER (PARTITION BY r) AS won
  FROM (SELECT DISTINCT p FROM pool), (SELECT range AS r FROM range(0, 250))
  UNION ALL
  SELECT j, r, p, w, p = arg_min(p, -ln((('0x' || substr(md5('11-' || r || '-' || j || '-' || p), 1, 13))::UBIGINT + 0.5) / pow(2.0, 52)) / w)
                         FILTER (WHERE w > 0) OVER (PARTITION BY r) AS won
  FROM (SELECT a.j + 1 AS j, a.r, a.p, CASE WHEN a.j = 0 THEN round(x.d, 9) ELSE least(a.w, round(x.d, 9)) END AS w
        FROM race a JOIN race b ON b.r = a.r AND b.won JOIN pairs x ON x.p = a.p AND x.q = b.p WHERE a.j < 6)
),
ranked AS (SELECT r, p, j AS c FROM race WHERE won),
lab AS (
  SELECT 0 AS it, k, r, x.p, arg_min(c, struct_pack(d := round(d, 9), c := c)) AS c
  FROM ks JOIN ranked ON c < k JOIN pairs x ON x.q = ranked.p GROUP BY k, r, x.p
  UNION ALL
  SELECT it + 1, k, r, p, c FROM (
    WITH now AS (SELECT * FROM lab),
    cross_ AS (SELECT any_value(it) AS it, k, r, x.p, c, avg(d) AS d FROM now JOIN pairs x ON x.q = now.p GROUP BY k, r, x.p, c),
    spread AS (SELECT k, r, c, avg(cross_.d) AS s FROM cross_ JOIN now USING (k, r, p, c) GROUP BY 1, 2, 3)
    SELECT any_value(it) AS it, k, r, p, arg_min(c, struct_pack(d := round(d - s / 2, 9), c := c)) AS c FROM cross_ JOIN spread USING (k, r, c) GROUP BY k, r, p
  ) WHERE it < 20
),
fin AS (SELECT k, r, p, c FROM lab WHERE it = 20),
fcross AS (SELECT k, r, x.p, c, avg(d) AS d FROM fin JOIN pairs x ON x.q = fin.p GROUP BY k, r, x.p, c),
fown AS (SELECT k, r, p, c, d FROM fcross JOIN fin USING (k, r, p, c)),
fnear AS (SELECT k, r, p, c, d - avg(d) OVER (PARTITION BY k, r, c) / 2 AS d FROM fown),
cost AS (SELECT k, r, sum(d) AS cost FROM fnear GROUP BY 1, 2),
win AS (SELECT k, arg_min(r, struct_pack(x := round(cost, 9), r := r)) AS r FROM cost GROUP BY k),
rep AS (SELECT k, c, arg_min(p, struct_pack(d := round(d, 9), p := p)) AS rep FROM fnear JOIN win USING (k, r) GROUP BY 1, 2),
members AS (SELECT k, p, rep FROM fin JOIN win USING (k, r) JOIN rep USING (k, c)),
worst AS (SELECT k, max(d) AS w FROM members JOIN pairs ON pairs.p = members.p AND pairs.q = members.rep GROUP BY k),
pick AS (SELECT coalesce(min(k) FILTER (WHERE w <= 0.4 * 0.4 * 72), max(k)) AS k FROM worst),
mem AS (SELECT p, rep FROM members WHERE k = (SELECT k FROM pick)),
{_MAP}
"""

# from one cluster on: rounds (r) until no day moves, then the farthest day becomes a
# cluster of its own, until all are near or there are twelve besides the extreme days;
# if a new cluster leaves another empty, the one before (prev) stands
SQL["cluster_periods_inserted"] = f"""WITH RECURSIVE {_POOL},
st AS (
  SELECT 0 AS r, 1 AS k, p, 0::BIGINT AS c, 0::BIGINT AS prev, false AS fin FROM (SELECT DISTINCT p FROM pool)
  UNION ALL
  SELECT r, k, p, c, prev, fin FROM (
    WITH now AS (SELECT * FROM st WHERE NOT fin),
    cross_ AS (SELECT x.p, now.c, avg(d) AS d FROM now JOIN pairs x ON x.q = now.p GROUP BY x.p, now.c),
    spread AS (SELECT c, avg(d) AS s FROM cross_ JOIN now USING (p, c) GROUP BY c),
    dist AS (SELECT p, c, d - s / 2 AS d FROM cross_ JOIN spread USING (c)),
    moved AS (SELECT p, arg_min(c, struct_pack(d := round(d, 9), c := c)) AS c2 FROM dist GROUP BY p),
    reps AS (SELECT c, arg_min(p, struct_pack(d := round(d, 9), p := p)) AS rep FROM dist JOIN now USING (p, c) GROUP BY c),
    own AS (SELECT now.*, c2, rep, pairs.d AS far, dense_rank() OVER (ORDER BY rep) - 1 AS place
            FROM now JOIN moved USING (p) JOIN reps USING (c) JOIN pairs ON pairs.p = now.p AND pairs.q = rep),
    all_ AS (SELECT bool_or(c <> c2) AND any_value(r) < 20 AS again, count(DISTINCT c) < any_value(k) AS lost,
                    max(far) <= 0.4 * 0.4 * 72 OR any_value(k) >= (SELECT 15 - count(*) FROM ext) AS near,
                    arg_min(p, struct_pack(d := -round(far, 9), p := p)) AS farthest FROM own)
    SELECT CASE WHEN again THEN r + 1 ELSE 0 END AS r, CASE WHEN again OR lost OR near THEN k ELSE k + 1 END AS k, p,
           CASE WHEN again THEN c2 WHEN lost THEN prev WHEN near THEN c WHEN p = farthest THEN k ELSE place END AS c,
           CASE WHEN again OR lost OR near THEN prev ELSE c END AS prev, NOT again AND (lost OR near) AS fin
    FROM own, all_
  )
),
done AS (SELECT p, c FROM st WHERE fin),
cross2 AS (SELECT x.p, done.c, avg(d) AS d FROM done JOIN pairs x ON x.q = done.p GROUP BY x.p, done.c),
rep2 AS (SELECT c, arg_min(p, struct_pack(d := round(d, 9), p := p)) AS rep FROM (SELECT cross2.*, d - avg(d) OVER (PARTITION BY c) / 2 AS d2 FROM cross2 JOIN done USING (p, c)) GROUP BY c),
mem AS (SELECT p, rep FROM done JOIN rep2 USING (c)),
{_MAP}
"""

SQL["extreme_periods_zone"] = f"""WITH {_SYS},
zl AS (SELECT Time_Index, (Time_Index - 1) // 288 + 1 AS p, sum(value) AS v FROM zres GROUP BY 1, 2),
pl AS (SELECT p, max(v) AS v FROM zl GROUP BY p),
pz AS (SELECT Zone, Resource, (Time_Index - 1) // 288 + 1 AS p, sum(value) AS v FROM zres WHERE Resource IN ('view', 'click') GROUP BY 1, 2, 3)
SELECT 'load_absolute_max' AS rule, CAST(NULL AS VARCHAR) AS Zone, (SELECT p FROM pl ORDER BY v DESC, p LIMIT 1) AS Period_Index
UNION ALL SELECT CASE Resource WHEN 'view' THEN 'pv_integral_min' ELSE 'wind_integral_min' END, Zone, arg_min(p, struct_pack(v := v, p := p))
FROM pz GROUP BY Resource, Zone
"""

# --- curves and levels --------------------------------------------------------------
SQL["curve_lookup"] = """
WITH k(x, y) AS (VALUES (1,0),(2,0),(3,0),(4,222),(5,444),(6,777),(7,1206),(8,1857),(9,2603),(10,3460),
  (11,4158),(12,4412),(13,4500),(14,4500),(15,4500),(16,4500),(17,4500),(18,4500),(19,4380),(20,4238),
  (21,4063),(22,3873),(23,3666),(24,3444),(25,3285),(26,3047),(27,2857),(28,0),(29,0),(30,0)),
c AS (SELECT p_partkey, CAST(x AS DOUBLE) * (0.8::DOUBLE + (p_partkey % 5) * 0.1::DOUBLE) AS x0,
             CAST(y AS DOUBLE) * CAST(p_retailprice AS DOUBLE) / 1000.0::DOUBLE AS y0 FROM part, k),
seg AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY p_partkey ORDER BY x0)),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, s AS l_quantity,
       CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part) THEN NULL
            ELSE floor(coalesce(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (s - x0) / (x1 - x0) END, 0.0) * 10000.0 + 0.5) / 10000.0 END AS kw
FROM li LEFT JOIN seg ON l_partkey = p_partkey AND s >= x0 AND (s < x1 OR (x1 IS NULL AND s = x0))
"""
SQL["order_levels"] = """
SELECT 'order ' || o_orderkey AS name, o_totalprice, CAST(row_number() OVER (ORDER BY 'order ' || o_orderkey) AS INTEGER) AS level FROM orders
"""
_LEVEL = "CASE Resource WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END"
SQL["capacity_changes"] = f"""WITH {_SYS},
l AS (UNPIVOT (SELECT Resource, Zone, StartCap, RetCap, NewCap FROM cap WHERE EndCap > 0) ON StartCap, RetCap, NewCap INTO NAME Measure VALUE MW)
SELECT Resource, Zone, Measure, round(MW, 4) AS MW, {_LEVEL} AS level FROM l
"""
SQL["energy_capacity"] = f"""WITH {_SYS}
SELECT Resource, round(sum(EndEnergyCap), 4) AS EndEnergyCap, CASE Resource WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 END AS level
FROM cap WHERE EndEnergyCap > 0 GROUP BY Resource
"""
SQL["literal_scenarios"] = """
SELECT s AS o_orderstatus, d AS until, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) FROM orders
  WHERE o_orderstatus = s AND o_orderdate <= CAST(d AS DATE)) AS total
FROM (VALUES ('F'), ('O'), ('P'), ('none')) a(s), (VALUES ('1995-01-01'), ('1999-01-01')) b(d)
"""
SQL["date_text_compare"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS approved FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-12-31'
"""

# --- files in order, workflows over files ---------------------------------------------
SQL["ordered_roundtrip"] = """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row, o_orderkey, o_totalprice FROM orders
"""
_TYPES = ("click", "error", "purchase", "signup", "view")
SQL["profile_file_to_grid"] = f"""
WITH g AS ({SQL["interpolate_linear"]})
SELECT row_number() OVER (ORDER BY ts) - 1 AS row, ts AS Datetime,
       {", ".join(f"first(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES)}
FROM g GROUP BY ts
"""
# the file's day profile has a row per minute that any day type has, counted from the first
_PROFILE = "         FROM evs GROUP BY 1, 2),\n"
SQL["net_load_files"] = SQL["net_load_5min"].replace("prof AS (", "prof0 AS (").replace(_PROFILE, _PROFILE + """prof AS (SELECT Time - (SELECT min(Time) FROM prof0) AS Time, w.Weekday, EV_load
         FROM (SELECT DISTINCT Time FROM prof0) CROSS JOIN (VALUES (true), (false)) w(Weekday) LEFT JOIN prof0 USING (Time, Weekday)),
""")
SQL["site_list"] = """
SELECT s_name AS site, CAST(s_suppkey AS INTEGER) AS capacity_kw, round(s_acctbal / 100, 4) AS lat, CAST(NULL AS DOUBLE) AS lon FROM supplier
"""
SQL["side_by_side"] = f"""WITH {_EV},
evs AS (SELECT {_CLOCK} AS clock, sum(value) AS e FROM ev WHERE event_type = 'click' GROUP BY Time_Index)
SELECT CAST(hour(clock) * 60 + minute(clock) AS INTEGER) AS Time,
       floor(CAST(sum(CAST(e AS DECIMAL(30, 2))) AS DOUBLE) / count(e) * 10000.0 + 0.5) / 10000.0 AS total, CASE WHEN dayofweek(clock) + 1 BETWEEN 2 AND 6 THEN 'Weekday' ELSE 'Weekend' END AS day
FROM evs GROUP BY 1, 3
"""
SQL["dg_sites_file"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 360 AS DOUBLE) END AS azimuth,
       CAST(o_orderkey % 60 AS DOUBLE) AS tilt, o_totalprice AS size_kw
FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) > DATE '1994-12-31'
"""
SQL["templates"] = """
WITH s AS (SELECT s_nationkey AS nation, list(s_suppkey ORDER BY s_suppkey) AS keys, max(s_acctbal) AS most FROM supplier GROUP BY 1),
r AS (SELECT nation, CAST(u.i - 1 AS INTEGER) AS i, keys[1:keys[u.i] % 3 + 1] AS cells
      FROM s, LATERAL (SELECT unnest(range(1, len(keys) + 1)) AS i) u WHERE nation % 2 = 0)
SELECT nation, 'nation' AS key, CAST(NULL AS INTEGER) AS i, CAST(NULL AS INTEGER) AS j, CAST(nation AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM s
UNION ALL SELECT nation, 'most', NULL, NULL, most, NULL FROM s WHERE nation % 2 = 0
UNION ALL SELECT nation, 'kind', NULL, NULL, NULL, 'even' FROM s WHERE nation % 2 = 0
UNION ALL SELECT nation, 'keys', CAST(i - 1 AS INTEGER), NULL, CAST(keys[i] AS DOUBLE), NULL
  FROM (SELECT nation, keys, unnest(range(1, len(keys) + 1)) AS i FROM s WHERE nation % 2 = 1)
UNION ALL SELECT nation, 'rows', i, CAST(j - 1 AS INTEGER), CAST(cells[j] AS DOUBLE), NULL
  FROM (SELECT nation, i, cells, unnest(range(1, len(cells) + 1)) AS j FROM r)
"""

# a reduced run: series of the representatives on every period of the horizon
_CASE = f"""{_SYS},
hp AS (SELECT (m.Period_Index - 1) * 288 + (x.Time_Index - 1) % 288 + 1 AS Time_Index, price
       FROM price x JOIN pmap m ON m.Rep_Period = (x.Time_Index - 1) // 288 + 1),
hs AS (SELECT (m.Period_Index - 1) * 288 + (x.Time_Index - 1) % 288 + 1 AS Time_Index, shdw
       FROM scar x JOIN pmap m ON m.Rep_Period = (x.Time_Index - 1) // 288 + 1),
hr AS (SELECT (m.Period_Index - 1) * 288 + (x.Time_Index - 1) % 288 + 1 AS Time_Index, Resource, value
       FROM res x JOIN pmap m ON m.Rep_Period = (x.Time_Index - 1) // 288 + 1)
"""
SQL["case_demand_price"] = f"""WITH {_CASE},
j AS (SELECT Load, price, shdw, {_CLOCK} AS clock FROM load LEFT JOIN hp USING (Time_Index) LEFT JOIN hs USING (Time_Index))
SELECT CAST(month(clock) AS INTEGER) AS month, CAST(hour(clock) AS INTEGER) AS hour,
       round(sum(Load), 4) AS demand, round(avg(price) * 12.0, 4) AS price, round(sum(shdw), 4) AS scarcity
FROM j GROUP BY 1, 2
"""
SQL["case_curtailment"] = f"""WITH {_CASE},
j AS (SELECT Resource, value, {_CLOCK} AS clock FROM hr)
SELECT CAST(month(clock) AS INTEGER) AS month, CAST(hour(clock) AS INTEGER) AS hour, round(sum(value) * (1.0 / 12.0), 4) AS total,
       round(sum(value) FILTER (WHERE Resource = 'click') * (1.0 / 12.0), 4) AS wind,
       round(sum(value) FILTER (WHERE Resource = 'view') * (1.0 / 12.0), 4) AS solar
FROM j GROUP BY 1, 2
"""
SQL["case_dispatch_week"] = f"""WITH {_CASE},
p AS (SELECT Rep_Period FROM pmap WHERE Rep_Period_Index = 3 AND Period_Index = Rep_Period),
bin AS (SELECT 2 * 288 + (r.Time_Index - 1) % 288 + 1 AS Time_Index, {_CLOCK.replace('Time_Index', 'r.Time_Index')} AS clock, r.Resource, r.value - coalesce(c.value, 0.0) AS net
        FROM res r LEFT JOIN chg c ON c.Time_Index = r.Time_Index AND c.Resource = r.Resource
        WHERE (r.Time_Index - 1) // 288 + 1 = (SELECT Rep_Period FROM p))
SELECT Time_Index, clock, Resource, round(net, 4) AS net FROM bin
WHERE Resource IN (SELECT Resource FROM cap GROUP BY 1 HAVING sum(EndCap) > 0)
"""
