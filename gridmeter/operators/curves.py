"""Turbine power curve lookup (T7, re-aimed from the wind-farm simulator).

One curve is a short literal (30 points), so its lookup is an array expression
on every row: count the knots at or below the speed, read the two neighbouring
knots, interpolate. No join and nothing broadcast beyond the literal itself.

Curves of many turbine types are a table of knots. Its lookup is a range join:
between two neighbouring knots lies a segment, segments and speeds are cut into
buckets, and a speed meets the few segments of its type and bucket by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.operators.keys import BROADCAST_GROUPS, attach
from gridmeter.session import checkpoint_dir

# Fixed values of the study's turbine template: wind speed (m/s) knots and
# the turbine's output (kW) at each knot; farm of 31 turbines, 139,500 kW
# system capacity in the template (the wind script runs it at 143,000 kW);
# loss percentages in the template's order (wake internal, external, future;
# availability balance-of-plant, grid, turbine; electrical efficiency,
# parasitic; environmental degradation, exposure, environmental, icing;
# operational environmental, grid, load, strategies; turbine generic,
# hysteresis, performance, specific).
CURVE_SPEEDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20,
                21, 22, 23, 24, 25, 26, 27, 28, 29, 30]
CURVE_KW = [0, 0, 0, 222, 444, 777, 1206, 1857, 2603, 3460, 4158, 4412, 4500, 4500, 4500, 4500, 4500, 4500,
            4380, 4238, 4063, 3873, 3666, 3444, 3285, 3047, 2857, 0, 0, 0]
TURBINES = 31
FARM_KW = 139500.0
LOSSES_PCT = [0, 1.1, 0, 0.5, 1.5, 1.58, 1.91, 0.1, 1.8, 0, 0.4, 0, 1, 0.84, 0, 0, 1.7, 0.4, 1.1, 0.81]


def _knots_at_or_below(speed: Column, knots: list[float], lo: int, hi: int) -> Column:
    """Number of sorted ``knots`` <= speed, as a balanced CASE tree over the
    literal knots (log2(n) comparisons, compiled by whole-stage codegen)."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(speed >= F.lit(knots[mid - 1]), _knots_at_or_below(speed, knots, mid, hi)).otherwise(
        _knots_at_or_below(speed, knots, lo, mid - 1)
    )


def curve_kw(speed: Column, speeds: Sequence[float] = CURVE_SPEEDS, kw: Sequence[float] = CURVE_KW,
             index: Column | None = None) -> Column:
    """One turbine's output at ``speed``: linear between knots, 0 below the
    first knot and above the last (cut-out). ``index`` is the number of knots
    at or below the speed, when already computed (see ``knot_index``)."""
    xs = F.array(*[F.lit(float(v)) for v in speeds])
    ys = F.array(*[F.lit(float(v)) for v in kw])
    n = len(speeds)
    i = index if index is not None else knot_index(speed, speeds)
    x0, x1 = F.element_at(xs, F.greatest(i, F.lit(1))), F.element_at(xs, F.least(i + 1, F.lit(n)))
    y0, y1 = F.element_at(ys, F.greatest(i, F.lit(1))), F.element_at(ys, F.least(i + 1, F.lit(n)))
    inside = (i >= 1) & (i < n)
    interp = y0 + (y1 - y0) * (speed - x0) / (x1 - x0)
    at_last = (i == n) & (speed == F.lit(float(speeds[-1])))
    return F.when(speed.isNull(), None).when(inside, interp).when(at_last, F.lit(float(kw[-1]))).otherwise(F.lit(0.0))


def knot_index(speed: Column, speeds: Sequence[float] = CURVE_SPEEDS) -> Column:
    """Number of curve knots at or below ``speed`` (0..n)."""
    return _knots_at_or_below(speed, [float(v) for v in speeds], 0, len(speeds))


def loss_factor(losses_pct: Sequence[float] = LOSSES_PCT) -> float:
    """Product of (1 - loss/100): our definition, no wake model."""
    f = 1.0
    for p in losses_pct:
        f *= 1.0 - p / 100.0
    return f


def power_curve(df: DataFrame, speed: str, turbines: int = TURBINES, cap_kw: float = FARM_KW,
                losses: Sequence[float] | None = None, out: str = "kw") -> DataFrame:
    """Farm output = min(turbines x curve(speed) [x losses], cap)."""
    s = F.col(speed).cast("double")
    # the knot index once per row, as its own column, then the interpolation
    df = df.withColumn("_gm_knot", knot_index(s))
    farm = curve_kw(s, index=F.col("_gm_knot")) * F.lit(float(turbines))
    if losses is not None:
        farm = farm * F.lit(loss_factor(losses))
    # ``least`` skips nulls: keep a missing speed missing instead of reading the cap
    return df.withColumn(out, F.when(farm.isNull(), None).otherwise(F.least(farm, F.lit(float(cap_kw))))).drop("_gm_knot")


def curve_segments(curves: DataFrame, by: Sequence[str], speed: str, kw: str, width: float) -> DataFrame:
    """The pieces of curves between neighbouring knots, a row per bucket that a
    piece touches: ``by``, ``_gm_b``, ends ``_gm_x0`` and ``_gm_x1``, outputs there
    ``_gm_y0`` and ``_gm_y1``. The last knot is a piece of its own, without end.
    Windows hold one curve's knots."""
    w = Window.partitionBy(*by).orderBy(speed)
    x, y = F.col(speed).cast("double"), F.col(kw).cast("double")
    seg = curves.select(*by, x.alias("_gm_x0"), y.alias("_gm_y0"), F.lead(x).over(w).alias("_gm_x1"), F.lead(y).over(w).alias("_gm_y1"))
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    return seg.withColumn("_gm_b", F.explode(F.sequence(bucket(F.col("_gm_x0")), bucket(F.coalesce("_gm_x1", "_gm_x0")))))


def curve_lookup(df: DataFrame, curves: DataFrame, by: Sequence[str], speed: str, curve_speed: str = "speed", curve_kw: str = "kw",
                 width: float = 1.0, out: str = "kw", broadcast_rows: int = BROADCAST_GROUPS, share: int = 5_000) -> DataFrame:
    """T7 for a table of curves (``by``, ``curve_speed``, ``curve_kw``; knots of a
    curve differ): ``df`` with ``out``, linear between the knots of the row's
    curve, 0 outside them; null without a speed or without a curve.

    ``width`` is a bucket's, best about the distance of knots: a row meets the
    pieces of its curve that touch its bucket. Pieces are counted: up to
    ``broadcast_rows`` are broadcast, so ``df`` doesn't move. Of more, those of types
    that hold over one in ``share`` of the rows are: such types are at most ``share``,
    their rows don't move either, and no key of the others' join is large. All other
    joins are told to merge: Spark's guess of a size doesn't count exploded rows, by
    which it would broadcast any number of pieces."""
    by = list(by)
    checkpoint_dir(df.sparkSession)
    pieces = curve_segments(curves, by, curve_speed, curve_kw, width).checkpoint(eager=True)
    renamed = {k: f"_gm_c{i}" for i, k in enumerate(by)}
    right = pieces.withColumnsRenamed(renamed)
    same = lambda names, mark: reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"{mark}{i}")) for i, k in enumerate(names)])
    s, x0, x1 = F.col("_gm_s"), F.col("_gm_x0"), F.col("_gm_x1")
    on = (F.col("_gm_rb") == F.col("_gm_b")) & (s >= x0) & ((s < x1) | (x1.isNull() & (s == x0))) & same(by, "_gm_c")

    def looked_up(rows: DataFrame, found: DataFrame) -> DataFrame:
        rows = rows.withColumn("_gm_s", F.col(speed).cast("double")).withColumn("_gm_rb", F.floor(F.col("_gm_s") / F.lit(float(width))).cast("long"))
        return rows.join(found, on, "left")

    if pieces.count() <= broadcast_rows:
        joined = looked_up(attach(df, curves.select(*by).distinct().withColumn("_gm_known", F.lit(True)), by, ["_gm_known"], how="left"), F.broadcast(right))
    else:
        held = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_gm_rows")).checkpoint(eager=True)
        total = held.agg(F.coalesce(F.sum("_gm_rows"), F.lit(0))).first()[0]
        hot = F.broadcast(held.where(F.col("_gm_rows") > total / share).select(*[F.col(f"`{k}`").alias(f"_gm_h{i}") for i, k in enumerate(by)]))
        known = curves.select(*[F.col(f"`{k}`").alias(f"_gm_k{i}") for i, k in enumerate(by)]).distinct().withColumn("_gm_known", F.lit(True))
        far = right.join(hot, same(list(renamed.values()), "_gm_h"), "left_semi")
        far = F.broadcast(far) if far.limit(broadcast_rows + 1).count() <= broadcast_rows else far.hint("merge")
        types = known.join(hot, same([f"_gm_k{i}" for i in range(len(by))], "_gm_h"), "left_semi")
        joined = looked_up(df.join(hot, same(by, "_gm_h"), "left_semi").join(F.broadcast(types), same(by, "_gm_k"), "left"), far)
        rest = df.join(hot, same(by, "_gm_h"), "left_anti").join(known.hint("merge"), same(by, "_gm_k"), "left")
        joined = joined.unionByName(looked_up(rest, right.hint("merge")))
    y0, y1 = F.col("_gm_y0"), F.col("_gm_y1")
    inside = F.when(x1.isNull(), y0).otherwise(y0 + (y1 - y0) * (s - x0) / (x1 - x0))
    value = F.when(F.col("_gm_known").isNull() | s.isNull(), None).otherwise(F.coalesce(inside, F.lit(0.0)))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], value.alias(out))
