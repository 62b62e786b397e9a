"""Statistics (M1-M4): grouped linear fits, exact quantiles, kernel density, ECDF.

Scale notes
* ``regr_*`` are one-pass algebraic aggregates with map-side partials.
* ``exact_quantiles`` never gathers a column in one buffer (which Spark's
  ``percentile`` does): it counts distinct values, ranks them with the
  range-partitioned ``cumsum`` and keeps the few rows that hold the target ranks.
* ``kernel_density`` bins the data linearly onto a grid of a few hundred points
  (an aggregate with at most that many rows per group) and convolves a group's
  bins with the Gaussian kernel by FFT: no row per pair of points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmeter.operators.keys import attach, join_groups
from gridmeter.operators.windows import cumsum


def grouped_linear_fit(df: DataFrame, y: str, x: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """M1: least-squares line per group (``lm(y ~ x * factor(g))`` is one
    independent line per level). Output ``(*by, slope, intercept, n)``."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y)
    aggs = [
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_count(yc, xc).alias("n"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def predict_linear(coef: DataFrame, xs: Sequence, x_name: str = "x", x_expr=None, out: str = "fit") -> DataFrame:
    """M2: evaluate each group's line at the given points.

    The points are the same for every group (S12's dates x orientations), so
    they are exploded from a literal array on the coefficient rows: a
    projection, not a join. ``x_expr`` maps the point column to the numeric x
    used in the fit (e.g. days since epoch).
    """
    pts = coef.withColumn(x_name, F.explode(F.array(*[F.lit(v) for v in xs])))
    xv = x_expr(F.col(x_name)) if x_expr is not None else F.col(x_name)
    return pts.withColumn(out, F.col("intercept") + F.col("slope") * xv)


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, col, _gm_c): non-null values with their multiplicity. A partial
    aggregate, so a hot value is combined inside every task; never larger
    than the input."""
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_gm_c"))


def ranked_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Value counts with their running count ``_gm_cum`` in value order (the
    skew-safe, checkpointed ``cumsum``): the one pass over the input that
    quantiles, ECDF and densities all read from."""
    return cumsum(value_counts(df, col, by), "_gm_c", order=[col], by=list(by), out="_gm_cum")


def _quantiles_from_ranked(ranked: DataFrame, col: str, probs: Sequence[float], keys: list[str]) -> DataFrame:
    totals = ranked.groupBy(*keys).agg(F.sum("_gm_c").alias("_gm_n"))
    j = attach(ranked, totals, keys, ["_gm_n"])
    lo_start = F.col("_gm_cum") - F.col("_gm_c")
    aggs, keep = [], None
    for i, p in enumerate(probs):
        h = (F.col("_gm_n") - 1) * F.lit(float(p))
        r_lo = F.floor(h)
        r_hi = F.least(r_lo + 1, F.col("_gm_n") - 1)
        has_lo = (lo_start <= r_lo) & (r_lo < F.col("_gm_cum"))
        has_hi = (lo_start <= r_hi) & (r_hi < F.col("_gm_cum"))
        j = j.withColumn(f"_gm_lo{i}", F.when(has_lo, F.col(col))).withColumn(f"_gm_hi{i}", F.when(has_hi, F.col(col)))
        j = j.withColumn(f"_gm_f{i}", h - r_lo)
        cond = has_lo | has_hi
        keep = cond if keep is None else keep | cond
        aggs += [F.max(f"_gm_lo{i}").alias(f"_gm_lo{i}"), F.max(f"_gm_hi{i}").alias(f"_gm_hi{i}"),
                 F.max(f"_gm_f{i}").alias(f"_gm_f{i}")]
    # at most 2 rows per probability and group survive the filter
    q = j.where(keep).groupBy(*keys).agg(*aggs)
    outs = [
        (F.col(f"_gm_lo{i}") + F.col(f"_gm_f{i}") * (F.col(f"_gm_hi{i}") - F.col(f"_gm_lo{i}"))).alias(f"q_{i}")
        for i in range(len(probs))
    ]
    return q.select(*keys, *outs)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Type-7 quantiles (R default, ``percentile``/``quantile_cont``), exactly.

    Output ``(*by, q_<i>)`` with one column per probability, in order.
    """
    keys = list(by)
    return _quantiles_from_ranked(ranked_counts(df, col, keys), col, probs, keys)


def _bandwidth_from_ranked(ranked: DataFrame, col: str, keys: list[str], adjust: float) -> DataFrame:
    """nrd0 from the value-count table: n, min, max, a two-pass sample
    variance over (value, count) pairs, and the exact IQR."""
    c, x = F.col("_gm_c"), F.col(col).cast("double")
    base = ranked.groupBy(*keys).agg(
        F.sum("_gm_c").alias("n"), F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"),
        (F.sum(c * x) / F.sum("_gm_c")).alias("_gm_mu"),
    ).where("n > 1")  # no spread, so no density, of a single value
    dev = attach(ranked, base, keys, ["n", "_gm_mu"]).groupBy(*keys).agg(
        F.sqrt(F.sum(c * (x - F.col("_gm_mu")) * (x - F.col("_gm_mu"))) / (F.first("n") - 1)).alias("_gm_sd")
    )
    j = join_groups(base, dev, keys, ["_gm_sd"])
    j = join_groups(j, _quantiles_from_ranked(ranked, col, [0.25, 0.75], keys), keys, ["q_0", "q_1"])
    return _nrd0(j, keys, adjust, first_abs=F.abs(F.col("lo")))


def _nrd0(j: DataFrame, keys: list[str], adjust: float, first_abs) -> DataFrame:
    iqr = (F.col("q_1") - F.col("q_0")) / F.lit(1.34)
    lo = F.least(F.col("_gm_sd"), iqr)
    # R's fall-backs; a zero spread means every value is equal, so |x[1]| = |min|
    spread = (
        F.when(lo > 0, lo)
        .when(F.col("_gm_sd") > 0, F.col("_gm_sd"))
        .when(first_abs > 0, first_abs)
        .otherwise(F.lit(1.0))
    )
    bw = F.lit(0.9 * adjust) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return j.select(*keys, "n", "lo", "hi", bw.alias("bw"))


def bandwidth_nrd0(df: DataFrame, col: str, by: Sequence[str] = (), adjust: float = 1.0,
                   approx_accuracy: int | None = None) -> DataFrame:
    """R's default bandwidth ``0.9 * min(sd, IQR / 1.34) * n^(-1/5)`` x ``adjust``,
    with R's fall-backs when the spread is 0. Output ``(*by, n, lo, hi, bw)``.

    The IQR is exact by default (value counts + running count, one pass over
    the input). ``approx_accuracy`` switches to one-pass ``percentile_approx``
    (relative rank error 1/accuracy) where a bandwidth to a few digits will do."""
    keys = list(by)
    if approx_accuracy:
        qs = F.percentile_approx(col, [0.25, 0.75], approx_accuracy)
        j = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(
            F.count(col).alias("n"), F.stddev_samp(col).alias("_gm_sd"), F.min(col).cast("double").alias("lo"),
            F.max(col).cast("double").alias("hi"), qs[0].alias("q_0"), qs[1].alias("q_1"),
        )
        return _nrd0(j, keys, adjust, first_abs=F.abs(F.col("lo")))
    return _bandwidth_from_ranked(ranked_counts(df, col, keys), col, keys, adjust)


def _grid_size(n: int) -> int:
    """Points of the grid on which data are binned: 512, or the power of two from n on."""
    return 512 if n <= 512 else 1 << (n - 1).bit_length()


def smoothed(bins: np.ndarray, weights: np.ndarray, lo: float, up: float, bw: float, m: int) -> np.ndarray:
    """Density at the ``m`` points from ``lo`` to ``up`` of the weights in bins, by
    FFT on a grid of twice the length, whose second half is empty so that nothing
    wraps around. The kernel stands at 2 m points over twice the range, as in R's
    ``density`` before 4.4."""
    y = np.zeros(2 * m)
    y[bins] = weights
    at = np.linspace(0.0, 2 * (up - lo), 2 * m)
    at[m + 1 :] = -at[m - 1 : 0 : -1]
    kernel = np.exp(-0.5 * (at / bw) ** 2) / (bw * math.sqrt(2 * math.pi))
    return np.maximum(np.fft.ifft(np.fft.fft(y) * np.conj(np.fft.fft(kernel))).real[:m], 0.0)


def _curves(counts: DataFrame, params: DataFrame, col: str, keys: list[str], n: int, ridge: bool) -> DataFrame:
    """Density curves of value counts; ``params`` has a row per group: ``n``, ``bw``
    and the ends of its points, ``_gm_from`` and ``_gm_to``."""
    m = _grid_size(n)
    pcols = ["n", "bw", "_gm_from", "_gm_to", "_gm_lo", "_gm_up"]
    # four bandwidths further on both sides, so that no kernel is cut off
    params = params.withColumns({"_gm_lo": F.col("_gm_from") - 4 * F.col("bw"), "_gm_up": F.col("_gm_to") + 4 * F.col("bw")})
    x = counts.select(*keys, F.col(col).cast("double").alias("_gm_x"), "_gm_c")
    xj = attach(x, params, keys, pcols)
    pos = (F.col("_gm_x") - F.col("_gm_lo")) / ((F.col("_gm_up") - F.col("_gm_lo")) / F.lit(m - 1))
    xj = xj.withColumn("_gm_pos", pos).withColumn("_gm_j", F.floor("_gm_pos").cast("int"))
    xj = xj.withColumn("_gm_fr", F.col("_gm_pos") - F.col("_gm_j"))
    c = F.col("_gm_c").cast("double")
    left = xj.select(*keys, "_gm_j", (c * (F.lit(1.0) - F.col("_gm_fr"))).alias("_gm_w"))
    right = xj.select(*keys, (F.col("_gm_j") + 1).alias("_gm_j"), (c * F.col("_gm_fr")).alias("_gm_w"))
    # at most a grid's points per group
    bins = left.unionByName(right).where(F.col("_gm_j").between(0, m - 1)).groupBy(*keys, "_gm_j").agg(F.sum("_gm_w").alias("_gm_w"))

    def curve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """All points of one group from its bins."""
        h = pdf.iloc[0]
        grid = np.linspace(h["_gm_lo"], h["_gm_up"], m)
        at = np.linspace(h["_gm_from"], h["_gm_to"], n)
        d = np.interp(at, grid, smoothed(pdf["_gm_j"].to_numpy(), pdf["_gm_w"].to_numpy() / h["n"], h["_gm_lo"], h["_gm_up"], h["bw"], m))
        made = {"i": np.arange(n, dtype="int32"), "x": at, "density": d}
        if ridge:
            share = np.append(0.0, np.cumsum(d[:-1] * np.diff(at)))
            made |= {"ndensity": d / d.max(), "ecdf": share, "tail": 0.5 - np.abs(0.5 - share)}
        return pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key, strict=True)}, **made})

    names = ["x", "density", "ndensity", "ecdf", "tail"] if ridge else ["x", "density"]
    schema = T.StructType([*[counts.schema[k] for k in keys], T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    return join_groups(bins, params, keys, pcols).groupBy(*keys).applyInPandas(curve, schema)


def kernel_density(
    df: DataFrame, col: str, by: Sequence[str] = (), adjust: float = 1.0, n: int = 512, domain: str = "cut", cut: float = 3.0,
    bw: DataFrame | None = None, approx_accuracy: int | None = None,
) -> DataFrame:
    """M3: Gaussian kernel density per group, as R's ``density`` gives it.

    The ``n`` points run, by ``domain``, from ``cut`` bandwidths below the least
    value to as many above the greatest (``"cut"``, the function's default), over
    the group's values (``"data"``), or over those of all groups (``"all"``); the
    latter two are what density plots evaluate. Values are split linearly between
    the two neighbouring points of a grid that reaches four bandwidths further, the
    grid is smoothed by FFT, and the curve is read off at the ``n`` points.
    Output ``(*by, i, x, density)``. Groups with a single value have no spread and
    are left out, as plotting does.

    The input is read once: everything (bandwidth, quantiles, bin weights)
    comes from its value-count table, weighted by multiplicity.
    """
    if domain not in ("cut", "data", "all"):
        raise ValueError("domain must be 'cut', 'data' or 'all'")
    keys = list(by)
    if approx_accuracy or bw is not None:
        counts = value_counts(df, col, keys)
        params = bw if bw is not None else bandwidth_nrd0(df, col, by=keys, adjust=adjust, approx_accuracy=approx_accuracy)
    else:
        counts = ranked_counts(df, col, keys)
        params = _bandwidth_from_ranked(counts, col, keys, adjust)
    if domain == "all":
        ends = counts.agg(F.min(col).cast("double").alias("_gm_from"), F.max(col).cast("double").alias("_gm_to"))
        params = attach(params, ends, [], ["_gm_from", "_gm_to"])
    else:
        reach = F.lit(cut if domain == "cut" else 0.0) * F.col("bw")
        params = params.withColumns({"_gm_from": F.col("lo") - reach, "_gm_to": F.col("hi") + reach})
    return _curves(counts, params, col, keys, n, ridge=False)


def density_ridges(df: DataFrame, col: str, by: Sequence[str], bandwidth: float | None = None, n: int = 512) -> DataFrame:
    """M4: a density curve per group, all with one bandwidth and on one range.

    The bandwidth is the mean of the groups' own ones (``nrd0``; groups of one
    value have none), unless it is given; the points reach three bandwidths
    beyond the values of all groups. Groups of fewer than three values have no
    curve. Output ``(*by, i, x, density, ndensity, ecdf, tail)``: the density, its
    share of the group's greatest, the integral of the curve up to x (left sums
    over the points) and the tail probability, 0.5 - |0.5 - ecdf|."""
    keys = list(by)
    counts = ranked_counts(df, col, keys)
    joint = _bandwidth_from_ranked(counts, col, keys, 1.0).agg(F.avg("bw").alias("bw")) if bandwidth is None else None
    ends = counts.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    groups = counts.groupBy(*keys).agg(F.sum("_gm_c").alias("n")).where("n > 2")
    params = attach(groups, ends, [], ["lo", "hi"])
    params = params.withColumn("bw", F.lit(float(bandwidth))) if joint is None else attach(params, joint, [], ["bw"])
    params = params.select(*keys, "n", "bw", (F.col("lo") - 3 * F.col("bw")).alias("_gm_from"), (F.col("hi") + 3 * F.col("bw")).alias("_gm_to"))
    return _curves(counts, params, col, keys, n, ridge=True)


def ecdf(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "ecdf") -> DataFrame:
    """M4: empirical CDF at each distinct value, ``count(x <= v) / n`` per group
    (``cume_dist``), via value counts + the skew-safe running sum; the group
    sizes come from the same checkpointed table."""
    keys = list(by)
    ranked = ranked_counts(df, col, keys)
    totals = ranked.groupBy(*keys).agg(F.sum("_gm_c").alias("_gm_n"))
    return attach(ranked, totals, keys, ["_gm_n"]).select(
        *keys, col, F.col("_gm_c").alias("n_at"), (F.col("_gm_cum") / F.col("_gm_n")).alias(out)
    )
