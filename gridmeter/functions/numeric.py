"""Numeric expressions: tolerant casts, significant-digit rounding, unit scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmeter.functions.time import ColumnLike, _c


def try_numeric(col: ColumnLike) -> Column:
    """Text -> double, null when it does not parse (R ``as.numeric``).

    ANSI mode is on in Spark 4, so a plain cast would fail the query on
    ``"N/A"``; ``try_cast`` keeps the row with a null instead.
    """
    return _c(col).try_cast("double")


def signif(col: ColumnLike, digits: int) -> Column:
    """Round to ``digits`` significant digits (R ``signif``).

    k = floor(log10|x|) - digits + 1; the value is scaled by 10^|k| the way
    that keeps the scale exact (multiply for k < 0, divide for k >= 0).
    """
    x = _c(col)
    k = F.floor(F.log10(F.abs(x))) - digits + 1
    scale = F.pow(F.lit(10.0), F.abs(k))
    up = F.round(x / scale) * scale
    down = F.round(x * scale) / scale
    return F.when(x.isNull(), None).when(x == 0, F.lit(0.0)).when(k >= 0, up).otherwise(down)


def per_hour(col: ColumnLike, steps_per_hour: float) -> Column:
    """Per-step quantity -> per-hour (e.g. price per 5-min step x 12)."""
    return _c(col) * F.lit(float(steps_per_hour))


def energy(col: ColumnLike, steps_per_hour: float) -> Column:
    """Power summed over steps -> energy (MW-steps / steps per hour = MWh)."""
    return _c(col) / F.lit(float(steps_per_hour))


def kw_to_mw(col: ColumnLike) -> Column:
    return _c(col) / F.lit(1000.0)


def log1p(col: ColumnLike) -> Column:
    return F.log1p(_c(col))


def no_limit(col: ColumnLike, sentinel: float = -1.0) -> Column:
    """Sentinel ``-1`` ("no limit") -> null."""
    c = _c(col)
    return F.when(c == F.lit(sentinel), None).otherwise(c)
