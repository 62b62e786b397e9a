"""Clock and calendar expressions (date parsing, parts, step index <-> clock).

All functions return ``Column`` expressions built from Spark SQL built-ins, so
they stay inside whole-stage codegen. Timestamps may be ``timestamp`` or
``timestamp_ntz``; helpers that truncate keep the input type so results do
not depend on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_literal(value: str | datetime, ntz: bool = True) -> Column:
    """A timestamp literal; NTZ by default so it compares with NTZ columns."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz" if ntz else "timestamp")


@dataclass(frozen=True)
class Grid:
    """A regular time grid: step length, origin and period length in steps.

    ``Grid()`` is the study's 5-minute grid starting 2025-01-01 with weekly
    periods (2016 steps); every query passes its own.
    """

    step_minutes: int = 5
    base: str = "2025-01-01 00:00:00"
    steps_per_period: int = 2016

    @property
    def steps_per_hour(self) -> float:
        return 60.0 / self.step_minutes

    @property
    def step_micros(self) -> int:
        return self.step_minutes * 60 * 1_000_000


# --- X1 parse ---------------------------------------------------------------

def parse_timestamp(col: ColumnLike, fmt: str | None = None, ntz: bool = True) -> Column:
    """Text -> timestamp; unparseable text gives null (``try_to_timestamp``).

    ``fmt`` uses Spark datetime patterns, e.g. ``'M/d/yy H:mm'`` for the
    ``%D %R`` files.
    """
    c = _c(col)
    if fmt is None:
        parsed = F.try_to_timestamp(c)
    else:
        parsed = F.try_to_timestamp(c, F.lit(fmt))
    parsed = parsed.cast("timestamp_ntz") if ntz else parsed
    if fmt is not None and _two_digit_year(fmt):
        # Spark reads "yy" as 2000-2099; R/POSIX ``%y`` reads 69-99 as 1969-1999
        parsed = F.when(F.year(parsed) >= 2069, F.timestamp_add("YEAR", F.lit(-100), parsed)).otherwise(parsed)
    return parsed


def _two_digit_year(fmt: str) -> bool:
    import re

    return re.search(r"(?<!y)yy(?!y)", fmt) is not None


def parse_date(col: ColumnLike, fmt: str | None = None) -> Column:
    c = _c(col)
    return F.try_to_date(c) if fmt is None else F.try_to_date(c, fmt)


# --- X2-X5 parts ------------------------------------------------------------

def floor_time(ts: ColumnLike, unit: str) -> Column:
    """``date_trunc`` that keeps ``timestamp_ntz`` input as NTZ."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")


def month_abbr(ts: ColumnLike) -> Column:
    """Month label ``Jan`` ... ``Dec`` (R ``month(label=TRUE, abbr=TRUE)``)."""
    return F.date_format(_c(ts), "MMM")


def weekday_flag(ts: ColumnLike) -> Column:
    """True Monday..Friday. ``dayofweek`` is 1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(_c(ts)).between(2, 6)


def minute_of_day(ts: ColumnLike) -> Column:
    c = _c(ts)
    return F.hour(c) * 60 + F.minute(c)


def time_of_day(ts: ColumnLike) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


# --- X6 / X7 / T4 / T5 index arithmetic --------------------------------------

def step_index(ts: ColumnLike, grid: Grid, one_based: bool = True) -> Column:
    """Clock -> step number on ``grid`` (floor), 1-based like ``t1``."""
    diff = F.timestamp_diff("MICROSECOND", ts_literal(grid.base), _c(ts))
    idx = F.floor(diff / F.lit(grid.step_micros)).cast("long")
    return idx + 1 if one_based else idx


def index_to_clock(index: ColumnLike, grid: Grid, one_based: bool = True) -> Column:
    """Step number -> clock: ``base + step_minutes * (i - 1)``."""
    i = _c(index).cast("long")
    k = i - 1 if one_based else i
    return F.timestamp_add("MINUTE", k * grid.step_minutes, ts_literal(grid.base))


def floor_to_grid(ts: ColumnLike, grid: Grid) -> Column:
    """Clock rounded down onto ``grid``."""
    return index_to_clock(step_index(ts, grid, one_based=False), grid, one_based=False)


def period_index(index: ColumnLike, steps: int) -> Column:
    """1-based step -> 1-based period: ``(i - 1) div steps + 1``."""
    return F.floor((_c(index) - 1) / F.lit(steps)).cast("long") + 1


def step_in_period(index: ColumnLike, steps: int) -> Column:
    """1-based step -> 0-based position inside its period (``pmod``)."""
    return F.pmod(_c(index) - 1, F.lit(steps)).cast("long")


def days_since_epoch(d: ColumnLike) -> Column:
    """Date as a number of days (the numeric form of an R ``Date``)."""
    return F.datediff(F.to_date(_c(d)), F.lit("1970-01-01").cast("date"))
