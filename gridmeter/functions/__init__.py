"""Scalar expressions (clock, numeric, labels); all are built-in Spark SQL."""

from gridmeter.functions.labels import concat_label, is_member, orientation, sign_by_membership
from gridmeter.functions.numeric import energy, kw_to_mw, log1p, no_limit, per_hour, signif, try_numeric
from gridmeter.functions.time import (
    Grid,
    days_since_epoch,
    floor_time,
    floor_to_grid,
    index_to_clock,
    minute_of_day,
    month_abbr,
    parse_date,
    parse_timestamp,
    period_index,
    step_in_period,
    step_index,
    time_of_day,
    ts_literal,
    weekday_flag,
)

__all__ = [
    "Grid", "concat_label", "days_since_epoch", "energy", "floor_time", "floor_to_grid",
    "index_to_clock", "is_member", "kw_to_mw", "log1p", "minute_of_day", "month_abbr",
    "no_limit", "orientation", "parse_date", "parse_timestamp", "per_hour", "period_index",
    "sign_by_membership", "signif", "step_in_period", "step_index", "time_of_day",
    "try_numeric", "ts_literal", "weekday_flag",
]
