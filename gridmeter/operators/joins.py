"""Join helpers (J1-J8) with the join strategy stated, not left to chance.

``broadcast`` is only ever applied to inputs that were counted (a day profile
of 1440 minutes x 2 day types, a period map). Everything else is left to
Catalyst + AQE, which turn a shuffle join into a broadcast at run time when the
measured side is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridmeter.functions.time import minute_of_day, weekday_flag
from gridmeter.operators.keys import broadcast_small, require_unique

# most rows a day profile can have: one per minute for each of two day types
DAY_PROFILE_MAX_ROWS = 24 * 60 * 2


def left_join_chain(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """``left_join(a) %>% left_join(b) ...`` on explicit shared keys.

    All inputs are keyed by the same step index, so Spark hash-partitions each
    side once on ``on`` and the chained joins reuse that partitioning.
    """
    out = base
    for o in others:
        out = out.join(o, list(on), "left")
    return out


def inner_join_chain(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner-join several step series on the step index."""
    out = base
    for o in others:
        out = out.join(o, list(on), "inner")
    return out


def join_day_profile(
    series: DataFrame, ts: str, profile: DataFrame, minutes: str = "Time", flag: str = "Weekday"
) -> DataFrame:
    """Series x day profile on (minute of day, weekday flag).

    A profile has one row per (minute, day type); repeated keys raise an error,
    as they would multiply the series. It is counted, and broadcast if it has at
    most ``DAY_PROFILE_MAX_ROWS`` rows, so that the year-long series is not
    shuffled; a larger one is joined as Spark decides.
    """
    s = series.withColumn(minutes, minute_of_day(ts)).withColumn(flag, weekday_flag(ts))
    bounded = require_unique(profile, [minutes, flag], "the day profile")
    return s.join(broadcast_small(bounded, DAY_PROFILE_MAX_ROWS), [minutes, flag], "inner")


def right_join_keep_all(facts: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keep every dimension row, matched or not (``right_join``)."""
    return facts.join(dim, key, "right")
