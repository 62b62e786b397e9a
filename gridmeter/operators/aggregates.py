"""Aggregations and orderings.

All are hash aggregates with map-side partial aggregation, so a hot group is
pre-combined inside every task before the shuffle: a key holding a third of
the rows costs one partial row per task, not a third of the data in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.functions.time import floor_time
from gridmeter.operators.keys import attach
from gridmeter.operators.windows import cumsum


def month_hour_profile(df: DataFrame, ts: str, aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates by (month, hour of day) of ``ts``."""
    return df.groupBy(
        F.month(ts).alias("month"), F.hour(ts).alias("hour"), *by
    ).agg(*aggs)


def day_hour_profile(df: DataFrame, ts: str, aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """G4 on a finer calendar: aggregates by (day of month, hour of day)."""
    return df.groupBy(F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), *by).agg(*aggs)


def fleet_sum(df: DataFrame, ts: str, value: str, unit: str | None = None, out: str = "total") -> DataFrame:
    """Total over all sites per timestamp (optionally floored to ``unit``)."""
    t = floor_time(ts, unit).alias(ts) if unit else F.col(ts)
    return df.groupBy(t).agg(F.sum(value).alias(out))


def min_max_range(df: DataFrame, col: str) -> DataFrame:
    """``range(x)`` as one row (lo, hi)."""
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def sum_filtered(df: DataFrame, value: str, filters: Mapping[str, Column]) -> DataFrame:
    """Several filtered sums in one pass (``sum(x) FILTER (WHERE ...)``)."""
    return df.agg(*[F.sum(F.when(cond, F.col(value))).alias(name) for name, cond in filters.items()])


def rollup_total(
    df: DataFrame, key: str, measures: Sequence[str], total_label: str = "Total",
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per-key sums plus a ``Total`` row (``rollup`` + ``grouping``).

    ``extra`` maps other label columns to what they show on the total row
    (zone -> ``n/a``); on detail rows they keep their (single) value.
    """
    extra = dict(extra or {})
    aggs = [F.sum(m).alias(m) for m in measures] + [F.first(c).alias(f"_gm_{c}") for c in extra]
    r = df.rollup(key).agg(*aggs, F.grouping(key).alias("_gm_g"))
    is_total = F.col("_gm_g") == 1
    out = r.select(
        F.when(is_total, F.lit(total_label)).otherwise(F.col(key).cast("string")).alias(key),
        *[F.when(is_total, F.lit(lbl)).otherwise(F.col(f"_gm_{c}").cast("string")).alias(c) for c, lbl in extra.items()],
        *measures,
    )
    return out


def rollup_zone_pivot(df: DataFrame, row: str, zone: str, value: str, zones: Sequence[str], total: str = "Total") -> DataFrame:
    """Rows x (Total, one column per zone): the zone rollup and the pivot
    as one conditional aggregate - one pass, no join."""
    return df.groupBy(row).agg(
        F.sum(value).alias(total),
        *[F.sum(F.when(F.col(zone) == z, F.col(value))).alias(str(z)) for z in zones],
    )


def semi_join_built(df: DataFrame, capacity: DataFrame, key: str | Sequence[str], cap_col: str = "EndCap") -> DataFrame:
    """Rows whose resource has positive built capacity (``left_semi``)."""
    keys = [key] if isinstance(key, str) else list(key)
    built = capacity.where(F.col(cap_col) > 0).select(*keys)
    return df.join(built, keys, "left_semi")


def level_ranks(spark: SparkSession, levels: Sequence[str], reverse: bool = False) -> DataFrame:
    """A dimension table (``_gm_level``, ``_gm_rank``) of names in order, from 1."""
    n = len(levels)
    rows = [(lv, n - i if reverse else i + 1) for i, lv in enumerate(levels)]
    return spark.createDataFrame(rows, "_gm_level string, _gm_rank int")


def ranks_of(df: DataFrame, col: str) -> DataFrame:
    """The dimension of a column's own names in order: distinct names, numbered by
    the range-partitioned running count."""
    names = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_gm_level")).distinct().withColumn("_gm_one", F.lit(1))
    ranked = cumsum(names, "_gm_one", order=["_gm_level"], out="_gm_rank")
    return ranked.select("_gm_level", F.col("_gm_rank").cast("int").alias("_gm_rank"))


def order_levels(df: DataFrame, col: str, levels: Sequence[str] | DataFrame, rank: str = "level", reverse: bool = False) -> DataFrame:
    """Explicit category order as a rank column (R ``factor(levels=...)``,
    ``fct_rev``), joined in from a dimension of any number of names: a list, or a
    table of ``ranks_of``. Labels not in ``levels`` get a null rank and sort last;
    unused levels never appear (``fct_drop``), as no row of ``df`` is added."""
    dim = levels if isinstance(levels, DataFrame) else level_ranks(df.sparkSession, levels, reverse)
    dim = dim.select(F.col("_gm_level").alias(col), F.col("_gm_rank").alias("_gm_r"))
    # the names are the larger side only if they are many: then the join is salted
    return attach(df, dim, [col], ["_gm_r"], how="left").withColumnRenamed("_gm_r", rank)
