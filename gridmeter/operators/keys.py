"""Attaching per-group values without keyless joins and without moving the
input by a hot group key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.session import checkpoint_dir

# A per-group table of up to so many rows is broadcast (its rows are a few
# numbers: under 100 MB); a larger one is joined by a salted shuffle.
BROADCAST_GROUPS = 500_000
SALTS = 64


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` grouped by its keys; a key with several rows stops the query, as a
    join on it would multiply what it settles. The check is a part of the plan:
    it starts no job, and the join that follows uses its grouping."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gm_n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in rest])
    told = F.raise_error(F.concat(F.lit(f"{what} has several rows for "), F.to_json(F.struct(*keys)))).cast("boolean")
    return once.where(F.when(F.col("_gm_n") == 1, F.lit(True)).otherwise(told)).select(*[F.col(f"`{c}`") for c in df.columns])


def broadcast_small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (no more are
    read to tell), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_groups(groups: DataFrame, more: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-group tables (one row per group on both sides, so no key is
    large). Null keys match each other. Without keys both have one row, and the
    second is read as a scalar subquery."""
    keys, cols = list(keys), list(cols)
    if keys:
        renamed = [f"_gm_a{i}" for i in range(len(keys))]
        right, on = more.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed, strict=True)], *cols), None
        for k, r in zip(keys, renamed, strict=True):
            same = F.col(f"`{k}`").eqNullSafe(F.col(r))
            on = same if on is None else on & same
        return groups.join(right, on, how).drop(*renamed)
    return attach(groups, more, keys, cols, how)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "inner",
           broadcast_groups: int = BROADCAST_GROUPS, salts: int = SALTS) -> DataFrame:
    """Add ``cols`` of a per-group table (one row per group) to ``df``. Null keys
    match each other.

    With group keys the table is materialised and counted. Up to
    ``broadcast_groups`` rows it is broadcast, so the input does not move. With
    more groups it is repeated ``salts`` times and the input joins on (key,
    salt), which cuts a group that holds a third of the rows into ``salts``
    parts. Without groups the table has one row and is read as a single scalar
    subquery holding a struct, so the plan never has a keyless join.
    """
    keys, cols = list(keys), list(cols)
    if keys:
        checkpoint_dir(df.sparkSession)
        renamed = [f"_gm_a{i}" for i in range(len(keys))]
        table = small.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed, strict=True)], *cols).checkpoint(eager=True)
        if table.count() <= broadcast_groups:
            left, right, on = df, F.broadcast(table), None
        else:
            # the salt is fixed by the row, so a task that runs again deals the same rows
            left = df.withColumn("_gm_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int"))
            # Spark's guess of a size doesn't count the repeats: it would broadcast them
            right = table.withColumn("_gm_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
            on = F.col("_gm_salt") == F.col("_gm_s")
        for k, r in zip(keys, renamed, strict=True):
            same = F.col(f"`{k}`").eqNullSafe(F.col(r))
            on = same if on is None else on & same
        joined = left.join(right, on, how)
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], *cols)
    s = small.select(F.struct(*[F.col(c) for c in cols]).alias("_gm_s")).scalar()
    # one subquery column, fields read from it: the subquery appears once in
    # the plan instead of once per field (nested attaches would multiply it)
    with_s = df.withColumn("_gm_s", s)
    return with_s.select(*[F.col(c) for c in df.columns], *[F.col("_gm_s")[c].alias(c) for c in cols])
