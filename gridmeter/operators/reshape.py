"""Wide <-> long reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_all_but(df: DataFrame, ids: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """R1 ``pivot_longer(cols = -ids)``: every other column becomes (name, value).

    Columns are cast to double first so mixed numeric types can share one
    value column. A pure projection + ``Expand``: no shuffle.
    """
    ids = list(ids)
    vals = [c for c in df.columns if c not in ids]
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in vals])
    return casted.unpivot(ids, vals, name, value)


def pivot_wider(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, names: Sequence[str] | None = None
) -> DataFrame:
    """R2 ``pivot_wider``: one column per distinct ``names_from``.

    Pass ``names`` whenever they are known: without them Spark runs an extra
    job to collect the distinct names (bounded only by the data).
    """
    g = df.groupBy(*ids)
    p = g.pivot(names_from, list(names)) if names is not None else g.pivot(names_from)
    return p.agg(F.first(values_from, ignorenulls=True))


def name_to_flag(df: DataFrame, col: str, true_label: str, out: str | None = None) -> DataFrame:
    """Label column -> boolean (``Weekday == "Weekday"``)."""
    return df.withColumn(out or col, F.col(col) == F.lit(true_label))


def matrix_to_rows(df: DataFrame, arrays: Sequence[str], index: str = "pos") -> DataFrame:
    """Parallel arrays (e.g. curve speeds and powers) -> one row per
    position: ``posexplode(arrays_zip(...))``."""
    arrays = list(arrays)
    keep = [c for c in df.columns if c not in arrays]
    z = df.select(*keep, F.posexplode(F.arrays_zip(*[F.col(a) for a in arrays])).alias(index, "_gm_z"))
    return z.select(*keep, index, *[F.col("_gm_z")[a].alias(a) for a in arrays])


def net_of_charge(
    gen: DataFrame, charge: DataFrame, keys: Sequence[str], value: str = "value", out: str = "net"
) -> DataFrame:
    """Net output = discharge - charge per (step, resource), in long form.

    The charge side's value is suffixed ``_c`` (dplyr ``suffix = c("", "_c")``);
    a missing charge counts as 0 (fixes D1, which subtracted a column from itself).
    """
    c = charge.select(*keys, F.col(value).alias(f"{value}_c"))
    j = gen.join(c, list(keys), "left")
    return j.withColumn(out, F.col(value) - F.coalesce(F.col(f"{value}_c"), F.lit(0.0)))


def row_total(df: DataFrame, cols: Sequence[str], out: str = "total") -> DataFrame:
    """Sum across named columns of a row (nulls count as 0)."""
    expr = None
    for c in cols:
        e = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        expr = e if expr is None else expr + e
    return df.withColumn(out, expr)


def union_sources(frames: Sequence[DataFrame], label: str | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """Stack same-shaped tables by column name, optionally tagging each."""
    out = None
    for i, f in enumerate(frames):
        if label is not None:
            f = f.withColumn(label, F.lit(labels[i] if labels else str(i)))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
