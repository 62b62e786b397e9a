"""Running sums and other order-dependent columns (W1-W4) without hot tasks.

A plain ``sum().over(partitionBy(g).orderBy(t))`` puts every row of a group
into one task; with one group holding a third of the rows that task holds a
third of the data. ``cumsum`` instead range-partitions on (group, order, tie),
which splits a hot group over many tasks, sums inside each task's slice and
then adds, per (task, group), the total of that group in earlier tasks.
Only the group that straddles a task border needs such an offset, so the offset
table has at most ``2 * partitions`` rows and is broadcast by a proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmeter.operators.keys import attach
from gridmeter.session import checkpoint_dir, shuffle_partitions

_PID = "_gm_pid"
_OFF = "_gm_off"
_TOT = "_gm_tot"


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


# bytes of input per task of the range sort, where that asks for more tasks
# than the session's shuffle partitions
TASK_BYTES = 128 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, where their size is known (estimates
    of later steps multiply joined sides, so they are no guide)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def sort_tasks(df: DataFrame) -> int:
    """Tasks of a range sort of ``df``: by the bytes it reads, at least the
    session's shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), min(100_000, input_bytes(df) // TASK_BYTES))


def sliced(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``keys``, which splits a hot group over many
    slices, with the slice of every row as ``_gm_pid``. It is checkpointed before
    it is read twice: range bounds come from a sample seeded per exchange, so two
    separately planned exchanges could disagree on them; stored ids cannot, and a
    lost executor re-reads the checkpoint instead of re-sampling."""
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(partitions or sort_tasks(df), *keys).withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True)


def _spanning(per_slice: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows (one per slice and group) of groups that lie in several slices: at
    most two per slice, as a slice can share its first and its last group only."""
    several = per_slice.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return per_slice.join(several, _null_safe_on(per_slice, several, by), "left_semi")


def _with_carried(rows: DataFrame, carried: DataFrame, keycols: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with what is carried into their slice and group, if anything is.
    The carried table has at most two rows a slice, so it is broadcast."""
    renamed = {c: f"_gm_k{i}" for i, c in enumerate(keycols)}
    small = F.broadcast(carried.select(*[F.col(c).alias(renamed[c]) for c in keycols], *columns))
    cond = None
    for c in keycols:
        e = rows[c].eqNullSafe(small[renamed[c]])
        cond = e if cond is None else cond & e
    return rows.join(small, cond, "left").drop(*renamed.values())


def neighbours(slices: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = (),
               before: str = "_gm_before", after: str = "_gm_after") -> DataFrame:
    """Structs of ``columns`` of the row before and after in ``order`` within each
    ``by`` group (W5), null at its ends: what ``lag`` and ``lead`` over the whole
    group give, without a task that holds the group.

    ``slices`` is a result of ``sliced``, or rows of one. Inside a slice a window
    finds the neighbours; the first and last rows of slices, a small table, carry
    them over the borders. Places in a group are unique."""
    by = list(by)
    here = F.struct(*columns)
    inside = Window.partitionBy(_PID, *by).orderBy(order)
    local = slices.select("*", F.lag(here).over(inside).alias(before), F.lead(here).over(inside).alias(after))
    edges = slices.groupBy(_PID, *by).agg(F.min_by(here, F.col(order)).alias("_gm_first"), F.max_by(here, F.col(order)).alias("_gm_last"))
    edges = _spanning(edges, by) if by else edges
    along = Window.partitionBy(*by).orderBy(_PID)
    carried = edges.select(_PID, *by, F.lag("_gm_last").over(along).alias("_gm_in"), F.lead("_gm_first").over(along).alias("_gm_out"))
    out = _with_carried(local, carried, [_PID, *by], ["_gm_in", "_gm_out"])
    out = out.withColumns({before: F.coalesce(before, "_gm_in"), after: F.coalesce(after, "_gm_out")})
    return out.drop("_gm_in", "_gm_out")


def cumsum(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    out: str = "cumsum",
    partitions: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` in ``order`` within each ``by`` group.

    ``order`` must end in a unique tie-break key for a deterministic result
    (rows with equal dates would otherwise sum in an arbitrary order, D16).
    Nulls in ``value`` count as 0. Integral input gives a ``long`` result,
    decimals stay exact, anything else is a ``double``. All other columns pass
    through unchanged; nothing leaves the JVM.
    """
    by, order = list(by), list(order)
    keys = by + order
    n = partitions or sort_tasks(df)
    vtype = df.schema[value].dataType
    if isinstance(vtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out_type = T.LongType()
    elif isinstance(vtype, T.DecimalType):
        out_type = T.DecimalType(38, vtype.scale)
    else:
        out_type = T.DoubleType()

    ranged = sliced(df, keys, n)
    amount = F.coalesce(F.col(value).cast(out_type), F.lit(0).cast(out_type))
    # a group's rows of one partition: never more than a range task's share
    inside = Window.partitionBy(_PID, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn(out, F.sum(amount).over(inside).cast(out_type))

    # Per (task, group) totals: partial aggregation keeps this at <= groups + tasks rows.
    totals = ranged.groupBy(_PID, *by).agg(F.sum(amount).cast(out_type).alias(_TOT))
    if by:
        totals = _spanning(totals, by)
        w = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    else:
        # one row per task: at most ``n`` rows in the single window partition
        w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *by, F.coalesce(F.sum(_TOT).over(w).cast(out_type), F.lit(0).cast(out_type)).alias(_OFF))
    joined = _with_carried(local, offsets, [_PID, *by], [_OFF])
    total = F.col(out) + F.coalesce(F.col(_OFF), F.lit(0).cast(out_type))
    return joined.select(*df.columns, total.cast(out_type).alias(out))


def offset_from_first(
    df: DataFrame, ts: str, by: Sequence[str] = (), unit: str = "MINUTE", out: str = "offset"
) -> DataFrame:
    """Time since the first row of each group (W4, ``Time - Time[1]``).

    The first timestamp is a group ``min`` (a partial aggregate attached to the
    rows without moving them by the group key), or a scalar subquery without
    groups; never a window that sorts a whole group in one task.
    """
    by = list(by)
    if not by:
        t0 = df.select(F.min(ts)).scalar()
        return df.withColumn(out, F.timestamp_diff(unit, t0, F.col(ts)))
    first = df.groupBy(*by).agg(F.min(ts).alias("_gm_first"))
    j = attach(df, first, by, ["_gm_first"], how="left")
    return j.select(*df.columns, F.timestamp_diff(unit, F.col("_gm_first"), F.col(ts)).alias(out))


def index_from_label(df: DataFrame, label: str, pattern: str = r"^t(\d+)$", out: str = "Time_Index") -> DataFrame:
    """Step number taken from a ``tN`` label (W3) instead of ``row_number``.

    Rows whose label does not match (metadata rows) are dropped.
    """
    idx = F.regexp_extract(F.col(label), pattern, 1)
    return df.where(F.col(label).rlike(pattern)).withColumn(out, idx.cast("long"))
