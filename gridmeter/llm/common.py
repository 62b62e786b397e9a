"""Shared pieces of the training-data operators: shared-folder tables, row
payloads, small-table joins and two-pass prefix sums.

Row handling is the same in every operator. The caller's columns travel in one
struct (``_row``), so an input column may have any name, also one an operator
makes itself; on output the operator's columns win and a clashing input column
is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmeter.session import checkpoint_dir

ROW = "_row"
# white space as the contracts define it: blank and tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    later steps survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` has written and no later step reads: what was
    made of them is stored itself. Other frames are left alone."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        jvm = getattr(t.sparkSession, "_jvm", None) if path else None
        if jvm:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The input row as one struct beside the given working columns."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW), *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, made: Sequence[str]) -> DataFrame:
    """The input columns again, and after them the columns ``made`` here."""
    fields = df.schema[ROW].dataType.names
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in fields if c not in made], *made)


def free_names(df: DataFrame, count: int) -> list[str]:
    """Names for working columns that ``df`` doesn't have, in any case of letters."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < count:
        if f"_x{i}" not in taken:
            out.append(f"_x{i}")
        i += 1
    return out


def n_words(text: Column) -> Column:
    """Number of maximal runs without blanks, tabs or line ends; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int, share: int = 5_000) -> DataFrame:
    """Left join on a key that may be very frequent in ``left``.

    ``right`` is a stored table with one row per key; ``weight`` tells how many
    rows of ``left`` carry the key and ``total`` their sum. Keys that hold more
    than one in ``share`` of all rows are at most ``share`` in number: they are
    broadcast, so none of their rows moves. All other keys are joined by a
    shuffle in which no key is large.
    """
    keys = list(keys)
    heavy = max(1_000, total // share)
    hot = F.broadcast(right.where(F.col(weight) > heavy))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(weight) <= heavy), keys, "left")
    return left.join(hot, keys).unionByName(rest)


def bucket_count(rows: Column, target: int = 2_000, most: int = 4_096) -> Column:
    """Buckets into which a group of so many rows is cut for a prefix sum."""
    return F.least(F.lit(most), F.ceil(rows / F.lit(float(target)))).cast("int")


def prefix_sums(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same ``keys``, in the order
    (``bucket``, ``order``), where buckets are small cuts of that order.

    Two passes: totals of buckets, whose running sums are a small table; then a
    window inside each bucket. No task gets all rows of a key.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_offset")
    )


def clean_source(col: Column) -> tuple[Column, Column]:
    """A nullable string as two columns without nulls, in code point order, null last."""
    return col.isNull().cast("int"), F.coalesce(col, F.lit(""))


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``_index``, its gapless place in the order of ``keys``: range-
    sorted and stored once, then each row's place in its partition plus the rows
    of the partitions before it (one broadcast row per partition)."""
    sort = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    sort = stored(sort, name)
    part = F.shiftright("_mid", 33).alias("_part")
    sizes = sort.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    place = F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1)
    return sort.withColumn("_part", part).join(offsets, "_part").withColumn("_index", place).drop("_part", "_offset", "_mid")


def without(docs: DataFrame, marks: DataFrame, id_: Column, sum_: Column, broadcast_rows: int) -> DataFrame:
    """Rows of ``docs`` whose mark keeps them. ``marks``, a stored table, has a row
    for each of them: ``_id``, ``_sum`` (hash of the text), ``keeps``. Of rows that
    repeat id and text, where one is to be kept, one stays. Up to
    ``broadcast_rows`` dropped rows (under 100 MB) are broadcast, more are joined
    by a shuffle."""
    pairs = marks.groupBy("_id", "_sum").agg(F.max("keeps").alias("_some"), F.min("keeps").alias("_all"))
    pairs = stored(pairs.where("not _all").select(F.col("_id").alias("_gone"), F.col("_sum").alias("_gone_sum"), "_some"), "gone")
    gone, twice = pairs.where("not _some"), pairs.where("_some")
    rows = packed(docs, _id=id_, _sum=sum_)

    def match(side: DataFrame) -> tuple[DataFrame, Column]:
        side = F.broadcast(side) if is_small(side, broadcast_rows) else side
        return side, rows["_id"].eqNullSafe(side["_gone"]) & (rows["_sum"] == side["_gone_sum"])

    left = rows.join(*match(gone), "left_anti")
    if not twice.isEmpty():
        side, on = match(twice)
        left = left.join(side, on, "left_anti").unionByName(left.join(side, on, "left_semi").dropDuplicates(["_id", "_sum"]))
    return left.select(f"{ROW}.*")
