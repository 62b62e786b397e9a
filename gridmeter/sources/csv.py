"""CSV readers and writers with declared schemas.

Every reader takes an explicit schema or column list: no inference pass over
the data. Nulls spelled ``-``, ``n/a`` or empty become null; numeric text
that does not parse becomes null through ``try_cast`` (ANSI mode stays on).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmeter.functions.time import parse_timestamp
from gridmeter.operators.windows import sliced

NULL_SPELLINGS = ("-", "n/a", "NA", "")


def _null_to_none(df: DataFrame, cols: Sequence[str], spellings: Sequence[str] = NULL_SPELLINGS) -> DataFrame:
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.trim(F.col(c)).isin(list(spellings)), None).otherwise(F.col(c)))
    return out


def read_csv_typed(
    spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str], ts_format: str | None = None,
    null_spellings: Sequence[str] = NULL_SPELLINGS,
) -> DataFrame:
    """Header CSV -> typed columns by name.

    Text is read as strings, trimmed header names are matched to ``types``
    (``double``, ``int``, ``long``, ``string``, ``timestamp``, ``date``,
    ``boolean``), and each column is converted with a tolerant cast.
    Timestamps use ``ts_format`` (Spark pattern). Unlisted columns are kept as text.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return _typed(raw.toDF(*[c.strip() for c in raw.columns]), types, ts_format, null_spellings)


def _typed(raw: DataFrame, types: Mapping[str, str], ts_format: str | None, null_spellings: Sequence[str]) -> DataFrame:
    """Text columns cast to ``types``; ``""`` leaves a column as it is."""
    raw = _null_to_none(raw, [c for c in raw.columns if types.get(c) != ""], null_spellings)
    cols = []
    for c in raw.columns:
        t = types.get(c)
        if t in (None, "", "string"):
            cols.append(F.col(c))
        elif t == "timestamp":
            cols.append(parse_timestamp(F.trim(F.col(c)), ts_format).alias(c))
        elif t == "date":
            cols.append(F.try_to_date(F.trim(F.col(c))).alias(c))
        elif t == "boolean":
            cols.append(F.upper(F.trim(F.col(c))).isin("TRUE", "T", "1").alias(c))
        else:
            cols.append(F.trim(F.col(c)).try_cast(t).alias(c))
    return raw.select(*cols)


def read_time_indexed(
    spark: SparkSession, path: str | Sequence[str], ts_col: str, ts_format: str | None, value_cols: Sequence[str] | None = None,
) -> DataFrame:
    """CSV whose ``ts_col`` is the time index; other columns are doubles."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    vals = list(value_cols) if value_cols is not None else [c for c in raw.columns if c != ts_col]
    types = {ts_col: "timestamp", **{v: "double" for v in vals}}
    return read_csv_typed(spark, path, types, ts_format).select(ts_col, *vals)


def read_by_position(spark: SparkSession, path: str | Sequence[str], names: Mapping[int, tuple[str, str]]) -> DataFrame:
    """Pick columns by position (0-based) -> (new name, type).

    For files whose header names are unusable (spaces, repeats, two tables
    side by side separated by an empty column)."""
    raw = spark.read.option("header", True).csv(path)
    cols = raw.columns
    out = []
    for pos, (name, t) in sorted(names.items()):
        c = F.trim(F.col(f"`{cols[pos]}`"))
        out.append((c if t == "string" else c.try_cast(t)).alias(name))
    return raw.select(*out)


def read_side_by_side(
    spark: SparkSession, path: str, blocks: Sequence[tuple[str, Mapping[int, tuple[str, str]]]], label: str = "block"
) -> DataFrame:
    """S9 + U2: one CSV holding several same-shaped tables next to each other
    -> one long table with a ``label`` column naming the block."""
    out = None
    for name, cols in blocks:
        part = read_by_position(spark, path, cols).withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mangle_names(df: DataFrame) -> DataFrame:
    """Base-R ``read.csv`` names: every character that a name can't have
    becomes ``.``, a name that can't start so gets an ``X``, and repeats get
    ``.1``, ``.2``, ..."""
    made, seen = [], set()
    for c in df.columns:
        name = re.sub(r"[^0-9A-Za-z_.]", ".", c.strip())
        if not re.match(r"[A-Za-z]|\.(?![0-9])", name):
            name = "X" + name
        unique, n = name, 0
        while unique in seen:
            n += 1
            unique = f"{name}.{n}"
        seen.add(unique)
        made.append(unique)
    return df.toDF(*made)


def file_path() -> Column:
    """The path of a row's file as it was given: ``_metadata`` holds it URL-
    encoded, where a plus sign stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_skip_meta(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, first_numeric: str | None = None,
    site_from_path: str | None = r"([^/]+)\.csv$", site_col: str = "site", years: tuple[int, int] | None = (1900, 2100),
) -> DataFrame:
    """Time-series CSVs with metadata lines above the data (weather
    downloads). Lines are parsed positionally with ``schema``; rows whose
    first field is not a year (``years``; None: any number) are metadata and dropped. The site id comes
    from the file name (``_metadata.file_path``), so many files read in one scan.
    """
    str_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = spark.read.schema(str_schema).option("header", False).option("mode", "PERMISSIVE").csv(path)
    key = first_numeric or schema.fields[0].name
    first = F.trim(F.col(key)).try_cast("double")
    is_data = first.isNotNull() if years is None else first.between(*years) & (first == F.floor(first))
    data = raw.where(is_data)
    cols = [F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    if site_from_path:
        cols.append(F.regexp_extract(file_path(), site_from_path, 1).alias(site_col))
    return data.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """K1: CSV with a header and no index column (a time index is an ordinary
    first column; ``write_ordered_csv`` keeps its order). ``single_file``
    coalesces to one part - only for small report tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_ordered_csv(df: DataFrame, path: str, order: Sequence[str], partitions: int | None = None, keep: Sequence[str] | None = None) -> None:
    """K2: CSV files in the total order of ``order``. Rows are range-partitioned
    and sorted within files, whose part numbers follow the order; no task gets the
    whole table. ``keep`` are the columns written (default: all). Beside the files ``_manifest`` (not a data file to readers of the
    folder) has a row per file: its name, its place, its rows and the rows before."""
    slices = sliced(df, order, partitions)
    slices.sortWithinPartitions(*order).select(*(keep or df.columns)).write.mode("overwrite").option("header", True).csv(path)
    counts = slices.groupBy(F.col("_gm_pid").alias("place")).agg(F.count(F.lit(1)).alias("rows"))
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(file_name(F.col("path")).alias("file"))
    files = files.withColumn("place", F.regexp_extract("file", r"^part-(\d+)", 1).cast("int"))
    # a row per file
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(files, "place").withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    placed.select("file", "place", "rows", "start").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def read_ordered_csv(spark: SparkSession, path: str, types: Mapping[str, str], ts_format: str | None = None, row: str = "row") -> DataFrame:
    """The table that ``write_ordered_csv`` has written, with each row's place in
    the whole order (``row``, from 0): the rows of the files before, of the file's
    earlier splits, and its place in its own. No sort is needed to know it. A file
    that lacks rows, or a missing one, stops the query."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    raw = raw.select("*", file_name(file_path()).alias("_gm_f"), F.col("_metadata.file_block_start").alias("_gm_s"), F.monotonically_increasing_id().alias("_gm_id"))
    splits = raw.groupBy("_gm_f", "_gm_s").agg(F.min("_gm_id").alias("_gm_least"), F.count(F.lit(1)).alias("_gm_n"))
    # a row per split, a window per file
    along = Window.partitionBy("_gm_f").orderBy("_gm_s")
    splits = splits.withColumn("_gm_b", F.coalesce(F.sum("_gm_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = splits.withColumn("_gm_rows", F.sum("_gm_n").over(Window.partitionBy("_gm_f")))
    manifest = spark.read.parquet(f"{path.rstrip('/')}/_manifest").select(F.col("file").alias("_gm_f"), "rows", "start")
    whole = manifest.join(splits, "_gm_f", "left")
    # a file that lacks rows, if any: a row per split, in one small window, so that every row of the table knows it
    lacking = F.max(F.when(~F.col("_gm_rows").eqNullSafe(F.col("rows")), F.col("_gm_f"))).over(Window.partitionBy())
    told = F.raise_error(F.concat(F.lit("rows are missing of "), F.col("_gm_lacking"))).cast("boolean")
    whole = whole.withColumn("_gm_lacking", lacking).where(F.when(F.col("_gm_lacking").isNull(), F.lit(True)).otherwise(told))
    offsets = whole.select("_gm_f", "_gm_s", (F.col("start") + F.col("_gm_b") - F.col("_gm_least")).alias("_gm_o"))
    placed = raw.join(offsets, ["_gm_f", "_gm_s"]).withColumn(row, F.col("_gm_o") + F.col("_gm_id"))
    return _typed(placed.drop("_gm_f", "_gm_s", "_gm_o", "_gm_id"), {**types, row: ""}, ts_format, NULL_SPELLINGS)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Intermediate results: Parquet, optionally partitioned (e.g. by sim/run)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
