"""Readers for planning-run result folders (S5-S7) and templates.

Result files are "wide": the first column holds a label (``Zone``,
``AnnualSum``, ``t1`` ... ``tN``), every other column is a resource or zone.
Rows are kept by their label (``^t\\d+$``), never by position, so files with
0, 1 or 2 metadata rows read the same way (fixes D3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.operators.keys import attach
from gridmeter.sources.csv import NULL_SPELLINGS, file_path

STEP_LABEL = r"^t(\d+)$"
# run tree layout: .../<sim folder>/<results folder>/<file>.csv
RUN_PATTERN = r"/([^/]+)/([^/]+)/[^/]+$"


# commas outside quotes
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# most files whose header lines are broadcast
HEADER_FILES = 20_000


def _fields(line: Column) -> Column:
    """The fields of a CSV line, without their quotes."""
    quoted = F.transform(F.split(line, _COMMA), lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), '""', '"'))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def _names(header: Column) -> Column:
    """Column names as Spark's CSV reader makes them: an empty one is ``_c`` and its
    place, one that repeats (in any case of letters) gets its place at its end."""
    lower = F.transform(header, lambda x: F.lower(x))

    def name(x: Column, i: Column) -> Column:
        times = F.size(F.filter(lower, lambda y: y == F.lower(x)))
        return F.when(F.trim(x) == "", F.concat(F.lit("_c"), i)).when(times > 1, F.concat(x, i)).otherwise(x)

    return F.transform(header, name)


def scan_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``names`` and ``fields`` of every line of CSV files that may all
    have columns of their own: each line meets the header line of its file in a
    join, so files of any number of layouts are one scan of splittable text, and
    no header goes to the driver. Fields don't hold line ends."""
    lines = spark.read.text(path).select(
        file_path().alias("file"), F.col("_metadata.file_block_start").alias("_gm_s"), F.monotonically_increasing_id().alias("_gm_at"), "value")
    heads = lines.where("_gm_s = 0").groupBy("file").agg(F.min_by("value", "_gm_at").alias("_gm_h"))
    heads = heads.select("file", F.regexp_replace("_gm_h", "^\ufeff", "").alias("_gm_h"))
    # names are made once a file
    heads = heads.withColumn("names", _names(_fields(F.col("_gm_h"))))
    if len(lines.inputFiles()) <= HEADER_FILES:
        both = lines.join(F.broadcast(heads), "file")
    else:
        both = attach(lines, heads, ["file"], ["_gm_h", "names"], broadcast_groups=HEADER_FILES)
    # its own header is no row of a file
    rows = both.where((F.col("_gm_s") > 0) | (F.regexp_replace("value", "^\ufeff", "") != F.col("_gm_h")))
    return rows.select("file", "names", _fields(F.col("value")).alias("fields"))


def scan_solver_wide(
    spark: SparkSession, path: str | Sequence[str], label_col: int = 0, id_cols: Sequence[str] = (),
    name: str = "name", value: str = "value", with_run: bool = False,
) -> DataFrame:
    """S5 (+ S7 with ``with_run``): wide step tables -> ``(Time_Index, name, value)``
    [+ ``sim``, ``run`` parsed from the file path]. Each file is read by its own
    names (``scan_lines``), however many layouts there are."""
    label = F.trim(F.get("fields", F.lit(label_col)))
    rows = scan_lines(spark, path).where(label.rlike(STEP_LABEL))
    ids = [F.regexp_extract(label, STEP_LABEL, 1).try_cast("long").alias("Time_Index")]
    if with_run:
        ids += [F.regexp_extract("file", RUN_PATTERN, i + 1).alias(c) for i, c in enumerate(("sim", "run"))]
    cells = rows.select(*ids, F.posexplode(F.arrays_zip("names", "fields")).alias("_gm_i", "_gm_x"))
    kept = (F.col("_gm_i") != label_col) & F.col("_gm_x.names").isNotNull() & ~F.col("_gm_x.names").isin(list(id_cols))
    made = ["Time_Index", *(("sim", "run") if with_run else ())]
    return cells.where(kept).select(*made, F.col("_gm_x.names").alias(name), F.trim(F.col("_gm_x.fields")).try_cast("double").alias(value))


def scan_solver_meta(spark: SparkSession, path: str | Sequence[str], row_label: str, label_col: int = 0) -> DataFrame:
    """The metadata row ``row_label`` (``Zone`` / ``AnnualSum``) as ``(name, value)``."""
    raw = spark.read.option("header", True).csv(path)
    cols = raw.columns
    label = cols[label_col]
    vals = [c for i, c in enumerate(cols) if i != label_col]
    row = raw.where(F.trim(F.col(f"`{label}`")) == row_label).select(
        *[F.trim(F.col(f"`{c}`")).alias(c) for c in vals]
    )
    return row.unpivot([], vals, "name", "value")


def scan_result_report(
    spark: SparkSession, path: str | Sequence[str], text_cols: Sequence[str] = ("Resource", "Zone", "Region", "region",
                                                                           "zone", "Costs", "Status"),
) -> DataFrame:
    """Small report tables; every column not named in ``text_cols`` is a
    double (``-`` / ``n/a`` / empty -> null, Julia exponent form parses)."""
    raw = spark.read.option("header", True).csv(path)
    out = []
    for c in raw.columns:
        col = F.trim(F.col(f"`{c}`"))
        col = F.when(col.isin(list(NULL_SPELLINGS)), None).otherwise(col)
        out.append((col if c.strip() in text_cols else col.try_cast("double")).alias(c.strip()))
    return raw.select(*out)


def scan_run_tree(spark: SparkSession, root: str, file_name: str, **kw) -> DataFrame:
    """The same result file across every run folder under ``root``:
    ``sim`` / ``run`` come from the path; runs may have different resources."""
    return scan_solver_wide(spark, f"{root.rstrip('/')}/*/*/{file_name}", with_run=True, **kw)


def scan_json_template(spark: SparkSession, path: str, drop: Sequence[str] = ("number_inputs",)) -> DataFrame:
    """A flat JSON parameter file (scalars, arrays, matrices) -> one row."""
    df = spark.read.option("multiLine", True).json(path)
    return df.drop(*[c for c in drop if c in df.columns])


def scan_templates(spark: SparkSession, path: str | Sequence[str], drop: Sequence[str] = ("number_inputs",)) -> DataFrame:
    """S8 for many files: every parameter of every template as rows ``(file, key, i,
    j, number, text)``, in one scan. Files may have different keys, and a key a
    scalar in one file and an array in another: they are parsed as variants, with
    no schema and no inference. A scalar has null places; an array has a row per
    element (``i``, from 0), a matrix with rows of any lengths one per ``i`` and
    ``j``. ``number`` is null for a text, ``text`` is the value as text; a JSON null
    has neither. Deeper values are given as JSON text."""
    whole = spark.read.text(path, wholetext=True).select(file_path().alias("file"), F.try_variant_get(F.parse_json("value"), "$", "map<string,variant>").alias("_gm_m"))
    rows = whole.select("file", F.explode("_gm_m").alias("key", "_gm_v")).where(~F.col("key").isin(list(drop)))
    for place in ("i", "j"):
        array = F.coalesce(F.startswith(F.schema_of_variant("_gm_v"), F.lit("ARRAY")), F.lit(False))
        rows = rows.withColumn("_gm_a", array)
        each = F.when(F.col("_gm_a"), F.try_variant_get("_gm_v", "$", "array<variant>")).otherwise(F.array("_gm_v"))
        rows = rows.select(*[c for c in rows.columns if c != "_gm_v"], F.posexplode(each).alias("_gm_p", "_gm_v"))
        rows = rows.withColumn(place, F.when(F.col("_gm_a"), F.col("_gm_p"))).drop("_gm_a", "_gm_p")
    kind, text = F.schema_of_variant("_gm_v"), F.try_variant_get("_gm_v", "$", "string")
    number = F.when((kind != "STRING") & (kind != "BOOLEAN"), F.try_variant_get("_gm_v", "$", "double"))
    return rows.select("file", "key", "i", "j", number.alias("number"), F.coalesce(text, F.when(kind != "VOID", F.to_json("_gm_v"))).alias("text"))
