"""Embedding whitening by weighted multiplicity covariance.

Equal vectors are one row with their number. The fit takes each distinct vector
with weight one or with that number; sums are exact whole numbers, and vectors are
centred by them before a blocked matrix product makes the covariance. Each distinct
vector is projected on the leading components once, and the rows are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK = 4_096  # vectors multiplied at once


def matrix(column: pa.Array, kind) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they hold it, else Python's."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    return x * n - np.array(sums, np.int64) if most < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


def outer_sums(rows: DataFrame, vector: str, weight: str, centred: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over rows of weight * v v^T, v a centred vector. A task multiplies in
    blocks and gives one row per row of its matrix; those are added in the order
    of tasks, so that reruns agree. ``size`` rows of ``size`` numbers come back."""
    fields = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("values", pa.list_(pa.float64()))])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in (b.slice(a, BLOCK) for b in batches for a in range(0, len(b), BLOCK)):
            v = centred(batch.column(vector))
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.float64)
            total = (0.0 if total is None else total) + (v * w[:, None]).T @ v
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=fields)

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part").combine_chunks()
        total = np.add.reduce(matrix(group["values"].combine_chunks(), np.float64), axis=0)
        return pa.table([group["i"].slice(0, 1), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["i", "values"])

    parts = rows.select(vector, weight).mapInArrow(multiply, "i int, part int, values array<double>")
    out = np.zeros((size, size))
    for r in parts.groupBy("i").applyInArrow(add, "i int, values array<double>").collect():
        out[r["i"]] = r["values"]
    return out


@dataclass
class Whitening:
    """The fit: rows in the list ``n``, sums, components as columns, their variances
    (of all, as shares), and the check of the whitened list."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None


def leading(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[float | None]]:
    """Unit eigenvectors (columns) of the greatest eigenvalues, those, and their
    shares of the trace. An entry of greatest size is positive."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    # below this an eigenvalue is rounding, not variance
    floor = max(float(e[0]), 0.0) * len(covariance) * np.finfo(float).eps
    e = np.where(e > floor, e, 0.0)
    return v, e, [float(x) / trace if trace > 0 else None for x in e]


def whiten(
    df: DataFrame,
    vector: Column,
    *,
    id_col: str = "vec_id",
    most: int = 16,
    weights: str = "one",
) -> tuple[DataFrame, Whitening]:
    """One row per row of ``df`` whose ``vector`` (array of whole numbers) is not
    null and holds no null: the id, ``deviation`` (sum of (n * x - S)^2 over
    dimensions) and ``whitened`` (up to ``most`` components, by falling variance);
    and the fit, over distinct vectors, each with weight one or, by
    ``weights="count"``, its number of rows.

    Repeated rows and null ids get rows of their own; other columns are not read.
    A component without variance has null as whitened value, and only the others
    count in ``identity_error``; no row at all gives n = 0 and no component.
    Vectors of unequal lengths are an error, as is a deviation beyond 64 bits.
    What comes to the driver grows with the dimensions alone.
    """
    spark = df.sparkSession
    x = vector.cast("array<bigint>")
    rows = df.select(df[id_col].alias("_id"), x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull()))
    key = F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256))
    rows = rows.select("_id", key.alias("_key"), "x")
    distinct = C.stored(rows.groupBy("_key", "x").agg(F.count("*").alias("_copies")).withColumn("_weight", F.lit(1).cast("long") if weights == "one" else F.col("_copies")), "whiten-distinct")
    n, total, least, dims = distinct.agg(F.coalesce(F.sum("_weight"), F.lit(0)), F.coalesce(F.sum("_copies"), F.lit(0)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != dims:
        raise ValueError(f"vectors have {least} to {dims} dimensions")
    if not dims:
        none = spark.createDataFrame([], "deviation long, whitened array<double>")
        return rows.select(F.col("_id").alias(id_col)).limit(0).crossJoin(none) if not n else rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), Whitening(n, [], np.zeros((0, 0)), np.zeros(0), [])
    by_dim = distinct.select("_weight", F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)") * F.col("_weight")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in by_dim.collect()}
    sums = [found[i] for i in range(dims)]

    def centred(column: pa.Array) -> np.ndarray:
        return (spread(matrix(column, np.int64), n, sums) / n).astype(np.float64)

    covariance = outer_sums(distinct, "x", "_weight", centred, dims) / n
    components, variances, explained = leading(covariance, most)
    scale = np.where(variances > 0, components / np.sqrt(np.where(variances > 0, variances, 1.0)), np.nan)
    fields = pa.schema([("_key", pa.binary()), ("_copies", pa.int64()), ("_weight", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, BLOCK) for b in batches for a in range(0, len(b), BLOCK)):
            d = spread(matrix(batch.column("x"), np.int64), n, sums)
            y = (d / n).astype(np.float64) @ scale
            ends = pa.array(range(0, y.size + 1, y.shape[1]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(y.ravel(), pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_copies"), batch.column("_weight"), pa.array(deviations(d), pa.int64()), lists], schema=fields)

    made = C.stored(distinct.mapInArrow(project, "_key binary, _copies long, _weight long, deviation long, whitened array<double>"), "whiten-made")
    fit = Whitening(n, sums, components, variances, explained)
    live = int((variances > 0).sum())
    if live:
        parts = made.select("_weight", F.posexplode(F.slice("whitened", 1, live)).alias("i", "c")).groupBy("i").agg(F.sum(F.col("c") * F.col("_weight")).alias("s"))
        mean = np.zeros(live)
        for r in parts.collect():
            mean[r["i"]] = r["s"] / n
        second = outer_sums(made, "whitened", "_weight", lambda column: matrix(column, np.float64)[:, :live] - mean, live) / n
        fit.identity_error = float(np.abs(second - np.eye(live)).max())
    back = C.lookup(rows.select("_id", "_key"), made.select("_key", "_copies", "deviation", "whitened"), ["_key"], "_copies", total)
    return back.select(F.col("_id").alias(id_col), "deviation", "whitened"), fit


def quantised(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a vector that is null or holds
    null, NaN or an infinity."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    entries = vector.cast("array<double>")
    return F.when(F.forall(entries, finite), F.transform(entries, lambda c: F.floor(c * 64).cast("long") + 1_000_000))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: up to 16 whitened components of every usable embedding."""
    embeddings = C.table(spark, sf_dir, "embeddings")
    rows, fit = whiten(embeddings, quantised(embeddings["embedding"]))
    shares = F.array(*[F.lit(x).cast("double") for x in fit.explained]).cast("array<double>")
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return rows.select(
        "vec_id", (F.col("_i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_i")).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error"),
    )
