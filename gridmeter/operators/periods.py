"""Typical-period reduction (M5-M12): features, scaling, extremes, clustering,
representatives, weights and the reduced series.

A year of interval data becomes a few weighted representative periods. The
heavy parts (features, scaling, extremes, distances of periods) are aggregates
over the full series, whatever its width. What k-means needs of a period is its
distance to every other one, so hundreds of restarts and numbers of clusters run
side by side in one job on a small table of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmeter.functions.time import period_index, step_in_period
from gridmeter.operators.keys import attach, broadcast_small
from gridmeter.session import checkpoint_dir, shuffle_partitions


def period_features(
    df: DataFrame, index: str, profile: str, value: str, steps: int, profiles: Sequence[str],
    period: str = "Period_Index",
) -> DataFrame:
    """M5: one feature vector per period, ordered by (profile, step).

    Long input ``(index, profile, value)`` -> ``(period, features array<double>)``
    of length ``len(profiles) * steps``; a missing step counts as 0. Zeros are
    added for every position of every period before the sum, and the sums of a
    period (bounded by its length) are sorted into the vector.
    """
    plist = F.array(*[F.lit(p) for p in profiles])
    pos = (F.array_position(plist, F.col(profile).cast("string")) - 1) * steps + step_in_period(index, steps)
    long = df.where(F.col(profile).isin(list(profiles))).select(
        period_index(index, steps).alias(period), pos.cast("int").alias("_gm_pos"), F.col(value).cast("double").alias("_gm_v")
    )
    sums = long.groupBy(period, "_gm_pos").agg(F.sum("_gm_v").alias("_gm_v"))
    width = len(profiles) * steps
    zeros = sums.select(period).distinct().select(
        period, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_gm_pos"), F.lit(0.0).alias("_gm_v")
    )
    full = sums.unionByName(zeros).groupBy(period, "_gm_pos").agg(F.coalesce(F.sum("_gm_v"), F.lit(0.0)).alias("_gm_v"))
    ordered = F.sort_array(F.collect_list(F.struct("_gm_pos", "_gm_v")))
    return full.groupBy(period).agg(F.transform(ordered, lambda x: x["_gm_v"]).alias("features"))


def scale_features(df: DataFrame, value: str, by: Sequence[str], method: str = "S", out: str = "scaled",
                   methods: dict[str, str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """M6: ``S`` = (v - mean) / sample sd, ``N`` = (v - min) / (max - min), per
    profile. One statistics aggregate per profile, joined back on the
    profile key; ``methods`` ({out column: method}) adds several scalings
    from that one pass. ``weights`` multiplies the scaled values of a profile
    (the first of ``by``), as the settings' load weight does."""
    st = df.groupBy(*by).agg(
        F.avg(value).alias("_gm_mu"), F.stddev_samp(value).alias("_gm_sd"),
        F.min(value).alias("_gm_lo"), F.max(value).alias("_gm_hi"),
    )
    j = attach(df, st, list(by), ["_gm_mu", "_gm_sd", "_gm_lo", "_gm_hi"])
    v = F.col(value)
    for name, m in (methods or {out: method}).items():
        if m == "S":
            e = F.when(F.col("_gm_sd") > 0, (v - F.col("_gm_mu")) / F.col("_gm_sd")).otherwise(F.lit(0.0))
        elif m == "N":
            rng = F.col("_gm_hi") - F.col("_gm_lo")
            e = F.when(rng > 0, (v - F.col("_gm_lo")) / rng).otherwise(F.lit(0.0))
        else:
            raise ValueError("method must be 'S' or 'N'")
        factor = F.lit(1.0)
        for profile, w in (weights or {}).items():
            factor = F.when(F.col(by[0]) == profile, F.lit(float(w))).otherwise(factor)
        j = j.withColumn(name, e * factor if weights else e)
    return j.drop("_gm_mu", "_gm_sd", "_gm_lo", "_gm_hi")


@dataclass(frozen=True)
class ExtremeRule:
    """M7: pick the period whose ``measure`` of ``profile`` is the max or min.

    measure: ``Absolute`` (largest/smallest single step) or ``Integral`` (sum
    over the period). scope: ``System`` sums zones first, ``Zone`` keeps each.
    """

    name: str
    profile: str
    measure: str = "Absolute"
    pick: str = "Max"
    scope: str = "System"


def extreme_periods(
    df: DataFrame, index: str, profile: str, value: str, steps: int, rules: Sequence[ExtremeRule],
    zone: str | None = None, period: str = "Period_Index",
) -> DataFrame:
    """M7: ``(rule, [zone,] period)`` for each rule; ties go to the earliest period.

    The input is reduced once to (profile, [zone,] period, step), from which
    every rule reads."""
    zones = [zone] if zone else []
    named = sorted({r.profile for r in rules})
    per_step = df.where(F.col(profile).isin(named)).withColumn(period, period_index(index, steps)).groupBy(
        profile, *zones, period, index).agg(F.sum(value).alias("_gm_v"))
    outs = []
    for r in rules:
        keys = zones if r.scope == "Zone" else []
        d = per_step.where(F.col(profile) == r.profile)
        if zones and not keys:
            d = d.groupBy(period, index).agg(F.sum("_gm_v").alias("_gm_v"))
        how = F.sum if r.measure != "Absolute" else F.max if r.pick == "Max" else F.min
        per_period = d.groupBy(*keys, period).agg(how("_gm_v").alias("_gm_v"))
        sign = -1 if r.pick == "Max" else 1
        best = per_period.groupBy(*keys).agg(
            F.min_by(period, F.struct((F.col("_gm_v") * sign).alias("v"), F.col(period).alias("p"))).alias(period)
        )  # one row per period per zone before this: small
        outs.append(best.select(F.lit(r.name).alias("rule"), *keys, period))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o, allowMissingColumns=True)
    return res


def _sq_dist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


# largest distance per feature that scaled values can have: the whole range, or
# (for standardised values) four standard deviations, about 95% of them
SPREAD = {"N": 1.0, "S": 4.0}


def pick_representative(assigned: DataFrame, centers: DataFrame, period: str = "Period_Index") -> DataFrame:
    """``(period, cluster, Rep_Period)``: a cluster's representative is the
    member nearest its centre, the earliest in ties. ``assigned``: period,
    cluster, features; ``centers``: cluster, center (at most one row a period)."""
    dist = assigned.join(F.broadcast(centers), "cluster").withColumn("_gm_d", _sq_dist(F.col("features"), F.col("center")))
    reps = dist.groupBy("cluster").agg(F.min_by(period, F.struct(F.round("_gm_d", TIE_DIGITS).alias("_gm_d"), period)).alias("Rep_Period"))
    return dist.join(reps, "cluster").select(period, "cluster", "Rep_Period")


def number_representatives(members: DataFrame, period: str = "Period_Index") -> DataFrame:
    """The period map, representatives numbered 1..K in period order (at
    most one row a period of the horizon)."""
    ids = members.select("Rep_Period").distinct()
    ids = ids.withColumn("Rep_Period_Index", F.row_number().over(Window.orderBy("Rep_Period")))
    return members.join(ids, "Rep_Period").select(period, "Rep_Period", "Rep_Period_Index")


# features of a period that one task of ``pair_distances`` multiplies
FEATURE_BLOCK = 512
# squared distances that agree to so many decimals are equal
TIE_DIGITS = 9


def pair_distances(features: DataFrame, period: str = "Period_Index", block: int = FEATURE_BLOCK) -> tuple[list, np.ndarray]:
    """The periods in order, and the squared distances of all pairs of their
    vectors. Vectors are cut into blocks of ``block`` features; a task takes one
    block of all periods, and block results are added per period in block order.
    What comes to the driver is one number per pair of periods (a megabyte for a
    year of days), however many profiles and steps a period has."""
    order = [r[0] for r in features.select(period).orderBy(period).collect()]
    n, place = len(order), {p: i for i, p in enumerate(order)}
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("features") / F.lit(block)) - 1, F.lit(0)).cast("int")), lambda b: F.slice("features", b * block + 1, F.lit(block)))
    cut = features.select(period, F.posexplode(cuts).alias("_gm_b", "_gm_x"))

    def products(group: pa.Table) -> pa.Table:
        """Distances of all pairs within one block of features."""
        at = np.array([place[p] for p in group[period].to_pylist()])
        x = np.zeros((n, max(len(v) for v in group["_gm_x"])))
        x[at] = group["_gm_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        x -= x.mean(axis=0)  # near-equal vectors keep their digits
        g = x @ x.T
        d = np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g, 0.0)
        return pa.table({"_gm_b": pa.array([group["_gm_b"][0].as_py()] * n, pa.int32()), "_gm_i": pa.array(range(n), pa.int32()), "_gm_d": pa.array(d.tolist(), pa.list_(pa.float64()))})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("_gm_b")
        total = np.add.reduce(group["_gm_d"].combine_chunks().flatten().to_numpy().reshape(len(group), n), axis=0)
        return pa.table({"_gm_i": group["_gm_i"].slice(0, 1), "_gm_d": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = cut.groupBy("_gm_b").applyInArrow(products, "_gm_b int, _gm_i int, _gm_d array<double>")
    out = np.zeros((n, n))
    for r in parts.groupBy("_gm_i").applyInArrow(add, "_gm_i int, _gm_d array<double>").collect():
        out[r["_gm_i"]] = r["_gm_d"]
    return order, (out + out.T) / 2


def centre_distances(d: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of every period to the mean of each cluster, from pair
    distances alone; infinite for a cluster without members."""
    a = np.zeros((len(d), k))
    a[np.arange(len(d)), labels] = 1.0
    size = a.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        to_members = d @ a / size
        spread = (a * np.where(size > 0, to_members, 0.0)).sum(axis=0) / size
        return np.where(size > 0, to_members - spread / 2, np.inf)


def lloyd(d: np.ndarray, labels: np.ndarray, k: int, max_iter: int) -> np.ndarray:
    """Labels after up to ``max_iter`` rounds: each period goes to the nearest
    mean, the first of equally near ones; clusters may become empty."""
    for _ in range(max_iter):
        new = centre_distances(d, labels, k).round(TIE_DIGITS).argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
    return labels


def summary(d: np.ndarray, labels: np.ndarray, k: int) -> tuple[float, float, np.ndarray]:
    """Cost of a clustering, the largest squared distance of a period to its
    representative, and the representative (the member nearest the mean, the
    earliest of equally near ones) of every period."""
    own = centre_distances(d, labels, k)
    near = own[np.arange(len(d)), labels]
    reps = np.zeros(len(d), int)
    for c in np.unique(labels):
        members = np.flatnonzero(labels == c)
        reps[members] = members[own[members, c].round(TIE_DIGITS).argmin()]
    return float(near.sum()), float(d[np.arange(len(d)), reps].max()), reps


def first_centres(order: Sequence, d: np.ndarray, seed: int, restart: int, k: int) -> list[int]:
    """A restart's first centres, each drawn with a chance in proportion to its
    squared distance to the nearest one before (k-means++). The draw is a race of
    exponential times, -ln(u) / weight, with u from a hash of seed, restart, turn
    and period, so that any machine draws the same. A shorter list if fewer vectors
    differ; that for a smaller k is its beginning."""
    out: list[int] = []
    weight = np.ones(len(order))
    for turn in range(k):
        u = np.array([(int(hashlib.md5(f"{seed}-{restart}-{turn}-{p}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for p in order])
        with np.errstate(divide="ignore"):
            time = np.where(weight > 0, -np.log(u) / weight, np.inf)
        if not np.isfinite(time).any():
            break
        out.append(int(time.argmin()))
        nearest = d[:, out].min(axis=1)
        weight = nearest.round(TIE_DIGITS)
    return out


FIT = "k int, restart int, cost double, worst double, reps array<int>"


def restarts(spark: SparkSession, order: Sequence, d: np.ndarray, ks: Sequence[int], repeats: int, seed: int, max_iter: int) -> DataFrame:
    """M8: k-means for every k and restart, a row each, all in one job. A fit
    needs only the pair distances, so a task runs its own restarts to the end."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for restart in batch["id"].tolist():
                first = first_centres(order, d, seed, restart, max(ks))
                for k in ks:
                    labels = lloyd(d, d[:, first[:k]].round(TIE_DIGITS).argmin(axis=1), k, max_iter)
                    cost, worst, reps = summary(d, labels, k)
                    out.append((k, restart, cost, worst, reps.astype("int32")))
            yield pd.DataFrame(out, columns=["k", "restart", "cost", "worst", "reps"])

    return spark.range(0, repeats, 1, min(repeats, 4 * shuffle_partitions(spark))).mapInPandas(fit, FIT)


def insert_farthest(best: DataFrame, d: np.ndarray, k_max: int, limit: float, max_iter: int) -> DataFrame:
    """M9 by insertion: while a period is farther than ``limit`` (squared) from its
    representative, the farthest one becomes a centre of its own, and k-means goes
    on from the clusters that there are. ``best`` has one fit, as ``reps``."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for reps in batch["reps"]:
                reps = np.asarray(reps)
                while True:
                    labels = np.unique(reps, return_inverse=True)[1]
                    k = int(labels.max()) + 1
                    cost, worst, reps = summary(d, labels, k)
                    if worst <= limit or k >= k_max:
                        break
                    labels[d[np.arange(len(d)), reps].round(TIE_DIGITS).argmax()] = k
                    labels = lloyd(d, labels, k + 1, max_iter)
                    new = summary(d, labels, k + 1)[2]
                    if len(np.unique(new)) <= k:  # the new cluster took another's place: nothing to gain
                        break
                    reps = new
                out.append((k, 0, cost, worst, reps.astype("int32")))
            yield pd.DataFrame(out, columns=["k", "restart", "cost", "worst", "reps"])

    return best.mapInPandas(grow, FIT)


def cluster_periods(
    features: DataFrame, k_min: int, k_max: int, threshold: float | None = None,
    extremes: DataFrame | None = None, repeats: int = 5, seed: int = 7, period: str = "Period_Index",
    max_iter: int = 50, scaling: str = "S", iterate: str = "cluster",
) -> DataFrame:
    """K-means over period vectors with ``k_min`` to ``k_max`` typical
    periods, extreme periods (M7) included, which form clusters of their own.

    With a ``threshold`` k grows until every period is within that share of the
    possible error of its representative period (``SPREAD`` per feature of the
    ``scaling``), or ``k_max`` is reached; without one k is ``k_max``. For each k
    the best of ``repeats`` restarts (least cost, then first) wins. With
    ``iterate="cluster"`` every k has its own restarts, all in one job; with
    ``"insert"`` only the least k has, and further clusters are inserted one by
    one (see ``insert_farthest``).

    Output is the period map ``(Period_Index, Rep_Period, Rep_Period_Index)``:
    each cluster is represented by its member nearest the centre, and
    representatives are numbered in period order. If every period is extreme,
    each represents itself. Vectors have equal lengths.
    """
    if iterate not in ("cluster", "insert"):
        raise ValueError("iterate must be 'cluster' or 'insert'")
    spark = features.sparkSession
    # one row per period of the horizon: checkpointed once to the shared folder
    checkpoint_dir(spark)
    feats = features.select(period, F.col("features").cast("array<double>").alias("features")).checkpoint(eager=True)
    own = feats.select(period).limit(0) if extremes is None else extremes.select(period).distinct()
    own = own.join(feats.select(period), period, "left_semi").select(period, F.col(period).alias("Rep_Period")).checkpoint(eager=True)
    n_own, width = own.count(), feats.select(F.max(F.size("features"))).first()[0]
    order, d = pair_distances(feats.join(own.select(period), period, "left_anti"), period)
    if not order:
        return number_representatives(own, period)
    limit = None if threshold is None else (threshold * SPREAD[scaling]) ** 2 * width
    most = min(len(order), max(1, k_max - n_own))
    least = most if limit is None else min(most, max(1, k_min - n_own))
    ks = list(range(least, most + 1)) if iterate == "cluster" else [least]
    fits = restarts(spark, order, d, ks, repeats, seed, max_iter)
    best = fits.groupBy("k").agg(F.min_by(F.struct("restart", "cost", "worst", "reps"), F.struct(F.round("cost", TIE_DIGITS).alias("cost"), "restart")).alias("f")).select("k", "f.*")
    if limit is not None:
        far = F.col("worst") > limit  # a row per k: the least k within the limit, else the largest
        best = best.orderBy(far, F.when(far, -F.col("k")).otherwise(F.col("k"))).limit(1)
        if iterate == "insert":
            best = insert_farthest(best, d, most, limit, max_iter)
    periods = spark.createDataFrame(list(enumerate(order)), T.StructType([T.StructField("_gm_i", T.IntegerType()), features.schema[period]]))
    names = lambda i, name: periods.select(F.col("_gm_i").alias(i), F.col(period).alias(name))
    members = best.select(F.posexplode("reps").alias("_gm_m", "_gm_r"))
    members = members.join(names("_gm_m", period), "_gm_m").join(names("_gm_r", "Rep_Period"), "_gm_r").select(period, "Rep_Period")
    return number_representatives(members.unionByName(own), period)


def period_weights(period_map: DataFrame, steps: int, total: float) -> DataFrame:
    """Members per representative, as a per-step weight so that
    sum(weight * steps) over representatives = ``total``."""
    counts = period_map.groupBy("Rep_Period", "Rep_Period_Index").agg(F.count(F.lit(1)).alias("n_members"))
    # number of periods = sum of members, over the representatives' rows
    # (at most one per period of the horizon), so no second pass over the map
    n_periods = F.sum("n_members").over(Window.partitionBy())
    return counts.withColumn("weight", (F.col("n_members") * F.lit(float(total))) / (n_periods * F.lit(steps)))


def step_weights(weights: DataFrame, steps: int, index: str = "Time_Index") -> DataFrame:
    """The weight of every step of the reduced series."""
    e = weights.select("Rep_Period_Index", "weight", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_gm_s"))
    return e.select(((F.col("Rep_Period_Index") - 1) * steps + F.col("_gm_s")).alias(index), "weight")


def reduced_series(df: DataFrame, period_map: DataFrame, steps: int, index: str = "Time_Index") -> DataFrame:
    """Keep the representative periods' steps, re-indexed
    ``(Rep_Period_Index - 1) * steps + step``. A map of up to 100,000
    representatives (counted) is broadcast."""
    reps = period_map.select(F.col("Rep_Period").alias("_gm_p"), "Rep_Period_Index").distinct()
    d = df.withColumn("_gm_p", period_index(index, steps)).join(broadcast_small(reps, 100_000), "_gm_p", "inner")
    return d.withColumn(index, (F.col("Rep_Period_Index") - 1) * steps + step_in_period(index, steps) + 1).drop(
        "_gm_p"
    )
