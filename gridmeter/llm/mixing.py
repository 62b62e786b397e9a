"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the
source's share of the word budget. A source's documents stand in a seeded
order, repeated in epochs; a document that begins after ``c`` of the source's
``T`` budgeted words is due at the time at which the source's cumulative demand
reaches ``c / T``. Inverting the cumulative demand gives that time, and a range
sort by it gives the training order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# A schedule is a list of (time, weight) knots, linear between them.
Schedule = Sequence[tuple[float, float]]

MAKES = ("size", "source_size", "target", "takes")


def ramp(weight: float, shape: int) -> Schedule:
    """A schedule with mean ``weight``: level, rising or falling (shape 0, 1, 2)."""
    low, high = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))[shape]
    return [(0.0, weight * low), (1.0, weight * high)]


def cycle(sources: Sequence[str | None]) -> dict[str | None, Schedule]:
    """Weights 1, 2, 3, repeating, over the sources in code point order (null
    last): level, rising and falling in turn."""
    ranked = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: ramp(float(i % 3 + 1), i % 3) for i, s in enumerate(ranked)}


def integral(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))


def water_fill(sizes: Mapping, weights: Mapping, max_repeats: int = 3) -> dict:
    """Shares of the sum of all sizes by weight, where no source gets more than
    ``max_repeats`` times its size; what is cut off goes to the others by weight."""
    rest, weight, targets = sum(sizes.values()), sum(weights.values()), {}
    open_ = dict(sizes)
    while open_:
        over = [s for s in open_ if weight and rest * weights[s] / weight > max_repeats * open_[s]]
        if not over:
            break
        for s in over:
            targets[s] = float(max_repeats * open_.pop(s))
        rest = sum(sizes.values()) - sum(map(int, targets.values()))
        weight = sum(weights[s] for s in open_)
    return targets | {s: rest * weights[s] / weight if weight else 0.0 for s in open_}


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces of the cumulative demand: mass before and after (of 1), start time,
    weight at the start and slope, both as shares of the whole mass."""
    whole, mass, out = integral(schedule) or 1.0, 0.0, []
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        piece = (t1 - t0) * (a + b) / 2 / whole
        if piece > 0:
            out.append((mass, mass + piece, t0, a / whole, (b - a) / (t1 - t0) / whole))
            mass += piece
    return out


def due(part: Column, pieces: Column) -> Column:
    """The time at which a share ``part`` of the demand is used up."""
    at = F.coalesce(F.get(F.filter(pieces, lambda s: part < s["upto"]), F.lit(0)), F.element_at(pieces, -1))
    more = part - at["mass"]
    return at["t0"] + 2.0 * more / (at["a"] + F.sqrt(at["a"] * at["a"] + 2.0 * at["slope"] * more))


def curriculum_takes(
    docs: DataFrame,
    size: Column,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    tie: Column | None = None,
    schedules=cycle,
    max_repeats: int = 3,
    seed: int = 17,
    max_sources: int = 100_000,
) -> DataFrame:
    """Every input row with ``size``, ``source_size``, ``target`` (its source's
    budget in words) and ``takes``: array of (copy, words, position), one entry
    for each time that the mix uses the row, empty if it doesn't.

    ``schedules``: a map from source to schedule, or a function from the list of
    sources to such a map; a source that it leaves out has weight 0. A null
    source is a source of its own. A source's budget is met to the word: the
    last document taken is cut there. No row is used more than ``max_repeats``
    times. Rows of size 0 take part in the first epoch with no words. Null ids
    come first in ties, and repeated rows are rows of their own; ``tie`` should
    tell apart rows with equal id, so that reruns agree. An empty table gives an
    empty table. There may be ``max_sources`` sources, whose totals go through
    the driver; more raise an error.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("-"))))
    null, source = C.clean_source(docs[source_col])
    rows = C.packed(docs, size=F.coalesce(size, F.lit(0)).cast("long"), _null=null, _source=source, _key=key, _id=docs[id_col], _tie=F.lit(0) if tie is None else tie)
    totals = rows.groupBy("_null", "_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources or group small sources first")
    name = lambda r: None if r["_null"] else r["_source"]
    sizes = {name(r): r["n"] for r in totals}
    plans = schedules(list(sizes)) if callable(schedules) else schedules
    plans = {s: plans.get(s) or [(0.0, 0.0), (1.0, 0.0)] for s in sizes}
    targets = water_fill(sizes, {s: integral(p) for s, p in plans.items()}, max_repeats)
    plan = spark.createDataFrame(
        [(r["_null"], r["_source"], r["n"], r["rows"], targets[name(r)], int(targets[name(r)] + 0.5), segments(plans[name(r)])) for r in totals],
        "_null int, _source string, source_size long, _rows long, target double, _budget long, _pieces array<struct<mass double, upto double, t0 double, a double, slope double>>",
    )
    # at most max_sources rows
    rows = rows.join(F.broadcast(plan), ["_null", "_source"])
    place = F.conv(F.substring("_key", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = rows.withColumn("_bucket", F.floor(place * C.bucket_count(F.col("_rows"))).cast("int"))
    rows = C.prefix_sums(rows, ["_null", "_source"], "_bucket", [F.col("_key"), F.col("_id"), F.col("size"), F.col("_tie")], F.col("size"), "_start")

    def take(copy):
        begin = copy * F.col("source_size") + F.col("_start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - begin))
        return F.struct(
            copy.cast("int").alias("copy"),
            words.cast("long").alias("words"),
            F.when(F.size("_pieces") > 0, due(begin.cast("double") / F.greatest(F.col("_budget"), F.lit(1)).cast("double"), F.col("_pieces"))).alias("position"),
        )

    used = lambda t: (t["words"] > 0) | ((t["copy"] == 0) & (F.col("size") == 0) & (F.col("_start") <= F.col("_budget")) & (F.col("_budget") > 0))
    rows = rows.withColumn("takes", F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), take), used))
    return C.unpacked(rows, MAKES)


def curriculum_mix(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The training stream: a row for each use of a document, in training order,
    with the columns of ``docs`` and ``copy``, ``words``, ``position``. The text
    of a use with fewer words than the document ends after those words. Rows
    without words come out as they are. Options as in ``curriculum_takes``."""
    names = [c for c in docs.columns if c not in (*MAKES, "copy", "words", "position")]
    taken = curriculum_takes(docs, C.n_words(docs[text_col]), id_col=id_col, tie=F.xxhash64(docs[text_col]), **options)
    used = taken.select(*[F.col(f"`{c}`") for c in names], "size", F.explode("takes").alias("_t")).select("*", "_t.*").drop("_t")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col(text_col))
    return used.withColumn(text_col, cut).drop("size").orderBy(F.col("position").asc_nulls_last(), F.col(id_col), F.col("copy"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words that the mix takes of each document."""
    docs = C.table(spark, sf_dir, "documents")
    sized = C.stored(docs.select("doc_id", "source", C.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_h")), "mix-sizes")
    takes = curriculum_takes(sized, F.col("size"), tie=F.col("_h"))
    return takes.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"]).alias("taken"),
        F.size("takes").alias("copies"),
        F.get("takes", F.lit(0))["position"].alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || COALESCE(doc_id::VARCHAR, '-')) AS k
  FROM documents
), s AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, SUM(source_size) OVER ()::BIGINT AS total,
         COALESCE(SUM(3 * source_size) OVER below, 0)::BIGINT AS caps,
         SUM(w) OVER rest::BIGINT AS weights
  FROM s
  WINDOW below AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), c AS (
  SELECT *, ((total - caps) * w)::DOUBLE / weights > 3 * source_size AS capped FROM f
), l AS (
  SELECT total - COALESCE(SUM(3 * source_size) FILTER (WHERE capped), 0)::BIGINT AS rest,
         COALESCE(SUM(w) FILTER (WHERE NOT capped), 0)::BIGINT AS weights
  FROM c GROUP BY total
), t AS (
  SELECT source, source_size, w,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (rest * w)::DOUBLE / l.weights END AS target
  FROM c, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w, floor(t.target + 0.5)::BIGINT AS budget,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, greatest(0, least(size, budget - begins)) AS t0,
         greatest(0, least(size, budget - source_size - begins)) AS t1,
         greatest(0, least(size, budget - 2 * source_size - begins)) AS t2,
         begins::DOUBLE / greatest(budget, 1)::DOUBLE AS part,
         CASE w WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 1.5 END::DOUBLE AS a,
         CASE w WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE -1.0 END::DOUBLE AS slope
  FROM p
)
SELECT doc_id, size, source_size, target, (t0 + t1 + t2)::BIGINT AS taken,
       ((t0 > 0 OR (size = 0 AND begins <= budget AND budget > 0))::INT + (t1 > 0)::INT + (t2 > 0)::INT)::INT AS copies,
       CASE WHEN t0 > 0 OR (size = 0 AND begins <= budget AND budget > 0)
            THEN 0.0::DOUBLE + 2.0::DOUBLE * part / (a + sqrt(a * a + 2.0::DOUBLE * slope * part)) END AS first_position
FROM u
"""
