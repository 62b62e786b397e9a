"""Shards that each match the mixture, by proportional stratified interleaving.

Rows of a source stand in a seeded order; the one of rank r of n gets the
fractional rank (r + 1/2) / n. Sorted by it, all sources are spread evenly over
the whole order, so every cut of it holds each source in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAKES = ("law", "shard", "slot", "grown_shard")


def interleaved_shards(
    docs: DataFrame,
    shards: int = 8,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    tie: Column | None = None,
    seed: int = 17,
    broadcast_sources: int = 100_000,
) -> DataFrame:
    """Every row with ``law`` ('rows'), ``shard`` (0 to ``shards`` - 1; counts at
    most one apart), ``slot`` (its place there, gapless from 0) and
    ``grown_shard`` (null: a further shard moves rows between all shards).

    A null source is a source of its own, null ids come first in ties, repeated
    rows are rows of their own, and ``tie`` should tell apart rows with equal id.
    With fewer rows than shards the last shards stay empty, as with an empty
    table. Ranks are prefix sums over buckets of the seeded order within a source
    and of the fractional rank over all, so that no task gets a whole source.
    """
    null, source = C.clean_source(docs[source_col])
    base = C.packed(docs, _null=null, _source=source, _key=F.xxhash64(F.lit(seed), docs[id_col]), _id=docs[id_col], _tie=F.lit(0) if tie is None else tie)
    order = [F.col("_key"), F.col("_id"), F.col("_tie")]
    one = F.lit(1).cast("long")
    sizes = base.groupBy("_null", "_source").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if C.is_small(sizes, broadcast_sources):
        rows = base.join(F.broadcast(sizes), ["_null", "_source"])
    else:
        rows = C.lookup(base, C.stored(sizes, "shard-sources"), ["_null", "_source"], "_n", total)
    unit = (F.col("_key").cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    cuts = C.bucket_count(F.col("_n"))
    rows = rows.withColumn("_bucket", F.least(F.floor(unit * cuts).cast("int"), cuts - 1))
    # stored, as both passes of the second sum read it
    rows = C.stored(C.prefix_sums(rows, ["_null", "_source"], "_bucket", order, one, "_rank"), "shard-ranks")
    # an offset of its own for each source spreads sources of one or few rows
    offset = (F.xxhash64(F.lit(seed), "_null", "_source").cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    rows = rows.withColumn("_part", (F.col("_rank") + offset) / F.col("_n"))
    rows = rows.withColumn("_cut", F.floor(F.col("_part") * C.bucket_count(F.lit(total), most=65_536)).cast("int"))
    rows = C.prefix_sums(rows, [], "_cut", [F.col("_part"), F.col("_null"), F.col("_source"), *order], one, "_place")
    # shard s takes the places from ceil(s * total / shards): sizes differ by one at most
    rows = rows.withColumn("_shard", F.expr(f"_place * {shards} div {max(total, 1)}"))
    made = {
        "law": F.lit("rows"),
        "shard": F.col("_shard").cast("int"),
        "slot": F.expr(f"_place - (_shard * {total} + {shards - 1}) div {shards}"),
        "grown_shard": F.lit(None).cast("int"),
    }
    return C.unpacked(rows.withColumns(made), MAKES)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows of ``interleaved_shards`` to one folder per shard, each
    file in the order of slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: shard and slot of every document under the law of rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = C.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("_h"))
    rows = C.stored(rows, "shard-rows")
    return interleaved_shards(rows, 8, tie=F.col("_h")).select("doc_id", "size", "text_crc32", *MAKES)
