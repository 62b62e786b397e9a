"""The corpus pipeline: from ``documents`` to packed training sequences.

Stages, in order: toxic documents go; of byte-equal texts one stays; of near-
duplicates one stays; sources are mixed to target weights along a curriculum,
in training order; the result is packed into sequences. Each stage reads the
Parquet files that the one before has written; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.llm import common as C
from gridmeter.llm.dedup import drop_exact
from gridmeter.llm.labels import id_remainder
from gridmeter.llm.mixing import curriculum_mix
from gridmeter.llm.near_dedup import drop_near
from gridmeter.llm.packing import concat_and_cut
from gridmeter.llm.toxicity import reject_toxic, train
from gridmeter.session import bound_arrow_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the sentence model, learned from the labels outside the held-out
    fifth, doesn't reject."""
    bound_arrow_batches(spark)
    labels = C.table(spark, sf_dir, "labels")
    return reject_toxic(docs, train(docs, labels, learn=id_remainder(labels["doc_id"], 5) != 0))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of byte-equal texts, that with the largest id."""
    bound_arrow_batches(spark)
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts with an edit similarity of 0.8, that with the least id."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream in order: a row for each use of a document. The use
    that ends a source's budget is cut there."""
    columns = docs.columns
    mixed = curriculum_mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else mixed.select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records with their ids, in the order of the stream."""
    bound_arrow_batches(spark)
    return concat_and_cut(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Learned scores, sketches and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
