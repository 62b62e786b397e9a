"""Bounded, reproducible samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    *,
    learn: Column,
    most_per_class: int,
    most_chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and labels of up to ``most_per_class`` rows of each class, chosen by
    a hash of the id among rows that satisfy ``learn`` (a condition on the labels
    table), and the size of each class there. Texts of over ``most_chars``
    characters are not drawn. Of several labels of an id the largest counts; rows
    without id or label are left out. The chosen ids are bounded, so they are
    broadcast and no text is shuffled."""
    marked = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in marked.where("_y in (0, 1)").groupBy("_y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("_id", F.lit(label_col)), F.lit(1 << 20))
    pick = F.lit(False)
    for y, n in sizes.items():
        pick = pick | ((F.col("_y") == y) & (place < int(min(1.0, most_per_class / n) * (1 << 20)) + 1))
    chosen = marked.where(pick).orderBy(place, "_id").limit(2 * len(sizes) * most_per_class + 1)
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).where(F.length("_text") <= most_chars)
    found = rows.join(F.broadcast(chosen), "_id").select("_id", "_text", "_y").limit(4 * len(sizes) * most_per_class + 1).collect()
    return [(r["_text"], r["_y"]) for r in sorted(found, key=lambda r: (r["_id"], r["_text"]))], sizes
