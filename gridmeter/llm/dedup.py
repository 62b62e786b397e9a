"""Exact dedup with counting quotient filters.

Every partition builds a counting quotient filter over 64-bit fingerprints of
its texts, cut into blocks by the fingerprint's top bits. Filters of one block
merge without loss: their runs are sorted remainders, so a merge is a sorted
merge that adds counts. A fingerprint with a count above one goes to byte
verification; every other text is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


class CountingQuotientFilter:
    """Sorted fingerprints with counts, stored as a quotient filter.

    A fingerprint of ``bits`` bits has a quotient (its top ``q`` bits), which is
    its home slot, and a remainder. Remainders of one quotient form a run in
    ascending order; runs follow one another in the order of quotients, shifted
    right where slots are taken. ``occupied`` marks quotients that have a run,
    ``ends`` marks the last slot of each run, ``used`` the slots in use; counts
    stand beside the remainders. Nothing is lost: the fingerprints can be
    listed again.
    """

    def __init__(self, q: int, bits: int, prints: np.ndarray, counts: np.ndarray):
        """``prints``: distinct, ascending, below 2 ** bits."""
        self.q, self.bits, self.r = q, bits, bits - q
        quotients = (prints >> np.uint64(self.r)).astype(np.int64)
        n = len(prints)
        index = np.arange(n, dtype=np.int64)
        slots = np.maximum.accumulate(quotients - index) + index if n else index
        size = max(1 << q, int(slots[-1]) + 1 if n else 0)
        self.occupied = np.zeros(1 << q, bool)
        self.occupied[quotients] = True
        self.used, self.ends = np.zeros(size, bool), np.zeros(size, bool)
        self.used[slots] = True
        if n:
            self.ends[slots[np.append(quotients[1:] != quotients[:-1], True)]] = True
        self.remainders = np.zeros(size, np.uint64)
        self.remainders[slots] = prints & np.uint64((1 << self.r) - 1)
        self.counts = np.zeros(size, np.uint32 if not n or counts.max() < 1 << 32 else np.uint64)
        self.counts[slots] = counts

    @classmethod
    def of(cls, bits: int, prints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From prints in any order, repeats added up (in whole numbers); about 3/4 of
        the slots used."""
        order = np.argsort(prints, kind="stable")
        sort = prints[order]
        first = np.flatnonzero(np.append(True, sort[1:] != sort[:-1])[: len(sort)])
        each = np.ones(len(sort), np.uint64) if counts is None else np.asarray(counts)[order].astype(np.uint64)
        return cls.sorted(bits, sort[first], np.add.reduceat(each, first) if len(first) else each)

    @classmethod
    def sorted(cls, bits: int, keys: np.ndarray, sums: np.ndarray) -> CountingQuotientFilter:
        """From distinct prints in ascending order and their counts."""
        q = min(bits, max(1, int(np.ceil(np.log2(max(1, len(keys)) / 0.75)))))
        return cls(q, bits, keys, sums)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in ascending order, and their counts."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        ends = self.ends[self.used]
        run = np.cumsum(ends) - ends
        return (quotients[run] << np.uint64(self.r)) | self.remainders[self.used], self.counts[self.used].astype(np.uint64)

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was added."""
        quotient, remainder = fingerprint >> self.r, fingerprint & ((1 << self.r) - 1)
        if not self.occupied[quotient]:
            return 0
        run = int(np.count_nonzero(self.occupied[:quotient]))
        ends = np.flatnonzero(self.ends)
        used = np.flatnonzero(self.used)
        used = used[(used > (ends[run - 1] if run else -1)) & (used <= ends[run])]
        found = used[self.remainders[used] == np.uint64(remainder)]
        return int(self.counts[found[0]]) if len(found) else 0

    def to_bytes(self) -> bytes:
        """Bit vectors, then remainders of used slots (as few bytes as hold them), then counts."""
        width = max(1, (self.r + 7) // 8)
        rem = self.remainders[self.used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        wide = self.counts.dtype == np.uint64
        head = np.array([self.q, self.bits, len(self.used), int(wide)], "<i8").tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.used, self.ends))
        return head + bits + rem.tobytes() + self.counts[self.used].astype("<u8" if wide else "<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, bits, size, wide = (int(x) for x in np.frombuffer(data, "<i8", 4))
        out, at = cls.__new__(cls), 32
        out.q, out.bits, out.r = q, bits, bits - q
        for name, n in (("occupied", 1 << q), ("used", size), ("ends", size)):
            nb = (n + 7) // 8
            setattr(out, name, np.unpackbits(np.frombuffer(data, np.uint8, nb, at), count=n).astype(bool))
            at += nb
        n, width = int(out.used.sum()), max(1, (out.r + 7) // 8)
        rem = np.zeros((n, 8), np.uint8)
        rem[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        out.remainders = np.zeros(size, np.uint64)
        out.remainders[out.used] = rem.reshape(-1).view("<u8")
        kind = "<u8" if wide else "<u4"
        out.counts = np.zeros(size, np.uint64 if wide else np.uint32)
        out.counts[out.used] = np.frombuffer(data, kind, n, at + n * width)
        return out


def merged_pair(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of prints and counts as one: equal prints add their
    counts, the others of ``b`` go to their places between those of ``a``."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    (keys, counts), (more, add) = a, b
    at = np.searchsorted(keys, more)
    same = np.zeros(len(more), bool)
    inside = at < len(keys)
    same[inside] = keys[at[inside]] == more[inside]
    counts = counts.copy()
    counts[at[same]] += add[same]
    return np.insert(keys, at[~same], more[~same]), np.insert(counts, at[~same], add[~same])


def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """One filter with the sums of all counts. Filters list their prints in order
    (runs by quotient, each with ascending remainders), so they are merged two by
    two, then the results, without sorting again."""
    parts = [f.items() for f in filters]
    while len(parts) > 1:
        parts = [merged_pair(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return CountingQuotientFilter.sorted(filters[0].bits, *parts[0])


def repeated_fingerprints(prints: DataFrame, total: int, block_prints: int = 200_000) -> DataFrame:
    """``_fp``, ``n`` of fingerprints (column ``_fp``, long) that occur more than
    once. Blocks get about ``block_prints`` fingerprints each however large the
    input is; copies inside a partition are one entry of its filter."""
    block_bits = min(40, max(6, int(np.ceil(np.log2(max(1, total) / block_prints)))))
    low = 64 - block_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            keys = np.sort(np.concatenate(held))
            blocks = (keys >> np.uint64(low)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            rest = keys & np.uint64((1 << low) - 1)
            rows = [(int(blocks[a]), CountingQuotientFilter.of(low, rest[a:b]).to_bytes()) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
            return pd.DataFrame(rows, columns=["block", "filter"])

        for batch in batches:
            held.append(batch["_fp"].to_numpy(np.int64).view(np.uint64))
            size += len(batch)
            if size >= 4_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        one = merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]])
        keys, counts = one.items()
        more = counts > 1
        prints = keys[more] | (np.uint64(pdf["block"].iloc[0]) << np.uint64(low))
        return pd.DataFrame({"_fp": prints.view(np.int64), "n": counts[more].astype(np.int64)})

    filters = prints.select("_fp").mapInPandas(build, "block long, filter binary")
    return filters.groupBy("block").applyInPandas(merged, "_fp long, n long")


MAKES = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", broadcast_rows: int = 500_000) -> DataFrame:
    """One row per input row, without its text: ``_row_id``, the id, ``keep_id``
    (largest id of its group of byte-equal texts), ``group_size``, ``kept``,
    ``text_sha256``.

    A null text is empty. A null id is below every other; where all ids of a
    group are null, ``keep_id`` is null. Of rows that repeat the kept id with the
    same text one is kept. An empty table gives no row. Up to ``broadcast_rows``
    repeated fingerprints (8 MB) are broadcast to find the texts that need
    verification; more are joined by a shuffle.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = C.stored(
        docs.select(F.monotonically_increasing_id().alias("_row_id"), docs[id_col].alias("_id"), F.xxhash64(text).alias("_fp"), F.sha2(text, 256).alias("text_sha256")),
        "dedup-prints",
    )
    total = rows.count()
    repeated = C.stored(repeated_fingerprints(rows, total), "dedup-repeated")
    few = C.is_small(repeated, broadcast_rows)
    texts = docs.select(docs[id_col].alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_fp"))
    suspects = texts.join(F.broadcast(repeated.select("_fp")) if few else repeated.select("_fp"), "_fp")
    # byte verification: the text itself is the key; copies collapse before the shuffle
    groups = suspects.groupBy("_fp", "_text").agg(F.count("*").alias("group_size"), F.max("_id").alias("keep_id"))
    groups = C.stored(groups.select("_fp", F.sha2("_text", 256).alias("text_sha256"), "group_size", "keep_id"), "dedup-groups")
    found = C.stored(C.lookup(rows, groups, ["_fp", "text_sha256"], "group_size", total), "dedup-found")
    found = found.select("_row_id", "_id", "_fp", "text_sha256", F.coalesce("group_size", F.lit(1)).alias("group_size"), F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"))
    is_keep = F.col("_id").eqNullSafe(F.col("keep_id"))
    # rows that repeat the kept id: the first stays. Few or none, but any number is right
    again = found.where(is_keep & (F.col("group_size") > 1)).groupBy("_fp", "text_sha256").agg(F.count("*").alias("_n"), F.min("_row_id").alias("_first"))
    again = C.stored(again.where("_n > 1"), "dedup-again")
    marked = C.lookup(found, again, ["_fp", "text_sha256"], "_n", total)
    return marked.select("_row_id", F.col("_id").alias(id_col), "keep_id", "group_size", (is_keep & (F.col("_first").isNull() | (F.col("_first") == F.col("_row_id")))).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with one row of each group of byte-equal texts, that with the
    largest id (cases as in ``exact_groups``)."""
    groups = C.stored(exact_groups(docs, text_col=text_col, id_col=id_col, broadcast_rows=broadcast_rows), "dedup-rows")
    marks = groups.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sum"), F.col("kept").alias("keeps"))
    return C.without(docs, marks, docs[id_col], F.sha2(F.coalesce(docs[text_col], F.lit("")), 256), broadcast_rows)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the group of every document."""
    return exact_groups(C.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY COALESCE(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY COALESCE(text, ''))
"""
