"""Packing by concatenating and cutting.

All documents' ids stand in one long row, which is cut every ``length`` ids.
Pass one encodes, sums inside each unit of the input (a file split, or a
partition where there is no file) and stores ids with starts inside the unit.
Running sums of the units' totals are the units' global starts. Pass two cuts
each document by its global start alone, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import blocks, default_tokenizer, piece_ids

UNIT = ["_file", "_block", "_part"]
# the order of units: folders, then files by their part number as a number (names
# of parts have five digits and more), then places in the file
ORDER = [r"regexp_extract(_file, '^(.*/)[^/]*$', 1)", r"try_cast(regexp_extract(_file, 'part-([0-9]+)[^/]*$', 1) AS decimal(38,0))", *UNIT]


def encoded_units(docs: DataFrame, *, text_col: str, id_col: str, end_id: int, tokenizer: str) -> DataFrame:
    """Pass one, stored: unit, start inside the unit, id, number of ids, ids."""
    end = end_id.to_bytes(4, "little")
    schema = "_file string, _block long, _part int, _local long, doc_id long, doc_tokens long, _ids binary"
    fields = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("_part", pa.int32()), ("_local", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("_ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sums = piece_ids(tokenizer), {}
        for batch in batches:
            for a, texts in blocks(batch.column("_text")):
                ids = [x + end for x in pieces.texts(texts)]
                part, local = batch.slice(a, len(texts)), []
                for unit, x in zip(zip(*(part.column(c).to_pylist() for c in UNIT), strict=True), ids, strict=True):
                    local.append(sums.get(unit, 0))
                    sums[unit] = local[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in UNIT), pa.array(local, pa.int64()), part.column("_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=fields)

    rows = docs.select(
        F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.spark_partition_id().alias("_part"),
        docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"),
    )
    return C.stored(rows.mapInArrow(encode, schema), "pack-ids")


def concat_and_cut(
    docs: DataFrame,
    *,
    length: int = 4096,
    text_col: str = "text",
    id_col: str = "doc_id",
    end_id: int = 2,
    tokenizer: str | None = None,
) -> DataFrame:
    """Boundary records, one per piece: ``doc_id``, ``start`` (the document's ids
    before the piece), ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence. Every sequence but the last is
    full.

    Documents stand in the order of the files that they are read from (path,
    place in the file). A null text is empty: its end id alone. Null ids and
    repeated rows are packed as rows of their own, other columns are not read,
    and an empty table gives no piece. Unit totals, one row per file split, are
    summed up in one small window and broadcast.
    """
    stored = encoded_units(docs, text_col=text_col, id_col=id_col, end_id=end_id, tokenizer=tokenizer or default_tokenizer())
    totals = stored.groupBy(*UNIT).agg(F.sum("doc_tokens").alias("_total"))
    before = Window.orderBy(*[F.expr(x) for x in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    # one row per file split of the input
    starts = F.broadcast(totals.select(*UNIT, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_unit")))
    placed = stored.join(starts, UNIT).select("doc_id", "doc_tokens", (F.col("_unit") + F.col("_local")).alias("_global"), "_ids")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    fields = pa.schema(list(zip(names, kinds, strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            rows = []
            for doc, n, begin, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "_global", "_ids")), strict=True):
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    size = min(length - offset, n - at)
                    rows.append((doc, at, size, ids[4 * at : 4 * (at + size)], n, sequence, offset))
                    at += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=fields)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = 4096) -> DataFrame:
    """Whole sequences from boundary records: ``sequence_id``, ``ids`` (little-
    endian 32-bit, zero-padded to ``length``), ``bounds`` (offset, length and
    document of each piece). A group has ``length`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    whole = F.rpad(joined, F.lit(4 * length), F.lit(b"\x00"))
    return rows.select("sequence_id", whole.alias("ids"), F.transform("_p", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["start"])).alias("bounds"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every piece of the concatenated and cut documents."""
    return piece_digests(concat_and_cut(C.table(spark, sf_dir, "documents")))
