"""Token-id files: frames of zstandard with one shared dictionary.

A folder holds ``dictionary`` (one row: hash, bytes) and ``segments``. A segment
has about a megabyte of frames, one frame per document, and the index to find
them: ids of the documents, where each frame begins, how many token ids it has,
and the hash of the dictionary it needs. To read one short document, its
segment's row is found by the id range and its frame alone is decompressed.
Segments are Parquet rows, so that Spark commits, retries and finds them on any
store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import blocks, default_tokenizer, piece_ids

SEGMENT = "part int, segment int, first_id long, last_id long, n_docs long, n_tokens long, local_start long, dictionary string, doc_ids array<long>, counts array<int>, offsets array<long>, frames binary"


def _segment_fields() -> pa.Schema:
    return pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("local_start", pa.int64()),
        ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary()),
    ])


def train_dictionary(docs: DataFrame, *, text_col: str, id_col: str, end_id: int, tokenizer: str, samples: int, sample_chars: int, size: int) -> bytes:
    """A dictionary trained on serialized ids of at most ``samples`` documents,
    chosen by a hash of the id, and ``sample_chars`` characters of each. Empty if
    there is too little to train on."""
    import zstandard

    share = min(1.0, samples / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(docs[id_col], F.lit("dictionary")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = [r[0] for r in chosen.select(F.substring(docs[text_col], 1, sample_chars)).limit(2 * samples).collect()]
    end = end_id.to_bytes(4, "little")
    ids = [x + end for x in piece_ids(tokenizer).texts(texts)]
    try:
        return zstandard.train_dictionary(size, ids, level=3).as_bytes() if sum(map(len, ids)) > 8 * size else b""
    except zstandard.ZstdError:
        return b""


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    end_id: int = 2,
    tokenizer: str | None = None,
    segment_bytes: int = 1 << 20,
    samples: int = 2_000,
    sample_chars: int = 8_192,
    dictionary_bytes: int = 1 << 16,
) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the ids
    in ascending order of id, null ids first; equal ids stand in the order of a
    hash of their texts, each a document of its own. Other columns are not read;
    an empty table gives no segment. The dictionary is the only part fitted to a
    sample (``samples`` texts of ``sample_chars`` characters)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    shared = train_dictionary(docs, text_col=text_col, id_col=id_col, end_id=end_id, tokenizer=tokenizer, samples=samples, sample_chars=sample_chars, size=dictionary_bytes)
    name, end, fields = hashlib.sha256(shared).hexdigest(), end_id.to_bytes(4, "little"), _segment_fields()
    spark.createDataFrame([(name, bytearray(shared))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pieces, part = piece_ids(tokenizer), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None).compress
        start = number = 0
        docs_, counts, offsets, frames, size = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            row = [part, number, docs_[0], docs_[-1], len(docs_), sum(counts), start, name, docs_, counts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            ids = batch.column("_id").to_pylist()
            for a, texts in blocks(batch.column("_text")):
                for doc, x in zip(ids[a : a + len(texts)], pieces.texts(texts), strict=True):
                    frame = pack(x + end)
                    docs_.append(doc)
                    counts.append(len(x) // 4 + 1)
                    offsets.append(size)
                    frames.append(frame)
                    size += len(frame)
                    if size >= segment_bytes:
                        yield segment()
                        start, number = start + sum(counts), number + 1
                        docs_, counts, offsets, frames, size = [], [], [], [], 0
        if docs_:
            yield segment()

    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, SEGMENT).write.parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a folder: ``doc_id``, ``start`` (ids of all documents before),
    ``n_tokens``, ``ids`` (little-endian 32-bit). With ``doc_ids`` (a short
    list), only segments whose id range holds one are read, and only the frames
    of those documents are decompressed. The starts of parts are running sums of
    one row per written partition."""
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    dictionary = spark.read.schema("hash string, dictionary binary").parquet(f"{path}/dictionary").first()
    shared, name = bytes(dictionary["dictionary"]), dictionary["hash"]
    if hashlib.sha256(shared).hexdigest() != name:
        raise ValueError("the dictionary is not the one that its hash names")
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start")))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        within = [F.col("first_id").isNull() | ((F.col("first_id") <= i) & (F.col("last_id") >= i)) for i in wanted]
        hit = F.lit(False)
        for w in within:
            hit = hit | w
        segments = segments.where(hit)
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None).decompress
        for batch in (b.slice(i, 1) for b in batches for i in range(len(b))):
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a segment needs another dictionary")
                frames, at, out = memoryview(row["frames"]), row["_part_start"] + row["local_start"], []
                ends = [*row["offsets"][1:], len(frames)]
                for doc, n, a, b in zip(row["doc_ids"], row["counts"], row["offsets"], ends, strict=True):
                    if wanted is None or doc in wanted:
                        out.append((doc, at, n, unpack(frames[a:b], max_output_size=4 * n)))
                    at += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    placed = segments.join(starts, "part").select("local_start", "dictionary", "doc_ids", "counts", "offsets", "frames", "_part_start")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what the files say of each document."""
    path = C.shared_path(spark, "token-files")
    write_token_files(C.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
