"""Token counts with a digest cache.

The cache is a folder of Parquet rows (digest of the normalised text, its bytes,
its tokens) below one folder for each tokenizer version, which is a digest of the
tokenizer's file, its library and that library's release. Documents are joined to
it by digest. Only texts that it lacks are encoded, each distinct one once, and
their counts are appended; then every document takes its count from the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import blocks

CACHE = "digest binary, n_bytes long, n_tokens long"
PIECES_KEPT = 200_000  # about 40 MB a worker; beyond it the worker starts over
LONG = 64  # longer pieces are not kept
# white space of Unicode, as the tokenizer's pattern has it
BLANK = "\t-\r \x85\xa0  -     　"
# a blank belongs to the word after it; of several the last one does
PIECE = re.compile(f"[{BLANK}]?[^{BLANK}]+|[{BLANK}]+(?=[{BLANK}][^{BLANK}])|[{BLANK}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """Digest of all that decides a count: file, library, its release, options."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {version(library)} plain".encode()).hexdigest()


def splits_at_blanks(path: str) -> bool:
    """Whether the tokenizer's file proves that no token crosses the borders of
    ``PIECE``: byte-level pieces by the usual pattern, texts as they are, added
    tokens without blanks, which take no blanks beside them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = spec.get("added_tokens") or []
    apart = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    return plain and apart and spec.get("normalizer") is None and spec.get("truncation") is None


class PieceCounts(dict):
    """From a piece of text to the number of its tokens; counts whole texts."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
            self.apart = splits_at_blanks(path)
            added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
            self.added = re.compile("|".join(map(re.escape, added))) if added else None
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = lambda t: len(model.encode(t, out_type=int))
            self.apart, self.added = False, None

    def __missing__(self, piece: str) -> int:
        n = self.size(piece)
        if len(piece) <= LONG:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = n
        return n

    def text(self, text: str) -> int:
        if not self.apart:
            return self.size(text)
        if self.added and self.added.search(text):
            # an added token ends what stands before it, blanks too, and is one token
            parts = self.added.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if len(text) < 1_000_000:
            return sum(map(self.__getitem__, PIECE.findall(text)))
        return sum(self[m.group()] for m in PIECE.finditer(text))


_HELD: dict[str, PieceCounts] = {}


def piece_counts(path: str) -> PieceCounts:
    """This worker's counts, of one tokenizer at a time: it is loaded once a worker,
    not once a task."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = PieceCounts(path)
    return _HELD[path]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Stored counts of a version, one row per digest; None if there are none yet. A
    text that two jobs (or two attempts of one) have appended is there twice, with
    the same count."""
    try:
        found = spark.read.schema(CACHE).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    cache: str,
    *,
    tokenizer: str | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    normal: Callable[[Column], Column] = lambda text: F.coalesce(text, F.lit("")),
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8) and ``n_tokens`` of its
    whole normalised text, by the tokenizers library (a .json file) or
    sentencepiece (.model), without begin, end or padding.

    ``normal`` maps a text to the one that is counted, by default null to the empty
    text, which has no token. Rows that repeat an id or a text each get a row, null
    ids too; columns other than id and text are not read; an empty table gives no
    row. Texts are shuffled only if the cache lacks them; a text that a large part
    of the rows hold is merged before that. Up to ``broadcast_rows`` (32 bytes
    each) missing digests are broadcast to find their texts.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    name = tokenizer_version(tokenizer)
    text = normal(docs[text_col])
    digest = F.unhex(F.sha2(text, 256))
    rows = C.stored(docs.select(docs[id_col].alias("_id"), digest.alias("digest")), "count-rows")
    wanted = rows.groupBy("digest").agg(F.count("*").alias("_copies"))
    cached = read_cache(spark, cache, name)
    if cached is None:
        misses, known, total = wanted.count(), 0, rows.count()
    else:
        wanted = C.stored(wanted.join(cached, "digest", "left"), "count-wanted")
        misses, known, total = wanted.agg(F.count_if(F.col("n_tokens").isNull()), F.count("n_tokens"), F.coalesce(F.sum("_copies"), F.lit(0))).first()

    if misses:
        texts = docs.select(digest.alias("digest"), text.alias("_text"))
        if known:
            missing = wanted.where("n_tokens is null").select("digest")
            texts = texts.join(F.broadcast(missing) if misses <= broadcast_rows else missing, "digest", "left_semi")
        distinct = texts.groupBy("digest").agg(F.first("_text").alias("_text"))
        fields = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = piece_counts(tokenizer)
            try:
                for batch in batches:
                    for a, held in blocks(batch.column("_text")):
                        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in held]
                        tokens = [counts.text(t) for t in held]
                        yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, len(held)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], schema=fields)
            finally:
                counts.clear()  # a worker waits for its next task, maybe of another job, without them

        distinct.mapInArrow(count, CACHE).write.mode("append").parquet(f"{cache}/version={name}")
        counted = wanted.select("digest", "_copies").join(read_cache(spark, cache, name), "digest")
        wanted = C.stored(counted, "count-wanted")
    elif cached is None:  # no row at all
        wanted = wanted.select("digest", "_copies", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"))
    return C.lookup(rows, wanted, ["digest"], "_copies", total).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts of every document, from a cache that is empty at first."""
    counts = token_counts(C.table(spark, sf_dir, "documents"), C.shared_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
