"""Document fingerprints by one-permutation MinHash, in Spark expressions only.

The words of a text are hashed once, runs of five words make shingle hashes, and
each shingle falls into one of ``BINS`` bins by its top bits. A bin keeps its
least hash; an empty bin takes that of a filled one along its own probe sequence
(optimal densification). Of each bin the low ``BITS`` bits are stored, and the
share of equal ones, corrected for chance, estimates the resemblance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
LANES = BINS * BITS // 64
BLANKS = "\t\n\x0b\x0c\r "
# low bit of every stored byte
ONES = 0x0101010101010101
# marks the start of each bin among the sorted hashes: even numbers, hashes are odd
STARTS = [(j << (64 - BIN_BITS)) - (1 << 63) for j in range(BINS)] + [(1 << 63) - 2]


def mixed(n: int) -> int:
    """A fixed scrambling of small numbers (splitmix64)."""
    n = (n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    n = (n ^ n >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    n = (n ^ n >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return n ^ n >> 31


# probe a of bin i is (FIRST[i] + a * STEP[i]) mod BINS: odd steps reach every bin
FIRST = [mixed(i) % BINS for i in range(BINS)]
STEP = [mixed(i + BINS) % BINS | 1 for i in range(BINS)]


def longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the packed bins of column ``text`` (array of
    ``LANES`` longs). A text of fewer than five words is one shingle, a text
    without words too. Each step is a column of its own, computed once a row."""
    w, sh, b, f = C.free_names(df, 4)  # no column of the input is lost
    words = F.split(F.btrim(F.col(text), F.lit(BLANKS)), C.SPACES)
    df = df.withColumn(w, F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.slice(w, F.lit(1), F.greatest(F.lit(1), F.size(w) - (WORDS - 1)))
    shingles = F.transform(runs, lambda x, i: F.xxhash64(F.slice(w, i + 1, F.lit(WORDS))).bitwiseOR(1))
    df = df.withColumn(sh, F.sort_array(F.concat(shingles, longs(STARTS)))).drop(w)
    # what follows a bin's start: its least hash, or the next start if the bin is empty
    least = F.slice(F.filter(sh, lambda x, i: F.get(sh, i - 1).bitwiseAND(1) == 0), 1, BINS)
    df = df.withColumn(b, F.transform(least, lambda x: F.when(x.bitwiseAND(1) == 1, x))).drop(sh)
    first, step = longs(FIRST), longs(STEP)

    def donor(i: Column) -> Column:
        at = lambda a: F.get(b, ((F.get(first, i) + a * F.get(step, i)).bitwiseAND(BINS - 1)).cast("int"))
        later = F.filter(F.transform(F.sequence(F.lit(8), F.lit(BINS - 1)), at), lambda x: x.isNotNull())
        return F.coalesce(*[at(F.lit(a)) for a in range(8)], F.get(later, F.lit(0)))

    filled = F.when(F.exists(b, lambda x: x.isNull()), F.transform(b, lambda x, i: F.coalesce(x, donor(i)))).otherwise(F.col(b))
    df = df.withColumn(f, filled).drop(b)

    def lane(n: Column) -> Column:
        byte = lambda t: F.shiftleft(F.shiftright(F.get(f, (n * 8 + t).cast("int")), 1).bitwiseAND(255), 8 * t)
        out = byte(0)
        for t in range(1, 8):
            out = out.bitwiseOR(byte(t))
        return out

    return df.withColumn(out, F.transform(longs(list(range(LANES))), lane)).drop(f)


def text_form(lanes: Column) -> Column:
    """The fingerprint as lowercase hex digits."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints: the share of equal bins, less
    the share 2^-BITS that is equal by chance."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for n in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, n))
        return F.bit_count(z.bitwiseAND(ONES))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), ((1.0 - differ / F.lit(float(BINS))) - chance) / (1.0 - chance))


def neighbour_fingerprints(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: the id, ``n_chars``, ``edited_sha256``, ``lanes`` and
    ``edited_lanes`` (fingerprints of the text and of its edited text, whose last
    quarter is replaced by the beginning of the next text), ``next_lanes``.

    The next text is that of the next pair (id, hash of text) in order, null ids
    first; after the last comes the first. So rows that repeat an id with the
    same text share one next text. A null text is empty; an empty table gives no
    row; a lone document is its own next. Texts are shuffled once, beginnings of
    next texts (a quarter of them) a second time.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    # texts and keys alone, so that both joins below read the same shuffled texts
    rows = docs.select(
        text.alias("_text"), F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("_id0"), docs[id_col].isNull().cast("int").alias("_null"), F.xxhash64(text).alias("_h")
    )
    key = ["_id0", "_null", "_h"]
    keys = rows.select((1 - F.col("_null")).alias("_some"), *key, F.length("_text").alias("_n")).distinct()
    index = C.numbered(keys, ["_some", "_id0", "_h"], "print-order")
    count = index.agg(F.coalesce(F.max("_index"), F.lit(-1))).first()[0] + 1
    after = index.select(((F.col("_index") + 1) % max(count, 1)).alias("_index"), F.expr("_n div 4").alias("_want"), *[F.col(c).alias(f"_to{c}") for c in key])
    order = C.stored(index.join(after, "_index").select(*key, "_index", "_want", *[f"_to{c}" for c in key]), "print-next")
    placed = rows.join(order.hint("merge"), key)
    begins = placed.select(*[F.col(f"_to{c}").alias(c) for c in key], F.expr("left(_text, _want)").alias("_begin"))
    begins = begins.groupBy(*key).agg(F.first("_begin").alias("_begin"))
    both = placed.join(begins.hint("merge"), key).select(F.when(F.col("_null") == 0, F.col("_id0")).alias("_id"), "_index", F.length("_text").alias("n_chars"), "_text", "_begin")
    keep = F.expr("left(_text, length(_text) - length(_text) div 4)")
    both = both.withColumn("_edited", F.concat(keep, F.col("_begin"))).drop("_begin")
    both = both.withColumn("edited_sha256", F.sha2("_edited", 256))
    both = fingerprinted(both, "_text", "lanes").drop("_text")
    both = fingerprinted(both, "_edited", "edited_lanes").drop("_edited")
    made = C.stored(both, "prints")
    following = made.select(((F.col("_index") + max(count, 1) - 1) % max(count, 1)).alias("_index"), F.col("lanes").alias("next_lanes")).dropDuplicates(["_index"])
    return made.join(following, "_index").select(F.col("_id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "lanes", "edited_lanes", "next_lanes")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of every text, and how near its edit and its next are."""
    rows = neighbour_fingerprints(C.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        text_form(F.col("lanes")).alias("fingerprint"),
        text_form(F.col("edited_lanes")).alias("edited_fingerprint"),
        resemblance(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        resemblance(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
